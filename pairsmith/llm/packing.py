"""Best-fit packing of token pieces into sequences by bin completion.

Only the number of pieces of each length matters for a packing, and there are
no more lengths than a sequence has tokens. So tasks cut texts into pieces, the
counts by length (a table bounded by the capacity) are packed as a whole, and
the resulting plan, a list of fillings with the number of sequences of each,
is dealt back to the pieces by their place among those of equal length.

The search fills the sequence of the largest open length first: it enumerates
the undominated fillings of the room beside it, uses one for as many sequences
as the counts allow, goes on with what is left, and comes back to other
fillings and numbers while the waste so far leaves a better result possible.
Best fit packs the whole counts at first, and what is open at some states on
the way; the best of these is the incumbent.
"""

import os
import re
import struct
import sys
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pairsmith.llm import shared

CAPACITY = 2048
END = 0
#: States and fillings of a state that the search looks at before it settles for the incumbent.
NODES = 2_000
FILLINGS = 24
#: Steps of one enumeration of fillings.
STEPS = 400
#: States between two best-fit packings of what is open.
REFIT = 50
#: Words whose ids a worker remembers, and the longest of them.
MEMORY = 800_000
MEMORY_WORD = 64

# A word with the one blank or line break before it, and with any longer white space after it.
_PART = re.compile(r"\s*\S+(?:(?![ \n]\S)\s+\S*)*|\s+")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    A text is cut before each blank or line break that stands alone, where the
    tokenizer's own pattern always cuts, so the ids of the parts are the parts
    of the ids. Those of a word are remembered; new words are encoded in one
    string, where the tokens with a blank or line break say where each begins.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.opens[number] = token.startswith("\u0120") or token == "\u010a"  # blank, line break
        self.known: dict[str, bytes] = {}

    def _encoded(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, keys: set[str]) -> None:
        """Remember ids. The key of a word after a blank is the word, after a line break both; other parts have a mark before them."""
        words = [k for k in keys if k[:1] not in ("\0", "")]
        marked = [k for k in keys if k[:1] in ("\0", "")]
        self.known.update((k, ids.tobytes()) for k, ids in zip(marked, self._encoded([k[1:] if k else " " for k in marked])))
        if words:
            ids = self._encoded(["".join([k if k[0] == "\n" else " " + k for k in words])])[0]
            starts = (4 * np.flatnonzero(self.opens[ids])).tolist()
            whole = ids.tobytes()
            self.known.update(zip(words, [whole[a:b] for a, b in zip(starts, [*starts[1:], len(whole)])], strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MEMORY:
            self.known.clear()
        split = [("\0" + t).replace("\n", " \n").split(" ") if _even(t) else ["\0" + p for p in _PART.findall(t)] for t in texts]
        new = set().union(*split).difference(self.known)
        self._learn(new)
        found = [b"".join(map(self.known.__getitem__, keys)) for keys in split]
        for key in new:
            if len(key) > MEMORY_WORD:
                del self.known[key]
        return found


def _even(text: str) -> bool:
    """Whether all white space is single blanks and line breaks between words, and no word has the mark of keys."""
    words = text.split()
    between = len(words) - 1
    return text.count(" ") + text.count("\n") == between == len(text) - len("".join(words)) and "\0" not in text


def remembered(path: str) -> Encoder:
    """The encoder of this Python worker, which keeps its words from task to task."""
    held = sys.modules.setdefault("pairsmith_encoders", ModuleType("pairsmith_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only a longer one is cut, and only its first piece may be shorter."""
    first = (length - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def pieces(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, row[, ids]) of all documents; ``row`` tells rows apart, repeated ones too."""
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = remembered(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            at, out, buffers = [], [], []
            for i, ids in enumerate(encoder.ids([t or "" for t in batch.column(1).to_pylist()])):
                ids += struct.pack("<I", END)
                for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    at.append(i)
                    out.append((piece, start, length, zlib.crc32(part), row))
                    row += 1
                    if with_ids:
                        buffers.append(part)
            columns = [batch.column(0).take(pa.array(at, pa.int64()))]
            columns += [pa.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * 5, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(buffers, pa.binary())] if with_ids else []), names=names)

    names = ["id", "piece", "start", "length", "ids_crc32", "row"] + ["ids"] * with_ids
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, row long" + ", ids binary" * with_ids)


# The search. Counts are by length, an array with a place for each length up to the capacity.


def least_sequences(counts: np.ndarray) -> int:
    """A lower bound: for any k, pieces above capacity - k stand alone, and those from k on share the room that the larger halves leave."""
    capacity = len(counts) - 1
    number, size = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, counts * np.arange(capacity + 1)))
    k, half = np.arange(capacity // 2 + 1), capacity // 2
    alone = number[-1] - number[capacity - k + 1]
    large = number[capacity - k + 1] - number[half + 1]
    room = large * capacity - (size[capacity - k + 1] - size[half + 1])
    small = size[half + 1] - size[k]
    return int((alone + large + np.maximum(0, -((room - small) // capacity))).max())


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(filling, times) by best fit from the largest length on; sequences of one filling are one entry."""
    capacity = len(counts) - 1
    open_: dict[int, Counter] = {}
    rooms: list[int] = []

    def put(room: int, filling: tuple, times: int) -> None:
        if room not in open_:
            open_[room] = Counter()
            insort(rooms, room)
        open_[room][filling] += times

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            i = bisect_right(rooms, length - 1)
            if i < len(rooms):
                room = rooms[i]
                inside = min(left, room // length)
                filling, there = open_[room].popitem()
                times = min(there, left // inside)
                if there > times:
                    open_[room][filling] = there - times
                elif not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, filling = capacity, ()
                inside = min(left, capacity // length)
                times = left // inside
            put(room - inside * length, filling + (length,) * inside, times)
            left -= inside * times
    return [x for room in open_.values() for x in room.items()]


def fillings(room: int, counts: list[int], lengths: list[int], most_waste: int) -> list[tuple[int, ...]]:
    """Undominated fillings of a room that waste ``most_waste`` at most, the fullest first.

    ``lengths`` are the open ones in ascending order. A length that fits exactly
    dominates all other ends of a filling. A filling is dominated if an unused
    length still fits, or fits in place of a shorter one of its own or of two.
    """
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    steps = 0

    def fill(left: int, upper: int, chosen: tuple[tuple[int, int], ...]) -> None:
        nonlocal steps
        i, ends = bisect_right(lengths, left, 0, upper), True
        while i:
            i -= 1
            length = lengths[i]
            for k in range(min(counts[length], left // length), 0, -1):
                if steps >= STEPS or len(found) >= FILLINGS:
                    return
                ends = False
                steps += 1
                fill(left - k * length, i, (*chosen, (length, k)))
                if length == left:
                    return
        if ends and left <= most_waste and not dominated(dict(chosen), left):
            found.append((left, chosen))

    def dominated(chosen: dict[int, int], waste: int) -> bool:
        own = [0, *chosen]
        own += [a + b for a, k in chosen.items() for b in chosen if a > b or a == b and k > 1]
        for size in own if waste else ():
            i = bisect_right(lengths, size + waste)
            while i and lengths[i - 1] > size:
                i -= 1
                if counts[lengths[i]] > chosen.get(lengths[i], 0):
                    return True
        return False

    fill(room, len(lengths), ())
    flat = [(waste, tuple(length for length, k in chosen for _ in range(k))) for waste, chosen in found]
    return [chosen for _, chosen in sorted(flat, key=lambda x: (x[0], [-c for c in x[1]]))]


def complete(counts: np.ndarray, nodes: int = NODES) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(filling, times) of the best packing found, and the lower bound; equal numbers prove it minimal.

    One filling is tried for as many sequences as the counts and the waste allow,
    then for half as many and for one, so small problems are searched in full.
    """
    capacity = len(counts) - 1
    tokens = int((counts * np.arange(capacity + 1)).sum())
    bound, best = least_sequences(counts), best_fit(counts)
    number = lambda packing: sum(times for _, times in packing)
    fewest, seen = number(best), 0

    def branches(open_: np.ndarray, path, used: int, waste: int):
        """States after one more filling, each made when it is its turn."""
        lengths = np.flatnonzero(open_).tolist()
        beside = open_.tolist()
        beside[lengths[-1]] -= 1
        for chosen in fillings(capacity - lengths[-1], beside, lengths, (fewest - 1) * capacity - tokens - waste):
            filling = (lengths[-1], *chosen)
            need = Counter(filling)
            lost = capacity - sum(filling)
            most = min(int(open_[length]) // k for length, k in need.items())
            if lost:
                most = min(most, max(1, ((fewest - 1) * capacity - tokens - waste) // lost))
            for times in dict.fromkeys((most, (most + 1) // 2, 1)):
                left = open_.copy()
                for length, k in need.items():
                    left[length] -= times * k
                yield left, (path, filling, times), used + times, waste + times * lost

    stack = [iter([(counts, None, 0, 0)])]
    while stack and fewest > bound and seen < nodes:
        state = next(stack[-1], None)
        if state is None:
            stack.pop()
            continue
        open_, path, used, waste = state
        if (fewest - 1) * capacity - tokens < waste or used + least_sequences(open_) >= fewest:
            continue
        seen += 1
        over = not open_.any()
        if over or seen % REFIT == 0:
            rest = best_fit(open_)
            if used + number(rest) < fewest:
                best, fewest = rest, used + number(rest)
                while path:
                    best.append(path[1:])
                    path = path[0]
        if not over:
            stack.append(branches(*state))
    return best, bound


def slots(packing: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, first sequence, in each, offset): the places that a filling gives to pieces of a length, by their rank."""
    given: Counter = Counter()
    out, first = [], 0
    for filling, times in packing:
        at = 0
        for length, inside in sorted(Counter(filling).items(), reverse=True):
            out.append((length, given[length], given[length] + times * inside, first, inside, at))
            given[length] += times * inside
            at += length * inside
        first += times
    return out


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): a row for each piece of each document.

    ``tokenizer`` is a file that executors can read. A document is its ids, then
    id 0; a null text is empty, so its piece is that one id. Rows with null or
    repeated ids are documents like others; columns but the id are left out.
    Sequences have gapless offsets from 0. Numbers of sequences do not depend on
    how rows are dealt to tasks; which of the pieces of equal length comes where
    does. An empty table gives no rows.

    Collected are counts by length, and broadcast are the plan's slots: at most
    ``capacity`` and capacity ** 1.5 rows, whatever the corpus has.
    """
    spark = docs.sparkSession
    table = shared.written(pieces(docs, tokenizer, id_column, text_column, capacity, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    numbers = np.zeros(capacity + 1, np.int64)
    numbers[list(counts)] = list(counts.values())
    packing, _ = complete(numbers)
    places = spark.createDataFrame(slots(packing), "slot_length long, lo long, hi long, first long, inside long, at long")

    # The rank among pieces of equal length: hashed buckets, about as many as rows in each, and what comes before a bucket.
    sizes = [(length, max(1, round((n / 4) ** 0.5))) for length, n in counts.items()]
    sizes = spark.createDataFrame(sizes, "of_length long, buckets long")
    rows = table.join(F.broadcast(sizes), F.col("length") == F.col("of_length"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "row"), F.col("buckets"))).drop("of_length", "buckets")
    numbers = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = numbers.select("length", "bucket", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "row")) - 1
    ranked = rows.withColumn("inside_bucket", inside).join(numbers, ["length", "bucket"]).withColumn("place", F.col("before") + F.col("inside_bucket"))
    slot = (F.col("length") == F.col("slot_length")) & (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))
    put = ranked.join(F.broadcast(places), slot)
    turn = F.col("place") - F.col("lo")
    return put.select(
        F.col("id").alias(id_column), "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(turn / F.col("inside"))).alias("sequence_id"),
        (F.col("at") + turn % F.col("inside") * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences themselves, from rows with ids; a sequence is of bounded size."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    return rows.select("sequence_id", "n_tokens", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
