"""Scoring with an n-gram language model as a weighted backoff automaton.

States are the word sequences seen in training, of up to ``order - 1`` words;
an arc reads a word that followed its state, a failure arc leads to the state
without the oldest word. Weights are base-10 logarithms of Dirichlet-smoothed
probabilities, p(w|h) = (c(hw) + MU p(w|h')) / (c(h) + MU), above the add-one
unigram, so a failure arc costs MU / (c(h) + MU) and all words of a state sum to 1.

The whole model grows with the corpus and no task holds it. Documents are coded
in blocks; a block sends its distinct n-grams, with their counts, to hashed
buckets, gets back the counts over all training documents, and so holds that
part of the automaton which its own texts can reach.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pairsmith.llm import shared

ORDER = 2
MU = 4.0
#: Tokens after which a block ends; a longer text is a block of its own.
BLOCK_TOKENS = 2_000_000
#: N-grams of a bucket, on average, before blocks are merged.
BUCKET_GRAMS = 4_000_000
#: Tokens of a stretch of a block; stretches are traversed side by side.
STRETCH = 512

END, START = 0, 1
_END, _START = (xxhash.xxh3_64_intdigest(x) for x in (b"\n", b"\r"))  # no word holds these


def _small(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(shared.packed(array))


def _big(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _coded(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """A row for each block: ids, training flags, lengths, local word numbers and the words' hashes."""
    import uuid

    local: dict[bytes, int] = {}
    ids, flags, lengths, parts, held, kind = [], [], [], [], 0, None

    def row() -> pa.RecordBatch:
        hashes = np.fromiter((_END, _START, *map(xxhash.xxh3_64_intdigest, local)), np.uint64, len(local) + 2)
        tokens = np.concatenate(parts)
        columns = [[uuid.uuid4().hex], [ids], [flags], [_small(np.array(lengths, np.int64))], [_small(tokens)], [_small(hashes)], [held]]
        kinds = [pa.string(), pa.list_(kind), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "ids", "flags", "lengths", "tokens", "hashes", "n_tokens"])

    for batch in batches:
        kind = batch.column(0).type
        for key, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shared.texts(batch, "text")):
            own = shared.words(text)
            ids.append(key)
            flags.append(flag)
            lengths.append(len(own) + 1)
            parts.append(np.fromiter((*(local.setdefault(w, len(local) + 2) for w in own), END), np.int32, len(own) + 1))
            held += len(own) + 1
            if held >= BLOCK_TOKENS:
                yield row()
                local = {}
                ids, flags, lengths, parts, held = [], [], [], [], 0
    if ids:
        yield row()


class Block:
    """The token stream of a block, with ``order - 1`` starts before each text."""

    def __init__(self, order: int, flags, lengths: bytes, tokens: bytes, hashes: bytes):
        self.order, pad = order, order - 1
        self.lengths, words, hashed = _big(lengths, np.int64), _big(tokens, np.int32), _big(hashes, np.uint64)
        ends = np.cumsum(self.lengths)
        place = np.arange(len(words)) + np.repeat(np.arange(1, len(ends) + 1) * pad, self.lengths)
        self.said = np.zeros(len(words) + pad * len(ends), bool)
        self.said[place] = True
        self.stream = np.full(len(self.said), START, np.int32)
        self.stream[place] = words
        self.last_start = np.zeros(len(self.said), bool)
        if pad:
            self.last_start[place[ends - self.lengths] - 1] = True
        flag = np.array([bool(x) for x in flags])
        self.trained = np.repeat(flag, self.lengths + pad)
        self.keys = [hashed[self.stream]]

    def key(self, k: int) -> np.ndarray:
        """Fingerprints of the k-grams that end at each place."""
        while len(self.keys) < k:
            longer = np.zeros(len(self.stream), np.uint64)
            longer[1:] = shared.joined_hash(self.keys[-1][:-1], self.keys[0][1:])
            self.keys.append(longer)
        return self.keys[k - 1]

    def grams(self, k: int):
        """(distinct keys in order, first place of each, places of all k-grams, their number among the distinct ones)."""
        places = np.flatnonzero(self.said | self.last_start if k < self.order else self.said)
        keys = self.key(k)[places]
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        number = np.empty(len(keys), np.int32)
        number[order] = np.cumsum(new) - 1
        return ordered[new], places[order[new]], places, number


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of the hash begins in sorted keys, and the end."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _sent(batches: Iterator[pa.RecordBatch], order: int, buckets: int) -> Iterator[pa.RecordBatch]:
    names = ["gram", "bucket", "block", "keys", "counts"]
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            block = Block(order, row["flags"], row["lengths"], row["tokens"], row["hashes"])
            for k in range(1, order + 1):
                keys, _, places, number = block.grams(k)
                counts = np.bincount(number, block.trained[places], len(keys)).astype(np.int64)
                at = _bounds(keys, buckets)
                for b in np.flatnonzero(np.diff(at)).tolist():
                    part = slice(at[b], at[b + 1])
                    columns = [[k], [b], [row["block"]], [shared.packed(keys[part])], [_small(counts[part])]]
                    kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _counted(group: pa.Table) -> pa.Table:
    """Corpus counts of a bucket's n-grams for each block, and a row of totals with a null block."""
    rows = group.to_pylist()
    keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
    counts = [_big(r["counts"], np.int64) for r in rows]
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(number, np.concatenate(counts), len(distinct)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    answers = [_small(total[number[end - len(k) : end]]) for k, end in zip(keys, ends)]
    real = total[distinct != np.uint64(_START)]
    columns = [[rows[0]["gram"]] * (len(rows) + 1), [rows[0]["bucket"]] * (len(rows) + 1), [*(r["block"] for r in rows), None], [*answers, None], [0] * len(rows) + [int(real.sum())], [0] * len(rows) + [int((real > 0).sum())]]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["gram", "bucket", "block", "counts", "total", "kinds"])


class Automaton:
    """The part of the backoff automaton that one block can reach.

    State 0 is the root; every other state is a seen sequence of fewer than
    ``order`` words. An arc (state, word) has a weight and a target, the longest
    state that the sequence read so far ends with; the root reads every word.
    A state without an arc for a word is left by its failure arc, which has a
    weight too, to the state without its first word.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], n: int, v: int, mu: float):
        self.block = block
        number, state_of, n_states = [], [], 1
        fail_to, fail_weight = [np.zeros(1, np.int32)], [np.zeros(1)]
        arcs: list[tuple[np.ndarray, ...]] = []
        self.n_words = int(block.stream.max()) + 1
        for k in range(1, block.order + 1):
            keys, first, places, at_place = block.grams(k)
            at = np.full(len(block.stream), -1, np.int32)
            at[places] = at_place
            number.append(at)
            c = counts[k - 1].astype(np.float64)
            # What a gram's last words are as a state, without its first word; for one word that is the root.
            shorter = state_of[-1][number[-2][first]] if k > 1 else np.zeros(len(c), np.int32)
            seen, word = c > 0, block.stream[first]
            if k == 1:
                p = (c + 1) / (n + v + 1)
            else:
                context = number[-2][first - 1]
                p = (c + mu * p[number[-2][first]]) / (counts[k - 2][context] + mu)
            if k < block.order:
                own = np.where(seen, n_states - 1 + np.cumsum(seen), shorter).astype(np.int32)
                n_states += int(seen.sum())
                fail_to.append(shorter[seen])
                fail_weight.append(np.log10(mu / (c[seen] + mu)))
                state_of.append(own)
            target = own if k < block.order else shorter
            if k == 1:
                self.root_weight, self.root_to = np.zeros(self.n_words), np.zeros(self.n_words, np.int32)
                self.root_weight[word], self.root_to[word] = np.log10(p), target
            else:
                source = state_of[k - 2][context]
                arcs.append((source[seen].astype(np.int64) * self.n_words + word[seen], np.log10(p[seen]), target[seen]))
        self.fail_to, self.fail_weight = np.concatenate(fail_to), np.concatenate(fail_weight)
        keys, weights, targets = (np.concatenate(x) for x in zip(*arcs)) if arcs else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32))
        order = np.argsort(keys)
        self.arcs, self.arc_weight, self.arc_to = keys[order], weights[order], targets[order]
        starts = np.flatnonzero(block.last_start)
        self.start = int(state_of[-1][number[block.order - 2][starts[0]]]) if len(starts) else 0
        self.unigram = number[0]
        block.keys.clear()

    def read(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weights of reading a word from each state, failure arcs included, and the states reached."""
        weight, to, at = np.zeros(len(states)), np.zeros(len(states), np.int32), states.copy()
        open_ = np.arange(len(states))
        while len(open_):
            inner = at[open_] > 0
            done = open_[~inner]
            weight[done] += self.root_weight[words[done]]
            to[done] = self.root_to[words[done]]
            open_ = open_[inner]
            wanted = at[open_].astype(np.int64) * self.n_words + words[open_]
            arc = np.searchsorted(self.arcs, wanted)
            arc[arc == len(self.arcs)] = 0
            read = self.arcs[arc] == wanted if len(self.arcs) else np.zeros(len(open_), bool)
            done, arc = open_[read], arc[read]
            weight[done] += self.arc_weight[arc]
            to[done] = self.arc_to[arc]
            open_ = open_[~read]
            weight[open_] += self.fail_weight[at[open_]]
            at[open_] = self.fail_to[at[open_]]
        return weight, to

    def traverse(self) -> np.ndarray:
        """The weight of each said token, from one left-to-right pass that carries a state.

        The block's texts, one after the other, are cut into stretches that are
        passed side by side. A stretch is entered ``order - 1`` tokens early: the
        state after these is the same from wherever they are read.
        """
        block, length = self.block, len(self.block.stream)
        begin = np.arange(0, length, STRETCH)
        states, weight = np.zeros(len(begin), np.int32), np.zeros(length)
        for step in range(1 - block.order, STRETCH):
            place = begin + step
            there = np.flatnonzero((place >= 0) & (place < length))
            at = place[there]
            states[there[block.last_start[at]]] = self.start
            there, at = there[block.said[at]], at[block.said[at]]
            got, states[there] = self.read(states[there], block.stream[at])
            if step >= 0:
                weight[at] = got
        return weight[block.said]


def score(docs: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text", order: int = ORDER, mu: float = MU) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Rows where ``train`` is true teach; null counts as false. A null text is
    empty and has the end token only. Ids may be null or repeated: each row is
    scored. Without training rows every token has probability 1. N-grams are
    told apart by 64-bit fingerprints.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(train, F.lit(False)).alias("flag"), F.col(text_column).alias("text"))
    id_type = rows.schema["id"].dataType
    fields = [("block", T.StringType()), ("ids", T.ArrayType(id_type)), ("flags", T.ArrayType(T.BooleanType())), ("lengths", T.BinaryType()), ("tokens", T.BinaryType()), ("hashes", T.BinaryType()), ("n_tokens", T.LongType())]
    blocks = shared.written(rows.mapInArrow(lambda b: _coded(b, order), T.StructType([T.StructField(n, t) for n, t in fields])), "lm-blocks")
    tokens = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    buckets = max(1, -(-tokens * order // BUCKET_GRAMS))
    sent = blocks.mapInArrow(lambda b: _sent(b, order, buckets), "gram int, bucket int, block string, keys binary, counts binary")
    sent = sent.repartition(order * buckets, "gram", "bucket")  # a bucket a task, however many there are
    counted = shared.written(sent.groupBy("gram", "bucket").applyInArrow(_counted, "gram int, bucket int, block string, counts binary, total long, kinds long"), "lm-counts")
    n, v = counted.where("block is null and gram = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            for i in range(batch.num_rows):  # one block at a time
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(order, row["flags"], row["lengths"], row["tokens"], row["hashes"])
                parts: list[list] = [[] for _ in range(order)]
                for part in sorted(row["parts"], key=lambda x: (x["gram"], x["bucket"])):
                    parts[part["gram"] - 1].append(_big(part["counts"], np.int64))
                counts = [np.concatenate(p) for p in parts]
                automaton = Automaton(block, counts, n, v, mu)
                weights = automaton.traverse()
                known = counts[0][automaton.unigram[block.said]]
                base = np.log10((known + 1) / (n + v + 1))
                starts = np.cumsum(block.lengths) - block.lengths
                sums = [block.lengths, np.add.reduceat((known > 0).astype(np.int64), starts), np.full(len(starts), n), np.add.reduceat(base, starts), np.add.reduceat(weights, starts)]
                yield pa.RecordBatch.from_arrays([ids[i].values, *map(pa.array, sums)], names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    own = counted.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("gram", "bucket", "counts")).alias("parts"))
    schema = T.StructType([T.StructField("id", id_type)] + [T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(x, T.DoubleType()) for x in ("base_score", "score")])
    return blocks.drop("n_tokens").join(own, "block").mapInArrow(scored, schema).withColumnRenamed("id", id_column)
