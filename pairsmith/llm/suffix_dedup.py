"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier.
All suffixes of a corpus are too many to sort in one place, so those that can be
equal for LENGTH bytes are brought together first: every window of LENGTH bytes
is named after its minimizer, the least fingerprint of its ``GRAM``-byte
strings, and equal windows have equal minimizers. Anchors, the places that are a
minimizer of some window, are counted over the corpus; only those that occur
again are sent with their surroundings. Where they meet, the suffixes that start
at their windows are sorted, the common prefixes of neighbours (up to LENGTH)
are taken, and previous and next smaller positions give the earlier matches.
"""

import itertools
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pairsmith.llm import shared
from pairsmith.session import scratch

LENGTH = 100
GRAM = 40
#: Windows of a text that are looked at in one go.
STRETCH = 1 << 23
#: Bytes of text of a block whose anchors are sent together.
BLOCK_BYTES = 16 << 20
#: Anchors of a bucket, on average, before blocks are merged.
BUCKET_ANCHORS = 1_000_000
LEAST_BUCKETS = 64
#: Buckets between the first blocks of tasks that follow each other.
BLOCK_STRIDE = 3
#: Strings that are compared at a time.
COMPARED = 1 << 16

_MIXER = np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)


def byte_windows(data: bytes, length: int) -> np.ndarray:
    """64-bit fingerprints of all strings of ``length`` bytes, eight bytes at a time."""
    n = len(data) - length + 1
    if n <= 0 or length < 8:
        return shared.window_hashes(np.frombuffer(data, np.uint8), length)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = np.full(n, length, np.uint64)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        out ^= words[at : at + n]
        out *= _MIXER
        out ^= out >> np.uint64(32)
    return out


def minimizers(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least value of each run of ``width`` values; up to 2^24 values, compared by their upper 40 bits."""
    n = len(values) - width + 1
    low, span = values & ~_PLACE | np.arange(len(values), dtype=np.uint64), 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return (np.minimum(low[:n], low[width - span : width - span + n]) & _PLACE).astype(np.int64)


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """(fingerprint, place, first window, last window) of each anchor of a text, in order of windows."""
    values, width, parts = byte_windows(data, gram), length - gram + 1, []
    for start in range(0, len(values) - width + 1, STRETCH):
        parts.append(minimizers(values[start : start + STRETCH + width - 1], width) + start)
    if not parts:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3
    places = np.concatenate(parts)
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    return values[places[first]], places[first], first, np.concatenate([first[1:], [len(places)]]) - 1


def previous_factors(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factors: ``order`` has positions in suffix order, ``common[i]`` what i and i - 1 there share.

    For each suffix, in suffix order, the previous and the next suffix with a
    smaller position are found by following links past larger ones; the longest
    common prefix with either is the longest match that starts earlier.
    """
    n = len(order)
    best = np.zeros(n, common.dtype)
    for side in (1, -1):
        position = order[::side]
        least = (common if side == 1 else np.concatenate([[0], common[:0:-1]])).copy()
        before = np.arange(n) - 1
        open_ = np.arange(n)
        while len(open_):
            at = before[open_]
            larger = (at >= 0) & (least[open_] > 0)
            larger[larger] = position[at[larger]] > position[open_[larger]]
            open_, at = open_[larger], at[larger]
            nearer, link = np.minimum(least[open_], least[at]), before[at]
            least[open_], before[open_] = nearer, link
        best = np.maximum(best, np.where(before >= 0, least, 0)[::side])
    return best


def _plain_order(data: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``suffix_order`` by Python's own comparison, for short windows and for fingerprints that deceive."""
    own = [data[s : s + length] for s in starts.tolist()]
    order = sorted(range(len(own)), key=lambda i: (own[i], i))
    common = [0, *(len(os.path.commonprefix([own[i], own[k]])) for i, k in itertools.pairwise(order))]
    return np.array(order, np.int64), np.array(common[: len(own)], np.int32)


def suffix_order(data: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` in the order of their first ``length`` bytes, then as given, and what neighbours share of these.

    Equal ones are brought together by fingerprint, and their bytes are compared.
    One of each is then sorted by its first eight bytes, those that tie by the
    next eight, and so on.
    """
    if length < 8 or not len(starts):
        return _plain_order(data, starts, length)
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    prints = byte_windows(data, length)[starts]
    together = np.argsort(prints, kind="stable")
    new = np.concatenate([[True], prints[together[1:]] != prints[together[:-1]]])
    one = starts[together]
    again = np.flatnonzero(~new)
    strings = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)
    for part in range(0, len(again), COMPARED):
        rows = again[part : part + COMPARED]
        if (strings[one[rows]] != strings[one[rows - 1]]).any():
            return _plain_order(data, starts, length)
    first = np.flatnonzero(new)
    distinct = one[first]

    word = words[distinct].astype(np.uint64)
    ranked = np.argsort(word, kind="stable")
    word = word[ranked]
    opens = np.concatenate([[True], word[1:] != word[:-1]])  # where a run of ties begins
    for at in steps[1:]:
        alone = opens & np.concatenate([opens[1:], [True]])
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        run = np.cumsum(opens)[tied]
        word = words[distinct[ranked[tied]] + at].astype(np.uint64)
        order = np.lexsort((word, run))
        ranked[tied], word = ranked[tied[order]], word[order]
        opens[tied[1:]] |= (word[1:] != word[:-1]) & (run[1:] == run[:-1])

    shared_ = np.zeros(len(ranked), np.int32)
    left, right, open_ = distinct[ranked[:-1]], distinct[ranked[1:]], np.arange(1, len(ranked))
    for at in steps:
        differ = words[left[open_ - 1] + at].astype(np.uint64) ^ words[right[open_ - 1] + at].astype(np.uint64)
        ends = differ != 0
        equal = sum(((differ[ends] >> np.uint64(8 * k)) == 0).astype(np.int32) for k in range(1, 8))
        shared_[open_[ends]] = at + equal
        open_ = open_[~ends]

    # The groups of equal suffixes in the order of their ranks, each in the given order.
    sizes = np.diff(np.concatenate([first, [len(starts)]]))
    begin = np.empty(len(first), np.int64)
    begin[ranked] = np.cumsum(sizes[ranked]) - sizes[ranked]
    group = np.cumsum(new) - 1
    place = begin[group] + np.arange(len(starts)) - first[group]
    order = np.empty(len(starts), np.int64)
    order[place] = together
    common = np.full(len(starts), length, np.int32)
    common[begin[ranked]] = shared_
    return order, common


def repeated_windows(data: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes have an earlier one that is equal for ``length`` bytes; the suffixes come in order of position.

    One whose fingerprint no other has matches none so far, so it stays out of the suffix array.
    """
    out = np.zeros(len(starts), bool)
    prints = byte_windows(data, length)[starts]
    together = np.argsort(prints)
    same = prints[together[1:]] == prints[together[:-1]]
    some = np.sort(together[np.concatenate([same, [False]]) | np.concatenate([[False], same])]) if len(starts) else together
    order, common = suffix_order(data, starts[some], length)
    out[some[order]] = previous_factors(order, common) >= length
    return out


def _zipped(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(shared.packed(array))


def _anchored(batches: Iterator[pa.RecordBatch], buckets: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Anchors by bucket of their fingerprint.

    Those that a block has once are sent with their document and place. Of those
    that it has again one is sent, with the mark that it is known to recur; their
    places go to buckets from ``buckets`` on, which need no more counting.
    """
    names, kinds = ["bucket", "keys", "ids", "places", "again"], [pa.int32(), *(pa.binary(),) * 4]
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    held: list[tuple] = []
    # Tasks begin at different buckets, or all first blocks would meet in one.
    size, blocks = 0, TaskContext.get().partitionId() * BLOCK_STRIDE

    def row(bucket: int, keys, ids, places, again) -> pa.RecordBatch:
        columns = [[bucket], [shared.packed(keys)], [_zipped(ids)], [_zipped(places.astype(np.int32))], [_zipped(again)]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def rows() -> Iterator[pa.RecordBatch]:
        keys, ids, places = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys, ids, places = keys[order], ids[order], places[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        number = np.cumsum(new) - 1
        again = np.bincount(number)[number] > 1
        if again.any():
            yield row(buckets + blocks % buckets, keys[:0], ids[again], places[again], again[:0])
        keys, ids, places, again = keys[new], ids[new], places[new], again[new]
        at = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
        for b in np.flatnonzero(np.diff(at)).tolist():
            part = slice(at[b], at[b + 1])
            yield row(b, keys[part], ids[part], places[part], again[part])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found, places, _, _ = anchors(text, length, gram)
            if len(found):
                held.append((found, np.full(len(found), key, np.int64), places))
                size += len(text)
            if size >= BLOCK_BYTES:
                yield from rows()
                held, size, blocks = [], 0, blocks + 1
    if held:
        yield from rows()


def _recurring(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(id, places): the anchors that occur again in the corpus, by document."""
    unzip = zstandard.ZstdDecompressor().decompress
    for table in shared.sorted_groups(batches, ["bucket"]):
        number = table.column("bucket").to_numpy()
        for bucket in np.unique(number).tolist():
            part = table.filter(pa.array(number == bucket)).to_pydict()
            keys = np.frombuffer(b"".join(part["keys"]), np.uint64)
            ids, places, again = (np.frombuffer(b"".join(map(unzip, part[c])), k) for c, k in (("ids", np.int64), ("places", np.int32), ("again", bool)))
            if bucket < buckets:
                order = np.argsort(keys, kind="stable")
                ordered = keys[order]
                group = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]])) - 1
                often = np.bincount(group, 1 + again[order])[group] > 1
                kept = order[often & ~again[order]]
                ids, places = ids[kept], places[kept]
            order = np.lexsort((places, ids))
            ids, places = ids[order], places[order]
            if len(ids):
                starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                offsets = np.concatenate([starts, [len(ids)]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[starts]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(places))], names=["id", "places"])


def windows_of(rows: list[tuple], length: int):
    """(row, offset, repeated) of each window in rows (anchor, document, place of the first window, bytes), which come by position."""
    sizes = np.array([len(r[3]) for r in rows])
    windows = sizes - length + 1
    begin = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(rows)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    return row, offset, repeated_windows(b"".join(r[3] for r in rows), begin[row] + offset, length)


def _runs(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, first, last) of runs of consecutive window starts."""
    order = np.lexsort((starts, ids))
    ids, starts = ids[order], starts[order]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(ids)]]) - 1
    return ids[first], starts[first], starts[last]


def _resolved(rows: list[tuple], length: int, final: bool) -> Iterator[pa.RecordBatch]:
    """Runs of windows that repeat an earlier one of the rows, and, unless final, the rows with a window that does not."""
    names, kinds = ["key", "id", "first", "last", "bytes"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    rows.sort(key=lambda r: r[1:3])
    row, offset, repeated = windows_of(rows, length)
    ids, starts = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    if repeated.any():
        run_ids, first, last = _runs(ids[row[repeated]], starts[row[repeated]] + offset[repeated])
        columns = [run_ids, run_ids, first, last, [None] * len(run_ids)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
    left = [] if final else np.unique(row[~repeated]).tolist()
    if left:
        keys = np.array([rows[r][0] for r in left], np.uint64).view(np.int64)
        columns = [keys, ids[left], starts[left], starts[left], [rows[r][3] for r in left]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _gathered(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Recurring anchors with the bytes of their windows, after what repeats within the task is settled."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for key, text, places in zip(*(batch.column(i).to_pylist() for i in range(3))):
            fingerprints, at, first, last = anchors(text, length, gram)
            wanted = np.isin(at, np.concatenate([np.array(p, np.int64) for p in places]))
            for k in np.flatnonzero(wanted).tolist():
                part = text[first[k] : last[k] + length]
                rows.append((fingerprints[k], key, int(first[k]), part))
                size += len(part)
            if size >= BLOCK_BYTES // 2:
                yield from _resolved(rows, length, False)
                rows, size = [], 0
    if rows:
        yield from _resolved(rows, length, False)


def _met(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows that repeat an earlier one, from rows sorted by anchor; settled runs pass."""
    for table in shared.sorted_groups(batches, ["key"]):
        settled = pa.compute.is_null(table.column("bytes"))
        for batch in table.filter(settled).to_batches():
            yield batch.drop_columns(["key", "bytes"])
        rest = table.filter(pa.compute.invert(settled)).to_pydict()
        if rest["id"]:
            rows = list(zip(rest["key"], rest["id"], rest["first"], rest["bytes"]))
            for batch in _resolved(rows, length, True):
                yield batch.drop_columns(["key", "bytes"])


def removed(first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges [from, to) that windows starting in the runs cover."""
    out: list[list[int]] = []
    for a, b in sorted(zip(first, last)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, removed, kept) of each row: byte ranges [from, to) that go, and what is left.

    A byte goes if it is covered by ``length`` bytes that also start in a
    document with a smaller id, or earlier in the same one. Ids are whole
    numbers and unique but for repeated rows, which are copies of each other and
    count as one document; a null text is empty; a row with a null id keeps its
    text and repeats nothing. Later copies of a whole text go whole if they have
    ``length`` bytes, by SHA-256; other bytes are compared.
    """
    gram = min(GRAM, length)
    spark = docs.sparkSession
    shared.small_batches(spark)
    bare = F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), bare.alias("text"))
    digests = rows.where("id is not null").select("id", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("size")).where(F.col("size") >= length)
    firsts = digests.groupBy("digest").agg(F.min("id").alias("own")).select("own").distinct()
    sized = rows.where("id is not null").agg(F.count("*"), F.count_distinct("id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    originals = rows.join(firsts, F.col("id") == F.col("own")).select("id", "text")
    if sized[0] > sized[1]:
        originals = originals.dropDuplicates(["id"])
    # Bucketed by id, so that the texts are dealt out once for all joins that follow.
    name, n_files = f"pairsmith_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    originals.write.option("path", scratch(spark, "originals")).bucketBy(n_files, "id").saveAsTable(name)
    originals = spark.table(name)

    buckets = max(LEAST_BUCKETS, int(sized[2] * 2 / (length - gram + 2) / BUCKET_ANCHORS))
    sent = originals.mapInArrow(lambda b: _anchored(b, buckets, length, gram), "bucket int, keys binary, ids binary, places binary, again binary")
    recurring = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _recurring(b, buckets), "id long, places array<int>")
    recurring = recurring.groupBy("id").agg(F.collect_list("places").alias("places"))
    gathered = originals.join(recurring, "id").select("id", "text", "places").mapInArrow(lambda b: _gathered(b, length, gram), "key long, id long, first long, last long, bytes binary")
    runs = gathered.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _met(b, length), "id long, first long, last long")
    runs = runs.groupBy("id").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, first, last in zip(*(batch.column(i).to_pylist() for i in range(4))):
                spans = removed(first, last, length) if first else []
                edges = [0, *(x for span in spans for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((key, len(text), len(text) - len(kept), len(spans), edges[1:-1], kept))
            kinds = [*(pa.int64(),) * 4, pa.list_(pa.int64()), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["id", "n_bytes", "n_removed", "n_spans", "removed", "kept"])

    whole = originals.join(runs, "id", "left").select("id", "text", "first", "last").mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, removed array<long>, kept binary")
    if sized[0] > sized[1]:
        whole = whole.join(digests.groupBy(F.col("id").alias("again")).agg(F.count("*").cast("int").alias("n_rows")), F.col("id") == F.col("again"))
        whole = whole.withColumn("row", F.explode(F.sequence(F.lit(1), "n_rows"))).drop("again", "n_rows", "row")
    copies = digests.join(firsts, F.col("id") == F.col("own"), "left_anti").select("id", F.col("size").cast("long").alias("n_bytes"), F.col("size").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.array(F.lit(0), F.col("size")).cast("array<long>").alias("removed"), F.lit(b"").alias("kept"))
    n_bytes = F.octet_length("text").cast("long")
    short = rows.where(F.col("id").isNull() | (n_bytes < length)).select("id", n_bytes.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.array().cast("array<long>").alias("removed"), F.col("text").alias("kept"))
    return whole.unionByName(copies).unionByName(short).withColumnRenamed("id", id_column)
