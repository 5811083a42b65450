"""Importance resampling towards a target distribution, by hashed n-gram features.

Features are runs of one or two words; each has a bucket. The gain of a bucket
is the log ratio of its smoothed shares in the target and in the corpus; a
document's weight is the mean gain of its features. Weights get Gumbel noise, and
the documents with the highest sums are drawn: a sample without replacement in
proportion to the exponentials of the weights.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairsmith.llm import shared
from pairsmith.llm.decontaminate import _TABLE as LOWERED

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = "7"
SCALE = 1_000
#: Bytes of texts whose n-grams are interned at a time.
RUN_BYTES = 1 << 16


class Table:
    """Open-addressed table of distinct n-grams: a slot holds hash, bytes, bucket and count."""

    def __init__(self, buckets: int = BUCKETS, room: int = 1 << 16):
        self.buckets, self.n = buckets, 0
        self._make(room)

    def _make(self, room: int) -> None:
        self.used, self.hashes = np.zeros(room, bool), np.zeros(room, np.uint64)
        self.grams = np.empty(room, object)
        self.bucket, self.count = np.zeros(room, np.int64), np.zeros(room, np.int64)

    def _grow(self, room: int) -> None:
        held = np.flatnonzero(self.used)
        old = [x[held] for x in (self.hashes, self.grams, self.bucket, self.count)]
        self._make(room)
        slots, _ = self._find(old[0], old[1])
        self.bucket[slots], self.count[slots] = old[2], old[3]

    def _find(self, hashes: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each gram, and the slots that were free before. All open grams probe at once."""
        last = np.uint64(len(self.used) - 1)
        at = (hashes & last).astype(np.int64)
        left, fresh = np.arange(len(grams)), []
        while len(left):
            spots = at[left]
            free = left[~self.used[spots]]
            if len(free):
                slots, first = np.unique(at[free], return_index=True)  # of several at one slot the first takes it
                self.used[slots], self.hashes[slots], self.grams[slots] = True, hashes[free[first]], grams[free[first]]
                fresh.append(slots)
            same = self.hashes[spots] == hashes[left]
            alike = left[same]
            same[same] = self.grams[at[alike]] == grams[alike]  # bytes, as hashes may be equal by chance
            left = left[~same]
            at[left] = (at[left] + 1) & int(last)
        return at, np.concatenate(fresh) if fresh else np.empty(0, np.int64)

    def intern(self, grams: list[bytes]) -> np.ndarray:
        """The slots of all occurrences, which are counted; slots hold until the next call."""
        hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams)), ">u8").astype(np.uint64)
        if 2 * (self.n + len(grams)) > len(self.used):
            self._grow(1 << (2 * (self.n + len(grams))).bit_length())
        column = np.empty(len(grams), object)
        column[:] = grams
        slots, fresh = self._find(hashes, column)
        self.bucket[fresh] = [zlib.crc32(g) % self.buckets for g in self.grams[fresh]]
        np.add.at(self.count, slots, 1)
        self.n += len(fresh)
        return slots


def runs(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Features of texts, about ``RUN_BYTES`` at a time: the features, the rows that they come from, and how many of each.

    A long text comes in parts; its last word goes with the next part, for the run across the cut.
    """
    grams: list[bytes] = []
    rows, sizes, held = [], [], 0
    for row, text in enumerate(texts):
        last: list[bytes] = []
        for words in shared.word_parts((text or b"").translate(LOWERED), RUN_BYTES):
            before = len(grams)
            grams += words
            line = last + words
            grams += map(b" ".join, zip(line, line[1:]))
            last = line[-1:]
            rows.append(row)
            sizes.append(len(grams) - before)
            held += sum(map(len, words))
            if held > RUN_BYTES:
                yield grams, rows, sizes
                grams, rows, sizes, held = [], [], [], 0
    if grams:
        yield grams, rows, sizes


def interned(docs: DataFrame, text_column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with n_features and features, which replace columns of these names.

    ``features`` has the bucket of each feature of a text, as compressed numbers:
    the bytes of n-grams are looked at once, and what follows only gathers.
    """
    shared.small_batches(docs.sparkSession)

    def make():
        small = zstandard.ZstdCompressor(level=1)

        def work(batch: pa.RecordBatch) -> list:
            table, parts = Table(buckets), [[] for _ in range(batch.num_rows)]
            for grams, rows, sizes in runs(shared.texts(batch, text_column)):
                slots = table.intern(grams)
                found = table.bucket[slots].astype(np.uint32)
                ends = np.cumsum(sizes).tolist()
                for row, end, size in zip(rows, ends, sizes):
                    parts[row].append(found[end - size : end])
            n = [sum(map(len, p)) for p in parts]
            return [n, [small.compress(shared.packed(np.concatenate(p))) if k else None for p, k in zip(parts, n)]]

        return work

    return shared.appended(docs, [("n_features", "long"), ("features", "binary")], make)


def _features(batch: pa.RecordBatch, index: int) -> Iterator[np.ndarray]:
    """The buckets of each row's features."""
    small, none = zstandard.ZstdDecompressor(), np.empty(0, np.uint32)
    for data in batch.column(index).to_pylist():
        yield np.frombuffer(small.decompress(data), np.uint32) if data else none


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): occurrences of features over all ``interned`` rows; each task sends a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own in _features(batch, 0):
                np.add.at(total, own, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return rows.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, from the two tables of bucket counts."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")))
    whole = Window.partitionBy()  # over one row a bucket
    ratio = (F.col("t") + 1) * (F.sum("s").over(whole) + buckets) / ((F.col("s") + 1) * (F.sum("t").over(whole) + buckets))
    return both.select("bucket", F.floor(SCALE * F.log(ratio)).cast("long").alias("gain"))


def noise(key: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, by the SHA-256 of seed and key; a null key is like an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("long")


def weigh(rows: DataFrame, gains: list[int]) -> DataFrame:
    """``interned`` rows with weight, the floored mean gain of their features (0 without any)."""
    known = rows.sparkSession.sparkContext.broadcast(np.array(gains, np.int64))  # a number a bucket

    def make():
        def work(batch: pa.RecordBatch) -> list:
            found = _features(batch, batch.schema.get_field_index("features"))
            return [[int(known.value[own].sum()) // max(len(own), 1) for own in found]]

        return work

    return shared.appended(rows, [("weight", "long")], make).drop("features")


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text", keep: list[str] | None = None, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """The columns ``keep`` of ``docs`` (None: all) with n_features, weight, score and rank, which replace columns of these names, as does features.

    Of the documents with ``least_words`` words or more, ``percent`` of a hundred
    (rounded down) with the highest scores are drawn, ranked 1, 2, 3 …; all others
    have a null rank. Equal scores go by id, null last, then by n_features and
    weight. Null and wordless texts have no features and weight 0; rows with a
    null id share one noise. Repeated rows count, and are drawn, one by one. An
    empty target leaves smoothing alone to weigh; an empty table stays empty.

    Scores are whole numbers in a range that double logarithms bound (about
    10 ** 5 values), so the cut and the ranks before each score come from a small
    histogram; documents meet only with those of the same score.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_features", "features", "weight", "score", "rank")]
    rows = interned(docs.select(*dict.fromkeys([*keep, id_column, text_column])), text_column, buckets)
    rows = shared.written(rows.select(*dict.fromkeys([*keep, id_column]), "n_features", "features"), "features")
    corpus = bucket_counts(rows, buckets)
    gains = bucket_gains(corpus, bucket_counts(interned(target.select(target_text), target_text, buckets), buckets), buckets)
    weighed = weigh(rows, [r["gain"] for r in gains.orderBy("bucket").collect()])  # a number a bucket
    score = (F.col("weight") + noise(F.col(id_column), seed))
    scored = weighed.withColumn("score", score).select(*dict.fromkeys([*keep, id_column]), "n_features", "weight", "score")
    scored = shared.written(scored, "scored")

    long_enough = F.col("n_features") >= 2 * least_words - 1
    steps = scored.where(long_enough).groupBy("score").agg(F.count("*").alias("n_same"))
    above = F.coalesce(F.sum("n_same").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = shared.written(steps.select(F.col("score").alias("step"), F.col("n_same").alias("same"), above.alias("above")), "scores")
    drawn = percent * (steps.agg(F.sum("same")).first()[0] or 0) // 100
    lowest = steps.where(F.col("above") < drawn).agg(F.min("step")).first()[0]
    reached = long_enough & (F.col("score") >= lowest) if lowest is not None else F.lit(False)
    columns = [*keep, "n_features", "weight", "score"]
    line = Window.partitionBy("d.score").orderBy(F.col(f"d.{id_column}").asc_nulls_last(), "d.n_features", "d.weight")
    place = F.col("s.above") + F.row_number().over(line)
    high = scored.where(reached).alias("d").join(steps.alias("s"), F.col("d.score") == F.col("s.step"))
    high = high.select(*(F.col(f"d.{c}") for c in columns), F.when(place <= drawn, place).cast("long").alias("rank"))
    return high.union(scored.where(~reached).select(*columns, F.lit(None).cast("long").alias("rank")))
