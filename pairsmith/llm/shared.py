"""Helpers that several operators of this subpackage use."""

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pairsmith.session import scratch

#: Rows and bytes of a batch that Python receives; texts may be long.
BATCH_ROWS = 1_000
BATCH_BYTES = 16 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIXER = np.uint64(0xD6E8FEB86659FD93)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut and it is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_remainder(column: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % divisor


def appended(df: DataFrame, fields: list[tuple[str, str]], make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """``df`` with columns that Python computes batch by batch.

    ``make()`` runs once per task and gives a function from a batch to one list
    or array per field. Columns of ``df`` with the same names are replaced.
    """
    base = df.drop(*(name for name, _ in fields))
    added = T.StructType([T.StructField(name, T._parse_datatype_string(kind)) for name, kind in fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(field.dataType) for field in added]
    names = base.columns + added.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                new = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(work(batch), kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return base.mapInArrow(run, T.StructType([*base.schema, *added]))


def texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; words between blanks, tabs, line breaks, vertical tabs and form feeds."""
    return (text or b"").lower().split()


def word_parts(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, part by part, so that the words of a very long text are never in memory at once."""
    start = 0
    while len(text) - start > size and (blank := _BLANK.search(text, start + size)):
        yield text[start : blank.start()].split()
        start = blank.start()
    yield text[start:].split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _MIXER
    x = (x ^ (x >> np.uint64(29))) * _GOLDEN
    return x ^ (x >> np.uint64(32))


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two parts; the order counts."""
    return mixed(left * _MIXER + mixed(right + _GOLDEN))


def window_hashes(units: np.ndarray, length: int) -> np.ndarray:
    """64-bit fingerprints of all windows of ``length`` units, by doubling."""
    n = len(units) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size, done, out = mixed(units.astype(np.uint64) + np.uint64(1)), 1, 0, None
    while True:
        if length & size:
            part = power[done : done + n]
            out = part if out is None else joined_hash(out, part)
            done += size
        if done == length:
            return out
        power = joined_hash(power[:-size], power[size:])
        size *= 2


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) reach; only nodes with an edge to another.

    Alternating large-star and small-star steps, each a grouped minimum and a
    join; every round is a written table, and only its count and checksum reach
    the driver. Null ends are ignored, repeated edges and loops count once.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("a"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())

    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("whole"))
    edges = written(edges.where("whole and a <> b").select("a", "b").distinct(), "edges")
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        lowest = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("low"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        pair = large.join(lowest, "a")
        ends = F.explode(F.array("a", "b"))
        edges = written(pair.select(ends.alias("a"), F.col("low").alias("b")).where("a <> b").distinct(), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


class Forest:
    """Union-find over 0 … n-1 inside one task; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while (self.up != (higher := self.up[self.up])).any():
            self.up = higher
        return self.up

    def union(self, left: np.ndarray, right: np.ndarray) -> None:
        """Join all pairs at once, by rounds of hooking the larger root under the smaller."""
        while len(left):
            up = self.roots()
            a, b = up[left], up[right]
            open_ = a != b
            left, right, a, b = left[open_], right[open_], a[open_], b[open_]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
        self.roots()


def sorted_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that arrive sorted by ``key``, several small groups at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(name)) for name in key]
        first, end = ([c[i].as_py() for c in columns] for i in (0, batch.num_rows - 1))
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        if end != first:
            cut = batch.num_rows
            changed = np.zeros(batch.num_rows, bool)
            for c in columns:
                values = c.to_numpy(zero_copy_only=False)
                changed[1:] |= values[1:] != values[:-1]
            cut = int(np.flatnonzero(changed)[-1])
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
        last = end
    if held:
        yield pa.Table.from_batches(held)


def packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()
