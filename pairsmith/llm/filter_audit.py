"""How filters interact, counted by a stream that takes back what a smaller id makes wrong.

All files of a table pass as available-now micro-batches. Each document gets a
mask of the filters that it fails. Whether its text is a copy of an earlier one
depends on the whole table: the state of a text is the smallest id so far, with
what was counted for it. When a smaller id arrives, the earlier mask is counted
down and counted up again with the copy's bit. The sums of all such changes are
the counts of every part and mask, from which the report of every filter order
follows. The states of some hundred texts, by a hash of the text, are one entry
of Spark's state store, as each entry costs a call of Python; the session's
setting says which store that is (on disk, RocksDB, for large corpora).
"""

import hashlib
import itertools
import pickle
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairsmith.llm import shared
from pairsmith.session import scratch
from pairsmith.streaming import streams

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
FEWEST_WORDS = 50
#: Per cent: distinct words of all words, capitals of all code points.
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
SYMBOLS = b"#$%&*|"
#: Micro-batches that the files are dealt out to.
BATCHES = 4
#: Documents to an entry of the state store.
TEXTS = 256
#: Texts that a task gathers before it sends them to their states.
GATHERED = 50_000

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUING = bytes(range(0x80, 0xC0))
_COUNTED = "part string, mask int, good boolean, toxic boolean, n long"
_ARROW = pa.schema([("part", pa.string()), ("mask", pa.int32()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("n", pa.int64())])
_KEYED = pa.schema([("bucket", pa.int64()), ("digest", pa.binary()), ("id", pa.int64()), *_ARROW])


def mask(text: bytes) -> int:
    """The bits of the filters that a text fails by itself, A the lowest."""
    n, distinct = 0, set()
    for words in shared.word_parts(text):
        n += len(words)
        distinct.update(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUING))
    fails = (n < FEWEST_WORDS, 100 * len(distinct) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * points, len(text.translate(None, SYMBOLS)) < len(text))
    return sum(bit << i for i, bit in enumerate(fails))


def _masked():
    def work(batch: pa.RecordBatch) -> list:
        found = [t or b"" for t in shared.texts(batch, "text")]
        return [[mask(t) for t in found], [hashlib.sha256(t).digest() for t in found]]

    return work


def _counts(counts: Counter) -> list[list]:
    rows = [(*row, n) for row, n in counts.items() if n]
    return [list(column) for column in zip(*rows)] or [[] for _ in _ARROW]


def _gathered(buckets: int):
    """What a task knows of each of its texts: the rows of the smallest id; the others are copies for good.

    Settled counts have no text, and go to a bucket that depends on the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[bytes, tuple[int, Counter]] = {}
        settled: Counter = Counter()
        own = TaskContext.get().partitionId() % buckets

        def sent() -> pa.RecordBatch:
            rows = [(int.from_bytes(key[:7]) % buckets, key, low, *row, n) for key, (low, held) in texts.items() for row, n in held.items()]
            rows += [(own, None, 0, *row, n) for row, n in settled.items()]
            texts.clear()
            settled.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_KEYED), _KEYED)], schema=_KEYED)

        for batch in batches:
            for id_, part, bits, good, toxic, key in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                row = (part, bits, good, toxic)
                if id_ is None:
                    settled[row] += 1
                    continue
                low, held = texts.get(key, (None, None))
                if low is None or id_ < low:
                    for (p, m, g, t), n in (held or {}).items():
                        settled[p, m | COPY, g, t] += n
                    texts[key] = (id_, Counter({row: 1}))
                elif id_ == low:
                    held[row] += 1
                else:
                    settled[part, bits | COPY, good, toxic] += 1
            if len(texts) >= GATHERED:
                yield sent()
        yield sent()

    return run


def _retracted(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the counts that new rows bring to a bucket's texts, and their new smallest ids."""
    changes: Counter = Counter()
    texts: dict[bytes, tuple[int, dict]] = pickle.loads(state.get[0]) if state.exists else {}
    for frame in frames:
        for digest, id_, part, bits, good, toxic, n in zip(*(frame[c].tolist() for c in ("digest", "id", *_ARROW.names))):
            row = (part, bits, good, toxic)
            if digest is None:
                changes[row] += n
                continue
            low, held = texts.get(digest, (None, {}))
            if low is None or id_ < low:
                for (p, m, g, t), k in held.items():
                    changes[p, m, g, t] -= k
                    changes[p, m | COPY, g, t] += k
                texts[digest] = (id_, {row: n})
                changes[row] += n
            elif id_ == low:
                held[row] = held.get(row, 0) + n
                changes[row] += n
            else:
                changes[part, bits | COPY, good, toxic] += n
    state.update((pickle.dumps(texts),))
    yield pd.DataFrame(dict(zip(_ARROW.names, _counts(changes))))


def _name(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def _globbed(path: str) -> str:
    """The path of a single file as a pattern; a stream takes a plain path for a folder."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/[{name[0]}]{name[1:]}"


def count(spark: SparkSession, path: str, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source", batches: int = BATCHES) -> DataFrame:
    """(part, mask, good, toxic, n): documents of the Parquet table at ``path`` by the filters that they fail.

    ``labels`` has the id column, quality and toxic; of repeated ids the highest
    values count. Null texts are empty and copies of each other, null parts are
    the empty string. A null id is neither smaller nor larger than another, so
    such a row is never a copy. Rows that repeat an id and its text are no
    copies of each other. Equal texts are told by SHA-256.
    """
    shared.small_batches(spark)
    table = spark.read.parquet(path)
    files = table.inputFiles()
    buckets = max(1, table.count() // TEXTS)
    known = labels.groupBy(F.col(id_column).cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = shared.written(known.where("id is not null"), "labels")
    at = _globbed(path) if [_name(f) for f in files] == [_name(path)] else path
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // batches))).parquet(at)

    def changes(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), F.col(text_column).cast("string").alias("text"))
        rows = shared.appended(rows, [("mask", "int"), ("digest", "binary")], _masked).drop("text")
        flag = lambda name: F.coalesce(name, F.lit(False)).alias(name)
        rows = rows.join(known, "id", "left").select("id", "part", "mask", flag("good"), flag("toxic"), "digest")
        keyed = rows.mapInArrow(_gathered(buckets), f"bucket long, digest binary, id long, {_COUNTED}")
        return keyed.groupBy("bucket").applyInPandasWithState(_retracted, _COUNTED, "texts binary", "append", GroupStateTimeout.NoTimeout)

    out = scratch(spark, "audit")
    found = streams.run_available(stream, changes, f"{out}/changes", f"{out}/checkpoint")
    return found.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def report(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step: what the step's filter does there, and its Shapley sum.

    All documents of a part are in at most 2 ** 5 masks, so a part's row holds all its counts.
    """
    orders = ["".join(p) for p in itertools.permutations(filters)]
    n = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("n"))), F.lit(0)).alias(flag)
    cells = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), n("good"), n("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    bit = lambda letter: f"shiftleft(1, instr('{filters}', {letter}) - 1)"
    rows = parts.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    rows = rows.withColumn("own", F.expr(bit("substring(filter_order, step, 1)")))
    rows = rows.withColumn("before", F.expr(f"aggregate(split(substring(filter_order, 1, step - 1), ''), 0, (a, x) -> a + if(x = '', 0, {bit('x')}))"))

    def total(what: str, condition: str, name: str):
        return F.expr(f"aggregate(filter(cells, c -> {condition}), 0L, (a, c) -> a + {what})").alias(name)

    removed = "c.mask & before = 0 and c.mask & own <> 0"
    return rows.select(
        "part", "filter_order", "step",
        total("c.n", "c.mask & (before | own) = 0", "kept"),
        total("c.n", removed, "removed"),
        total("c.n", "c.mask & before <> 0 and c.mask & own <> 0", "redundant"),
        total("c.n", "c.mask = own", "unique_fails"),
        total("c.good", removed, "good_lost"),
        total("c.toxic", removed, "toxic_lost"),
        # A filter is the first of those that a document fails in an equal share of the orders.
        total(f"c.n * cast({len(orders)} / bit_count(c.mask) as bigint)", "c.mask & own <> 0", "shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, **columns) -> DataFrame:
    """The report over a Parquet table; an empty table has no parts and so no rows."""
    return report(shared.written(count(spark, path, labels, **columns), "audit-counts"))
