"""A stored index of vectors with exact retrieval.

The index is two Parquet tables: the vectors, partitioned by their nearest
center, and the centers with the number of their vectors and a radius, the
largest distance of one of them. For a query q and a center c with radius r, no
vector of the partition scores above ``q·c + |q|·r``. A block of queries is
answered in two passes: the first reads the partitions that promise most and
hold k vectors, which gives each query a score that k documents reach; the second
reads only partitions whose bound reaches it for some query. So the result is
that of a full scan, whatever the centers are; they only decide how much is read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairsmith.functions.keyed import keyed_hash
from pairsmith.operators.retrieval import SCORE_DIGITS, TopK, _column, _matrix, _type, id_types

CENTERS = 64
ROUNDS = 3
SEED = 42
# Centers that the driver and the executors hold at most, and the bytes of a block of queries.
MAX_CENTERS = 16_384
BLOCK_BYTES = 32 << 20
# Query-center pairs of a block, a byte each.
BLOCK_PAIRS = 16 << 20
# Scores are rounded, and bounds are sums of rounded numbers.
_SLACK = 10.0 ** (1 - SCORE_DIGITS)


def _nearest(matrix: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each vector, the first of equally near ones, and the distance to it."""
    squares = (matrix * matrix).sum(axis=1)[:, None] - 2 * matrix @ centers.T + (centers * centers).sum(axis=1)
    best = squares.argmin(axis=1)
    return best, np.sqrt(((matrix - centers[best]) ** 2).sum(axis=1))


def _moved(vectors: DataFrame, centers: np.ndarray) -> np.ndarray:
    """Means of the vectors around each center; tasks send a sum and a number for each center."""
    known = vectors.sparkSession.sparkContext.broadcast(centers)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(known.value.shape), np.zeros(len(known.value), np.int64)
        for batch in batches:
            if batch.num_rows:
                matrix = _matrix(batch.column(0))
                best, _ = _nearest(matrix, known.value)
                np.add.at(total, best, matrix)
                n += np.bincount(best, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(total[at].tolist(), pa.list_(pa.float64()))], names=["center", "n", "total"])

    parts = vectors.select("vector").mapInArrow(sums, "center long, n long, total array<double>")
    added = F.transform(F.sequence(F.lit(0), F.lit(centers.shape[1] - 1)), lambda i: F.get("total", i))
    cells = parts.select("center", "n", F.posexplode(added).alias("place", "x"))
    merged = cells.groupBy("center", "place").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    moved = centers.copy()
    for r in merged.collect():  # a number for each center and dimension
        moved[r["center"], r["place"]] = r["x"] / r["n"]
    return moved


def build(documents: DataFrame, path: str, centers: int = CENTERS, rounds: int = ROUNDS, seed: int = SEED) -> None:
    """Write the index of ``documents`` (doc_id, vector; ids unique) to ``path``.

    The first centers are vectors drawn by a keyed hash of their ids, then moved
    to the means around them ``rounds`` times. Vectors have one length; NULL
    vectors are left out, as nothing scores them.
    """
    if not 0 < centers <= MAX_CENTERS:
        raise ValueError(f"{centers} centers, not between 1 and {MAX_CENTERS}")
    spark = documents.sparkSession
    whole = documents.select("doc_id", "vector").where("vector is not null")
    drawn = whole.select(keyed_hash(seed, F.col("doc_id")).alias("_draw"), "vector").orderBy("_draw").limit(centers)
    points = np.unique(np.array([r["vector"] for r in drawn.collect()], np.float64), axis=0)
    for _ in range(rounds if len(points) else 0):
        points = _moved(whole, points)
    known = spark.sparkContext.broadcast(points)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, distance = _nearest(_matrix(batch.column(1)), known.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(distance)], names=["doc_id", "vector", "center", "distance"])

    kind = f"doc_id {_type(whole, 'doc_id')}, vector {_type(whole, 'vector')}, center long, distance double"
    # Partitions of even size, so that a center with many vectors is not one task's file.
    whole.mapInArrow(assign, kind).hint("rebalance", "center").write.partitionBy("center").parquet(f"{path}/vectors")
    sizes = spark.read.schema(kind).parquet(f"{path}/vectors").groupBy("center").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"))
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "center long, point array<double>")
    table.join(sizes, "center").write.parquet(f"{path}/centers")


def search(path: str, queries: DataFrame, k: int, block_bytes: int = BLOCK_BYTES, read: list | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query, rank from 1, as ``retrieval.top_k`` gives them.

    Queries (query_id, vector; ids unique) go in blocks of ``block_bytes`` at
    most, each dealt out by a hash of the id. ``read`` is filled with the number
    of partitions and those that each block's two passes read.
    """
    spark = queries.sparkSession
    centers = spark.read.parquet(f"{path}/centers").orderBy("center").collect()  # MAX_CENTERS at most
    if not centers:  # an empty index, of which nothing tells the type of the ids
        return spark.createDataFrame([], f"query_id {_type(queries, 'query_id')}, doc_id bigint, score double, rank int")
    vectors = spark.read.parquet(f"{path}/vectors").select("doc_id", "vector", "center")
    kinds = id_types(queries, vectors)
    fold = TopK(k, *kinds)
    queries = queries.select("query_id", "vector").where("vector is not null")
    n, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], fold.schema + ", rank int")
    points, radii, sizes = np.array([c["point"] for c in centers]), np.array([c["radius"] for c in centers]), np.array([c["n"] for c in centers])
    names = [c["center"] for c in centers]
    rows = max(1, min(block_bytes // (8 * (width + 4)), BLOCK_PAIRS // len(centers)))
    # Blocks are hashed, so one may be larger than the mean; twice as many leave room for that.
    blocks = 1 if n <= rows else -(-2 * n // rows)

    def scanned(table: pa.Table, wanted: np.ndarray) -> DataFrame:
        """Partial results of the query-center pairs in ``wanted``, from the partitions that have any."""
        shared = spark.sparkContext.broadcast((table, np.packbits(wanted), wanted.shape))
        place = {name: i for i, name in enumerate(names)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, bits, shape = shared.value
            wanted = np.unpackbits(bits, count=shape[0] * shape[1]).reshape(shape).astype(bool)
            folds: dict[int, TopK] = {}
            for batch in batches:
                whole = pa.Table.from_batches([batch])
                for center in pc.unique(batch.column(2)).to_pylist():
                    if center not in folds:
                        folds[center] = TopK(fold.k, *kinds)
                        folds[center].start(table.take(np.flatnonzero(wanted[:, place[center]])))
                    folds[center].add(whole.filter(pc.equal(whole.column("center"), center)))
            for one in folds.values():
                yield from one.finish().to_batches()

        needed = [name for name, any_ in zip(names, wanted.any(axis=0)) if any_]
        return vectors.where(F.col("center").isin(needed)).mapInArrow(run, fold.schema)

    def answered(block: DataFrame) -> DataFrame:
        table = block.toArrow()
        matrix = _matrix(_column(table, "vector"))
        if not len(matrix):
            return spark.createDataFrame([], fold.schema)
        bounds = matrix @ points.T + np.linalg.norm(matrix, axis=1)[:, None] * radii
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        found = scanned(table, first)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k)
        reached = found.where(F.col("_place") == k).select("query_id", "score").toArrow()  # a row a query of the block
        least = dict(zip(reached.column(0).to_pylist(), reached.column(1).to_pylist()))
        floor = np.array([least.get(q, -np.inf) for q in _column(table, "query_id").to_pylist()])
        second = (bounds >= floor[:, None] - _SLACK) & ~first
        if read is not None:
            read.append((len(names), int(first.any(axis=0).sum()), int(second.any(axis=0).sum())))
        return scanned(table, first).union(scanned(table, second))

    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = [answered(queries.where(block == i) if blocks > 1 else queries) for i in range(blocks)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return whole.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
