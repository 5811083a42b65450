"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= t have squared distance <= 2 - 2t. After a random
rotation that distance is spread over m blocks of coordinates, so in some block
it is at most an m-th: each block is range-joined on a grid under that budget,
and a pair found is confirmed by its exact cosine. A pair is taken only in the
first block that admits it, so none counts twice.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairsmith.llm import shared

THRESHOLD = 0.93
BLOCKS = 8
#: Leading coordinates of a block that make its grid, 1 or 2: more of them make smaller cells, but send each vector to more of them.
GRID = 1
#: Vectors of a cell that one task compares with as many of another; larger cells are split into such tiles.
TILE = 4_096
#: Pairs of a tile that are confirmed at a time.
CHUNK = 100_000
SCALE = 1 << 20


def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.Generator(np.random.Philox(key=size)).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def splits(size: int, blocks: int) -> list[slice]:
    """The coordinates of each block; fewer blocks than asked for where there are fewer coordinates."""
    edges = np.linspace(0, size, min(blocks, size) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def budget(size: int, block: slice, threshold: float) -> float:
    """The block's share, by its coordinates, of the squared distance in units of 1 / SCALE, with room for rounding."""
    far = np.sqrt(2 - 2 * threshold) + 1e-9 + np.sqrt(size) / SCALE
    return far * far * SCALE * SCALE * (block.stop - block.start) / size


def turned(vectors: np.ndarray) -> np.ndarray:
    """Rotated unit vectors as whole numbers of 1 / SCALE, which all tasks compare alike."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return np.rint(v / np.linalg.norm(v, axis=1, keepdims=True) @ rotation(v.shape[1]) * SCALE).astype(np.int32)


def _placed(batches: Iterator[pa.RecordBatch], threshold: float, n_blocks: int, grid: int, kind) -> Iterator[pa.RecordBatch]:
    """A row for each vector and block: its cell."""
    for batch in batches:
        sizes = np.array([len(x) for x in batch.column(2)])
        for size in np.unique(sizes).tolist():
            own = batch.filter(pa.array(sizes == size))
            vectors = np.array(own.column(2).to_pylist(), np.float64)
            q = turned(vectors)
            for j, block in enumerate(splits(size, n_blocks)):
                side = np.sqrt(budget(size, block, threshold))
                cell = np.floor(q[:, block][:, :grid] / side).astype(np.int64)
                cell = np.pad(cell, ((0, 0), (0, 2 - cell.shape[1])))
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, j, np.int32)), *(pa.array(cell[:, g]) for g in range(2)), pa.array([x.tobytes() for x in q], pa.binary()), pa.array([x.tobytes() for x in vectors.astype(kind)], pa.binary()), own.column(3)],
                    names=["rep", "label", "size", "block", "x", "y", "turned", "vector", "copies"],
                )


def _compared(batches: Iterator[pa.RecordBatch], threshold: float, n_blocks: int, kind) -> Iterator[pa.RecordBatch]:
    """(rep, links, root) of the vectors with links in each tile of comparisons."""
    key = ["label", "size", "block", "x", "y", "step", "tile", "other"]
    for table in shared.sorted_groups(batches, key):
        table = table.combine_chunks()
        ids = np.stack([table.column(c).to_numpy().astype(np.int64) for c in key])
        cuts = np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1, [table.num_rows]])
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if end - start > 1:
                yield from _tile(table.slice(start, end - start), threshold, n_blocks, kind)


def _tile(table: pa.Table, threshold: float, n_blocks: int, kind) -> Iterator[pa.RecordBatch]:
    size, j = table.column("size")[0].as_py(), table.column("block")[0].as_py()
    parts, most = splits(size, n_blocks), [budget(size, b, threshold) for b in splits(size, n_blocks)]
    guest = np.array(table.column("guest").to_pylist())
    same = table.column("step")[0].as_py() == 0 and table.column("tile")[0].as_py() == table.column("other")[0].as_py()
    left, right = (np.arange(len(guest)),) * 2 if same else (np.flatnonzero(~guest), np.flatnonzero(guest))
    if not len(left) or not len(right):
        return
    q = np.frombuffer(b"".join(table.column("turned").to_pylist()), np.int32).reshape(-1, size).astype(np.float64)
    vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(-1, size).astype(np.float64)
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    copies, reps = table.column("copies").to_numpy(), table.column("rep").to_numpy()
    links, forest = np.zeros(len(reps), np.int64), shared.Forest(len(reps))
    a, b = q[left][:, parts[j]], q[right][:, parts[j]]
    norms = (b * b).sum(1)
    rows = max(1, 4_000_000 // len(right))
    for first in range(0, len(left), rows):
        x = a[first : first + rows]
        near = (x * x).sum(1)[:, None] + norms - 2 * x @ b.T <= most[j]  # whole numbers below 2^53: exact
        i, k = np.nonzero(near)
        i, k = left[i + first], right[k]
        if same:
            i, k = i[i < k], k[i < k]
        for at in range(0, len(i), CHUNK):
            one, two = i[at : at + CHUNK], k[at : at + CHUNK]
            for earlier in range(j):
                far = ((q[one, parts[earlier]] - q[two, parts[earlier]]) ** 2).sum(1) > most[earlier]
                one, two = one[far], two[far]
            linked = (unit[one] * unit[two]).sum(1) >= threshold
            one, two = one[linked], two[linked]
            np.add.at(links, one, copies[two])
            np.add.at(links, two, copies[one])
            forest.union(one, two)
    found = np.flatnonzero(links)
    if len(found):
        roots = reps[forest.roots()[found]]
        yield pa.RecordBatch.from_arrays([pa.array(reps[found]), pa.array(links[found]), pa.array(roots)], names=["rep", "links", "root"])


def link(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", threshold: float = THRESHOLD, blocks: int = BLOCKS, grid: int = GRID) -> DataFrame:
    """(id, n_links, component_id, kept) of each row, by cosine >= ``threshold`` within equal labels.

    Ids are whole numbers and unique; rows with a null label, or whose vector is
    null, empty, zero or holds a null or non-finite component, link with
    nothing; vectors of different lengths never link. Equal vectors of a label
    are compared once, with their number. A row with a null id links with
    nothing; it has a null component_id and is kept.
    """
    spark = vectors.sparkSession
    shared.small_batches(spark)
    kind = np.float32 if dict(vectors.dtypes)[vector_column] == "array<float>" else np.float64  # sent as they are
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    labels = F.xxhash64("label").alias("label")
    classes = usable.groupBy(labels, "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    placed = classes.select("rep", "label", "v", "copies").mapInArrow(lambda b: _placed(b, threshold, blocks, grid, kind), "rep long, label long, size int, block int, x long, y long, turned binary, vector binary, copies long")
    placed = shared.written(placed, "vectors")

    tiles = F.ceil(F.col("n") / F.lit(float(TILE))).cast("int")
    cells = shared.written(placed.groupBy("label", "size", "block", "x", "y").agg(F.count("*").alias("n")).withColumn("tiles", tiles).drop("n"), "cells")
    steps = [(0, 0), (1, 0)] if grid == 1 else [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(steps))))
    cell = ["label", "size", "block", "x", "y"]
    asked = cells.withColumn("s", step).select(*cell, "tiles", "s.step", (F.col("x") + F.col("s.dx")).alias("x2"), (F.col("y") + F.col("s.dy")).alias("y2"))
    others = cells.select("label", "size", "block", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("tiles").alias("tiles2"))
    pairs = shared.written(asked.join(others, ["label", "size", "block", "x2", "y2"]), "cell-pairs")

    mine = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    theirs = F.pmod(F.xxhash64("rep"), F.col("tiles2")).cast("int")
    sent = ["turned", "vector", "copies", "rep"]
    # A cell with itself: tile a meets tile b >= a; the rows of b are the guests.
    hosts = placed.join(pairs, cell).withColumn("tile", mine)
    hosts = hosts.withColumn("other", F.explode(F.sequence(F.when(F.col("step") == 0, F.col("tile")).otherwise(F.lit(0)), F.col("tiles2") - 1)))
    hosts = hosts.select(*cell, "step", "tile", "other", F.lit(False).alias("guest"), *sent)
    visit = pairs.select("label", "size", "block", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x2").alias("x"), F.col("y2").alias("y"), "step", "tiles", "tiles2").where("step > 0 or tiles > 1")
    guests = placed.join(visit, cell).withColumn("other", theirs)
    hosting = F.when(F.col("step") > 0, F.sequence(F.lit(0), F.col("tiles") - 1)).when(F.col("other") > 0, F.sequence(F.lit(0), F.col("other") - 1))
    guests = guests.withColumn("tile", F.explode(hosting))
    guests = guests.select("label", "size", "block", F.col("x1").alias("x"), F.col("y1").alias("y"), "step", "tile", "other", F.lit(True).alias("guest"), *sent)
    key = [*cell, "step", "tile", "other"]
    gathered = hosts.union(guests).repartition(*key).sortWithinPartitions(*key)
    found = shared.written(gathered.mapInArrow(lambda b: _compared(b, threshold, blocks, kind), "rep long, links long, root long"), "links")

    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = shared.components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = classes.join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("label").alias("l"), F.col("v").alias("w"), "rep", "copies", "links", "component")
    own_label = F.when(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)), F.when(F.col("label").isNotNull(), F.xxhash64("label")))
    joined = rows.withColumn("l", own_label).join(known.withColumnRenamed("l", "l2"), (F.col("l") == F.col("l2")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component", "rep", "id")
    n_links = F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return joined.select(F.col("id").alias(id_column), n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
