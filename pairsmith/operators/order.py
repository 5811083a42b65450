"""Exact positions and runs inside ordered groups of any size.

An ordinary window hands a whole group to one task. Here a counting job (with
map-side combine) first looks for groups above ``max_rows``. Without any, the
ordinary window is used. Otherwise each large group is cut at split points into
buckets that follow the order; windows run per bucket, and a small table of
bucket totals carries the numbers from one bucket to the next. The split points
are rows picked by hash, so they are the same whenever a stage runs again. They
only place the cuts: every row is kept and numbered.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_ROWS = 1_000_000
SPLITS = 1024
FAN_OUT = 32
BROADCAST_GROUPS = 64


def attach(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left", small: bool = False) -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the key columns of ``other`` are dropped."""
    renamed = other.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], *[F.col(c) for c in other.columns if c not in keys]
    )
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"_key_{k}"]) for k in keys])
    joined = df.join(F.broadcast(renamed) if small else renamed, same, how)
    return joined.drop(*[f"_key_{k}" for k in keys])


def large_groups(df: DataFrame, keys: list[str], max_rows: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > max_rows)


def _bucketed(df: DataFrame, keys: list[str], order: list[Column], max_rows: int, splits: int):
    """``df`` with ``_order`` and ``_bucket``, and whether bucket tables are small; None if no group is large."""
    df = df.withColumn("_order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    large = large_groups(df, keys, max_rows)
    n_large, most = large.agg(F.count(F.lit(1)), F.max("_rows")).first()
    if n_large == 0:
        return None
    # Buckets of about max_rows in the largest group, whatever its size is; each row is placed in two short scans.
    splits = max(splits, -(-most // max_rows))
    fan_out = max(FAN_OUT, math.isqrt(splits))
    small = n_large <= BROADCAST_GROUPS and splits <= SPLITS
    sizes = large
    large = large.select(*keys)
    spread = Window.partitionBy(*keys).orderBy(F.xxhash64("_order"), "_order")
    cuts = (
        attach(df.select(*keys, "_order"), large, keys, "left_semi", small)
        .withColumn("_pick", F.row_number().over(spread))
        .where(F.col("_pick") <= splits)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("_order")).alias("_cuts"))
        .withColumn("_heads", F.filter("_cuts", lambda c, i: i % fan_out == fan_out - 1))
    )
    cuts = attach(cuts, sizes, keys, "inner", small)
    marked = attach(df, cuts, keys, small=small)
    # Two short scans in place of one long one: the block of cuts, then the cut in it.
    block = F.size(F.filter("_heads", lambda c: c < F.col("_order"))) * fan_out
    marked = marked.withColumn("_block", F.coalesce(block, F.lit(0)))
    inside = F.size(F.filter(F.slice("_cuts", F.col("_block") + 1, F.lit(fan_out)), lambda c: c < F.col("_order")))
    bucket = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(1 + F.col("_block") + inside)
    return marked.withColumn("_bucket", bucket).drop("_cuts", "_heads", "_block"), small


def _keyed(df: DataFrame, keys: list[str]):
    return (df, keys) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def group_row_number(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    name: str,
    max_rows: int = MAX_ROWS,
    splits: int = SPLITS,
    size: str | None = None,
) -> DataFrame:
    """1-based position by ``order`` (ascending) within ``keys``; no keys: in the whole table.

    ``size`` names a further column with the number of rows of the group.
    """
    wanted = df.columns + [name] + ([size] if size else [])
    df, keys = _keyed(df, keys)
    bucketed = _bucketed(df, keys, order, max_rows, splits)
    if bucketed is None:
        if size:
            df = df.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("long")).select(*wanted)
    marked, small = bucketed
    if size:
        # Groups that were not cut lie in bucket 0 whole.
        inside = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_bucket"))
        marked = marked.withColumn(size, F.coalesce("_rows", inside))
    marked = marked.drop("_rows")
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        marked.where(F.col("_bucket") > 0)
        .groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy("_order")
    return (
        attach(marked, before, keys + ["_bucket"], small=small)
        .withColumn(name, F.row_number().over(local) + F.coalesce("_before", F.lit(0)))
        .select(*wanted)
    )


def number_runs(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    value: str,
    name: str = "island",
    max_rows: int = MAX_ROWS,
    splits: int = SPLITS,
) -> DataFrame:
    """Numbers from 1 for the runs of rows that follow each other with an equal ``value``."""
    source = df.columns
    df, keys = _keyed(df, keys)
    bucketed = _bucketed(df, keys, order, max_rows, splits)

    def starts(window):
        same = F.col(value).eqNullSafe(F.lag(value).over(window))
        return F.when(F.row_number().over(window) == 1, F.lit(None)).otherwise((~same).cast("long"))

    if bucketed is None:
        window = Window.partitionBy(*keys).orderBy(*order)
        running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        numbered = df.withColumn("_start", F.coalesce(starts(window), F.lit(1)))
        return numbered.withColumn(name, F.sum("_start").over(running)).select(*source, name)

    marked, small = bucketed
    local = Window.partitionBy(*keys, "_bucket").orderBy("_order")
    marked = marked.withColumn("_start", F.coalesce(starts(local), F.lit(0)))
    buckets = Window.partitionBy(*keys).orderBy("_bucket")
    base = (
        marked.groupBy(*keys, "_bucket")
        .agg(
            F.sum("_start").alias("_inner"),
            F.min_by(value, "_order").alias("_first"),
            F.max_by(value, "_order").alias("_last"),
        )
        .withColumn("_opens", _opens_run(buckets))
        .withColumn(
            "_base",
            F.col("_opens")
            + F.coalesce(
                F.sum(F.col("_opens") + F.col("_inner")).over(buckets.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select(*keys, "_bucket", "_base")
    )
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        attach(marked, base, keys + ["_bucket"])
        .withColumn(name, F.col("_base") + F.sum("_start").over(running))
        .select(*source, name)
    )


def _opens_run(buckets) -> Column:
    same = F.col("_first").eqNullSafe(F.lag("_last").over(buckets))
    return F.when(F.row_number().over(buckets) == 1, F.lit(1)).otherwise((~same).cast("long"))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row by ``order`` for each key, as an aggregate that combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def assign_batches(df: DataFrame, order: list[Column], batch_size: int, max_rows: int = MAX_ROWS) -> DataFrame:
    """``position`` from 0 in row order and ``batch_id``; the last batch may be short."""
    numbered = group_row_number(df, [], order, "_number", max_rows)
    position = F.col("_number") - 1
    return numbered.select(
        *df.columns, position.alias("position"), F.floor(position / batch_size).alias("batch_id")
    )
