"""Random order and random split by keyed hash, without a one-partition sort."""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairsmith.functions.keyed import keyed_hash

# 4 hex digits: 65,536 prefixes at most, so the table of prefix counts stays small at any scale.
PREFIX = 4


def _prefix_counts(hashed: DataFrame) -> DataFrame:
    earlier = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_rows"))
    return counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))


def _hashed(df: DataFrame, hashed: Column) -> DataFrame:
    return df.withColumn("_hash", hashed).withColumn("_prefix", F.substring("_hash", 1, PREFIX))


def shuffled(df: DataFrame, seed: int, key: str, epoch: int | None = None) -> DataFrame:
    """Rows in seeded random order with their ``position`` from 0; ``key`` is unique."""
    hashed = keyed_hash(seed, F.col(key)) if epoch is None else keyed_hash(seed, epoch, F.col(key))
    marked = _hashed(df, hashed)
    inside = Window.partitionBy("_prefix").orderBy("_hash", key)
    return (
        marked.join(F.broadcast(_prefix_counts(marked)), "_prefix")
        .withColumn("position", F.row_number().over(inside) - 1 + F.col("_before"))
        .drop("_hash", "_prefix", "_rows", "_before")
    )


def split_ids(df: DataFrame, id_column: str, dev_share: float, seed: int = 10) -> DataFrame:
    """Distinct ids with ``part``: exactly ceil(share × ids) of them are 'dev', the rest 'train'."""
    ids = _hashed(df.select(id_column).distinct(), keyed_hash(seed, F.col(id_column)))
    counts = _prefix_counts(ids)
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    n_dev = math.ceil(total * dev_share)
    placed = ids.join(F.broadcast(counts), "_prefix")
    # Whole prefixes fall on one side, except for the single one that holds the boundary.
    on_boundary = (F.col("_before") < n_dev) & (F.col("_before") + F.col("_rows") > n_dev)
    clear = placed.where(~on_boundary).select(
        id_column, F.when(F.col("_before") < n_dev, F.lit("dev")).otherwise(F.lit("train")).alias("part")
    )
    inside = Window.partitionBy("_prefix").orderBy("_hash", id_column)
    mixed = (
        placed.where(on_boundary)
        .withColumn("_position", F.row_number().over(inside) + F.col("_before"))
        .select(id_column, F.when(F.col("_position") <= n_dev, F.lit("dev")).otherwise(F.lit("train")).alias("part"))
    )
    return clear.unionByName(mixed)


def rows_of(df: DataFrame, ids: DataFrame, id_column: str, part: str) -> DataFrame:
    return df.join(ids.where(F.col("part") == part).select(id_column), id_column, "left_semi")
