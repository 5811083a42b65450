"""Draws that depend on a seed and a key only.

A draw made this way is the same on every retry, for every partitioning and in
a stream as in a batch.
"""

from pyspark.sql import Column, DataFrame, functions as F


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def keyed_hash(seed, *keys) -> Column:
    """Hex md5 of ``seed:key:key…``; order by it for a random permutation."""
    return F.md5(F.concat_ws(":", _text(seed), *[_text(k) for k in keys]))


def keyed_index(size: Column, seed, *keys) -> Column:
    """0-based index below ``size``, uniform up to the 2^32 grid."""
    return F.pmod(F.conv(F.substring(keyed_hash(seed, *keys), 1, 8), 16, 10).cast("long"), size.cast("long")).cast("int")


def once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``df`` with a column that is evaluated once for each row.

    Spark may copy a column's expression to each place that uses it, also into
    lambdas, where it runs for each item. It does not copy through a generator.
    """
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(column)).alias(name))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once for each row, also where the body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
