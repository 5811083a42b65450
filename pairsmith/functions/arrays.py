"""Arrays of ids and vectors: cut, pad, dot product, circular slice."""

from pyspark.sql import Column, functions as F

PAD_ID = 0
UNKNOWN_ID = 1
IGNORED_LABEL = -100


def truncate(ids: Column, length: int) -> Column:
    return F.slice(ids, 1, length)


def pad(ids: Column, length: int, pad_id: int = PAD_ID) -> Column:
    """Right-padded to exactly ``length``; longer input is cut."""
    kept = truncate(ids, length)
    return F.concat(kept, F.array_repeat(F.lit(pad_id), (F.lit(length) - F.size(kept)).cast("int")))


def attention_mask(ids: Column, length: int) -> Column:
    """True on real ids, false on padding."""
    kept = F.least(F.size(ids), F.lit(length))
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: i <= kept)


def ignore_padding(padded: Column, pad_id: int = PAD_ID) -> Column:
    return F.transform(padded, lambda i: F.when(i == pad_id, F.lit(IGNORED_LABEL)).otherwise(i))


def dot(left: Column, right: Column) -> Column:
    same = F.size(left) == F.size(right)
    left = F.when(same | left.isNull() | right.isNull(), left).otherwise(F.raise_error(F.lit("vectors of different lengths")))
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def rotated(items: Column, offset: Column, length: int) -> Column:
    """``length`` items from ``offset`` on, going round once."""
    return F.slice(F.concat(items, items), offset + 1, F.lit(length))
