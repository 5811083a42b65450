"""Query groups with positives and negatives, and group sampling per epoch."""

from pyspark.sql import Column, DataFrame, functions as F

from pairsmith.functions import arrays
from pairsmith.functions.keyed import keyed_hash, keyed_index
from pairsmith.operators.order import MAX_ROWS, group_row_number


def _sides(items: DataFrame) -> DataFrame:
    return items.withColumn("_side", F.when(F.col("gain") == 1, F.lit(1)).otherwise(F.lit(0)))


def _complete_keys(items: DataFrame, key: str) -> DataFrame:
    counts = items.groupBy(key).agg(
        F.count_if(F.col("_side") == 1).alias("_n_pos"), F.count_if(F.col("_side") == 0).alias("_n_neg")
    )
    return counts.where((F.col("_n_pos") > 0) & (F.col("_n_neg") > 0))


def group_items(items: DataFrame, key: str = "query_id", order: str = "pos", max_rows: int = MAX_ROWS) -> DataFrame:
    """(key, query, side, place, text, gain, product_id) of complete groups, for groups of any size.

    ``side`` is 1 for positives and 0 for negatives, ``place`` counts from 0 in
    row order. This is the form for groups that may not fit one row.
    """
    sided = _sides(items)
    ranked = group_row_number(sided, [key, "_side"], [F.col(order)], "_number", max_rows)
    whole = ranked.join(_complete_keys(sided, key).select(key), key, "left_semi")
    return whole.select(key, "query", F.col("_side").alias("side"), (F.col("_number") - 1).alias("place"), "text", "gain", "product_id")


def query_groups(items: DataFrame, key: str = "query_id", order: str = "pos") -> DataFrame:
    """One row per query that has both positives and negatives, with both lists in row order.

    ``items``: key, query, gain, text, product_id and the order column. A row
    holds its whole group, as the nested files do; ``group_items`` has the same
    groups as rows, and ``sample_groups`` needs no nested row.
    """
    items = _sides(items)

    def side(number):
        item = F.struct(F.col(order).alias("o"), "text", "gain", "product_id")
        ordered = F.array_sort(F.collect_list(F.when(F.col("_side") == number, item)))
        return F.transform(
            ordered, lambda x: F.struct(x["text"].alias("text"), x["gain"].alias("gain"), x["product_id"].alias("product_id"))
        )

    groups = items.groupBy(key).agg(F.min_by("query", order).alias("query"), side(1).alias("positive"), side(0).alias("negative"))
    return groups.where((F.size("positive") > 0) & (F.size("negative") > 0))


def sample_record(
    records: DataFrame,
    epoch: int,
    seed: int | None,
    n_passages: int,
    key: str = "key",
    fixed_positive: bool = False,
    fixed_negatives: bool = False,
    lengths: dict[str, int] | None = None,
) -> DataFrame:
    """``passages`` of one epoch: a positive and n−1 negatives, from the arrays of each row.

    Records of ids are cut to ``lengths`` of query, passages and labels, where given.
    No state and no shuffle, so it serves a stream of records as it serves a batch.
    """
    k = n_passages - 1
    positives, negatives = F.col("positives"), F.col("negatives")
    size = F.size(negatives)
    if seed is None or fixed_positive:
        chosen = F.element_at(positives, 1)
    else:
        chosen = F.element_at(positives, F.pmod(F.lit(seed + epoch), F.size(positives)) + 1)

    if seed is None:
        short = F.slice(F.concat(negatives, negatives), 1, k)
    else:
        slots = F.array(*[F.lit(s) for s in range(k)]).cast("array<int>")
        short = F.when(
            size > 0,
            F.transform(slots, lambda s: F.element_at(negatives, keyed_index(size, seed, F.col(key), epoch, s) + 1)),
        ).otherwise(negatives)

    mixed = negatives
    if seed is not None and not fixed_negatives:
        drawn = F.transform(
            negatives, lambda x, i: F.struct(keyed_hash(seed, F.col(key), i).alias("h"), i.alias("i"), x.alias("x"))
        )
        mixed = F.transform(F.array_sort(drawn), lambda d: d["x"])
    if k == 0:
        full = F.slice(negatives, 1, 0)
    elif fixed_negatives:
        full = F.slice(negatives, 1, k)
    else:
        full = arrays.rotated(mixed, F.pmod(F.lit(epoch * k), F.greatest(size, F.lit(1))), k)
    passages = F.concat(F.array(chosen), F.when(size < k, short).otherwise(full))
    sampled = records.withColumn("passages", _of_size(passages, n_passages)).drop("positives", "negatives")
    for name, length in (lengths or {}).items():
        cut = F.transform(name, lambda p: arrays.truncate(p, length)) if name == "passages" else arrays.truncate(F.col(name), length)
        sampled = sampled.withColumn(name, cut)
    return sampled


def _of_size(passages: Column, n_passages: int) -> Column:
    found = F.size(passages)
    wrong = F.raise_error(F.concat(F.lit("group size "), found.cast("string"), F.lit(f", not {n_passages}")))
    return F.when(found == n_passages, passages).otherwise(wrong)


def sample_items(
    items: DataFrame,
    epoch: int,
    seed: int | None,
    n_passages: int,
    key: str = "query_id",
    order: str = "pos",
    item: str = "text",
    fixed_positive: bool = False,
    fixed_negatives: bool = False,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """``sample_record`` from rows in place of arrays, for groups too large for one row.

    The wanted positions are worked out from the group sizes (n rows per
    query), and joined with the numbered items.
    """
    k = n_passages - 1
    items = _sides(items).select(key, "query", "_side", F.col(order).alias("_o"), F.col(item).alias("_item"))
    first = items.groupBy(key).agg(F.min_by("query", "_o").alias("query"))
    sizes = _complete_keys(items, key)
    ranked = group_row_number(items, [key, "_side"], [F.col("_o")], "_number", max_rows)
    ranked = ranked.withColumn("_place", F.col("_number") - 1)
    if seed is not None and not fixed_negatives:
        drawn = ranked.where(F.col("_side") == 0).withColumn("_draw", keyed_hash(seed, F.col(key), F.col("_place")))
        mixed = group_row_number(drawn, [key], [F.col("_draw"), F.col("_place")], "_mixed", max_rows)
        mixed = mixed.join(sizes.select(key, "_n_neg"), key).withColumn(
            "_place", F.when(F.col("_n_neg") < k, F.col("_place")).otherwise(F.col("_mixed") - 1)
        )
        columns = [key, "query", "_side", "_place", "_item"]
        ranked = ranked.where(F.col("_side") == 1).select(*columns).unionByName(mixed.select(*columns))

    slots = sizes.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(k))))
    slot, n_pos, n_neg = F.col("_slot"), F.col("_n_pos"), F.col("_n_neg")
    positive = F.lit(0) if seed is None or fixed_positive else F.pmod(F.lit(seed + epoch), n_pos)
    if seed is None:
        short = F.when(slot - 1 < 2 * n_neg, F.pmod(slot - 1, n_neg))
    else:
        short = keyed_index(n_neg, seed, F.col(key), epoch, slot - 1)
    full = slot - 1 if fixed_negatives else F.pmod(F.lit(epoch * k) + slot - 1, n_neg)
    wanted = slots.select(
        key,
        "_slot",
        F.when(slot == 0, F.lit(1)).otherwise(F.lit(0)).alias("_side"),
        F.when(slot == 0, positive).when(n_neg < k, short).otherwise(full).cast("long").alias("_place"),
    )
    picked = wanted.join(ranked.drop("query"), [key, "_side", "_place"])
    passages = F.transform(F.array_sort(F.collect_list(F.struct("_slot", "_item"))), lambda x: x["_item"])
    return first.join(picked.groupBy(key).agg(_of_size(passages, n_passages).alias("passages")), key)


def sample_groups(items: DataFrame, epoch: int, seed: int | None, n_passages: int, **options) -> DataFrame:
    """Sampled passages for each complete query, in one way at any size."""
    return sample_items(items, epoch, seed, n_passages, **options)


def as_records(groups: DataFrame) -> DataFrame:
    """Groups as training records: the texts alone."""
    return groups.select(
        "query_id",
        F.col("query_id").cast("string").alias("key"),
        "query",
        F.transform("positive", lambda x: x["text"]).alias("positives"),
        F.transform("negative", lambda x: x["text"]).alias("negatives"),
    )


def candidates(groups: DataFrame) -> DataFrame:
    """Positives, then negatives, of each dev group as rows with their place in the list."""
    listed = groups.select("query_id", F.posexplode(F.concat("positive", "negative")).alias("place", "c"))
    return listed.select("query_id", "place", F.col("c.product_id").alias("product_id"), F.col("c.gain").alias("gain"))
