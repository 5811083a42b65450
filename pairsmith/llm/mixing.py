"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is wanted ``target / source size`` times: the whole
part is certain, the fraction f is sampled. Documents have unequal inclusion
odds, f / (1 - f) times the root of their length against the source's mean
length, so longer ones are preferred. A document with the random number u has
the Pareto rank of its random odds u / (1 - u) divided by its inclusion odds;
the lowest ranks of a source are taken until their words fill what the certain
copies leave of the target.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairsmith.llm import shared

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
SEED = "mix"
#: Documents of a source that one step of its cumulated sizes holds on average.
STEP = 1_000
_BITS = 52


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_number(key: Column, seed: str) -> Column:
    """Between 0 and 1, without both, from the md5 of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << _BITS)


def _lean(size: Column, mean: Column) -> Column:
    """A document's odds against those of one of mean length."""
    return F.sqrt((size + 1) / (mean + 1))


def _order(u: Column, size: Column, mean: Column) -> Column:
    """Between 0 and 1, in the order of the Pareto ranks of a source, whatever its fraction is."""
    ratio = u / (1 - u) / _lean(size, mean)
    return ratio / (1 + ratio)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, n, source_size, target) from (source, n, source_size), one row a source.

    Sources in code point order, null last, get the weights in turn. A source
    whose share would pass ``limit`` times its size stops there; the excess goes
    to the others by weight: they fill in the order of size by weight. This
    window sees one row per source, not per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(limit))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.withColumns({
        "total": F.sum("source_size").over(everything) * float(share),
        "full_before": F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "weight_left": F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)),
    })
    full = F.col("most") / F.col("weight") <= (F.col("total") - F.col("full_before")) / F.col("weight_left")
    rows = rows.withColumn("full", full).withColumns({
        "used": F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(everything),
        "open": F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything),
    })
    shared_out = F.col("weight") * ((F.col("total") - F.col("used")) / F.col("open"))
    return rows.select("source", "n", "source_size", F.when(F.col("full"), F.col("most")).otherwise(shared_out).alias("target"))


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", size_column: str = "size", weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = SEED) -> DataFrame:
    """``docs`` with source_size, target, copies and taken, which replace columns of these names.

    ``copies`` is how often the mix holds the document, ``taken`` its words
    times that. Null sizes count 0; null sources are one source; null ids share
    one random number. Equal ranks go by id as text, then size, so repeated rows
    are equal or neighbours in the order and are counted one by one. A source of
    size 0 gets nothing; an empty table stays empty. Only sums of a source's
    steps and the rows of the step where the target is met meet in one task.
    """
    size = F.coalesce(docs[size_column], F.lit(0)).cast("long")
    narrow = shared.written(
        docs.select(
            F.col(source_column).cast("string").alias("source"),
            size.alias("size"),
            random_number(F.col(id_column), seed).alias("u"),
            F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("key"),
        ),
        "mix",
    )
    sizes = narrow.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = source_targets(sizes, weights, share, limit).withColumns({"whole": F.floor(wanted), "part": wanted - F.floor(wanted)}).withColumns({
        "rest": F.col("target") - F.col("whole") * F.col("source_size"),
        "steps": F.ceil(F.col("n") / F.lit(float(STEP))),
    })
    sources = shared.written(sources, "mix-sources")

    mean = F.col("source_size") / F.col("n")
    step = F.floor(_order(F.col("u"), F.col("size"), mean) * F.col("steps")).alias("step")
    rank = (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")) * _lean(F.col("size"), mean))
    needed = sources.select(F.col("source").alias("of_source"), "steps", "part", "rest", "source_size", "n")
    known = narrow.join(needed, F.col("source").eqNullSafe(F.col("of_source"))).select("source", "size", "key", "rest", step, F.when(F.col("part") > 0, rank).alias("rank"))
    sums = known.groupBy("source", "step").agg(F.sum("size").alias("in_step"), F.first("rest").alias("rest"))
    so_far = F.sum("in_step").over(Window.partitionBy("source").orderBy("step"))
    crossed = sums.withColumn("so_far", so_far).where("so_far - in_step <= rest and rest < so_far")
    crossed = crossed.select(F.col("source").alias("at_source"), F.col("step").alias("at_step"), (F.col("so_far") - F.col("in_step")).alias("before"))
    inside = known.join(crossed, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("step") == F.col("at_step")))
    line = Window.partitionBy("source", "step").orderBy("rank", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("middle", F.col("before") + F.sum("size").over(line) - F.col("size") / 2)
    last = inside.groupBy("source", "step").agg(F.max(F.when(F.col("middle") <= F.col("rest"), F.struct("rank", "key", "size"))).alias("last"))
    last = last.select(F.col("source").alias("cut_source"), F.col("step").alias("cut_step"), "last")
    plan = sources.join(last, F.col("source").eqNullSafe(F.col("cut_source")), "left").select(F.col("source").alias("mix_source"), "source_size", "n", "target", "whole", "part", "steps", "cut_step", "last")
    plan = shared.written(plan, "mix-plan")

    base = docs.drop("source_size", "target", "copies", "taken")
    u, mean = random_number(base[id_column], seed), F.col("p.source_size") / F.col("p.n")
    own_rank = (u / (1 - u)) / (F.col("p.part") / (1 - F.col("p.part")) * _lean(size, mean))
    own = F.struct(F.when(F.col("p.part") > 0, own_rank).alias("rank"), F.coalesce(base[id_column].cast("string"), F.lit("")).alias("key"), size.alias("size"))
    own_step = F.floor(_order(u, size, mean) * F.col("p.steps"))
    picked = (F.col("p.part") > 0) & ((own_step < F.col("p.cut_step")) | ((own_step == F.col("p.cut_step")) & F.coalesce(own <= F.col("p.last"), F.lit(False))))
    copies = (F.col("p.whole") + F.coalesce(picked, F.lit(False)).cast("long")).cast("long")
    joined = base.join(plan.alias("p"), base[source_column].cast("string").eqNullSafe(F.col("p.mix_source")))
    return joined.select(*(base[c] for c in base.columns), F.col("p.source_size"), F.col("p.target"), copies.alias("copies"), (copies * F.coalesce(base[size_column], F.lit(0)).cast("long")).alias("taken"))
