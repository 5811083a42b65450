"""Retrieval measures, and the choice of a checkpoint by them."""

from pyspark.sql import DataFrame, Window, functions as F

from pairsmith.functions import labels


def first_hits(run: DataFrame, hit, cut: int) -> DataFrame:
    """(query_id, first_hit): place of the first hit among the first ``cut`` by ``rank``; NULL without one.

    Places count the lines that are there, so gaps in the ranks do not matter.
    Two aggregations, no sort and no window, however long one query's list is.
    """
    first = run.groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("_hit"))
    reached = first.where(F.col("_hit").isNotNull())
    places = (
        run.join(reached, "query_id")
        .where(F.col("rank") <= F.col("_hit"))
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("_place"))
        .where(F.col("_place") <= cut)
    )
    return first.join(places, "query_id", "left").select("query_id", F.col("_place").alias("first_hit"))


def mean_reciprocal_rank(ranks: DataFrame, column: str) -> DataFrame:
    """A query whose rank is NULL counts as 0."""
    return ranks.agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg(F.coalesce(1.0 / F.col(column), F.lit(0.0))).alias("mrr")
    )


def _gain_sum(ranked: DataFrame, weight: str, name: str) -> DataFrame:
    return ranked.groupBy("query_id").agg(F.sum(F.col(weight) / F.log2(F.col("_rank") + 1)).alias(name))


def ndcg_per_query(
    run: DataFrame, judged: DataFrame, weight: str = "weight", cut: int | None = None
) -> DataFrame:
    """nDCG of each judged query.

    ``run``: query_id, doc_id, score; ``judged``: query_id, doc_id, weight; one
    row per pair in each. Only judged documents are ranked; ties go to the
    id that is later as text, and a missing score ranks last. A query's judged
    documents are ranked in one task, as judgements are made by hand. Judged queries without a result, or without any weight, get 0.
    """
    scored = run.join(judged, ["query_id", "doc_id"]).select("query_id", "doc_id", "score", weight)

    by_id = F.col("doc_id").cast("string")

    def ranked(df, *order):
        numbered = df.withColumn("_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
        return numbered if cut is None else numbered.where(F.col("_rank") <= cut)

    gained = _gain_sum(ranked(scored, F.desc_nulls_last("score"), by_id.desc()), weight, "dcg")
    ideal = _gain_sum(ranked(judged.select("query_id", "doc_id", weight), F.desc(weight), by_id), weight, "ideal")
    ratio = F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0)
    return ideal.join(gained, "query_id", "left").select("query_id", ratio.alias("ndcg"))


def mean_ndcg(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("ndcg").alias("ndcg"))


def judged_graded(qrels: DataFrame) -> DataFrame:
    return qrels.select(
        "query_id", "doc_id", labels.looked_up(F.col("relevance"), labels.LEVEL_WEIGHT).alias("weight")
    )


def running_best(metrics: DataFrame) -> DataFrame:
    """``is_best`` where the value is above 0 and above every earlier step of its run.

    One row per checkpoint, so the windows are as short as the list of checkpoints.
    """
    earlier = Window.partitionBy("run", "metric").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("value").over(earlier), F.lit(0.0))
    return metrics.withColumn("is_best", (F.col("value") > 0) & (F.col("value") > before))


def best_checkpoint(metrics: DataFrame) -> DataFrame:
    """The first step with the highest value above 0."""
    above = metrics.where(F.col("value") > 0)
    best = F.max_by(F.struct("step", "value"), F.struct("value", -F.col("step")))
    return above.groupBy("run", "metric").agg(best.alias("_b")).select("run", "metric", "_b.step", "_b.value")
