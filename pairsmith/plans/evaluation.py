"""Scored files and checkpoint choice from vectors."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairsmith.functions import arrays
from pairsmith.operators import index, metrics, retrieval, trec
from pairsmith.session import stored
from pairsmith.sources import files


def product_files(queries: DataFrame, documents: DataFrame, examples: DataFrame, key: str, out: str, vectors: DataFrame | None = None) -> None:
    """Hypothesis, results and judgement files of row-aligned query and document vectors.

    ``queries``: key, query_id, pos, vector; ``documents``: key, product_id,
    vector; or, with a table of ``vectors``, vec_id in place of vector. The scores
    are worked out once and stored for the files.
    """
    scored = stored(retrieval.score_aligned(queries, documents, key, vectors).select("query_id", "product_id", "pos", "score"), "scores")
    files.write_hypothesis(scored, f"{out}/hypothesis")
    files.write_spaced(trec.run_table(scored), f"{out}/results")
    files.write_spaced(trec.qrels_table(examples), f"{out}/qrels")


def run_lines(ranked: DataFrame) -> DataFrame:
    """Retrieved documents in the layout of a run file."""
    return ranked.select(
        "query_id", F.lit(trec.ITERATION).alias("Q0"), "doc_id", "rank", "score", F.lit(trec.RUN_NAME).alias("tool")
    )


def run_file_mrr(spark: SparkSession, path: str, cut: int = 100) -> DataFrame:
    """MRR of a run file in which a passage with the query's id is the hit."""
    run = files.read_run_file(spark, path)
    hits = metrics.first_hits(run, F.col("passage_id") == F.col("query_id"), cut)
    return metrics.mean_reciprocal_rank(hits, "first_hit")


def pair_mrr_by_step(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """MRR of every checkpoint in one job; both sides have the ``step`` of their vectors."""
    ranks = retrieval.pair_ranks(queries, documents, by="step")
    return ranks.groupBy("step").agg(F.count(F.lit(1)).alias("n_queries"), F.avg(1.0 / F.col("rank")).alias("value"))


def retrieval_mrr(queries: DataFrame, documents: DataFrame, wanted: str, found: str, cut: int) -> DataFrame:
    """MRR of the ``cut`` nearest documents; a hit is one whose ``found`` equals the query's ``wanted``."""
    ranked = retrieval.top_k(queries, documents, cut)
    named = ranked.join(queries.select("query_id", F.col(wanted).alias("_wanted")), "query_id").join(documents.select("doc_id", F.col(found).alias("_found")), "doc_id")
    return metrics.mean_reciprocal_rank(metrics.first_hits(named, F.col("_found") == F.col("_wanted"), cut), "first_hit")


def measures_by_step(queries: DataFrame, documents: DataFrame, cut_ndcg: int = 100, cut_mrr: int = 1000, **sizes) -> DataFrame:
    """(step, metric, n_queries, value): pair MRR, nDCG and retrieval MRR of every checkpoint from one pass over the scores.

    Both sides have step, vector and label; a query's own document has its id,
    and relevant are the documents with its label. Equal scores go by id, the
    smaller first; for the pair MRR they count as better.
    """
    keys = ["step", "query_id"]
    own = documents.select("step", F.col("doc_id").alias("query_id"), F.col("vector").alias("_d"))
    score = F.round(arrays.dot(F.col("vector"), F.col("_d")), retrieval.SCORE_DIGITS).alias("own_score")
    known = queries.join(own, keys).select(*keys, "vector", "label", score)
    types = retrieval.id_types(known, documents)
    fold = retrieval.PerGroup("step", lambda: retrieval.Measures(max(cut_ndcg, cut_mrr), cut_ndcg, *types))
    partial = retrieval.fold_scores(known, documents.select("step", "doc_id", "vector", "label"), fold, **sizes)
    counts = partial.where("doc_id is null").groupBy(*keys).agg(F.sum("n_better").alias("n_better"), F.sum("n_relevant").alias("n_relevant"))

    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    ranked = partial.where("doc_id is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(cut_ndcg, cut_mrr))
    labels = documents.select("step", "doc_id", F.col("label").alias("_found"))
    hits = ranked.join(labels, ["step", "doc_id"]).join(known.select(*keys, "label"), keys).where(F.col("label") == F.col("_found"))
    reached = hits.groupBy(*keys).agg(
        F.min(F.when(F.col("rank") <= cut_mrr, F.col("rank"))).alias("first_hit"),
        F.sum(F.when(F.col("rank") <= cut_ndcg, 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    places = F.sequence(F.lit(1), F.least("n_relevant", F.lit(cut_ndcg)).cast("int"))
    ideal = F.when(F.col("n_relevant") > 0, F.aggregate(places, F.lit(0.0), lambda total, i: total + 1 / F.log2(i + 1)))
    values = counts.join(reached, keys, "left").select(
        "step",
        F.explode(F.create_map(
            F.lit("pair_mrr"), 1.0 / (1 + F.col("n_better")),
            F.lit(f"ndcg_{cut_ndcg}"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)),
            F.lit(f"mrr_{cut_mrr}"), F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)),
        )).alias("metric", "value"),
    )
    return values.groupBy("step", "metric").agg(F.count(F.lit(1)).alias("n_queries"), F.avg("value").alias("value"))


def retrieve_to_run_file(queries: DataFrame, documents: DataFrame, k: int, out: str, **options) -> None:
    """Index the documents, retrieve the k best of each query exactly, and write them as a run file.

    The index stays at ``out``/index for further queries; the run file is ``out``/run.
    """
    index.build(documents, f"{out}/index", **options)
    files.write_spaced(run_lines(index.search(f"{out}/index", queries, k)), f"{out}/run")
