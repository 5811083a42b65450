"""Run and judgement tables in the layout that evaluation tools read."""

from pyspark.sql import Column, DataFrame, functions as F

from pairsmith.functions import labels
from pairsmith.operators.order import MAX_ROWS, group_row_number

# The highest run score, and the constant columns of both files.
TOP_SCORE = 128
ITERATION = "Q0"
RUN_NAME = "baseline"


def rank_score(rank: Column, size: Column) -> Column:
    """Evenly spaced score for 0-based ``rank`` in a list of ``size``, best first."""
    return F.bround((size - 1 - rank) * F.lit(float(TOP_SCORE)) / size, 3)


def run_table(scored: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """query_id, Q0, product_id, rank from 0, score, name; by score descending, then row order ``pos``."""
    # A missing score ranks last.
    order = [F.col("score").isNull(), -F.col("score"), F.col("pos")]
    ranked = group_row_number(scored, ["query_id"], order, "_number", max_rows, size="_size")
    rank = F.col("_number") - 1
    return ranked.select(
        "query_id",
        F.lit(ITERATION).alias("iteration"),
        "product_id",
        rank.alias("rank"),
        rank_score(rank, F.col("_size")).alias("score"),
        F.lit(RUN_NAME).alias("conf"),
    )


def qrels_table(examples: DataFrame) -> DataFrame:
    """query_id, 0, product_id, relevance; made from the examples alone."""
    return examples.select(
        "query_id", F.lit(0).alias("iteration"), "product_id", labels.relevance(F.col("esci_label")).alias("relevance")
    )

