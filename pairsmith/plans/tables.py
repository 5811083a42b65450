"""The driver's tables as inputs of the jobs."""

from pyspark.sql import DataFrame, SparkSession, functions as F

# Judged rows of a task, on average.
TASK_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged query–product rows; ``pos`` is the row order inside a query."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    # Work by query goes on in the partitions of this join, so tasks stay small only if their number grows with the rows.
    parts = lines.count() // TASK_ROWS
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        lines, orders = lines.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
    lines = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    key = F.col("l_orderkey")
    return lines.select(
        key.alias("query_id"),
        F.col("l_partkey").alias("product_id"),
        F.concat(F.lower("o_orderpriority"), F.lit(" order for customer "), F.col("o_custkey").cast("string")).alias("query"),
        F.when(F.col("l_suppkey") % 5 == 0, "jp").otherwise("us").alias("product_locale"),
        F.when(key % 2 == 0, 1).otherwise(0).alias("small_version"),
        F.when(key % 10 != 0, 1).otherwise(0).alias("large_version"),
        F.when(key % 4 == 3, "test").otherwise("train").alias("split"),
        F.when(F.col("l_returnflag") == "A", "E")
        .when(F.col("l_returnflag") == "N", "S")
        .when(F.col("l_linestatus") == "F", "C")
        .otherwise("I")
        .alias("esci_label"),
        F.col("l_extendedprice").alias("score"),
        F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice").alias("pos"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("p_partkey"), "html")
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("p_partkey"), "text")
    title = F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(""))
    locales = F.explode(F.array(F.lit("us"), F.lit("jp"))).alias("product_locale")
    return (
        part.select("p_partkey", "p_name", "p_brand", locales)
        .where(~((F.col("product_locale") == "jp") & (F.col("p_partkey") % 7 == 0)))
        .join(pages, "p_partkey", "left")
        .join(documents, "p_partkey", "left")
        .select(
            "product_locale",
            F.col("p_partkey").alias("product_id"),
            F.coalesce(title, F.concat("p_name", F.lit(" "), "p_brand")).alias("product_title"),
            F.col("html").alias("product_description"),
            F.col("text").alias("product_bullet_point"),
        )
    )


def code_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows, as docstring and code."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("docstring"))
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    by_function = F.col("conv_id") % 3 == 0
    language = F.col("conv_id") % 6
    return asked.join(answered, ["conv_id", "turn"]).select(
        "conv_id",
        "turn",
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("url"),
        F.when(language == 0, "python")
        .when(language == 1, "php")
        .when(language == 2, "java")
        .when(language == 3, "go")
        .when(language == 4, "ruby")
        .otherwise("javascript")
        .alias("language"),
        "docstring",
        F.when(~by_function, F.col("answer")).alias("code_text"),
        F.when(by_function, F.col("answer")).alias("function_text"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
