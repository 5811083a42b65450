"""Labelled query–item tables: join, filters, texts, pairs."""

from pyspark.sql import Column, DataFrame, functions as F

from pairsmith.functions import labels, text
from pairsmith.functions.keyed import keyed_index, once

JOIN_KEYS = ["product_locale", "product_id"]


def join_products(examples: DataFrame, products: DataFrame) -> DataFrame:
    """Every example, with its product where there is one."""
    return examples.join(products, JOIN_KEYS, "left")


def select_examples(
    examples: DataFrame, locale: str, large: int | None = None, small: int | None = None, split: str | None = None
) -> DataFrame:
    """Rows of one locale, version and split; an option left out does not filter."""
    wanted = {"product_locale": locale, "large_version": large, "small_version": small, "split": split}
    for name, value in wanted.items():
        if value is not None:
            examples = examples.where(F.col(name) == value)
    return examples


def union_splits(parts: list[DataFrame]) -> DataFrame:
    """The rows of several parts one after the other, by column name; repeated rows stay."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_gain(examples: DataFrame) -> DataFrame:
    return examples.withColumn("gain", labels.gain(F.col("esci_label")))


def product_texts(products: DataFrame, to_text=text.html_to_text) -> DataFrame:
    """One template text per product, made before the join so that no product is parsed twice."""
    body = to_text(F.col("product_description"))
    return products.select(*JOIN_KEYS, text.title_and_text(F.col("product_title"), body).alias("text"))


def pretrain_pairs(
    examples: DataFrame, products: DataFrame, seed: int, to_text=text.html_to_text, prepare=None, distinct: bool = False
) -> DataFrame:
    """(query, positive, title): one bullet line against the description without markup.

    Kept are products with a description that did carry markup, judged exact.
    ``prepare`` is work on the products' texts, done once for a product, before it
    meets its queries; with ``distinct`` a product that a query has several times
    is one pair.
    """
    described = products.where(
        F.col("product_description").isNotNull() & F.col("product_bullet_point").isNotNull()
    ).select(
        *JOIN_KEYS,
        F.col("product_title").alias("title"),
        F.col("product_description").alias("_raw"),
        text.lines(F.col("product_bullet_point")).alias("_lines"),
    )
    described = once(described, "positive", to_text(F.col("_raw")))
    usable = described.where((F.col("positive") != F.col("_raw")) & (F.col("positive") != "")).drop("_raw")
    if prepare:
        usable = prepare(usable)
    exact = with_gain(examples).where(F.col("gain") == 1)
    if distinct:
        exact = exact.select(*JOIN_KEYS, "query_id").distinct()
    pick = keyed_index(F.size("_lines"), seed, F.col("query_id"), F.col("product_id"))
    return (
        exact.join(usable, JOIN_KEYS)
        .withColumn("query", F.element_at("_lines", pick + 1))
        .where(F.col("query") != "")
        .drop("_lines")
    )


def enough_tokens(column: Column, at_least: int = 2) -> Column:
    return F.size(text.ws_tokens(column)) >= at_least


def code_pairs(lines: DataFrame, prefer: str = "code_tokens") -> DataFrame:
    """(docstring, code) texts from token lists under either field name."""
    return lines.withColumn("docstring", text.joined_tokens(F.col("docstring_tokens"))).withColumn(
        "code_text", text.joined_tokens(text.first_present(prefer))
    )


def variant_counts() -> dict[str, Column]:
    """How many rows came in, and from which token field, as aggregates for a write to fill."""
    return {
        "n_rows": F.count(F.lit(1)),
        "n_code_tokens": F.count_if(F.col("code_tokens").isNotNull()),
        "n_function_tokens": F.count_if(F.col("code_tokens").isNull() & F.col("function_tokens").isNotNull()),
    }


def test_queries(examples: DataFrame) -> DataFrame:
    """Query side of a test corpus, one row per example."""
    return examples.select(F.col("query_id").alias("id"), "query")


def test_documents(examples: DataFrame, texts: DataFrame, once: bool = False) -> DataFrame:
    """Document side, aligned with the queries; ``once`` keeps one row per product."""
    keys = examples.select(*JOIN_KEYS)
    if once:
        keys = keys.distinct()
    # A product that is not in the table still has its row, with an empty text.
    return keys.join(texts, JOIN_KEYS, "left").select(
        F.col("product_id").alias("id"),
        F.coalesce("text", text.title_and_text(F.lit(""), F.lit(None))).alias("product"),
    )
