"""Code data from token lists to training records and test files."""

from pyspark.sql import DataFrame, functions as F

from pairsmith.functions import text
from pairsmith.functions.keyed import once
from pairsmith.operators import entities, masking, pairs, vocabulary

# Token budgets.
PRETRAIN_LENGTHS = {"query": 60, "positive": 240, "label": 60}
TOKEN_LENGTHS = PRETRAIN_LENGTHS
FINETUNE_LENGTHS = {"query": 50, "positive": 256}
SEED = 42


def code_lines(rows: DataFrame) -> DataFrame:
    """Rows of docstring and code texts in the shape of the code files."""
    return rows.select(
        text.ws_tokens(F.col("code_text")).alias("code_tokens"),
        text.ws_tokens(F.col("function_text")).alias("function_tokens"),
        text.ws_tokens(F.col("docstring")).alias("docstring_tokens"),
        F.coalesce("code_text", "function_text").alias("code"),
        "url",
        "language",
    )


def with_identifiers(lines: DataFrame) -> DataFrame:
    """Identifiers of each row: from the joined tokens for Python, from the raw code for the others."""
    source = F.when(F.col("language") == "python", text.joined_tokens(text.first_present())).otherwise(
        text.php_source(F.col("code"), F.col("language"))
    )
    return once(lines, "identifiers", entities.identifiers(source, F.col("language")))


def masked(lines: DataFrame, seed: int = SEED) -> DataFrame:
    """``lines`` with ``masked`` and ``label``; rows without any chosen identifier are left out."""
    named = with_identifiers(lines).where(F.size("identifiers") > 0)
    chosen = entities.chosen_identifiers(F.col("identifiers"), F.col("language"), F.col("url"), seed)
    staged = once(named, "_chosen", chosen).where(F.size("_chosen") > 0)
    staged = once(staged, "_map", masking.sentinel_map(F.col("_chosen")))  # not anew for each token
    return (
        staged.withColumn("masked", masking.mask(text.first_present(), F.col("_map")))
        .withColumn("label", masking.recovery_label(F.col("_chosen")))
        .drop("_chosen", "_map")
    )


def pretrain_tokens(masked_lines: DataFrame) -> DataFrame:
    """(url, query, positive, label): the token lists that become ids."""
    return masked_lines.select(
        "url",
        text.word_tokens(text.joined_tokens(F.col("docstring_tokens"))).alias("query"),
        text.masked_tokens(F.col("masked")).alias("positive"),
        text.masked_tokens(F.col("label")).alias("label"),
    )


def records_of(encoded: DataFrame) -> DataFrame:
    """Records of (url, query, positive, label) as ids; a list without tokens is empty."""
    lists = [F.coalesce(c, F.array().cast("array<int>")) for c in ("query", "positive", "label")]
    return encoded.select("url", F.col("url").alias("key"), *vocabulary.pretrain_record(*lists))


def pretrain_records(masked_lines: DataFrame, words: DataFrame, **sizes) -> DataFrame:
    """``words``: a stored vocabulary of any size; ``url`` tells the lines apart."""
    return records_of(vocabulary.encode_columns(pretrain_tokens(masked_lines), ["url"], TOKEN_LENGTHS, words, **sizes))


def finetune_records(lines: DataFrame, words: DataFrame, **sizes) -> DataFrame:
    """(docstring, code) as ids, without negatives."""
    texts = pairs.code_pairs(lines)
    tokens = texts.select("url", text.word_tokens(F.col("docstring")).alias("query"), text.word_tokens(F.col("code_text")).alias("positive"))
    encoded = vocabulary.encode_columns(tokens, ["url"], FINETUNE_LENGTHS, words, **sizes)
    none = F.array().cast("array<array<int>>")
    return encoded.select("url", F.col("url").alias("key"), "query", F.array("positive").alias("positives"), none.alias("negatives"))


def test_queries(lines: DataFrame) -> DataFrame:
    return pairs.code_pairs(lines).select(F.col("url").alias("id"), F.col("docstring").alias("query"))


def test_documents(lines: DataFrame) -> DataFrame:
    return pairs.code_pairs(lines).select(F.col("url").alias("id"), F.col("code_text").alias("code"))
