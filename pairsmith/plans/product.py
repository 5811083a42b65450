"""Product data from tables to training records."""

from pyspark.sql import DataFrame, functions as F

from pairsmith.functions import text
from pairsmith.functions.keyed import once
from pairsmith.operators import groups, masking, pairs, split, vocabulary
from pairsmith.operators.entities import PROPER_NOUN, description_entities, title_entities

# Token budgets and shares of the dev sets.
PRETRAIN_LENGTHS = {"query": 50, "positive": 240, "label": 60}
FINETUNE_LENGTHS = {"query": 20, "passage": 256}
PRETRAIN_DEV_SHARE = 0.05
FINETUNE_DEV_SHARE = 0.125
SPLIT_SEED = 10
SEED = 42


def pretrain_examples(examples: DataFrame, locale: str = "us") -> DataFrame:
    return pairs.select_examples(examples, locale, large=1)


def finetune_examples(examples: DataFrame, locale: str = "us") -> DataFrame:
    return pairs.select_examples(examples, locale, small=1, split="train")


def pretrain_part(examples: DataFrame, products: DataFrame, part: str, seed: int = SEED, locale: str = "us", **options) -> DataFrame:
    """Pairs of the 'train' or 'dev' queries; the dev part stays raw text. ``options`` are those of ``pretrain_pairs``."""
    wanted = pretrain_examples(examples, locale)
    ids = split.split_ids(wanted, "query_id", PRETRAIN_DEV_SHARE, SPLIT_SEED)
    products = products.where(F.col("product_locale") == locale)
    return pairs.pretrain_pairs(split.rows_of(wanted, ids, "query_id", part), products, seed, **options)


def masked(texts: DataFrame, title: str, body: str) -> DataFrame:
    """``texts`` with ``masked`` and ``label``; bodies of fewer than two tokens are left out."""
    staged = once(texts.where(pairs.enough_tokens(F.col(body))), "_tokens", text.word_tokens(F.col(body)))
    staged = once(staged, "_title", title_entities(F.col(title)))
    staged = once(staged, "_entities", description_entities(F.col("_tokens"), F.col("_title")))
    staged = once(staged, "_map", masking.sentinel_map(F.col("_entities")))

    def may_be_entity(t):
        return t.rlike(PROPER_NOUN) | F.array_contains("_title", F.lower(t))

    return (
        staged.withColumn("masked", masking.mask(F.col("_tokens"), F.col("_map"), may_be_entity))
        .withColumn("label", masking.recovery_label(F.col("_entities")))
        .drop("_tokens", "_title", "_entities", "_map")
    )


def pretrain_records(masked_pairs: DataFrame, words: DataFrame, **sizes) -> DataFrame:
    """``words``: a stored vocabulary of any size. (query_id, product_id) tells the pairs apart."""
    key = F.concat_ws(":", F.col("query_id").cast("string"), F.col("product_id").cast("string")).alias("key")
    tokens = masked_pairs.select(
        "query_id",
        "product_id",
        key,
        text.word_tokens(F.col("query")).alias("query"),
        text.masked_tokens(F.col("masked")).alias("positive"),
        text.masked_tokens(F.col("label")).alias("label"),
    )
    kept = vocabulary.drop_empty(vocabulary.encode_columns(tokens, ["key"], PRETRAIN_LENGTHS, words, **sizes))
    record = vocabulary.pretrain_record(F.col("query"), F.col("positive"), F.col("label"))
    return kept.select("query_id", "product_id", "key", *record)


def finetune_items(examples: DataFrame, texts: DataFrame) -> DataFrame:
    """Judged rows with the text of their product; ``texts`` has one row per product."""
    judged = pairs.with_gain(examples).select(*pairs.JOIN_KEYS, "query_id", "query", "gain", "pos")
    empty = text.title_and_text(F.lit(""), F.lit(None))
    joined = judged.join(texts, pairs.JOIN_KEYS, "left")
    if dict(texts.dtypes)["text"] == "string":
        joined = joined.withColumn("text", F.coalesce("text", empty))
    return joined.drop("product_locale")


def finetune_groups(examples: DataFrame, products: DataFrame) -> DataFrame:
    return groups.query_groups(finetune_items(examples, pairs.product_texts(products)))


def finetune_part(examples: DataFrame, products: DataFrame, part: str) -> DataFrame:
    """Groups of the 'train' or 'dev' queries of the fine-tuning examples."""
    wanted = finetune_examples(examples)
    ids = split.split_ids(wanted, "query_id", FINETUNE_DEV_SHARE, SPLIT_SEED)
    return finetune_groups(split.rows_of(wanted, ids, "query_id", part), products)


def finetune_records(examples: DataFrame, products: DataFrame, words: vocabulary.Vocabulary) -> DataFrame:
    """Groups of ids. Each product is encoded once, before it meets its queries."""
    tokens = text.word_tokens(F.col("text"))
    texts = pairs.product_texts(products).withColumn("text", words.encode(tokens, FINETUNE_LENGTHS["passage"]))
    items = finetune_items(examples, texts)
    unmatched = words.encode(text.word_tokens(text.title_and_text(F.lit(""), F.lit(None))), FINETUNE_LENGTHS["passage"])
    items = items.withColumn("text", F.coalesce("text", unmatched))
    return groups.as_records(groups.query_groups(items)).withColumn(
        "query", words.encode(text.word_tokens(F.col("query")), FINETUNE_LENGTHS["query"])
    )
