"""A training-data pipeline over ``documents``: each stage calls one operator and sees all that its predecessor kept."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairsmith.llm import decontaminate, language_id, minhash_dedup, mixing, pii, shared

#: Documents whose best cosine with a language profile is lower are in none of the languages; unrelated vectors have about this.
LEAST_COSINE = 0.03
#: The key of the surrogates; a real corpus has its own.
KEY = b"corpus pipeline"


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns under names that no operator uses, and these names."""
    copies = {c: f"pipeline_{i}_{c}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(copy) for c, copy in copies.items())), copies


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that labelled documents have.

    A null or empty text, or one without letters, is in none and goes; a null
    ``lang`` teaches nothing. Whole texts of any length are judged. Repeated rows
    are judged alike; an empty table stays empty. Columns keep their values,
    whatever their names are.
    """
    model = language_id.fit(docs, "doc_id", "text", "lang")
    apart, copies = _apart(docs)
    found = language_id.identify(apart, model, copies["text"])
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_COSINE))
    return kept.select(*(F.col(copy).alias(c) for c, copy in copies.items()))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more; the smallest id stays.

    Null and wordless texts are near nothing and stay, as do rows with a null id;
    of repeated rows one stays. An empty table stays empty. Columns keep their
    values, whatever their names are.
    """
    return minhash_dedup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item.

    Null and wordless texts hold none and stay; whole texts of any length are
    searched. Repeated rows are judged alike, repeated items count once; an empty
    table or benchmark changes nothing. Columns keep their values, whatever their
    names are.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    apart, copies = _apart(docs)
    found = decontaminate.decontaminate(apart, benchmark, copies["text"])
    return found.where(~F.col("contaminated")).select(*(F.col(copy).alias(c) for c, copy in copies.items()))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data in their texts.

    Null and empty texts stay, null and repeated ids are allowed, and equal rows
    stay equal; an empty table stays empty. All other columns keep their values,
    whatever their names are.
    """
    apart, copies = _apart(docs)
    found = pii.pseudonymize(apart, KEY, copies["doc_id"], copies["text"])
    return found.select(*(F.col(copy).alias(c) for c, copy in copies.items()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document, with size, source_size, target and the copy's number.

    Columns of these four names are replaced, all others keep their values. Null
    texts have size 0 and null sources are one source; equal ranks go by id;
    repeated rows are mixed one by one. An empty table stays empty.
    """
    own = ["size", "source_size", "target", "copy"]
    apart, copies = _apart(docs.drop(*own))
    sized = apart.withColumn("size", mixing.n_words(F.col(copies["text"])))
    mixed = mixing.mix(sized, copies["doc_id"], copies["source"]).where("copies > 0")
    numbered = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return numbered.select(*(F.col(copy).alias(c) for c, copy in copies.items()), *own)


STAGES = [
    ("language ID", keep_known_languages),
    ("near duplicates", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("personal data", replace_personal_data),
    ("source mix", mix_sources),
]

#: SQL cannot express the trained language profiles and the keyed surrogates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.written(docs, f"stage-{k}")
    return docs
