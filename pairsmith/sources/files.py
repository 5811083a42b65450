"""Files read and written by the jobs."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from pairsmith import schemas
from pairsmith.functions.text import ws_tokens

CHECKPOINT_FOLDER = r"/(checkpoint-[0-9]+)/[^/]+$"


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = schemas.CODE_LINES) -> DataFrame:
    """One object per line; a line that is not one is an error, not a null row."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """An array of objects, on one line or (``multi_line``) spread over many."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multi_line).json(path)


def read_codebase_map(spark: SparkSession, path: str, separator: str = ", ") -> DataFrame:
    """Files that hold one ``{code: index}`` object each, as rows of tokens, index and empty texts.

    The object may be of any size: its entries, not lines, are the records that
    Spark splits the file by. An entry ends where ``separator`` is followed by a
    quote, which no text within quotes can hold unescaped. The one exception is
    a code that itself ends in the separator; it is an error, as is anything
    else that is not an entry. Of a repeated code every entry is a row.
    """
    entries = spark.read.text(path, lineSep=separator + '"')
    # The last entry of a file has the closing brace, the first the opening brace and quote, unless it is a code of one brace.
    ended = F.regexp_replace("value", r"\}\s*$", "")
    begun = F.regexp_replace(ended, r'^\s*\{\s*"', "")
    entry = r'(?s)^.*"\s*:\s*-?[0-9]+\s*$'
    bare = F.when(begun.rlike(entry), begun).when(ended.rlike(entry), ended)
    wrong = F.raise_error(F.concat(F.lit("not an entry of a codebase map: "), F.substring("value", 1, 80)))
    whole = F.coalesce(F.concat(F.lit('{"'), bare, F.lit("}")), wrong)
    objects = F.from_json("_object", T.MapType(T.StringType(), T.LongType()), {"mode": "FAILFAST"})
    parsed = entries.where(~F.col("value").rlike(r"^\s*(\{\s*\})?\s*$")).select(whole.alias("_object"))
    listed = parsed.select(F.explode(objects).alias("code", "retrieval_idx"))
    return listed.select(
        ws_tokens(F.col("code")).alias("code_tokens"), "retrieval_idx", F.lit("").alias("doc"), F.array().cast("array<string>").alias("docstring_tokens")
    )


def write_codebase_map(df: DataFrame, path: str) -> None:
    """(code, retrieval_idx) rows as ``{code: index}`` objects, one for each partition of ``df``."""
    quoted = F.to_json(F.array("code"))
    entry = F.concat(F.expr("substring(_q, 2, length(_q) - 2)"), F.lit(": "), F.col("retrieval_idx").cast("string"))
    entries = df.select("code", "retrieval_idx", quoted.alias("_q")).select(entry.alias("value"))

    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "{"
        for batch in batches:
            if batch.num_rows:
                text = before + ", ".join(batch.column(0).to_pylist())
                before = ", "
                yield pa.RecordBatch.from_arrays([pa.array([text])], names=["value"])
        if before != "{":
            yield pa.RecordBatch.from_arrays([pa.array(["}"])], names=["value"])

    # Rows follow each other with a blank, so a partition's rows are one object, batch by batch.
    entries.mapInArrow(objects, "value string").write.text(path, lineSep=" ")


def read_run_file(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated run lines: longer lines are skipped, shorter ones end in nulls."""
    fields = F.split("value", " ")
    kept = spark.read.text(path).where((F.trim("value") != "") & (F.size(fields) <= len(schemas.RUN_COLUMNS)))
    named = [F.get(fields, i).alias(name) for i, name in enumerate(schemas.RUN_COLUMNS)]
    return kept.select(*named).withColumns(
        {"rank": F.expr("try_cast(rank as bigint)"), "score": F.expr("try_cast(score as double)")}
    )


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Vectors with text ids; the ids become numbers, so that they sort as such."""
    return spark.read.schema(schemas.EMBEDDINGS).parquet(path).select(F.col("id").cast("bigint").alias("id"), "embedding")


def list_checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """(checkpoint, step, n_files) of the ``checkpoint-<step>`` folders below ``root``; folders of other names are left out.

    Spark lists the files; none is opened.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    folder = F.regexp_extract("path", CHECKPOINT_FOLDER, 1)
    listed = found.where(folder != "").groupBy(folder.alias("checkpoint")).agg(F.count(F.lit(1)).alias("n_files"))
    return listed.select("checkpoint", F.regexp_extract("checkpoint", "([0-9]+)$", 1).cast("bigint").alias("step"), "n_files")


def read_checkpoints(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows of all ``checkpoint-<step>`` folders below ``root``, with their step."""
    rows = spark.read.schema(schema).parquet(f"{root.rstrip('/')}/checkpoint-[0-9]*")
    folder = F.regexp_extract(F.col("_metadata.file_path"), CHECKPOINT_FOLDER, 1)
    return rows.withColumn("step", F.regexp_extract(folder, "([0-9]+)$", 1).cast("bigint"))


def write_checkpoints(df: DataFrame, root: str, steps: list[int]) -> None:
    """The rows of each step in a folder of its own."""
    for step in steps:
        df.where(F.col("step") == step).drop("step").write.parquet(f"{root.rstrip('/')}/checkpoint-{step}")


def write_json_lines(df: DataFrame, path: str, counts: dict[str, Column] | None = None) -> dict:
    """One object per row; the ``counts`` (aggregates by name) are filled by the write itself, without a second pass."""
    seen = Observation()
    observed = df.observe(seen, *(c.alias(name) for name, c in counts.items())) if counts else df
    observed.write.option("ignoreNullFields", True).json(path)
    return seen.get if counts else {}


def write_json_arrays(df: DataFrame, path: str, key: list[str], rows: int = 10_000) -> None:
    """Arrays of about ``rows`` objects, one on each line; the rows of an array share a hash of the key."""
    arrays = max(1, -(-df.count() // rows))
    bucket = F.pmod(F.xxhash64(*key), F.lit(arrays)).alias("_array")
    listed = df.groupBy(bucket).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    listed.select("value").write.text(path)


def write_hypothesis(scored: DataFrame, path: str) -> None:
    """query_id,product_id by query and score, both descending."""
    scored.orderBy(F.desc("query_id"), F.desc("score"), "product_id").select("query_id", "product_id").write.option(
        "header", True
    ).csv(path)


def write_spaced(df: DataFrame, path: str) -> None:
    """Run and judgement files: space-separated, without a header."""
    df.write.csv(path, sep=" ", header=False)


def log_metrics(df: DataFrame, path: str) -> None:
    """(name, step, value) points; those of the same name and step are replaced, so a rerun adds no second point."""
    points = df.select("value", "name", "step")
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name", "step").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METRICS).parquet(path)
