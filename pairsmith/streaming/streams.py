"""The row-wise jobs on streams of files.

Both are stateless, so a stream gives the rows that the batch gives, and a
restart goes on from the checkpoint.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T

from pairsmith.operators import groups, pairs, vocabulary
from pairsmith.plans import code


def json_line_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 1000) -> DataFrame:
    """The files of a folder as they come, up to ``files`` in a micro-batch."""
    return spark.readStream.schema(schema).option("mode", "FAILFAST").option("maxFilesPerTrigger", files).json(path)


def run_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataFrame:
    """Process the files present now into parquet, and read the result."""
    transformed = transform(stream)
    query = (
        transformed.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(transformed.schema).parquet(out)


def sampled_records(epoch: int, seed: int | None, n_passages: int, key: str = "key", **options):
    """Per-record sampling as a function for ``run_available`` or ``DataFrame.transform``."""
    return lambda records: groups.sample_record(records, epoch, seed, n_passages, key=key, **options)


def built_code_pairs(prefer: str = "code_tokens"):
    return lambda lines: pairs.code_pairs(lines, prefer)


def coded_tokens(words: DataFrame, seed: int = code.SEED):
    """The whole code builder on a stream of lines: entities, masks and the ids of the three texts.

    The vocabulary is a static table of any size, which every micro-batch joins
    anew. Restoring a row's order takes an aggregation, which a stateless stream
    leaves to its reader: the stream writes a row for each token, and
    ``code_records`` puts the records together.
    """

    def built(lines: DataFrame) -> DataFrame:
        tokens = code.pretrain_tokens(code.masked(lines, seed))
        return vocabulary.token_ids(tokens, ["url"], code.TOKEN_LENGTHS, words)

    return built


def code_records(token_rows: DataFrame) -> DataFrame:
    """The pre-training records of the rows that a ``coded_tokens`` stream has written so far."""
    return code.records_of(vocabulary.assembled(token_rows, ["url"], code.TOKEN_LENGTHS))
