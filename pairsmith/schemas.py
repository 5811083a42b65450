"""Schemas of the files and tables that the jobs read and write."""

from pyspark.sql import types as T

_tokens = T.ArrayType(T.StringType())
_ids = T.ArrayType(T.IntegerType())
_candidate = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("gain", T.DoubleType()),
    T.StructField("product_id", T.LongType()),
])

# Either code_tokens or function_tokens is present in a line.
CODE_LINES = T.StructType([
    T.StructField("code_tokens", _tokens),
    T.StructField("function_tokens", _tokens),
    T.StructField("docstring_tokens", _tokens),
    T.StructField("code", T.StringType()),
    T.StructField("url", T.StringType()),
])

PRETRAIN_DEV = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("positive", T.StringType()),
    T.StructField("title", T.StringType()),
])

FINETUNE_DEV = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("query_id", T.LongType()),
    T.StructField("products", _tokens),
    T.StructField("positive", T.ArrayType(_candidate)),
    T.StructField("negative", T.ArrayType(_candidate)),
])

TRAIN_RECORDS = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("query", _ids),
    T.StructField("positives", T.ArrayType(_ids)),
    T.StructField("labels", _ids),
    T.StructField("negatives", T.ArrayType(_ids)),
])

EMBEDDINGS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

METRICS = T.StructType([
    T.StructField("value", T.DoubleType()),
    T.StructField("name", T.StringType()),
    T.StructField("step", T.LongType()),
])

RUN_COLUMNS = ("query_id", "Q0", "passage_id", "rank", "score", "tool")
