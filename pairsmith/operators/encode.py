"""Text to vectors."""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pairsmith.functions import text

# Bytes of a matrix that every executor may hold.
MAX_HEAD_BYTES = 256 << 20


def encode_texts(
    texts: DataFrame,
    make_encoder: Callable[[], Callable[[list[str]], list]],
    id_column: str,
    text_column: str,
    batch_size: int = 256,
) -> DataFrame:
    """(id, vector) by a model of the caller's; ``make_encoder`` runs once per task."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for frame in batches:
            encoder = encoder or make_encoder()
            for start in range(0, len(frame), batch_size):
                rows = frame.iloc[start : start + batch_size]
                yield pd.DataFrame({id_column: rows[id_column], "vector": list(encoder(rows[text_column].tolist()))})

    id_type = texts.schema[id_column].dataType.simpleString()
    return texts.select(id_column, text_column).mapInPandas(encode, f"{id_column} {id_type}, vector array<double>")


def hashed_words(texts: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """(id, vector): counts of lower-cased words by hash bucket, to unit length; a text without words has a zero vector.

    A text is one row's own business: the distinct words of a batch are hashed
    once and counted without a shuffle. A NULL text is like an empty one.
    """
    words = F.coalesce(text.word_tokens(F.lower(text_column)), F.array().cast("array<string>"))

    @F.arrow_udf("array<double>")
    def counted(batch: pa.Array) -> pa.Array:
        sizes = np.asarray(pc.list_value_length(batch))
        coded = batch.flatten().dictionary_encode()
        bucket = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % width for w in coded.dictionary.to_pylist()], np.int64)
        cells = np.repeat(np.arange(len(batch)), sizes) * width + bucket[np.asarray(coded.indices)]
        counts = np.bincount(cells, minlength=len(batch) * width).reshape(-1, width).astype(np.float64)
        lengths = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = counts / np.where(lengths > 0, lengths, 1.0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * width, pa.int32()), pa.array(unit.ravel()))

    return texts.select(id_column, counted(words).alias("vector"))


def linear_head(vectors: DataFrame, weights: DataFrame, max_bytes: int = MAX_HEAD_BYTES) -> DataFrame:
    """``vectors`` with ``vector`` times the transposed weights: one output per row of the matrix.

    ``weights``: row (from 0) and weights (array). The matrix goes to each
    executor once; its bytes are checked. NULL vectors stay NULL, and vectors of
    another length than the rows are an error.
    """
    n, width = weights.agg(F.count(F.lit(1)), F.max(F.size("weights"))).first()
    if n * (width or 0) * 8 > max_bytes:
        raise ValueError(f"a head of {n} x {width} weights, more than {max_bytes} bytes")
    rows = weights.orderBy("row").select("weights").collect()
    matrix = vectors.sparkSession.sparkContext.broadcast(np.array([r["weights"] for r in rows], np.float64).reshape(n, -1))

    @F.arrow_udf("array<double>")
    def multiplied(batch: pa.Array) -> pa.Array:
        head, there = matrix.value, np.asarray(batch.is_valid())
        sizes = np.asarray(pc.list_value_length(batch.drop_null()))
        if (sizes != head.shape[1]).any():
            raise ValueError(f"a vector of another length than the {head.shape[1]} weights of a row")
        out = np.asarray(batch.drop_null().flatten(), np.float64).reshape(-1, head.shape[1]) @ head.T
        ends = np.concatenate([[0], np.cumsum(there)]) * len(head)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out.ravel()), mask=batch.is_null())

    return vectors.withColumn("vector", multiplied(F.col("vector")))
