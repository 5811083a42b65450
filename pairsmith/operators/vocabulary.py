"""Vocabulary, encoding to ids and back."""

from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairsmith.functions import arrays
from pairsmith.operators.masking import SENTINELS
from pairsmith.operators.order import attach
from pairsmith.session import scratch

# Ids below this are padding, unknown and the sentinels.
FIRST_WORD_ID = 2 + SENTINELS
# Bytes of words that the executors may hold; a larger vocabulary is joined, never cut.
MAX_BYTES = 64 << 20
# Tokens that a join of a larger vocabulary broadcasts, and their bytes at most.
FREQUENT = 10_000
SHORT = 64


def build_vocabulary(tokens: DataFrame, size: int, column: str = "tokens") -> DataFrame:
    """(token, n, id) of the most frequent tokens; ties by token.

    Counting is distributed; the ranking sees only the ``size`` kept tokens.
    """
    counts = tokens.select(F.explode(column).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    return top.withColumn("id", (rank - 1 + FIRST_WORD_ID).cast("int"))


def reserved_tokens() -> list[str]:
    return ["<pad>", "<unk>"] + [f"<extra_id_{i}>" for i in range(SENTINELS)]


def stored(table: DataFrame) -> DataFrame:
    """A built vocabulary as a table, so that the words of the corpus are counted once, however often it is read."""
    path = scratch(table.sparkSession, "vocabulary")
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def table_bytes(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.sum(F.octet_length("token") + 8), F.lit(0))).first()[0]


class _Known:
    """Tokens by id; their index is built when a worker first looks one up, and kept for its later batches."""

    def __init__(self, tokens: pa.Array):
        self.tokens = tokens

    def __getstate__(self):
        return {"tokens": self.tokens}

    @cached_property
    def index(self) -> dict[str, int]:
        return {token: i for i, token in enumerate(self.tokens.to_pylist())}

    def ids(self, flat: pa.Array) -> pa.Array:
        """Each distinct token of a batch is looked up once."""
        distinct = flat.dictionary_encode()
        found = pa.array([self.index.get(t, arrays.UNKNOWN_ID) for t in distinct.dictionary.to_pylist()], pa.int32())
        return pc.fill_null(found.take(distinct.indices), arrays.UNKNOWN_ID)


class Vocabulary:
    """A built vocabulary on the executors; its bytes are checked before it is broadcast."""

    def __init__(self, table: DataFrame, max_bytes: int = MAX_BYTES):
        size = table_bytes(table)
        if size > max_bytes:
            raise ValueError(f"a vocabulary of {size} bytes, more than {max_bytes}: use encode_columns")
        rows = table.select("token", "id").collect()
        words = [r.token for r in sorted(rows, key=lambda r: r.id)]
        self._tokens = table.sparkSession.sparkContext.broadcast(_Known(pa.array(reserved_tokens() + words, pa.string())))

    def encode(self, tokens: Column, max_length: int) -> Column:
        """The first ``max_length`` ids; a token that is not in the vocabulary becomes the unknown id."""
        known = self._tokens

        @F.arrow_udf("array<int>")
        def lookup(batch: pa.Array) -> pa.Array:
            return _lists(batch, known.value.ids)

        return lookup(F.slice(tokens, 1, max_length))

    def decode(self, ids: Column) -> Column:
        known = self._tokens

        @F.arrow_udf("array<string>")
        def lookup(batch: pa.Array) -> pa.Array:
            return _lists(batch, lambda flat: known.value.tokens.take(flat))

        return lookup(ids)


def _lists(batch: pa.ListArray, translate) -> pa.ListArray:
    """The same lists with translated items; NULL lists stay NULL."""
    lengths = pc.fill_null(pc.list_value_length(batch), 0)
    ends = pc.cumulative_sum(lengths).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, translate(batch.flatten()), mask=batch.is_null())


def encode_columns(rows: DataFrame, key: list[str], lengths: dict[str, int], table: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``rows`` with the token lists of the columns in ``lengths`` as their first ids, with a vocabulary of any size.

    Up to ``max_bytes`` the vocabulary is broadcast. A larger one is joined: see
    ``token_ids``. There ``key`` tells the rows apart, and a repeated key is an
    error; NULL lists stay NULL and unknown or NULL tokens get the unknown id.
    """
    if table_bytes(table) <= max_bytes:
        words = Vocabulary(table, max_bytes)
        return rows.withColumns({name: words.encode(F.col(name), length) for name, length in lengths.items()})
    ids = assembled(token_ids(rows, key, lengths, table), key, lengths)
    renamed = ids.withColumnsRenamed({name: f"_ids_{name}" for name in lengths})
    empty = F.array().cast("array<int>")
    whole = {name: F.when(F.col(name).isNotNull(), F.coalesce(F.col(f"_ids_{name}"), empty)) for name in lengths}
    return attach(rows, renamed, key).withColumns(whole).select(*rows.columns)


def token_ids(rows: DataFrame, key: list[str], lengths: dict[str, int], table: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(key…, column, place, id): a row for each of the first tokens of each list, without an aggregation, so that a stream can make it.

    The most frequent tokens, which would all meet in a few tasks, take their ids
    from a broadcast: ``frequent`` tokens of up to ``SHORT`` bytes, so of a proven
    size. The others are shuffled by token to the rest of the vocabulary; none of
    them is more frequent in the corpus that the vocabulary was built from.
    """
    lists = F.explode(F.array(*(F.struct(F.lit(name).alias("column"), F.slice(F.col(name).cast("array<string>"), 1, n).alias("tokens")) for name, n in lengths.items())))
    cells = rows.select(*key, lists.alias("_list")).select(*key, F.col("_list.column").alias("column"), F.posexplode("_list.tokens").alias("place", "token"))
    hot = (F.col("id") < FIRST_WORD_ID + frequent) & (F.octet_length("token") <= SHORT)
    reserved = rows.sparkSession.createDataFrame(list(enumerate(reserved_tokens())), "id int, token string").select("token", "id")
    known = table.select("token", "id").union(reserved)
    near = known.where(hot).withColumnRenamed("token", "_near")
    far = known.where(~hot).withColumnsRenamed({"token": "_far", "id": "_far_id"})
    tried = cells.join(F.broadcast(near), F.col("token") == F.col("_near"), "left")
    found = tried.where(F.col("_near").isNotNull()).select(*key, "column", "place", "id")
    left = tried.where(F.col("_near").isNull()).join(far.hint("merge"), F.col("token") == F.col("_far"), "left")
    return found.union(left.select(*key, "column", "place", F.coalesce("_far_id", F.lit(arrays.UNKNOWN_ID)).alias("id")))


def assembled(ids: DataFrame, key: list[str], names) -> DataFrame:
    """(key…, a list of ids for each name) from ``token_ids``, in the order of the places; a list without tokens is NULL."""

    def ordered(name: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when(F.col("column") == name, F.struct("place", "id"))))
        repeated = F.size(listed) > F.coalesce(F.max(F.when(F.col("column") == name, F.col("place"))) + 1, F.lit(0))
        whole = F.when(F.size(listed) > 0, F.transform(listed, lambda x: x["id"]))
        return F.when(repeated, F.raise_error(F.lit(f"repeated key of rows with {name}"))).otherwise(whole).alias(name)

    return ids.groupBy(*key).agg(*(ordered(name) for name in names))


def drop_empty(encoded: DataFrame, query: str = "query", positive: str = "positive") -> DataFrame:
    return encoded.where((F.size(query) > 0) & (F.size(positive) > 0))


def pretrain_record(query: Column, positive: Column, label: Column) -> list[Column]:
    none = F.array().cast("array<array<int>>")
    return [
        query.alias("query"),
        F.array(positive).alias("positives"),
        label.alias("labels"),
        none.alias("negatives"),
    ]


def collate(rows: DataFrame, lengths: dict[str, int], batch: str = "batch_id", position: str = "position") -> DataFrame:
    """One row per training batch: padded queries, passages and labels with masks, in the order of ``position``.

    ``rows``: query (ids), passages (lists of ids) and labels (ids); ``lengths``
    has the padded lengths of query, passage and label. The passages of all rows
    follow each other in one list. Padding in labels is ignored by the loss. A
    batch without any labels gets the single label 0; labels for some of its
    rows only are an error. A batch has the size of a training batch, so it is
    one row.
    """
    item = F.struct(position, "query", "passages", "labels")
    batches = rows.groupBy(batch).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    queries = F.transform("_rows", lambda r: r["query"])
    passages = F.flatten(F.transform("_rows", lambda r: r["passages"]))
    labels = F.transform("_rows", lambda r: arrays.ignore_padding(arrays.pad(r["labels"], lengths["label"])))
    missing = F.size(F.filter("_rows", lambda r: r["labels"].isNull()))
    none = F.array(F.array(F.lit(0)))
    wrong = F.raise_error(F.lit("labels of some rows of a batch only"))

    def padded(ids: Column, name: str) -> list[Column]:
        length = lengths[name]
        return [
            F.transform(ids, lambda x: arrays.pad(x, length)).alias(f"{name}_ids"),
            F.transform(ids, lambda x: arrays.attention_mask(x, length)).alias(f"{name}_mask"),
        ]

    return batches.select(
        batch,
        F.size("_rows").alias("n_rows"),
        *padded(queries, "query"),
        *padded(passages, "passage"),
        F.when(missing == 0, labels).when(missing == F.size("_rows"), none).otherwise(wrong).alias("labels"),
    )


def pad_batch(ids: Column, length: int) -> list[Column]:
    return [arrays.pad(ids, length).alias("input_ids"), arrays.attention_mask(ids, length).alias("attention_mask")]
