"""Scores of queries against documents: aligned, per candidate, and all against all in blocks.

All-against-all work never makes a row per pair. A fold keeps, per query, only
what the result needs (the best k, a count), while documents pass by in matrix
blocks. Queries of a checked size are broadcast and documents stay where they
are; beyond that size queries are dealt out to blocks of bounded size, and a
task streams all documents past a block.
"""

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pairsmith.functions import arrays
from pairsmith.operators.order import group_row_number

# Bytes of the queries, with what a fold holds for them, that each task may have.
MAX_BROADCAST_BYTES = 32 << 20
CELL_BYTES = 64 << 20
# Bytes of a table of vectors that every executor may hold.
MAX_TABLE_BYTES = 256 << 20
# Rows of a batch that a task gives out.
OUTPUT_ROWS = 1 << 16
# Queries and passages of a cell of a batch's score matrix.
CELL_ROWS = 2_048
# Scores are compared after rounding: equal vectors tie, whatever the block shapes.
SCORE_DIGITS = 9
# Elements of one score matrix in memory.
_SLICE = 4 << 20


def _type(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def id_types(queries: DataFrame, documents: DataFrame) -> tuple[str, str, pa.DataType]:
    """The types of the ids that a fold gives out."""
    return _type(queries, "query_id"), _type(documents, "doc_id"), to_arrow_type(documents.schema["doc_id"].dataType)


def _vector_of(rows: DataFrame, at: str, vectors: DataFrame, name: str) -> DataFrame:
    """``rows`` with the vector that ``at`` points to."""
    return rows.join(vectors.select(F.col("vec_id").alias(at), F.col("vector").alias(name)), at).drop(at)


def score_aligned(queries: DataFrame, documents: DataFrame, key: str, vectors: DataFrame | None = None, max_bytes: int = MAX_TABLE_BYTES) -> DataFrame:
    """Dot product of the two rows with the same key.

    With ``vectors`` (vec_id, vector) both sides have the ``vec_id`` of their
    vector in its place. The rows are aligned without vectors, which then come
    from a broadcast of up to ``max_bytes``; a larger table is joined.
    """
    if vectors is None:
        aligned = queries.withColumnRenamed("vector", "_q").join(documents.withColumnRenamed("vector", "_d"), key)
    else:
        size = vectors.agg(F.coalesce(F.sum(4 * F.coalesce(F.size("vector"), F.lit(0)) + 64), F.lit(0))).first()[0]
        known = F.broadcast(vectors) if size <= max_bytes else vectors
        aligned = queries.withColumnRenamed("vec_id", "_at_q").join(documents.withColumnRenamed("vec_id", "_at_d"), key)
        aligned = _vector_of(_vector_of(aligned, "_at_q", known, "_q"), "_at_d", known, "_d")
    return aligned.withColumn(
        "score", F.round(arrays.dot(F.col("_q"), F.col("_d")), SCORE_DIGITS)
    ).drop("_q", "_d")


def score_candidates(candidates: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Score of each listed (query_id, doc_id)."""
    q = queries.select("query_id", F.col("vector").alias("_q"))
    d = documents.select("doc_id", F.col("vector").alias("_d"))
    scored = candidates.join(q, "query_id").join(d, "doc_id")
    return scored.withColumn("score", F.round(arrays.dot(F.col("_q"), F.col("_d")), SCORE_DIGITS)).drop("_q", "_d")


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _score_slices(queries: np.ndarray, documents: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    step = max(1, _SLICE // max(1, len(documents)))
    for start in range(0, len(queries), step):
        rows = slice(start, start + step)
        yield rows, np.round(queries[rows] @ documents.T, SCORE_DIGITS)


class TopK:
    """The k best documents per query: score descending, then id ascending. Ids are of any type that sorts.

    The state is a score and a place of ``k`` documents for each query. Of a
    block of scores only those that reach a query's k-th best are looked at.
    """

    def __init__(self, k: int, query_type: str = "bigint", document_type: str = "bigint", kind: pa.DataType = pa.int64()):
        self.k, self.kind = k, kind
        self.schema = f"query_id {query_type}, doc_id {document_type}, score double"
        self.state_bytes = 16 * k

    def start(self, queries: pa.Table) -> None:
        self.ids = _column(queries, "query_id")
        self.queries = _matrix(_column(queries, "vector"))
        self.names = pa.array([], self.kind)
        self.scores, self.docs = np.empty((len(self.ids), 0)), np.empty((len(self.ids), 0), np.int64)
        self.sizes = np.zeros(len(self.ids), np.int64)

    def add(self, documents: pa.Table) -> None:
        before = len(self.names)
        self.names = pa.concat_arrays([self.names, _column(documents, "doc_id").cast(self.kind)])
        rank = np.asarray(pc.rank(self.names, tiebreaker="first")).astype(np.int64)
        width = min(self.k, len(self.names))
        if width > self.scores.shape[1]:
            more = ((0, 0), (0, width - self.scores.shape[1]))
            self.scores, self.docs = np.pad(self.scores, more), np.pad(self.docs, more)
        for rows, new in _score_slices(self.queries, _matrix(_column(documents, "vector"))):
            self.seen(rows, new, documents)
            for query, row in zip(range(len(self.ids))[rows], new):
                self._merge(query, row, before, rank)

    def _merge(self, query: int, row: np.ndarray, before: int, rank: np.ndarray) -> None:
        """The best of a query's list and a row of scores, whose documents have places from ``before`` on."""
        size = self.sizes[query]
        at = np.arange(len(row)) if size < self.k else np.flatnonzero(~(row < self.scores[query, self.k - 1]))
        if len(at) > self.k:
            reached = row[at] >= np.partition(row[at], len(at) - self.k)[len(at) - self.k]
            at = at[reached] if reached.sum() >= self.k else at  # fewer only where scores are no numbers
        if not len(at):
            return
        scores = np.concatenate([self.scores[query, :size], row[at]])
        docs = np.concatenate([self.docs[query, :size], at + before])
        best = np.lexsort((rank[docs], -scores))[: self.k]
        self.sizes[query] = size = len(best)
        self.scores[query, :size], self.docs[query, :size] = scores[best], docs[best]

    def seen(self, rows: slice, scores: np.ndarray, documents: pa.Table) -> None:
        """What a fold with further measures takes from a block of scores; nothing here."""

    def finish(self) -> pa.Table:
        there = np.arange(self.scores.shape[1]) < self.sizes[:, None]
        return pa.table(
            {
                "query_id": self.ids.take(pa.array(np.repeat(np.arange(len(self.ids)), self.sizes))),
                "doc_id": self.names.take(pa.array(self.docs[there])),
                "score": self.scores[there],
            }
        )


class Measures(TopK):
    """The best documents per query, and from the same scores two counts for each query.

    A list ends with its first relevant document, but has ``shown`` documents at
    least and ``k`` at most: what comes later changes neither the place of the
    first hit nor the first ``shown`` places. ``n_better``: documents other than
    its own that score at least as high as its own; ``n_relevant``: documents
    with the query's label. The counts come as rows without a document.
    """

    def __init__(self, k: int, shown: int, *types):
        super().__init__(k, *types)
        self.shown = shown
        self.schema += ", n_better bigint, n_relevant bigint"

    def start(self, queries: pa.Table) -> None:
        super().start(queries)
        self.query_names = np.array(self.ids.to_pylist())
        self.own = np.asarray(_column(queries, "own_score"), dtype=np.float64)
        labels = _column(queries, "label")
        self.known = pc.unique(labels).drop_null()
        self.label = self._coded(labels, -2)
        self.better, self.relevant = np.zeros((2, len(self.ids)), np.int64)
        self.found = np.empty(0, np.int64)

    def _coded(self, labels: pa.Array, unknown: int) -> np.ndarray:
        return np.asarray(pc.fill_null(pc.index_in(labels, self.known), unknown)).astype(np.int64)

    def add(self, documents: pa.Table) -> None:
        labels = self._coded(_column(documents, "label"), -1)
        counts = np.append(np.bincount(labels[labels >= 0], minlength=len(self.known)), 0)
        self.relevant += counts[np.maximum(self.label, -1)]
        self.found = np.concatenate([self.found, labels])
        self.block_names = np.array(_column(documents, "doc_id").to_pylist())
        super().add(documents)

    def seen(self, rows: slice, scores: np.ndarray, documents: pa.Table) -> None:
        self.better[rows] += ((scores >= self.own[rows, None]) & (self.block_names[None, :] != self.query_names[rows, None])).sum(axis=1)

    def finish(self) -> pa.Table:
        if self.scores.shape[1]:
            there = np.arange(self.scores.shape[1]) < self.sizes[:, None]
            hits = there & (self.found[self.docs] == self.label[:, None])
            last = np.where(hits.any(axis=1), np.maximum(self.shown, hits.argmax(axis=1) + 1), self.k)
            self.sizes = np.minimum(self.sizes, last)
        top = super().finish()
        none = pa.nulls(top.num_rows, pa.int64())
        top = top.append_column("n_better", none).append_column("n_relevant", none)
        counts = {"query_id": self.ids, "doc_id": pa.nulls(len(self.ids), top.schema.field("doc_id").type), "score": pa.nulls(len(self.ids), pa.float64())}
        return pa.concat_tables([top, pa.table(counts | {"n_better": self.better, "n_relevant": self.relevant}, schema=top.schema)])


class AtLeastAsGood:
    """Per query, the number of documents other than its own that score at least as high as its own."""

    state_bytes = 32

    def __init__(self, query_type: str = "bigint"):
        self.schema = f"query_id {query_type}, n_better bigint"

    def start(self, queries: pa.Table) -> None:
        self.names = _column(queries, "query_id")
        self.ids = np.array(self.names.to_pylist())
        self.own = np.asarray(_column(queries, "own_score"))
        self.queries = _matrix(_column(queries, "vector"))
        self.counts = np.zeros(len(self.ids), dtype=np.int64)

    def add(self, documents: pa.Table) -> None:
        ids = np.array(_column(documents, "doc_id").to_pylist())
        for rows, scores in _score_slices(self.queries, _matrix(_column(documents, "vector"))):
            beaten = (scores >= self.own[rows, None]) & (ids[None, :] != self.ids[rows, None])
            self.counts[rows] += beaten.sum(axis=1)

    def finish(self) -> pa.Table:
        return pa.table({"query_id": self.names, "n_better": self.counts})


class Summary:
    """Per query over all documents: how many, the best score, and the sum of the scores."""

    state_bytes = 32

    def __init__(self, query_type: str = "bigint"):
        self.schema = f"query_id {query_type}, n_scored bigint, best_score double, score_sum double"

    def start(self, queries: pa.Table) -> None:
        self.ids = _column(queries, "query_id")
        self.queries = _matrix(_column(queries, "vector"))
        self.count = np.zeros(len(self.ids), dtype=np.int64)
        self.best = np.full(len(self.ids), -np.inf)
        self.total = np.zeros(len(self.ids))

    def add(self, documents: pa.Table) -> None:
        for rows, scores in _score_slices(self.queries, _matrix(_column(documents, "vector"))):
            self.count[rows] += scores.shape[1]
            self.best[rows] = np.maximum(self.best[rows], scores.max(axis=1))
            self.total[rows] += scores.sum(axis=1)

    def finish(self) -> pa.Table:
        return pa.table(
            {"query_id": self.ids, "n_scored": self.count, "best_score": self.best, "score_sum": self.total}
        )


class PerGroup:
    """A fold for each value of a column that both sides have, such as the checkpoint of the vectors."""

    def __init__(self, column: str, make_fold):
        self.column, self.make_fold = column, make_fold
        self.schema = f"{column} bigint, {make_fold().schema}"
        self.state_bytes = make_fold().state_bytes

    def _parts(self, table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
        for value in pc.unique(_column(table, self.column)).to_pylist():
            yield value, table.filter(pc.equal(table.column(self.column), value))

    def start(self, queries: pa.Table) -> None:
        self.folds = {}
        for value, part in self._parts(queries):
            self.folds[value] = self.make_fold()
            self.folds[value].start(part)

    def add(self, documents: pa.Table) -> None:
        for value, part in self._parts(documents):
            if value in self.folds:
                self.folds[value].add(part)

    def finish(self) -> pa.Table:
        done = [(value, fold.finish()) for value, fold in self.folds.items()]
        return pa.concat_tables(
            [part.add_column(0, self.column, pa.array([value] * part.num_rows, pa.int64())) for value, part in done]
        )


def fold_scores(
    queries: DataFrame,
    documents: DataFrame,
    fold,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """Partial results of ``fold`` over all query–document pairs; a query has one row set per block.

    ``queries``: query_id, vector and what the fold needs; ``documents``: doc_id, vector; ids unique.
    """
    n_queries, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    row_bytes = 8 * (width + 4) + fold.state_bytes
    if n_queries * row_bytes <= max_broadcast_bytes:
        rows = queries.toArrow()
        shared = queries.sparkSession.sparkContext.broadcast(rows)

        def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            started = False
            for batch in batches:
                if not started:
                    fold.start(shared.value)
                    started = True
                if batch.num_rows:
                    fold.add(pa.Table.from_batches([batch]))
            if started:
                yield from fold.finish().to_batches(OUTPUT_ROWS)

        return documents.mapInArrow(pass_by, fold.schema)

    # Blocks of queries with their state are of bounded size, and all documents stream past each.
    by = [fold.column] if isinstance(fold, PerGroup) else []
    sizes = queries.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    groups, most = sizes.agg(F.count(F.lit(1)), F.max("_n")).first()
    blocks = math.ceil(most / max(1, cell_bytes // row_bytes))
    cell = [*by, "_block"]
    q = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("_side", F.lit(0))
    d = documents.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_side", F.lit(1))
    dealt = q.unionByName(d, allowMissingColumns=True).repartition(2 * groups * blocks, *cell).sortWithinPartitions(*cell, "_side")

    def pass_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, started = None, [], False

        def finished() -> Iterator[pa.RecordBatch]:
            if waiting:
                if not started:
                    fold.start(pa.concat_tables(waiting))
                yield from fold.finish().to_batches(OUTPUT_ROWS)

        for batch in batches:
            table, place = pa.Table.from_batches([batch]), 0
            for (key, side), run in itertools.groupby(zip(zip(*(table.column(c).to_pylist() for c in cell)), table.column("_side").to_pylist())):
                part = table.slice(place, len(list(run)))
                place += part.num_rows
                if key != current:
                    yield from finished()
                    current, waiting, started = key, [], False
                if side == 0:
                    waiting.append(part)
                elif waiting:
                    if not started:
                        fold.start(pa.concat_tables(waiting))
                        started = True
                    fold.add(part)
        yield from finished()

    return dealt.mapInArrow(pass_blocks, fold.schema)


def top_k(queries: DataFrame, documents: DataFrame, k: int, **sizes) -> DataFrame:
    """(query_id, doc_id, score, rank): the k nearest documents of each query, rank from 1."""
    fold = TopK(k, *id_types(queries, documents))
    partial = fold_scores(queries.select("query_id", "vector"), documents.select("doc_id", "vector"), fold, **sizes)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def score_summary(queries: DataFrame, documents: DataFrame, **sizes) -> DataFrame:
    """One row per query over its whole row of the score matrix."""
    documents = documents.select("doc_id", "vector")
    partial = fold_scores(queries.select("query_id", "vector"), documents, Summary(_type(queries, "query_id")), **sizes)
    return partial.groupBy("query_id").agg(
        F.sum("n_scored").alias("n_scored"), F.max("best_score").alias("best_score"), F.sum("score_sum").alias("score_sum")
    )


def pair_ranks(queries: DataFrame, documents: DataFrame, by: str | None = None, **sizes) -> DataFrame:
    """Rank of each query's own document (same id); documents with an equal score count as better.

    With ``by`` the ranks are separate for each value of that column.
    """
    keys = [by] if by else []
    q = queries.select(*keys, "query_id", "vector")
    d = documents.select(*keys, "doc_id", "vector")
    own = q.join(d.select(*keys, F.col("doc_id").alias("query_id"), F.col("vector").alias("_d")), keys + ["query_id"])
    score = F.round(arrays.dot(F.col("vector"), F.col("_d")), SCORE_DIGITS)
    known = own.withColumn("own_score", score).drop("_d")
    kind = _type(queries, "query_id")
    fold = PerGroup(by, lambda: AtLeastAsGood(kind)) if by else AtLeastAsGood(kind)
    return fold_scores(known, d, fold, **sizes).groupBy(*keys, "query_id").agg((1 + F.sum("n_better")).alias("rank"))


def contrastive_loss(vectors: DataFrame, passages_per_query: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(batch_id, n, loss): mean cross entropy of each batch; the target of row i is its own first passage.

    ``vectors``: batch_id, side ('q' or 'p'), position in the batch, vector. A
    batch may have any size: its score matrix is dealt out to cells of
    ``cell_rows`` queries and passages. A cell gives each of its queries the
    maximum of its scores and the sum of their exponentials below that maximum;
    such pairs merge in any order to the logarithm of the whole row's sum. A
    query without its passage is an error.
    """
    keys = ["batch_id", "side"]
    placed = group_row_number(vectors.select(*keys, "position", "vector"), keys, [F.col("position")], "_number")
    placed = placed.withColumn("place", F.col("_number") - 1).withColumn("block", F.floor(F.col("place") / cell_rows))
    blocks = placed.groupBy("batch_id").agg(
        *(F.max(F.when(F.col("side") == side, F.col("block"))).alias(f"last_{side}") for side in "qp")
    )
    placed = placed.join(blocks, "batch_id")

    def dealt(side: str, other: str, own: str, all_of: str) -> DataFrame:
        rows = placed.where(F.col("side") == side).where(F.col(f"last_{other}").isNotNull())
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"last_{other}")))
        fresh = (F.col(c).alias(c) for c in ("batch_id", "place", "vector"))  # both sides come from one table
        return rows.select(*fresh, F.col("block").alias(own), copies.alias(all_of))

    def cell(queries: pa.Table, passages: pa.Table) -> pa.Table:
        scores = _matrix(_column(queries, "vector")) @ _matrix(_column(passages, "vector")).T
        top = scores.max(axis=1)
        total = np.exp(scores - top[:, None]).sum(axis=1)
        return pa.table({"batch_id": _column(queries, "batch_id"), "place": _column(queries, "place"), "top": top, "total": total})

    q, p = dealt("q", "p", "i", "j"), dealt("p", "q", "j", "i")
    cells = q.groupBy("batch_id", "i", "j").cogroup(p.groupBy("batch_id", "i", "j"))
    kind = _type(vectors, "batch_id")
    parts = cells.applyInArrow(cell, f"batch_id {kind}, place bigint, top double, total double")

    def merged(a, b):
        top = F.greatest(a["top"], b["top"])
        total = a["total"] * F.exp(a["top"] - top) + b["total"] * F.exp(b["top"] - top)
        return F.struct(top.alias("top"), total.alias("total"))

    listed = F.collect_list(F.struct("top", "total"))  # one pair a block of passages
    rows = parts.groupBy("batch_id", "place").agg(listed.alias("pairs"))
    whole = F.aggregate(F.slice("pairs", F.lit(2), F.size("pairs")), F.element_at("pairs", 1), merged)
    rows = rows.select("batch_id", "place", whole.alias("sum"))

    targets = placed.where(F.col("side") == "q").select("batch_id", "place", (F.col("place") * passages_per_query).alias("_target"), F.col("vector").alias("_q"))
    passages = placed.where(F.col("side") == "p").select("batch_id", F.col("place").alias("_target"), F.col("vector").alias("_p"))
    own = targets.join(passages, ["batch_id", "_target"], "left").join(rows, ["batch_id", "place"], "left")
    missing = F.raise_error(F.lit("a query without its passage")).cast("double")
    loss = F.col("sum.top") + F.log("sum.total") - arrays.dot(F.col("_q"), F.col("_p"))
    losses = own.select("batch_id", F.when(F.col("_p").isNull(), missing).otherwise(loss).alias("loss"))
    return losses.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"))
