"""The stored index against a full scan, the loss against a whole matrix, measures and heads."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsmith.operators import encode, index, retrieval
from pairsmith.plans import evaluation
from pairsmith.session import scratch


def clustered(spark, n=600, width=8, seed=1):
    rng = np.random.default_rng(seed)
    centers = 5 * rng.standard_normal((12, width))
    rows = [(i, (centers[i % 12] + 0.3 * rng.standard_normal(width)).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(5)]  # ties
    return spark.createDataFrame(rows, "doc_id long, vector array<double>")


@pytest.mark.parametrize("block_bytes", [32 << 20, 2_000])
def test_the_index_finds_what_a_scan_finds_and_reads_less(spark, block_bytes):
    documents, path, read = clustered(spark), scratch(spark, "index"), []
    index.build(documents, path, centers=12)
    queries = documents.where("doc_id % 12 < 2 and doc_id < 240 or doc_id = 601").withColumnRenamed("doc_id", "query_id")
    found = index.search(path, queries, 7, block_bytes=block_bytes, read=read)
    wanted = retrieval.top_k(queries, documents, 7)
    listed = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    assert listed(found) == listed(wanted) and (block_bytes > 2_000 or len(read) > 1)
    assert all(first + second < total for total, first, second in read), read


@pytest.mark.parametrize("k", [1, 40, 700])
def test_the_index_is_exact_with_any_centers(spark, k):
    rng = np.random.default_rng(k)
    rows = [(f"d{i}", rng.standard_normal(5).tolist() if i else [0.0] * 5) for i in range(120)] + [("none", None)]
    documents, path = spark.createDataFrame(rows, "doc_id string, vector array<double>"), scratch(spark, "index")
    index.build(documents, path, centers=9, rounds=1)
    queries = documents.where("vector is not null").limit(30).withColumnRenamed("doc_id", "query_id")
    listed = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    assert listed(index.search(path, queries, k)) == listed(retrieval.top_k(queries, documents.where("vector is not null"), k))


def test_empty_sides_of_the_index(spark):
    none, path = spark.createDataFrame([], "doc_id long, vector array<double>"), scratch(spark, "index")
    index.build(none, path)
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")
    assert index.search(path, queries, 3).count() == 0
    path = scratch(spark, "index")
    index.build(none.union(spark.createDataFrame([(1, [1.0])], none.schema)), path)
    assert index.search(path, queries.limit(0), 3).count() == 0 and index.search(path, queries, 3).count() == 1


def slow_loss(queries, passages, step):
    total = 0.0
    for i, q in enumerate(queries):
        scores = [sum(a * b for a, b in zip(q, p)) for p in passages]
        top = max(scores)
        total += top + math.log(sum(math.exp(s - top) for s in scores)) - scores[i * step]
    return total / len(queries)


@pytest.mark.parametrize("cell_rows", [1, 3, 2_048])
def test_the_loss_is_the_same_in_cells_of_any_size(spark, cell_rows):
    rng = random.Random(7)
    vector = lambda: [rng.uniform(-30, 30) for _ in range(4)]
    batches = {b: ([vector() for _ in range(n)], [vector() for _ in range(2 * n)]) for b, n in ((0, 1), (1, 4), (2, 7))}
    rows = [(b, s, 10 * i, v) for b, sides in batches.items() for s, side in zip("qp", sides) for i, v in enumerate(side)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "batch_id long, side string, position long, vector array<double>")
    found = {r["batch_id"]: (r["n"], r["loss"]) for r in retrieval.contrastive_loss(frame, 2, cell_rows).collect()}
    assert found == {b: (len(q), pytest.approx(slow_loss(q, p, 2), abs=1e-9)) for b, (q, p) in batches.items()}


def test_a_query_without_its_passage_is_an_error(spark):
    frame = spark.createDataFrame([(0, "q", 0, [1.0]), (0, "q", 1, [1.0]), (0, "p", 0, [1.0])], "batch_id long, side string, position long, vector array<double>")
    with pytest.raises(Exception, match="without its passage"):
        retrieval.contrastive_loss(frame, 1).collect()


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_measures_of_one_pass_equal_brute_force(spark, limit):
    rng = random.Random(3)
    rows = [(step, i, [float(rng.randrange(-4, 5)) for _ in range(3)], rng.randrange(3)) for step in (1, 2) for i in range(60)]
    side = lambda r, name: spark.createDataFrame(r, f"step long, {name} long, vector array<double>, label int")
    docs = [(s, i, [x + 1 for x in v], rng.randrange(3)) for s, i, v, _ in rows]
    found = evaluation.measures_by_step(side(rows, "query_id"), side(docs, "doc_id"), cut_ndcg=10, cut_mrr=5, max_broadcast_bytes=limit, cell_bytes=2_000).collect()
    wanted = {}
    for step in (1, 2):
        pair, ndcg, mrr = [], [], []
        own = [d for d in docs if d[0] == step]
        for _, i, v, label in (r for r in rows if r[0] == step):
            score = {d[1]: sum(a * b for a, b in zip(v, d[2])) for d in own}
            order = sorted(own, key=lambda d: (-score[d[1]], d[1]))
            hits = [d[3] == label for d in order]
            pair.append(1 / (1 + sum(score[j] >= score[i] for j in score if j != i)))
            mrr.append(next((1 / (r + 1) for r, h in enumerate(hits[:5]) if h), 0.0))
            ideal = sum(1 / math.log2(r + 2) for r in range(min(10, sum(hits))))
            ndcg.append(sum(1 / math.log2(r + 2) for r, h in enumerate(hits[:10]) if h) / ideal if ideal else 0.0)
        for name, values in (("pair_mrr", pair), ("ndcg_10", ndcg), ("mrr_5", mrr)):
            wanted[step, name] = (len(values), pytest.approx(sum(values) / len(values)))
    assert {(r["step"], r["metric"]): (r["n_queries"], r["value"]) for r in found} == wanted


def test_hashed_words_equal_a_count_without_a_shuffle(spark):
    import hashlib

    rows = [(1, "b a B a"), (2, ""), (3, None), (4, "x-1 ! x-1")]
    frame = spark.createDataFrame(rows, "id long, text string")
    encoded = encode.hashed_words(frame, "id", "text", 8)
    assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()
    found = {r["id"]: r["vector"] for r in encoded.collect()}
    for id_, words in ((1, ["b", "a", "b", "a"]), (2, []), (3, []), (4, ["x-1", "!", "x-1"])):
        counts = np.zeros(8)
        for w in words:
            counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8] += 1
        assert found[id_] == pytest.approx((counts / (np.linalg.norm(counts) or 1)).tolist())


def test_a_head_multiplies_blocks_and_keeps_nulls(spark):
    rng = np.random.default_rng(0)
    head, vectors = rng.standard_normal((5, 3)), rng.standard_normal((40, 3))
    weights = spark.createDataFrame([(i, w.tolist()) for i, w in reversed(list(enumerate(head)))], "row long, weights array<double>")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, None)], "id long, vector array<double>")
    found = {r["id"]: r["vector"] for r in encode.linear_head(rows, weights).collect()}
    assert found[99] is None and all(found[i] == pytest.approx((head @ v).tolist()) for i, v in enumerate(vectors))
    with pytest.raises(Exception, match="another length"):
        encode.linear_head(rows.withColumn("vector", F.array(F.lit(1.0))), weights).collect()
    with pytest.raises(ValueError, match="more than"):
        encode.linear_head(rows, weights, max_bytes=10)
