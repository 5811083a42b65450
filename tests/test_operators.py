import random

import pytest
from pyspark.sql import Row, functions as F

from pairsmith.functions import text
from pairsmith.operators import entities, metrics, order, retrieval, trec


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "markup, wanted",
    [
        ("a &rsquo; b &#8217; &#x27;", "a ’ b ’ '"),
        ("&amp;lt; &nosuch; & &", "&lt; &nosuch; & &"),
        ("<p>x</p><script>1</script>&copy;", "x©"),
        ("&#x1F600;&#0;", "😀�"),
        ("", ""),
    ],
)
def test_character_references_are_decoded_once(spark, markup, wanted):
    assert one(spark, text.html_to_text(F.col("m")), m=markup) == wanted


def test_a_missing_title_keeps_the_body(spark):
    assert one(spark, text.title_and_text(F.lit(None).cast("string"), F.col("b")), b="body") == "title :  text : body"


@pytest.mark.parametrize(
    "language, source, wanted",
    [
        ("php", "<?php $a = b(1e5); /* c */ ?>", ["a", "b"]),
        ("java", "x = 10L + 0x1F + 1e5; // y", ["x"]),
        ("python", "a = f\"hi\" + r'b' + B # c", ["a", "B"]),
        ("go", "func f() { s := `raw` }", ["f", "s"]),
    ],
)
def test_names_only(spark, language, source, wanted):
    assert one(spark, entities.identifiers(F.col("s"), F.lit(language)), s=source) == wanted


@pytest.mark.parametrize("language", ["python", "php", "java", "go", "ruby", "javascript"])
def test_long_comments_and_strings(spark, language):
    long = "x\\\\" * 200_000
    comment = f"# {long}\n" if language in ("python", "ruby") else f"/* {'* ' * 300_000} */"
    assert one(spark, entities.identifiers(F.col("s"), F.lit(language)), s=f'{comment} name "{long}"') == ["name"]


def test_an_unknown_language_is_an_error(spark):
    with pytest.raises(Exception, match="no rules for language rust"):
        one(spark, entities.identifiers(F.col("s"), F.lit("rust")), s="fn f")


def test_half_of_the_occurrences(spark):
    names = ["a"] * 6 + ["b", "c"]
    found = one(spark, entities.select_half(F.col("n"), F.lit("k"), 1), n=names)
    counted = {x: names.count(x) for x in found}
    assert len(found) == sum(counted.values()) >= 4 and min(counted.values()) > 0


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_top_k_with_text_ids_on_both_paths(spark, limit):
    rows = spark.createDataFrame([(f"v{i}", [float(i % 7), float(i % 3), 1.0]) for i in range(40)], "id string, vector array<double>")
    queries, documents = rows.where("id < 'v2'").withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "doc_id")
    found = retrieval.top_k(queries, documents, 5, max_broadcast_bytes=limit, cell_bytes=400).collect()
    vectors = {r["id"]: r["vector"] for r in rows.collect()}
    for q in {r["query_id"] for r in found}:
        best = sorted(vectors, key=lambda d: (-sum(a * b for a, b in zip(vectors[q], vectors[d])), d))[:5]
        assert [r["doc_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == best


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_pair_ranks_on_both_paths(spark, limit):
    rows = spark.createDataFrame([(i, [float((i * 5) % 11), 1.0]) for i in range(20)], "id long, vector array<double>")
    queries, documents = rows.withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "doc_id")
    found = {r["query_id"]: r["rank"] for r in retrieval.pair_ranks(queries, documents, max_broadcast_bytes=limit, cell_bytes=200).collect()}
    vectors = {r["id"]: r["vector"] for r in rows.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(vectors[a], vectors[b]))
    assert found == {q: 1 + sum(dot(q, d) >= dot(q, q) for d in vectors if d != q) for q in vectors}


def test_a_missing_score_ranks_last(spark):
    rows = spark.createDataFrame([(1, 10, None, 0), (1, 11, 0.5, 1)], "query_id long, product_id long, score double, pos int")
    assert {r["product_id"]: r["rank"] for r in trec.run_table(rows).collect()} == {11: 0, 10: 1}


def test_ndcg_with_text_ids(spark):
    run = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 1.0)], "query_id string, doc_id string, score double")
    judged = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.0)], "query_id string, doc_id string, weight double")
    assert metrics.ndcg_per_query(run, judged).first()["ndcg"] == pytest.approx(1 / 1.584962500721156)


def test_vectors_of_different_lengths_are_an_error(spark):
    left = spark.createDataFrame([(1, [1.0])], "k long, vector array<double>")
    right = spark.createDataFrame([(1, [1.0, 2.0])], "k long, vector array<double>")
    with pytest.raises(Exception, match="different lengths"):
        retrieval.score_aligned(left, right, "k").collect()


@pytest.mark.parametrize("groups, splits", [(3, 4), (3, 1), (90, 2)])
def test_numbers_in_groups_that_are_cut(spark, groups, splits):
    """Groups of up to 60 rows in buckets of about 5, below and above the number of groups that are broadcast."""
    rows = [(g if g else None, (i * 37) % (20 + g % 41), i) for g in range(groups) for i in range(20 + g % 41)]
    frame = spark.createDataFrame(rows, "g long, o long, i long")
    found = order.group_row_number(frame, ["g"], [F.col("o"), F.col("i")], "n", max_rows=5, splits=splits, size="size")
    wanted = {}
    for g, o, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        wanted[g, i] = sum(1 for k in wanted if k[0] == g) + 1
    counts = {g: sum(1 for k in wanted if k[0] == g) for g, _, _ in rows}
    assert {(r["g"], r["i"]): (r["n"], r["size"]) for r in found.collect()} == {k: (n, counts[k[0]]) for k, n in wanted.items()}
    runs = order.number_runs(frame.withColumn("v", F.col("o") % 3 == 0), ["g"], [F.col("o"), F.col("i")], "v", max_rows=5, splits=splits)
    plain = order.number_runs(frame.withColumn("v", F.col("o") % 3 == 0), ["g"], [F.col("o"), F.col("i")], "v")
    assert sorted(map(tuple, runs.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_a_task_holds_the_state_of_a_bounded_number_of_queries(spark):
    class Watched(retrieval.TopK):
        def start(self, queries):
            assert queries.num_rows <= 60, f"{queries.num_rows} queries with {self.k} documents each in one task"
            super().start(queries)

    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(300)]
    queries, documents = (spark.createDataFrame(rows, f"{name} long, vector array<double>") for name in ("query_id", "doc_id"))
    found = retrieval.fold_scores(queries, documents, Watched(100), max_broadcast_bytes=100_000, cell_bytes=50_000).collect()
    assert len(found) == 300 * 100
    best = sorted((-sum(a * b for a, b in zip(rows[7][1], v)), i) for i, v in rows)[:100]
    assert sorted((-r["score"], r["doc_id"]) for r in found if r["query_id"] == 7) == best


def test_lists_of_measures_end_with_the_first_hit():
    import pyarrow as pa

    fold = retrieval.Measures(5, 2)
    fold.start(pa.table({"query_id": [1, 2, 3], "vector": [[1.0]] * 3, "label": [7, 8, None], "own_score": [0.5, 9.0, 9.0]}))
    for ids in ([10, 11, 12], [13, 14, 15]):
        fold.add(pa.table({"doc_id": ids, "vector": [[20.0 - i] for i in ids], "label": [{12: 7, 10: 8}.get(i) for i in ids]}))
    found = fold.finish().to_pylist()
    assert [[r["doc_id"] for r in found if r["query_id"] == q and r["doc_id"]] for q in (1, 2, 3)] == [[10, 11, 12], [10, 11], [10, 11, 12, 13, 14]]
    assert [(r["n_better"], r["n_relevant"]) for r in found if r["doc_id"] is None] == [(6, 1), (2, 1), (2, 0)]
