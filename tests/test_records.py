"""Token ids by join, training batches, the stream of the code builder, checkpoints and metric logs."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF
from pairsmith.functions import arrays
from pairsmith.operators import groups, pairs, vocabulary
from pairsmith.plans import code, registry, registry_records, tables
from pairsmith.session import scratch
from pairsmith.sources import files
from pairsmith.streaming import streams


@pytest.fixture(scope="module")
def words(spark):
    rows = [("the", 900), ("of", 800), ("x" * 100, 700), ("rare", 5), ("once", 1)]
    rows = [(t, n, vocabulary.FIRST_WORD_ID + i) for i, (t, n) in enumerate(rows)]
    return vocabulary.stored(spark.createDataFrame(rows, "token string, n long, id int"))


def token_rows(spark):
    rng = random.Random(4)
    pool = ["the"] * 30 + ["of", "x" * 100, "rare", "once", "unknown", "<extra_id_3>", None]
    rows = [(i, [rng.choice(pool) for _ in range(rng.choice([0, 1, 7, 30]))], ["of", "rare"]) for i in range(60)]
    return spark.createDataFrame(rows + [(100, None, []), (None, ["of"], None)], "key long, a array<string>, b array<string>")


@pytest.mark.parametrize("frequent", [0, 2, 10_000])
def test_ids_by_join_equal_ids_by_broadcast(spark, words, frequent, monkeypatch):
    rows, lengths = token_rows(spark), {"a": 20, "b": 1}
    known = {r["token"]: r["id"] for r in words.collect()} | {t: i for i, t in enumerate(vocabulary.reserved_tokens())}
    wanted = {r["key"]: tuple(None if r[c] is None else [known.get(t, arrays.UNKNOWN_ID) for t in r[c][:n]] for c, n in lengths.items()) for r in rows.collect()}
    listed = lambda df: {r["key"]: (r["a"], r["b"]) for r in df.collect()}
    assert listed(vocabulary.encode_columns(rows, ["key"], lengths, words)) == wanted
    monkeypatch.setattr(vocabulary.token_ids, "__defaults__", (frequent,))
    joined = vocabulary.encode_columns(rows, ["key"], lengths, words, max_bytes=0)
    assert listed(joined) == wanted and joined.columns == rows.columns


def test_a_repeated_key_is_an_error_in_the_join(spark, words):
    rows = spark.createDataFrame([(1, ["the", "of"]), (1, ["the", "of"])], "key long, a array<string>")
    with pytest.raises(Exception, match="repeated key"):
        vocabulary.encode_columns(rows, ["key"], {"a": 5}, words, max_bytes=0).collect()


def test_a_vocabulary_is_counted_once(spark):
    plan = registry_records.encode_large(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def batch_rows(spark, labels):
    rows = [(b, p, [p + 1] * (p + 1), [[b + 5, 7], [8]], labels(b, p)) for b in range(2) for p in range(3)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "batch_id long, position long, query array<int>, passages array<array<int>>, labels array<int>")


def test_a_batch_is_one_row_in_order(spark):
    found = {r["batch_id"]: r for r in vocabulary.collate(batch_rows(spark, lambda b, p: [9, 0, p] if b else None), {"query": 2, "passage": 3, "label": 4}).collect()}
    for b in (0, 1):
        assert found[b]["n_rows"] == 3
        assert found[b]["query_ids"] == [[1, 0], [2, 2], [3, 3]] and found[b]["query_mask"] == [[True, False], [True, True], [True, True]]
        assert found[b]["passage_ids"] == [[b + 5, 7, 0], [8, 0, 0]] * 3 and found[b]["passage_mask"][1] == [True, False, False]
    assert found[0]["labels"] == [[0]] and found[1]["labels"] == [[9, -100, -100, -100], [9, -100, 1, -100], [9, -100, 2, -100]]


def test_labels_of_some_rows_only_are_an_error(spark):
    with pytest.raises(Exception, match="labels of some rows"):
        vocabulary.collate(batch_rows(spark, lambda b, p: [1] if p else None), {"query": 2, "passage": 3, "label": 4}).collect()


def test_sampled_records_are_cut(spark):
    records = spark.createDataFrame([("k", [1, 2, 3], [[1, 2, 3, 4]], [[5, 6, 7]], None)], "key string, query array<int>, positives array<array<int>>, negatives array<array<int>>, labels array<int>")
    found = groups.sample_record(records, 0, None, 2, lengths={"query": 2, "passages": 3, "labels": 1}).first()
    assert (found["query"], found["passages"], found["labels"]) == ([1, 2], [[1, 2, 3], [5, 6, 7]], None)


@pytest.mark.parametrize("negatives, wanted", [(["a", "b"], ["p", "a", "b", "a"]), (["a", "b", "c", "d"], ["p", "a", "b", "c"])])
def test_too_few_negatives_are_repeated_in_order(spark, negatives, wanted):
    records = spark.createDataFrame([("k", "q", ["p"], negatives)], "key string, query string, positives array<string>, negatives array<string>")
    assert groups.sample_record(records, 0, None, 4).first()["passages"] == wanted


def test_the_stream_stops_between_two_batches_and_goes_on(spark):
    lines = registry._code(spark, SF)
    words = vocabulary.stored(registry._vocabulary(spark, SF))
    path, out = scratch(spark, "lines"), scratch(spark, "stream")
    files.write_json_lines(lines.repartition(4, "url"), path)
    build = streams.coded_tokens(words)
    first = build(streams.json_line_stream(spark, path, lines.schema, files=1)).writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint")
    running = first.trigger(processingTime="1 hour").start(f"{out}/rows")  # a second batch would come in an hour
    try:
        while not (running.lastProgress and running.lastProgress["batchId"] == 0 and running.lastProgress["numInputRows"]):
            assert running.awaitTermination(1) is False
    finally:
        running.stop()
    some = spark.read.parquet(f"{out}/rows").select("url").distinct().count()
    rows = streams.run_available(streams.json_line_stream(spark, path, lines.schema, files=1), build, f"{out}/rows", f"{out}/checkpoint")
    batch = sorted(registry_records.code_records(spark, SF).collect())
    assert sorted(registry_records._record_lists(streams.code_records(rows)).collect()) == batch and 0 < some < len(batch)


def test_stream_of_code_equals_the_batch(spark):
    assert sorted(registry_records.stream_code_records(spark, SF).collect()) == sorted(registry_records.code_records(spark, SF).collect())


def test_points_are_replaced_not_repeated(spark):
    path = scratch(spark, "metrics")
    points = lambda rows: spark.createDataFrame(rows, "name string, step long, value double")
    files.log_metrics(points([("mrr", 1, 0.5), ("mrr", 2, 0.6), ("ndcg", 1, 0.1)]), path)
    files.log_metrics(points([("mrr", 2, 0.7), ("mrr", 3, 0.8)]), path)
    found = {(r["name"], r["step"]): r["value"] for r in files.read_metrics(spark, path).collect()}
    assert found == {("mrr", 1): 0.5, ("mrr", 2): 0.7, ("mrr", 3): 0.8, ("ndcg", 1): 0.1}


def test_checkpoints_are_listed_without_other_folders(spark):
    root = scratch(spark, "run")
    rows = spark.range(6).select("id", (F.col("id") % 3 * 1000).alias("step"))
    files.write_checkpoints(rows, root, [0, 1000, 2000])
    for other in ("best_dev", "checkpoint-x", "old-checkpoint-7"):
        rows.drop("step").write.parquet(f"{root}/{other}")
    found = files.list_checkpoints(spark, root).orderBy("step").collect()
    assert [(r["checkpoint"], r["step"]) for r in found] == [("checkpoint-0", 0), ("checkpoint-1000", 1000), ("checkpoint-2000", 2000)]
    read = files.read_checkpoints(spark, root, rows.drop("step").schema)
    assert sorted((r["id"], r["step"]) for r in read.collect()) == [(i, i % 3 * 1000) for i in range(6)]


def test_a_map_is_read_in_splits(spark):
    import json
    import os

    rng = random.Random(5)
    codes = {" ".join(rng.choice(['a', '"', ', "b"', '": 3', "}", "{", "é", "\\", "\n", ","]) for _ in range(rng.choice([1, 5, 40]))): i for i in range(400)}
    codes = {c: i for c, i in codes.items() if not c.endswith(", ")}
    folder = scratch(spark, "maps").removeprefix("file:")
    os.makedirs(folder)
    for name, ascii_ in (("one.json", True), ("two.json", False)):
        with open(f"{folder}/{name}", "w") as f:
            json.dump(codes, f, ensure_ascii=ascii_)
    with open(f"{folder}/none.json", "w") as f:
        json.dump({}, f)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        found = files.read_codebase_map(spark, folder)
        assert found.rdd.getNumPartitions() > 8
        assert sorted((r["retrieval_idx"], r["code_tokens"]) for r in found.collect()) == sorted((i, c.split()) for c, i in codes.items() for _ in range(2))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("content", ['{"a, ": 1, "b": 2}', '{"a": "x"}', '["a"]', "nothing"])
def test_what_is_no_map_is_an_error(spark, content):
    import os

    folder = scratch(spark, "maps").removeprefix("file:")
    os.makedirs(folder)
    with open(f"{folder}/map.json", "w") as f:
        f.write(content)
    with pytest.raises(Exception, match="not an entry"):
        files.read_codebase_map(spark, folder).collect()


def test_markup_is_stripped_once(spark):
    plan = registry.QUERIES["pretrain_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("(?is)<!--") <= 1


def test_counts_come_from_the_write_itself(spark):
    lines = code.code_lines(tables.code_rows(spark, SF))
    tried = spark.sparkContext.accumulator(0)

    def passed(url):
        tried.add(1)
        return url

    counted = files.write_json_lines(lines.withColumn("url", F.udf(passed, "string")("url")), scratch(spark, "lines"), pairs.variant_counts())
    assert counted["n_rows"] == lines.count() == tried.value == counted["n_code_tokens"] + counted["n_function_tokens"]


def test_product_scores_take_vectors_by_reference(spark):
    from pairsmith.operators import retrieval

    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, None)], "vec_id long, vector array<double>")
    queries = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", 3)], "key string, vec_id long")
    documents = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("d", 1)], "key string, vec_id long")
    for limit in (1 << 20, 0):
        scored = retrieval.score_aligned(queries, documents, "key", vectors, limit)
        assert sorted((r["key"], r["score"]) for r in scored.collect() if r["score"]) == [("a", 11.0), ("b", 11.0), ("b", 11.0)] and scored.count() == 4


def test_each_product_is_masked_once(spark, monkeypatch):
    from pairsmith.operators import pairs
    from pairsmith.plans import product

    examples = spark.createDataFrame([(q, p, "us", 1, "E") for q in range(40) for p in (1, 2)] + [(0, 1, "us", 1, "E")], "query_id long, product_id long, product_locale string, large_version int, esci_label string")
    products = spark.createDataFrame([(p, loc, f"Title {p}", f"<b>Body</b> of Item {p}", "one line") for p in (1, 2) for loc in ("us", "jp")], "product_id long, product_locale string, product_title string, product_description string, product_bullet_point string")
    seen = []

    def prepare(texts):
        seen.append(texts.count())
        return product.masked(texts, "title", "positive")

    part = product.pretrain_part(examples, products, "train", prepare=prepare, distinct=True)
    whole = product.masked(product.pretrain_part(examples, products, "train").dropDuplicates(["query_id", "product_id"]), "title", "positive")
    listed = lambda df: sorted(tuple(r) for r in df.select("query_id", "product_id", "query", "masked", "label").collect())
    assert seen == [2] and listed(part) == listed(whole) and len(listed(part)) == 76


def test_words_of_a_batch_are_hashed_where_they_are_counted(spark):
    from pairsmith.operators import encode

    vectors = encode.hashed_words(spark.createDataFrame([(1, "b a A"), (2, None), (3, "")], "id long, text string"), "id", "text", 32)
    assert {r["id"]: round(sum(x * x for x in r["vector"]), 6) for r in vectors.collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    assert "conv(" not in vectors._jdf.queryExecution().optimizedPlan().toString()


def test_the_sentinels_of_a_code_are_mapped_once(spark):
    from pairsmith.plans import code

    lines = spark.createDataFrame([(["a", "=", "b"], None, ["x"], "a = b", "u", "python")], "code_tokens array<string>, function_tokens array<string>, docstring_tokens array<string>, code string, url string, language string")
    masked = code.masked(lines)
    assert [r["masked"] for r in masked.collect()] == ["<extra_id_0> = <extra_id_1>"]
    plan = masked._jdf.queryExecution().optimizedPlan().toString()
    assert "try_element_at(map_from_arrays" not in plan and "element_at(map_from_arrays" not in plan.replace(" ", "")


def test_tasks_of_judged_rows_grow_in_number(spark, monkeypatch, tmp_path):
    from pairsmith.plans import tables

    lines = "id as l_orderkey, id as l_partkey, id as l_suppkey, id as l_linenumber, 1.0D as l_extendedprice, 'A' as l_returnflag, 'F' as l_linestatus"
    spark.range(2_000).selectExpr(*lines.split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(2_000).selectExpr("id as o_orderkey", "'1-URGENT' as o_orderpriority", "id as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(tables, "TASK_ROWS", 200)
    rows = tables.examples(spark, str(tmp_path))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2 and rows.count() == 2_000
