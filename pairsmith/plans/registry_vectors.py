"""Registered queries over vectors: the index, the measures of checkpoints, heads."""

from pyspark.sql import Window, functions as F

from pairsmith.operators import encode, retrieval
from pairsmith.plans import evaluation, tables
from pairsmith.plans.registry import _PAIRS, _WORDS, VECTORS, _query, _sweep
from pairsmith.session import scratch, stored
from pairsmith.sources import files

WIDTH = 32
_LOWER_WORDS = _WORDS.replace("(text,", "(lower(text),")
_HASHED = f"""buckets as (select doc_id, ('0x' || substr(md5(t), 1, 8))::bigint % {WIDTH} as k from (select doc_id, unnest({_LOWER_WORDS}) as t from documents)),
counts as (select doc_id, k, count(*)::double as n from buckets group by all),
lengths as (select doc_id, sqrt(sum(n * n)) as l from counts group by doc_id),
dense as (select doc_id, list(coalesce(n / l, 0) order by k) as v from (select doc_id, r.range as k from documents, range({WIDTH}) r) left join counts using (doc_id, k) left join lengths using (doc_id) group by doc_id),
scored as (select q.doc_id as query_id, d.doc_id, round(list_dot_product(q.v, d.v), 9) as score from dense q cross join dense d where q.doc_id % 20 = 0),
top as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored)"""


@_query("select query_id::varchar as query_id, doc_id::varchar as passage_id, rank, score from top where rank <= 10", _HASHED)
def retrieve_to_run(spark, sf_dir):
    """Documents encoded, indexed and stored; every twentieth is a query against all; the run file is read again."""
    encoded = stored(encode.hashed_words(tables.table(spark, sf_dir, "documents"), "doc_id", "text", WIDTH), "encoded")
    queries = encoded.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    out = scratch(spark, "retrieval")
    evaluation.retrieve_to_run_file(queries, encoded, 10, out)
    return files.read_run_file(spark, f"{out}/run").select("query_id", "passage_id", "rank", "score")


@_query("select q.query_id, d.doc_id, round(list_dot_product(q.v, d.v), 9) as score from q join d on d.doc_id // 10 = q.query_id // 10", VECTORS)
def score_candidates(spark, sf_dir):
    """Each query against its own candidate list."""
    rows = tables.vectors(spark, sf_dir)
    queries = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    documents = rows.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("doc_id"), "vector")
    candidates = documents.select((F.floor(F.col("doc_id") / 10) * 10).alias("query_id"), "doc_id")
    return retrieval.score_candidates(candidates, queries, documents).select("query_id", "doc_id", "score")


@_query("""select a.vec_id as id, h.vec_id as place, round(list_dot_product(a.embedding::double[], h.embedding::double[]), 9) as value
from embeddings a cross join (select * from embeddings where vec_id < 64) h""")
def linear_head(spark, sf_dir):
    """All vectors through a 64 x 64 head, whose rows are the first 64 vectors."""
    rows = tables.vectors(spark, sf_dir)
    head = rows.where("vec_id < 64").select(F.col("vec_id").alias("row"), F.col("vector").alias("weights"))
    out = encode.linear_head(rows.select(F.col("vec_id").alias("id"), "vector"), head)
    listed = out.select("id", F.posexplode("vector").alias("place", "value"))
    return listed.select("id", F.col("place").cast("long").alias("place"), F.round("value", 9).alias("value"))


# Checkpoints

STEPS = {8: 1000, 16: 2000, 32: 4000, 64: 8000}


def _checkpoint_folder(spark, sf_dir) -> str:
    """The vectors' first dimensions as the checkpoints of a run, beside a folder that is none."""
    root = scratch(spark, "checkpoints")
    rows = tables.vectors(spark, sf_dir)
    cut = F.explode(F.array(*(F.struct(F.lit(step).cast("long").alias("step"), F.slice("vector", 1, k).alias("vector")) for k, step in STEPS.items())))
    rows = rows.select("vec_id", "label", cut.alias("c")).select("vec_id", "label", "c.vector", "c.step")
    files.write_checkpoints(rows, root, list(STEPS.values()))
    rows.where("step = 1000").drop("step").write.parquet(f"{root}/best_dev")
    return root


@_query("select 'checkpoint-' || step as checkpoint, step, n_rows, row_number() over (order by step) as place from (values (1000), (2000), (4000), (8000)) t(step), (select count(*) as n_rows from embeddings)")
def checkpoint_order(spark, sf_dir):
    root = _checkpoint_folder(spark, sf_dir)
    rows = files.read_checkpoints(spark, root, spark.read.parquet(f"{root}/best_dev").schema).groupBy("step").agg(F.count("*").alias("n_rows"))
    listed = files.list_checkpoints(spark, root).join(rows, "step")
    place = F.row_number().over(Window.orderBy("step")).cast("long").alias("place")
    return listed.select("checkpoint", F.col("step").cast("int").alias("step"), "n_rows", place)


_MEASURES = """labels as (select vec_id // 2 as i, vec_id % 2 as side, label from embeddings),
hits as (select ps.*, q.label = d.label as hit from ps join labels q on q.i = ps.i and q.side = 0 join labels d on d.i = ps.j and d.side = 1),
ordered as (select *, row_number() over (partition by step, i order by s desc, j) as rank from hits),
each as (select step, i, 1.0::double / (1 + count(*) filter (s >= own and i <> j)) as pair_mrr,
  coalesce(1.0::double / min(rank) filter (hit and rank <= 1000), 0) as mrr_1000,
  coalesce(sum(1 / log2(rank + 1)) filter (hit and rank <= 100), 0) as dcg, count(*) filter (hit) as n from ordered join own using (step, i) group by step, i),
measured as (select *, case when n = 0 then 0 else dcg / list_sum(list_transform(range(1, least(n, 100) + 1), lambda r: 1 / log2(r + 1))) end as ndcg_100 from each),
points as (unpivot (select step, count(*) as n_queries, round(avg(pair_mrr), 9) as pair_mrr, round(avg(ndcg_100), 9) as ndcg_100, round(avg(mrr_1000), 9) as mrr_1000 from measured group by step) on pair_mrr, ndcg_100, mrr_1000 into name metric value value)"""


@_query("select step, metric, n_queries, value from points", VECTORS, _PAIRS, _MEASURES)
def metric_sweep(spark, sf_dir):
    """Three measures of every checkpoint folder from one pass."""
    root = _checkpoint_folder(spark, sf_dir)
    rows = files.read_checkpoints(spark, root, spark.read.parquet(f"{root}/best_dev").schema)
    pair = F.floor(F.col("vec_id") / 2)
    queries = rows.where("vec_id % 2 = 0").select(pair.alias("query_id"), "vector", "label", "step")
    documents = rows.where("vec_id % 2 = 1").select(pair.alias("doc_id"), "vector", "label", "step")
    return evaluation.measures_by_step(queries, documents).withColumn("value", F.round("value", 9))


@_query("select 'eval/mrr' as name, step, value from sweep", VECTORS, _PAIRS)
def metric_log(spark, sf_dir):
    """The points of a sweep, logged twice."""
    path = scratch(spark, "metrics")
    points = _sweep(spark, sf_dir).select(F.lit("eval/mrr").alias("name"), "step", "value")
    for _ in range(2):
        files.log_metrics(points, path)
    return files.read_metrics(spark, path).select("name", "step", "value")
