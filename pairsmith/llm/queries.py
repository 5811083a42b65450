"""The registered queries of this subpackage and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairsmith.llm import decontaminate, embedding_dedup, filter_audit, language_id, lm_scoring, minhash_dedup, mixing, packing, pii, resampling, shared, suffix_dedup, url_filter, warc
from pairsmith.session import scratch

#: The key of the surrogates in the registered query; users bring their own.
KEY = b"registered query"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = shared.crc_remainder("doc_id", 5) == 0
    model = language_id.fit(docs.where(~held_out), "doc_id", "text", "lang")
    return language_id.identify(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model).drop("text")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(shared.crc_remainder("doc_id", 7) == 2, F.lit(False))
    scored = lm_scoring.score(docs, shared.crc_remainder("doc_id", 7) != 2)
    scored = scored.withColumn("held_out", held_out)
    return scored.select("doc_id", "held_out", *(c for c in scored.columns if c not in ("doc_id", "held_out")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    path = scratch(spark, "archives")
    warc.write(warc.decide(pages), path)
    found = warc.read(spark, path, with_payload=False)
    return found.select(F.col("page").cast(pages.schema["page_id"].dataType).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(pages.schema["page_id"].dataType).alias("refers_to"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(_table(spark, sf_dir, "embeddings"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.link(_table(spark, sf_dir, "documents"), size=3, similarity=85)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), "contaminated")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, KEY).select("doc_id", "text", "n_entities", F.concat_ws(",", "entity_kinds").alias("entity_kinds"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # vocabulary files that only this query needs

    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"]).select("doc_id", "n_features", "weight", "score", "rank")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", _table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1,
        "op2_lm_scoring": op2,
        "op3_warc": op3,
        "op4_url_filter": op4,
        "op5_embedding_dedup": op5,
        "op6_minhash_dedup": op6,
        "op7_suffix_dedup": op7,
        "op8_decontaminate": op8,
        "op9_pii_surrogates": op9,
        "op10_mix": op10,
        "op11_best_fit_packing": op11,
        "op12_importance_resampling": op12,
        "op13_filter_audit": op13,
        "pipeline": pipeline,
    }


OP3_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
r as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as payload_digest from p),
h as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) else page_id end as holder from r)
select page_id, payload_bytes, payload_digest,
       case when holder is distinct from page_id then 'revisit' else 'response' end as record_type,
       case when holder is distinct from page_id then holder end as refers_to
from h
"""

OP4_SQL = r"""
with recursive rules(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u as (
  select page_id, url, html,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) as tail
  from pages),
k as (select *, case when host <> '' then host || case when tail = '' then '/' else tail end end as node from u),
tags as (select node as a, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^>]*>')) as tag from k),
targets as (
  select a, replace(case when regexp_matches(tag, '(?i)^<link.*\srel\s*=\s*["'']?\s*canonical\b') then regexp_extract(tag, '(?is)\shref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
                         when regexp_matches(tag, '(?i)^<meta.*\shttp-equiv\s*=\s*["'']?\s*refresh\b') then regexp_extract(tag, '(?is)url\s*=\s*["'']?\s*([^"''\s>]+)', 1) end, '&amp;', '&') as t
  from tags),
edges as (
  select a, translate(regexp_extract(t, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
            || case when regexp_extract(t, '(?s)^.*?://[^/?#]*([^#]*)', 1) = '' then '/' else regexp_extract(t, '(?s)^.*?://[^/?#]*([^#]*)', 1) end as b
  from targets where t like '%://%' and a is not null),
both_ways as (select a, b from edges union select b, a from edges),
reach(a, b) as (select a, b from both_ways union select r.a, w.b from reach r join both_ways w on r.b = w.a),
nodes as (select distinct b as node, regexp_extract(b, '^([^/?]*)', 1) as host, regexp_extract(b, '^[^/?]*([^?]*)', 1) as path from reach),
noderules as (select node, arg_max(verdict, length(h || p)) as verdict from nodes join rules on (host = h or host like '%.' || h) and starts_with(path, p) group by node),
groups as (select r.a as node, max(n.verdict = 'allow') as allowed, max(n.verdict = 'block') as blocked from reach r left join noderules n on n.node = r.b group by r.a),
own as (select page_id, url, node, arg_max(rules.verdict, length(h || p)) as verdict, arg_max(h || p, length(h || p)) as rule
        from k join rules on (host = h or host like '%.' || h) and starts_with(path, p) group by page_id, url, node)
select k.page_id, k.host, k.path, own.rule,
       coalesce(own.verdict, case when groups.blocked and not coalesce(groups.allowed, false) then 'block' else 'allow' end) as verdict
from k left join own on own.page_id = k.page_id and own.url is not distinct from k.url left join groups on groups.node = k.node
"""

OP5_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
          where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
low as (select a, min(b) as b from reach group by a),
n as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, least(vec_id, coalesce(low.b, vec_id)) as component_id, vec_id = least(vec_id, coalesce(low.b, vec_id)) as kept
from embeddings left join n on n.a = vec_id left join low on low.a = vec_id
"""

OP6_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from w),
x as (select doc_id, len(s) as n, unnest(s) as g from s),
few as (select *, count(*) over (partition by g) as df from x),
common as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c
           from few a join few b on a.g = b.g and a.doc_id < b.doc_id where a.df > 1 and b.df > 1 group by all),
links as (select a, b from common where 100 * c >= 85 * (na + nb - c)),
both_ways as (select a, b from links union select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a),
low as (select a, min(b) as b from reach group by a)
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce(low.b, doc_id)) as component_id, doc_id = least(doc_id, coalesce(low.b, doc_id)) as kept
from s left join low on low.a = doc_id
"""

OP8_SQL = r"""
with low as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
windows as (select distinct item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as s
            from (select item, w, least(10, len(w)) as k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)),
sizes as (select distinct k from windows),
spots as (select doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') as s
          from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from low join sizes on len(w) >= k)),
hits as (select doc_id, item, k, i from spots join windows using (k, s)),
words as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from (select distinct doc_id, k, i from hits)) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from hits) group by doc_id)
select low.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from low left join words using (doc_id) left join found using (doc_id)
"""

OP10_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         coalesce(cast(doc_id as varchar), '') as key,
         (('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from documents),
s as (select source, sum(size)::bigint as source_size, count(*) as n from d group by source),
w as (select *, (case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end)::double as weight, source_size * 2.0::double as most from s),
f as (select *, sum(source_size) over () * 1.5::double as total,
        coalesce(sum(most) over (order by most / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as full_before,
        sum(weight) over (order by most / weight, source asc nulls last rows between current row and unbounded following) as weight_left from w),
g as (select *, most / weight <= (total - full_before) / weight_left as is_full from f),
h as (select *, sum(case when is_full then most else 0 end) over () as used, sum(case when is_full then 0 else weight end) over () as open from g),
t as (select source, source_size, n, case when is_full then most else weight * ((total - used) / open) end as target from h),
e as (select *, case when source_size > 0 then target / source_size else 0 end as wanted from t),
p as (select *, floor(wanted) as whole, wanted - floor(wanted) as part, target - floor(wanted) * source_size as rest from e),
r as (select doc_id, size, key, p.*, case when part > 0 then (u / (1 - u)) / (part / (1 - part) * sqrt((size + 1) / (source_size / n + 1))) end as pareto from d join p on d.source is not distinct from p.source),
c as (select *, sum(size) over (partition by source order by pareto, key, size rows unbounded preceding) - size / 2 as middle from r)
select doc_id, size, source_size, target::double as target, (size * (whole + case when part > 0 and middle <= rest then 1 else 0 end))::bigint as taken from c
"""


# crc32 by its byte table; distinct features only, as the lists of bytes are long.
OP12_SQL = r"""
with crc as (select list(c order by b) as c from (select b, list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b) as c from range(256) t(b))),
docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bench as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
runs as (select doc_id, 0 as side, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from docs
         union all select null, 1, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from bench),
hexed as (select f, hex(encode(f)) as x from (select distinct f from runs)),
named as (select f, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint), lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 10000 as bucket from hexed, crc),
placed as (select doc_id, side, bucket from runs join named using (f)),
counts as (select b.bucket, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from (select range as bucket from range(10000)) b left join placed p on p.bucket = b.bucket group by b.bucket),
gains as (select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from counts),
sums as (select doc_id, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight from placed join gains using (bucket) where side = 0 group by doc_id),
scored as (select docs.doc_id, len(w) as n_words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || docs.doc_id), 1, 8))::bigint::double + 0.5) / 4294967296)))::bigint as score from docs left join sums using (doc_id)),
drawn as (select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_words >= 20 qualify rank <= 25 * count(*) over () // 100)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score, drawn.rank::bigint as rank from scored left join drawn using (doc_id)
"""

OP13_SQL = r"""
with words as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
flags as (select doc_id, part, len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) as c,
          regexp_matches(t, '[#$%&*|]') as d, doc_id > min(doc_id) over (partition by t) as e from words),
marks as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by doc_id),
docs as (select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * coalesce(e, false)::int as mask, coalesce(good, false) as good, coalesce(toxic, false) as toxic from flags left join marks using (doc_id)),
cells as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from docs group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as bit),
orders as (select p.x || q.x || r.x || s.x || t.x as filter_order from letters p, letters q, letters r, letters s, letters t where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps as (select filter_order, step::int as step, bit as own, (select coalesce(sum(l.bit), 0) from letters l where instr(filter_order, l.x) < step)::int as before from orders, range(1, 6) r(step), letters where x = substr(filter_order, step::int, 1)),
each as (select part, filter_order, step, own, coalesce(sum(n) filter (mask & (before | own) = 0), 0) as kept, coalesce(sum(n) filter (mask & before = 0 and mask & own <> 0), 0) as removed,
         coalesce(sum(n) filter (mask & before <> 0 and mask & own <> 0), 0) as redundant, coalesce(sum(n) filter (mask = own), 0) as unique_fails,
         coalesce(sum(good) filter (mask & before = 0 and mask & own <> 0), 0) as good_lost, coalesce(sum(toxic) filter (mask & before = 0 and mask & own <> 0), 0) as toxic_lost
         from cells, steps group by part, filter_order, step, own, before)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
       toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from each
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op4_url_filter": OP4_SQL, "op5_embedding_dedup": OP5_SQL, "op6_minhash_dedup": OP6_SQL, "op8_decontaminate": OP8_SQL, "op10_mix": OP10_SQL, "op12_importance_resampling": OP12_SQL, "op13_filter_audit": OP13_SQL}
