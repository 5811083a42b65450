"""Registered queries over tokens and training records, and the SQL of the entity queries."""

from pyspark.sql import Column, functions as F

from pairsmith import schemas
from pairsmith.functions import text
from pairsmith.operators import groups, order, pairs, retrieval, vocabulary
from pairsmith.plans import code, evaluation, product, tables
from pairsmith.plans.registry import _COMPLETE, _COUNTED, _FINETUNE, _PAIRS, _WORDS, CODE, EXAMPLES, LIST, PRODUCTS, SQL, VECTORS, _code, _items, _passages, _query, _stored
from pairsmith.session import scratch, stored
from pairsmith.sources import files
from pairsmith.streaming import streams

_PROPER = r"regexp_full_match({}, '\p{{Lu}}\p{{L}}*')"


def _words_of(column: str) -> str:
    return _WORDS.replace("(text,", f"({column},")


# bodies(key, title, body) → masked(key, masked), named(key, label): E6 to E10.
_MASKED = rf"""toks as (select key, unnest({_words_of("body")}) as token, generate_subscripts({_words_of("body")}, 1) as place from bodies
  where len(list_filter(regexp_split_to_array(body, '\s+'), lambda t: t <> '')) >= 2),
titles as (select distinct key, lower(t) as e from (select key, unnest({_words_of("title")}) as t from bodies) where {_PROPER.format("t")}),
ents as (select toks.*, {_PROPER.format("token")} or e is not null as is_entity from toks left join titles on titles.key = toks.key and e = lower(token)),
firsts as (select key, token, min(place) as first from ents where is_entity group by all),
maps as (select key, token, row_number() over (partition by key order by first) as rn from firsts qualify rn <= 99),
marked as (select ents.key, place, coalesce('<extra_id_' || (rn - 1) || '>', ents.token) as token from ents left join maps on maps.key = ents.key and maps.token = ents.token),
masked as (select key, string_agg(token, ' ' order by place) as masked from marked group by key),
named as (select key, string_agg('<extra_id_' || (rn - 1) || '> ' || token, ' ' order by rn) || ' <extra_id_' || count(*) || '>' as label from maps group by key)"""

_DOCUMENT_BODIES = "bodies as (select doc_id as key, string_split(text, chr(10))[1] as title, text as body from documents)"
SQL["mask_entities_products"] = f"with {_DOCUMENT_BODIES}, {_MASKED} select key as doc_id, masked, coalesce(label, '<extra_id_0>') as label from masked left join named using (key)"

_NAMES = f"""tokens as (select doc_id, unnest({_WORDS}) as name, generate_subscripts({_WORDS}, 1) as place from documents),
names as (select doc_id, name, row_number() over (partition by doc_id order by place) - 1 as i, count(*) over (partition by doc_id) as n from tokens where {_PROPER.format("name")}),
drawn as (select *, row_number() over (partition by doc_id order by md5('42:' || doc_id || ':' || i), i) as draw from names)"""
SQL["sentinel_map"] = f"""with {_NAMES}, firsts as (select doc_id, name, min(i) as first from names group by all),
placed as (select doc_id, name, row_number() over (partition by doc_id order by first) as rn from firsts)
select doc_id, name as entity, '<extra_id_' || (rn - 1) || '>' as sentinel from placed where rn <= 99"""
SQL["sample_identifiers"] = f"""with {_NAMES}, hit as (select distinct doc_id, name from drawn where draw <= greatest(floor(0.5 * (n - 1)), 1))
select doc_id, string_agg(name, '|' order by i) as sampled from names join hit using (doc_id, name) group by doc_id"""
# Values in the order of their first draw, until those before a value make up half.
SQL["select_half_identifiers"] = f"""with {_NAMES}, vals as (select doc_id, name, min(draw) as first, count(*) as k, any_value(n) as n from drawn group by all),
sums as (select *, coalesce(sum(k) over (partition by doc_id order by first rows between unbounded preceding and 1 preceding), 0) as before from vals),
halves as (select doc_id, string_agg(name, '|' order by i) as half from names join (select doc_id, name from sums where before < n // 2) using (doc_id, name) group by doc_id)
select documents.doc_id, coalesce(half, '') as half from documents left join halves using (doc_id)"""


# Ids


def _tokens(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.word_tokens(F.col("text")).alias("ids"))


def _joined(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), LIST)


@_query(SQL["encode_pairs"])
def encode_large(spark, sf_dir):
    """The same as ``encode_pairs`` with a vocabulary that counts as too large for a broadcast."""
    encoded = vocabulary.encode_columns(_tokens(spark, sf_dir), ["doc_id"], {"ids": 50}, _stored(spark, sf_dir), max_bytes=0)
    return encoded.select("doc_id", _joined(F.col("ids")).alias("ids"))


_IDS = "coded as (select doc_id, list(coalesce(id, 1) order by place) as ids from words left join vocab using (token) group by doc_id), numbered as (select *, row_number() over (order by doc_id) - 1 as position from coded)"
_PAD = "list_resize(list_slice({}, {}, {}), {}, 0)"

SQL["pad_batches"] = f"""with {_COUNTED}, {_IDS}
select doc_id, position // 16 as batch_id, {_PAD.format("ids", 1, 64, 64)} as input_ids, list_transform(range(1, 65), lambda i: i <= len(ids)) as attention_mask,
       list_transform({_PAD.format("ids", 1, 64, 64)}, lambda x: case when x = 0 then -100 else x end) as labels from numbered"""

_LENGTHS = {"query": 12, "passage": 32, "label": 16}


@_query(f"""select position // 16 as batch_id, count(*)::int as n_rows,
string_agg(array_to_string({_PAD.format("ids", 1, 8, 12)}, '|'), '|' order by position) as query_ids, sum(least(len(ids), 8))::long as n_query,
string_agg(array_to_string({_PAD.format("ids", 1, 24, 32)} || {_PAD.format("ids", 25, 48, 32)}, '|'), '|' order by position) as passage_ids,
sum(least(len(ids), 24) + greatest(least(len(ids), 48) - 24, 0))::long as n_passage,
case when any_value(position // 16) % 3 = 0 then '0' else string_agg(array_to_string(list_transform({_PAD.format("ids", 40, 49, 16)}, lambda x: case when x = 0 then -100 else x end), '|'), '|' order by position) end as labels
from numbered group by position // 16""", _COUNTED, _IDS)
def collate_batches(spark, sf_dir):
    """Sampled and truncated records as nested training batches; every third batch has no labels."""
    words = vocabulary.Vocabulary(_stored(spark, sf_dir))
    encoded = order.assign_batches(_tokens(spark, sf_dir).withColumn("ids", words.encode(F.col("ids"), 50)), [F.col("doc_id")], 16)
    part = lambda start, length: F.slice("ids", start, length)
    records = encoded.select(
        "batch_id", "position", F.col("doc_id").cast("string").alias("key"), F.col("ids").alias("query"),
        F.array("ids").alias("positives"), F.array(part(25, 50)).alias("negatives"),
        F.when(F.col("batch_id") % 3 != 0, part(40, 50)).alias("labels"),
    )
    sampled = groups.sample_record(records, 0, None, 2, lengths={"query": 8, "passages": 24, "labels": 10})
    batches = vocabulary.collate(sampled, _LENGTHS)
    real = lambda mask: F.size(F.filter(F.flatten(mask), lambda x: x)).cast("long")
    return batches.select(
        "batch_id", "n_rows", _joined(F.flatten("query_ids")).alias("query_ids"), real("query_mask").alias("n_query"),
        _joined(F.flatten("passage_ids")).alias("passage_ids"), real("passage_mask").alias("n_passage"), _joined(F.flatten("labels")).alias("labels"),
    )


# Records

_PICKED = "lines[('0x' || substr(md5('42:' || query_id || ':' || product_id), 1, 8))::bigint % len(lines) + 1]"
_PRETRAIN = f"""split as (select query_id, row_number() over (order by md5('10:' || query_id), query_id) <= ceil(0.05 * count(*) over ()) as dev
  from (select distinct query_id from examples where product_locale = 'us' and large_version = 1)),
pretrain as (select query_id, product_id, {_PICKED} as query, body as positive, product_title as title, dev
  from (select query_id, product_id, product_locale, ord from gains where gain = 1 and product_locale = 'us' and large_version = 1) join split using (query_id)
  join (select *, string_split(product_bullet_point, chr(10)) as lines from products where product_description is not null and product_bullet_point is not null and body <> product_description and body <> '') using (product_locale, product_id)
  where {_PICKED} <> '')"""


@_query("select query_id, product_id, query, positive, title from pretrain where dev", EXAMPLES, PRODUCTS, _PRETRAIN)
def pretrain_dev(spark, sf_dir):
    part = product.pretrain_part(tables.examples(spark, sf_dir), tables.products(spark, sf_dir), "dev")
    return part.select("query_id", "product_id", "query", "positive", "title")


_VOCAB = _COUNTED.split("everything as", 1)[1]
_RECORDS = rf"""bodies as (select query_id || ':' || product_id as key, title, positive as body from (select distinct query_id, product_id, title, positive from pretrain where not dev)),
{_MASKED},
every as (select 'positive' as kind, key, place, token from marked union all
  select 'label', key, place, token from (select key, unnest(string_split(coalesce(label, '<extra_id_0>'), ' ')) as token, generate_subscripts(string_split(coalesce(label, '<extra_id_0>'), ' '), 1) as place from masked left join named using (key)) union all
  select 'query', key, place, token from (select query_id || ':' || product_id as key, unnest({_words_of("query")}) as token, generate_subscripts({_words_of("query")}, 1) as place from (select distinct query_id, product_id, query from pretrain where not dev)) join masked using (key)),
everything as{_VOCAB},
ids as (select kind, key, string_agg(coalesce(id, case when starts_with(every.token, '<extra_id_') then 2 + regexp_extract(every.token, '[0-9]+')::int end, 1)::varchar, '|' order by place) as ids
  from every left join vocab on vocab.token = every.token where place <= case kind when 'positive' then 240 when 'label' then 60 else 50 end group by all)"""


@_query("""select string_split(p.key, ':')[1]::bigint as query_id, string_split(p.key, ':')[2]::bigint as product_id, q.ids as query, p.ids as positives, l.ids as labels
from ids p join ids q on q.key = p.key and q.kind = 'query' join ids l on l.key = p.key and l.kind = 'label' where p.kind = 'positive'""", EXAMPLES, PRODUCTS, _PRETRAIN, _RECORDS)
def pretrain_records(spark, sf_dir):
    """The written records of the product builder: pairs of the train part, masked, labelled and encoded."""
    masked = lambda texts: product.masked(texts.dropDuplicates(pairs.JOIN_KEYS), "title", "positive").drop("title", "positive")
    part = product.pretrain_part(tables.examples(spark, sf_dir), tables.products(spark, sf_dir), "train", prepare=masked, distinct=True)
    path = scratch(spark, "records")
    records = product.pretrain_records(part, _stored(spark, sf_dir))
    files.write_json_lines(records, path)
    read = files.read_json_lines(spark, path, records.schema)
    return read.select("query_id", "product_id", _joined(F.col("query")).alias("query"), _joined(F.flatten("positives")).alias("positives"), _joined(F.col("labels")).alias("labels"))


_GROUP_IDS = rf"""everything as{_VOCAB},
texts as (select product_locale, product_id, 'title : ' || coalesce(product_title, '') || ' text : ' || coalesce(body, '') as body from products),
cut as (select product_locale, product_id, list_slice({_words_of("body")}, 1, 256) as w from texts),
coded as (select product_locale, product_id, string_agg(coalesce(id, 1)::varchar, '|' order by place) as ids
  from (select product_locale, product_id, unnest(w) as token, generate_subscripts(w, 1) as place from cut) left join vocab using (token) group by all),
bare as (select string_agg(coalesce(id, 1)::varchar, '|' order by place) as none from (select unnest(['title', ':', 'text', ':']) as token, generate_subscripts(['title', ':', 'text', ':'], 1) as place) left join vocab using (token)),
asked as (select query_id, arg_min(query, ord) as query from wanted group by query_id),
asked_ids as (select query_id, string_agg(coalesce(id, 1)::varchar, '|' order by place) as query
  from (select query_id, unnest(list_slice({_words_of("query")}, 1, 20)) as token, generate_subscripts(list_slice({_words_of("query")}, 1, 20), 1) as place from asked) left join vocab using (token) group by query_id),
sided as (select query_id, string_agg(coalesce(ids, none), ';' order by ord) filter (gain = 1) as positives, string_agg(coalesce(ids, none), ';' order by ord) filter (gain <> 1) as negatives
  from wanted left join coded using (product_locale, product_id), bare group by query_id)"""


@_query("select query_id, query, positives, negatives from sided join asked_ids using (query_id) where positives is not null and negatives is not null", EXAMPLES, PRODUCTS, _FINETUNE, _GROUP_IDS)
def finetune_records(spark, sf_dir):
    """The written records of the fine-tuning builder: groups of encoded products."""
    wanted = product.finetune_examples(tables.examples(spark, sf_dir))
    words = vocabulary.Vocabulary(_stored(spark, sf_dir))
    path = scratch(spark, "records")
    records = product.finetune_records(wanted, tables.products(spark, sf_dir), words)
    files.write_json_lines(records, path)
    read = files.read_json_lines(spark, path, records.schema)
    listed = lambda side: F.array_join(F.transform(side, _joined), ";")
    return read.select("query_id", _joined(F.col("query")).alias("query"), listed("positives").alias("positives"), listed("negatives").alias("negatives"))


def _record_lists(records):
    return records.select("url", _joined(F.col("query")).alias("query"), _joined(F.flatten("positives")).alias("positives"), _joined(F.col("labels")).alias("labels"))


def code_records(spark, sf_dir):
    """The code builder as a batch, which the stream must equal."""
    lines = _code(spark, sf_dir)
    return _record_lists(code.pretrain_records(code.masked(lines), _stored(spark, sf_dir)))


@_query()
def stream_code_records(spark, sf_dir):
    """The whole code builder on a stream of files, two in a micro-batch."""
    path, out = scratch(spark, "lines"), scratch(spark, "records")
    lines = _code(spark, sf_dir)
    files.write_json_lines(lines.repartition(6, "url"), path)
    stream = streams.json_line_stream(spark, path, lines.schema, files=2)
    rows = streams.run_available(stream, streams.coded_tokens(_stored(spark, sf_dir)), f"{out}/rows", f"{out}/checkpoint")
    return _record_lists(streams.code_records(rows))


_SHORT = """enough as (select query_id from placed where side = 0 group by query_id having count(*) >= 2),
slots as (select query_id, unnest(range(0, 4)) as slot from enough),
wanted as (select slots.query_id, slot, case when slot = 0 then 1 else 0 end as side, case when slot = 0 then 0 else (slot - 1) % least(n_neg, 3) end as place from slots join complete using (query_id))"""


@_query("select query_id, string_agg(product_id::varchar, '|' order by slot) as passages from wanted join placed using (query_id, side, place) group by query_id", EXAMPLES, _COMPLETE, _SHORT)
def sample_groups_short(spark, sf_dir):
    """Unseeded groups of four of queries with two negatives or more: two are repeated, in order."""
    items = _items(spark, sf_dir)
    enough = items.where("gain <> 1").groupBy("query_id").count().where("count >= 2")
    return _passages(groups.sample_groups(items.join(enough, "query_id", "left_semi"), 0, None, 4))


@_query(SQL["code_pairs"])
def scan_json_array(spark, sf_dir):
    path = scratch(spark, "arrays")
    files.write_json_arrays(_code(spark, sf_dir).select("code_tokens", "function_tokens", "docstring_tokens", "url"), path, ["url"], 50)
    return pairs.code_pairs(files.read_json_array(spark, path, schemas.CODE_LINES)).select("url", "docstring", "code_text")


@_query(r"""select min(conv_id * 1000 + turn) as retrieval_idx, code, 0::int as n_docstring from (select *, array_to_string(list_filter(regexp_split_to_array(answer, '\s+'), lambda t: t <> ''), ' ') as code from code_pairs) group by code""", CODE)
def scan_codebase_map(spark, sf_dir):
    """Each code once with its index, written as objects of many entries and read in splits."""
    rows = tables.code_rows(spark, sf_dir)
    code_text = text.joined_tokens(text.ws_tokens(F.coalesce("code_text", "function_text")))
    wanted = rows.select(code_text.alias("code"), (F.col("conv_id") * 1000 + F.col("turn")).alias("retrieval_idx")).groupBy("code").agg(F.min("retrieval_idx").alias("retrieval_idx"))
    path = scratch(spark, "map")
    files.write_codebase_map(wanted, path)
    read = files.read_codebase_map(spark, path)
    return read.select("retrieval_idx", text.joined_tokens(F.col("code_tokens")).alias("code"), F.size("docstring_tokens").alias("n_docstring"))


_FIRST = "top as (select i, j, row_number() over (partition by i order by s desc, j) as rank from ps where step = 8000)"


@_query("select count(*) as n_queries, round(avg(coalesce(1.0::double / first_hit, 0)), 6) as mrr from (select i, min(rank) filter (i = j and rank <= 100) as first_hit from top group by i)", VECTORS, _PAIRS, _FIRST)
def mrr_run_at_100(spark, sf_dir):
    """Retrieved pairs as a run file, read again and measured."""
    rows = tables.vectors(spark, sf_dir)
    pair = F.floor(F.col("vec_id") / 2)
    queries = rows.where("vec_id % 2 = 0").select(pair.alias("query_id"), "vector")
    documents = rows.where("vec_id % 2 = 1").select(pair.alias("doc_id"), "vector")
    path = scratch(spark, "run")
    files.write_spaced(evaluation.run_lines(retrieval.top_k(queries, documents, 100)), path)
    return evaluation.run_file_mrr(spark, path, 100).withColumn("mrr", F.round("mrr", 6))


@_query("select query_id, row_number() over (partition by query_id order by side desc, place) - 1 as place, product_id, gain from placed", EXAMPLES, _COMPLETE)
def candidate_list(spark, sf_dir):
    """Positives, then negatives, of every complete group, as the list that a dev query is scored against."""
    listed = groups.candidates(groups.query_groups(_items(spark, sf_dir)))
    return listed.select("query_id", F.col("place").cast("long").alias("place"), "product_id", "gain")


@_query("select vec_id as id, len(embedding)::int as width, round(list_sum(embedding::double[]), 6) as total from embeddings")
def scan_embeddings(spark, sf_dir):
    """Vector files with text ids, read with ids as numbers."""
    path = scratch(spark, "vectors")
    tables.vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("id"), F.col("vector").alias("embedding")).write.parquet(path)
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return files.read_embeddings(spark, path).select("id", F.size("embedding").alias("width"), F.round(total, 6).alias("total"))


@_query("select url as id, docstring as text, 'query' as side from pairs union all select url, code_text, 'code' from pairs", CODE, "pairs as (" + SQL["code_pairs"].removeprefix(f"with {CODE} ") + ")")
def test_code(spark, sf_dir):
    """Both sides of the code test corpus."""
    lines = _code(spark, sf_dir)
    queries = code.test_queries(lines).select("id", F.col("query").alias("text"), F.lit("query").alias("side"))
    return queries.union(code.test_documents(lines).select("id", F.col("code").alias("text"), F.lit("code").alias("side")))


_ALIGNED = """n as (select count(*) as n from embeddings),
scored as (select query_id, product_id, ord, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 9) as score
  from examples, n join embeddings a on a.vec_id = query_id % n join embeddings b on b.vec_id = (product_id * 7 + 3) % n),
ranked as (select *, row_number() over (partition by query_id order by score desc, ord) - 1 as rank, count(*) over (partition by query_id) as size from scored)"""


@_query("select query_id::varchar as query_id, product_id::varchar as passage_id, rank, round_even((size - 1 - rank) * 128.0::double / size, 3) as score from ranked", EXAMPLES, _ALIGNED.replace("from examples, n join", "from (select * from examples, n) join"))
def product_results(spark, sf_dir):
    """The product test as one job: row-aligned vectors, their scores, and the three files; the results are read again."""
    rows = stored(tables.examples(spark, sf_dir).select("query_id", "product_id", "pos", "esci_label"), "examples")
    vectors = tables.vectors(spark, sf_dir).select("vec_id", "vector")
    n = vectors.count()
    key = F.struct("query_id", "pos").alias("key")
    side = lambda at, *columns: rows.select(key, *columns, at.alias("vec_id"))
    queries = side(F.col("query_id") % n, "query_id", "pos")
    documents = side((F.col("product_id") * 7 + 3) % n, "product_id")
    out = scratch(spark, "product")
    evaluation.product_files(queries, documents, rows, "key", out, vectors)
    return files.read_run_file(spark, f"{out}/results").select("query_id", "passage_id", "rank", "score")
