"""Queries of retrieval, claims, evidence, reviews and evaluation over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import lexicons as L
from corpuscle.functions import text as T
from corpuscle.functions.columns import canonical_id
from corpuscle.operators import claims as C
from corpuscle.operators import evaluation, evidence, records, retrieval, review, reviews
from corpuscle.plans.corpus_queries import CURRENT, LATEST, QUERY_TERMS, TERMS, TOKENS, _KEY, listed
from corpuscle.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Retrieval ---------------------------------------------------------------------------------------

_INDEX = f"""t as (select id doc, case when len(x) = 0 then ['<empty>'] else x end x from (select id, coalesce({TOKENS.format('text')}, []) x from {CURRENT.format('chunks')})),
  p as (select doc, term, count(*) tf from (select doc, unnest(x) term from t) group by all),
  st as (select count(*) n, avg(len(x)) avgdl from t),
  r as (select term, count(*) df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) raw from p, st group by 1),
  i as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from r) else raw end idf from r)"""
_ASKED = f"(select query_id, term, count(*) times from (select query_id, unnest({TOKENS.format('query')}) term from (select distinct query_id, query from search_results)) group by all)"


def _chunk_index(spark: SparkSession, root: str) -> retrieval.Bm25Index:
    return retrieval.bm25_index(records.current(table(spark, root, "chunks").select("id", "text", "loaded_at", "deleted_at")), "id")


def _asked(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "search_results").select("query_id", "query").distinct()


@query(f"with {_INDEX} select n as docs, round(avgdl, 6) as avgdl, (select count(*) from i) as terms, (select sum(tf)::bigint from p) as tokens, (select round(avg(idf), 6) from i) as mean_idf from st")
def bm25_index_stats(spark: SparkSession, root: str) -> DataFrame:
    index = _chunk_index(spark, root)
    terms = index.terms.agg(F.count("*").alias("terms"), F.round(F.avg("idf"), 6).alias("mean_idf"))
    tokens = index.postings.agg(F.sum("tf").alias("tokens"))
    return index.stats.crossJoin(F.broadcast(terms)).crossJoin(F.broadcast(tokens)).select(F.col("n").alias("docs"), F.round("avgdl", 6).alias("avgdl"), "terms", "tokens", "mean_idf")


@query(
    f"""with {_INDEX}, s as (select query_id, doc, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(x) / avgdl))), 6) score from {_ASKED} join i using (term) join p using (term) join t using (doc), st group by all)
    select query_id, doc as chunk_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc)::int rank from s where score > 0) where rank <= 10"""
)
def bm25_topk(spark: SparkSession, root: str) -> DataFrame:
    """The ten best chunks of every query."""
    return retrieval.bm25_search(_chunk_index(spark, root), _asked(spark, root), 10).withColumnRenamed("doc", "chunk_id")


_DENSE = """(select query_id, doc, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc)::int rank from
  (select a.vec_id query_id, b.vec_id doc, round(least(1.0, list_inner_product(a.embedding::double[], b.embedding::double[])), 6) score from embeddings a, embeddings b where a.vec_id % 50 = 0)) where rank <= 10)"""


def _dense(spark: SparkSession, root: str) -> DataFrame:
    vectors = table(spark, root, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    asked = table(spark, root, "embeddings").filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.dense_search(vectors, asked, 10)


@query(f"select * from {_DENSE}")
def dense_topk(spark: SparkSession, root: str) -> DataFrame:
    """The ten best vectors of every query vector (ids divisible by 50), against all."""
    return _dense(spark, root)


_RESULTS = "(select query_id, any_value(query) query, chunk_id, any_value(article_id) article_id, any_value(preview) preview, min(final_rank) final_rank, min(bm25_rank) filter (bm25_rank >= 1) bm25_rank, min(dense_rank) filter (dense_rank >= 1) dense_rank from search_results group by query_id, chunk_id)"


def _results(spark: SparkSession, root: str) -> DataFrame:
    """One row per query and chunk."""
    best = lambda c: F.min(F.when(F.col(c) >= 1, F.col(c))).alias(c)
    return table(spark, root, "search_results").groupBy("query_id", "chunk_id").agg(F.min("query").alias("query"), F.min("article_id").alias("article_id"), F.min("preview").alias("preview"), F.min("final_rank").alias("final_rank"), best("bm25_rank"), best("dense_rank"))


_FUSED = f"(select query_id, chunk_id, score, fused_rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int fused_rank from (select query_id, chunk_id, round(coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + dense_rank), 0), 12) score from {_RESULTS}) where score > 0) where fused_rank <= 10)"


@query(f"select query_id, chunk_id, score::double as score, fused_rank from {_FUSED}")
def rrf_fusion(spark: SparkSession, root: str) -> DataFrame:
    """The ten best chunks of each query by reciprocal ranks."""
    return retrieval.reciprocal_rank_fusion(_results(spark, root), ["bm25_rank", "dense_rank"], 10).select("query_id", "chunk_id", "score", "fused_rank")


@query(
    f"""select topic, chunk_id, score::double as score, best_rank, rank from (select *, row_number() over (partition by topic order by score desc, chunk_id)::int rank from
    (select string_split(query, ' ')[1] topic, chunk_id, round(sum(1.0 / (60 + final_rank)), 12) score, min(final_rank) best_rank from {_RESULTS} group by all)) where rank <= 10"""
)
def multi_query_merge(spark: SparkSession, root: str) -> DataFrame:
    """The queries of one first word taken as variants of one question."""
    return retrieval.merge_variants(_results(spark, root).withColumn("topic", F.get(F.split("query", " "), 0)), "topic", 10)


@query(f"select query_id, r.chunk_id, coalesce(c.section_type, 'other') as chunk_section, length(coalesce(c.text, ''))::int as chunk_length from {_RESULTS} r left join {CURRENT.format('chunks')} c on c.id = r.chunk_id")
def rank_enrichment(spark: SparkSession, root: str) -> DataFrame:
    chunks = records.current(table(spark, root, "chunks").select("id", "section_type", "text", "loaded_at", "deleted_at"))
    return retrieval.enrich(_results(spark, root).select("query_id", "chunk_id"), chunks).select("query_id", "chunk_id", "chunk_section", F.char_length("chunk_text").alias("chunk_length"))


@query(
    f"""select count(*) as entries, count(*) filter (c.id is null) as unknown, count(*) filter (c.id is not null and c.article_id <> r.article_id) as article_mismatch,
    count(*) filter (c.id is not null and c.article_id = r.article_id and left(coalesce(c.text, ''), 80) <> r.preview) as preview_mismatch from {_RESULTS} r left join {CURRENT.format('chunks')} c on c.id = r.chunk_id"""
)
def index_consistency(spark: SparkSession, root: str) -> DataFrame:
    chunks = records.current(table(spark, root, "chunks").select("id", "article_id", "text", "loaded_at", "deleted_at"))
    return retrieval.index_consistency(_results(spark, root), chunks, 80)


# Claims ------------------------------------------------------------------------------------------

_SOURCE = f"(select id, coalesce(verbatim, text, '') v from {LATEST.format('claims')})"


def _claim_texts(spark: SparkSession, root: str) -> DataFrame:
    df = records.latest(table(spark, root, "claims").select("id", "text", "verbatim", "loaded_at"))
    return df.select("id", F.coalesce("verbatim", "text", F.lit("")).alias("v"))


_CORE = "regexp_replace(trim(v), '[\"''”’)\\]}» ]+$', '')"
_COMPLETE = f"""(length(trim(v)) >= 20 and len(list_filter(regexp_split_to_array(trim(v), '\\s+'), lambda w: w <> '')) >= 5 and not regexp_matches(trim(v), '^\\p{{Ll}}')
  and regexp_matches({_CORE}, '[.!?]$') and not regexp_matches({_CORE}, '(\\.\\.\\.|…)$')
  and lower(regexp_extract(regexp_replace({_CORE}, '[.!?]$', ''), '([\\pL\\pM\\pN_''-]+)[^\\pL\\pM\\pN_''-]*$', 1)) not in ('', {listed(L.TRAILING_WORDS)}))"""


@query(f"select {_COMPLETE} as complete, count(*) as n from {_SOURCE} group by all")
def claim_gate(spark: SparkSession, root: str) -> DataFrame:
    return _claim_texts(spark, root).select(C.is_complete("v").alias("complete")).groupBy("complete").agg(F.count("*").alias("n"))


_WORD = lambda values: "\\b(?:" + "|".join(v.replace("-", "\\-") for v in values) + ")\\b"
_PARTS = lambda values: "(" + " or ".join(f"contains(l, '{v}')" for v in values) + ")"
_TYPE = f"""case when regexp_matches(l, '{_WORD(L.LIMITATION_MARKERS)}') then 'limitation' when regexp_matches(l, '{_WORD(L.KNOWN_DATASETS)}') and {_PARTS(L.RELEASE_VERBS)} then 'dataset'
  when regexp_matches(l, '{_WORD(L.CONTRIBUTION_VERBS)}') and regexp_matches(l, '\\b(?:we|our|this\\s+paper|this\\s+work)\\b') then 'method'
  when regexp_matches(l, '{_WORD(L.COMPARISON_VERBS)}') or regexp_matches(l, '\\b(?:compared?\\s+to|versus|vs\\.?|over\\s+the\\s+baseline)\\b') then 'comparison'
  when {_PARTS([*L.MODAL_SPECULATIVE, *L.FUTURE_MARKERS])} then 'hypothesis' else 'finding' end"""
_HEDGE = f"case when {_PARTS(L.FUTURE_MARKERS)} or regexp_matches(l, '{_WORD(L.MODAL_SPECULATIVE)}') then 'speculative' when regexp_matches(l, '{_WORD([*L.MODAL_HEDGED, *C._inflected(L.HEDGING_VERBS)])}') then 'hedged' else 'certain' end"


@query(f"select {_TYPE} as claim_type, {_HEDGE} as hedging_level, count(*) as n from (select lower(v) l from {_SOURCE}) group by all")
def claim_types(spark: SparkSession, root: str) -> DataFrame:
    return _claim_texts(spark, root).select(C.claim_type("v").alias("claim_type"), C.hedging("v").alias("hedging_level")).groupBy("claim_type", "hedging_level").agg(F.count("*").alias("n"))


_NAMES = listed([n.replace("-", "").replace(" ", "") for n in L.METRIC_NAMES])
_EITHER = L.METRIC_PATTERN.replace("'", "''")


@query(
    f"""with m as (select id, lower(v) l, regexp_extract(lower(v), '{_EITHER}', ['a', 'b', 'c', 'd', 'e']) g from {_SOURCE}),
    k as (select id, l, case when regexp_replace(g.e, '[- ]', '', 'g') in ({_NAMES}) then g.e when regexp_replace(g.a, '[- ]', '', 'g') in ({_NAMES}) then g.a end name,
      coalesce(try_cast(nullif(g.b, '') as double), try_cast(nullif(g.c, '') as double)) num from m),
    f as (select id, l, name, case when num > 0 and num <= 100 then num end value from k)
    select id, name as metric_name, case when name is not null or value is not null then value else try_cast(nullif(regexp_extract(l, '\\b(\\d+\\.?\\d*)\\s*(?:%|percent)\\b', 1), '') as double) end as metric_value from f"""
)
def metric_extract(spark: SparkSession, root: str) -> DataFrame:
    return _claim_texts(spark, root).withColumn("m", C.metric("v")).select("id", F.col("m.name").alias("metric_name"), F.col("m.value").alias("metric_value"))


@query(f"select id, article_id, claim_type, hedging_level from {CURRENT.format('claims')} where claim_type = 'finding' and hedging_level = 'certain' and metric_value is not null")
def claims_filter(spark: SparkSession, root: str) -> DataFrame:
    df = records.current(table(spark, root, "claims").select("id", "article_id", "claim_type", "hedging_level", "metric_value", "loaded_at", "deleted_at"))
    return df.filter("claim_type = 'finding' and hedging_level = 'certain' and metric_value is not null").select("id", "article_id", "claim_type", "hedging_level")


@query(f"select claim_type, hedging_level, count(*) as n, count(metric_value) as with_metric, count(distinct article_id) as articles, (100 * count(metric_value)) // count(*) as percent from {CURRENT.format('claims')} group by all")
def claim_counts(spark: SparkSession, root: str) -> DataFrame:
    df = records.current(table(spark, root, "claims").select("id", "article_id", "claim_type", "hedging_level", "metric_value", "loaded_at", "deleted_at"))
    return df.groupBy("claim_type", "hedging_level").agg(F.count("*").alias("n"), F.count("metric_value").alias("with_metric"), F.count_distinct("article_id").alias("articles"), F.floor(100 * F.count("metric_value") / F.count("*")).alias("percent"))


_SPLIT = r"string_split(regexp_replace(text, '([.!?][\"'')\]]{0,3})(\s)', '\1' || chr(1) || '\2', 'g'), chr(1))"
_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LONGEST = lambda terms: "case " + " ".join(f"when regexp_matches(l, '{_WORD([t])}') then '{t}'" for t in sorted(terms, key=lambda t: (-len(t), t))) + " end"


@query(
    f"""with s as (select id, article_id, char_start cs, {_SPLIT} p from {CURRENT.format('chunks')} where text is not null),
    e as (select id, article_id, cs, p[n] raw, list_sum(list_transform(p[1:n - 1], lambda x: length(x)))::int before from (select *, unnest(range(1, len(p) + 1)) n from s)),
    c as (select id, article_id, cs, coalesce(before, 0) st, coalesce(before, 0) + length(raw) - length(regexp_replace(raw, '^{_WS}+', '')) pl, regexp_replace(raw, '^{_WS}+|{_WS}+$', '', 'g') v from e),
    g as (select *, lower(v) l, regexp_extract(lower(v), '{_EITHER}', ['a', 'b', 'c', 'd', 'e']) g from c where {_COMPLETE} and length(trim(v)) <= 600 and not (st = 0 and cs > 0)),
    k as (select *, case when regexp_replace(g.e, '[- ]', '', 'g') in ({_NAMES}) then g.e when regexp_replace(g.a, '[- ]', '', 'g') in ({_NAMES}) then g.a end name,
      coalesce(try_cast(nullif(g.b, '') as double), try_cast(nullif(g.c, '') as double)) num from g),
    f as (select *, case when num > 0 and num <= 100 then num end value from k)
    select article_id, id as chunk_id, pl::int as char_start, (pl + length(v))::int as char_end, {_TYPE} as claim_type, {_HEDGE} as hedging_level, name as metric_name,
      case when name is not null or value is not null then value else try_cast(nullif(regexp_extract(l, '\\b(\\d+\\.?\\d*)\\s*(?:%|percent)\\b', 1), '') as double) end as metric_value, {_LONGEST(L.KNOWN_DATASETS)} as dataset_name, {_LONGEST(L.KNOWN_MODELS)} as model_name from f"""
)
def extracted_claims(spark: SparkSession, root: str) -> DataFrame:
    """Claims extracted anew from all chunks."""
    return C.extract_claims(records.current(table(spark, root, "chunks"))).select("article_id", "chunk_id", "char_start", "char_end", "claim_type", "hedging_level", "metric_name", "metric_value", "dataset_name", "model_name")


# Evidence ----------------------------------------------------------------------------------------

_RELEVANCE = f"""(select query_id, id, article_id, claim_type, final_rank, hits, extra, n, v from (select r.query_id, c.id, c.article_id, c.claim_type, r.final_rank, c.v, len(q.t)::int n, len(list_intersect(q.t, c.t))::int hits,
    len(list_filter(list_intersect(q.t, a.t), lambda x: not list_contains(list_intersect(q.t, c.t), x)))::int extra
  from {_RESULTS} r join (select query_id, any_value({QUERY_TERMS.replace('{0}', 'query')}) t from search_results group by 1) q using (query_id)
  join (select id, {_KEY.format('article_id')} article_id, {_KEY.format('chunk_id')} chunk_id, claim_type, coalesce(verbatim, text, '') v, {TERMS.replace('{0}', "coalesce(verbatim, text, '')")} t from {CURRENT.format('claims')}) c on c.chunk_id = r.chunk_id
  left join (select id, {TERMS.replace('{0}', 'title')} t from {CURRENT.format('articles')}) a on a.id = c.article_id))"""


def _relevant(spark: SparkSession, root: str) -> DataFrame:
    """Claims of retrieved chunks with their relevance to the query."""
    own = records.current(table(spark, root, "claims").select("id", "article_id", "chunk_id", "claim_type", "text", "verbatim", "loaded_at", "deleted_at"))
    c = own.select("id", canonical_id("article_id").alias("article_id"), canonical_id("chunk_id").alias("chunk_id"), "claim_type", F.coalesce("verbatim", "text", F.lit("")).alias("v"))
    a = records.current(table(spark, root, "articles").select("id", "title", "loaded_at", "deleted_at")).select(F.col("id").alias("article_id"), "title")
    found = _results(spark, root).select("query_id", "query", "chunk_id", "final_rank").join(c, "chunk_id").join(a, "article_id", "left")
    return found.withColumn("r", evidence.relevance("query", "v", "title"))


@query(f"select query_id, id as claim_id, n > 0 and hits > 0 and hits + extra >= case when n <= 3 then 1 else 2 end as relevant, case when n = 0 then 0 else round((hits + 0.25 * extra) / n, 6) end::double as score from {_RELEVANCE}")
def relevance_scores(spark: SparkSession, root: str) -> DataFrame:
    return _relevant(spark, root).select("query_id", F.col("id").alias("claim_id"), F.col("r.relevant").alias("relevant"), F.col("r.score").alias("score"))


_IN_WORD = "regexp_matches(substring(ct, ({0})::int, 1), '^[\\pL\\pM\\pN_]$')"
_STRIPPED = f"regexp_replace(coalesce(nullif(verbatim, ''), text, ''), '^{_WS}+|{_WS}+$', '', 'g')"
#: Per claim of ``k`` (id, a, h, v, s0, e0 and what else) its place and the first check it fails.
_JUDGED = f"""j as (select k.*, coalesce(x.text, '') ct, x.article_id xa, x.char_start xs, b.id bid, b.title from k left join CHUNKS x on x.id = k.h left join ARTICLES b on b.id = k.a),
    p as (select *, case when s0 >= 0 and e0 >= s0 and e0 <= length(ct) and substring(ct, s0 + 1, e0 - s0) = v then s0 else strpos(ct, v) - 1 end st from j),
    q as (select *, case when xa <> coalesce(a, '') then 'article_id_mismatch' when bid is null then 'article_missing' when xa is null then 'missing_chunk_metadata' when v = '' then 'empty_source_text'
      when not {_COMPLETE} then 'incomplete' when st < 0 then 'not_verbatim_in_source'
      when (st > 0 and {_IN_WORD.format('st')} and {_IN_WORD.format('st + 1')}) or (st + length(v) < length(ct) and {_IN_WORD.format('st + length(v)')} and {_IN_WORD.format('st + length(v) + 1')}) then 'source_token_boundary'
      when st = 0 and xs > 0 then 'source_context_unavailable' end reason from p)"""
_judged = lambda version: _JUDGED.replace("CHUNKS", version.format("chunks")).replace("ARTICLES", version.format("articles"))
_CLAIM = f"c.id, {_KEY.format('c.article_id')} a, {_KEY.format('c.chunk_id')} h, {_STRIPPED} v, c.char_start s0, c.char_end e0"


@query(f"with k as (select {_CLAIM} from {LATEST.format('claims')} c), {_judged(LATEST)} select coalesce(reason, 'passed') as reason, count(*) as n from q group by all")
def evidence_cascade(spark: SparkSession, root: str) -> DataFrame:
    claims = records.latest(table(spark, root, "claims").select("id", "article_id", "chunk_id", "text", "verbatim", "char_start", "char_end", "loaded_at"))
    chunks = records.latest(table(spark, root, "chunks").select("id", "article_id", "text", "char_start", "loaded_at"))
    articles = records.latest(table(spark, root, "articles").select("id", "loaded_at"))
    return evidence.cascade(claims, chunks, articles).groupBy(F.coalesce("reject_reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


#: A rejection counts at its stage: the number of the first stage that a claim doesn't pass.
_STAGE = "case when reason is null then 9 " + " ".join(f"when reason in ({listed(reasons)}) then {i}" for i, (_, reasons) in enumerate(evidence.STAGES)) + " end"


@query(
    f"""with k as (select {_CLAIM} from {CURRENT.format('claims')} c where {_KEY.format('c.chunk_id')} in (select chunk_id from search_results)), {_judged(CURRENT)},
    s as (select *, {_STAGE} stage, case when s0 is null or e0 is null then null when s0 >= 0 and e0 >= s0 and e0 <= length(ct) and substring(ct, s0 + 1, e0 - s0) = v then 'valid' when st >= 0 then 'recovered' else 'invalid' end o from q),
    c as (select unnest(['associated_with_retrieved_chunks', 'rejected_' || reason, case when stage > 0 then 'offsets_' || o end, {", ".join(f"case when stage > {i} then '{name}' end" for i, (name, _) in enumerate(evidence.STAGES))}]) counter from s)
    select counter, count(*) as n from c where counter is not null group by 1"""
)
def generation_stages(spark: SparkSession, root: str) -> DataFrame:
    """What became of the claims of all retrieved chunks, before relevance."""
    claims = records.current(table(spark, root, "claims").select("id", "article_id", "chunk_id", "text", "verbatim", "char_start", "char_end", "loaded_at", "deleted_at"))
    asked = table(spark, root, "search_results").select("chunk_id").distinct().withColumnRenamed("chunk_id", "_asked")
    chunks = records.current(table(spark, root, "chunks").select("id", "article_id", "text", "char_start", "loaded_at", "deleted_at"))
    articles = records.current(table(spark, root, "articles").select("id", "loaded_at", "deleted_at"))
    near = claims.join(asked, canonical_id("chunk_id") == F.col("_asked"), "left_semi")
    return evidence.stage_counts(evidence.cascade(near, chunks, articles))


_TYPES = "[" + ", ".join(f"'{t}'" for t in evidence.TYPE_ORDER) + "]"


@query(
    f"""with recursive c as (select query_id, id, article_id a, claim_type t, trim(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g')) k, round((hits + 0.25 * extra) / n, 6) score, final_rank r, list_position({_TYPES}, claim_type) o
      from {_RELEVANCE} where n > 0 and hits > 0 and hits + extra >= case when n <= 3 then 1 else 2 end),
    l as (select query_id, list(struct_pack(id, a := coalesce(a, ''), t, k) order by o, score desc, r, id) items from c where o is not null and k <> '' group by 1),
    g as (select query_id, items, 0 i, []::varchar[] ids, []::varchar[] keys, []::varchar[] articles, []::varchar[] types from l
      union all select query_id, items, i + 1, case when fits then list_append(ids, x.id) else ids end, case when fits then list_append(keys, x.k) else keys end, case when fits then list_append(articles, x.a) else articles end, case when fits then list_append(types, x.t) else types end
      from (select *, not list_contains(keys, x.k) and len(list_filter(articles, lambda y: y = x.a)) < {evidence.PER_ARTICLE} and len(list_filter(types, lambda y: y = x.t)) < {evidence.PER_TYPE} fits from (select *, items[i + 1] x from g where i < len(items))))
    select query_id, unnest(ids) as id, generate_subscripts(ids, 1)::int as position from g where i = len(items)"""
)
def greedy_selection(spark: SparkSession, root: str) -> DataFrame:
    """The claims a review of each query would cite."""
    found = _relevant(spark, root).filter("r.relevant").select("query_id", "id", "article_id", "claim_type", F.col("r.score").alias("score"), F.col("final_rank").alias("rank"), F.col("v").alias("text"))
    return evidence.select_evidence(found)


@query(f"with g as ({SQL['greedy_selection']}) select g.query_id, count(*) filter (claim_type = 'method') as method, count(*) filter (claim_type = 'finding') as finding from g join {CURRENT.format('claims')} c on c.id = g.id group by 1")
def rendered_types(spark: SparkSession, root: str) -> DataFrame:
    """How many claims of two types each review would show."""
    types = records.current(table(spark, root, "claims").select("id", "claim_type", "loaded_at", "deleted_at")).select("id", "claim_type")
    return evidence.rendered_by_type(greedy_selection(spark, root).join(types, "id"), ["query_id"])


@query(
    """with r as (select query_id, chunk_id, min(case when bm25_rank >= 1 then bm25_rank end) b, min(case when dense_rank >= 1 then dense_rank end) d from search_results where query_id is not null and chunk_id is not null group by all),
    s as (select query_id, chunk_id, b, d, round(coalesce(1.0 / (60 + b), 0) + coalesce(1.0 / (60 + d), 0), 12)::double score from r where b is not null or d is not null)
    select query_id, chunk_id, b as bm25_rank, d as dense_rank, score, n as fused_rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int n from s) where n <= 20"""
)
def fused_ranks(spark: SparkSession, root: str) -> DataFrame:
    """Two rankings of each query, joined in full and fused."""
    df = table(spark, root, "search_results").filter("query_id is not null and chunk_id is not null")
    one = lambda c: df.filter(F.col(c) >= 1).groupBy("query_id", F.col("chunk_id").alias("doc")).agg(F.min(c).alias("rank"))
    return retrieval.fuse(one("bm25_rank"), one("dense_rank"), 20)


@query(
    """with j as (select query_id, list(chunk_id) ids from search_results where final_rank <= 3 and query_id is not null group by 1)
    select query_id, 'repeated_id' as problem from j where len(ids) <> len(list_distinct(ids))"""
)
def judgment_problems(spark: SparkSession, root: str) -> DataFrame:
    """The stored top three of each query taken as judgments: those that name a chunk twice may not be used."""
    top = table(spark, root, "search_results").filter("final_rank <= 3 and query_id is not null")
    return evaluation.check_judgments(top.groupBy("query_id").agg(F.collect_list("chunk_id").alias("relevant_chunk_ids")))


# Reviews -----------------------------------------------------------------------------------------

_EVIDENCE = f"(select * exclude (n) from (select *, row_number() over (partition by evidence_id order by loaded_at desc) n from evidence) where n = 1)"
_STATUS = f"""(select e.review_id, e.evidence_id, e.sentence_index, case when {_KEY.format('e.claim_id')} is null then 'unverifiable' when c.id is null then 'reference_unresolved' when coalesce(c.verbatim, c.text) = e.passage then 'verified' else 'exists_no_support' end status
  from {_EVIDENCE} e left join {LATEST.format('claims')} c on c.id = {_KEY.format('e.claim_id')})"""


def _statuses(spark: SparkSession, root: str) -> DataFrame:
    """One row per evidence with a status by its claim: unknown, another passage, or the quoted one."""
    e = records.latest(table(spark, root, "evidence").select("review_id", "evidence_id", "sentence_index", "claim_id", "passage", "loaded_at"), "evidence_id").withColumn("key", canonical_id("claim_id"))
    c = records.latest(table(spark, root, "claims").select("id", "text", "verbatim", "loaded_at")).select(F.col("id").alias("key"), F.coalesce("verbatim", "text").alias("source"), F.lit(True).alias("known"))
    status = F.when(F.col("key").isNull(), "unverifiable").when(F.col("known").isNull(), "reference_unresolved").when(F.col("source") == F.col("passage"), "verified").otherwise("exists_no_support")
    return e.join(c, "key", "left").select("review_id", "evidence_id", "sentence_index", status.alias("status"))


_C = lambda s: f"count(*) filter (status = '{s}')"


@query(
    f"""with n as (select review_id, count(status) as n_citations, {_C('verified')} as n_verified, {_C('exists_no_support')} as n_unsupported, {_C('contradicted')} as n_contradicted, {_C('hallucinated')} as n_hallucinated, {_C('unverifiable')} as n_unverifiable, {_C('reference_unresolved')} as n_reference_unresolved from {_STATUS} group by 1),
    v as (select *, n_verified + n_unsupported + n_contradicted as n_nli_verdicts, n_verified + n_unsupported + n_contradicted + n_reference_unresolved + n_hallucinated as n_evaluated from n)
    select *, case when n_citations = 0 then 0 else round(n_nli_verdicts / n_citations, 6) end::double as nli_coverage, case when n_nli_verdicts = 0 then 0 else round(n_verified / n_nli_verdicts, 6) end::double as nli_support_rate,
      case when n_citations = 0 then 0 else round(n_evaluated / n_citations, 6) end::double as verification_coverage, case when n_evaluated = 0 then 0 else round(n_verified / n_evaluated, 6) end::double as evaluated_support_rate,
      case when n_citations = 0 then 0 else round(n_verified / n_citations, 6) end::double as overall_support_rate, case when n_citations = 0 then 0 else round(n_hallucinated / n_citations, 6) end::double as overall_hallucination_rate from v"""
)
def status_accounting(spark: SparkSession, root: str) -> DataFrame:
    return review.status_accounting(_statuses(spark, root), "review_id")


@query(
    f"""select review_id, case when count(*) filter (sentence_index % 2 = 1) = 0 then 0 else round(count(*) filter (sentence_index % 2 = 1 and status = 'hallucinated') / count(*) filter (sentence_index % 2 = 1), 6) end::double as invented_rate,
    case when count(*) filter (status in ('verified', 'exists_no_support', 'contradicted')) = 0 then 0 else round({_C('verified')} / count(*) filter (status in ('verified', 'exists_no_support', 'contradicted')), 6) end::double as support_rate from {_STATUS} group by 1"""
)
def audit_rates(spark: SparkSession, root: str) -> DataFrame:
    """Odd sentences taken as audited by a person."""
    entries = _statuses(spark, root).withColumn("auditor", F.when(F.col("sentence_index") % 2 == 1, "person").otherwise("auto_nli"))
    return review.audit_rates(entries, "review_id")


@query(
    f"""with p as (select review_id, sentence_index, row_number() over (partition by review_id, sentence_index order by evidence_id) n, c.extraction_confidence e, 1 - c.extraction_confidence d from {_EVIDENCE} v left join {LATEST.format('claims')} c on c.id = {_KEY.format('v.claim_id')}),
    s as (select *, case when e is null then null when e >= 0.5 then 'verified' when d >= 0.4 then 'contradicted' else 'exists_no_support' end s from p where n <= 3)
    select review_id, sentence_index, case when bool_or(s = 'verified') then 'verified' when bool_or(s = 'contradicted') then 'contradicted' when bool_or(s = 'exists_no_support') then 'exists_no_support' else 'unverifiable' end as status, max(e) as score from s group by all"""
)
def verdict_fold(spark: SparkSession, root: str) -> DataFrame:
    """A claim's confidence taken as entailment, its complement as contradiction."""
    e = records.latest(table(spark, root, "evidence").select("review_id", "sentence_index", "evidence_id", "claim_id", "loaded_at"), "evidence_id").withColumn("id", canonical_id("claim_id"))
    c = records.latest(table(spark, root, "claims").select("id", "extraction_confidence", "loaded_at")).select("id", "extraction_confidence")
    premises = e.join(c, "id", "left").select("review_id", "sentence_index", F.col("evidence_id").alias("premise_order"), F.col("extraction_confidence").alias("entailment"), (1 - F.col("extraction_confidence")).alias("contradiction"))
    return review.fold_verdicts(premises, ["review_id", "sentence_index"])


@query("select review_id, evidence_id from (select *, row_number() over (partition by review_id order by loaded_at desc, evidence_id) n from evidence) where n = 1")
def latest_evidence(spark: SparkSession, root: str) -> DataFrame:
    return review.newest(table(spark, root, "evidence"), "review_id", F.col("loaded_at").desc(), F.col("evidence_id")).select("review_id", "evidence_id")


_STRIP = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


@query(
    f"""with e as (select review_id, sentence_index, article_id aid, {_KEY.format('claim_id')} cid, {_STRIP("coalesce(passage, '')")} passage from {_EVIDENCE} where review_id is not null and article_id is not null),
    s as (select review_id, sentence_index, list_distinct(list(aid)) cits, list_sort(list_distinct(list(cid) filter (cid is not null))) sup from e group by all),
    t as (select review_id, sentence_index, unnest(cits) aid, sup from s),
    p as (select review_id, sentence_index, aid, unnest(case when len(sup) = 0 or sup is null then [null] else sup end) cid, unnest(case when len(sup) = 0 or sup is null then [0] else range(len(sup)) end) o from t),
    c as (select id, {_KEY.format('article_id')} ca, {_STRIPPED} src from {LATEST.format('claims')}),
    i as (select review_id, sentence_index, aid, cid, count(*) n, bool_and(passage = src) same from e join c on c.id = e.cid group by all),
    j as (select p.*, a.id is not null known, c.id is not null there, src, coalesce(ca = p.aid, false) own, coalesce(i.n > 0 and i.same, false) quoted from p left join {LATEST.format('articles')} a on a.id = p.aid left join c on c.id = p.cid left join i on i.review_id = p.review_id and i.sentence_index = p.sentence_index and i.aid = p.aid and i.cid = p.cid),
    r as (select *, own and quoted m, row_number() over (partition by review_id, sentence_index, aid order by own and quoted desc, o) n from j),
    v as (select *, case when m and n <= 3 and src <> '' then length(src) % 10 / 10 end ent, case when m and n <= 3 and src <> '' then length(src) % 7 / 10 end con from r),
    f as (select review_id, sentence_index, aid, any_value(known) known, count(cid) claims, bool_or(cid is not null and not there) missing, bool_or(own and not quoted) invalid, bool_or(m) matching, coalesce(bool_or(ent >= 0.5), false) ver, coalesce(bool_or(ent < 0.5 and con >= 0.4), false) contra, coalesce(bool_or(ent < 0.5 and con < 0.4), false) nos, max(ent) score from v group by all)
    select review_id, sentence_index, aid as article_id, case when not known then 'reference_unresolved' when claims = 0 or invalid then 'unverifiable' when not matching then case when missing then 'unverifiable' else 'exists_no_support' end when ver then 'verified' when contra then 'contradicted' when nos then 'exists_no_support' else 'unverifiable' end as status,
      case when not known then 0 when claims = 0 or invalid or not matching then null else score end::double as score from f"""
)
def review_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """The cited articles of each review sentence against their claims, a premise's length standing for a model."""
    e = records.latest(table(spark, root, "evidence"), "evidence_id").filter("review_id is not null and article_id is not null").withColumn("claim_id", canonical_id("claim_id"))
    item = F.struct("claim_id", "article_id", F.coalesce("passage", F.lit("")).alias("passage"))
    by_sentence = e.groupBy("review_id", "sentence_index").agg(F.collect_set("article_id").alias("citations"), F.sort_array(F.collect_set("claim_id")).alias("supporting_claim_ids"), F.collect_list(item).alias("evidence"))
    sentence = F.struct("sentence_index", F.concat(F.lit("Sentence "), "sentence_index").alias("text"), "citations", "supporting_claim_ids", "evidence")
    made = by_sentence.groupBy(F.col("review_id").alias("id")).agg(F.sort_array(F.collect_list(sentence)).alias("sentences"))
    own = records.latest(table(spark, root, "claims").select("id", "article_id", "text", "verbatim", "loaded_at")).withColumn("article_id", canonical_id("article_id"))
    articles = records.latest(table(spark, root, "articles").select("id", "loaded_at"))
    share = lambda p, n: F.char_length(p) % n / 10
    judged = reviews.verdicts(made, own, articles, lambda p, h: F.struct(share(p, 10).alias("entailment"), share(p, 7).alias("contradiction")))
    numbers = made.select(F.col("id").alias("review_id"), F.posexplode("sentences").alias("at", "s")).select("review_id", F.col("at").alias("sentence_index"), F.col("s.sentence_index").alias("number"))
    return judged.join(numbers, ["review_id", "sentence_index"]).select("review_id", F.col("number").alias("sentence_index"), "article_id", "status", "score")


_LATIN = lambda x: f"regexp_replace(translate({x}, '{L.ACCENTS}', '{L.PLAIN}'), '[^A-Za-z0-9]', '', 'g')"
_BIB = f"""(select id, case when name = '' then 'Unknown' else name end || coalesce(year, 0) || case when word = '' then 'X' else word end key from (select id, year, {_LATIN("case when contains(au, ',') then string_split(au, ',')[1] else regexp_extract(trim(au), '([^ ]*)$', 1) end")} name,
  {_LATIN("coalesce(list_filter(regexp_extract_all(coalesce(title, ''), '[A-Za-zÀ-ÿ0-9]+'), lambda w: lower(w) not in ('a', 'an', 'the', 'of', 'for', 'on', 'in'))[1], 'X')")} word from (select *, coalesce(authors[1], 'Unknown') au from {LATEST.format('articles')})))"""


@query(f"select id, key || case when n = 0 then '' when n <= 26 then chr((n + 96)::int) else '_' || n end as bibtex_key from (select *, row_number() over (partition by key order by id) - 1 n from {_BIB})")
def bibtex_keys(spark: SparkSession, root: str) -> DataFrame:
    return review.unique_keys(records.latest(table(spark, root, "articles").select("id", "authors", "year", "title", "loaded_at")))


_ESCAPED = lambda x: "array_to_string(list_transform(string_split(" + x + ", ''), lambda y: coalesce([" + listed(review.LATEX.values()) + "][list_position([" + listed(review.LATEX) + "], y)], y)), '')"
_FIELD = lambda name, value: "case when " + value + " <> '' then '  " + name + " = {' || " + _ESCAPED(value) + " || '},' end"
_VENUE = "coalesce(venue_name, source.venue, 'Other')"
_BIB_LINES = ", ".join(
    (
        "'@' || kind || '{' || bibtex_key || ','", "'  title     = {' || " + _ESCAPED("title") + " || '},'", "'  author    = {' || array_to_string(list_transform(authors, lambda a: " + _ESCAPED("a") + "), ' and ') || '},'",
        "'  year      = {' || year || '},'", _FIELD("booktitle", "case when kind = 'inproceedings' then " + _VENUE + " end"), _FIELD("journal  ", "case when kind = 'article' then " + _VENUE + " end"), _FIELD("eprint   ", "source.arxiv_id"),
        _FIELD("archivePrefix", "case when kind = 'misc' then 'arXiv' end"), _FIELD("howpublished", r"case when kind = 'misc' then '\url{https://arxiv.org/abs/' || source.arxiv_id || '}' end"), _FIELD("doi      ", "source.doi"), _FIELD("url      ", "source.url"), "'}'",
    )
)


@query(f"with k as ({SQL['bibtex_keys']}) select id, bibtex_key, concat_ws(chr(10), {_BIB_LINES}) as entry from (select *, case when source.arxiv_id is not null then 'misc' when source.acl_id is not null then 'inproceedings' else 'article' end kind from {LATEST.format('articles')}) join k using (id)")
def bibtex_entries(spark: SparkSession, root: str) -> DataFrame:
    return review.bibtex(records.latest(table(spark, root, "articles").select("id", "authors", "year", "title", "source", "venue_name", "loaded_at")))


# Evaluation --------------------------------------------------------------------------------------

_RELEVANT = f"(select query_id, chunk_id from {_FUSED} where fused_rank <= 3)"
_QUALITY = f"""(select m, query_id, round(coalesce(hits, 0) / size, 9) recall, coalesce(round(1.0 / best, 9), 0)::double rr from (select m, query_id, count(*) size from {_RELEVANT}, (values ('bm25'), ('dense'), ('final')) t(m) group by all)
  left join (select m, query_id, count(distinct chunk_id) hits, min(r) best from (select 'bm25' m, query_id, chunk_id, bm25_rank r from {_RESULTS} union all select 'dense', query_id, chunk_id, dense_rank from {_RESULTS} union all select 'final', query_id, chunk_id, final_rank from {_RESULTS})
    semi join {_RELEVANT} using (query_id, chunk_id) where r <= 10 group by all) using (m, query_id))"""


def _quality(spark: SparkSession, root: str) -> DataFrame:
    """Recall and reciprocal rank at 10 of three rankings, the three best fused chunks taken as relevant."""
    results = _results(spark, root)
    wanted = retrieval.reciprocal_rank_fusion(results, ["bm25_rank", "dense_rank"], 3).select("query_id", F.col("chunk_id").alias("doc"))
    parts = [evaluation.per_query(results.select("query_id", F.col("chunk_id").alias("doc"), F.col(r).alias("rank")), wanted, 10).withColumn("method", F.lit(m)) for m, r in (("bm25", "bm25_rank"), ("dense", "dense_rank"), ("final", "final_rank"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"select m as method, query_id, recall, rr from {_QUALITY}")
def recall_mrr(spark: SparkSession, root: str) -> DataFrame:
    return _quality(spark, root)


@query(f"select m as method, count(*) as n, round(avg(rr), 6) as mean, round(coalesce(stddev_samp(rr), 0), 6) as std from {_QUALITY} group by 1")
def metric_mean_std(spark: SparkSession, root: str) -> DataFrame:
    return evaluation.mean_std(_quality(spark, root), "method", "rr")


@query(f"with a as (select m, round(avg(recall), 6) v from {_QUALITY} group by 1) select m as method, round(v - (select v from a where m = 'final'), 6) as delta from a where m <> 'final'")
def ablation_delta(spark: SparkSession, root: str) -> DataFrame:
    return evaluation.ablation(evaluation.mean_std(_quality(spark, root), "method", "recall"), "method", "final")


@query(
    "select date_trunc('hour', ts) as hour, event_type, count(*) as n, count(distinct user_id) as users, round(sum(value), 4) as total from events group by all"
)
def event_hours(spark: SparkSession, root: str) -> DataFrame:
    """The status log by hour and type."""
    return table(spark, root, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))
