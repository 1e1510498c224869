"""Queries of the corpus operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import identifiers as I
from corpuscle.functions import lexicons as L
from corpuscle.functions import text as T
from corpuscle.operators import chunking, citations, claims, corpus, licences, records
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


def listed(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


LATEST = "(select * exclude (n) from (select *, row_number() over (partition by id order by loaded_at desc nulls last) n from {0} where id is not null) where n = 1)"
CURRENT = "(select * from " + LATEST + " where deleted_at is null)"
TOKENS = r"list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+(?:[-''][a-z0-9]+)*'), lambda t: length(t) > 1 and t not in (" + listed(L.STOP_WORDS) + "))"
_URL_HOST = r"nullif(lower(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"


@query(f"select id, id as article_id, title, year from {CURRENT.format('articles')}")
def current_articles(spark: SparkSession, root: str) -> DataFrame:
    df = records.current(table(spark, root, "articles"))
    return df.select("id", F.col("id").alias("article_id"), "title", "year")


@query(f"select year, source.venue as venue, count(*) as n from {CURRENT.format('articles')} group by all")
def year_venue_counts(spark: SparkSession, root: str) -> DataFrame:
    df = records.current(table(spark, root, "articles").select("id", "year", "source.venue", "loaded_at", "deleted_at"))
    return df.groupBy("year", "venue").agg(F.count("*").alias("n"))


@query(
    f"""select count(*) as records, count(distinct id) as unique_ids, count(d) as with_doi, count(distinct d) as unique_dois,
    count(*) filter (abstract is null or trim(abstract) = '') as missing_abstracts, count(*) filter (source.url is null or trim(source.url) = '') as missing_urls,
    count(*) filter ((source.pdf_url is null or trim(source.pdf_url) = '') and (source.arxiv_id is null or trim(source.arxiv_id) = '')) as without_pdf_source,
    count(*) filter (e) as licence_identified, count(*) filter (e and source.license.evidence = 'openalex') as licence_explicit, count(*) filter (e and source.license.evidence = 'acl_policy') as licence_inferred,
    count(*) filter (source.license is null) as missing_licences, count(*) filter (not coalesce(e, false)) as licence_unknown, count(*) filter (source.license.policy_conflict is not null) as policy_conflicts
    from (select *, source.license.family <> 'unknown' and source.license.evidence in ('openalex', 'acl_policy') and source.license.policy_conflict is null as e,
      nullif(lower(trim(regexp_replace(regexp_replace(trim(source.doi), '(?i)^doi:\\s*', ''), '(?i)^https?://(?:dx\\.)?doi\\.org/', ''))), '') as d from {LATEST.format('articles')})"""
)
def corpus_statistics(spark: SparkSession, root: str) -> DataFrame:
    return corpus.statistics(records.latest(table(spark, root, "articles")))


@query(f"select coalesce(source.license.family, 'unknown') as family, count(*) as n from {LATEST.format('articles')} group by 1")
def licence_families(spark: SparkSession, root: str) -> DataFrame:
    return corpus.licence_families(records.latest(table(spark, root, "articles").select("id", "source", "loaded_at")))


@query(f"select count(*) filter (id in (select article_id from provenance_records)) as with_provenance, count(*) filter (id not in (select article_id from provenance_records where article_id is not null)) as without_provenance from {LATEST.format('articles')}")
def provenance_split(spark: SparkSession, root: str) -> DataFrame:
    return corpus.provenance_split(records.latest(table(spark, root, "articles").select("id", "loaded_at")), table(spark, root, "provenance_records").select("article_id"))


@query(f"select id, cited_by_count from {CURRENT.format('articles')} order by cited_by_count desc nulls last, id limit 20")
def most_cited(spark: SparkSession, root: str) -> DataFrame:
    """The twenty most cited articles."""
    return corpus.most_cited(records.current(table(spark, root, "articles").select("id", "cited_by_count", "loaded_at", "deleted_at")), 20).select("id", "cited_by_count")


@query(f"select lower(trim(metric_name)) as metric_name, count(*) as n from {CURRENT.format('claims')} where trim(metric_name) <> '' group by 1 order by n desc, 1 limit 5")
def top_metric_names(spark: SparkSession, root: str) -> DataFrame:
    return claims.top_metric_names(records.current(table(spark, root, "claims").select("id", "metric_name", "loaded_at", "deleted_at")))


_PERMISSIONS = ", ".join(f"('{f}', '{r[0]}', '{c[0]}', '{a[0]}')" for f, (r, c, a) in licences.PROFILES.items())


@query(
    f"""select coalesce(r, 'unknown') as redistribution, coalesce(c, 'unknown') as commercial_use, coalesce(a, 'unknown') as adaptations, count(*) as n
    from {LATEST.format('articles')} left join (values {_PERMISSIONS}) t(f, r, c, a) on f = replace(source.license.family, '_', '-') group by all"""
)
def permission_profile(spark: SparkSession, root: str) -> DataFrame:
    """What the licences of the articles permit; the tables spell families with underscores."""
    df = records.latest(table(spark, root, "articles").select("id", F.translate("source.license.family", "_", "-").alias("family"), "loaded_at"))
    names = ("redistribution", "commercial_use", "adaptations")
    return licences.with_permissions(df).select(*(F.col(f"{c}.outcome").alias(c) for c in names)).groupBy(*names).agg(F.count("*").alias("n"))


_LICENCES = ", ".join(f"('{k}', '{v[0]}', {repr(v[1]) if v[1] else 'null'})" for k, v in L.LICENCES.items())


@query(
    f"""with l as (select * from (values {_LICENCES}) t(k, family, spdx)), r as (select unnest(locations) x from provenance_records)
    select coalesce(family, 'unknown') as family, spdx as spdx_id, count(*) as n from r left join l on lower(trim(x.license.raw_string)) = k where x.license is not null group by all"""
)
def licence_names(spark: SparkSession, root: str) -> DataFrame:
    places = table(spark, root, "provenance_records").select(F.explode("locations").alias("x")).filter("x.license is not null")
    return places.select(I.licence("x.license.raw_string").alias("l")).groupBy(F.col("l.family").alias("family"), F.col("l.spdx_id").alias("spdx_id")).agg(F.count("*").alias("n"))


@query(f"select host, count(*) as n from (select {_URL_HOST.format('canonical_record_url')} as host from provenance_records) where host is not null group by all")
def url_hosts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "provenance_records").select(I.host(F.trim("canonical_record_url")).alias("host")).filter("host is not null").groupBy("host").agg(F.count("*").alias("n"))


@query(
    r"""select distinct record_id, nullif(lower(trim(regexp_replace(regexp_replace(regexp_replace(doi, '^[\s\x{A0}\x{3000}]+|[\s\x{A0}\x{3000}]+$', '', 'g'), '(?i)^doi:\s*', ''), '(?i)^https?://(?:dx\.)?doi\.org/', ''))), '') as doi from provenance_records"""
)
def doi_normalize(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "provenance_records").select("record_id", I.doi("doi").alias("doi")).distinct()


@query(r"select id, nullif(regexp_extract(coalesce(source.arxiv_id, source.url), '(?:^|[^0-9])([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?(?:[^0-9]|$)', 1), '') as arxiv_id from " + LATEST.format("articles"))
def arxiv_extract(spark: SparkSession, root: str) -> DataFrame:
    df = records.latest(table(spark, root, "articles").select("id", "source", "loaded_at"))
    return df.select("id", I.arxiv_id(F.coalesce("source.arxiv_id", "source.url")).alias("arxiv_id"))


@query(f"select id, substring(md5(coalesce(nullif(source.acl_id, ''), nullif(source.arxiv_id, ''), id)), 1, 8) as corpus_id from {LATEST.format('articles')}")
def corpus_id_md5(spark: SparkSession, root: str) -> DataFrame:
    df = records.latest(table(spark, root, "articles").select("id", "source", "loaded_at"))
    return df.select("id", I.corpus_id(F.col("source.acl_id"), F.col("source.arxiv_id"), F.col("id")).alias("corpus_id"))


@query(
    f"""with h as (select id, sha1(unhex(replace(section_id, '-', '')) || encode('chunk:' || chunk_index)) h from {LATEST.format('chunks')})
    select id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || lower(hex(('0x' || substring(h, 17, 1))::int % 4 + 8)) || substring(h, 18, 3) || '-' || substring(h, 21, 12) as uuid from h"""
)
def uuid5_ids(spark: SparkSession, root: str) -> DataFrame:
    df = records.latest(table(spark, root, "chunks").select("id", "section_id", "chunk_index", "loaded_at"))
    return df.select("id", I.uuid5(F.col("section_id"), F.concat(F.lit("chunk:"), F.col("chunk_index").cast("string"))).alias("uuid"))


@query(
    r"""with w as (select id, string_split(abstract, ' ') w from """ + LATEST.format("articles") + r""" where abstract is not null)
    select id, array_to_string(list_filter(w, lambda x: x <> ''), ' ') as abstract from w"""
)
def rebuild_abstracts(spark: SparkSession, root: str) -> DataFrame:
    """Abstracts turned into word positions and back."""
    df = records.latest(table(spark, root, "articles").select("id", "abstract", "loaded_at")).filter("abstract is not null")
    words = df.select("id", F.posexplode(F.filter(F.split("abstract", " "), lambda w: w != "")).alias("at", "word"))
    index = words.groupBy("id", "word").agg(F.collect_list("at").alias("places")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))
    return df.select("id").join(index, "id", "left").select("id", corpus.rebuild_abstract("index").alias("abstract"))


_VENUES = " ".join(f"when regexp_matches(n, '{p}') then '{v}'" for v, p, _ in I._VENUE_NAMES)


@query(f"select id, case {_VENUES} when not contains(n, 'anthology') and (regexp_matches(n, '{I._ACL_MEETING}') or regexp_matches(n, '\\bacl\\b')) then 'acl' end as venue from (select id, lower(coalesce(venue_name, source.venue)) n from {LATEST.format('articles')})")
def venue_detect(spark: SparkSession, root: str) -> DataFrame:
    df = records.latest(table(spark, root, "articles").select("id", "venue_name", "source", "loaded_at"))
    return df.select("id", I.venue_of_text(F.coalesce("venue_name", "source.venue")).alias("venue"))


@query("select record_id, len(list_distinct(locations)) as n from (select *, row_number() over (partition by record_id order by loaded_at) k from provenance_records) where k = 1 and locations is not null")
def distinct_locations(spark: SparkSession, root: str) -> DataFrame:
    df = records.first_by(table(spark, root, "provenance_records"), "record_id", F.col("loaded_at")).filter("locations is not null")
    return df.select("record_id", F.size(corpus.all_locations(F.col("locations"))).cast("bigint").alias("n"))


# Chunks ------------------------------------------------------------------------------------------


# White space as Python strips it.
_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(
    f"""with recursive d as (select doc_id, text t, length(text) n from documents where text is not null and not regexp_matches(text, '^{_WS}*$')),
    w as (
      select doc_id, 0::bigint s, 0::bigint e, 0::bigint nxt from d
      union all
      select doc_id, s, e, case when f <= s then s + {chunking.SIZE - chunking.OVERLAP} else f end from (
        select doc_id, s, e, case when e - {chunking.OVERLAP} <= s then e - {chunking.OVERLAP} else least(e, case when regexp_matches(tail, '{_WS}') then e - {chunking.OVERLAP} + greatest(0, length(regexp_extract(tail, '(?s)^(.*?){_WS}', 0)) - 2) else e end) end f from (
          select *, substring(t, (e - {chunking.OVERLAP})::int, {chunking.OVERLAP} + 1) tail from (select *, case when e0 >= n then n when length(regexp_extract(win, '(?s)^.*[.!?\n]')) > 0 then low + length(regexp_extract(win, '(?s)^.*[.!?\n]'))
            when length(regexp_extract(win, '(?s)^.* ')) > 0 and low + length(regexp_extract(win, '(?s)^.* ')) - 1 > s then low + length(regexp_extract(win, '(?s)^.* ')) - 1 else e0 end e from (
            select *, substring(t, (low + 1)::int, (e0 - low)::int) win from (
              select doc_id, t, n, nxt s, least(nxt + {chunking.SIZE}, n) e0, greatest(nxt + 1, least(nxt + {chunking.SIZE}, n) - {chunking.REACH}) low from w join d using (doc_id) where nxt < n)))))),
    c as (select w.doc_id, s + length(x) - length(regexp_replace(x, '^{_WS}+', '')) a, s + length(regexp_replace(x, '{_WS}+$', '')) b from (select w.*, substring(t, (s + 1)::int, (e - s)::int) x from w join d using (doc_id) where e > 0) w)
    select doc_id, (row_number() over (partition by doc_id order by a, b) - 1)::int as chunk_index, a::int as char_start, b::int as char_end, ((b - a) // 4)::int as token_count from c where b - a >= {chunking.LEAST}"""
)
def chunk_documents(spark: SparkSession, root: str) -> DataFrame:
    return chunking.chunk(table(spark, root, "documents"), "doc_id").select("doc_id", "chunk_index", "char_start", "char_end", "token_count")


@query(f"select section_type, count(*) as chunks, count(distinct article_id) as articles, sum(length(text) // 4)::bigint as tokens from {CURRENT.format('chunks')} group by all")
def chunk_stats(spark: SparkSession, root: str) -> DataFrame:
    df = records.current(table(spark, root, "chunks"))
    return df.groupBy("section_type").agg(F.count("*").alias("chunks"), F.count_distinct("article_id").alias("articles"), F.sum(F.floor(F.char_length("text") / 4)).alias("tokens"))


_SECTIONS = " ".join(f"when regexp_matches(h, '{p}') then '{t}'" for p, t in L.SECTION_PATTERNS)


@query(rf"with h as (select lower(trim(regexp_replace(regexp_extract(text, '^\s*([^\n]*)', 1), '^[0-9]+\.[0-9]+\s+', ''))) h from {LATEST.format('chunks')} where text is not null) select case {_SECTIONS} else 'other' end as detected, count(*) as n from h group by all")
def section_types(spark: SparkSession, root: str) -> DataFrame:
    """The types that the first lines of chunks tell as headings."""
    df = records.latest(table(spark, root, "chunks").select("id", "text", "loaded_at")).filter("text is not null")
    head = F.trim(F.regexp_replace(F.regexp_extract("text", r"^\s*([^\n]*)", 1), r"^[0-9]+\.[0-9]+\s+", ""))
    return df.select(T.section_type(head).alias("detected")).groupBy("detected").agg(F.count("*").alias("n"))


@query(f"select c.id from {LATEST.format('chunks')} c where c.id not in (select {r'''coalesce(lower(trim(chunk_id)), '')'''} from claims)")
def chunks_without_claims(spark: SparkSession, root: str) -> DataFrame:
    """The chunks a resumed claim extraction still has to do."""
    df = records.latest(table(spark, root, "chunks").select("id", "loaded_at"))
    done = table(spark, root, "claims").select(F.lower(F.trim("chunk_id")).alias("id")).filter("id is not null")
    return records.unseen(df, done, "id").select("id")


@query("select distinct article_id as id from chunks where article_id is not null")
def seen_articles(spark: SparkSession, root: str) -> DataFrame:
    return records.seen_manifest(table(spark, root, "chunks"), "article_id").select(F.col("article_id").alias("id"))


_UUID5 = lambda parent, name: f"(select substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || lower(hex(('0x' || substring(h, 17, 1))::int % 4 + 8)) || substring(h, 18, 3) || '-' || substring(h, 21, 12) from (select sha1(unhex(replace({parent}, '-', '')) || encode({name})) h))"


@query(f"select {_UUID5('id', chr(39) + 'section:0' + chr(39))} as section_id, id as article_id, 'abstract' as section_type, 0 as char_start, length(abstract)::int as char_end from {CURRENT.format('articles')} where trim(abstract) <> ''")
def abstract_sections(spark: SparkSession, root: str) -> DataFrame:
    df = records.current(table(spark, root, "articles").select("id", "abstract", "loaded_at", "deleted_at"))
    return chunking.abstract_sections(df).drop("text")


@query(
    f"""with a as {LATEST.format('articles')}, i as (select openalex_id p, min(id) t from a where openalex_id is not null group by 1),
    r as (select id, unnest(referenced_works) ref, unnest(generate_series(0, len(referenced_works) - 1))::int pos from a)
    select {_UUID5('r.id', "'citation:' || pos")} as id, r.id as source_article_id, t as target_article_id, ref as target_raw_ref, '{citations.CONTEXT}' as context_sentence, '{citations.FUNCTION}' as function from r left join i on p = regexp_extract(ref, '([^/]*)$', 1)"""
)
def citation_records(spark: SparkSession, root: str) -> DataFrame:
    """The citations that the articles' reference lists tell, as records."""
    df = records.latest(table(spark, root, "articles").select("id", "openalex_id", "referenced_works", "loaded_at"))
    return citations.citation_records(citations.references(df)).drop("function_confidence", "chunk_id")


@query(
    f"""with l as (select * from (values {_LICENCES}) t(k, family, spdx)), r as (select unnest(locations) x from provenance_records),
    n as (select r.x, coalesce(family, 'unknown') family, spdx from r left join l on lower(trim(r.x.license.raw_string)) = k)
    select family, spdx as spdx_id, case when family <> 'unknown' then 'openalex' else 'unknown' end as evidence, count(*) as n, count(x.license.raw_string) as named from n group by all"""
)
def licence_evidence(spark: SparkSession, root: str) -> DataFrame:
    """The licences of all recorded copies by their names and pages; no page of the tables lies under a policy."""
    copies = table(spark, root, "provenance_records").select(F.explode("locations").alias("x"))
    found = licences.with_evidence(F.col("x.license.raw_string"), F.col("x.landing_page_url"), licences.policy_id(F.col("x.landing_page_url"), F.lit("acl"), F.lit(2023)))
    return copies.select(found.alias("l")).groupBy("l.family", "l.spdx_id", "l.evidence").agg(F.count("*").alias("n"), F.count("l.raw_string").alias("named"))


@query(f"select id, nullif(regexp_extract(trim(openalex_id), '^(?:https?://(?:www\\.)?openalex\\.org/)?(W\\d+)$', 1), '') as provider_id, coalesce(nullif(trim(source.pdf_url), ''), 'https://arxiv.org/pdf/' || source.arxiv_id) as pdf_source from {LATEST.format('articles')}")
def provider_ids(spark: SparkSession, root: str) -> DataFrame:
    df = records.latest(table(spark, root, "articles").select("id", "openalex_id", "source", "loaded_at"))
    return df.select("id", I.provider_id("openalex_id").alias("provider_id"), I.pdf_source(F.col("source.pdf_url"), F.col("source.arxiv_id")).alias("pdf_source"))


@query(f"select article_id as id, string_agg(text, chr(10) order by id, text) as body, count(*) as n from {CURRENT.format('chunks')} where article_id is not null and text is not null group by 1")
def article_texts(spark: SparkSession, root: str) -> DataFrame:
    """The texts of each article's chunks in the order of their ids."""
    df = records.current(table(spark, root, "chunks").select("id", "article_id", "text", "loaded_at", "deleted_at")).filter("text is not null")
    return records.grouped(df, "article_id", "text", "id").select(F.col("article_id").alias("id"), F.array_join("values", "\n").alias("body"), F.size("values").cast("bigint").alias("n"))


# Text --------------------------------------------------------------------------------------------


@query(f"with t as (select section_type, unnest({TOKENS.format('text')}) t from {LATEST.format('chunks')} where text is not null) select section_type, count(*) as tokens, count(distinct t) as distinct_tokens from t group by all")
def token_stats(spark: SparkSession, root: str) -> DataFrame:
    df = records.latest(table(spark, root, "chunks").select("id", "section_type", "text", "loaded_at")).filter("text is not null")
    return df.select("section_type", F.explode(T.tokens("text")).alias("t")).groupBy("section_type").agg(F.count("*").alias("tokens"), F.count_distinct("t").alias("distinct_tokens"))


@query(f"with t as (select doc_id, unnest({TOKENS.format('text')}) t from documents where text is not null) select t as token, count(*) as tf, count(distinct doc_id) as df from t group by all")
def vocabulary(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "documents").filter("text is not null")
    per = df.select("doc_id", F.explode(T.tokens("text")).alias("token")).groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


_ONE, _TO, _SEVERAL = T.folds()
_MARKLESS = f"regexp_replace(lower(x), '[{T.ARABIC_MARKS}\\x{{300}}-\\x{{36f}}]', '', 'g')"
_SHORT = f"replace(translate({_MARKLESS}, '{T.short_folds()[0]}', '{T.short_folds()[1]}'), 'ß', 'ss')"
_SPELLED = f"[{listed(_SEVERAL.values())}][list_position([{listed(_SEVERAL)}], y)]"
_LONG = f"array_to_string(list_transform(string_split(translate({_MARKLESS}, '{_ONE}', '{_TO}'), ''), lambda y: coalesce({_SPELLED}, y)), '')"
_TERM = r"[\p{L}\p{N}]+(?:[" + T.ARABIC_MARKS + r"][\p{L}\p{N}]+)*"
_FOUND = "regexp_extract_all(coalesce({0}, ''), '" + _TERM + "')"
TERMS = "list_distinct(case when regexp_matches(lower({0}), '" + T.unusual() + "') then list_transform(" + _FOUND + ", lambda x: " + _LONG + ") else list_transform(" + _FOUND + ", lambda x: " + _SHORT + ") end)"
QUERY_TERMS = "list_filter(" + TERMS + ", lambda t: length(t) > 1 and t not in (" + listed(L.QUERY_STOP_WORDS) + "))"


@query(
    f"select language, count(*) as n from (select case when regexp_matches(text, '[\\x{{600}}-\\x{{6ff}}\\x{{750}}-\\x{{77f}}\\x{{8a0}}-\\x{{8ff}}]') then 'ar' when regexp_matches(text, '[À-ÖØ-öø-ÿ]') or list_has_any({TERMS.replace('{0}', 'text')}, [{listed(L.FRENCH_HINTS)}]) then 'fr' else 'en' end as language from documents where text is not null) group by all"
)
def query_languages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").filter("text is not null").select(T.query_language("text").alias("language")).groupBy("language").agg(F.count("*").alias("n"))


@query(f"select query_id, list_sort({QUERY_TERMS.replace('{0}', 'query')}) as terms from (select distinct query_id, query from search_results)")
def query_term_sets(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "search_results").select("query_id", "query").distinct()
    return df.select("query_id", F.array_sort(T.query_terms("query")).alias("terms"))


@query(
    f"""with t as (select id, title x from {LATEST.format('articles')} where title is not null)
    select id, left(regexp_replace(regexp_replace(regexp_replace({_LONG}, '[^\\x00-\\x7f]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) as slug,
      array_to_string(list_transform(regexp_extract_all(lower(x), '\\p{{L}}+|\\P{{L}}+'), lambda y: upper(left(y, 1)) || y[2:]), '') as title from t"""
)
def title_forms(spark: SparkSession, root: str) -> DataFrame:
    df = records.latest(table(spark, root, "articles").select("id", "title", "loaded_at")).filter("title is not null")
    return df.select("id", T.slug("title").alias("slug"), T.title_case("title").alias("title"))


@query(r"select key, count(*) as n, min(id) as first_id from (select id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as key from " + LATEST.format("claims") + r" where text is not null) where key <> '' group by all having count(*) > 1")
def equal_text_claims(spark: SparkSession, root: str) -> DataFrame:
    df = records.latest(table(spark, root, "claims").select("id", "text", "loaded_at")).filter("text is not null")
    return df.withColumn("key", T.folded_key("text")).filter("key <> ''").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


# Graph -------------------------------------------------------------------------------------------

_KEY = r"nullif(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^urn:uuid:|^\{{|\}}$', '', 'g'), '')"
_CITATIONS = "(select * exclude (n) from (select *, row_number() over (partition by id order by loaded_at desc) n from citations) where n = 1)"
_EDGES = f"(select source_article_id as source_id, {_KEY.format('target_article_id')} as target_id, count(*) as count from {_CITATIONS} where source_article_id is not null and {_KEY.format('target_article_id')} is not null group by all)"


def _citations(spark: SparkSession, root: str) -> DataFrame:
    return records.latest(table(spark, root, "citations").select("id", "source_article_id", "target_article_id", "loaded_at"))


@query(f"select * from {_EDGES}")
def citation_edges(spark: SparkSession, root: str) -> DataFrame:
    return citations.edges(_citations(spark, root))


@query(
    f"""with n as (select count(*) nodes from (select source_id from {_EDGES} union select target_id from {_EDGES})), e as (select count(*) edges from {_EDGES})
    select nodes, edges, case when nodes < 2 then 0 else round(edges / (nodes * (nodes - 1)), 12) end::double as density from n, e"""
)
def graph_density(spark: SparkSession, root: str) -> DataFrame:
    return citations.graph_summary(citations.edges(_citations(spark, root)))


@query(
    f"""select count(*) as citations, count({_KEY.format('target_article_id')}) as internal, round(count({_KEY.format('target_article_id')}) / count(*), 6) as internal_share,
    round(count(*) / count(distinct source_article_id), 6) as per_article from {_CITATIONS}"""
)
def reference_shares(spark: SparkSession, root: str) -> DataFrame:
    return citations.reference_shares(_citations(spark, root))


@query(
    f"""with a as {LATEST.format('articles')}, i as (select openalex_id p, min(id) t from a where openalex_id is not null group by 1),
    r as (select id, unnest(referenced_works) ref, unnest(generate_series(0, len(referenced_works) - 1))::int pos from a)
    select r.id as source_article_id, pos as position, ref as target_raw_ref, t as target_article_id from r left join i on p = regexp_extract(ref, '([^/]*)$', 1)"""
)
def reference_list(spark: SparkSession, root: str) -> DataFrame:
    df = records.latest(table(spark, root, "articles").select("id", "openalex_id", "referenced_works", "loaded_at"))
    return citations.references(df)


@query(f"select function, count(*) as n, round(avg(function_confidence), 6) as mean_confidence from {_CITATIONS} group by all")
def citation_functions(spark: SparkSession, root: str) -> DataFrame:
    df = records.latest(table(spark, root, "citations").select("id", "function", "function_confidence", "loaded_at"))
    return df.groupBy("function").agg(F.count("*").alias("n"), F.round(F.avg("function_confidence"), 6).alias("mean_confidence"))


@query(f"select target_id as article_id, sum(count)::bigint as cited, count(*) as citing_articles from {_EDGES} group by 1 order by cited desc, article_id limit 20")
def most_cited(spark: SparkSession, root: str) -> DataFrame:
    """A top-20 report."""
    e = citations.edges(_citations(spark, root))
    return e.groupBy(F.col("target_id").alias("article_id")).agg(F.sum("count").alias("cited"), F.count("*").alias("citing_articles")).orderBy(F.col("cited").desc(), "article_id").limit(20)
