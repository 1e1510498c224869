"""Queries of the training-data operators and their SQL. Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import abuse, encoding, leakage, near_duplicates, neighbours, ranking, sentences, splitting, survivors
from corpuscle.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return survivors.survivors(table(spark, root, "provenance_records")).select("work_doi", "field_name", "record_id")


def p1_golden(spark: SparkSession, root: str) -> DataFrame:
    return survivors.golden_records(table(spark, root, "provenance_records")).select("work_doi", "provider_record_id", "canonical_record_url", "locations_from")


def _pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.split_oversized(table(spark, root, "chunks"), table(spark, root, "claims"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return splitting.forced_items(_pieces(spark, root))


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    return _pieces(spark, root)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return neighbours.neighbours(table(spark, root, "chunk_vectors")).select("chunk_id", "neighbour_id")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return ranking.first_by_majority(table(spark, root, "search_results"))


def p5_order(spark: SparkSession, root: str) -> DataFrame:
    return ranking.rank_walk(table(spark, root, "search_results")).select("query_id", "chunk_id", "final_rank")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return sentences.sentences(table(spark, root, "chunks"), table(spark, root, "claims"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates.NearDuplicates(table(spark, root, "claims")).pairs().select(F.col("id_a").alias("claim_id_a"), F.col("id_b").alias("claim_id_b"))


def p7_classes(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates.NearDuplicates(table(spark, root, "claims")).membership()


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return encoding.encode(table(spark, root, "documents"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaks(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id")


def p9_near(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"), slack=2).select("doc_id", "item_id")


def p9_items(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaked_items(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return _scored(spark, root).filter("flagged").select("doc_id")


def p10_scores(spark: SparkSession, root: str) -> DataFrame:
    return _scored(spark, root).select("doc_id", "score")


def p10_rates(spark: SparkSession, root: str) -> DataFrame:
    return abuse.rates(_scored(spark, root))


def _scored(spark: SparkSession, root: str) -> DataFrame:
    return abuse.score(table(spark, root, "documents"), table(spark, root, "doc_labels"))


QUERIES = {
    "p1_found": p1_found,
    "p1_golden": p1_golden,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_order": p5_order,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_classes": p7_classes,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_near": p9_near,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}

# White space and blanks as RE2 patterns.
_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BLANK = f"^{_WS}*$"

_P1 = f"""with r as (select *, row_number() over (partition by record_id order by loaded_at nulls last) n from provenance_records where record_id is not null),
  b as (select record_id, case when retrieved_at <= loaded_at then retrieved_at end recency, provider_record_id, canonical_record_url,
      len(list_distinct(list_filter(list_transform(coalesce(locations, []), lambda x: struct_pack(a := case when not regexp_matches(coalesce(x.landing_page_url, ''), '{_BLANK}') then x.landing_page_url end, b := case when not regexp_matches(coalesce(x.pdf_url, ''), '{_BLANK}') then x.pdf_url end)), lambda p: p.a is not null or p.b is not null))) pairs,
      nullif(regexp_extract(lower(replace(regexp_replace(doi, '^{_WS}+|{_WS}+$', '', 'g'), '%2F', '/')), '^(?:(?:info|urn):)?(?:doi[:/]?\\s*)?(?:https?://)?(?:[a-z0-9.-]*doi\\.org/)?(?:doi:\\s*)?(10\\.[^\\s/]+/\\S+)$', 1), '') work_doi
    from r where n = 1),
  f as (select work_doi, record_id, recency, 'provider_record_id' field_name, case when regexp_matches(coalesce(provider_record_id, ''), '{_BLANK}') then 0 else 1 end c from b
    union all select work_doi, record_id, recency, 'canonical_record_url', case when regexp_matches(coalesce(canonical_record_url, ''), '{_BLANK}') then 0 else 1 end from b
    union all select work_doi, record_id, recency, 'locations', pairs from b),
  w as (select work_doi from b where work_doi is not null group by 1 having count(*) > 1)
  select work_doi, field_name, record_id from (select *, row_number() over (partition by work_doi, field_name order by c desc, recency desc nulls last, record_id) n from f where c > 0) where n = 1 and work_doi in (from w)"""

_P2 = """with c as (select distinct on (id) 'chunk' k, id, text t, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 1000 big, 1000 lim from chunks where id is not null
    union all select distinct on (id) 'claim', id, verbatim, case when char_end > char_start then char_end - char_start else length(trim(verbatim, ' ' || chr(9) || chr(10) || chr(13))) end > 600, 600 from claims where id is not null)
  select k as item_kind, id as item_id, case when coalesce(list_max(list_transform(regexp_split_to_array(t, '[\\s\\pZ\\x{85}\\pP]+'), lambda x: length(x))), 0) > lim then 1 else 0 end::bigint as forced from c where big"""

# The strength of each cut as a list per item, then one piece after another.
_IN = lambda c, chars: c + " in (" + ", ".join("'" + x.replace("'", "''") + "'" for x in chars) + ")"
_CLOSING = "\"'\u201d\u2019\u00bb)]\u300d\u300f\uff09"
_P2_PIECES = (
    """with recursive c as (select distinct on (id) 'chunk' k, id, text t, 1000 lim from chunks where id is not null and length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 1000 union all
      select distinct on (id) 'claim', id, verbatim, 600 from claims where id is not null and case when char_end > char_start then char_end - char_start else length(trim(verbatim, ' ' || chr(9) || chr(10) || chr(13))) end > 600),
    b as (select *, length(t) - length(ltrim(t, ' ' || chr(9) || chr(10) || chr(13))) a, length(rtrim(t, ' ' || chr(9) || chr(10) || chr(13))) z from c),
    u as (select k, id, unnest(string_split(t, '')) x, generate_subscripts(string_split(t, ''), 1) i from b where z - a > lim),
    g as (select *, regexp_matches(x, '"""
    + _WS
    + r"""') sp, regexp_matches(x, '\pP') pu, regexp_matches(x, '\pM') mk from u),
    h as (select *, last_value(case when not sp then x end ignore nulls) over w lastx, last_value(case when not sp then coalesce(pv, '') end ignore nulls) over w prevx, last_value(case when not sp then i end ignore nulls) over w lasti, sum((x = chr(10))::int) over w nl,
      lead(x) over o nx, lead(sp) over o nsp, lead(pu) over o npu, lead(mk) over o nmk from (select *, lag(x) over (partition by k, id order by i) pv from g) window o as (partition by k, id order by i), w as (partition by k, id order by i rows unbounded preceding)),
    l as (select *, nl - coalesce(max(case when not sp then nl end) over (partition by k, id order by i rows unbounded preceding), 0) since from h),
    s as (select k, id, list(case when nmk and not (sp or pu) then 0 when sp and not nsp and since > 1 then 6 when sp and not nsp and since = 1 then 5
      when not sp and not (nsp or npu) and (FULL_LAST or (CLOSED and FULL_PREV)) then 4 when sp and not nsp and (END_LAST or (CLOSED and END_PREV)) then 4
      when not sp and not (nsp or npu) and FULL_CLAUSE then 3 when sp and not nsp and CLAUSE then 3 when sp then 2 when sp or pu or nsp or npu then 1 else 0 end order by i) st from l where nx is not null group by all),
    r as (select k, id, t, lim, st, a s, a e, z, 0 n, null::bigint ps, null::bigint pe, 0::bigint ov, 0 f, false done from b join s using (k, id) where z - a > lim
      union all select k, id, t, lim, st, case when fin or skip then e else greatest(s + 1, place - 100) end, case when fin then z when skip then e else place end, z, case when skip then n else n + 1 end, case when not skip then s end, case when fin then z when not skip then place end, case when skip or n = 0 then 0 else e - s end, case when fin or skip then 0 else (v = 0)::int end, fin
      from (select *, not fin and v = 0 and s < e skip, case when v = 0 then s + lim else place0 end place from (select *, z - s <= lim fin, case when va > 0 then va else vb end v, case when va > 0 then ha - (list_position(list_reverse(sa), va) - 1) else ha - (list_position(list_reverse(sb), vb) - 1) end place0
        from (select *, s + lim ha, coalesce(list_max(sa), 0) va, coalesce(list_max(sb), 0) vb from (select *, case when greatest(greatest(s, e) + 1, s + lim // 2) <= s + lim then st[greatest(greatest(s, e) + 1, s + lim // 2):s + lim] else [] end sa, st[greatest(s, e) + 1:s + lim] sb from r where not done))))),
    p as (select k, id, n - 1 i, ps, pe, ov, f, t[ps + 1:pe] x from r where ps is not null
      union all select k, id, 0, case when a < z then a end, case when a < z then z end, 0, 0, case when a < z then t[a + 1:z] end from b where t is null or z - a <= lim)
    select k as item_kind, id as item_id, i::int as piece_index, ps::int as piece_start, pe::int as piece_end, ov::int as overlap, f::int as forced, x as text from p"""
)
for _name, _test in (
    ("FULL_LAST", _IN("lastx", splitting.FULL_ENDS)), ("FULL_PREV", _IN("prevx", splitting.FULL_ENDS)), ("END_LAST", _IN("lastx", splitting.ENDS)), ("END_PREV", _IN("prevx", splitting.ENDS)),
    ("FULL_CLAUSE", _IN("x", splitting.CLAUSES[4:])), ("CLAUSE", _IN("lastx", splitting.CLAUSES)), ("CLOSED", _IN("lastx", _CLOSING)),
):
    _P2_PIECES = _P2_PIECES.replace(_name, _test)

_P5 = """with s as (select query_id, chunk_id, max(case when not isnan(rrf_score) then rrf_score end) a, max(case when bm25_rank >= 1 then -bm25_rank end) b, max(case when dense_rank >= 1 then -dense_rank end) c
    from search_results where query_id is not null and chunk_id is not null group by all)
  select x.query_id, x.chunk_id from s x join s y on x.query_id = y.query_id and x.chunk_id <> y.chunk_id group by all
  having bool_and((case when x.a > y.a or (x.a is not null and y.a is null) then 1 else 0 end) + (case when x.b > y.b or (x.b is not null and y.b is null) then 1 else 0 end) + (case when x.c > y.c or (x.c is not null and y.c is null) then 1 else 0 end) >= 2)"""

# The walk of one query: how many items each score has above an item, the chance of each step, sixty steps; then the rounds.
_P5_ABOVE = "list_transform({0}, lambda x: struct_pack(c := x.c, a := x.a, b := x.b, d := x.d, na := len(list_filter({0}, lambda z: z.a > x.a)), nb := len(list_filter({0}, lambda z: z.b > x.b)), nd := len(list_filter({0}, lambda z: z.d > x.d))))"
_P5_STEP = "list_transform(x, lambda y: list_transform(x, lambda z: ((case when y.a > z.a then 1.0::double / z.na else 0 end) + (case when y.b > z.b then 1.0::double / z.nb else 0 end) + (case when y.d > z.d then 1.0::double / z.nd else 0 end) + (case when y.c = z.c then (z.na = 0)::int + (z.nb = 0)::int + (z.nd = 0)::int else 0 end)) / 3))"
_P5_WALKED = f"""select query_id, depth, items, list_transform(list_reduce(list_concat([list_transform(items, lambda i: 1.0::double / len(items))], list_transform(range(60), lambda i: []::double[])), lambda m, e: list_transform(w, lambda r: 0.15::double / len(w) + 0.85::double * list_dot_product(m, r))), lambda v: round(v, 12)) mass
    from (select query_id, depth, items, {_P5_STEP} w from (select query_id, depth, items, {_P5_ABOVE.format('items')} x from ({{0}})))"""
_P5_ORDER = f"""with recursive s as (select query_id, chunk_id, max(case when not isnan(rrf_score) then rrf_score end) a, max(case when bm25_rank >= 1 then -bm25_rank end) b, max(case when dense_rank >= 1 then -dense_rank end) d
    from search_results where query_id is not null and chunk_id is not null group by all),
  q as (select query_id, 0 depth, list(struct_pack(c := chunk_id, a := coalesce(a, '-infinity'::double), b := coalesce(b, '-infinity'::double), d := coalesce(d, '-infinity'::double)) order by chunk_id) items from s group by 1),
  r as ({_P5_WALKED.format('from q')} union all
    {_P5_WALKED.format("select query_id, depth + 1 depth, list_filter(items, lambda i: (i.a > t.a)::int + (i.b > t.b)::int + (i.d > t.d)::int >= 2) items from (select *, items[list_position(mass, list_max(mass))] t from r)")} where len(items) > 0),
  e as (select query_id, depth, unnest(items).c chunk_id, unnest(mass) mass from r)
  select query_id, chunk_id, row_number() over (partition by query_id order by depth desc, mass desc, chunk_id) as final_rank from (select * from e qualify row_number() over (partition by query_id, chunk_id order by depth desc) = 1)"""

_GRAMS = "select {0} i, list_slice(w, s, s + 11) g from (select {0}, w, unnest(generate_series(1, len(w) - 11)) s from (select {0}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}]+') w from {1} where text is not null) where len(w) >= 12)"
_P9 = f"select distinct d.i as doc_id, e.i as item_id from ({_GRAMS.format('doc_id', 'documents')}) d join ({_GRAMS.format('item_id', 'eval_items')}) e on d.g = e.g"

# From the rarest word of a phrase: starts at which each word stands within two places of its own.
_P9_NEAR = r"""with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}]+') w from documents where doc_id is not null and text is not null),
    t as (select doc_id, unnest(w) word, generate_subscripts(w, 1) pos from d), f as (select word, count(*) n from t group by 1),
    e as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}]+') v from eval_items where text is not null),
    g as (select item_id, list_slice(v, s, s + 11) g from (select item_id, v, unnest(generate_series(1, len(v) - 11)) s from e where len(v) >= 12)),
    p as (select g, arg_min(j, (n, j)) j from (select g, g[j] word, j from (select distinct g from g), range(1, 13) r(j)) join f using (word) group by g having count(*) = 12),
    s as (select distinct doc_id, g, pos - j + 1 + delta s from p join t on word = g[j], range(-2, 3) r(delta)),
    m as (select distinct doc_id, g from s join d using (doc_id) where list_bool_and(list_transform(range(0, 12), lambda j: s + j + 2 >= 1 and list_contains(list_slice(w, greatest(1, s + j - 2), greatest(1, s + j + 2)), g[j + 1]))))
  select distinct doc_id, item_id from m join g using (g)"""

_P3 = """with v as (select chunk_id, any_value(embedding)::double[64] e from chunk_vectors where chunk_id is not null and len(embedding) = 64
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by 1),
  s as (select a.chunk_id, b.chunk_id neighbour_id, round(array_cosine_similarity(a.e, b.e), 6) c from v a join v b on a.chunk_id <> b.chunk_id)
  select chunk_id, neighbour_id from (select *, row_number() over (partition by chunk_id order by c desc, neighbour_id) n from s where c >= 0.85) where n <= 5"""

_P7 = r"""with c as (select distinct on (id) id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}]+') w from claims where id is not null and text is not null),
  t as (select id, w, count(*) n from (select id, unnest(w) w from c) group by all),
  z as (select id, sum(n) z from t group by 1),
  i as (select a.id x, b.id y, sum(least(a.n, b.n)) common from t a join t b on a.w = b.w and a.id < b.id group by all)
  select x as claim_id_a, y as claim_id_b from i join z p on p.id = x join z q on q.id = y where common * 1.0 / (p.z + q.z - common) >= 0.75"""

_P1_GOLDEN = f"""select work_doi, max(case when field_name = 'provider_record_id' then provider_record_id end) as provider_record_id, max(case when field_name = 'canonical_record_url' then canonical_record_url end) as canonical_record_url,
    max(case when field_name = 'locations' then record_id end) as locations_from from ({_P1}) join (select record_id, arg_min(provider_record_id, loaded_at) provider_record_id, arg_min(canonical_record_url, loaded_at) canonical_record_url from provenance_records group by 1) using (record_id) group by 1"""

_P7_CLASSES = rf"""with b as (select id, min(id) over (partition by k) class_id from (select distinct on (id) id, list_sort(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{Nd}}]+')) k from claims where id is not null and text is not null) where len(k) > 0),
    p as (select * from ({_P7})), e as (select x.class_id, y.class_id other from p join b x on x.id = claim_id_a join b y on y.id = claim_id_b union select y.class_id, x.class_id from p join b x on x.id = claim_id_a join b y on y.id = claim_id_b)
  select id, class_id, (select count(*) from e where e.class_id = b.class_id and other <> b.class_id) as links from b"""

_P9_ITEMS = f"""select item_id, count(*) as documents, least(1.0, round(max(n) / any_value(total), 6))::double as largest_share from (select d.i doc, e.i item_id, count(distinct d.g) n from ({_GRAMS.format('doc_id', 'documents')}) d join ({_GRAMS.format('item_id', 'eval_items')}) e on d.g = e.g group by all)
    join (select item_id, greatest(1, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}]+')) - 11) total from eval_items) using (item_id) group by 1"""

SQL = {"p1_golden": _P1_GOLDEN, "p7_classes": _P7_CLASSES, "p9_items": _P9_ITEMS, "p1_found": _P1, "p2_found": _P2, "p2_pieces": _P2_PIECES, "p3_found": _P3, "p5_found": _P5, "p5_order": _P5_ORDER, "p7_found": _P7, "p9_found": _P9, "p9_near": _P9_NEAR}
