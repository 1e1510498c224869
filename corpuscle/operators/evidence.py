"""Evidence for review sentences: relevance, an auditable cascade of checks, capped selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.columns import canonical_id, col_of
from corpuscle.functions.text import comparison_sides, content_terms, folded_key, query_terms
from corpuscle.operators.claims import is_complete, on_token_borders

# The order of claim types in a review.
TYPE_ORDER = ("method", "dataset", "finding", "comparison", "limitation", "hypothesis")
PER_TYPE, PER_ARTICLE = 3, 2


def relevance(query: Column | str, claim: Column | str, title: Column | str) -> Column:
    """struct(terms, claim_hits, title_only_hits, relevant, score) of one query variant.

    Relevant: a term in the claim, and one term (two, if the query has more than
    three) in claim and title together. The score counts title-only terms a quarter.
    """
    terms = query_terms(query)
    in_claim = F.array_intersect(terms, content_terms(claim))
    in_title = F.array_intersect(terms, content_terms(title))
    title_only = F.size(F.array_except(in_title, in_claim))
    hits, n = F.size(in_claim), F.size(terms)
    relevant = (n > 0) & (hits > 0) & (hits + title_only >= F.when(n <= 3, 1).otherwise(2))
    score = F.when(n == 0, 0.0).otherwise(F.round((hits + 0.25 * title_only) / n, 6))
    return F.struct(n.alias("terms"), hits.alias("claim_hits"), title_only.alias("title_only_hits"), relevant.alias("relevant"), score.alias("score"))


def best_relevance(*variants: Column) -> Column:
    """struct(relevant, score) over variants of the query: any relevant, the best score."""
    relevant = variants[0]["relevant"]
    for v in variants[1:]:
        relevant = relevant | v["relevant"]
    score = F.greatest(*(v["score"] for v in variants)) if len(variants) > 1 else variants[0]["score"]
    return F.struct(relevant.alias("relevant"), score.alias("score"))


def source_text(verbatim: Column | str = "verbatim", text: Column | str = "text") -> Column:
    """What a claim quotes: its verbatim unless that is null or empty, else its text, without outer white space."""
    quoted = F.coalesce(F.nullif(col_of(verbatim), F.lit("")), col_of(text), F.lit(""))
    return F.regexp_replace(quoted, r"(?U)^\s+|\s+\z", "")


def cascade(claims: DataFrame, chunks: DataFrame, articles: DataFrame, retrieved: DataFrame | None = None, sections: DataFrame | None = None, variants: list[str] | None = None) -> DataFrame:
    """Claims with their place in the source and the first check they fail, null for those that pass.

    Columns: those of ``claims`` with canonical ids, source (the text quoted), source_start (its place in the chunk),
    offsets (``valid``, ``recovered``, ``invalid`` or null for none), reject_reason; with ``variants`` also title and
    relevance, a struct per variant of the query.

    Checks, in order: an id; the article of the retrieved chunk (without ``retrieved``, of the chunk); article known;
    chunk known; the retrieved article and text are the chunk's (else the index is stale); a text; a complete sentence;
    found verbatim in the chunk (at the stored place, else by search); with a section of the chunk known by ``sections``
    (id, article_id, text): it exists, is of the same article and holds the chunk at its place; on word borders, in the
    section if there is one; without a section not the cut first sentence of a later chunk; relevant to a variant.
    All checks are one expression, so their order survives the optimizer.

    ``retrieved`` (chunk_id, article_id, chunk_text, and what else is to come along) keeps only claims of its chunks.
    """
    own = claims.withColumn("article_id", canonical_id("article_id")).withColumn("chunk_id", canonical_id("chunk_id")).withColumn("source", source_text())
    none = F.lit(None).cast("string")
    section = F.nullif(F.col("section_id"), F.lit("")) if sections is not None and "section_id" in chunks.columns else none
    end = F.col("char_end") if "char_end" in chunks.columns else F.lit(None).cast("int")
    c = chunks.select(F.col("id").alias("chunk_id"), F.col("article_id").alias("_chunk_article"), F.coalesce("text", F.lit("")).alias("_chunk_text"), F.col("char_start").alias("_chunk_start"), end.alias("_chunk_end"), section.alias("_section"))
    title = F.col("title") if "title" in articles.columns else none
    a = articles.select(F.col("id").alias("article_id"), F.lit(True).alias("_article_known"), title.alias("title"))
    if retrieved is None:
        both = own.join(c, "chunk_id", "left").withColumn("_found_article", F.col("_chunk_article")).withColumn("_stale", F.lit(False))
    else:
        found = retrieved.withColumnRenamed("article_id", "_found_article").withColumnRenamed("chunk_text", "_found_text")
        both = own.join(found, "chunk_id").join(c, "chunk_id", "left").withColumn("_stale", (F.col("_chunk_article") != F.col("_found_article")) | (F.coalesce("_found_text", F.lit("")) != F.col("_chunk_text"))).drop("_found_text")
    both = both.join(a, "article_id", "left")
    if sections is not None:
        known = sections.select(F.col("id").alias("_section"), F.col("article_id").alias("_section_article"), F.coalesce("text", F.lit("")).alias("_section_text"))
        both = both.join(known, "_section", "left")
    else:
        both = both.withColumn("_section_article", none).withColumn("_section_text", none)
    start, size = F.col("char_start"), F.char_length("source")
    stored = (start >= 0) & (F.col("char_end") >= start) & (F.col("char_end") <= F.char_length("_chunk_text")) & (F.substring(F.col("_chunk_text"), start + 1, F.col("char_end") - start) == F.col("source"))
    stored = F.coalesce(stored, F.lit(False))
    placed = both.withColumn("source_start", F.when(stored, start).otherwise(F.position(F.col("source"), F.col("_chunk_text")) - 1)).withColumn("_stored", stored)
    offsets = F.when(start.isNotNull() & F.col("char_end").isNotNull(), F.when(F.col("_stored"), "valid").when(F.col("source_start") >= 0, "recovered").otherwise("invalid"))
    chunk_start, chunk_end, in_section = F.col("_chunk_start"), F.col("_chunk_end"), F.col("_section").isNotNull()
    held = (F.col("_section_article") == F.col("article_id")) & (chunk_start >= 0) & (chunk_end >= chunk_start) & (chunk_end <= F.char_length("_section_text")) & (F.substring(F.col("_section_text"), chunk_start + 1, chunk_end - chunk_start) == F.col("_chunk_text"))
    around = F.when(in_section, F.col("_section_text")).otherwise(F.col("_chunk_text"))
    begin = F.when(in_section, chunk_start + F.col("source_start")).otherwise(F.col("source_start"))
    reason = (
        F.when(F.coalesce("id", F.lit("")) == "", "missing_claim_id")
        .when(F.col("_found_article") != F.coalesce("article_id", F.lit("")), "article_id_mismatch")
        .when(F.col("_article_known").isNull(), "article_missing")
        .when(F.col("_chunk_article").isNull(), "missing_chunk_metadata")
        .when(F.col("_stale"), "retrieved_chunk_inconsistent")
        .when(F.col("source") == "", "empty_source_text")
        .when(~is_complete("source"), "incomplete")
        .when(F.col("source_start") < 0, "not_verbatim_in_source")
        .when(in_section & F.col("_section_article").isNull(), "source_context_unavailable")
        .when(in_section & ~F.coalesce(held, F.lit(False)), "source_section_mismatch")
        .when(~on_token_borders(around, begin, begin + size), "source_token_boundary")
        .when(~in_section & (F.col("source_start") == 0) & (chunk_start > 0), "source_context_unavailable")
    )
    kept = [c for c in placed.columns if not c.startswith("_") and c not in ("source_start", "title")]
    if variants is None:
        return placed.select(*kept, "source_start", offsets.alias("offsets"), reason.alias("reject_reason"))
    each = F.array(*(relevance(F.lit(v), "source", "title") for v in variants))
    judged = placed.select(*kept, "title", "source_start", offsets.alias("offsets"), reason.alias("reject_reason")).withColumn("relevance", F.when(F.col("reject_reason").isNull(), each))
    return judged.withColumn("reject_reason", F.when(F.col("reject_reason").isNull() & ~F.exists("relevance", lambda r: r["relevant"]), "irrelevant").otherwise(F.col("reject_reason")))


# What lies between the first stages of the cascade; a claim that fails at a stage or later has passed those before.
STAGES = (
    ("complete", ("missing_claim_id", "article_id_mismatch", "article_missing", "missing_chunk_metadata", "retrieved_chunk_inconsistent", "empty_source_text", "incomplete")),
    ("verbatim_in_chunk", ("not_verbatim_in_source",)),
    ("source_span_valid", ("source_context_unavailable", "source_section_mismatch", "source_token_boundary")),
    ("relevance_pass", ("irrelevant",)),
)


def stage_counts(judged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(*keys, counter, n) of the output of ``cascade``: the claims looked at, those past each stage, the rejections by reason, the offsets.

    One aggregate over the few reasons; every counter that isn't 0 has a row.
    """
    keys = keys or []
    failed = [F.coalesce(F.col("reject_reason").isin([r for _, reasons in STAGES[: i + 1] for r in reasons]), F.lit(False)) for i in range(len(STAGES))]
    counters = [F.lit("associated_with_retrieved_chunks"), *(F.when(~f, name) for f, (name, _) in zip(failed, STAGES)), F.concat(F.lit("rejected_"), "reject_reason"), F.when(~failed[0], F.concat(F.lit("offsets_"), "offsets"))]
    return judged.select(*keys, F.explode(F.array(*counters)).alias("counter")).filter("counter is not null").groupBy(*keys, "counter").agg(F.count("*").alias("n"))


def overlap_counts(judged: DataFrame) -> DataFrame:
    """(variant, overlap, n, passed) of judged claims with relevance: how many meet no, one or several terms of each variant of the query."""
    each = judged.filter("relevance is not null").select(F.posexplode("relevance").alias("variant", "r"))
    bucket = F.when(F.col("r.claim_hits") == 0, "zero").when(F.col("r.claim_hits") == 1, "one").otherwise("multiple")
    return each.groupBy("variant", bucket.alias("overlap")).agg(F.count("*").alias("n"), F.sum(F.col("r.relevant").cast("long")).alias("passed"))


def rendered_by_type(selected: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(*keys, method, finding): how many of the claims shown carry these two labels."""
    count = lambda t: F.count(F.when(F.col("claim_type") == t, 1)).alias(t)
    return selected.groupBy(*(keys or [])).agg(count("method"), count("finding"))


def side_terms(query: str, english: str | None = None, translate: Callable[[str], str | None] | None = None) -> Column:
    """The terms of the two sides of a comparison, array<array<string>>, null for another query.

    The sides of the English variant count; if it has none, those of the query, each with the terms of its translation.
    """
    spark = SparkSession.active()
    for variant in filter(None, (english, query)):
        sides = spark.range(1).select(comparison_sides(F.lit(variant)).alias("s")).collect()[0]["s"]
        if sides:
            translated = [translate(label) if translate and variant == query else None for label in sides]
            return F.array(*(F.array_union(query_terms(F.lit(label)), query_terms(F.lit(other or ""))) for label, other in zip(sides, translated)))
    return F.lit(None).cast("array<array<string>>")


def covers(sides: Column, text: Column | str) -> Column:
    """Per side whether the text has one of its terms; null without sides."""
    return F.transform(sides, lambda terms: F.arrays_overlap(terms, content_terms(text)))


def greedy(rows: list[dict], per_type: int = PER_TYPE, per_article: int = PER_ARTICLE) -> list[dict]:
    """Claims chosen by relevance, rank and id: types in their order, capped per type and article, equal texts once.

    Where rows say which side of a comparison they cover, each side not covered yet first takes its best claim, and if
    one side has none nothing is chosen.
    """
    taken: list[dict] = []
    keys: set[str] = set()
    articles: dict[str, int] = {}
    types: dict[str, int] = {}
    order = sorted(rows, key=lambda r: (-r["score"], r["rank"], r["id"]))

    def take(row: dict) -> bool:
        fits = row["key"] and row["key"] not in keys and articles.get(row["article_id"], 0) < per_article and types.get(row["claim_type"], 0) < per_type
        if fits:
            taken.append(row)
            keys.add(row["key"])
            articles[row["article_id"]] = articles.get(row["article_id"], 0) + 1
            types[row["claim_type"]] = types.get(row["claim_type"], 0) + 1
        return bool(fits)

    compared = max((len(r.get("covers") if r.get("covers") is not None else ()) for r in rows), default=0)
    for side in range(compared):
        if not any(r["covers"][side] for r in taken) and not any(take(r) for r in order if r["covers"][side]):
            return []
    for kind in TYPE_ORDER:
        for row in order:
            if row["claim_type"] == kind:
                take(row)
    return taken


def select_evidence(candidates: DataFrame, per_type: int = PER_TYPE, per_article: int = PER_ARTICLE) -> DataFrame:
    """(query_id, id, position) of (query_id, id, article_id, claim_type, score, rank, text) candidates; with ``covers`` (array<boolean>) for comparisons.

    The choice is sequential, but it takes at most ``most`` claims, so at most
    ``most / per_article`` articles are ever full and ``most`` texts ever used. Windows
    keep as many of a text, an article and a type as these could block, plus those the
    caps let through, apart for each pattern of covered sides; the fold over the rest
    gives what it would give over all.
    """
    from pyspark.sql import Window

    order = [F.col("score").desc(), F.col("rank"), F.col("id")]
    sided = candidates if "covers" in candidates.columns else candidates.withColumn("covers", F.lit(None).cast("array<boolean>"))
    keyed = sided.withColumn("key", folded_key("text")).filter(F.col("key") != "")
    best = lambda df, by, n: df.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "claim_type", "covers", *by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
    most = per_type * len(TYPE_ORDER)
    full = -(-most // per_article)
    once = best(best(keyed, ["key", "article_id"], 1), ["key"], full + 1)
    per = best(once, ["article_id"], most + per_article)
    short = best(per, [], full * (most + per_article) + most * (full + 1) + per_type)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query, items in zip(batch["query_id"], batch["items"]):
                rows += [(query, r["id"], i) for i, r in enumerate(greedy([dict(x) for x in items], per_type, per_article), 1)]
            yield pd.DataFrame(rows, columns=["query_id", "id", "position"])

    packed = short.groupBy("query_id").agg(F.collect_list(F.struct("id", "article_id", "claim_type", "score", "rank", "key", "covers")).alias("items"))
    return packed.mapInPandas(fold, "query_id string, id string, position int")


def display(c: Column | str) -> Column:
    """A bullet taken off, a capital first, a full stop last."""
    c = F.regexp_replace(F.trim(col_of(c)), r"^[-*•]\s+", "")
    capital = F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1_000_000))
    return F.when(capital.rlike(r"[.!?]\z"), capital).otherwise(F.concat(capital, F.lit(".")))
