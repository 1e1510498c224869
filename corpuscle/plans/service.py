"""The functions behind a service: search, claims, bibliography, drafting and verifying a review.

Each takes a session and a corpus directory and returns a DataFrame; nothing is kept
between calls but tables. Models stay with the caller: ``encode`` turns a query into
a vector, ``translate`` into English, ``entail`` is a column function of premise and
hypothesis that gives struct(entailment, contradiction).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions.columns import canonical_id
from corpuscle.operators import evidence, records, retrieval, review
from corpuscle.operators import reviews as nested
from corpuscle.sources import jsonl
from corpuscle.sources.tables import table

#: Candidates of each ranking before fusion.
POOL = 50
MODES = ("rrf", "bm25", "dense")


class NotFound(LookupError):
    """An id that the corpus doesn't hold."""


class InsufficientEvidence(ValueError):
    """No claim passed all checks."""


@dataclass(frozen=True)
class Settings:
    """What a service is set up with; every bound is checked."""

    root: str = "data"
    top_k: int = 10
    mode: str = "rrf"

    def __post_init__(self):
        _bounded("top_k", self.top_k, 1, 50)
        if self.mode not in MODES:
            raise ValueError(f"no such mode: {self.mode}")

    @classmethod
    def of(cls, environment: Mapping[str, str]) -> Settings:
        """From DATA_DIR, DEFAULT_TOP_K and RETRIEVAL_MODE; blank ones count as unset."""
        named = {k: v for k, name in (("root", "DATA_DIR"), ("top_k", "DEFAULT_TOP_K"), ("mode", "RETRIEVAL_MODE")) if (v := environment.get(name, "").strip())}
        if "top_k" in named:
            try:
                named["top_k"] = int(named["top_k"])
            except ValueError as error:
                raise ValueError(f"DEFAULT_TOP_K must be an integer, not {named['top_k']!r}") from error
        return cls(**named | ({"mode": named["mode"].lower()} if "mode" in named else {}))


def health(spark: SparkSession, root: str, reviews: DataFrame | None = None, index: str | None = None) -> DataFrame:
    """(table_name, n): the current records of the tables there are, the different reviews, and 1 or 0 for a saved index."""
    parts = [records.latest(table(spark, root, t).select("id", "loaded_at")).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in ("articles", "chunks", "claims")]
    if reviews is not None:
        parts.append(reviews.agg(F.count_distinct("slug").alias("n")).select(F.lit("reviews").alias("table_name"), "n"))
    if index is not None:
        parts.append(spark.createDataFrame([("index", int(jsonl.exists(spark, f"{index}/constants")))], "table_name string, n bigint"))
    return reduce(DataFrame.unionByName, parts)


def review_of(reviews: DataFrame, slug: str) -> DataFrame:
    """The newest review of a slug; an unknown one raises ``NotFound``."""
    found = nested.newest(reviews.filter(F.col("slug") == slug))
    if not found.limit(1).collect():
        raise NotFound(slug)
    return found


def review_bibliography(spark: SparkSession, root: str, reviews: DataFrame, slug: str) -> DataFrame:
    """(id, bibtex_key, entry) of the articles that the newest review of a slug cites."""
    cited = review_of(reviews, slug).select(F.explode(F.flatten(F.transform("sentences", lambda s: s["citations"]))).alias("id")).distinct()
    return review.bibtex(records.current(table(spark, root, "articles")).join(cited, "id", "left_semi"))


def _bounded(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be {low} to {high}")
    return value


def build_index(spark: SparkSession, root: str, path: str) -> None:
    """Builds the lexical index of the current chunks and saves it under ``path`` for ``search``."""
    chunks = records.current(table(spark, root, "chunks").select("id", "text", "loaded_at", "deleted_at"))
    retrieval.save_index(retrieval.bm25_index(chunks, "id"), path)


def search(spark: SparkSession, root: str, query: str, k: int = 10, mode: str = "rrf", encode: Callable[[str], list[float]] | None = None, index: str | None = None) -> DataFrame:
    """(chunk_id, rank, score, bm25_rank, dense_rank, chunk_section, chunk_text): ``bm25``, ``dense`` or ``rrf``. A blank query finds nothing.

    ``index``: where ``build_index`` saved the lexical index; without it one is built for this search.
    """
    _bounded("k", k, 1, 50)
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if mode != "bm25" and encode is None:
        raise ValueError("dense search needs an encoder")
    chunks = records.current(table(spark, root, "chunks").select("id", "article_id", "section_type", "text", "char_start", "loaded_at", "deleted_at"))
    asked = spark.createDataFrame([(1, query)] if query.strip() else [], "query_id bigint, query string")
    pool = POOL if mode == "rrf" else k
    lexical = dense = None
    if mode != "dense":
        stored = retrieval.load_index(spark, index) if index else retrieval.bm25_index(chunks, "id")
        lexical = retrieval.bm25_search(stored, asked, pool)
    if mode != "bm25":
        vectors = table(spark, root, "chunk_vectors").filter("embedding is not null").dropDuplicates(["chunk_id"]).select(F.col("chunk_id").alias("doc"), F.col("embedding").alias("v"))
        vector = spark.createDataFrame([(1, encode(query))] if query.strip() else [], "query_id bigint, q array<double>")
        dense = retrieval.dense_search(vectors, vector, pool)
    if mode == "rrf":
        ranked = retrieval.fuse(lexical, dense, k).select("chunk_id", F.col("fused_rank").alias("rank"), "score", "bm25_rank", "dense_rank")
    else:
        one = lexical if mode == "bm25" else dense
        ranks = [F.col("rank").alias("bm25_rank") if mode == "bm25" else F.lit(None).cast("int").alias("bm25_rank"), F.col("rank").alias("dense_rank") if mode == "dense" else F.lit(None).cast("int").alias("dense_rank")]
        ranked = one.select(F.col("doc").alias("chunk_id"), "rank", "score", *ranks)
    return retrieval.enrich(ranked, chunks)


def article_claims(spark: SparkSession, root: str, article_id: str) -> DataFrame:
    """The current claims of an article; an unknown article raises ``NotFound``."""
    if records.current(table(spark, root, "articles").filter(F.col("id") == article_id)).limit(1).count() == 0:
        raise NotFound(article_id)
    return records.current(table(spark, root, "claims").filter(canonical_id("article_id") == article_id))


def claims(spark: SparkSession, root: str, claim_type: str | None = None, hedging: str | None = None, has_metric: bool | None = None, limit: int = 50) -> DataFrame:
    """Filtered current claims in the order of their ids, at most ``limit`` (1 to 500)."""
    df = records.current(table(spark, root, "claims"))
    for column, value in (("claim_type", claim_type), ("hedging_level", hedging)):
        df = df.filter(F.col(column) == value) if value is not None else df
    if has_metric is not None:
        df = df.filter(F.col("metric_value").isNotNull() if has_metric else F.col("metric_value").isNull())
    return df.orderBy("id").limit(_bounded("limit", limit, 1, 500))


def bibliography(spark: SparkSession, root: str, ids: list[str]) -> DataFrame:
    """(id, bibtex_key, entry) of articles; unknown ids raise ``NotFound`` with all of them."""
    own = records.current(table(spark, root, "articles").filter(F.col("id").isin(ids)))
    missing = set(ids) - {r[0] for r in own.select("id").collect()}
    if missing:
        raise NotFound(", ".join(sorted(missing)))
    return review.bibtex(own)


def _generation(spark: SparkSession, root: str, query: str, k: int, encode: Callable | None, translate: Callable[[str], str | None] | None, index: str | None) -> tuple[DataFrame, DataFrame]:
    """(judged claims of the retrieved chunks, the chosen ones)."""
    if len(query.strip()) < 2:
        raise ValueError("the query is too short")
    _bounded("k", k, 5, 50)
    english = translate(query) if translate else None
    variants = list(dict.fromkeys(v for v in (query, english) if v))
    mode = "rrf" if encode else "bm25"
    found = [search(spark, root, v, k, mode, encode, index).select(F.lit(i).alias("query_id"), F.lit(1).alias("topic"), "chunk_id", F.col("rank").alias("final_rank")) for i, v in enumerate(variants)]
    ranked = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    merged = retrieval.merge_variants(ranked, "topic", k).select("chunk_id", "rank")
    chunks, articles = records.current(table(spark, root, "chunks")), records.current(table(spark, root, "articles"))
    seen = retrieval.enrich(merged, chunks).join(chunks.select(F.col("id").alias("chunk_id"), "article_id"), "chunk_id").select("chunk_id", "article_id", "chunk_text", F.col("rank").alias("retrieval_rank"))
    judged = evidence.cascade(records.current(table(spark, root, "claims")), chunks, articles, seen, variants=variants)
    sides = evidence.side_terms(query, english, translate)
    score = F.array_max(F.transform("relevance", lambda r: r["score"]))
    candidates = judged.filter("reject_reason is null").select(F.lit("1").alias("query_id"), "id", "article_id", "claim_type", score.alias("score"), F.col("retrieval_rank").alias("rank"), F.col("source").alias("text"), evidence.covers(sides, "source").alias("covers"))
    return judged, evidence.select_evidence(candidates).join(candidates, ["query_id", "id"]).select("position", F.col("id").alias("claim_id"), "article_id", "claim_type", evidence.display("text").alias("sentence"), F.col("text").alias("passage"), "score")


def draft(spark: SparkSession, root: str, query: str, k: int = 20, encode: Callable | None = None, translate: Callable[[str], str | None] | None = None, index: str | None = None) -> DataFrame:
    """(position, claim_id, article_id, claim_type, sentence, passage, score): the sentences of a review with their evidence.

    The query and its translation are retrieved apart and fused; claims of the found
    chunks pass the cascade of checks and the relevance of either variant, and are
    chosen under the caps per type and article, for a comparison from both sides.
    """
    return _generation(spark, root, query, k, encode, translate, index)[1]


def diagnostics(spark: SparkSession, root: str, query: str, k: int = 20, encode: Callable | None = None, translate: Callable[[str], str | None] | None = None, index: str | None = None) -> DataFrame:
    """(counter, n): what became of the claims at each stage of ``draft``."""
    judged, chosen = _generation(spark, root, query, k, encode, translate, index)
    by_type = evidence.rendered_by_type(chosen).select(F.explode(F.create_map(F.lit("rendered_method"), F.col("method"), F.lit("rendered_finding"), F.col("finding"))).alias("counter", "n"))
    overlaps = evidence.overlap_counts(judged).select(F.concat(F.lit("variant_"), "variant", F.lit("_overlap_"), "overlap").alias("counter"), "n")
    return evidence.stage_counts(judged).unionByName(overlaps).unionByName(by_type)


def verify(spark: SparkSession, root: str, sentences: DataFrame, entail: Callable[[Column, Column], Column]) -> DataFrame:
    """(position, status, score) of drafted sentences against the stored claims they cite.

    A claim that isn't there or belongs to another article can't be verified or doesn't support; else the model decides.
    """
    own = records.latest(table(spark, root, "claims")).select(F.col("id").alias("claim_id"), canonical_id("article_id").alias("_article"), F.coalesce("verbatim", "text").alias("_source"))
    both = sentences.join(own, "claim_id", "left")
    known = F.col("_source").isNotNull() & (F.trim("_source") != "")
    scores = F.when(known & (F.col("_article") == F.col("article_id")) & (F.col("_source") == F.col("passage")), entail(F.col("_source"), F.col("sentence")))
    judged = both.withColumn("_s", scores)
    status = F.when(~F.coalesce(known, F.lit(False)), "unverifiable").when(F.col("_article") != F.col("article_id"), "exists_no_support").otherwise(F.coalesce(review.verdict("_s.entailment", "_s.contradiction"), F.lit("unverifiable")))
    return judged.select("position", status.alias("status"), F.col("_s.entailment").alias("score"))
