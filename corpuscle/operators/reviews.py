"""Reviews as nested documents: verification of their citations, audits, the newest of each, saved forms.

A review is (id, slug, generated_at, sentences), a sentence struct(text, citations, supporting_claim_ids, evidence), evidence
array<struct(claim_id, article_id, passage)>. Verification works on flat rows and nests the result again.

Defined cases: sentences without citations keep no statuses; a citation of an unknown article can't be resolved (score 0); one
without claims, with claims that don't exist or with another passage than its claim is unverifiable; claims of other articles
don't support it; of several claims the first three count, the strongest verdict wins; a premise without text or without a
verdict of the model counts for nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.columns import strip
from corpuscle.operators import review
from corpuscle.operators.evidence import source_text
from corpuscle.operators.records import first_by

CITATION = ("review_id", "sentence_index", "citation_index")


def citations(reviews: DataFrame) -> DataFrame:
    """(review_id, sentence_index, citation_index, article_id, sentence, supporting_claim_ids, evidence): one row per citation."""
    sentences = reviews.select(F.col("id").alias("review_id"), F.posexplode("sentences").alias("sentence_index", "s"))
    return sentences.select("review_id", "sentence_index", F.posexplode("s.citations").alias("citation_index", "article_id"), F.col("s.text").alias("sentence"), "s.supporting_claim_ids", "s.evidence")


def verdicts(reviews: DataFrame, claims: DataFrame, articles: DataFrame, entail: Callable[[Column, Column], Column]) -> DataFrame:
    """(review_id, sentence_index, citation_index, article_id, sentence, status, score, note) of every citation.

    ``entail(premise, hypothesis)`` gives struct(entailment, contradiction) or null.
    """
    known = articles.select(F.col("id").alias("article_id"), F.lit(True).alias("_known"))
    source = claims.select(F.col("id").alias("claim_id"), F.col("article_id").alias("_claim_article"), source_text().alias("_source"), F.lit(True).alias("_there"))
    each = citations(reviews).join(known, "article_id", "left")
    pairs = each.select("*", F.posexplode_outer("supporting_claim_ids").alias("claim_order", "claim_id")).join(source, "claim_id", "left")
    items = F.filter("evidence", lambda e: (e["claim_id"] == F.col("claim_id")) & (e["article_id"] == F.col("article_id")))
    quoted = (F.size(F.coalesce("evidence", F.array())) <= 0) | ((F.size(items) > 0) & F.forall(items, lambda e: strip(e["passage"]) == F.col("_source")))
    own = F.coalesce(F.col("_claim_article") == F.col("article_id"), F.lit(False))
    marked = pairs.withColumn("_own", own).withColumn("_quoted", F.coalesce(quoted, F.lit(False))).withColumn("_matching", F.col("_own") & F.col("_quoted"))
    # The matching claims come first in their order; the first few are premises.
    order = Window.partitionBy(*CITATION).orderBy(F.col("_matching").desc(), "claim_order")
    premise = F.col("_matching") & (F.col("_n") <= review.MOST_PREMISES) & (F.col("_source") != "")
    judged = marked.withColumn("_n", F.row_number().over(order)).withColumn("_s", F.when(premise, entail(F.col("_source"), F.col("sentence")))).withColumn("_v", review.verdict("_s.entailment", "_s.contradiction"))
    any_of = lambda c: F.max(c.cast("int")) == 1
    has = lambda v: any_of(F.coalesce(F.col("_v") == v, F.lit(False)))
    folded = judged.groupBy(*CITATION, "article_id", "sentence", "_known").agg(
        F.count("claim_id").alias("claims"), any_of(F.col("claim_id").isNotNull() & F.col("_there").isNull()).alias("missing"), any_of(F.col("_own") & ~F.col("_quoted")).alias("invalid"), any_of(F.col("_matching")).alias("matching"),
        has("verified").alias("verified"), has("contradicted").alias("contradicted"), has("exists_no_support").alias("no_support"), F.max("_s.entailment").alias("entailment"),
        any_of(F.col("_matching") & (F.col("_n") <= review.MOST_PREMISES) & (F.col("_source") == "")).alias("empty"),
    )
    cases = (
        (F.col("_known").isNull(), "reference_unresolved", F.lit(0.0), "article_missing_from_corpus"),
        (F.col("claims") == 0, "unverifiable", None, "no_claim_level_evidence_attached"),
        (F.col("invalid"), "unverifiable", None, "evidence_passage_does_not_match_source_claim"),
        (~F.col("matching") & F.col("missing"), "unverifiable", None, "supporting_claim_missing_or_unattributed"),
        (~F.col("matching"), "exists_no_support", None, "supporting_claim_belongs_to_another_article"),
        (F.col("verified"), "verified", F.col("entailment"), "automatic_nli_entailment_indicator"),
        (F.col("contradicted"), "contradicted", F.col("entailment"), "automatic_nli_contradiction_indicator"),
        (F.col("no_support"), "exists_no_support", F.col("entailment"), "automatic_nli_no_support_indicator"),
        (F.col("empty"), "unverifiable", None, "source_claim_text_empty"),
        (F.lit(True), "unverifiable", None, "no_nli_verdict"),
    )
    outcome = F.coalesce(*(F.when(test, F.struct(F.lit(status).alias("status"), (F.lit(None) if score is None else score).cast("double").alias("score"), F.lit(note).alias("note"))) for test, status, score, note in cases))
    return folded.withColumn("_o", outcome).select(*CITATION, "article_id", "sentence", "_o.status", "_o.score", "_o.note")


def verified_reviews(reviews: DataFrame, judged: DataFrame) -> DataFrame:
    """``reviews`` with verification_statuses and nli_score in every sentence."""
    per_sentence = judged.groupBy("review_id", "sentence_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("citation_index", "status"))), lambda x: x["status"]).alias("statuses"), F.round(F.max("score"), 4).alias("nli_score"))
    sentences = reviews.select(F.col("id").alias("review_id"), F.posexplode("sentences").alias("sentence_index", "s")).join(per_sentence, ["review_id", "sentence_index"], "left")
    new = F.struct("s.*", F.coalesce("statuses", F.array().cast("array<string>")).alias("verification_statuses"), "nli_score")
    nested = sentences.select("review_id", F.struct("sentence_index", new.alias("s")).alias("x")).groupBy("review_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["s"]).alias("sentences"))
    return reviews.drop("sentences").join(nested.withColumnRenamed("review_id", "id"), "id", "left")


def audit_entries(judged: DataFrame, articles: DataFrame) -> DataFrame:
    """(review_id, sentence_text, cited_key, status, auditor, note): one entry per citation, with the start of the sentence."""
    last_name = F.element_at(F.split(F.trim(F.get("authors", F.lit(0))), r"\s+"), -1)
    word = F.nullif(F.regexp_replace(F.get(F.split(F.trim("title"), r"\s+"), F.lit(0)), "[^A-Za-z]", ""), F.lit(""))
    keys = articles.select(F.col("id").alias("article_id"), F.concat(F.coalesce(last_name, F.lit("Unknown")), F.coalesce("year", F.lit(0)), F.coalesce(word, F.lit("X"))).alias("_key"))
    note = F.when(F.col("score").isNull(), F.col("note")).otherwise(F.concat("note", F.lit(" | entailment_probability="), F.format_string("%.4f", "score")))
    return judged.join(keys, "article_id", "left").select("review_id", F.substring("sentence", 1, 200).alias("sentence_text"), F.coalesce("_key", F.substring("article_id", 1, 8)).alias("cited_key"), "status", F.lit("auto_nli").alias("auditor"), note.alias("note"))


def newest(reviews: DataFrame) -> DataFrame:
    """The newest review of each slug by generated_at, a verified one before a plain one of the same time; with ``evidence_complete``.

    Evidence is complete where every sentence with claims has its passages.
    """
    latest = first_by(reviews, "slug", F.col("generated_at").desc_nulls_last(), F.col("is_verified").desc_nulls_last(), "id")
    cited = F.filter("sentences", lambda s: F.size(F.coalesce(s["supporting_claim_ids"], F.array())) > 0)
    return latest.withColumn("evidence_complete", F.coalesce(F.forall(cited, lambda s: F.size(F.coalesce(s["evidence"], F.array())) > 0), F.lit(True)))


def save(reviews: DataFrame, path: str) -> None:
    """Writes each review as one JSON document in a folder of its slug, in place of what was there."""
    fields = [c for c in reviews.columns if c != "slug"]
    document = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    writer = reviews.select("slug", document.alias("value")).repartition("slug").write.option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("slug").mode("overwrite").text(path)
