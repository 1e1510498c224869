"""Verification, audits and newest forms of reviews."""

import datetime as dt
import json

from pyspark.sql import functions as F

from corpuscle.operators import reviews

SCHEMA = "id string, slug string, generated_at timestamp, is_verified boolean, sentences array<struct<text:string,citations:array<string>,supporting_claim_ids:array<string>,evidence:array<struct<claim_id:string,article_id:string,passage:string>>>>"
T0 = dt.datetime(2025, 1, 1)


def sentence(text, citations, claims, evidence=()):
    return (text, citations, claims, [tuple(e) for e in evidence])


def tables(spark):
    claims = spark.createDataFrame([("c1", "A", "yes it is", ""), ("c2", "A", None, "no it is not"), ("c3", "B", "other", None), ("c4", "A", "", " "), ("c5", "A", "maybe", None), ("c6", "A", "maybe", None), ("c7", "A", "yes late", None)], "id string, article_id string, verbatim string, text string")
    articles = spark.createDataFrame([("A", ["Ada Lovelace"], 1843, "Notes, on it"), ("B", [], None, None)], "id string, authors array<string>, year int, title string")
    entail = lambda p, h: F.when(p.startswith("yes"), F.struct(F.lit(0.9).alias("entailment"), F.lit(0.0).alias("contradiction"))).when(p.startswith("no"), F.struct(F.lit(0.1).alias("entailment"), F.lit(0.8).alias("contradiction"))).when(p == "maybe", F.struct(F.lit(0.2).alias("entailment"), F.lit(0.1).alias("contradiction")))
    return claims, articles, entail


def test_citations_are_verified_and_nested_again(spark):
    s = [
        sentence("plain", [], []),
        sentence("supported", ["A"], ["c5", "c1"]),
        sentence("contradicted, unknown", ["A", "X"], ["c2"]),
        sentence("nothing attached", ["A"], []),
        sentence("other passage", ["A"], ["c1"], [("c1", "A", "changed")]),
        sentence("same passage", ["A"], ["c1"], [("c1", "A", " yes it is ")]),
        sentence("claim gone", ["A"], ["c9"]),
        sentence("of another article", ["A"], ["c3"]),
        sentence("no text", ["A"], ["c4"]),
        sentence("the fourth doesn't count", ["A"], ["c5", "c6", "c2", "c7"]),
    ]
    df = spark.createDataFrame([("r", "slug", T0, False, s), ("none", "empty", T0, False, [])], SCHEMA)
    claims, articles, entail = tables(spark)
    judged = reviews.verdicts(df, claims, articles, entail)
    out = {r["id"]: r["sentences"] for r in reviews.verified_reviews(df, judged).collect()}
    assert [(x["verification_statuses"], x["nli_score"]) for x in out["r"]] == [
        ([], None), (["verified"], 0.9), (["contradicted", "reference_unresolved"], 0.1), (["unverifiable"], None), (["unverifiable"], None),
        (["verified"], 0.9), (["unverifiable"], None), (["exists_no_support"], None), (["unverifiable"], None), (["contradicted"], 0.2),
    ]
    assert [x["text"] for x in out["r"]] == [x[0] for x in s] and out["none"] is None
    entries = {(e["sentence_text"], e["status"]): e for e in reviews.audit_entries(judged, articles).collect()}
    assert entries["supported", "verified"]["note"] == "automatic_nli_entailment_indicator | entailment_probability=0.9000" and entries["supported", "verified"]["cited_key"] == "Lovelace1843Notes"
    assert entries["contradicted, unknown", "reference_unresolved"]["cited_key"] == "X" and entries["no text", "unverifiable"]["note"] == "source_claim_text_empty"
    assert reviews.verdicts(df.limit(0), claims, articles, entail).count() == 0


def test_newest_review_and_saved_documents(spark, tmp_path):
    whole, bare = sentence("a", ["A"], ["c"], [("c", "A", "p")]), sentence("a", ["A"], ["c"])
    df = spark.createDataFrame([("1", "s", T0, True, [whole]), ("2", "s", T0 + dt.timedelta(days=1), False, [bare]), ("3", "s", T0, False, [whole]), ("4", "t", T0, False, [whole]), ("5", "t", T0, True, [whole])], SCHEMA)
    found = {r["slug"]: (r["id"], r["evidence_complete"]) for r in reviews.newest(df).collect()}
    assert found == {"s": ("2", False), "t": ("5", True)}
    reviews.save(reviews.newest(df), str(tmp_path / "out"))
    reviews.save(reviews.newest(df.filter("slug = 't'")), str(tmp_path / "out"))
    read = {json.loads(r["value"])["id"] for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert read == {"2", "5"}
