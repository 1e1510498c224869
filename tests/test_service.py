"""The service functions and manifests on a small corpus."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import snapshot
from corpuscle.plans import service

AT = dt.datetime(2024, 1, 1)
UID = "00000000-0000-4000-8000-{:012}".format
TEXT = "Low rank adapters keep the parsing accuracy of large models. Something else is said about retrieval here."


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("corpus"))
    source = "struct<venue:string,acl_id:string,arxiv_id:string,doi:string,url:string>"
    spark.createDataFrame([(UID(1), "Adapters for parsing", ["Ada Lovelace"], 2023, ("acl", None, None, None, "u"), None, AT, None)], f"id string, title string, authors array<string>, year int, source {source}, venue_name string, loaded_at timestamp_ntz, deleted_at timestamp_ntz").write.parquet(f"{base}/articles.parquet")
    spark.createDataFrame([(UID(11), UID(1), "abstract", TEXT, 0, AT, None), (UID(12), UID(1), "method", "Graphs and lattices are another thing.", 0, AT, None), (UID(13), UID(1), "method", None, 0, AT, None)], "id string, article_id string, section_type string, text string, char_start int, loaded_at timestamp_ntz, deleted_at timestamp_ntz").write.parquet(f"{base}/chunks.parquet")
    first = TEXT.split(". ")[0] + "."
    claims = [(UID(21), UID(1), UID(11), first, first, 0, len(first), "finding", "certain", 1.0, AT, None), (UID(22), UID(1), UID(11), "Altered text of a claim about parsing adapters here.", "Altered text of a claim about parsing adapters here.", 0, 9, "method", "hedged", None, AT, None), (UID(23), UID(9), UID(11), first, first, 0, len(first), "method", "certain", None, AT, None)]
    spark.createDataFrame(claims, "id string, article_id string, chunk_id string, text string, verbatim string, char_start int, char_end int, claim_type string, hedging_level string, metric_value double, loaded_at timestamp_ntz, deleted_at timestamp_ntz").write.parquet(f"{base}/claims.parquet")
    spark.createDataFrame([(UID(11), [1.0, 0.0]), (UID(12), [0.0, 1.0]), (UID(12), [0.0, 1.0]), (UID(13), None)], "chunk_id string, embedding array<float>").write.parquet(f"{base}/chunk_vectors.parquet")
    return base


def test_search_modes(spark, root):
    encode = lambda q: [0.0, 1.0]
    lexical = service.search(spark, root, "parsing adapters", mode="bm25").collect()
    assert [r["chunk_id"] for r in lexical] == [UID(11)] and lexical[0]["chunk_text"] == TEXT
    dense = service.search(spark, root, "any", 1, "dense", encode).collect()
    assert [(r["chunk_id"], r["dense_rank"]) for r in dense] == [(UID(12), 1)]
    both = service.search(spark, root, "parsing adapters", 5, "rrf", encode).collect()
    assert {r["chunk_id"] for r in both} == {UID(11), UID(12)}
    assert service.search(spark, root, "  ", mode="bm25").count() == 0
    for wrong in (dict(k=0), dict(mode="none"), dict(mode="dense")):
        with pytest.raises(ValueError):
            service.search(spark, root, "x", **wrong)


def test_a_saved_index_gives_the_same(spark, root, tmp_path):
    service.build_index(spark, root, str(tmp_path / "i"))
    both = [[tuple(r) for r in service.search(spark, root, "parsing adapters", mode="bm25", index=i).orderBy("rank").collect()] for i in (None, str(tmp_path / "i"))]
    assert both[0] == both[1] and both[0]
    spark.createDataFrame([(9.0, 9.0, 9.0)], "k1 double, b double, epsilon double").write.mode("overwrite").parquet(str(tmp_path / "i" / "constants"))
    with pytest.raises(ValueError):
        service.search(spark, root, "parsing", mode="bm25", index=str(tmp_path / "i"))


def test_draft_and_verify(spark, root):
    drafted = service.draft(spark, root, "parsing adapters of large models")
    rows = drafted.collect()
    assert [(r["claim_id"], r["article_id"]) for r in rows] == [(UID(21), UID(1))] and rows[0]["sentence"].endswith(".")
    sure = lambda p, h: F.struct(F.lit(0.9).alias("entailment"), F.lit(0.0).alias("contradiction"))
    assert [tuple(r) for r in service.verify(spark, root, drafted, sure).collect()] == [(1, "verified", 0.9)]
    broken = drafted.withColumn("claim_id", F.lit("none"))
    assert [r["status"] for r in service.verify(spark, root, broken, sure).collect()] == ["unverifiable"]
    assert service.draft(spark, root, "unseen topic wholly elsewhere").count() == 0
    counts = {r["counter"]: r["n"] for r in service.diagnostics(spark, root, "parsing adapters of large models").collect()}
    assert counts["relevance_pass"] >= counts["rendered_method"] + counts["rendered_finding"] >= 0 and counts["associated_with_retrieved_chunks"] >= counts["complete"]


def test_look_ups(spark, root):
    assert {r["table_name"]: r["n"] for r in service.health(spark, root).collect()} == {"articles": 1, "chunks": 3, "claims": 3}
    assert {r["id"] for r in service.article_claims(spark, root, UID(1)).collect()} == {UID(21), UID(22)}
    assert [r["id"] for r in service.claims(spark, root, claim_type="method", has_metric=False, limit=1).collect()] == [UID(22)]
    assert service.bibliography(spark, root, [UID(1)]).collect()[0]["bibtex_key"] == "Lovelace2023Adapters"
    for call in (lambda: service.article_claims(spark, root, "x"), lambda: service.bibliography(spark, root, ["x", UID(1)])):
        with pytest.raises(service.NotFound):
            call()


def test_settings_and_reviews(spark, root, tmp_path):
    assert service.Settings.of({"DEFAULT_TOP_K": " ", "RETRIEVAL_MODE": "BM25"}) == service.Settings("data", 10, "bm25")
    for wrong in ({"DEFAULT_TOP_K": "x"}, {"DEFAULT_TOP_K": "51"}, {"RETRIEVAL_MODE": "none"}):
        with pytest.raises(ValueError):
            service.Settings.of(wrong)
    schema = "id string, slug string, generated_at int, is_verified boolean, sentences array<struct<text:string,citations:array<string>,supporting_claim_ids:array<string>,evidence:array<struct<claim_id:string>>>>"
    reviews = spark.createDataFrame([("r", "s", 1, False, [("t", [UID(1)], [], [])]), ("q", "s", 0, True, [])], schema)
    assert [r["id"] for r in service.review_of(reviews, "s").collect()] == ["r"]
    assert [r["id"] for r in service.review_bibliography(spark, root, reviews, "s").collect()] == [UID(1)]
    with pytest.raises(service.NotFound):
        service.review_of(reviews, "none")
    assert {r["table_name"]: r["n"] for r in service.health(spark, root, reviews, str(tmp_path / "no")).collect()} == {"articles": 1, "chunks": 3, "claims": 3, "reviews": 1, "index": 0}


def test_manifests(spark, tmp_path):
    corpus = tmp_path / "corpus"
    (corpus / "raw").mkdir(parents=True)
    (corpus / "raw" / "articles.jsonl").write_text("{}\n")
    one, two = snapshot.build(spark, str(corpus)), snapshot.build(spark, str(corpus))
    assert one["snapshot_id"] == two["snapshot_id"] and one["files"][0]["path"] == "raw/articles.jsonl" and one["files"][0]["artifact"] == "source"
    assert snapshot.verify(spark, str(corpus), one) == []
    snapshot.write(one, str(tmp_path / "m.json"), str(corpus))
    assert json.loads((tmp_path / "m.json").read_text())["snapshot_id"] == one["snapshot_id"]
    (tmp_path / "other.json").write_text("[]")
    for place in (corpus / "m.json", tmp_path / "other.json"):
        with pytest.raises(snapshot.SnapshotError):
            snapshot.write(one, str(place), str(corpus))
    (corpus / "raw" / "articles.jsonl").write_text("{} \n")
    (corpus / "new").write_text("x")
    assert snapshot.verify(spark, str(corpus), one) == ["added: new", "changed: raw/articles.jsonl"]
    assert snapshot.verify(spark, str(corpus), one | {"schema": 2})[0] == "the id doesn't fit the manifest"
    assert not any(map(snapshot.safe_path, ("/a", "../a", "a/../b", "c:\\x", "", "s3:x")))
