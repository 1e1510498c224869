"""Paged sources, manifests, judgments, links, parsing modes, ids, rewrites."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import citations, claims, evaluation, records, snapshot
from corpuscle.sources import files, paging, works

UID = "12345678-1234-5678-1234-567812345678"


def test_pages_wait_for_errors_and_end_at_a_lost_connection(spark, tmp_path):
    answers = {"*": [([{"id": "W1"}, {"id": "W2"}], "a")], "a": [paging.HttpError(500), ([{"id": "W3"}], "b")], "b": [ConnectionError()]}
    waited = []

    def fetch(cursor):
        answer = answers[cursor].pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert paging.land(spark, paging.pages(fetch, sleep=waited.append), str(tmp_path / "w")) == 3 and waited == [paging.WAIT]
    assert sorted(r["id"] for r in works.landed_works(spark, str(tmp_path / "w")).collect()) == ["W1", "W2", "W3"]
    endless = lambda cursor: ([{"id": "x"}] * 4, "more")
    assert paging.land(spark, paging.pages(endless), str(tmp_path / "m"), most=6) == 6


def test_look_ups_go_in_batches_and_give_up(spark):
    def look_up(keys):
        assert len(keys) <= 50
        return [{"key": k} for k in keys if k != "k7"]

    keys = spark.createDataFrame([(f"k{i}",) for i in range(120)] + [("k1",), (None,)], "arxiv_id string")
    assert paging.looked_up(keys, "arxiv_id", look_up, keys.limit(3)).count() == 116
    waited = []

    def busy(keys):
        raise paging.HttpError(429)

    assert paging.patiently(busy, ["a"], sleep=waited.append) == [] and waited == [5.0, 10.0]


def test_manifest_of_seen_ids(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "id string")
    records.write_manifest(df, str(tmp_path / "m"))
    assert sorted(r["id"] for r in records.read_manifest(spark, str(tmp_path / "m")).collect()) == ["a", "b"]
    assert records.read_manifest(spark, str(tmp_path / "none")).count() == 0
    values = records.grouped(spark.createDataFrame([("x", i, f"v{i}") for i in range(50)] + [("y", 1, "w"), (None, 1, "z")], "k string, n int, v string"), "k", "v", "n").collect()
    assert {r["k"]: r["values"] for r in values} == {"x": [f"v{i}" for i in range(50)], "y": ["w"]}


def test_latest_delivery_is_the_same_in_any_order(spark):
    rows = [("a", 1, v) for v in "pqrst"]
    assert len({records.latest(spark.createDataFrame(r, "id string, loaded_at int, v string").repartition(n)).collect()[0]["v"] for r, n in ((rows, 1), (rows[::-1], 3))}) == 1


def test_judgments_are_read_strictly(spark, tmp_path):
    place = tmp_path / "j.jsonl"
    with pytest.raises(FileNotFoundError):
        evaluation.read_judgments(spark, str(place))
    place.write_text('{"query_id": "q", "query": "x", "relevant_chunk_ids": ["a", "b"]}\n')
    assert evaluation.read_judgments(spark, str(place)).count() == 1
    place.write_text('{"query_id": "q", "query": "x", "relevant_chunk_ids": ["a", "a"]}\n{"query_id": "p", "query": "x", "relevant_chunk_ids": []}\n')
    with pytest.raises(evaluation.UnusableJudgments, match="repeated_id|empty"):
        evaluation.read_judgments(spark, str(place))


def test_links_are_refused_and_modes_are_read(spark, tmp_path):
    (tmp_path / "parsed").mkdir()
    assert snapshot.parsing_mode(spark, str(tmp_path))[0] == "unknown"
    for text, mode in (("x effective_mode=abstract\nMode : pdf\n", "abstract_only"), ("Mode : PDF", "full_text"), ("effective_mode = pdf\neffective_mode=abstract", "mixed"), ("nothing", "unknown")):
        (tmp_path / "parsed" / "parse_log.txt").write_text(text)
        assert snapshot.parsing_mode(spark, str(tmp_path))[0] == mode
    files.refuse_links(str(tmp_path))
    os.symlink(tmp_path / "parsed", tmp_path / "link")
    with pytest.raises(files.UnsafeTree):
        snapshot.build(spark, str(tmp_path))


def test_ids_of_citations_and_claims(spark):
    (c,) = citations.citation_records(spark.createDataFrame([(UID, 3, "W1", None)], "source_article_id string, position int, target_raw_ref string, target_article_id string")).collect()
    assert (c["id"], c["function"]) == (str(uuid.uuid5(uuid.UUID(UID), "citation:3")), "undefined")
    text = "The first sentence has quite enough words. The second sentence has quite enough words."
    rows = claims.extract_claims(spark.createDataFrame([(UID, "x", 0, text)], "id string, article_id string, char_start int, text string")).collect()
    assert {r["id"] for r in rows} == {str(uuid.uuid5(uuid.UUID(UID), f"claim:{n}")) for n in (0, 43)}


@pytest.mark.parametrize("candidate,kept", [("Our model gains 3.5% accuracy on SQuAD here.", True), ("Our model gains 3.6% accuracy on SQuAD here.", False), ("Our model never gains 3.5% accuracy on SQuAD here.", False), ("Our model might gain 3.5% accuracy on SQuAD here.", False), ("Our strong model gains 3.5% accuracy on SQuAD here.", False), ("model gains 3.5", False), (None, False)])
def test_only_safe_rewrites_are_taken(spark, candidate, kept):
    source = "The model gains 3.5% accuracy on SQuAD here."
    got = spark.createDataFrame([(source, candidate)], "s string, c string").select(claims.safe_rewrite("s", "c").alias("v")).collect()[0]["v"]
    assert got == (candidate if kept else source)


def test_top_metric_names(spark):
    df = spark.createDataFrame([("F1",), ("f1 ",), ("bleu",), ("acc",), (None,), (" ",)], "metric_name string")
    assert [tuple(r) for r in claims.top_metric_names(df, 2).collect()] == [("f1", 2), ("acc", 1)]
