"""Scans, sinks, incremental ingest and works."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from corpuscle.operators import corpus, records
from corpuscle.sources import files, jsonl, works
from corpuscle.streaming import ingest

SCHEMA = StructType().add("id", StringType()).add("n", IntegerType())


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines))
    return str(path)


def test_lenient_scan_drops_what_it_cannot_read(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", ['{"id": "x", "n": 1}', "", "{broken", '{"id": "y", "n": 2}', '{"id": "z", "n": -1}'])
    assert {r["id"] for r in jsonl.scan_lenient(spark, p, SCHEMA, F.col("n") > 0).collect()} == {"x", "y"}
    assert jsonl.scan_lenient(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_strict_scan_names_the_line(spark, tmp_path):
    good = write(tmp_path / "g.jsonl", ['{"id": "x", "n": 1}', "", '{"id": "y", "n": 2}'])
    assert jsonl.scan_strict(spark, good, SCHEMA).count() == 2
    bad = write(tmp_path / "b.jsonl", ['{"id": "x", "n": 1}', "", "{broken"])
    with pytest.raises(jsonl.MalformedRecord, match="b.jsonl:3"):
        jsonl.scan_strict(spark, bad, SCHEMA)
    assert jsonl.invalid_lines(spark, bad).collect()[0]["invalid"] == 1


def test_last_line_of_a_key_wins(spark, tmp_path):
    p = write(tmp_path / "d.jsonl", ['{"id": "x", "n": 1}', '{"id": "x", "n": 3}', '{"id": "y", "n": 2}'])
    assert {tuple(r) for r in jsonl.last_by_key(spark, p, SCHEMA, "id").collect()} == {("x", 3), ("y", 2)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], SCHEMA)
    jsonl.append(df, str(tmp_path / "out"))
    jsonl.append(df, str(tmp_path / "out"))
    assert jsonl.scan_strict(spark, str(tmp_path / "out"), SCHEMA).count() == 2
    jsonl.overwrite(df, str(tmp_path / "out"))
    assert jsonl.scan_strict(spark, str(tmp_path / "out"), SCHEMA).count() == 1
    jsonl.write_text(df, "id", str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).collect()[0][0] == "x"


def test_files_and_snapshot(spark, tmp_path):
    import hashlib

    write(tmp_path / "t" / "a.txt", ["hello"])
    write(tmp_path / "t" / "sub" / "b.txt", ["x" * 2000])
    found = {r["path"].rsplit("/", 1)[1]: (r["size"], r["sha256"]) for r in files.tree(spark, str(tmp_path / "t")).collect()}
    assert found["a.txt"] == (5, hashlib.sha256(b"hello").hexdigest())
    assert {r["path"].rsplit("/", 1)[1] for r in files.cached_documents(spark, str(tmp_path / "t")).filter("usable").collect()} == {"b.txt"}


def test_incremental_ingest_adds_each_id_once(spark, tmp_path):
    for i, ids in enumerate(("ab", "bc", "cd")):
        write(tmp_path / "in" / f"{i}.json", [json.dumps({"id": x, "n": i}) for x in ids])
    target = str(tmp_path / "out")
    for _ in range(2):
        q = ingest.json_stream(spark, str(tmp_path / "in"), SCHEMA, 1).writeStream.foreachBatch(ingest.append_once("id", target)).option("checkpointLocation", str(tmp_path / f"c{_}")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == list("abcd")


def test_works_become_articles(spark, tmp_path):
    words = [f"word{i}" for i in range(20)]
    place = {"landing_page_url": "https://aclanthology.org/2023.acl-long.1/", "pdf_url": "https://aclanthology.org/2023.acl-long.1.pdf", "license": "cc-by", "source": {"display_name": "Proceedings of the Annual Meeting of the Association for Computational Linguistics"}}
    work = {"id": "https://openalex.org/W1", "title": " A title ", "publication_year": 2023, "abstract_inverted_index": {w: [i] for i, w in enumerate(words)}, "authorships": [{"author": {"display_name": " Ada "}}, {"author": {"display_name": ""}}], "primary_location": place, "locations": [place], "doi": "https://doi.org/10.1/X", "referenced_works": ["https://openalex.org/W2"], "ids": {}, "cited_by_count": 3}
    short = {**work, "id": "https://openalex.org/W2", "abstract_inverted_index": {"a": [0]}}
    old = {**work, "id": "https://openalex.org/W3", "publication_year": 2001}
    write(tmp_path / "p.json", [json.dumps({"results": [work, short, old]})])
    rows = corpus.works_to_articles(works.landed_works(spark, str(tmp_path / "p.json"))).collect()
    assert len(rows) == 1
    a = rows[0]
    assert (a["title"], a["authors"], a["venue"], a["acl_id"], a["doi"], a["provider_id"], a["referenced_works"], a["license"]["family"]) == ("A title", ["Ada"], "acl", "2023.acl-long.1", "10.1/x", "W1", ["W2"], "cc-by")
    assert a["abstract"] == " ".join(words)
    ids = spark.createDataFrame([("2304.01234",), ("1",)], "arxiv_id string")
    assert works.lookup_works(works.landed_works(spark, str(tmp_path / "p.json")), ids).filter("id is null").count() == 2


def test_latest_and_unseen(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("b", 1, None), (None, 1, None)], "id string, loaded_at int, deleted_at int")
    assert {(r["id"], r["loaded_at"]) for r in records.latest(df).collect()} == {("a", 2), ("b", 1)}
    assert {r["id"] for r in records.current(df).collect()} == {"b"}
    assert {r["id"] for r in records.unseen(df, df.filter("id = 'a'"), "id").collect() if r["id"]} == {"b"}
