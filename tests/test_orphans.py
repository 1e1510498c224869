"""Incremental orphan tracking against a brute-force reading of the definition."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import orphans as ops
from corpuscle.streaming.orphans import OrphanTracker

T0 = dt.datetime(2024, 1, 1)
RECORD = "id string, article_id string, chunk_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
PARENT = "id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
EVIDENCE = "evidence_id string, claim_id string, loaded_at timestamp_ntz"
CITATION = "id string, target_article_id string, loaded_at timestamp_ntz"


def uid(n):
    return f"{n:08x}-0000-4000-8000-{n:012x}"


def spelled(x, r):
    return r.choice([x, x.upper(), f" {x}", f"{x}\n", "{" + x + "}", f"urn:uuid:{x}"])


def make(seed):
    r = random.Random(seed)
    at = lambda: T0 + dt.timedelta(days=r.randint(0, 90))
    gone = lambda t: t + dt.timedelta(hours=1) if r.random() < 0.3 else None

    def parents(low, high):
        rows = [(uid(i), t := at(), gone(t)) for i in range(low, high) for _ in range(r.randint(1, 2)) if r.random() < 0.8]
        return rows

    ref = lambda low, high: r.choice([None, " ", spelled(uid(r.randint(low, high)), r), spelled(uid(low), r)])
    articles, chunks = parents(0, 12), parents(100, 112)
    claims = [(uid(200 + i), ref(0, 13), ref(100, 113), t := at(), gone(t)) for i in range(15)]
    claims += [(c[0], c[1], c[2], c[3] + dt.timedelta(days=2), None) for c in claims[:4]]
    evidence = [(uid(300 + i), ref(200, 217), at()) for i in range(15)]
    citations = [(uid(400 + i), ref(0, 13), at()) for i in range(15)]
    return {"articles": (articles, PARENT), "chunks": (chunks, PARENT), "claims": (claims, RECORD), "evidence": (evidence, EVIDENCE), "citations": (citations, CITATION)}


def expected(data):
    key = lambda x: x.strip().lower().removeprefix("urn:uuid:").strip("{}") or None if x else None
    at = {"articles": 1, "chunks": 1, "claims": 3}
    gone = {"articles": 2, "chunks": 2, "claims": 4}
    known = {}
    for t in at:
        for row in data[t][0]:
            known.setdefault((t, row[0]), []).append((row[at[t]], row[gone[t]] is not None))
    refs = {}
    for table, field, column, parent, when in (("claims", "chunk_id", 2, "chunks", 3), ("claims", "article_id", 1, "articles", 3), ("evidence", "claim_id", 1, "claims", 2), ("citations", "target_article_id", 1, "articles", 2)):
        for row in data[table][0]:
            if key(row[column]):
                k = (table, field, row[0], parent, key(row[column]))
                refs[k] = min(refs.get(k, row[when]), row[when])
    out = set()
    for (table, field, record, parent, k), first in refs.items():
        rows = known.get((parent, k))
        kind = "missing" if not rows else "deleted" if max(rows)[1] else "late" if min(rows)[0] > first else None
        if kind:
            out.add((table, field, record, first.strftime("%Y-%m"), kind))
    return out


def frames(spark, data):
    return {t: spark.createDataFrame(rows, schema) for t, (rows, schema) in data.items()}


def found(state):
    return {tuple(r) for r in ops.report(state).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_increments_give_what_the_definition_says(spark, seed):
    data = make(seed)
    tables = frames(spark, data)
    assert found(ops.orphans(tables)) == expected(data)
    assert found(ops.orphans(tables, ("2024-01-20", "2024-02-20"))) == expected(data)


def test_stream_of_deliveries(spark, tmp_path):
    data = make(3)
    events = []
    for t in ("articles", "chunks"):
        events += [(t, r[0], r[1], r[2], {}) for r in data[t][0]]
    events += [("claims", r[0], r[3], r[4], {"article_id": r[1], "chunk_id": r[2]}) for r in data["claims"][0]]
    events += [("evidence", r[0], r[2], None, {"claim_id": r[1]}) for r in data["evidence"][0]]
    events += [("citations", r[0], r[2], None, {"target_article_id": r[1]}) for r in data["citations"][0]]
    random.Random(0).shuffle(events)
    schema = "table_name string, record_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, refs map<string,string>"
    for i, part in enumerate(itertools.batched(events, len(events) // 2 + 1)):
        spark.createDataFrame(list(part), schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    tracker = OrphanTracker(spark, f"{tmp_path}/state")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = stream.writeStream.foreachBatch(tracker.process).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert found(tracker.state) == expected(data)
    # A new tracker goes on with what was committed.
    again = OrphanTracker(spark, f"{tmp_path}/state")
    assert found(again.state) == expected(data)
    again.process(spark.createDataFrame(events[:20], schema))
    assert found(again.state) == expected(data)


def test_an_increment_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    wanted = lambda rows: [r for r in rows if r[:2] == ("claims", "article_id") and r[4] == "missing"]
    data = next(d for d in map(make, range(4, 99)) if wanted(expected(d)))
    tables = frames(spark, data)
    state = ops.orphans(tables, ("2024-01-20", "2024-02-20"), path=f"{tmp_path}/s")
    counted = {tuple(r) for r in ops.counts(state).collect()}
    assert counted == {tuple(r) for r in ops.counts(ops.orphans(tables)).collect()} and len(counted) > 5
    before = dict(state.manifest["places"])
    missing = wanted(expected(data))[0]
    key = next(c[1] for c in data["claims"][0] if c[0] == missing[2])
    arrived = {"articles": spark.createDataFrame([(key, T0 - dt.timedelta(days=1), None)], PARENT)}
    rest = {t: df.limit(0) for t, df in tables.items() if t not in arrived}
    state.advance(ops.parent_events({**rest, **arrived}), ops.reference_events({**rest, **arrived}))
    after = state.manifest["places"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert missing not in found(state) and sum(r["n"] for r in state.counts().collect()) < sum(r[-1] for r in counted)
    reopened = ops.OrphanStore(spark, f"{tmp_path}/s")
    assert found(reopened) == found(state) and set(reopened.history()) == {3, 4}
    # Four increments, of which the first versions are no longer named.
    kept = {p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("v")}
    assert kept == {f"v{v}" for v in {*before.values(), *after.values()} | {3, 4}}


def test_empty_tables_and_extra_columns(spark):
    data = {t: ([], schema) for t, (_, schema) in make(1).items()}
    assert found(ops.orphans(frames(spark, data))) == set()
    tables = frames(spark, make(1))
    same = found(ops.orphans(tables))
    clashing = {t: df.withColumn("key", F.lit(1)).withColumn("parent_table", F.lit("x")).withColumn("kind", F.lit("y")) for t, df in tables.items()}
    assert found(ops.orphans(clashing)) == same


def test_null_times_and_ids(spark):
    tables = frames(spark, {**make(1), "articles": ([(None, T0, None), (uid(1), None, None)], PARENT), "citations": ([(None, uid(9), T0), (uid(400), uid(1), None), (uid(401), uid(9), None)], CITATION)})
    rows = {r for r in found(ops.orphans(tables)) if r[0] == "citations"}
    assert rows == {("citations", "target_article_id", uid(401), None, "missing")}
