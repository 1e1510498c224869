import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import survivors as S

SCHEMA = (
    "record_id string, doi string, retrieved_at timestamp_ntz, provider_record_id string, canonical_record_url string, "
    "locations array<struct<landing_page_url:string,pdf_url:string>>, loaded_at timestamp_ntz"
)
T0 = dt.datetime(2024, 1, 1)


def rows(seed, n=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        base = f"10.{r.randint(1, 5)}/Ab{r.randint(1, 4)}"
        doi = r.choice([base, base.upper(), f"doi:{base}", f" https://doi.org/{base.replace('/', '%2F')}\n", "n/a", None, "", "10.5/", "info:doi/" + base])
        places = r.choice([None, [], [(r.choice([None, " ", "a", "b"]), r.choice([None, "", "c"])) for _ in range(r.randint(1, 4))]])
        at = T0 + dt.timedelta(days=r.randint(0, 9))
        out.append((f"r{i % 40:02}", doi, r.choice([None, at, at + dt.timedelta(days=99)]), r.choice([None, " ", "x"]), r.choice([None, "\t", "u"]), places, at))
    seen = {}
    # A record delivered again differs only in loaded_at.
    return [row if row[0] not in seen and not seen.update({row[0]: row}) else (*seen[row[0]][:6], seen[row[0]][6] + dt.timedelta(days=r.randint(1, 9))) for row in out]


def plain(doi):
    import re
    from urllib.parse import unquote

    d = unquote(doi or "").strip().lower()
    d = re.sub(r"^info:doi/|^doi:|^https?://doi.org/", "", d)
    return d if re.fullmatch(r"10\.[^\s/]+/\S+", d) else None


def brute(data):
    first = {}
    for row in data:
        if row[0] not in first or row[6] < first[row[0]][6]:
            first[row[0]] = row
    works = {}
    for row in first.values():
        if plain(row[1]):
            works.setdefault(plain(row[1]), []).append(row)
    out = set()
    for work, members in works.items():
        if len(members) < 2:
            continue
        for field, column in (("provider_record_id", 3), ("canonical_record_url", 4), ("locations", 5)):

            def rank(row):
                recency = row[2].timestamp() if row[2] and row[2] <= row[6] else float("-inf")
                if column < 5:
                    return (-1 if row[column] and row[column].strip() else 0, -recency, row[0])
                blank = lambda v: v if v and v.strip() else None
                pairs = {(blank(a), blank(b)) for a, b in row[5] or []} - {(None, None)}
                return (-len(pairs), -recency, row[0])

            best = min(members, key=rank)
            if rank(best)[0]:
                out.add((work, field, best[0]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, SCHEMA)
    assert {tuple(r)[:3] for r in S.survivors(df).collect()} == brute(data)


def test_one_hot_work_nulls_and_empty(spark):
    data = rows(4) + [(f"h{i:03}", "10.9/hot", T0, "p", None, None, T0) for i in range(200)] + [(None, "10.9/hot", T0, "p", None, None, T0), ("z", "10.9/HOT", None, None, None, None, None)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("field_name", F.lit("clash")).withColumn("value", F.lit(1))
    found = {tuple(r)[:3] for r in S.survivors(df).collect()}
    assert ("10.9/hot", "provider_record_id", "h000") in found and not any(f[0] == "10.9/hot" and f[1] != "provider_record_id" for f in found)
    assert S.survivors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_golden_record(spark):
    data = [("a", "10.1/x", T0, "old", None, None, T0), ("b", "10.1/x", T0 + dt.timedelta(1), "new", " ", [("l", None)], T0 + dt.timedelta(1))]
    (row,) = S.golden_records(spark.createDataFrame(data, SCHEMA)).collect()
    assert (row["provider_record_id"], row["canonical_record_url"], row["locations_from"]) == ("new", None, "b")


def test_a_later_delivery_does_not_replace_one_without_a_doi(spark):
    late = T0 + dt.timedelta(days=1)
    data = [("a", None, T0, "old", None, None, T0), ("a", "10.1/x", T0, "new", None, None, late), ("b", "10.1/x", T0, "b", None, None, T0)]
    assert S.survivors(spark.createDataFrame(data, SCHEMA)).count() == 0


def test_deliveries_of_one_time_are_told_apart_whatever_their_order(spark):
    data = [("a", "10.1/x", T0, v, None, None, T0) for v in "pqrst"] + [("b", "10.1/x", None, "b", None, None, T0)]
    found = {S.survivors(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect()[0]["value"] for rows, n in ((data, 1), (data[::-1], 3), (data[2:] + data[:2], 5))}
    assert len(found) == 1
