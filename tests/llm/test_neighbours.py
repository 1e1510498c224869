import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import neighbours as N

SCHEMA = "chunk_id string, embedding array<float>"


def data(seed, n=300, copies=12):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(8, 64))
    v = centres[random.integers(0, 8, n)] + 0.35 * random.normal(size=(n, 64))
    v[:copies] = v[0]
    v[copies : copies + 5] *= 7
    return [(f"c{i:04}", [float(x) for x in row.astype(np.float32)]) for i, row in enumerate(v)]


def brute(rows, k=5, least=0.85):
    good = {}
    for name, v in rows:
        if name and v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(name, np.array(v, np.float32).astype(float))
    names = sorted(good)
    unit = np.array([good[n] / np.linalg.norm(good[n]) for n in names])
    cosine = np.round(unit @ unit.T, 6)
    out = set()
    for i, n in enumerate(names):
        order = sorted((-cosine[i, j], m) for j, m in enumerate(names) if j != i and cosine[i, j] >= least)
        out |= {(n, m) for _, m in order[:k]}
    return out


@pytest.mark.parametrize("options", [{}, {"width": 4, "tables": 12}, {"width": 6, "radius": 1, "tables": 8}, {"width": 2, "tables": 6, "block": 16}])
def test_recall_against_brute_force(spark, options):
    rows = data(1)
    rows += rows[3:6]
    got = {(r[0], r[1]) for r in N.neighbours(spark.createDataFrame(rows, SCHEMA), **options).collect()}
    want = brute(rows)
    assert len(got & want) >= 0.98 * len(want) and len(got) >= 0.98 * len(want)
    copies = {(a, b) for a, b in want if a < "c0012" and b < "c0012"}
    assert copies <= got


def test_unusable_rows(spark):
    rows = data(2, 40, 2)
    bad = [("n1", None), ("n2", [1.0] * 63), ("n3", [0.0] * 64), ("n4", [float("nan")] + [1.0] * 63), ("n5", [float("inf")] + [1.0] * 63), ("n6", [None] + [1.0] * 63), (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad, SCHEMA).withColumn("rid", F.lit("x")).withColumn("v", F.lit(1))
    got = {(r[0], r[1]) for r in N.neighbours(df).collect()}
    assert got == brute(rows)
    assert N.neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert N.neighbours(spark.createDataFrame(bad, SCHEMA)).count() == 0


@pytest.mark.parametrize("count", [100_000, 13_000_000, 1_700_000_000])
def test_recall_keeps_up_with_the_size(spark, count):
    """Planned for large collections, with their long substrings, the index finds as much."""
    tables, width, radius = N.plan(count)
    rows = data(4, 500, 0)
    got = {(r[0], r[1]) for r in N.neighbours(spark.createDataFrame(rows, SCHEMA), count=count).collect()}
    want = brute(rows)
    assert len(got & want) >= 0.95 * len(want) and count / 2**width < 200_000


def test_a_pair_at_the_least_cosine_meets():
    random = np.random.default_rng(3)
    a, noise = random.normal(size=(2, 2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    b = 0.85 * a + np.sqrt(1 - 0.85**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    for count in (100_000, 13_000_000, 1_700_000_000):
        tables, width, radius = N.plan(count)
        rotations = N.fit_rotations(a, tables * width, rounds=2)
        x, y = (N.substrings(v, rotations, tables, width) for v in (a, b))
        assert ((np.bitwise_count(x ^ y) <= radius).any(axis=1)).mean() >= 0.95
