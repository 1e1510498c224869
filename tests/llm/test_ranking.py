import math
import random

import numpy as np
import pytest

from corpuscle.llm import ranking as R

SCHEMA = "query_id string, chunk_id string, rrf_score double, bm25_rank int, dense_rank int"


def rows(seed, queries=6):
    r = random.Random(seed)
    out = []
    for q in range(queries):
        for i in range(r.randint(1, 12)):
            row = (f"q{q}", f"c{i:02}", r.choice([None, float("nan"), r.randint(0, 5) / 2, math.inf]), r.choice([None, 0, r.randint(1, 6)]), r.choice([None, -1, r.randint(1, 6)]))
            out += [row] * r.randint(1, 2)
        if q % 2:
            out.append((f"q{q}", "best", 99.0, 1 if q > 2 else None, 0 if q < 2 else 1))
    return out


def usable(row):
    score = row[2] if row[2] is not None and row[2] == row[2] else None
    return (score, *(-x if x is not None and x >= 1 else None for x in row[3:]))


def brute_winners(data):
    queries = {}
    for row in data:
        queries.setdefault(row[0], {})[row[1]] = usable(row)
    better = lambda a, b: sum(x is not None and (y is None or x > y) for x, y in zip(a, b))
    return {(q, c) for q, items in queries.items() if len(items) > 1 for c in items if all(better(items[c], items[o]) >= 2 for o in items if o != c)}


def matrix_walk(scores, damping, steps):
    """The transition matrix written out."""
    n = len(scores)
    p = np.zeros((n, n))
    for j in range(scores.shape[1]):
        for i in range(n):
            above = np.flatnonzero(scores[:, j] > scores[i, j])
            if len(above):
                p[i, above] += 1 / len(above) / scores.shape[1]
            else:
                p[i, i] += 1 / scores.shape[1]
    mass = np.full(n, 1 / n)
    for _ in range(steps):
        mass = (1 - damping) / n + damping * mass @ p
    return mass


@pytest.mark.parametrize("seed", range(4))
def test_prefix_sums_equal_the_matrix(seed):
    scores = np.random.default_rng(seed).integers(-1, 6, (15, 3)).astype(float)
    assert np.allclose(R.stationary(scores), matrix_walk(scores, R.DAMPING, R.STEPS))


@pytest.mark.parametrize("seed", range(3))
def test_majority_winners(spark, seed):
    data = rows(seed)
    got = {tuple(x) for x in R.first_by_majority(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == brute_winners(data)


def brute_order(items, steps=R.STEPS):
    """Places in order: those that beat the first by mass go ahead, ordered alike."""
    if not items:
        return []
    code = lambda v: -np.inf if v is None else v
    names = sorted(items)
    scores = np.array([[code(v) for v in items[n]] for n in names], dtype=float)
    mass = np.round(matrix_walk(scores, R.DAMPING, steps), 12)
    walked = [names[i] for i in sorted(range(len(names)), key=lambda i: (-mass[i], names[i]))]
    top = scores[names.index(walked[0])]
    ahead = {n for n, s in zip(names, scores) if (s > top).sum() >= 2}
    return brute_order({n: items[n] for n in ahead}, steps) + [n for n in walked if n not in ahead]


@pytest.mark.parametrize("seed", range(3))
def test_order_against_brute_force(spark, seed):
    data = rows(seed)
    queries = {}
    for row in data:
        have = queries.setdefault(row[0], {}).get(row[1])
        new = usable(row)
        queries[row[0]][row[1]] = new if have is None else tuple(a if b is None or (a is not None and a > b) else b for a, b in zip(new, have))
    got = {}
    for r in R.rank_walk(spark.createDataFrame(data, SCHEMA)).orderBy("query_id", "final_rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == {q: brute_order(items) for q, items in queries.items()}


def test_no_score_decides_by_its_range(spark):
    data = [("q", c, s * 10.0**6, b, d) for c, s, b, d in (("a", 3.0, 3, 3), ("b", 2.0, 1, 1), ("c", 1.0, 2, 2))]
    order = R.rank_walk(spark.createDataFrame(data, SCHEMA)).orderBy("final_rank").collect()
    assert order[0]["chunk_id"] == "b" and order[0]["beats_all"]


def test_large_queries_have_the_same_order(spark):
    data = rows(5, 2)
    df = spark.createDataFrame(data, SCHEMA)
    whole = {(r["query_id"], r["chunk_id"]): (round(r["mass"], 10), r["final_rank"], r["beats_all"]) for r in R.rank_walk(df, steps=3).collect()}
    parts = {(r["query_id"], r["chunk_id"]): (round(r["mass"], 10), r["final_rank"], r["beats_all"]) for r in R.rank_walk(df, block=4, steps=3).collect()}
    assert whole == parts


def test_empty_and_null(spark):
    assert R.rank_walk(spark.createDataFrame([], SCHEMA)).count() == 0
    assert R.rank_walk(spark.createDataFrame([(None, "c", 1.0, 1, 1), ("q", None, 1.0, 1, 1)], SCHEMA)).count() == 0
    (one,) = R.rank_walk(spark.createDataFrame([("q", "c", None, None, None)], SCHEMA)).collect()
    assert one["final_rank"] == 1 and not one["beats_all"]
