import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import near_duplicates as D

SCHEMA = "id string, text string"


def similarity(a, b):
    x, y = Counter(a.lower().replace(".", " ").split()), Counter(b.lower().replace(".", " ").split())
    both = sum((x & y).values())
    return both / max(1, sum((x | y).values()))


def texts(seed, n=120):
    r = random.Random(seed)
    vocabulary = ["the", "of", "a"] * 6 + [f"w{i}" for i in range(60)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([1, 2, 4, 7, 12, 20, 26, 40, 90]))] for _ in range(n // 6)]
    out = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.randint(0, max(1, len(words) // 6))):
            at = r.randrange(len(words) + 1)
            r.choice([lambda: words.insert(at, r.choice(vocabulary)), lambda: words and words.pop(min(at, len(words) - 1)), lambda: r.shuffle(words)])()
        out.append((f"i{i:03}", r.choice([" ", " ", ". "]).join(words)))
    return out


def brute(rows):
    good = sorted({i: t for i, t in rows if i and t is not None and t.replace(".", " ").split()}.items())
    return {(a, b) for k, (a, x) in enumerate(good) for b, y in good[k + 1 :] if similarity(x, y) >= 0.75}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_pairs(spark, seed):
    rows = texts(seed)
    rows += rows[:5] + [("n1", None), ("n2", ""), ("n3", "..."), (None, "the of a"), ("n4", "...")]
    found = D.NearDuplicates(spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit(1)))
    got = [tuple(r) for r in found.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_classes_that_share_their_short_number(spark, monkeypatch):
    monkeypatch.setattr(D, "SHORT_BITS", 5)
    rows = texts(4)
    got = [tuple(r) for r in D.NearDuplicates(spark.createDataFrame(rows, SCHEMA)).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_classes_and_hot_copies(spark):
    rows = [(f"h{i:03}", "the same text of many words again and again") for i in range(60)] + [("x", "the same text of many words again and once"), ("y", "nothing of it")]
    got = {r["id"]: (r["class_id"], r["links"]) for r in D.NearDuplicates(spark.createDataFrame(rows, SCHEMA)).membership().collect()}
    assert got["h059"] == ("h000", 1) and got["x"] == ("x", 1) and got["y"] == ("y", 0)


def test_empty(spark):
    found = D.NearDuplicates(spark.createDataFrame([], SCHEMA))
    assert found.pairs().count() == 0 and found.membership().count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 12, 26, 33, 36, 37, 80, 150, 401])
def test_probes_never_lose_a_pair(size):
    """The probes are worth more than any 2x + y above the threshold, and a group has enough chunks for them."""
    worst = max((2 * x + y for y in range(size + 1) for x in range(min(y, size) + 1) if 4 * (size - x) >= 3 * (size + y)), default=0)
    assert int(D.needed(size)) == worst + 1
    ends = D.group_ends(size)
    m = -(-int(D.needed(int(ends[np.searchsorted(ends, size)]))) // 2)
    random = np.random.default_rng(size)
    t = D.allowed_errors(random.random((1, m)), random.random((1, m)), np.array([worst + 1]))
    assert (t + 1).sum() >= worst + 1 and t.max() <= 1


def test_a_text_of_many_copies_is_spread_over_a_grid(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 7)
    rows = [(f"c{i:03}", "the same words again and again") for i in range(40)] + [(f"d{i}", "a few other copies here") for i in range(3)] + [("e", "the same words again and once")]
    got = [tuple(r) for r in D.NearDuplicates(spark.createDataFrame(rows, "id string, text string")).pairs().collect()]
    same = [(a, b) for a, x in rows for b, y in rows if a < b and x == y]
    linked = {p for p in got if "e" in p}
    assert sorted(p for p in got if "e" not in p) == sorted(same) and len(got) == len(set(got)) and len(linked) in (0, 40)
