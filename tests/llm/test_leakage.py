import random
import re

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import leakage as L

DOC, ITEM = "doc_id bigint, text string", "item_id bigint, text string"


def grams(text, n):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def data(seed):
    r = random.Random(seed)
    vocabulary = ["the", "of"] * 5 + [f"v{i}" for i in range(40)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(r.randint(5, 40)))) for i in range(12)] + [(90, None), (91, ""), (None, "a b c")]
    docs = []
    for i in range(60):
        words = say(r.randint(0, 80))
        if r.random() < 0.5:
            source = (r.choice(items[:12])[1]).split()
            at = r.randrange(len(source))
            words[len(words) // 2 : len(words) // 2] = source[at : at + r.randint(3, 30)]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(words).upper() if r.random() < 0.3 else " ".join(words)))
    return docs + [(100, None), (101, ""), (None, items[0][1])], items


@pytest.mark.parametrize("seed,n", [(1, 12), (2, 4), (3, 1)])
def test_against_brute_force(spark, seed, n):
    docs, items = data(seed)
    got = {(r[0], r[1]): r[2] for r in L.leaks(spark.createDataFrame(docs, DOC).withColumn("item_id", F.lit(7)), spark.createDataFrame(items, ITEM), n).collect()}
    want = {(d, i): len(grams(x, n) & grams(y, n)) for d, x in docs for i, y in items if d is not None and i is not None and grams(x, n) & grams(y, n)}
    assert got == want


def test_several_passes(spark):
    docs, items = data(4)
    a, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    assert {tuple(r) for r in L.leaks(a, b, 4, most_characters=100).collect()} == {tuple(r) for r in L.leaks(a, b, 4).collect()}


def test_a_phrase_doesnt_run_over_documents(spark):
    item = [(1, " ".join(f"t{i}" for i in range(12)))]
    docs = [(1, " ".join(f"t{i}" for i in range(6))), (2, " ".join(f"t{i}" for i in range(6, 12)))]
    assert L.leaks(spark.createDataFrame(docs, DOC).coalesce(1), spark.createDataFrame(item, ITEM)).count() == 0


def test_empty(spark):
    none_docs, none_items = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    some = spark.createDataFrame([(1, "a b c")], DOC)
    assert L.leaks(none_docs, spark.createDataFrame([(1, "a b c")], ITEM), 2).count() == 0
    assert L.leaks(some, none_items, 2).count() == 0
    (row,) = L.leaked_items(some, spark.createDataFrame([(1, "x a b c")], ITEM), 2).collect()
    assert (row["documents"], row["largest_share"]) == (1, round(2 / 3, 6))


def near(doc, item, n, slack):
    """Some start has every word of a phrase within ``slack`` of its place."""
    w, g = ([x for x in re.findall(r"[^\W_]+", (t or "").lower())] for t in (doc, item))
    found = set()
    for at in range(len(g) - n + 1):
        phrase = g[at : at + n]
        for start in range(-n - slack, len(w) + slack):
            if all(phrase[j] in w[max(0, start + j - slack) : max(0, start + j + slack + 1)] for j in range(n)):
                found.add(tuple(phrase))
    return len(found)


@pytest.mark.parametrize("slack", [1, 2])
def test_proximity_against_brute_force(spark, slack):
    docs, items = data(6)
    docs = [(i, re.sub(r"(v7|the)", r"\1 extra", t) if i % 2 else t) for i, t in docs[:40] if t]
    got = {(r[0], r[1]): r[2] for r in L.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), 6, slack).collect()}
    want = {(d, i): near(x, y, 6, slack) for d, x in docs for i, y in items if i is not None and near(x, y, 6, slack)}
    assert got == want


def test_the_index_is_stored_and_searched_again(spark):
    docs, items = data(7)
    stored = L.index(spark.createDataFrame(docs, DOC))
    df = spark.createDataFrame(items, ITEM)
    assert stored.stored_at and {tuple(r) for r in L.search(stored, df, 4).collect()} == {tuple(r) for r in L.leaks(spark.createDataFrame(docs, DOC), df, 4).collect()}
    assert L.search(stored, df, 4, 1).count() >= L.search(stored, df, 4).count() > 0
