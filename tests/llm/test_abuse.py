import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import abuse as A

DOC, LABEL = "doc_id bigint, text string, source string", "doc_id bigint, toxic int"


def corpus(seed, n):
    """Papers with insults in a tenth of them, in disguise at times; quoted insults are harmless."""
    r = random.Random(seed)
    nouns = ["parser", "model", "index", "corpus", "lattice", "metric", "encoder", "graph"]
    fair = ["The {} improves the {} by 3.5 points.", "We compare a {} with the {} in Fig. 2.", "Human raters prefer the {}, whereas the {} fails.", "Removing the {} lowers recall of the {}.", 'Annotators marked the phrase "you idiot" as abusive in the {} threads of the {}.', "We study how hateful posts about the {} spread in a {}."]
    foul = ["You are a pathetic idiot and your {} is garbage.", "Shut up, you worthless moron, nobody wants your {} here.", "Those people are vermin and must be kept out of the {}."]
    hide = [lambda s: s, lambda s: s, lambda s: s.replace("idiot", "1d10t").replace("moron", "m0r0n").replace("vermin", "v3rm1n"), lambda s: s.replace("idiot", "i d i o t").replace("moron", "m o r o n").replace("vermin", "v e r m i n"), lambda s: s.replace("a", "а").replace("e", "е"), str.upper, lambda s: s.replace("idiot", "idiiiiot").replace("moron", "morooon")]
    docs, truth = [], []
    for i in range(n):
        units = [r.choice(fair).format(r.choice(nouns), r.choice(nouns)) for _ in range(r.randint(2, 6))]
        bad = r.random() < 0.2
        if bad:
            units.insert(r.randrange(len(units) + 1), r.choice(hide)(r.choice(foul).format(r.choice(nouns))))
        docs.append((i, r.choice([" ", "\n"]).join(units), f"s{i % 3}"))
        truth.append(int(bad))
    return docs, truth


def test_held_out_accuracy_with_wrong_labels(spark):
    docs, truth = corpus(1, 1500)
    r = random.Random(2)
    labels = [(i, t if r.random() > 0.04 else 1 - t) for i, t in enumerate(truth[:1000])] + [(5000, 1), (3, None), (None, 1), (4, 7)]
    scored = A.score(spark.createDataFrame(docs, DOC).withColumn("score", F.lit(0)), spark.createDataFrame(labels, LABEL)).collect()
    got = {row["doc_id"]: row["flagged"] for row in scored}
    held = range(1000, 1500)
    right = sum(got[i] and truth[i] for i in held)
    assert right >= 0.9 * sum(truth[i] for i in held) and right >= 0.9 * sum(got[i] for i in held)


def test_table_is_the_kernel_sum():
    """Scoring by one table equals the sum over landmarks of alpha times kernel."""
    docs, _ = corpus(3, 30)
    own = A.Units([d[1] for d in docs], 10)
    marks, alpha = np.array([0, 5, 9]), np.array([0.5, -1.0, 2.0])
    k = own.kernel(np.arange(own.n), marks)
    table = (own.rows(marks).T @ alpha).astype(np.float32)
    assert np.allclose(own.scores(table), k @ alpha, atol=1e-4)
    assert np.allclose(A.document_scores([docs[0][1]], table, 0.0)[0], own.scores(table)[own.owner == 0].max(), atol=1e-5)


def test_disguises_keep_features():
    own = A.Units(["you are vermin here", "you are v3rm1n here", "you are v e r m i n here", "you are VERMIN here", "the lattice of a corpus"])
    k = own.kernel(np.arange(5), np.array([0]))[:, 0]
    assert k[3] == pytest.approx(k[0]) and k[1] > 0.6 * k[0] and k[2] > 0.5 * k[0] and k[4] < 0.3 * k[0]


def test_defined_cases(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (None, "Fine text.", "b"), (4, "word " * 20000, "b"), (4, "word " * 20000, "b")]
    df = spark.createDataFrame(docs, DOC)
    for labels in ([], [(1, 1), (2, 0)], [(4, 0)]):
        rows = A.score(df, spark.createDataFrame(labels, LABEL)).collect()
        assert len(rows) == 6
    assert not any(r["flagged"] for r in rows)
    assert A.score(df.limit(0), spark.createDataFrame([], LABEL)).count() == 0
    assert {(r["source"], r["documents"]) for r in A.rates(A.score(df, spark.createDataFrame([], LABEL))).collect()} == {("a", 2), (None, 1), ("b", 3)}


def test_labels_of_absent_documents_take_no_place_in_the_draw(spark):
    docs = spark.createDataFrame([(1, "a fair text", "s"), (2, "another one", "s"), (3, None, "s")], DOC)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 2002)], LABEL)
    assert sorted(tuple(r) for r in A.labelled(docs, labels, most=10).collect()) == [(1, "a fair text", 1), (2, "another one", 0)]


def test_a_document_that_comes_often_is_drawn_once(spark):
    docs = spark.createDataFrame([(1, "hot", "s")] * 500 + [(1, "later text", "s"), (2, "two", "s"), (4, "long " * 400, "s")], DOC)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (4, 0)], LABEL)
    rows = A.labelled(docs, labels, most_characters=100_000).collect()
    assert sorted((r["doc_id"], r["text"][:5]) for r in rows) == [(1, "hot"), (2, "two")]
    assert A.labelled(docs, labels, most=1).count() == 1


def test_rates_against_brute_force(spark):
    docs, truth = corpus(5, 300)
    scored = A.score(spark.createDataFrame(docs, DOC), spark.createDataFrame(list(enumerate(truth)), LABEL)).cache()
    want = {}
    for r in scored.collect():
        n, bad = want.get(r["source"], (0, 0))
        want[r["source"]] = (n + 1, bad + r["flagged"])
    assert {(r["source"], r["documents"], r["flagged"], r["rate"]) for r in A.rates(scored).collect()} == {(k, n, bad, round(bad / n, 6)) for k, (n, bad) in want.items()}
