"""Literal cases of the corpus operators."""

import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpuscle.functions import identifiers as I
from corpuscle.functions import text as T
from corpuscle.operators import chunking, citations, claims, corpus, evaluation, evidence, retrieval, review


def one(spark, column, **values):
    fields = ", ".join(f"{k} {'string' if not isinstance(v, (int, float)) else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], fields).select(column.alias("v")).collect()[0]["v"]


def test_abstract_is_rebuilt(spark):
    df = spark.createDataFrame([({"second": [1], "first": [0, 3]},), (None,), ({"a": [0], "b": [0]},)], "m map<string,array<int>>")
    assert [r[0] for r in df.select(corpus.rebuild_abstract("m")).collect()] == ["first second first", "", "b"]


@pytest.mark.parametrize("url,want", [("https://arxiv.org/abs/2304.01234v3", "2304.01234"), ("12304.01234", None), ("x", None)])
def test_arxiv_id(spark, url, want):
    assert one(spark, I.arxiv_id("u"), u=url) == want


@pytest.mark.parametrize("url,want", [("https://aclanthology.org/2023.acl-long.42/", "2023.acl-long.42"), ("https://www.aclanthology.org/P19-1001.pdf", "P19-1001"), ("https://x.org/2023.acl-long.42", None), ("https://aclanthology.org/papers/x", None)])
def test_acl_id(spark, url, want):
    assert one(spark, I.acl_id("u"), u=url) == want


def test_uuid5_is_the_standard_one(spark):
    for name in ("chunk:0", "chunk:17", "é"):
        assert one(spark, I.uuid5(F.lit(I.URL_NAMESPACE), F.col("n")), n=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


@pytest.mark.parametrize("raw,want", [(" CC-BY-4.0 ", ("cc-by", "CC-BY-4.0")), ("cc-by", ("cc-by", None)), ("elsevier-user-license", ("restricted", None)), ("nonsense", ("unknown", None)), ("mit", ("mit", "MIT"))])
def test_licence(spark, raw, want):
    assert tuple(one(spark, I.licence("l"), l=raw)) == want


@pytest.mark.parametrize("url,year,want", [("https://aclanthology.org/2014.acl-long.1/", 2014, "CC-BY-NC-SA-3.0"), ("https://aclanthology.org/P19-1001/", 2019, "CC-BY-4.0"), ("https://aclanthology.org/P19-1001/", 2020, None), ("https://aclanthology.org/P98-1001/", 1998, "CC-BY-NC-SA-3.0"), ("https://aclanthology.org/2014.x-1/", 2014, None), ("https://aclanthology.org/W19-1001/", 2019, None)])
def test_acl_policy(spark, url, year, want):
    assert one(spark, I.acl_policy_licence("u", F.col("y")), u=url, y=year) == want


@pytest.mark.parametrize("name,want", [("Findings of EMNLP 2020", "emnlp"), ("Annual Meeting of the Association for Computational Linguistics", "acl"), ("ACL Anthology", None), ("Advances in Neural Information Processing Systems", "neurips"), ("Some Journal", None)])
def test_venue(spark, name, want):
    assert one(spark, I.venue_of_text("n"), n=name) == want


@pytest.mark.parametrize("text,want", [("The model reaches an F1 score of 92.5.", ("f1", 92.5)), ("We gain 3.5% accuracy on it.", (None, 3.5)), ("A BLEU of 27 and more", ("bleu", 27.0)), ("It is 250 percent larger.", (None, 250.0)), ("Nothing here.", (None, None))])
def test_metric(spark, text, want):
    assert tuple(one(spark, claims.metric("t"), t=text)) == want


def test_claim_types_and_hedging(spark):
    assert one(spark, claims.claim_type("t"), t="We propose a parser.") == "method"
    assert one(spark, claims.claim_type("t"), t="Models outperform humans.") == "comparison"
    assert one(spark, claims.claim_type("t"), t="We release SQuAD again.") == "dataset"
    assert one(spark, claims.claim_type("t"), t="It cannot parse.") == "limitation"
    assert one(spark, claims.hedging("t"), t="Results suggested a gain.") == "hedged"
    assert one(spark, claims.hedging("t"), t="Perhaps it works.") == "speculative"
    assert one(spark, claims.first_known("t", ["gpt", "gpt-2"]), t="Like GPT-2 it") == "gpt-2"


@pytest.mark.parametrize("text,want", [("This sentence has enough words to stand.", True), ("this one begins with a small letter.", False), ("Too short here.", False), ("This sentence is cut off because of the.", False), ("No final mark is to be seen here", False), ("An ellipsis ends this long sentence...", False), ('She said "this is a complete sentence."', True)])
def test_complete_sentence(spark, text, want):
    assert one(spark, claims.is_complete("t"), t=text) is want


def test_extraction_drops_the_first_sentence_of_a_later_chunk(spark):
    body = "The first sentence has quite enough words. The second sentence has quite enough words."
    df = spark.createDataFrame([("a", "x", 0, body), ("b", "x", 75, body), ("n", "x", 0, None), ("e", "x", 0, "")], "id string, article_id string, char_start int, text string")
    rows = {(r["chunk_id"], r["char_start"]): r for r in claims.extract_claims(df).collect()}
    assert set(rows) == {("a", 0), ("a", 43), ("b", 43)}
    assert all(body[r["char_start"] : r["char_end"]] == r["verbatim"] for r in rows.values())


def test_chunks(spark):
    text = "Sentence with enough words to be retained. " * 20
    found = chunking.windows(text, 150, 30)
    assert len(found) > 1 and all(b - a >= 30 and text[a:b] == text[a:b].strip() for a, b in found)
    assert all(a == 0 or text[a - 1].isspace() for a, _ in found)
    words = lambda n: ("word " * n)[: n]
    assert [len(chunking.windows(words(n))) for n in (900, 199)] == [2, 1]
    df = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, "short")], "doc_id int, text string")
    assert {r["doc_id"] for r in chunking.chunk(df, "doc_id").collect()} == {1}
    assert chunking.chunk(df.limit(0), "doc_id").count() == 0


def test_chunks_keep_to_the_rules():
    """Exact offsets, starts at words, ends at sentence marks where one is in reach, no gap longer than white space."""
    text = "\n".join(f"Sentence {i} has words enough to be kept, and more." + " tail" * (i % 7) for i in range(80))
    found = chunking.windows(text, 300, 60)
    assert all(text[a:b] == text[a:b].strip() and chunking.LEAST <= b - a <= 300 for a, b in found)
    assert all(a == 0 or text[a - 1].isspace() for a, _ in found)
    assert all(c <= b and not text[b:c].strip() for (_, b), (c, _) in zip(found, found[1:]))
    assert all(text[b - 1] in ".!?" or text[b : b + 1] in ("", "\n") or not any(m in text[b - chunking.REACH + 1 : b] for m in ".!?\n") for _, b in found[:-1])
    assert chunking.windows("x" * 950, 300, 60)[0] == (0, 300) and chunking.windows(" \n ", 300, 60) == []


def test_ids_follow_from_their_parents(spark):
    parent = "12345678-1234-5678-1234-567812345678"
    df = spark.createDataFrame([(parent, "Sentence with enough words to be retained. " * 40)], "section_id string, text string")
    rows = chunking.with_chunk_ids(chunking.chunk(df, "section_id")).collect()
    assert len(rows) > 1 and all(r["id"] == str(uuid.uuid5(uuid.UUID(parent), f"chunk:{r['chunk_index']}")) for r in rows)
    (section,) = chunking.abstract_sections(spark.createDataFrame([(parent, "An abstract.")], "id string, abstract string")).collect()
    assert section["section_id"] == str(uuid.uuid5(uuid.UUID(parent), "section:0"))


def test_query_terms(spark):
    assert sorted(one(spark, T.query_terms("q"), q="Comparaison de LoRA et du fine-tuning complet")) == ["comparaison", "complet", "fine", "lora", "tuning"]
    assert [one(spark, T.query_language("q"), q=q) for q in ("مقارنة بين LoRA", "étude des modèles", "a study of models")] == ["ar", "fr", "en"]
    assert one(spark, T.tokens("q"), q="مقارنة بين LoRA") == ["lora"]


@pytest.mark.parametrize("text,want", [("Größe ﬁnal ＬｏＲＡ", ["grosse", "final", "lora"]), ("étude Ångström", ["etude", "angstrom"]), ("أحمد آداب", ["احمد", "اداب"]), ("x² ½", ["x2", "1⁄2"]), ("ǆ ﷲ", ["dz", "الله"]), (None, [])])
def test_terms_are_folded_wholly(spark, text, want):
    """As the standard library's normal forms: compatibility, case folding, no combining marks."""
    got = spark.createDataFrame([(text,)], "q string").select(T.content_terms("q").alias("v")).collect()[0]["v"]
    assert got == want
    assert one(spark, T.normal_query("q"), q="ＬｏＲＡ  vs\u00a0ﬁne") == "LoRA vs fine"
    assert one(spark, T.slug("q"), q="Évaluation œuvre: ﬁn!") == "evaluation-uvre-fin"


def test_comparison_sides(spark):
    assert tuple(one(spark, T.comparison_sides("q"), q="LoRA versus full fine-tuning?")) == ("LoRA", "full fine-tuning")
    assert tuple(one(spark, T.comparison_sides("q"), q="compare between BERT and GPT")) == ("BERT", "GPT")
    assert tuple(one(spark, T.comparison_sides("q"), q="Comparaison entre LoRA et QLoRA ?")) == ("LoRA", "QLoRA")
    assert tuple(one(spark, T.comparison_sides("q"), q="مقارنة بين BERT و GPT")) == ("BERT", "GPT")
    assert tuple(one(spark, T.comparison_sides("q"), q="compare between the and a, LoRA vs. adapters")) == ("compare between the and a, LoRA", "adapters")
    assert one(spark, T.comparison_sides("q"), q="attention in parsers") is None


def test_relevance(spark):
    ok = one(spark, evidence.relevance("q", "c", "t"), q="What is NLP", c="NLP is a field.", t="X")
    assert ok["relevant"] and ok["score"] == 1.0
    no = one(spark, evidence.relevance("q", "c", "t"), q="low resource parsing transfer", c="The parsing field.", t="X")
    assert not no["relevant"]
    titled = one(spark, evidence.relevance("q", "c", "t"), q="low resource parsing transfer", c="The parsing field.", t="On transfer")
    assert titled["relevant"] and titled["score"] == 0.3125


def test_rank_fusion_ties_by_id(spark):
    df = spark.createDataFrame([("q", "b", 1, 1), ("q", "a", 1, 1)], "query_id string, chunk_id string, bm25_rank int, dense_rank int")
    rows = retrieval.reciprocal_rank_fusion(df, ["bm25_rank", "dense_rank"], 5).orderBy("fused_rank").collect()
    assert [r["chunk_id"] for r in rows] == ["a", "b"] and rows[0]["score"] == pytest.approx(2 / 61)


def test_full_outer_fusion(spark):
    schema = "query_id string, doc string, rank int"
    rows = retrieval.fuse(spark.createDataFrame([("q", "a", 1)], schema), spark.createDataFrame([("q", "b", 1), ("q", "a", 2)], schema), 5).orderBy("fused_rank").collect()
    assert [(r["chunk_id"], r["bm25_rank"], r["dense_rank"]) for r in rows] == [("a", 1, 2), ("b", None, 1)]


def test_citation_graph(spark):
    articles = spark.createDataFrame([("a", "W1", ["https://openalex.org/W2", "https://openalex.org/W9"]), ("b", "W2", [])], "id string, openalex_id string, referenced_works array<string>")
    refs = citations.references(articles)
    assert {(r["position"], r["target_article_id"]) for r in refs.collect()} == {(0, "b"), (1, None)}
    (s,) = citations.graph_summary(citations.edges(refs)).collect()
    assert (s["nodes"], s["edges"], s["density"]) == (2, 1, 0.5)
    (e,) = citations.graph_summary(citations.edges(refs.limit(0))).collect()
    assert (e["nodes"], e["density"]) == (0, 0.0)


def test_bibtex(spark):
    source = "struct<venue:string,acl_id:string,arxiv_id:string,doi:string,url:string>"
    df = spark.createDataFrame([("2", ["Lovelace, Ada"], 2023, "The Évaluation of Methods", Row(venue="v", acl_id=None, arxiv_id=None, doi="10.1/x_y", url="u"), None), ("1", ["Ada Lovelace"], 2023, "Evaluation & more", Row(venue="v", acl_id=None, arxiv_id="1", doi=None, url="u"), None), ("3", [], None, None, Row(venue=None, acl_id=None, arxiv_id=None, doi=None, url=None), None)], f"id string, authors array<string>, year int, title string, source {source}, venue_name string")
    rows = {r["id"]: r for r in review.bibtex(df).collect()}
    assert rows["1"]["bibtex_key"] == "Lovelace2023Evaluation" and rows["2"]["bibtex_key"] == "Lovelace2023Evaluationa" and rows["3"]["bibtex_key"] == "Unknown0X"
    assert r"Evaluation \& more" in rows["1"]["entry"] and rows["1"]["entry"].startswith("@misc{") and r"10.1/x\_y" in rows["2"]["entry"]


def test_status_accounting(spark):
    df = spark.createDataFrame([("r", s) for s in ("verified", "hallucinated", "contradicted", "unverifiable")] + [("s", None)], "review_id string, status string")
    rows = {r["review_id"]: r for r in review.status_accounting(df, "review_id").collect()}
    assert (rows["r"]["n_nli_verdicts"], rows["r"]["nli_coverage"], rows["r"]["evaluated_support_rate"]) == (2, 0.5, round(1 / 3, 6))
    assert (rows["s"]["n_citations"], rows["s"]["nli_coverage"]) == (0, 0.0)


def test_audit_and_verdicts(spark):
    df = spark.createDataFrame([("r", "auto_nli", s) for s in ("reference_unresolved", "verified", "contradicted")], "review_id string, auditor string, status string")
    (a,) = review.audit_rates(df, "review_id").collect()
    assert (a["invented_rate"], a["support_rate"]) == (0.0, 0.5)
    p = spark.createDataFrame([(1, 1, 0.1, 0.9), (1, 2, 0.6, 0.0), (2, 1, None, None), (3, 4, 0.9, 0.0), (3, 1, 0.2, 0.1), (3, 2, 0.1, 0.1), (3, 3, 0.1, 0.1)], "c int, premise_order int, entailment double, contradiction double")
    assert {r["c"]: (r["status"], r["score"]) for r in review.fold_verdicts(p, ["c"]).collect()} == {1: ("verified", 0.6), 2: ("unverifiable", None), 3: ("exists_no_support", 0.2)}


def test_recall_and_rank(spark):
    got = spark.createDataFrame([("q", d, r) for r, d in enumerate("abc", 1)] + [("p", d, r) for r, d in enumerate("xbc", 1)], "query_id string, doc string, rank int")
    want = spark.createDataFrame([("q", "b"), ("q", "d"), ("p", "b"), ("none", "z")], "query_id string, doc string")
    rows = {r["query_id"]: (r["recall"], r["rr"]) for r in evaluation.per_query(got, want, 10).collect()}
    assert rows == {"q": (0.5, 0.5), "p": (1.0, 0.5), "none": (0.0, 0.0)}


def test_means_and_ablation(spark):
    df = spark.createDataFrame([("full", 0.83), ("full", 0.84), ("full", 0.82), ("less", 0.5)], "m string, v double")
    rows = {r["m"]: r for r in evaluation.mean_std(df, "m", "v").collect()}
    assert rows["full"]["mean"] == 0.83 and rows["full"]["std"] > 0 and rows["less"]["std"] == 0.0
    (d,) = evaluation.ablation(evaluation.mean_std(df, "m", "v"), "m", "full").collect()
    assert (d["m"], d["delta"]) == ("less", -0.33)


def test_greedy_selection_matches_the_plain_fold(spark):
    import random

    r = random.Random(1)
    rows = [(f"q{q}", f"c{i:03}", f"a{r.randint(0, 9)}", r.choice(evidence.TYPE_ORDER), r.randint(0, 4) / 4, r.randint(1, 20), f"Text {r.randint(0, 60)}") for q in range(3) for i in range(150)]
    schema = "query_id string, id string, article_id string, claim_type string, score double, rank int, text string"
    got = {(x["query_id"], x["id"]) for x in evidence.select_evidence(spark.createDataFrame(rows, schema)).collect()}
    want = set()
    for q in ("q0", "q1", "q2"):
        own = [dict(zip(("id", "article_id", "claim_type", "score", "rank"), x[1:6]), key=x[6].lower()) for x in rows if x[0] == q]
        want |= {(q, x["id"]) for x in evidence.greedy(own)}
    assert got == want


def test_comparisons_cite_both_sides(spark):
    schema = "query_id string, id string, article_id string, claim_type string, score double, rank int, text string"
    rows = [("q", f"c{i}", f"a{i}", "method", 1.0 - i / 100, i, f"BERT number {i}") for i in range(8)] + [("q", "z", "a9", "finding", 0.1, 90, "GPT is last"), ("p", "only", "a", "method", 1.0, 1, "BERT alone")]
    df = spark.createDataFrame(rows, schema)
    sides = evidence.side_terms("BERT versus GPT")
    chosen = {q: [r["id"] for r in evidence.select_evidence(df.filter(F.col("query_id") == q).withColumn("covers", evidence.covers(sides, "text"))).orderBy("position").collect()] for q in "qp"}
    assert chosen == {"q": ["c0", "z", "c1", "c2"], "p": []}
    assert spark.range(1).select(evidence.side_terms("BERT vs GPT", None, {"BERT": "Bidirectional encoder"}.get).alias("s")).collect()[0]["s"] == [["bert", "bidirectional", "encoder"], ["gpt"]]
    assert spark.range(1).select(evidence.side_terms("attention in parsers").alias("s")).collect()[0]["s"] is None


def test_evidence_checks_in_their_order(spark):
    body = "The parser is better than all others here. A second sentence follows it here."
    sentence, second = body[:42], body[43:]
    claim = "id string, article_id string, chunk_id string, text string, verbatim string, char_start int, char_end int"
    rows = [
        ("ok", "A", "c", None, sentence, 0, 42), ("recovered", "A", "c", sentence, "", 5, 47), (None, "A", "c", None, sentence, 0, 42), ("other", "B", "c", None, sentence, 0, 42), ("gone", "X", "c5", None, sentence, 0, 42),
        ("nochunk", "A", "c9", None, sentence, 0, 42), ("stale", "A", "c2", None, sentence, 0, 42), ("empty", "A", "c", "", " ", 0, 1), ("part", "A", "c", None, "Not whole", 0, 9), ("changed", "A", "c", None, sentence.replace("better", "worse"), 0, 42),
        ("nosection", "A", "c3", None, sentence, 0, 42), ("moved", "A", "c4", None, sentence, 0, 42), ("later", "A", "c6", None, sentence, 0, 42), ("inside", "A", "c7", None, second, 0, 34), ("away", "A", "c", None, second, 43, 77),
    ]
    chunks = spark.createDataFrame([("c", "A", body, 0, len(body), "s"), ("c2", "A", body + " ", 0, 78, None), ("c3", "A", body, 0, 77, "s9"), ("c4", "A", body, 3, 80, "s"), ("c5", "X", body, 0, 77, "s"), ("c6", "A", body, 9, 86, None), ("c7", "A", "x" + body[44:], 0, 35, None)], "id string, article_id string, text string, char_start int, char_end int, section_id string")
    chunks = chunks.withColumn("text", F.when(F.col("id") == "c7", "x" + second).otherwise(F.col("text")))
    found = chunks.select(F.col("id").alias("chunk_id"), "article_id", F.when(F.col("id") == "c2", "old").otherwise(F.col("text")).alias("chunk_text")).unionByName(spark.createDataFrame([("c9", "A", body)], "chunk_id string, article_id string, chunk_text string"))
    lower = lambda df: df.withColumn("article_id", F.lower("article_id"))
    judged = evidence.cascade(lower(spark.createDataFrame(rows, claim)), lower(chunks), spark.createDataFrame([("a", "On trees"), ("b", "x")], "id string, title string"), lower(found), lower(spark.createDataFrame([("s", "A", body)], "id string, article_id string, text string")), ["parser quality"])
    assert {r["id"]: r["reject_reason"] for r in judged.collect()} == {
        "ok": None, "recovered": None, None: "missing_claim_id", "other": "article_id_mismatch", "gone": "article_missing", "nochunk": "missing_chunk_metadata", "stale": "retrieved_chunk_inconsistent", "empty": "empty_source_text", "part": "incomplete",
        "changed": "not_verbatim_in_source", "nosection": "source_context_unavailable", "moved": "source_section_mismatch", "later": "source_context_unavailable", "inside": "source_token_boundary", "away": "irrelevant",
    }
    assert {r["id"]: r["offsets"] for r in judged.collect() if r["id"] in ("ok", "recovered", "changed")} == {"ok": "valid", "recovered": "recovered", "changed": "invalid"}
    counts = {r["counter"]: r["n"] for r in evidence.stage_counts(judged).collect()}
    assert (counts["associated_with_retrieved_chunks"], counts["complete"], counts["verbatim_in_chunk"], counts["source_span_valid"], counts["relevance_pass"], counts["rejected_irrelevant"]) == (15, 8, 7, 3, 2, 1)
    assert {(r["overlap"], r["n"], r["passed"]) for r in evidence.overlap_counts(judged).collect()} == {("zero", 1, 0), ("one", 2, 2)}
    shown = spark.createDataFrame([("method",), ("method",), ("limitation",)], "claim_type string")
    assert tuple(evidence.rendered_by_type(shown).collect()[0]) == (2, 0)


def test_bm25_against_the_formula(spark):
    import math

    docs = {"a": "neural parser parser", "b": "neural lattice", "c": "", "d": "graph lattice graph tagger"}
    df = spark.createDataFrame(list(docs.items()), "id string, text string")
    q = spark.createDataFrame([("q", "parser neural neural")], "query_id string, query string")
    tokens = {k: v.split() or ["<empty>"] for k, v in docs.items()}
    n, avg = 4, sum(map(len, tokens.values())) / 4
    df_of = lambda t: sum(t in x for x in tokens.values())
    raw = {t: math.log(n - df_of(t) + 0.5) - math.log(df_of(t) + 0.5) for x in tokens.values() for t in x}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, v in raw.items()}
    want = {}
    for k, x in tokens.items():
        s = sum(idf[t] * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t in ("parser", "neural", "neural"))
        if round(s, 6) > 0:
            want[k] = round(s, 6)
    got = {r["doc"]: r["score"] for r in retrieval.bm25_search(retrieval.bm25_index(df, "id"), q, 10).collect()}
    assert got == pytest.approx(want)


def test_dense_search_in_blocks(spark):
    vectors = spark.createDataFrame([(i, [float(i == 0), float(i == 1), 0.5]) for i in range(4)] + [(9, None), (10, [1.0]), (11, [9.0, None, 9.0])], "doc bigint, v array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "query_id bigint, q array<float>")
    whole = {tuple(r) for r in retrieval.dense_search(vectors, queries, 2).select("query_id", "doc", "rank").collect()}
    assert whole == {(1, 0, 1), (1, 1, 2), (2, 1, 1), (2, 0, 2)}
    assert retrieval.dense_search(vectors, queries.limit(0), 2).count() == 0 and retrieval.dense_search(vectors.limit(0), queries, 2).count() == 0
    assert whole == {tuple(r) for r in retrieval.dense_search(vectors, queries, 2, most=1).select("query_id", "doc", "rank").collect()}


def test_searches_in_parts_and_by_joins_give_the_same(spark):
    import random

    r = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(120)], "doc bigint, text string")
    asked = spark.createDataFrame([(q, " ".join(r.choice(words) for _ in range(4))) for q in range(9)] + [(99, ""), (98, None)], "query_id bigint, query string")
    index = retrieval.bm25_index(docs.repartition(3), "doc")
    rows = lambda df: {(x["query_id"], x["doc"], round(x["score"], 5), x["rank"]) for x in df.collect()}
    assert rows(retrieval.bm25_search(index, asked, 5)) == rows(retrieval.bm25_search(index, asked, 5, most=1)) and index.postings.count() > 0
    assert retrieval.bm25_search(index, asked.filter("query_id > 90"), 5).count() == 0
    vectors = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(60)] + [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [1.0])], "doc bigint, v array<double>")
    queries = vectors.filter("doc < 9").select(F.col("doc").alias("query_id"), F.col("v").alias("q"))
    assert rows(retrieval.dense_search(vectors.repartition(3), queries, 5)) == rows(retrieval.dense_search(vectors, queries, 5, most=8))
    assert retrieval.dense_search(vectors, queries.limit(0), 5).count() == 0


class _Seen:
    """Stands for the documents of an index and keeps the function that a search gives to their tasks."""

    def __init__(self, docs):
        self.docs, self.schema = docs, docs.schema

    def mapInArrow(self, work, schema):  # noqa: N802
        self.work = work
        return self.docs.mapInArrow(work, schema)


def test_a_task_of_a_lexical_search_holds_little_and_hands_on_only_the_best(spark):
    import random
    import tracemalloc
    from dataclasses import replace

    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=30))) for i in range(800)], "doc bigint, text string")
    asked = spark.createDataFrame([(q, " ".join(r.sample(words, 5))) for q in range(3000)], "query_id bigint, query string")
    index = retrieval.bm25_index(docs, "doc")
    seen = _Seen(index.docs)
    retrieval.bm25_search(replace(index, docs=seen), asked, 3)
    # Nearly five million products in one batch, then the same documents in many batches.
    table = index.docs.orderBy("doc").toArrow().combine_chunks()
    tracemalloc.start()
    whole = list(seen.work(iter(table.to_batches())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    parts = list(seen.work(iter(table.to_batches(max_chunksize=50))))
    assert peak < 120e6
    assert sum(b.num_rows for b in whole) == sum(b.num_rows for b in parts) == 3000 * 3
    rows = lambda batches: {tuple(x.values()) for b in batches for x in b.to_pylist()}
    assert rows(whole) == rows(parts)


def test_lexical_search_in_blocks_and_parts_with_ties(spark, monkeypatch):
    import random
    from collections import defaultdict

    r = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(r.choices(words, k=6)) for _ in range(15)]
    # Copies tie; their ids come in no order.
    docs = spark.createDataFrame([(f"d{(i * 37) % 90:02}", texts[i % 15]) for i in range(90)], "doc string, text string")
    asked = spark.createDataFrame([(f"q{q}", " ".join(r.choices(words, k=3))) for q in range(25)] + [(None, "w1 w2")], "query_id string, query string")
    index = retrieval.bm25_index(docs.repartition(2), "doc")
    avg, hits = index.stats.collect()[0]["avgdl"], defaultdict(list)
    for x in index.postings.collect():
        hits[x["term"]].append(x)
    idf = {x["term"]: x["idf"] for x in index.terms.collect()}
    want = set()
    for q, text in asked.collect():
        sums = defaultdict(float)
        for t in text.split():
            for x in hits[t]:
                sums[x["doc"]] += idf[t] * retrieval._saturated(x["tf"], x["length"], avg)
        best = sorted((-round(v, 6), d) for d, v in sums.items() if round(v, 6) > 0)[:7]
        want |= {(q, d, i) for i, (_, d) in enumerate(best, 1)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    got = lambda **x: {(y["query_id"], y["doc"], y["rank"]) for y in retrieval.bm25_search(index, asked, 7, **x).collect()}
    try:
        assert got() == want
        monkeypatch.setattr(retrieval, "MOST_KEPT", 70)
        assert got() == want and got(most=30) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(retrieval, "MOST_KEPT", 10**6)
    seen = _Seen(index.docs)
    retrieval.bm25_search(retrieval.Bm25Index(seen, index.terms, index.stats), asked, 7)
    batches = index.docs.toArrow().to_batches(max_chunksize=13)
    rows = lambda: sorted((str(y["query_id"]), y["doc"]) for b in seen.work(iter(batches)) for y in b.to_pylist())
    monkeypatch.setattr(retrieval, "CELLS", 40)
    monkeypatch.setattr(retrieval, "PRODUCTS", 5)
    assert rows() == sorted((str(q), d) for q, d, _ in want)
