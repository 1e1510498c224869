"""Accounting of review sentences, audits and verdicts; bibliography entries."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.columns import col_of
from corpuscle.functions.lexicons import ACCENTS, PLAIN

STATUSES = ("verified", "exists_no_support", "contradicted", "reference_unresolved", "hallucinated", "unverifiable")
#: Entailment and contradiction from which a verdict counts, and premises of a citation.
ENTAILED, CONTRADICTED, MOST_PREMISES = 0.50, 0.40, 3


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole, to six digits."""
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole, 6))


def status_accounting(statuses: DataFrame, by: str) -> DataFrame:
    """Counts and rates of (by, status) rows, one row per citation; each rate names its own denominator."""
    count = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    counted = statuses.groupBy(by).agg(
        F.count("status").alias("n_citations"), count("verified").alias("n_verified"), count("exists_no_support").alias("n_unsupported"), count("contradicted").alias("n_contradicted"),
        count("hallucinated").alias("n_hallucinated"), count("unverifiable").alias("n_unverifiable"), count("reference_unresolved").alias("n_reference_unresolved"),
    )
    verdicts = F.col("n_verified") + F.col("n_unsupported") + F.col("n_contradicted")
    evaluated = F.col("n_nli_verdicts") + F.col("n_reference_unresolved") + F.col("n_hallucinated")
    return (
        counted.withColumn("n_nli_verdicts", verdicts)
        .withColumn("n_evaluated", evaluated)
        .withColumn("nli_coverage", share(F.col("n_nli_verdicts"), F.col("n_citations")))
        .withColumn("nli_support_rate", share(F.col("n_verified"), F.col("n_nli_verdicts")))
        .withColumn("verification_coverage", share(F.col("n_evaluated"), F.col("n_citations")))
        .withColumn("evaluated_support_rate", share(F.col("n_verified"), F.col("n_evaluated")))
        .withColumn("overall_support_rate", share(F.col("n_verified"), F.col("n_citations")))
        .withColumn("overall_hallucination_rate", share(F.col("n_hallucinated"), F.col("n_citations")))
    )


def audit_rates(entries: DataFrame, by: str) -> DataFrame:
    """Per review: invented among human entries, supported among verdicts, of (by, auditor, status) rows."""
    human, verdict = F.col("auditor") != "auto_nli", F.col("status").isin("verified", "exists_no_support", "contradicted")
    count = lambda c: F.count(F.when(c, 1))
    return entries.groupBy(by).agg(share(count(human & (F.col("status") == "hallucinated")), count(human)).alias("invented_rate"), share(count(F.col("status") == "verified"), count(verdict)).alias("support_rate"))


def verdict(entailment: Column | str, contradiction: Column | str) -> Column:
    """The status of one premise by its scores."""
    e, c = col_of(entailment), col_of(contradiction)
    return F.when(e.isNull(), None).when(e >= ENTAILED, "verified").when(c >= CONTRADICTED, "contradicted").otherwise("exists_no_support")


def fold_verdicts(premises: DataFrame, citation: list[str]) -> DataFrame:
    """Per citation the strongest verdict of its first premises and the highest entailment; none gives ``unverifiable``.

    ``premises``: citation columns, premise_order, entailment, contradiction.
    """
    first = premises.withColumn("_n", F.row_number().over(Window.partitionBy(*citation).orderBy("premise_order"))).filter(F.col("_n") <= MOST_PREMISES)
    has = lambda s: F.max((F.col("v") == s).cast("int")) == 1
    return first.withColumn("v", verdict("entailment", "contradiction")).groupBy(*citation).agg(F.when(has("verified"), "verified").when(has("contradicted"), "contradicted").when(has("exists_no_support"), "exists_no_support").otherwise("unverifiable").alias("status"), F.max("entailment").alias("score"))


def newest(reviews: DataFrame, by: str, *order: Column) -> DataFrame:
    """The newest row per key by (generated_at, is_verified)."""
    return reviews.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter("_n = 1").drop("_n")


def _ascii(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, ACCENTS, PLAIN), "[^A-Za-z0-9]", "")


def bibtex_key(authors: Column, year: Column, title: Column) -> Column:
    """Last name, year and the first title word that is no article or preposition, in ASCII."""
    first = F.coalesce(F.get(authors, F.lit(0)), F.lit("Unknown"))
    last = F.when(first.contains(","), F.substring_index(first, ",", 1)).otherwise(F.substring_index(F.trim(first), " ", -1))
    found = F.filter(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("[A-Za-zÀ-ÿ0-9]+"), F.lit(0)), lambda w: ~F.lower(w).isin("a", "an", "the", "of", "for", "on", "in"))
    word = _ascii(F.coalesce(F.get(found, F.lit(0)), F.lit("X")))
    name = _ascii(last)
    return F.concat(F.when(name == "", "Unknown").otherwise(name), F.coalesce(year, F.lit(0)).cast("string"), F.when(word == "", "X").otherwise(word))


def unique_keys(articles: DataFrame) -> DataFrame:
    """(id, bibtex_key): keys of several articles get a, b, c ... from the second on, in the order of their ids.

    Only keys that repeat are numbered, so the window sees no more than their rows.
    """
    keyed = articles.select("id", bibtex_key(F.col("authors"), F.col("year"), F.col("title")).alias("key"))
    n = F.row_number().over(Window.partitionBy("key").orderBy("id")) - 1
    letters = F.when(n == 0, "").when(n <= 26, F.char((n + 96).cast("bigint"))).otherwise(F.concat(F.lit("_"), n.cast("string")))
    return keyed.select("id", F.concat("key", letters).alias("bibtex_key"))


# The commands of special characters.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def escape_latex(c: Column | str) -> Column:
    """Each special character by its command, in one pass."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in LATEX.items()))
    return F.array_join(F.transform(F.split(col_of(c), ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


def bibtex(articles: DataFrame) -> DataFrame:
    """(id, bibtex_key, entry): preprints are misc, anthology papers inproceedings, others article."""
    s = F.col("source")
    kind = F.when(s["arxiv_id"].isNotNull(), "misc").when(s["acl_id"].isNotNull(), "inproceedings").otherwise("article")
    venue = F.coalesce("venue_name", s["venue"], F.lit("Other"))
    line = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"  {name} = {{"), escape_latex(value), F.lit("},")))
    authors = F.array_join(F.transform("authors", escape_latex), " and ")
    entry = F.concat_ws(
        "\n",
        F.concat(F.lit("@"), kind, F.lit("{"), F.col("bibtex_key"), F.lit(",")),
        F.concat(F.lit("  title     = {"), escape_latex("title"), F.lit("},")),
        F.concat(F.lit("  author    = {"), authors, F.lit("},")),
        F.concat(F.lit("  year      = {"), F.col("year").cast("string"), F.lit("},")),
        line("booktitle", F.when(kind == "inproceedings", venue)),
        line("journal  ", F.when(kind == "article", venue)),
        line("eprint   ", s["arxiv_id"]),
        line("archivePrefix", F.when(kind == "misc", "arXiv")),
        line("howpublished", F.when(kind == "misc", F.concat(F.lit("\\url{https://arxiv.org/abs/"), s["arxiv_id"], F.lit("}")))),
        line("doi      ", s["doi"]),
        line("url      ", s["url"]),
        F.lit("}"),
    )
    return articles.join(unique_keys(articles), "id").select("id", "bibtex_key", entry.alias("entry"))
