"""Rule-based claims: sentence gates, metrics, data sets, models, hedging and types, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import identifiers as I
from corpuscle.functions import lexicons as L
from corpuscle.functions.columns import col_of
from corpuscle.functions.text import any_part, any_word, words_in

PERCENT = r"\b(\d+\.?\d*)\s*(?:%|percent)\b"
FIRST_PERSON = r"\b(?:we|our|this\s+paper|this\s+work)\b"


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(F.trim(col_of(c)), r"\s+"), lambda w: w != ""))


def is_complete(c: Column | str) -> Column:
    """A whole sentence: 20 characters, 5 words, no small first letter, a final mark and no dangling last word."""
    c = F.trim(F.coalesce(col_of(c), F.lit("")))
    core = F.regexp_replace(c, "[\"'”’)\\]}» ]+\\z", "")
    body = F.regexp_replace(core, r"[.!?]\z", "")
    last = F.lower(F.regexp_extract(body, r"(?<![\p{L}\p{M}\p{N}_'-])([\p{L}\p{M}\p{N}_'-]++)[^\p{L}\p{M}\p{N}_'-]*+\z", 1))
    return (F.char_length(c) >= 20) & (word_count(c) >= 5) & ~c.rlike(r"^\p{Ll}") & core.rlike(r"[.!?]\z") & ~core.rlike(r"(?:\.\.\.|…)\z") & (last != "") & ~last.isin(L.TRAILING_WORDS)


def passes_extraction(c: Column | str, char_start: Column, chunk_start: Column) -> Column:
    """The gate at extraction: a complete sentence of at most 600 characters that isn't the first of a later chunk."""
    return is_complete(c) & (F.char_length(F.trim(col_of(c))) <= 600) & ~((char_start == 0) & (chunk_start > 0))


def on_token_borders(text: Column, start: Column, end: Column) -> Column:
    """False where [start, end) of ``text`` begins or ends inside a word, or lies outside."""
    word = lambda at: F.substring(text, at, F.lit(1)).rlike(r"(?U)^[\w]\z")
    inside = lambda at: (at > 0) & (at < F.char_length(text)) & word(at) & word(at + 1)
    return (start >= 0) & (end >= start) & (end <= F.char_length(text)) & ~inside(start) & ~inside(end)


def metric(c: Column | str) -> Column:
    """struct(name, value): the first metric with a number, or number with a metric; else a percentage alone."""
    c = F.lower(col_of(c))
    names = words_in([n.replace("-", "").replace(" ", "") for n in L.METRIC_NAMES])
    percent = F.nullif(F.regexp_extract(c, PERCENT, 1), F.lit("")).try_cast("double")

    def parts(match: Column) -> Column:
        group = lambda i: F.nullif(F.regexp_extract(match, L.METRIC_PATTERN, i), F.lit(""))
        known = lambda v: F.when(F.array_contains(names, F.regexp_replace(v, "[- ]", "")), v)
        number = F.coalesce(group(2), group(3)).try_cast("double")
        name, value = F.coalesce(known(group(5)), known(group(1))), F.when((number > 0) & (number <= 100), number)
        return F.struct(name.alias("name"), value.alias("value"))

    # The text is searched once: groups are taken from the match, which is short, and a lambda's variable is evaluated once.
    found = F.get(F.transform(F.transform(F.array(F.when(c.rlike("[0-9]"), F.regexp_extract(c, L.METRIC_PATTERN, 0)).otherwise("")), parts), lambda m: F.struct(m["name"].alias("name"), F.when(m["name"].isNotNull() | m["value"].isNotNull(), m["value"]).otherwise(percent).alias("value"))), 0)
    return found


def first_known(c: Column | str, terms: list[str]) -> Column:
    """The longest known term that stands in the text as a word, of equal ones the first by name; null for none."""
    c = F.lower(col_of(c))
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    # One pass tells the texts without any term, nearly all of them, from the others.
    return F.when(any_word(c, ordered), F.coalesce(*(F.when(any_word(c, [t]), F.lit(t)) for t in ordered)))


def _inflected(verbs: list[str]) -> list[str]:
    """The forms of the verbs' lemmas."""
    out = []
    for v in verbs:
        stem = v[:-1] if v.endswith("e") else v
        out += [v, f"{v}s", f"{stem}ed", f"{stem}ing"] if not v.endswith("y") else [v, f"{v[:-1]}ies", f"{v[:-1]}ied", f"{v}ing"]
    return out


def hedging(c: Column | str) -> Column:
    """``speculative``, ``hedged`` or ``certain``."""
    c = F.lower(col_of(c))
    return F.when(any_part(c, L.FUTURE_MARKERS) | any_word(c, L.MODAL_SPECULATIVE), "speculative").when(any_word(c, [*L.MODAL_HEDGED, *_inflected(L.HEDGING_VERBS)]), "hedged").otherwise("certain")


def claim_type(c: Column | str) -> Column:
    """The type of a claim, by the first rule that fits."""
    c = F.lower(col_of(c))
    return (
        F.when(any_word(c, L.LIMITATION_MARKERS), "limitation")
        .when(any_word(c, L.KNOWN_DATASETS) & any_part(c, L.RELEASE_VERBS), "dataset")
        .when(any_word(c, L.CONTRIBUTION_VERBS) & c.rlike(FIRST_PERSON), "method")
        .when(any_word(c, L.COMPARISON_VERBS) | c.rlike(r"\b(?:compared?\s+to|versus|vs\.?|over\s+the\s+baseline)\b"), "comparison")
        .when(any_part(c, [*L.MODAL_SPECULATIVE, *L.FUTURE_MARKERS]), "hypothesis")
        .otherwise("finding")
    )


def extract_claims(chunks: DataFrame) -> DataFrame:
    """Claims of (id, article_id, char_start, text) chunks, with an id that follows from the chunk's and the place: complete sentences with their place, type, hedging, metric, data set and model.

    A sentence ends at ``.``, ``!`` or ``?`` with its closing marks before white space.
    """
    parts = F.split(F.col("text"), r"(?<=[.!?][\"')\]]{0,3})(?=\s)")
    # The pieces follow one another without loss: the sum of lengths so far places them, within the row.
    step = lambda done, raw: F.struct((done["end"] + F.char_length(raw)).alias("end"), F.array_append(done["found"], F.struct(done["end"].alias("start"), raw.alias("raw"))).alias("found"))
    begin = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,raw:string>>").alias("found"))
    rows = chunks.filter("text is not null").select(F.col("id").alias("chunk_id"), "article_id", F.col("char_start").alias("chunk_start"), F.explode(F.aggregate(parts, begin, step)["found"]).alias("s"))
    lead = F.char_length("s.raw") - F.char_length(F.regexp_replace(F.col("s.raw"), r"(?U)^\s+", ""))
    sentence = F.regexp_replace(F.col("s.raw"), r"(?U)^\s+|\s+\z", "")
    found = rows.select("chunk_id", "article_id", "chunk_start", F.col("s.start").alias("sent_start"), (F.col("s.start") + lead).alias("char_start"), sentence.alias("verbatim"))
    kept = found.filter(passes_extraction("verbatim", F.col("sent_start"), F.col("chunk_start")))
    m = metric("verbatim")
    return kept.select(
        I.uuid5(F.col("chunk_id"), F.concat(F.lit("claim:"), F.col("char_start"))).alias("id"), "article_id", "chunk_id", "char_start", (F.col("char_start") + F.char_length("verbatim")).alias("char_end"), "verbatim",
        claim_type("verbatim").alias("claim_type"), hedging("verbatim").alias("hedging_level"), m["name"].alias("metric_name"), m["value"].alias("metric_value"),
        first_known("verbatim", L.KNOWN_DATASETS).alias("dataset_name"), first_known("verbatim", L.KNOWN_MODELS).alias("model_name"),
    )


def safe_rewrite(source: Column | str, candidate: Column | str) -> Column:
    """The rewritten sentence if it is whole and has the source's numbers, negations, hedges and content words, else the source."""
    source, candidate = col_of(source), col_of(candidate)
    found = lambda c, pattern: F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))
    numbers, words = (lambda c: found(c, r"[+-]?\d+(?:\.\d+)?%?")), (lambda c: F.array_distinct(found(c, "[a-z0-9]+")))
    same = lambda listed: F.size(F.array_except(F.array_intersect(words(source), words_in(listed)), words(candidate))) + F.size(F.array_except(F.array_intersect(words(candidate), words_in(listed)), words(source))) == 0
    free = words_in([*L.QUERY_STOP_WORDS, *L.GRAMMATICAL])
    changed = F.array_union(F.array_except(words(candidate), words(source)), F.array_except(words(source), words(candidate)))
    kept = is_complete(candidate) & (numbers(source) == numbers(candidate)) & same(L.POLARITY) & same(L.HEDGES) & (F.size(F.array_except(changed, free)) == 0)
    return F.when(F.coalesce(kept, F.lit(False)), F.trim(candidate)).otherwise(source)


def top_metric_names(claims: DataFrame, k: int = 5) -> DataFrame:
    """(metric_name, n): the ``k`` most frequent metric names in small letters, ties by name."""
    named = claims.select(F.lower(F.trim("metric_name")).alias("metric_name")).filter("metric_name != ''")
    return named.groupBy("metric_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "metric_name").limit(k)
