"""Text expressions: tokens, terms, keys, languages. All run inside the JVM."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions import lexicons as L
from corpuscle.functions.columns import col_of, let

TOKEN = r"[a-z0-9]+(?:[-'][a-z0-9]+)*"
# Arabic marks inside words, and letters that are written alike.
ARABIC_MARKS = "ً-ٰٟـ"
TERM = rf"[\p{{L}}\p{{N}}]+(?:[{ARABIC_MARKS}][\p{{L}}\p{{N}}]+)*"
ARABIC_FROM, ARABIC_TO = "أإآٱى", "ااااي"


@lru_cache(1)
def folds() -> tuple[str, str, dict[str, str]]:
    """By rule: letters and numbers whose compatibility form without combining marks is another letter (from, to), and those with several.

    Hangul syllables stay as they are.
    """
    one: dict[str, str] = dict(zip(ARABIC_FROM, ARABIC_TO))
    several: dict[str, str] = {}
    for i in (*range(0xA0, 0xAC00), *range(0xF900, 0xFB50), *range(0xFB50, 0xFFF0)):
        c = chr(i)
        if c in one or c.lower() != c or unicodedata.category(c)[0] not in "LN":
            continue
        plain = unicodedata.normalize("NFKC", c).casefold().translate(str.maketrans(ARABIC_FROM, ARABIC_TO))
        plain = "".join(x for x in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            one[c] = plain
        elif len(plain) > 1:
            several[c] = plain
    return "".join(one), "".join(one.values()), several


def covering(characters, gap: int = 64) -> str:
    """A short character class of ranges that hold the characters; it may hold others between them."""
    parts: list[list[int]] = []
    for i in sorted(map(ord, characters)):
        if parts and i - parts[-1][1] <= gap:
            parts[-1][1] = i
        else:
            parts.append([i, i])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in parts) + "]"


#: Up to here letters fold by a short table.
LATIN_END = 0x180


@lru_cache(1)
def short_folds() -> tuple[str, str]:
    """The folds of Latin letters with accents and of Arabic variants, what nearly all texts need."""
    own = [(a, b) for a, b in zip(*folds()[:2]) if ord(a) < LATIN_END or a in ARABIC_FROM]
    return "".join(a for a, _ in own), "".join(b for _, b in own)


@lru_cache(1)
def unusual() -> str:
    """A class of the letters that the short table leaves to the long one; the German sharp s has its own rule."""
    one, _, several = folds()
    return covering({*one, *several} - {*short_folds()[0], "ß"}, 96)


#: Few ranges around that class, for a quick first test.
OUTSIDE = "[\u00bc-\u00be\u0133-\u1fff\u2070-\uffff]"


def words_in(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def tokens(c: Column | str, remove_stop: bool = True) -> Column:
    """Lower-case alphanumeric tokens; stop words and single characters left out."""
    found = F.regexp_extract_all(F.lower(col_of(c)), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(L.STOP_WORDS)) if remove_stop else found


def _folded(c: Column, source: str, target: str) -> Column:
    return F.translate(F.regexp_replace(F.lower(c), f"[{ARABIC_MARKS}\u0300-\u036f]", ""), source, target)


def fold(c: Column | str) -> Column:
    """Lower case without accents, Arabic marks and spelling variants, for texts without ``unusual`` letters."""
    return F.replace(_folded(col_of(c), *short_folds()), F.lit("ß"), F.lit("ss"))


def fold_wholly(c: Column | str) -> Column:
    """Lower case without accents, marks, compatibility forms and spelling variants; ligatures and the like are spelled out."""
    source, target, several = folds()
    known = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    spelled = lambda t: F.array_join(F.transform(F.split(t, ""), lambda x: F.coalesce(F.try_element_at(known, x), x)), "")
    return let(_folded(col_of(c), source, target), lambda t: F.when(t.rlike(covering(several)), spelled(t)).otherwise(t))


def content_terms(c: Column | str) -> Column:
    """The different folded words and numbers of a text; null gives none."""
    text = F.coalesce(col_of(c), F.lit(""))
    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    # Only the texts with unusual letters go by the long tables.
    return F.array_distinct(F.when(text.rlike(OUTSIDE) & F.lower(text).rlike(unusual()), F.transform(found, fold_wholly)).otherwise(F.transform(found, fold)))


def query_terms(c: Column | str) -> Column:
    """Content terms of more than one character that aren't query stop words."""
    return F.filter(content_terms(c), lambda t: (F.length(t) > 1) & ~t.isin(L.QUERY_STOP_WORDS))


def folded_key(c: Column | str) -> Column:
    """ASCII letters and digits in lower case, single blanks between: the key of equal texts."""
    return F.trim(F.regexp_replace(F.lower(col_of(c)), "[^a-z0-9]+", " "))


def collapse(c: Column | str) -> Column:
    """White space runs as one blank, none outside."""
    return F.trim(F.regexp_replace(col_of(c), r"(?U)\s+", " "))


@lru_cache(1)
def compatibility() -> tuple[str, str, dict[str, str]]:
    """By rule: characters with another compatibility form (from, to), and those whose form has several characters."""
    forms = {c: n for i in (*range(0xA0, 0xAC00), *range(0xF900, 0xFFF0)) if (n := unicodedata.normalize("NFKC", c := chr(i))) != c and n}
    one = {c: n for c, n in forms.items() if len(n) == 1}
    return "".join(one), "".join(one.values()), {c: n for c, n in forms.items() if len(n) > 1}


def normal_query(c: Column | str) -> Column:
    """A query with characters in their compatibility form and single blanks, for matching only."""
    source, target, several = compatibility()
    known = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    plain = F.translate(col_of(c), source, target)
    return collapse(F.array_join(F.transform(F.split(plain, ""), lambda x: F.coalesce(F.try_element_at(known, x), x)), ""))


def query_language(c: Column | str) -> Column:
    """``ar`` by script, ``fr`` by accents or hint words, else ``en``."""
    c = col_of(c)
    arabic = c.rlike("[؀-ۿݐ-ݿࢠ-ࣿ]")
    french = c.rlike("[À-ÖØ-öø-ÿ]") | F.arrays_overlap(content_terms(c), words_in(L.FRENCH_HINTS))
    return F.when(arabic, "ar").when(french, "fr").otherwise("en")


def any_word(c: Column, values: list[str]) -> Column:
    """True if one of the words stands in the (lower-case) text as a whole."""
    return c.rlike(r"\b(?:" + "|".join(re.escape(v).replace(r"\ ", " ").replace(r"\-", "-") for v in values) + r")\b")


def any_part(c: Column, values: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(v) for v in values))


def section_type(heading: Column | str) -> Column:
    """The type of a section heading by the first pattern that fits, else ``other``."""
    c = F.lower(F.trim(col_of(heading)))
    return reduce(lambda acc, p: acc.when(c.rlike(p[0]), p[1]), L.SECTION_PATTERNS[1:], F.when(c.rlike(L.SECTION_PATTERNS[0][0]), L.SECTION_PATTERNS[0][1])).otherwise("other")


def slug(c: Column | str) -> Column:
    """ASCII letters and digits with hyphens between, 60 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(fold_wholly(c), r"[^\x00-\x7f]", ""), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)


def title_case(c: Column | str) -> Column:
    """A capital after every character that is no letter."""
    parts = F.regexp_extract_all(F.lower(col_of(c)), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")


def comparison_sides(c: Column | str) -> Column:
    """struct(left, right) of a query that compares two things; null for others or where a side has no terms.

    A verb with a preposition opens the left side and a conjunction the right one; else a connector parts the whole query.
    The first way that leaves terms on both sides counts.
    """
    c = F.regexp_replace(normal_query(c), f"[{ARABIC_MARKS}]", "")

    def sides(parts: Column) -> Column:
        trim = lambda v: F.regexp_replace(v, r"^[ :,\-?]+|[ :,\-?]+$", "")
        found = F.when(F.size(parts) == 2, F.struct(trim(F.get(parts, 0)).alias("left"), trim(F.get(parts, 1)).alias("right")))
        return F.when((F.size(query_terms(found["left"])) > 0) & (F.size(query_terms(found["right"])) > 0), found)

    ways = [F.split(F.get(F.split(c, rf"(?iu)(?:{verb})\s+{preposition}\s+", 2), 1), rf"(?iu)\s+{conjunction}\s+", 2) for verb, preposition, conjunction in L.COMPARING]
    connector = rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(L.CONNECTORS)})\.?(?=\s|$)"
    return F.coalesce(*(sides(w) for w in (*ways, F.split(c, connector, 2))))
