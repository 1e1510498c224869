"""Identifiers, addresses, venues and licences of articles."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions import lexicons as L
from corpuscle.functions.columns import col_of, let

# The name space of addresses in UUID version 5.
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def uuid5(namespace: Column, name: Column) -> Column:
    """The version 5 UUID of ``name`` in ``namespace`` (a UUID text)."""
    h = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(name, "UTF-8")))
    nibble = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(nibble, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def corpus_id(acl_id: Column, arxiv_id: Column, own_id: Column) -> Column:
    """The first eight hex digits of the MD5 of the first identifier there is."""
    return F.substring(F.md5(F.coalesce(F.nullif(acl_id, F.lit("")), F.nullif(arxiv_id, F.lit("")), own_id)), 1, 8)


def doi(c: Column | str) -> Column:
    """Lower case, without ``doi:`` and resolver addresses; empty becomes null."""
    c = F.trim(F.regexp_replace(col_of(c), r"(?U)^\s+|\s+$", ""))
    bare = F.regexp_replace(F.regexp_replace(c, r"(?i)^doi:\s*", ""), r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    return F.nullif(F.lower(F.trim(bare)), F.lit(""))


def host(c: Column | str) -> Column:
    """The lower-case host of an address; null without one."""
    return F.lower(F.try_parse_url(col_of(c), F.lit("HOST")))


def is_domain(h: Column, domain: str) -> Column:
    return (h == domain) | h.endswith("." + domain)


def arxiv_id(c: Column | str) -> Column:
    """The number of an arXiv id or address, without its version."""
    return F.nullif(F.regexp_extract(col_of(c), r"(?<!\d)(\d{4}\.\d{4,5})(?:v\d+)?(?!\d)", 1), F.lit(""))


def acl_id(c: Column | str) -> Column:
    """The first path segment of an anthology address without ``.pdf``."""
    c = col_of(c)
    segment = F.regexp_replace(F.regexp_extract(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), r"^/+([^/]+)", 1), r"(?i)\.pdf$", "")
    return F.when(is_domain(host(c), "aclanthology.org") & ~segment.isin("papers", "anthology", ""), segment)


def pdf_source(pdf_url: Column, arxiv: Column) -> Column:
    """The recorded address of the PDF, else the one of the preprint."""
    return F.coalesce(F.nullif(F.trim(pdf_url), F.lit("")), F.concat(F.lit("https://arxiv.org/pdf/"), arxiv))


def last_segment(c: Column | str) -> Column:
    """What follows the last slash."""
    return F.substring_index(F.rtrim(col_of(c)), "/", -1)


def provider_id(c: Column | str) -> Column:
    """A bare ``W...`` id, or the one of a plain provider address without query and fragment."""
    c = F.trim(col_of(c))
    return F.nullif(F.regexp_extract(c, r"^(?:https?://(?:www\.)?openalex\.org/)?(W\d+)$", 1), F.lit(""))


# Venue patterns in order; the association's meeting comes after the others.
_VENUE_NAMES = (
    ("emnlp", r"\bemnlp\b|empirical methods in natural language processing", r"empirical methods in natural language processing"),
    ("naacl", r"\bnaacl\b|north american chapter of the association for computational linguistics", r"north american chapter of the association for computational linguistics"),
    ("coling", r"\bcoling\b|international conference on computational linguistics", r"international conference on computational linguistics"),
    ("iclr", r"\biclr\b|international conference on learning representations", r"international conference on learning representations"),
    ("neurips", r"\bneurips\b|\bnips\b|neural information processing systems", r"neural information processing systems"),
    ("icml", r"\bicml\b|international conference on machine learning", r"international conference on machine learning"),
)
_ACL_MEETING = r"(?:annual meeting|proceedings|conference).{0,100}association for computational linguistics|association for computational linguistics.{0,100}(?:annual meeting|proceedings|conference)"


def venue_of_text(c: Column | str, acronyms: bool = True) -> Column:
    """The venue a name tells; null for none."""
    c = F.lower(col_of(c))
    out = reduce(lambda acc, v: acc.when(c.rlike(v[1 if acronyms else 2]), v[0]), _VENUE_NAMES, F.when(F.lit(False), F.lit(None)))
    acl = c.rlike(_ACL_MEETING) | c.rlike(r"\bacl\b") if acronyms else c.rlike(_ACL_MEETING)
    return out.when(~c.contains("anthology") & acl, "acl")


def venue_of_url(c: Column | str) -> Column:
    """The venue an address tells; null for none."""

    def venue(x: Column) -> Column:
        h = x["host"]
        anthology = F.regexp_extract(x["path"], r"^/(?:papers/)?\d{4}\.(acl|emnlp|naacl|coling)\b", 1)
        return (
            F.when(is_domain(h, "aclanthology.org") & (anthology != ""), anthology)
            .when(is_domain(h, "emnlp.org"), "emnlp")
            .when(is_domain(h, "naacl.org"), "naacl")
            .when(is_domain(h, "iclr.cc"), "iclr")
            .when(is_domain(h, "neurips.cc") | is_domain(h, "nips.cc"), "neurips")
            .when(is_domain(h, "icml.cc"), "icml")
        )

    c = col_of(c)
    return let(F.struct(host(c).alias("host"), F.lower(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))).alias("path")), venue)


def licence(raw: Column | str) -> Column:
    """struct(family, spdx_id) of a provider's licence name; unknown names give ``unknown``."""
    key = F.lower(F.trim(col_of(raw)))
    family = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v[0])) for k, v in L.LICENCES.items()))
    exact = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v[1])) for k, v in L.LICENCES.items() if v[1]))
    return F.struct(F.coalesce(F.try_element_at(family, key), F.lit("unknown")).alias("family"), F.try_element_at(exact, key).alias("spdx_id"))


def acl_policy_licence(url: Column | str, year: Column) -> Column:
    """The licence the anthology's policy gives a paper of its address and year: 2016 or later CC BY, earlier CC BY-NC-SA."""

    def told(segment: Column) -> Column:
        modern = F.regexp_extract(segment, r"(?i)^((?:19|20)\d\d)\.(?:acl|emnlp|naacl)(?:-[a-z0-9]+)*\.\d+$", 1).try_cast("int")
        old = F.regexp_extract(segment, r"(?i)^p(\d\d)-\d+$", 1).try_cast("int")
        return F.coalesce(modern, F.when(old < 90, old + 2000).otherwise(old + 1900))

    agreed = lambda y: F.when(year.isNull() | (y == year), F.when(y < 2016, "CC-BY-NC-SA-3.0").when(y >= 2016, "CC-BY-4.0"))
    return let(let(acl_id(url), told), agreed)
