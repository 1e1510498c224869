"""Licences with their evidence, what they permit, and provenance records with roles, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import identifiers as I
from corpuscle.functions import lexicons as L
from corpuscle.functions.columns import is_blank, let

LICENCE = "struct<spdx_id:string,family:string,raw_string:string,source_url:string,evidence:string,inference_source:string,policy_conflict:string>"
# Venues whose policy gives a licence, and where the policy is written.
POLICY_VENUES = ("acl", "emnlp", "naacl")
POLICY_SOURCE = "https://aclanthology.org/faq/copyright/"
ROLES = ("citation_source", "pdf_source", "license_evidence")

# Conditions by name.
ATTRIBUTION, NOTICE, NONCOMMERCIAL = "Attribution is required.", "Retain the applicable copyright and license notices.", "Use must be noncommercial."
SHARE_ALIKE, SAME_TERMS = "Distributed adaptations must retain the applicable share-alike terms.", "Distributed adaptations must use the same license terms."
NOT_DISTRIBUTED, NO_ADAPTATIONS = "Adapted material may not be distributed under this license.", "The license does not permit distribution of adaptations."
# Family -> outcome and conditions of redistribution, commercial use and adaptations; other families are unknown.
PROFILES = {
    "cc-by": (("conditional", [ATTRIBUTION]), ("conditional", [ATTRIBUTION]), ("conditional", [ATTRIBUTION])),
    "cc-by-sa": (("conditional", [ATTRIBUTION, SHARE_ALIKE]), ("conditional", [ATTRIBUTION]), ("conditional", [ATTRIBUTION, SAME_TERMS])),
    "cc-by-nd": (("conditional", [ATTRIBUTION, NOT_DISTRIBUTED]), ("conditional", [ATTRIBUTION]), ("prohibited", [ATTRIBUTION, NO_ADAPTATIONS])),
    "cc-by-nc": (("conditional", [NONCOMMERCIAL, ATTRIBUTION]), ("prohibited", []), ("conditional", [NONCOMMERCIAL, ATTRIBUTION])),
    "cc-by-nc-sa": (("conditional", [NONCOMMERCIAL, ATTRIBUTION, SAME_TERMS]), ("prohibited", []), ("conditional", [NONCOMMERCIAL, ATTRIBUTION, SAME_TERMS])),
    "cc-by-nc-nd": (("conditional", [NONCOMMERCIAL, ATTRIBUTION, NO_ADAPTATIONS]), ("prohibited", []), ("prohibited", [NONCOMMERCIAL, ATTRIBUTION, NO_ADAPTATIONS])),
    "cc0": (("permitted", []),) * 3,
    "public-domain": (("permitted", []),) * 3,
    "apache-2.0": (("conditional", [NOTICE]),) * 3,
    "mit": (("conditional", [NOTICE]),) * 3,
    "all-rights-reserved": (("prohibited", []),) * 3,
}


def with_evidence(raw: Column, url: Column, policy: Column) -> Column:
    """The licence of a copy as ``LICENCE``: its raw name, its address and the licence id its policy gives, null for none.

    A name counts before the policy, which is then kept as a conflict where it says otherwise; without a name the policy counts.
    """
    family_of = F.create_map(*chain.from_iterable((F.lit(v[1]), F.lit(v[0])) for v in L.LICENCES.values() if v[1]))

    def licence(x: Column) -> Column:
        raw, url, policy, told, expected = (x[f] for f in ("raw", "url", "policy", "told", "expected"))
        named, known = ~is_blank(raw), told["family"] != "unknown"
        inferred = ~named & policy.isNotNull()
        differs = named & known & policy.isNotNull() & ((told["family"] != expected) | (told["spdx_id"].isNotNull() & (told["spdx_id"] != policy)))
        conflict = F.concat(F.lit("OpenAlex reports '"), raw, F.lit("'; ACL policy evidence indicates "), policy, F.lit(". Explicit OpenAlex metadata was preserved."))
        return F.struct(
            F.when(inferred, policy).otherwise(told["spdx_id"]).alias("spdx_id"), F.when(inferred, expected).otherwise(told["family"]).alias("family"), raw.alias("raw_string"), url.alias("source_url"),
            F.when(inferred, "acl_policy").when(known, "openalex").otherwise("unknown").alias("evidence"), F.when(inferred, POLICY_SOURCE).alias("inference_source"), F.when(differs, conflict).alias("policy_conflict"),
        )

    with_family = lambda x: F.struct(x["raw"].alias("raw"), x["url"].alias("url"), x["policy"].alias("policy"), I.licence(x["raw"]).alias("told"), F.try_element_at(family_of, x["policy"]).alias("expected"))
    return let(let(F.struct(raw.alias("raw"), url.alias("url"), policy.alias("policy")), with_family), licence)


def policy_id(url: Column, venue: Column, year: Column) -> Column:
    """The licence id the policy gives an address of one of its venues and the year of its paper; null for others."""
    return let(url, lambda u: F.when(venue.isin(*POLICY_VENUES) & (I.venue_of_url(u) == venue) & year.isNotNull(), I.acl_policy_licence(u, year)))


def of_location(location: Column, venue: Column, year: Column) -> Column:
    """The licence of one location by its own name and landing page only."""
    filled = lambda f: F.when(~is_blank(location[f]), location[f])
    return with_evidence(filled("license"), filled("landing_page_url"), policy_id(location["landing_page_url"], venue, year))


def of_article(primary: Column, best: Column, others: Column, venue: Column, year: Column) -> Column:
    """The licence of a work: the first one named by the primary or the best open copy, else the one the policy gives the first of all landing pages it covers."""
    named = F.get(F.filter(F.array(primary, best), lambda x: ~is_blank(x["license"])), F.lit(0))
    pages = F.filter(F.transform(F.concat(F.array(primary, best), F.coalesce(others, F.array())), lambda x: x["landing_page_url"]), lambda u: u.isNotNull() & (u != ""))
    policies = lambda found: F.transform(found, lambda u: F.struct(u.alias("url"), policy_id(u, venue, year).alias("policy")))
    covered = lambda found: F.coalesce(F.get(F.filter(found, lambda p: p["policy"].isNotNull()), F.lit(0)), F.get(found, F.lit(0)))
    by_page = let(let(let(pages, policies), covered), lambda p: with_evidence(F.lit(None).cast("string"), p["url"], p["policy"]))
    return let(named, lambda x: F.when(x.isNotNull(), with_evidence(x["license"], x["landing_page_url"], policy_id(x["landing_page_url"], venue, year))).otherwise(by_page))


def is_verified(licence: Column) -> Column:
    """A known family with named or policy evidence and no conflict."""
    return F.coalesce((licence["family"] != "unknown") & licence["evidence"].isin("openalex", "acl_policy") & licence["policy_conflict"].isNull(), F.lit(False))


def profiles(spark: SparkSession) -> DataFrame:
    """The dimension of what families permit: (family, redistribution, commercial_use, adaptations), each struct(outcome, conditions)."""
    decision = "struct<outcome:string,conditions:array<string>>"
    return spark.createDataFrame(list((f, *p) for f, p in PROFILES.items()), f"family string, redistribution {decision}, commercial_use {decision}, adaptations {decision}")


def with_permissions(df: DataFrame, family: str = "family") -> DataFrame:
    """Adds the three decisions; families without a profile are unknown. The dimension has a row per family."""
    unknown = F.struct(F.lit("unknown").alias("outcome"), F.array().cast("array<string>").alias("conditions"))
    dimension = profiles(df.sparkSession)
    names = [c for c in dimension.columns if c != "family"]
    joined = df.join(F.broadcast(dimension.withColumnRenamed("family", "_family")), F.col(family) == F.col("_family"), "left").drop("_family")
    return joined.withColumns({n: F.coalesce(n, unknown) for n in names})


def _place_of(locations: Column, fits) -> Column:
    """The place of the first location that fits, null for none."""
    marked = F.transform(locations, lambda x, i: F.when(fits(x), i))
    return F.get(F.filter(marked, lambda i: i.isNotNull()), F.lit(0))


def provenance(work_id: Column, doi: Column, locations: Column, venue: Column, year: Column, url: Column, pdf_url: Column, licence: Column, at: Column) -> Column:
    """The record of one provider's work: every copy with its own licence and its roles.

    The first copy of the citation's landing page is its source, the first of the PDF's address that of the PDF; the licence
    rests on the first copy of its address with the same licence, else on the first copy with the same licence.
    """
    licensed = F.transform(locations, lambda x: F.struct(x["id"].alias("location_id"), F.nullif(x["landing_page_url"], F.lit("")).alias("landing_page_url"), F.nullif(x["pdf_url"], F.lit("")).alias("pdf_url"), x["version"].alias("version"), of_location(x, venue, year).alias("license")))
    same = lambda x: x["license"].eqNullSafe(licence)
    fields = ("location_id", "landing_page_url", "pdf_url", "version", "license")

    def places(copies: Column) -> Column:
        by_address = _place_of(copies, lambda x: (x["landing_page_url"] == licence["source_url"]) & same(x))
        chosen = (_place_of(copies, lambda x: x["landing_page_url"] == url), _place_of(copies, lambda x: x["pdf_url"] == pdf_url), F.coalesce(by_address, _place_of(copies, same)))
        return F.struct(copies.alias("copies"), F.array(*chosen).alias("chosen"))

    def roles(x: Column) -> Column:
        own = lambda i: F.filter(F.array(*(F.when(F.get(x["chosen"], F.lit(n)) == i, role) for n, role in enumerate(ROLES))), lambda r: r.isNotNull())
        return F.transform(x["copies"], lambda c, i: F.struct(*(c[f].alias(f) for f in fields), own(i).alias("roles")))

    with_roles = let(let(licensed, places), roles)
    record = I.provider_id(work_id)
    return F.struct(F.lit("openalex").alias("provider"), record.alias("provider_record_id"), F.when(record.isNotNull(), F.concat(F.lit("https://openalex.org/"), record)).alias("canonical_record_url"), I.doi(doi).alias("doi"), at.alias("retrieved_at"), with_roles.alias("locations"))


def role_conflicts(articles: DataFrame, provenance_column: str = "provenance", source: str = "source") -> DataFrame:
    """(id, role, problem) of articles whose copies contradict their source: a role given to several copies, or to one that differs."""
    s = F.col(source)
    copies = F.flatten(F.transform(provenance_column, lambda p: p["locations"]))
    wanted = {"citation_source": lambda x: x["landing_page_url"].eqNullSafe(s["url"]), "pdf_source": lambda x: x["pdf_url"].eqNullSafe(s["pdf_url"]), "license_evidence": lambda x: x["license"].eqNullSafe(s["license"])}

    def check(role: str) -> Column:
        own = F.filter(copies, lambda x: F.array_contains(x["roles"], role))
        problem = F.when(F.size(own) > 1, "several").when(F.exists(own, lambda x: ~wanted[role](x)), "differs")
        return F.struct(F.lit(role).alias("role"), problem.alias("problem"))

    return articles.select("id", F.explode(F.array(*(check(r) for r in ROLES))).alias("c")).select("id", "c.role", "c.problem").filter("problem is not null")
