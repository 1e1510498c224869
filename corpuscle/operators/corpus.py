"""Works to articles, and statistics of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import identifiers as I
from corpuscle.functions.columns import col_of, settle
from corpuscle.operators import licences

YEARS, LEAST_ABSTRACT, MOST_AUTHORS = (2019, 2025), 50, 20


def rebuild_abstract(index: Column | str) -> Column:
    """The text of a map from words to their positions; at one position the later word wins, gaps are skipped."""
    entries = F.map_entries(col_of(index))
    placed = F.flatten(F.transform(entries, lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("at"), i.alias("order"), e["key"].alias("word")))))
    ordered = F.array_sort(placed)
    last = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i + 1)["at"] != x["at"], F.lit(True)))
    return F.coalesce(F.array_join(F.transform(last, lambda x: x["word"]), " "), F.lit(""))


def all_locations(*parts: Column) -> Column:
    """The different locations of single structs and arrays of them, in first-seen order, without nulls."""
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: x.isNotNull()))


def location_venue(x: Column) -> Column:
    """The venue of one location: by its name, else its address, else its host's full name."""
    return F.coalesce(I.venue_of_text(x["name"]), I.venue_of_url(x["landing_page_url"]), I.venue_of_text(x["host"], acronyms=False))


def article_venue(locations: Column, arxiv: Column) -> Column:
    """The first location whose name or address tells a venue; else ``arxiv`` by its id, else ``other``."""
    names = F.transform(locations, location_venue)
    return F.coalesce(F.get(F.filter(names, lambda v: v.isNotNull()), F.lit(0)), F.when(arxiv.isNotNull(), "arxiv"), F.lit("other"))


_PLACE = "struct<id:string,landing_page_url:string,pdf_url:string,version:string,license:string,name:string,host:string>"


def works_to_articles(works: DataFrame, retrieved_at: Column | None = None) -> DataFrame:
    """Articles of provider works: with a title, an abstract of 50 characters, a year of 2019 to 2025 and an address.

    Columns of ``works``: id, title, publication_year, abstract_inverted_index,
    authorships, primary_location, best_oa_location, locations, ids, open_access, doi,
    cited_by_count, referenced_works. Each article has its licence with evidence and
    its provenance, a record of all copies with their roles.
    """
    place = lambda c: F.when(c.isNotNull(), F.struct(c["id"].alias("id"), c["landing_page_url"].alias("landing_page_url"), c["pdf_url"].alias("pdf_url"), c["version"].alias("version"), c["license"].alias("license"), c["source"]["display_name"].alias("name"), c["source"]["host_organization_name"].alias("host")))
    listed = F.filter(F.coalesce(F.transform("locations", place), F.array().cast(f"array<{_PLACE}>")), lambda x: x.isNotNull())
    base = settle(works, abstract=rebuild_abstract("abstract_inverted_index"), _primary=place(F.col("primary_location")), _best=place(F.col("best_oa_location")), _listed=listed)
    base = settle(base, _published=F.concat(F.filter(F.array("_primary"), lambda x: x.isNotNull()), F.col("_listed")), _all=all_locations(F.array("_primary"), F.array("_best"), F.col("_listed")))
    is_arxiv = lambda u: F.coalesce(I.is_domain(I.host(u), "arxiv.org"), F.lit(False))
    first = lambda column, keep: F.get(F.filter(column, keep), F.lit(0))
    arxiv = F.coalesce(I.arxiv_id(F.col("ids.arxiv")), first(F.transform("_all", lambda x: F.when(is_arxiv(x["landing_page_url"]), I.arxiv_id(x["landing_page_url"]))), lambda v: v.isNotNull()))
    base = settle(settle(base, _arxiv=arxiv), venue=article_venue(F.col("_published"), F.col("_arxiv")))
    pages = F.filter(F.transform("_published", lambda x: x["landing_page_url"]), lambda u: u.isNotNull() & (u != ""))
    # The venue's own page counts first, then any page that isn't the preprint's.
    own_page = first("_published", lambda x: (~F.col("venue").isin("arxiv", "other")) & (location_venue(x) == F.col("venue")) & x["landing_page_url"].isNotNull() & ~is_arxiv(x["landing_page_url"]))
    preprint = F.concat(F.lit("https://arxiv.org/abs/"), F.col("_arxiv"))
    recorded = F.coalesce(F.nullif(F.col("open_access.oa_url"), F.lit("")), F.get("_published", F.lit(0))["pdf_url"])
    on_arxiv = (F.col("venue") == "arxiv") & F.col("_arxiv").isNotNull()
    base = settle(base, _own=own_page)
    own_page = F.col("_own")
    page = F.coalesce(own_page["landing_page_url"], first(pages, lambda u: ~is_arxiv(u)), F.get(pages, F.lit(0)))
    base = settle(base, pdf_url=F.when(on_arxiv, I.pdf_source(recorded, F.col("_arxiv"))).otherwise(recorded), url=F.when(on_arxiv, preprint).otherwise(F.coalesce(page, preprint, recorded)), license=licences.of_article(F.col("_primary"), F.col("_best"), F.col("_published"), F.col("venue"), F.col("publication_year")))
    at = F.current_timestamp() if retrieved_at is None else retrieved_at
    record = licences.provenance(F.col("id"), F.col("doi"), F.col("_all"), F.col("venue"), F.col("publication_year"), F.col("url"), F.col("pdf_url"), F.col("license"), at)
    # The cut to the first authors comes before blank names are left out.
    names = F.filter(F.transform(F.slice("authorships", 1, MOST_AUTHORS), lambda a: F.trim(a["author"]["display_name"])), lambda n: n.isNotNull() & (n != ""))
    named_place = F.coalesce(own_page["name"], F.get("_published", F.lit(0))["name"], first(F.transform("_published", lambda x: x["name"]), lambda n: n.isNotNull() & (n != "")))
    acl = first(F.transform("_all", lambda x: I.acl_id(x["landing_page_url"])), lambda v: v.isNotNull())
    out = base.select(
        I.uuid5(F.lit(I.URL_NAMESPACE), F.concat(F.lit("https://openalex.org/"), F.coalesce(I.provider_id("id"), F.replace("id", F.lit("https://openalex.org/"), F.lit(""))))).alias("id"),
        F.trim("title").alias("title"), F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("Unknown"))).alias("authors"), F.col("publication_year").alias("year"), "abstract", "venue", F.col("_arxiv").alias("arxiv_id"),
        acl.alias("acl_id"), I.doi("doi").alias("doi"), "url", "pdf_url", "license", F.array(record).alias("provenance"), I.provider_id("id").alias("provider_id"),
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), F.transform("referenced_works", I.last_segment).alias("referenced_works"), named_place.alias("venue_name"),
    )
    return out.filter((F.col("title") != "") & (F.char_length("abstract") >= LEAST_ABSTRACT) & F.col("year").between(*YEARS) & F.col("url").isNotNull())


def statistics(articles: DataFrame) -> DataFrame:
    """One row of counts over article records, in one pass."""
    s = F.col("source")
    count = lambda c: F.count(F.when(c, 1))
    empty = lambda c: c.isNull() | (F.trim(c) == "")
    evidence = licences.is_verified(s["license"])
    doi = I.doi(s["doi"])
    return articles.agg(
        F.count("*").alias("records"), F.count_distinct("id").alias("unique_ids"), F.count(doi).alias("with_doi"), F.count_distinct(doi).alias("unique_dois"),
        count(empty(F.col("abstract"))).alias("missing_abstracts"), count(empty(s["url"])).alias("missing_urls"), count(empty(s["pdf_url"]) & empty(s["arxiv_id"])).alias("without_pdf_source"),
        count(evidence).alias("licence_identified"), count(evidence & (s["license"]["evidence"] == "openalex")).alias("licence_explicit"), count(evidence & (s["license"]["evidence"] == "acl_policy")).alias("licence_inferred"),
        count(s["license"].isNull()).alias("missing_licences"), count(~evidence).alias("licence_unknown"), count(s["license"]["policy_conflict"].isNotNull()).alias("policy_conflicts"),
    )


def licence_families(articles: DataFrame) -> DataFrame:
    """(family, n) of the articles' licences in the order of their names; articles without a licence are unknown."""
    return articles.groupBy(F.coalesce(F.col("source.license.family"), F.lit("unknown")).alias("family")).agg(F.count("*").alias("n")).orderBy("family")


def provenance_split(articles: DataFrame, records: DataFrame) -> DataFrame:
    """One row: how many article records have a provenance record and how many have none."""
    known = records.select(F.col("article_id").alias("id")).filter("id is not null").distinct().withColumn("_known", F.lit(True))
    return articles.join(known, "id", "left").agg(F.count("_known").alias("with_provenance"), (F.count("*") - F.count("_known")).alias("without_provenance"))


def most_cited(articles: DataFrame, k: int) -> DataFrame:
    """The ``k`` articles of most citations, ties by the smaller id."""
    return articles.orderBy(F.col("cited_by_count").desc_nulls_last(), "id").limit(k)
