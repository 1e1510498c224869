"""Licences with evidence, permissions and provenance."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import corpus, licences
from corpuscle.sources import works

AT = dt.datetime(2025, 1, 1)
ACL = {"id": "l1", "landing_page_url": "https://aclanthology.org/2023.acl-long.1/", "pdf_url": "https://aclanthology.org/2023.acl-long.1.pdf", "version": "publishedVersion", "license": None, "source": {"display_name": "Annual Meeting of the Association for Computational Linguistics", "host_organization_name": None}}
ARXIV = {"id": "l2", "landing_page_url": "https://arxiv.org/abs/2304.01234v2", "pdf_url": "https://arxiv.org/pdf/2304.01234", "version": None, "license": "cc-by-nc", "source": {"display_name": "arXiv", "host_organization_name": None}}


def article(spark, **parts):
    work = {"id": "https://openalex.org/W7", "title": "T", "publication_year": 2023, "abstract_inverted_index": {f"w{i:02}": [i] for i in range(30)}, "authorships": [], "primary_location": None, "best_oa_location": None, "locations": [], "ids": None, "open_access": None, "doi": None, "cited_by_count": None, "referenced_works": []}
    df = spark.createDataFrame([{**work, **parts}], works.SCHEMA)
    return corpus.works_to_articles(df, F.lit(AT))


def test_policy_gives_a_licence_where_none_is_named(spark):
    (a,) = article(spark, primary_location=ACL, locations=[ACL, ARXIV | {"license": None}]).collect()
    assert (a["venue"], a["license"]["spdx_id"], a["license"]["family"], a["license"]["evidence"], a["license"]["inference_source"]) == ("acl", "CC-BY-4.0", "cc-by", "acl_policy", licences.POLICY_SOURCE)
    assert (a["url"], a["arxiv_id"], a["acl_id"], a["venue_name"]) == (ACL["landing_page_url"], "2304.01234", "2023.acl-long.1", ACL["source"]["display_name"])
    (record,) = a["provenance"]
    assert (record["provider_record_id"], record["canonical_record_url"], record["retrieved_at"]) == ("W7", "https://openalex.org/W7", AT)
    assert [x["roles"] for x in record["locations"]] == [["citation_source", "pdf_source", "license_evidence"], []]


def test_a_named_licence_counts_and_the_conflict_is_kept(spark):
    (a,) = article(spark, primary_location=ACL | {"license": "cc-by-nc"}, locations=[ARXIV]).collect()
    assert (a["license"]["family"], a["license"]["evidence"]) == ("cc-by-nc", "openalex") and "CC-BY-4.0" in a["license"]["policy_conflict"]
    (same,) = article(spark, primary_location=ACL | {"license": "cc-by"}).collect()
    assert same["license"]["policy_conflict"] is None and same["license"]["family"] == "cc-by"
    (other_year,) = article(spark, primary_location=ACL | {"license": "cc-by-nc"}, publication_year=2022).collect()
    assert other_year["license"]["policy_conflict"] is None


def test_the_publication_counts_before_the_preprint(spark):
    (a,) = article(spark, primary_location=ARXIV, best_oa_location=ARXIV, locations=[ARXIV, ACL]).collect()
    assert (a["url"], a["license"]["family"], a["license"]["source_url"], a["pdf_url"]) == (ACL["landing_page_url"], "cc-by-nc", ARXIV["landing_page_url"], ARXIV["pdf_url"])
    assert {x["location_id"]: x["roles"] for x in a["provenance"][0]["locations"]} == {"l2": ["pdf_source", "license_evidence"], "l1": ["citation_source"]}
    (p,) = article(spark, primary_location=ARXIV | {"pdf_url": None}).collect()
    assert (p["venue"], p["url"], p["pdf_url"]) == ("arxiv", "https://arxiv.org/abs/2304.01234", "https://arxiv.org/pdf/2304.01234")
    assert article(spark).count() == 0


@pytest.mark.parametrize("family,want", [("cc-by-nd", ("conditional", "conditional", "prohibited")), ("cc-by-nc-sa", ("conditional", "prohibited", "conditional")), ("cc0", ("permitted",) * 3), ("all-rights-reserved", ("prohibited",) * 3), ("restricted", ("unknown",) * 3), (None, ("unknown",) * 3)])
def test_permissions(spark, family, want):
    (r,) = licences.with_permissions(spark.createDataFrame([(family,)], "family string")).collect()
    assert tuple(r[c]["outcome"] for c in ("redistribution", "commercial_use", "adaptations")) == want


def test_role_conflicts(spark):
    good = article(spark, primary_location=ACL, locations=[ACL, ARXIV]).withColumn("source", F.struct("url", "pdf_url", "license"))
    assert licences.role_conflicts(good).count() == 0
    moved = good.withColumn("source", F.struct(F.lit("x").alias("url"), "pdf_url", "license"))
    twice = good.withColumn("provenance", F.concat("provenance", "provenance"))
    assert [tuple(r)[1:] for r in licences.role_conflicts(moved).collect()] == [("citation_source", "differs")]
    assert {tuple(r)[1:] for r in licences.role_conflicts(twice).collect()} == {(r, "several") for r in licences.ROLES}
    (s,) = corpus.provenance_split(good, spark.createDataFrame([(good.collect()[0]["id"],), (None,)], "article_id string")).collect()
    assert tuple(s) == (1, 0)
