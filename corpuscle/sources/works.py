"""Landed provider works: pages of JSON under a folder, read with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACE = "struct<id:string,landing_page_url:string,pdf_url:string,version:string,license:string,source:struct<display_name:string,host_organization_name:string>>"
SCHEMA = (
    f"id string, title string, publication_year int, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>, "
    f"primary_location {_PLACE}, best_oa_location {_PLACE}, locations array<{_PLACE}>, ids struct<arxiv:string>, open_access struct<oa_url:string>, doi string, "
    "cited_by_count int, referenced_works array<string>"
)


def landed_works(spark: SparkSession, path: str) -> DataFrame:
    """One row per work of landed pages; a page is {"results": [...]}."""
    pages = spark.read.schema(f"results array<struct<{_inner()}>>").option("multiLine", "true").json(path)
    return pages.select(F.explode("results").alias("w")).select("w.*")


def _inner() -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SCHEMA).simpleString()[len("struct<") : -1]


def lookup_works(works: DataFrame, ids: DataFrame) -> DataFrame:
    """Works of (arxiv_id) rows by their preprint DOI, and null for ids without one."""
    keyed = works.withColumn("_key", F.regexp_replace(F.lower("doi"), r"^https?://(?:dx\.)?doi\.org/", ""))
    asked = ids.select("arxiv_id", F.concat(F.lit("10.48550/arxiv."), F.lower("arxiv_id")).alias("_key")).distinct()
    return asked.join(keyed, "_key", "left").drop("_key")
