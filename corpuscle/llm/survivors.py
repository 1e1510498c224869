"""Best representative of each duplicate group, field by field.

Records that describe one work are ranked by window ordering, a ranking per
field, and the top record per group and field is kept. Spark filters a
``row_number() <= 1`` window already before the shuffle (WindowGroupLimit), so of
a group that holds a third of all rows each task passes on one row per field.

Defined cases: repeated deliveries of a record count once, by their first
``loaded_at`` (a null ``loaded_at`` comes last; of several at that time the one whose
content hashes lowest); rows with a null record_id belong to no group, nor do records
whose first delivery has no usable DOI; blank values are unfilled; a field no
record of the group has filled has no survivor; a retrieved_at that is null or
later than the first delivery ranks as earliest; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.columns import col_of, is_blank

FIELDS = ("provider_record_id", "canonical_record_url", "locations")


def plain_doi(c: Column | str) -> Column:
    """Lower-case ``10.<registrant>/<suffix>`` of any usual spelling; null for anything else."""
    c = col_of(c)
    # A plus sign is itself, not a blank, in a DOI; a broken escape leaves the text as it is.
    decoded = F.when(c.contains("%"), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)
    bare = F.regexp_replace(F.lower(decoded), r"(?U)^\s+|\s+\z", "")
    found = F.regexp_extract(bare, r"(?U)^(?:(?:info|urn):)?(?:doi[:/]?\s*)?(?:https?://)?(?:[a-z0-9.-]*doi\.org/)?(?:doi:\s*)?(10\.[^\s/]+/\S+)\z", 1)
    return F.nullif(found, F.lit(""))


def _filled_pairs(locations: Column) -> Column:
    """The different non-empty (landing_page_url, pdf_url) pairs of a record, blank being null."""
    clean = lambda v: F.when(~is_blank(v), v)
    pairs = F.transform(locations, lambda x: F.struct(clean(x["landing_page_url"]).alias("landing_page_url"), clean(x["pdf_url"]).alias("pdf_url")))
    return F.array_distinct(F.filter(pairs, lambda p: p["landing_page_url"].isNotNull() | p["pdf_url"].isNotNull()))


def first_deliveries(records: DataFrame) -> DataFrame:
    """One row per record_id: its first delivery; of equal times the one whose content hashes lowest."""
    w = Window.partitionBy("record_id").orderBy(F.col("loaded_at").asc_nulls_last(), F.xxhash64(*(c for c in records.columns if c != "record_id")))
    return records.filter(F.col("record_id").isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def survivors(records: DataFrame) -> DataFrame:
    """(work_doi, field_name, record_id, value) of every work with two records or more.

    ``value`` is the surviving value as text (locations as JSON). Columns of
    ``records`` besides the ones named here take no part, whatever their names.
    """
    own = records.select("record_id", "doi", "retrieved_at", "provider_record_id", "canonical_record_url", "locations", "loaded_at")
    # The first delivery is taken before its DOI is judged: a later delivery must not take the place of one without a DOI.
    base = first_deliveries(own).withColumn("doi", plain_doi("doi")).filter(F.col("doi").isNotNull())
    recency = F.when(F.col("retrieved_at") <= F.col("loaded_at"), F.col("retrieved_at"))
    pairs = F.coalesce(F.size(_filled_pairs(F.col("locations"))), F.lit(0))
    scalar = lambda f: F.struct(F.lit(f).alias("field_name"), F.when(is_blank(f), 0).otherwise(1).alias("completeness"), F.col(f).alias("value"))
    candidates = (
        base.select("doi", "record_id", recency.alias("recency"), F.array(*(scalar(f) for f in FIELDS[:2]), F.struct(F.lit("locations").alias("field_name"), F.greatest(pairs, F.lit(0)).alias("completeness"), F.to_json("locations").alias("value"))).alias("fields"))
        .select("doi", "record_id", "recency", F.explode("fields").alias("f"))
        .select("doi", "f.field_name", "record_id", "recency", "f.completeness", "f.value")
        .filter("completeness > 0")
    )
    order = Window.partitionBy("doi", "field_name").orderBy(F.col("completeness").desc(), F.col("recency").desc_nulls_last(), F.col("record_id"))
    top = candidates.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    works = base.groupBy("doi").agg(F.count("*").alias("_records")).filter("_records > 1").select("doi")
    return top.join(works, "doi", "left_semi").select(F.col("doi").alias("work_doi"), "field_name", "record_id", "value")


def golden_records(records: DataFrame) -> DataFrame:
    """One built record per work: the surviving value of each field and the record it comes from."""
    pick = lambda f, c: F.max(F.when(F.col("field_name") == f, F.col(c)))
    return survivors(records).groupBy("work_doi").agg(*(pick(f, "value").alias(f) for f in FIELDS), *(pick(f, "record_id").alias(f"{f}_from") for f in FIELDS))
