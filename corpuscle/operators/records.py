"""Versions of records: latest deliveries, duplicates, increments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


def latest(df: DataFrame, key: str = "id", at: str = "loaded_at") -> DataFrame:
    """The last delivery of every key; rows with a null key are left out.

    Of several deliveries of one time the one whose content hashes lowest counts.
    The window is cut to one row per key already before the shuffle.
    """
    content = [f.name for f in df.schema.fields if f.name != key and not isinstance(f.dataType, MapType)]
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.xxhash64(*content))
    return df.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def current(df: DataFrame, key: str = "id") -> DataFrame:
    """The last delivery of every key that isn't deleted by it."""
    return latest(df, key).filter("deleted_at is null")


def unseen(new: DataFrame, seen: DataFrame, key: str, seen_key: str | None = None) -> DataFrame:
    """Rows of ``new`` whose key is not among those of ``seen``: the resume of an append-only step."""
    return new.join(seen.select(F.col(seen_key or key).alias(key)), key, "left_anti")


def first_by(df: DataFrame, group, *order) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("_n = 1").drop("_n")


def seen_manifest(df: DataFrame, key: str = "id") -> DataFrame:
    """The sorted different ids, one row each; the sort is a range partition, nothing is collected."""
    return df.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(key)


def write_manifest(ids: DataFrame, path: str, key: str = "id") -> None:
    """Saves the sorted ids seen so far, a text line each."""
    seen_manifest(ids, key).select(F.col(key).cast("string")).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """(key) of a saved manifest; one that isn't there or can't be read holds no ids."""
    try:
        found = spark.read.text(path)
        found.limit(1).collect()
    except Exception:  # an unreadable manifest is as none
        found = spark.createDataFrame([], "value string")
    return found.select(F.col("value").alias(key)).distinct()


def grouped(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, values): the values of each key in an order. Salted first, so that no task gathers a hot key before its parts are joined."""
    parts = df.filter(F.col(key).isNotNull()).withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(32))).groupBy(key, "_salt").agg(F.collect_list(F.struct(order, value)).alias("_v"))
    return parts.groupBy(key).agg(F.transform(F.sort_array(F.flatten(F.collect_list("_v"))), lambda x: x[value]).alias("values"))
