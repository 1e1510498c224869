"""Retrieval quality: recall and reciprocal rank at k, means with sample deviation, ablations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuscle.sources import jsonl


def per_query(retrieved: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, rr) of (query_id, doc, rank) against (query_id, doc); queries without relevant docs don't count."""
    wanted = relevant.select("query_id", "doc").distinct()
    hits = retrieved.filter(F.col("rank") <= k).join(wanted, ["query_id", "doc"], "left_semi").groupBy("query_id").agg(F.count_distinct("doc").alias("hits"), F.min("rank").alias("best"))
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("size"))
    return sizes.join(hits, "query_id", "left").select("query_id", F.round(F.coalesce("hits", F.lit(0)) / F.col("size"), 9).alias("recall"), F.coalesce(F.round(1.0 / F.col("best"), 9), F.lit(0.0)).alias("rr"))


def mean_std(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, std): the sample deviation, 0 for one value."""
    return df.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.try_subtract(F.stddev_samp(value), F.lit(0.0)), F.lit(0.0)), 6).alias("std"))


def ablation(scores: DataFrame, by: str, full: str, value: str = "mean") -> DataFrame:
    """(by, delta): each row's value less that of the row named ``full``."""
    base = scores.filter(F.col(by) == full).select(F.col(value).alias("_full"))
    return scores.filter(F.col(by) != full).crossJoin(F.broadcast(base.limit(1))).select(by, F.round(F.col(value) - F.col("_full"), 6).alias("delta"))


def check_judgments(judgments: DataFrame) -> DataFrame:
    """(query_id, problem) of judgments (query_id, relevant_chunk_ids) that may not be used: repeated query, repeated id, no id."""
    repeated = judgments.groupBy("query_id").agg(F.count("*").alias("n")).filter("n > 1").select("query_id", F.lit("repeated_query").alias("problem"))
    twice = judgments.filter(F.size("relevant_chunk_ids") != F.size(F.array_distinct("relevant_chunk_ids"))).select("query_id", F.lit("repeated_id").alias("problem"))
    none = judgments.filter(F.coalesce(F.size("relevant_chunk_ids"), F.lit(0)) <= 0).select("query_id", F.lit("empty").alias("problem"))
    return repeated.unionByName(twice).unionByName(none)


class UnusableJudgments(ValueError):
    """Judgments that may not be used for an evaluation."""


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, relevant_chunk_ids) of a JSON Lines file, read strictly: it exists, every line is sound, no problem is found."""
    schema = StructType.fromDDL("query_id string, query string, relevant_chunk_ids array<string>")
    if not jsonl.exists(spark, path):
        raise FileNotFoundError(path)
    judgments = jsonl.scan_strict(spark, path, schema)
    problems = check_judgments(judgments).limit(5).collect()
    if problems or not judgments.limit(1).collect():
        raise UnusableJudgments("; ".join(f"{p['query_id']}: {p['problem']}" for p in problems) or "no judgments")
    return judgments
