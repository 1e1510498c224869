"""The citation graph: references, edges, nodes, density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.columns import canonical_id
from corpuscle.functions.identifiers import last_segment, uuid5


def references(articles: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(source_article_id, position, target_raw_ref, target_article_id): one row per reference; targets outside the corpus are null.

    ``known`` (provider_id, id) overrides the articles' own provider ids.
    """
    own = articles.select(F.col("openalex_id").alias("provider_id"), F.col("id").alias("target"), F.lit(1).alias("order"))
    if known is not None:
        own = own.unionByName(known.select("provider_id", F.col("id").alias("target"), F.lit(0).alias("order")))
    ids = own.filter("provider_id is not null").groupBy("provider_id").agg(F.min(F.struct("order", "target")).alias("m")).select("provider_id", F.col("m.target").alias("target_article_id"))
    rows = articles.select(F.col("id").alias("source_article_id"), F.posexplode("referenced_works").alias("position", "target_raw_ref")).withColumn("provider_id", last_segment("target_raw_ref"))
    return rows.join(ids, "provider_id", "left").select("source_article_id", "position", "target_raw_ref", "target_article_id")


# The context and the function of a citation known from a reference list only.
CONTEXT, FUNCTION = "Metadata-only reference.", "undefined"


def citation_records(references: DataFrame) -> DataFrame:
    """The references as citation records, with an id that follows from the citing article and the place in its list."""
    name = F.concat(F.lit("citation:"), F.col("position"))
    return references.select(
        uuid5(F.col("source_article_id"), name).alias("id"), "source_article_id", "target_article_id", "target_raw_ref", F.lit(CONTEXT).alias("context_sentence"), F.lit(FUNCTION).alias("function"),
        F.lit(None).cast("double").alias("function_confidence"), F.lit(None).cast("string").alias("chunk_id"),
    )


def edges(citations: DataFrame) -> DataFrame:
    """(source_id, target_id, count) of citations with a target; self-loops stay."""
    target = canonical_id("target_article_id")
    return citations.select(F.col("source_article_id").alias("source_id"), target.alias("target_id")).filter("source_id is not null and target_id is not null").groupBy("source_id", "target_id").agg(F.count("*").alias("count"))


def graph_summary(edge: DataFrame) -> DataFrame:
    """One row: nodes, different edges, density = edges / (n (n - 1)), 0 below two nodes.

    Nodes are counted by a shuffle of both ends after a partial aggregate, so a
    target that a third of the edges share is one row per task.
    """
    nodes = edge.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().agg(F.count("*").alias("nodes"))
    counted = edge.select("source_id", "target_id").distinct().agg(F.count("*").alias("edges"))
    n = F.col("nodes")
    return nodes.crossJoin(F.broadcast(counted)).select("nodes", "edges", F.when(n < 2, 0.0).otherwise(F.round(F.col("edges") / (n * (n - 1)), 12)).alias("density"))


def reference_shares(citations: DataFrame) -> DataFrame:
    """One row: citations, those with a target in the corpus, their share, and citations per citing article."""
    inside = canonical_id("target_article_id").isNotNull()
    total, sources = F.count("*"), F.count_distinct("source_article_id")
    return citations.agg(
        total.alias("citations"),
        F.count(F.when(inside, 1)).alias("internal"),
        F.when(total == 0, 0.0).otherwise(F.round(F.count(F.when(inside, 1)) / total, 6)).alias("internal_share"),
        F.when(sources == 0, 0.0).otherwise(F.round(total / sources, 6)).alias("per_article"),
    )
