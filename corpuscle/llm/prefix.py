"""The rank walk of queries too large for one task, by distributed prefix sums.

Equal values of a score are merged first (a partial aggregate), so a value that a
third of the rows share is one row. The different values of a (query, score) are
cut at approximate quantiles into blocks; sums run inside blocks by a window, and
the few block totals are summed by a second window. No task sees a whole query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import discard, store

def _blocks(values: DataFrame, blocks: int) -> DataFrame:
    """Adds ``block`` to (query_id, score, value, ...) rows, rising with value."""
    cuts = values.groupBy("query_id", "score").agg(F.percentile_approx("value", [i / blocks for i in range(1, blocks)], 1000).alias("cuts"))
    return values.join(cuts, ["query_id", "score"]).withColumn("block", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")


def _above(values: DataFrame, amount: Column) -> DataFrame:
    """Adds ``total``: the sum of ``amount`` over rows of strictly higher value."""
    inside = Window.partitionBy("query_id", "score", "block").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("query_id", "score").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = values.groupBy("query_id", "score", "block").agg(F.sum(amount).alias("sum")).select("query_id", "score", "block", F.coalesce(F.sum("sum").over(across), F.lit(0)).alias("before"))
    return values.withColumn("inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(totals, ["query_id", "score", "block"]).withColumn("total", F.col("inside") + F.col("before")).drop("inside", "before")


def ranked(items: DataFrame, parts: int = 64) -> DataFrame:
    """Adds ``rank`` to (query_id, chunk_id, mass): by falling mass, ties going to the smaller id.

    Rows are parted by ranges of the whole order, ids included, so neither a large query nor a tie that all its items
    share lies in one part; the ranks of a part begin behind the counts of the parts before it.
    """
    order = (F.col("query_id"), (-F.col("mass")).alias("minus"), F.col("chunk_id"))
    placed = store(items.select("query_id", "chunk_id", "mass").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "walk-parts")
    inside = Window.partitionBy("query_id", "part").orderBy(F.col("mass").desc(), "chunk_id")
    before = Window.partitionBy("query_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("query_id", "part").agg(F.count("*").alias("n")).select("query_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return placed.withColumn("n", F.row_number().over(inside)).join(counts, ["query_id", "part"]).select("query_id", "chunk_id", "mass", (F.col("n") + F.col("before")).cast("long").alias("rank"))


def walk_large(own: DataFrame, damping: float, steps: int, blocks: int = 64) -> DataFrame:
    """(query_id, chunk_id, mass) as by ``ranking.walk``, for (query_id, chunk_id, s0, s1, s2) rows of large queries.

    The mass is written after each step, as a step reads it twice; the one before is deleted.
    """
    # A missing score stands below every value.
    scores = F.array(*(F.coalesce(F.greatest(F.lit(-1.7e308), F.col(f"s{j}")), F.lit(float("-inf"))) for j in range(3)))
    each = store(own.select("query_id", "chunk_id", F.posexplode(scores).alias("score", "value")), "walk-values")
    counted = _blocks(each.groupBy("query_id", "score", "value").agg(F.count("*").alias("n")), blocks)
    steps_of = store(_above(counted, F.col("n")).select("query_id", "score", "value", "block", F.col("total").alias("above")), "walk-ranks")
    size = own.groupBy("query_id").agg(F.count("*").alias("size"))
    mass = store(own.select("query_id", "chunk_id").join(size, "query_id").withColumn("mass", 1.0 / F.col("size")), "walk-mass")
    below = lambda v: _above(v.withColumn("value", -F.col("value")).withColumn("block", -F.col("block")), F.col("handed")).withColumn("value", -F.col("value"))
    for _ in range(steps):
        held = each.join(mass, ["query_id", "chunk_id"]).groupBy("query_id", "score", "value").agg(F.sum("mass").alias("held")).join(steps_of, ["query_id", "score", "value"])
        handed = held.withColumn("handed", F.when(F.col("above") > 0, F.col("held") / F.col("above")).otherwise(0.0))
        gains = below(handed).select("query_id", "score", "value", "above", F.col("total").alias("gain"))
        got = each.join(gains, ["query_id", "score", "value"]).join(mass, ["query_id", "chunk_id"]).select("query_id", "chunk_id", "size", (F.col("gain") + F.when(F.col("above") == 0, F.col("mass")).otherwise(0.0)).alias("g"))
        last, mass = mass, store(got.groupBy("query_id", "chunk_id", "size").agg((F.lit((1 - damping)) / F.first("size") + F.lit(damping / 3) * F.sum("g")).alias("mass")), "walk-mass")
        discard(last)
    return mass.select("query_id", "chunk_id", "mass")
