"""The orphan tracker behind Structured Streaming.

``tracker.process`` is a ``foreachBatch`` function over a stream of deliveries of
all tables: (table_name, record_id, loaded_at, deleted_at, refs), refs being a map
from field to referred id. Each micro-batch is one increment of the keyed state, which
lies in files: it touches only the buckets of its keys, and a restarted stream goes on
with what was committed. A batch delivered again after a failure changes nothing, as
all merges are idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.columns import canonical_id
from corpuscle.operators import orphans as ops


class OrphanTracker:
    def __init__(self, spark: SparkSession, path: str, references=ops.REFERENCES, buckets: int = ops.BUCKETS):
        self.references = references
        self.state = ops.OrphanStore(spark, path, buckets)

    def process(self, batch: DataFrame, epoch: int = 0) -> None:
        parents = {r.parent for r in self.references}
        arrived = batch.filter(F.col("table_name").isin(*parents)).select(F.col("table_name").alias("parent_table"), canonical_id("record_id").alias("key"), F.col("loaded_at").alias("first_at"), F.struct(F.col("loaded_at").alias("at"), F.col("deleted_at").isNotNull().alias("deleted")).alias("last"))
        known = F.array(*(F.struct(F.lit(r.table).alias("t"), F.lit(r.field).alias("f"), F.lit(r.parent).alias("p")) for r in self.references))
        refs = (
            batch.select("table_name", "record_id", "loaded_at", F.col("refs"), F.explode(known).alias("k"))
            .filter(F.col("k.t") == F.col("table_name"))
            .select("table_name", F.col("k.f").alias("field_name"), "record_id", F.col("k.p").alias("parent_table"), canonical_id(F.element_at("refs", F.col("k.f"))).alias("key"), F.col("loaded_at").alias("first_at"))
            .filter(F.col("record_id").isNotNull() & F.col("key").isNotNull())
        )
        self.state.advance(ops._merge_parents(arrived.filter(F.col("key").isNotNull())), ops._merge_references(refs))
