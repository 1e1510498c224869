"""Incremental ingest: a file stream whose rows are appended once per id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuscle.operators.records import unseen
from corpuscle.sources import jsonl


def json_stream(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def append_once(key: str, target: str, buckets: int = 64):
    """A ``foreachBatch`` function that appends the rows of a batch whose key ``target`` doesn't hold.

    The target is parted by a hash of the key, so a batch reads the keys of the buckets
    it touches only. A batch delivered again after a failure finds its rows there and
    adds nothing. Rows with a null key are left out.
    """

    def process(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.filter(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets)))
        if jsonl.exists(spark, target):
            # At most ``buckets`` numbers.
            touched = [r[0] for r in new.select("bucket").distinct().collect()]
            held = spark.read.schema(new.schema).parquet(target).filter(F.col("bucket").isin(touched))
            new = unseen(new, held, key)
        new.write.mode("append").partitionBy("bucket").parquet(target)

    return process


def deduplicated(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark: state stays bounded by ``late``."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
