"""JSON-Lines tables: lenient and strict scans, append and overwrite sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORRUPT = "_corrupt"


class MalformedRecord(ValueError):
    """A strict scan met a line that is no record."""


def _parsed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema.add(CORRUPT, "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def scan_lenient(spark: SparkSession, path: str, schema: StructType, valid: Column | None = None) -> DataFrame:
    """Rows that parse and are ``valid``; blank and broken lines are skipped, a missing path is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = _parsed(spark, path, StructType(list(schema.fields))).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return df.filter(valid) if valid is not None else df


def scan_strict(spark: SparkSession, path: str, schema: StructType, valid: Column | None = None) -> DataFrame:
    """All rows; the first malformed line, by file and number, raises ``MalformedRecord``."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    parsed = lines.filter(F.trim("value") != "").withColumn("r", F.from_json("value", StructType(list(schema.fields)), {"mode": "PERMISSIVE"})).withColumn("json", F.try_parse_json("value"))
    bad = F.col("json").isNull() | F.col("r").isNull() | ~F.col("value").rlike(r"^\s*\{")
    rows = parsed.select("value", "file", "at", bad.alias("bad"), "r.*")
    wrong = rows.filter("bad" if valid is None else F.col("bad") | ~F.coalesce(valid, F.lit(False))).orderBy("file", "at").limit(1).collect()
    if wrong:
        # The number of a line within its file: ids of a partition rise by one, partitions of a file in order.
        number = lines.filter((F.col("file") == wrong[0]["file"]) & (F.col("at") <= wrong[0]["at"])).count()
        raise MalformedRecord(f"{wrong[0]['file']}:{number}: malformed or invalid record")
    return rows.select(*schema.names)


def last_by_key(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """The last line of every key: what a dictionary filled line by line holds."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", StructType(list(schema.fields)), {"mode": "FAILFAST"}).alias("r"), F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("at"))
    w = Window.partitionBy(F.col("r")[key]).orderBy(F.col("at").desc())
    return lines.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("r.*")


def invalid_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines, invalid): per file the lines that are no JSON."""
    return spark.read.text(path).filter(F.trim("value") != "").groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("lines"), F.count(F.when(F.try_parse_json("value").isNull(), 1)).alias("invalid"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
