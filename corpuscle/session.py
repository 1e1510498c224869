"""Session helpers: a local session for tests and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests on one machine) a temporary folder is made and set; a cluster must name one,
    as executors can't read a folder of the driver's machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if named:
        if not current:
            context.setCheckpointDir(named)
        return named
    if not current:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpuscle-"))
        current = context.getCheckpointDir()
    return current


def store(df: DataFrame, label: str, partition_by: list[str] | None = None, row_group: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The written table survives the loss of any executor, cuts the lineage and
    gives later steps exact statistics. ``row_group``: bytes of a row group, for large rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if row_group:
        writer = writer.option("parquet.block.size", row_group)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``store`` wrote and nothing reads any more; others are left alone."""
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
