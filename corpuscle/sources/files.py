"""Files as tables: sizes and checksums of a tree, cached documents."""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sizes of a usable cached document, in bytes.
SMALLEST, LARGEST = 1000, 20_000_000


def tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size, sha256) of all files below ``root``; each task hashes its own files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def cached_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, usable): cached files, usable by size. Only names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), ((F.col("length") > SMALLEST) & (F.col("length") <= LARGEST)).alias("usable"))


class UnsafeTree(ValueError):
    """A tree with links or special files."""


def refuse_links(root: str) -> None:
    """Raises for a local tree that holds a link or a file that is neither plain nor a folder."""
    for folder, names, files in os.walk(root):
        for name in (*names, *files):
            kind = os.lstat(os.path.join(folder, name)).st_mode
            if not (stat.S_ISREG(kind) or stat.S_ISDIR(kind)):
                raise UnsafeTree(f"no plain file: {os.path.join(folder, name)}")
