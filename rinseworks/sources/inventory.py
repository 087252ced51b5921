"""What files lie in a folder: kinds, sizes, and whether they can be taken in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinseworks.functions import constants as K


def file_inventory(
    spark: SparkSession, path: str, recursive: bool = True, max_bytes: int | None = None
) -> DataFrame:
    """``(path, name, extension, kind, size, modified, accepted)``; contents are not read.

    Files over ``max_bytes`` are not accepted; there is no limit unless it is given.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", recursive)
        .load(path)
        .select("path", "length", "modificationTime")
    )
    kinds = F.create_map(*[F.lit(v) for pair in K.FILE_KINDS.items() for v in pair])
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.try_element_at(kinds, extension)
    return files.select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        extension.alias("extension"),
        kind.alias("kind"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        (kind.isNotNull() & (F.lit(max_bytes is None) | (F.col("length") <= F.lit(max_bytes)))).alias("accepted"),
    )


def inventory_by_kind(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("kind").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file's content with the number of copies of it."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", F.sha2("content", 256).alias("fingerprint"))
        .groupBy("fingerprint")
        .agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("copies"))
    )
