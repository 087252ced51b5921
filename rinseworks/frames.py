"""Small building blocks: one-pass per-column statistics and durable intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARROW = {
    "string": pa.string(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
}
_local_folders: dict[str, str] = {}
_written: list[str] = []


def per_column(
    df: DataFrame, columns: Iterable[str], stats: Callable[[str], list[Column]]
) -> DataFrame:
    """One row per column holding its aggregates, all from a single pass.

    ``stats(name)`` lists aliased aggregate expressions. The result has ``position``
    (order of the columns), ``column`` and the aggregates.
    """
    names = list(columns)
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), *stats(c))
        for i, c in enumerate(names or df.columns[:1])
    ]
    out = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return out if names else out.where(F.lit(False))


def small_frame(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    """A frame of a few rows decided on the driver, as a local relation without a job."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if any(f.dataType.simpleString() not in _ARROW for f in kind):
        return spark.createDataFrame(rows, kind)
    fields = [(f.name, _ARROW[f.dataType.simpleString()]) for f in kind]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    table = pa.table(
        [pa.array(list(v), t) for v, (_, t) in zip(columns, fields)], schema=pa.schema(fields)
    )
    return spark.createDataFrame(table)


def localize(df: DataFrame) -> DataFrame:
    """Hold a frame of boundedly few rows as literal rows, so that what is derived from
    it does not scan the table again."""
    return small_frame(df.sparkSession, [tuple(r) for r in df.collect()], df.schema)


def together(spark: SparkSession, *tasks: Callable[[], object]) -> list:
    """Results of independent tasks, run at the same time so their jobs share the cluster."""
    with ThreadPoolExecutor(len(tasks)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
        return [w.result() for w in waiting]


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session without the setting falls back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="rinseworks-")
    return _local_folders[app]


def durable(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Cuts the lineage, is computed once, survives lost executors and keeps column
    pruning and filter pushdown for the readers that follow.
    """
    path = f"{shared_folder(df.sparkSession)}/rinseworks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable_text(df: DataFrame) -> str:
    """Write a frame of one text column as lines to the shared folder; returns where."""
    path = f"{shared_folder(df.sparkSession)}/rinseworks-{uuid.uuid4().hex}"
    df.write.text(path)
    _written.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the intermediates this process wrote, once no frame reads them any more."""
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out when a scan has fewer tasks than there are cores.

    A small file of a single row group is one task; work that is heavy per row then uses
    one core. A table of fewer files than cores is shuffled once, one of more is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
