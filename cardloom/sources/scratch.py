"""Tables that a query writes on its way, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ROW = (1 << 33) - 1


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cardloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written and read again, so that what reads it several times doesn't work it out again, nor does a lost executor."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete kept tables that nothing reads any more, and let Spark clear the shuffles of what isn't referred to."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._kept_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        cleared(tables[0].sparkSession)


def cleared(spark: SparkSession) -> None:
    """Let Spark clear shuffles: they go when the driver finds their plans unused."""
    spark._jvm.System.gc()


def running(df: DataFrame, order, **values) -> DataFrame:
    """df with the sum of each of the values (name=Column) over all rows up to and including it, in a total order.

    Rows are sorted in ranges and summed inside them, so that no task has all; a row for each range goes to the driver.
    """
    rows = kept(df.orderBy(order).withColumn("_at", F.monotonically_increasing_id()), "running").withColumn("_part", F.shiftright("_at", 33))
    of_parts = rows.groupBy("_part").agg(*(F.sum(v).alias(f"_{name}") for name, v in values.items()))
    before, starts = [None] * len(values), []
    for part, *sums in sorted(map(tuple, of_parts.collect())):
        starts.append((part, *before))
        before = [b if s is None else s if b is None else b + s for b, s in zip(before, sums, strict=True)]
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, of_parts.schema))
    up, zero = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0), F.lit(0)
    sums = {name: F.coalesce(F.col(f"_{name}"), zero) + F.coalesce(F.sum(v).over(up), zero) for name, v in values.items()}
    return rows.join(starts, "_part").withColumns(sums).drop("_part", "_at", *(f"_{name}" for name in values))


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """df with its position from 1 in a total order: sorted in ranges and numbered inside them, so that no task has all rows.

    One number for each range goes to the driver.
    """
    rows = kept(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    starts, before = [], 0
    for k, n in sorted(map(tuple, rows.groupBy(part.alias("p")).count().collect())):
        starts.append((k, before))
        before += n
    starts = df.sparkSession.createDataFrame(starts, "_part bigint, _before bigint")
    out = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(_ROW)) + 1).drop("_part", "_before", "_at")
