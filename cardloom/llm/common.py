"""What the corpus operators share: shared scratch tables, bounded samples, text batches, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch of texts. Texts average a few kB, so that a batch is a few MB.
BATCH_ROWS = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts to a few MB; give executors this package, which they may not have installed."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    context = spark.sparkContext
    if getattr(context, "_cardloom_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="cardloom-code-")) / "cardloom_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._cardloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="cardloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_tables: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.append(path)
    return path


def _written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def write_out(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so that a lost executor costs nothing done before."""
    return _written(df, name, codec)[0]


def cleared(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage: what loops leave there grows to the whole heap, and shuffles that no plan uses stay on disk."""
    spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables written so far; for callers that have written their results."""
    while _tables:
        delete(spark, _tables.pop())


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(key).cast("string")) % folds


def hash_share(key: str, salt: str) -> Column:
    """A uniform number in [0, 1) that depends on the row's key and the salt alone."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(df: DataFrame, key: str, label: str, per_label: int, salt: str) -> DataFrame:
    """About per_label rows of each label, at most twice as many, by hash of the key.

    The share to take comes from a count of all rows of each label, so that labels of any size give as many rows.
    Labels are classes of a model: their number is bounded by the caller.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        if value is not None:
            share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_label / n))).otherwise(share)
    return df.where(hash_share(key, salt) < share).limit(2 * per_label * max(1, len(counts)))


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text of a batch; None for null."""
    return (x for x in column.cast(pa.binary()).to_pylist())


def release() -> None:
    """Give freed memory of this worker back: workers live on, and the next stage's share the executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(batches):
    """The batches, and a release() after the last."""
    try:
        yield from batches
    finally:
        release()


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with fn: RecordBatch -> dict of columns, or None."""

    def run(batches):
        out = None
        for batch in released(batches):
            if batch.num_rows and (cols := fn(batch)) is not None:
                out = out or arrow_schema(schema)
                yield pa.RecordBatch.from_arrays([as_arrow(cols[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        return values.cast(kind)
    if isinstance(values, np.ndarray) and values.dtype != object:
        return pa.array(values).cast(kind)
    return pa.array(values, type=kind)


_KINDS = {
    "bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
    "array<double>": pa.list_(pa.float64()), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32()),
}


def arrow_schema(schema: str) -> pa.Schema:
    """Of a DDL string 'name type, name type' with the types above."""
    return pa.schema([(n, _KINDS[t]) for n, t in (x.strip().split(" ", 1) for x in schema.split(", "))])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... of each i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    Large-star and small-star rounds: every round replaces the links of a node by links to the smallest node it sees,
    so a group with a long diameter needs a logarithmic number of rounds and a hot node's links are merged in partial
    aggregations. Each round is written to the shared folder, the one before it deleted; one number a round goes to the driver.
    """
    spark = links.sparkSession
    edges, path = _written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links"
    )
    cleared(spark)
    last = None
    for _ in range(60):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before = path
        edges, path = _written(small.where("u <> v").distinct(), "links")
        delete(spark, before)
        _tables.remove(before)
        del both, low, large, small
        cleared(spark)
        state = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle in 60 rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
