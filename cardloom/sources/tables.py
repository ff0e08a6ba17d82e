"""Reading and writing tables: schemas checked, manifests, optional sources."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_NAME = re.compile(r"[a-z_][a-z0-9_]*")


def read_raw(spark: SparkSession, folder: str, name: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A table of the catalog; anything but a plain name raises ValueError."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"Not a table name: {name!r}")
    return spark.table(name)


def read_optional(spark: SparkSession, folder: str, name: str, columns: tuple[str, ...] = ()) -> DataFrame | None:
    """The table, or None where it or one of the columns is missing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    table = read_raw(spark, folder, name)
    return table if set(columns) <= set(table.columns) else None


def require(df: DataFrame, columns, what: str = "table") -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} is missing required columns: {missing}")


def write_tables(tables: dict[str, DataFrame], folder: str, seed: int, config: dict) -> dict:
    """Each table as Parquet, and manifest.json with seed, a hash of the configuration and row counts."""
    rows = {}
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        rows[name] = read_raw(spark, folder, name).count()
    digest = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
    manifest = {"seed": seed, "config_sha256": digest, "rows": rows}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest.json")
    return manifest


def wide(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """An array column as columns dim_000, dim_001, ..."""
    return vectors.select(key, *(F.col(vector)[k].alias(f"dim_{k:03d}") for k in range(dims)))


def narrow(table: DataFrame, key: str, vector: str) -> DataFrame:
    names = sorted(c for c in table.columns if c.startswith("dim_"))
    return table.select(key, F.array(*names).alias(vector))
