"""Rendezvous hashing of records over weighted shards.

Every shard draws a number for a record's key and the highest draw, bent by the shard's weight, gets the record. A
record's draws don't depend on how many shards there are, so that a new shard takes records into itself and moves none
between the others. All of it is built-in functions; texts are read once, for their size and checksum, and only
`write_shards` shuffles them.

Defined for odd rows: a null key is a key like others; null texts have size 16 and checksum 0 like empty ones; equal
rows get positions of their own; columns of any name beside the key and the text are left alone; an empty table gives an
empty one. A hot key (null, or a repeated record) stays in one shard, as the law asks, but not in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .numbering import counted, numbered, told_apart

SHARDS = 40
#: Bytes that a record takes beside its text.
RECORD_BYTES = 16
#: A digest of 256 bits has draws of 32 bits for so many shards.
DRAWS = 8


def _name(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit("null"))


def strengths(key: str, weights: Sequence[float]) -> Column:
    """An array with each shard's strength for the row's key: -weight / ln(draw), the draw uniform in (0, 1)."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need weights above zero")
    out = []
    for j, weight in enumerate(weights):
        digest = F.sha2(F.concat(_name(key), F.lit(f":{j // DRAWS}")), 256)
        number = F.conv(F.substring(digest, 8 * (j % DRAWS) + 1, 8), 16, 10).cast("bigint")
        out.append(F.lit(-float(weight)) / F.log((number + F.lit(0.5)) / F.lit(float(1 << 32))))
    return F.array(*out)


def place(docs: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, grown_weight: float = 1.0) -> DataFrame:
    """docs with shard, and grown_shard: the shard if one more of grown_weight came behind the others. Nothing is shuffled."""
    n, every = len(weights), fresh(docs, "strengths")
    out = docs.drop("shard", "grown_shard").withColumn(every, strengths(key, [*weights, grown_weight]))
    now = F.slice(every, 1, n)
    shard = (F.array_position(now, F.array_max(now)) - 1).cast("int")  # the first of equal ones
    grown = F.when(F.element_at(every, n + 1) > F.array_max(now), F.lit(n)).otherwise(shard)
    return out.withColumns({"shard": shard, "grown_shard": grown}).drop(every)


def _order(key: str) -> Column:
    """Records lie in a shard in an order that depends on nothing but themselves, and is mixed."""
    name = F.concat_ws("|", _name(key), F.col("text_crc32").cast("string"), F.col("size").cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def _records(docs: DataFrame, key: str, text: str) -> DataFrame:
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + RECORD_BYTES
    return docs.select(F.col(key).alias("key"), size.alias("size"), F.coalesce(F.crc32(text), F.lit(0).cast("bigint")).alias("text_crc32"))


def shard_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * SHARDS, grown_weight: float = 1.0) -> DataFrame:
    """A row for each document: key, size, text_crc32, shard, slot (its place in the shard, from 0), grown_shard.

    Equal records are counted before they are shuffled; shards are numbered in ranges of their order, so that a shard is
    no unit of work. The rows of each shard are counted on the driver: one number a shard.
    """
    groups = place(counted(_records(docs, key, text)), "key", weights, grown_weight).withColumn("_mixed", _order("key"))
    found = numbered(groups, [F.col(c) for c in ("shard", "_mixed", "key", "text_crc32", "size")])
    first = {r[0]: r[1] for r in found.groupBy("shard").agg(F.min("start")).collect()}
    zero = F.element_at(F.create_map(*(F.lit(x) for pair in sorted(first.items()) for x in pair)), F.col("shard")) if first else F.lit(0)
    return told_apart(found).withColumn("slot", (F.col("position") - zero).cast("bigint")).drop("position", "_mixed")


def write_shards(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * SHARDS) -> DataFrame:
    """The documents, whole rows, as Parquet in a folder a shard (shard=0, shard=1, ...), read again.

    Tasks get ranges of (shard, order), so that heavy shards are written by several; equal rows are told apart by the
    task that read them, so that copies don't meet in one range.
    """
    records = place(docs, key, weights).drop("grown_shard")
    mixed, salt = fresh(records, "mixed"), fresh(records, "salt")
    checksum = F.coalesce(F.crc32(text), F.lit(0))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", _name(key), checksum.cast("string"))), 1, 15), 16, 10).cast("bigint")
    dealt = records.withColumn(mixed, order).withColumn(salt, F.spark_partition_id())
    dealt = dealt.repartitionByRange("shard", mixed, salt).sortWithinPartitions("shard", mixed)
    dealt.drop(mixed, salt).write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.schema(records.schema).parquet(folder)


def report(docs: DataFrame) -> DataFrame:
    """op11: the plan of 40 equal shards under the law `key`."""
    return shard_plan(docs).select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def crc32_sql(bytes_list: str) -> str:
    """DuckDB's expression for the crc32 of a list of bytes; crc32_table has to be joined."""
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bytes_list}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def crc32_table_sql() -> str:
    """The CTE crc32_table: t, the 256 entries of the checksum's table from its rule."""
    step, ctes = "select range as i, range::bigint as c from range(256)", []
    for k in range(8):
        ctes.append(f"crc32_{k} as ({step})")
        step = f"select i, if(c & 1 = 1, xor(3988292384::bigint, c >> 1), c >> 1) as c from crc32_{k}"
    return ", ".join([*ctes, f"crc32_table as (select list(c order by i) as t from ({step}) x)"])


def bytes_sql(text: str) -> str:
    """DuckDB's expression for the list of a text's bytes."""
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: cast('0x' || h as bigint))"


def sql() -> str:
    strength = f"-1.0 / ln((cast('0x' || substr(sha256(name || ':' || (j // {DRAWS})), {DRAWS} * (j % {DRAWS}) + 1, 8) as bigint) + 0.5) / 4294967296.0)"
    return f"""with {crc32_table_sql()},
records as (select doc_id, coalesce(cast(doc_id as varchar), 'null') as name, coalesce(octet_length(encode(text)), 0) + {RECORD_BYTES} as size, coalesce({crc32_sql(bytes_sql("text"))}, 0)::bigint as text_crc32 from documents, crc32_table),
drawn as (select name, j, {strength} as s from (select distinct name from records) n, (select unnest(range({SHARDS + 1})) as j) k),
placed as (select name, arg_max(j, (s, -j)) filter (j < {SHARDS}) as shard, arg_max(j, (s, -j)) as grown_shard from drawn group by name)
select doc_id, size::bigint as size, text_crc32, 'key' as law, shard::int as shard, grown_shard::int as grown_shard,
 row_number() over (partition by shard order by cast('0x' || substr(md5(name || '|' || text_crc32 || '|' || size), 1, 15) as bigint), doc_id nulls first, text_crc32, size) - 1 as slot
from records join placed using (name)"""
