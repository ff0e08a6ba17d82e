"""Gapless positions in a total order, for tables of any size and any number of equal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, write_out

#: Equal rows that one row of a counted table stands for at most, when it is told apart into rows again.
BLOCK = 1 << 16


def counted(rows: DataFrame, n: str = "n") -> DataFrame:
    """One row for all equal rows, with their number: they are summed before they are shuffled, so that none is hot."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias(n))


def numbered(groups: DataFrame, order: list[Column], n: str = "n", start: str = "start") -> DataFrame:
    """groups with the number of rows before each in the order, where a group stands for n rows; written and read again.

    `order` has to tell any two groups apart. Groups are sorted in ranges and summed inside them; one sum a range, of
    which there are as many as shuffle partitions, goes to the driver.
    """
    part = fresh(groups, "part")
    rows = write_out(groups.orderBy(*order).withColumn(part, F.spark_partition_id()), "ranges")
    starts, before = [], 0
    for k, total in sorted(map(tuple, rows.groupBy(part).agg(F.sum(n)).collect())):
        starts.append((k, before))
        before += total
    ranges = rows.sparkSession.createDataFrame(starts, f"{part} int, {part}_before bigint")
    inside = F.sum(n).over(W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    out = rows.withColumn(start, F.coalesce(inside, F.lit(0))).join(F.broadcast(ranges), part)
    return write_out(out.withColumn(start, F.col(start) + F.col(f"{part}_before")).drop(part, f"{part}_before"), "numbered")


def told_apart(groups: DataFrame, n: str = "n", start: str = "start", name: str = "position") -> DataFrame:
    """A row for each of the n rows that a group stands for, numbered from the group's start; groups is a written table.

    Large groups are dealt out in blocks before they are told apart, so that no task makes all of one group's rows.
    """
    block = fresh(groups, "block")
    first = F.col(start) + F.col(block) * F.lit(BLOCK)
    last = F.least(first + BLOCK, F.col(start) + F.col(n)) - 1
    few = groups.where(F.col(n) <= BLOCK).withColumn(block, F.lit(0).cast("bigint"))
    many = groups.where(F.col(n) > BLOCK).withColumn(block, F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(`{n}` - 1) div {BLOCK}"))))
    many = many.repartition(block, start)
    return few.unionByName(many).withColumn(name, F.explode(F.sequence(first, last))).drop(block, n, start)
