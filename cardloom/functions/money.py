"""Fees as Columns over a purchase and its prices."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

def amount() -> Column:
    return F.col("amount_cop").cast("double")


def region() -> Column:
    return F.when(F.col("cross_border"), "cross_border").otherwise("domestic")


def interchange(value: Column) -> Column:
    """The small tier's price up to and including its limit, else the cell's."""
    small = F.col("small_ticket_max_cop").isNotNull() & (value <= F.col("small_ticket_max_cop"))
    tier = value * F.col("small_ticket_rate") + F.col("small_ticket_fixed_cop")
    return F.when(small, tier).otherwise(value * F.col("rate") + F.col("fixed_cop"))


def side_fee(side: str, part: str) -> Column:
    if part == "assessment":
        return amount() * F.col(f"{side}_assessment_rate")
    if part == "authorization":
        return F.col(f"{side}_authorization_fee_cop")
    return F.when(F.col("cross_border"), amount() * F.col(f"{side}_cross_border_rate")).otherwise(F.lit(0.0))


def mdr(pricing_model: str = "pricing_model") -> Column:
    passed_on = F.col("interchange_cop") + F.col("acquirer_network_fee_cop")
    plus = passed_on + (amount() * F.col("icpp_markup_rate") + F.col("icpp_markup_fixed_cop"))
    surcharge = F.when(F.col("cross_border"), F.col("blended_cross_border_rate")).otherwise(F.lit(0.0))
    flat = amount() * (F.col("blended_mdr_rate") + surcharge)
    return F.when(F.col(pricing_model) == "icpp", plus).when(F.col(pricing_model) == "blended", flat)


def logistic(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def row_sum(columns) -> Column:
    return reduce(add, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """The vector by its length, which is worked out once a row; a zero vector stays zero."""
    a = F.col(a) if isinstance(a, str) else a
    return F.zip_with(a, F.array_repeat(F.greatest(norm(a), F.lit(1e-12)), F.size(a)), lambda x, n: x / n)


def hashed_uniform(*parts) -> Column:
    """A uniform number from the first 32 bits of the parts' MD5: the same in any engine and partitioning."""
    key = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
