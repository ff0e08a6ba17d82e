"""Profit and loss by any segment, and what is read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money
from .waterfall import COSTS, DRIVERS, MONEY

RECEIVERS = (
    ("issuer", "issuer_id", "issuer_gross_cop", "issuer_contribution_cop"),
    ("acquirer", "acquirer_id", "acquirer_gross_cop", "acquirer_contribution_cop"),
    ("network", None, "network_revenue_cop", "network_revenue_cop"),
)
RATES = {
    "effective_interchange_rate": "interchange_cop", "effective_mdr_rate": "mdr_cop", "net_revenue_yield": "network_revenue_cop",
    "acquirer_margin_rate": "acquirer_gross_cop", "issuer_contribution_rate": "issuer_contribution_cop",
}


def pnl_by(priced: DataFrame, keys: list[str | Column] = ()) -> DataFrame:
    """Count, volume, all money columns and five rates of volume by keys (names or Columns); no keys: the total."""
    sums = [F.count("*").alias("n_txns"), F.sum("amount_cop").cast("double").alias("gdv_cop"), *(F.sum(c).alias(c) for c in MONEY)]
    out = priced.groupBy(*keys).agg(*sums) if keys else priced.agg(*sums)
    return out.withColumns({rate: F.try_divide(F.col(c), F.col("gdv_cop")) for rate, c in RATES.items()})


def pnl_sets(priced: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    """Several segmentations in one pass (grouping sets); a key that a set lacks is null, grouping_set numbers them."""
    sums = [F.count("*").alias("n_txns"), F.sum("amount_cop").cast("double").alias("gdv_cop"), *(F.sum(c).alias(c) for c in MONEY)]
    out = priced.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, keys)).agg(F.grouping_id().alias("grouping_set"), *sums)
    return out.withColumns({rate: F.try_divide(F.col(c), F.col("gdv_cop")) for rate, c in RATES.items()})


def by_actor(priced: DataFrame) -> DataFrame:
    """Gross revenue and contribution of every actor, from one pass over the purchases."""
    actor = F.explode(F.array(*(
        F.struct(
            F.lit(kind).alias("actor_type"), (F.col(key) if key else F.lit("NETWORK")).alias("actor_id"),
            F.col(gross).alias("revenue_cop"), F.col(rest).alias("contribution_cop"),
        ) for kind, key, gross, rest in RECEIVERS
    ))).alias("actor")
    return priced.select("amount_cop", actor).groupBy("actor.actor_type", "actor.actor_id").agg(
        F.sum("actor.revenue_cop").alias("revenue_cop"), F.sum("actor.contribution_cop").alias("contribution_cop"),
        F.sum("amount_cop").cast("double").alias("gdv_cop"), F.count("*").alias("n_txns"),
    )


def net_revenue_yield(priced: DataFrame, keys=()) -> DataFrame:
    names = [k for k in keys if isinstance(k, str)]
    return pnl_by(priced, list(keys)).select(*names, "n_txns", "gdv_cop", "network_revenue_cop", *DRIVERS, (F.col("net_revenue_yield") * 10_000).alias("net_revenue_yield_bps"))


def effective_interchange(priced: DataFrame, keys=()) -> DataFrame:
    return pnl_by(priced, list(keys)).select(*keys, "n_txns", "gdv_cop", "interchange_cop", "effective_interchange_rate")


def issuer_contribution(priced: DataFrame, keys=("product",)) -> DataFrame:
    lines = ("interchange_cop", "issuer_network_fee_cop", "issuer_gross_cop", *COSTS[:5], "issuer_contribution_cop")
    return pnl_by(priced, list(keys)).select(*keys, "n_txns", "gdv_cop", *lines, "issuer_contribution_rate")


def relative_burden(priced: DataFrame, merchants: DataFrame) -> DataFrame:
    """Per merchant with purchases: effective MDR over the margin of its sector."""
    volume = priced.groupBy("merchant_id").agg(F.count("*").alias("n_txns"), F.sum("amount_cop").cast("double").alias("gdv_cop"), F.sum("mdr_cop").alias("mdr_cop"))
    rate = F.col("mdr_cop") / F.col("gdv_cop")
    facts = merchants.select("merchant_id", "mcc_group", "size_tier", "pricing_model", "sector_margin")
    return volume.join(facts, "merchant_id").withColumns({"effective_mdr_rate": rate, "relative_burden": rate / F.col("sector_margin")})


def statement(priced: DataFrame) -> DataFrame:
    """Signed lines of each actor, per 100 of MDR and in basis points of volume."""
    lines = [
        ("merchant", "mdr_cop", -1), ("issuer", "interchange_cop", 1), ("issuer", "issuer_network_fee_cop", -1), ("issuer", "issuer_gross_cop", 1),
        *(("issuer", c, -1) for c in COSTS[:5]), ("issuer", "issuer_contribution_cop", 1), ("network", "network_assessment_cop", 1),
        ("network", "network_authorization_cop", 1), ("network", "network_cross_border_cop", 1), ("network", "network_revenue_cop", 1),
        ("acquirer", "acquirer_network_fee_cop", -1), ("acquirer", "acquirer_gross_cop", 1), ("acquirer", "acquirer_processing_cop", -1),
        ("acquirer", "acquirer_contribution_cop", 1),
    ]
    items = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(a).alias("actor"), F.lit(c).alias("line"), (sign * F.col(c)).alias("value")) for i, (a, c, sign) in enumerate(lines)))
    total = pnl_by(priced)
    out = total.select("mdr_cop", "gdv_cop", F.explode(items).alias("x"))
    return out.select("x.pos", "x.actor", "x.line", (F.col("x.value") / F.col("mdr_cop") * 100).alias("per_100_mdr"), (F.col("x.value") / F.col("gdv_cop") * 10_000).alias("bps"))


def revenue_by_driver(priced: DataFrame) -> DataFrame:
    """Network drivers in basis points of volume, by product and in total, from one pass."""
    out = priced.rollup("product").agg(F.sum("amount_cop").cast("double").alias("gdv_cop"), *(F.sum(c).alias(c) for c in (*DRIVERS, "network_revenue_cop")))
    bps = [(F.col(c) / F.col("gdv_cop") * 10_000).alias(c.replace("_cop", "_bps")) for c in (*DRIVERS, "network_revenue_cop")]
    return out.select(F.coalesce("product", F.lit("total")).alias("product"), *bps)


TICKETS = ((10_000, "<=10k"), (20_000, "<=20k"), (50_000, "<=50k"), (70_000, "<=70k"))


def ticket_economics(priced: DataFrame) -> DataFrame:
    """Gross rates by ticket size; bins are closed on the right."""
    label = None
    for limit, name in TICKETS:
        here = F.col("amount_cop") <= limit
        label = F.when(here, name) if label is None else label.when(here, name)
    binned = priced.withColumn("ticket", label.otherwise(">70k"))
    out = binned.groupBy("ticket").agg(
        F.count("*").alias("n_txns"), F.sum("amount_cop").alias("gdv_cop"),
        *(F.sum(c).alias(c) for c in ("mdr_cop", "issuer_gross_cop", "network_revenue_cop", "acquirer_gross_cop")),
    )
    rates = [(F.col(c) / F.col("gdv_cop")).alias(c.replace("_cop", "_rate")) for c in ("mdr_cop", "issuer_gross_cop", "network_revenue_cop", "acquirer_gross_cop")]
    return out.select("ticket", "n_txns", "gdv_cop", *rates)


def repriced(priced: DataFrame, price_again, tiers: DataFrame) -> DataFrame:
    """The same purchases priced blended and passed on, by size tier, in one row for each tier."""
    out = None
    for model in ("blended", "icpp"):
        cost = price_again(priced.drop("pricing_model", "region").withColumn("pricing_model", F.lit(model)))
        cost = cost.join(tiers.select("merchant_id", "size_tier"), "merchant_id").groupBy("size_tier").agg(
            F.sum("amount_cop").alias("gdv_cop"), F.sum("mdr_cop").alias(f"mdr_{model}_cop"), F.sum("acquirer_gross_cop").alias(f"margin_{model}_cop")
        )
        out = cost if out is None else out.join(cost.drop("gdv_cop"), "size_tier")
    return out.withColumn("difference_rate", (F.col("mdr_icpp_cop") - F.col("mdr_blended_cop")) / F.col("gdv_cop"))


def shares(priced: DataFrame, group: str, of: str) -> DataFrame:
    """Share of each value of `of` in the volume of its group."""
    out = priced.groupBy(group, of).agg(F.sum("amount_cop").alias("gdv_cop"))
    return out.withColumn("share", F.col("gdv_cop") / F.sum("gdv_cop").over(W.partitionBy(group)))


def row_conservation(priced: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    received = money.row_sum(["issuer_gross_cop", "network_revenue_cop", "acquirer_gross_cop"])
    return priced.withColumn("received", received).where(F.abs(F.col("received") - F.col("mdr_cop")) > tolerance * F.greatest(F.abs("mdr_cop"), F.lit(1.0)))


