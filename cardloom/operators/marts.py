"""Marts and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effective_interchange(fact: DataFrame) -> DataFrame:
    keys = ["txn_month", "product", "mcc_group", "channel", "region"]
    columns = ("interchange_cop", "network_revenue_cop", "mdr_cop", "issuer_gross_cop", "acquirer_gross_cop")
    out = fact.groupBy(*keys).agg(F.count("*").alias("n_txns"), F.sum("amount_cop").alias("gdv_cop"), *(F.sum(c).alias(c) for c in columns))
    ratio = {"effective_interchange_rate": "interchange_cop", "net_revenue_yield": "network_revenue_cop", "effective_mdr_rate": "mdr_cop", "acquirer_margin_rate": "acquirer_gross_cop"}
    return out.withColumns({k: F.col(c) / F.col("gdv_cop") for k, c in ratio.items()})


def pnl_by_actor(fact: DataFrame) -> DataFrame:
    """Gross income of issuer, acquirer and network; each purchase is read once and gives three rows."""
    part = lambda kind, key, c: F.struct(F.lit(kind).alias("actor_type"), key.alias("actor_id"), F.col(c).alias("revenue_cop"))
    parts = F.array(
        part("issuer", F.col("issuer_id"), "issuer_gross_cop"), part("acquirer", F.col("acquirer_id"), "acquirer_gross_cop"),
        part("network", F.lit("NETWORK"), "network_revenue_cop"),
    )
    rows = fact.select("txn_month", "product", "mcc_group", "amount_cop", F.inline(parts))
    return rows.groupBy("txn_month", "actor_type", "actor_id", "product", "mcc_group").agg(
        F.count("*").alias("n_txns"), F.sum("amount_cop").alias("gdv_cop"), F.sum("revenue_cop").alias("revenue_cop")
    )


def merchant_burden(fact: DataFrame, merchants: DataFrame) -> DataFrame:
    volume = fact.groupBy("merchant_id").agg(F.count("*").alias("n_txns"), F.sum("amount_cop").alias("gdv_cop"), F.sum("mdr_cop").alias("mdr_cop"))
    rate = F.col("mdr_cop") / F.col("gdv_cop")
    facts = merchants.select("merchant_id", "mcc", "mcc_group", "size_tier", "acquirer_id", "pricing_model", "sector_margin")
    return volume.join(facts, "merchant_id").withColumns({"effective_mdr_rate": rate, "relative_burden": rate / F.col("sector_margin")})


def graph_edges(fact: DataFrame, merchant: str = "merchant_id") -> DataFrame:
    return fact.groupBy("txn_month", "cardholder_id", F.col(merchant).alias("merchant_id")).agg(F.count("*").alias("n_txns"), F.sum("amount_cop").alias("amount_cop"))


def dim_cardholder(cardholders: DataFrame, issuers: DataFrame) -> DataFrame:
    return cardholders.join(issuers.select("issuer_id", "issuer_type", "country"), "issuer_id", "left").select(
        "cardholder_id", "issuer_id", "issuer_type", "product", "country", "spend_segment"
    )


def dim_merchant(merchants: DataFrame, mccs: DataFrame) -> DataFrame:
    return merchants.join(mccs.select("mcc", "mcc_name"), "mcc", "left").select(
        "merchant_id", "mcc", "mcc_name", "mcc_group", "channel", "size_tier", "size_weight", "acquirer_id", "pricing_model", "sector_margin"
    )


def dim_date(purchases: DataFrame) -> DataFrame:
    """Every day from the first purchase to the last."""
    span = purchases.agg(F.min("txn_date").alias("a"), F.max("txn_date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("date_day"))
    weekday = F.weekday("date_day") + 1
    return days.select(
        "date_day", F.year("date_day").cast("bigint").alias("year"), F.quarter("date_day").cast("bigint").alias("quarter"),
        F.month("date_day").cast("bigint").alias("month"), F.trunc("date_day", "MM").alias("month_start"),
        F.dayofmonth("date_day").cast("bigint").alias("day_of_month"), weekday.cast("bigint").alias("iso_weekday"), (weekday >= 6).alias("is_weekend"),
    )
