"""Pricing: every purchase with the split of its merchant's charge, costs and contributions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money
from ..sources import bridge, fees
from ..sources.tables import require

WATERFALL = (
    "interchange_cop", "issuer_network_fee_cop", "acquirer_network_fee_cop", "network_revenue_cop", "mdr_cop", "issuer_gross_cop", "acquirer_gross_cop",
)
DRIVERS = ("network_assessment_cop", "network_authorization_cop", "network_cross_border_cop")
COSTS = (
    "rewards_cop", "funding_cop", "credit_loss_cop", "issuer_processing_cop", "fraud_loss_cop", "acquirer_processing_cop", "chargeback_cop",
)
RESULTS = ("issuer_contribution_cop", "acquirer_contribution_cop", "merchant_cost_cop")
MONEY = (*WATERFALL, *DRIVERS, *COSTS, *RESULTS)
REQUIRED = (
    "merchant_id", "issuer_id", "acquirer_id", "product", "mcc_group", "channel", "cross_border", "amount_cop", "fraud_flag", "chargeback_flag",
)


@dataclass(frozen=True)
class Prices:
    """Small tables that a purchase is priced with."""

    grid: DataFrame
    groups: DataFrame
    costs: DataFrame
    network: DataFrame
    terms: DataFrame

    @classmethod
    def configured(cls, spark: SparkSession, acquirers: DataFrame) -> Prices:
        return cls(fees.grid(spark), fees.groups(spark), fees.issuer_costs(spark), fees.network_fees(spark), fees.pricing_terms(acquirers))


def one_each(table: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The table with a row for each key; a key that stands more than once raises when it is read, instead of doubling purchases."""
    rest = F.first(F.struct(*(F.col(c) for c in table.columns if c not in keys)))
    n = F.count("*")
    found = table.groupBy(*keys).agg(F.when(n == 1, rest).otherwise(F.raise_error(F.lit(f"more than one {what} for a key"))).alias("_row"))
    return found.select(*keys, "_row.*")


#: Columns of the price tables that a purchase is priced with: few different values, which a file keeps as numbers of a dictionary.
RATES = (
    "rate", "fixed_cop", "small_ticket_max_cop", "small_ticket_rate", "small_ticket_fixed_cop", "blended_mdr_rate", "rewards", "funding", "loss", "processing",
    "icpp_markup_rate", "icpp_markup_fixed_cop", "blended_cross_border_rate",
    *(f"{s}_{n}" for s in ("issuer", "acquirer") for n in ("assessment_rate", "authorization_fee_cop", "cross_border_rate")),
)


def modelled(purchases: DataFrame, merchants: DataFrame | None, parts: int | None = None) -> DataFrame:
    """purchases with pricing_model; their own, if they have one. parts: to how many they are dealt by merchant_id, as merchants then are."""
    if "pricing_model" in purchases.columns:
        return purchases
    if merchants is None:
        raise ValueError("purchases have no pricing_model: pass the merchants")
    models = one_each(merchants.select("merchant_id", "pricing_model"), ["merchant_id"], "pricing model")
    return purchases.join(models.repartition(parts, "merchant_id") if parts else models, "merchant_id", "left")


def rated(purchases: DataFrame, prices: Prices, merchants: DataFrame | None = None) -> DataFrame:
    """purchases with pricing_model, region and RATES: all that amounts() needs; money columns already there go.

    Every price table is far below any broadcast limit by construction (192 cells, 12 groups, 4 products, one row of
    fees, one row an acquirer), merchants are joined as their size asks for. A price that stands more than once raises when
    it is read; every purchase stays one row.
    """
    require(purchases, REQUIRED, "purchases")
    out = modelled(purchases.drop(*MONEY), merchants)
    columns = [c for c in purchases.columns if c not in (*MONEY, "pricing_model", "region")]
    out = out.withColumn("region", money.region())
    for table, keys, what in (
        (prices.grid.drop("valid_from", "valid_to"), list(fees.CELL), "interchange price"), (prices.groups.select("mcc_group", "blended_mdr_rate"), ["mcc_group"], "group"),
        (prices.costs, ["product"], "issuer cost"), (prices.terms, ["acquirer_id"], "pricing term"),
    ):
        out = out.join(F.broadcast(one_each(table, keys, what)), keys, "left")
    out = out.withColumn("_all", F.lit(1)).join(F.broadcast(one_each(prices.network.withColumn("_all", F.lit(1)), ["_all"], "row of network fees")), "_all", "left")
    return out.select(*columns, "region", "pricing_model", *RATES)


def amounts(out: DataFrame) -> DataFrame:
    """Rated purchases with all MONEY columns in place of RATES; a price that is missing raises when it is read."""
    columns = [c for c in out.columns if c not in (*RATES, "region", "pricing_model")]
    gap = lambda c, what: F.coalesce(c, F.raise_error(F.lit(f"a purchase has no {what}")).cast("double"))
    side = {s: {p: money.side_fee(s, p) for p in ("assessment", "authorization", "cross_border")} for s in ("issuer", "acquirer")}
    out = out.withColumns({
        "interchange_cop": gap(money.interchange(money.amount()), "interchange price"),
        **{f"{s}_network_fee_cop": p["assessment"] + p["authorization"] + p["cross_border"] for s, p in side.items()},
        **{f"network_{p}_cop": side["issuer"][p] + side["acquirer"][p] for p in ("assessment", "authorization", "cross_border")},
    })
    out = out.withColumn("mdr_cop", gap(money.mdr(), "MDR"))
    out = out.withColumns({
        "network_revenue_cop": F.col("issuer_network_fee_cop") + F.col("acquirer_network_fee_cop"),
        "issuer_gross_cop": F.col("interchange_cop") - F.col("issuer_network_fee_cop"),
        "acquirer_gross_cop": F.col("mdr_cop") - F.col("interchange_cop") - F.col("acquirer_network_fee_cop"),
        "rewards_cop": money.amount() * F.col("rewards"), "funding_cop": money.amount() * F.col("funding"),
        "credit_loss_cop": money.amount() * F.col("loss"), "issuer_processing_cop": money.amount() * F.col("processing"),
        "fraud_loss_cop": F.when(F.col("fraud_flag") & ~F.col("chargeback_flag"), money.amount()).otherwise(F.lit(0.0)),
        "acquirer_processing_cop": money.amount() * fees.PROCESSING_RATE + fees.PROCESSING_FIXED,
        "chargeback_cop": F.when(F.col("chargeback_flag"), money.amount()).otherwise(F.lit(0.0)),
    })
    costs = F.col("rewards_cop") + F.col("funding_cop") + F.col("credit_loss_cop") + F.col("issuer_processing_cop") + F.col("fraud_loss_cop")
    out = out.withColumns({
        "issuer_contribution_cop": F.col("issuer_gross_cop") - costs,
        "acquirer_contribution_cop": F.col("acquirer_gross_cop") - F.col("acquirer_processing_cop"),
        "merchant_cost_cop": F.col("mdr_cop") + F.col("chargeback_cop"),
    })
    return out.select(*columns, "region", "pricing_model", *MONEY)


def price(purchases: DataFrame, prices: Prices, merchants: DataFrame | None = None) -> DataFrame:
    """purchases with pricing_model and all MONEY columns; money columns already there are computed anew."""
    return amounts(rated(purchases, prices, merchants))


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priced purchases of a data folder, with their month."""
    acquirers = bridge.acquirers(spark, sf_dir)
    out = price(bridge.transactions(spark, sf_dir), Prices.configured(spark, acquirers), bridge.merchants(spark, sf_dir))
    return out.withColumn("txn_month", F.trunc("txn_date", "MM"))


def gaps(purchases: DataFrame, prices: Prices) -> DataFrame:
    """One row: how many purchases lack a cell, a group, a term or a pricing model."""
    out = purchases.withColumn("region", money.region())
    out = out.join(F.broadcast(prices.grid.withColumn("_cell", F.lit(1))), ["product", "mcc_group", "channel", "region"], "left")
    out = out.join(F.broadcast(prices.groups.select("mcc_group", F.lit(1).alias("_group"))), "mcc_group", "left")
    out = out.join(F.broadcast(prices.terms.select("acquirer_id", F.lit(1).alias("_term"))), "acquirer_id", "left")
    count = lambda c: F.coalesce(F.sum(F.col(c).isNull().cast("bigint")), F.lit(0)).alias(c.strip("_") + "_missing")
    return out.agg(count("_cell"), count("_group"), count("_term"))


def duplicate_cells(grid: DataFrame) -> DataFrame:
    return grid.groupBy("product", "mcc_group", "channel", "region").count().where("count > 1")
