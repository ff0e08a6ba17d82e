"""Prices and parameters of the network, as data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# The products, channels, regions, groups and prices that results have to be computed with.
PRODUCTS = ("debit", "credit_standard", "credit_premium", "commercial")
CHANNELS = ("cp", "cnp")
REGIONS = ("domestic", "cross_border")
#: group: (sector margin, elasticity, blended MDR, online share, fraud risk, dispute rate)
GROUPS = {
    "grocery": (0.03, 1.5, 0.0160, 0.04, 0.8, 0.0002),
    "fuel": (0.03, 1.5, 0.0155, 0.0, 1.2, 0.0002),
    "utilities_telecom": (0.10, 0.8, 0.0165, 0.55, 0.6, 0.0003),
    "restaurants": (0.08, 1.2, 0.0215, 0.12, 1.0, 0.0004),
    "health": (0.10, 0.7, 0.0180, 0.06, 0.8, 0.0003),
    "retail": (0.12, 1.0, 0.0220, 0.15, 1.0, 0.0006),
    "home_electronics": (0.08, 1.0, 0.0215, 0.25, 1.5, 0.0008),
    "travel": (0.06, 0.9, 0.0270, 0.60, 1.8, 0.0030),
    "transport": (0.07, 1.3, 0.0200, 0.35, 1.0, 0.0005),
    "digital": (0.20, 0.6, 0.0240, 1.0, 2.0, 0.0025),
    "education": (0.15, 0.5, 0.0135, 0.30, 0.5, 0.0002),
    "entertainment": (0.10, 1.1, 0.0215, 0.25, 1.0, 0.0008),
}
#: Base interchange rate of each product, in the order of GROUPS; fixed part of each product.
BASE_RATES = {
    "debit": (0.0040, 0.0030, 0.0035, 0.0090, 0.0060, 0.0100, 0.0100, 0.0110, 0.0045, 0.0100, 0.0040, 0.0090),
    "credit_standard": (0.0120, 0.0120, 0.0120, 0.0170, 0.0150, 0.0180, 0.0180, 0.0200, 0.0130, 0.0180, 0.0120, 0.0170),
    "credit_premium": (0.0160, 0.0150, 0.0150, 0.0220, 0.0190, 0.0230, 0.0220, 0.0250, 0.0170, 0.0230, 0.0150, 0.0220),
    "commercial": (0.0170, 0.0160, 0.0160, 0.0230, 0.0200, 0.0240, 0.0240, 0.0260, 0.0180, 0.0240, 0.0160, 0.0230),
}
FIXED = {"debit": 0.0, "credit_standard": 100.0, "credit_premium": 150.0, "commercial": 200.0}
CNP_ADD, CROSS_BORDER_ADD = 0.0030, 0.0080
SMALL_MAX, SMALL_RATE, SMALL_FIXED = 20_000.0, 0.0020, 0.0
SMALL_PRODUCTS, SMALL_GROUPS = ("debit", "credit_standard"), ("grocery", "transport", "restaurants")
#: side: (assessment rate, authorization fee, cross-border rate)
NETWORK = {"issuer": (0.0002, 40.0, 0.008), "acquirer": (0.0013, 80.0, 0.0045)}
MARKUP_RATE, MARKUP_FIXED, BLENDED_CROSS_BORDER = 0.0020, 100.0, 0.015
PROCESSING_RATE, PROCESSING_FIXED = 0.0010, 100.0
#: product: (rewards, funding, credit loss, processing)
ISSUER_COSTS = {
    "debit": (0.0, 0.0, 0.0, 0.0010),
    "credit_standard": (0.004, 0.0020, 0.0030, 0.0015),
    "credit_premium": (0.012, 0.0025, 0.0015, 0.0020),
    "commercial": (0.008, 0.0030, 0.0010, 0.0020),
}
#: size tier: share of merchants, from the largest
TIERS = (("large", 0.01), ("medium", 0.09), ("small", 0.30), ("micro", 0.60))
#: acceptance curve and response
ABANDONMENT, SEMI_ELASTICITY, SHOCK = 0.035, 0.018, 0.10
CNP_SHIFT, ICPP_SENSITIVITY, INSTANT_SHIFT, INSTANT_TICKET = 0.35, 1.25, 0.45, 50_000.0
LOWEST, HIGHEST = 0.0005, 0.60
REWARDS_ELASTICITY = {"low": 0.4, "mid": 0.9, "high": 1.6}
SPEND_CAP, LEAKAGE = 0.25, 0.35
#: fraud: probability by channel, factors, chargeback given fraud
FRAUD = {"cp": 0.000174, "cnp": 0.00099}
FRAUD_CROSS_BORDER, FRAUD_TOKENIZED, CHARGEBACK_IF_FRAUD = 6.4, 0.5, 0.8


#: What a channel and a region add: (rate, fixed part); since when the prices hold.
CHANNEL_ADDS = {"cp": (0.0, 0.0), "cnp": (CNP_ADD, 0.0)}
REGION_ADDS = {"domestic": (0.0, 0.0), "cross_border": (CROSS_BORDER_ADD, 0.0)}
VALID_FROM = "2024-01-01"
CELL = ("product", "mcc_group", "channel", "region")


def _each(adds: dict[str, tuple[float, float]], name: str) -> Column:
    """A row for each key of adds, beside every row that there is."""
    return F.inline(F.array(*(F.struct(F.lit(k).alias(name), F.lit(r).alias(f"{name}_rate"), F.lit(f).alias(f"{name}_fixed")) for k, (r, f) in adds.items())))


def grid(
    spark: SparkSession, base=BASE_RATES, fixed=FIXED, overrides=(), channels=CHANNEL_ADDS, regions=REGION_ADDS, valid_from: str = VALID_FROM, valid_to: str | None = None
) -> DataFrame:
    """The interchange table: a row for each product, group, channel and region.

    overrides: (product, mcc_group, channel, region, rate, fixed) in place of what base and adds come to. A fee below 0
    raises when its cell is read.
    """
    priced = [(p, g, float(r), float(fixed[p])) for p, rates in base.items() for g, r in zip(GROUPS, rates, strict=True)]
    cells = spark.createDataFrame(priced, "product string, mcc_group string, base_rate double, base_fixed double")
    cells = cells.select("*", _each(channels, "channel")).select("*", _each(regions, "region"))
    own = spark.createDataFrame([tuple(o) for o in overrides], "product string, mcc_group string, channel string, region string, own_rate double, own_fixed double")
    cells = cells.join(F.broadcast(own), list(CELL), "left")
    sums = {k: F.col(f"base_{k}") + F.col(f"channel_{k}") + F.col(f"region_{k}") for k in ("rate", "fixed")}
    small = (F.col("region") == "domestic") & F.col("product").isin(*SMALL_PRODUCTS) & F.col("mcc_group").isin(*SMALL_GROUPS)
    found = cells.select(*CELL, F.coalesce("own_rate", F.round(sums["rate"], 6)).alias("rate"), F.coalesce("own_fixed", sums["fixed"]).alias("fixed_cop"), small.alias("small"))
    below = F.raise_error(F.concat(F.lit("fees can't be below 0, see "), F.concat_ws("/", *CELL))).cast("double")
    ok = (F.col("rate") >= 0) & (F.col("fixed_cop") >= 0)
    tier = {"small_ticket_max_cop": SMALL_MAX, "small_ticket_rate": SMALL_RATE, "small_ticket_fixed_cop": SMALL_FIXED}
    return found.select(
        *CELL, F.when(ok, F.col("rate")).otherwise(below).alias("rate"), F.when(ok, F.col("fixed_cop")).otherwise(below).alias("fixed_cop"),
        *(F.when(F.col("small"), F.lit(v)).alias(k) for k, v in tier.items()), F.lit(valid_from).cast("date").alias("valid_from"), F.lit(valid_to).cast("date").alias("valid_to"),
    )


def cell(table: DataFrame, product: str, mcc_group: str, channel: str, region: str) -> Row:
    """The one row of an interchange table for these keys; KeyError where there is none, ValueError where there are more."""
    keys = (product, mcc_group, channel, region)
    wanted = [F.col(name) == value for name, value in zip(CELL, keys, strict=True)]
    rows = table.where(reduce(lambda a, b: a & b, wanted)).limit(2).collect()
    if not rows:
        raise KeyError(keys)
    if len(rows) > 1:
        raise ValueError(f"more than one price for {keys}")
    return rows[0]


def groups(spark: SparkSession) -> DataFrame:
    rows = [(k, i, *v) for i, (k, v) in enumerate(GROUPS.items())]
    names = "mcc_group string, pos int, group_margin double, base_elasticity double, blended_mdr_rate double"
    return spark.createDataFrame(rows, names + ", online_share double, fraud_risk double, dispute_rate double")


def issuer_costs(spark: SparkSession) -> DataFrame:
    rows = [(k, i, *v) for i, (k, v) in enumerate(ISSUER_COSTS.items())]
    return spark.createDataFrame(rows, "product string, product_pos int, rewards double, funding double, loss double, processing double")


def network_fees(spark: SparkSession) -> DataFrame:
    """One row: three fees of each side."""
    parts = ("assessment_rate", "authorization_fee_cop", "cross_border_rate")
    names = [f"{side}_{p} double" for side in NETWORK for p in parts]
    return spark.createDataFrame([sum(NETWORK.values(), ())], ", ".join(names))


def pricing_terms(acquirers: DataFrame) -> DataFrame:
    return acquirers.select(
        "acquirer_id", F.lit(MARKUP_RATE).alias("icpp_markup_rate"), F.lit(MARKUP_FIXED).alias("icpp_markup_fixed_cop"),
        F.lit(BLENDED_CROSS_BORDER).alias("blended_cross_border_rate"),
    )
