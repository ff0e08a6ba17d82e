"""Merchant profiles and reports on segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.fees import PRODUCTS
from ..sources.scratch import running
from ..sources.tables import require

NEEDED = ("merchant_id", "cardholder_id", "amount_cop", "interchange_cop", "mdr_cop", "channel", "cross_border", "product")

#: Purchases whose cardholders are told apart at once.
SLICE_ROWS = 8_000_000


def customers_of(fact: DataFrame, slices: int = 1) -> DataFrame:
    """merchant_id, n_customers: different cardholders, in slices of merchants, so that a task's pairs stay in its memory."""
    pairs = fact.select("merchant_id", "cardholder_id")
    counted = None
    for k in range(slices):
        some = pairs if slices == 1 else pairs.where(F.pmod(F.xxhash64("merchant_id"), F.lit(slices)) == k)
        one = some.distinct().groupBy("merchant_id").agg(F.count("cardholder_id").alias("_n"))
        counted = one if counted is None else counted.union(one)
    return counted.groupBy("merchant_id").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_customers"))


def merchant_profile(fact: DataFrame, merchants: DataFrame, rows: int | None = None, once: bool = False) -> DataFrame:
    """One row for each merchant with purchases. rows: about how many these are, if that is known.

    Cardholders are counted apart from the sums: counted with them, each pair of merchant and cardholder, nearly as many as
    purchases, would carry all sums, which no task's memory holds. once: they are counted with them all the same, of purchases
    that are costly to read twice and dealt by merchant_id into parts that a task's memory does hold.
    """
    require(fact, NEEDED, "purchases")
    share = lambda c: F.avg(c.cast("double"))
    volume = fact.groupBy("merchant_id").agg(
        F.count("*").alias("n_txns"), F.sum("amount_cop").cast("double").alias("gdv_cop"),
        F.sum("interchange_cop").alias("interchange_cop"), F.sum("mdr_cop").alias("mdr_cop"), share(F.col("channel") == "cnp").alias("cnp_share"),
        share(F.col("cross_border")).alias("cross_border_share"), *(share(F.col("product") == p).alias(f"share_{p}") for p in PRODUCTS),
        *([F.count_distinct("cardholder_id").alias("n_customers")] if once else []),
    )
    if not once:
        # left, though none is missing: so Spark leaves the count out where nobody asks for it
        volume = volume.join(customers_of(fact, max(1, -(-(rows or 0) // SLICE_ROWS))), "merchant_id", "left")
    facts = merchants.select("merchant_id", "mcc_group", F.col("channel").alias("merchant_channel"), "size_tier", "pricing_model", "sector_margin")
    rate = F.col("mdr_cop") / F.col("gdv_cop")
    return volume.join(facts, "merchant_id").select("merchant_id", "n_txns", "n_customers", *[c for c in volume.columns if c not in ("merchant_id", "n_txns", "n_customers")], *facts.columns[1:]).withColumns({
        "avg_ticket_cop": F.col("gdv_cop") / F.col("n_txns"), "effective_interchange_rate": F.col("interchange_cop") / F.col("gdv_cop"),
        "effective_mdr_rate": rate, "relative_burden": rate / F.col("sector_margin"),
    })


def uncovered(fact: DataFrame, merchants: DataFrame) -> DataFrame:
    """Merchants with purchases that the dimension lacks: a 1:1 join has to lose none."""
    return fact.select("merchant_id").distinct().join(merchants.select("merchant_id"), "merchant_id", "left_anti")


def population(profile: DataFrame, least: int = 10) -> DataFrame:
    return profile.where(F.col("n_txns") >= least)


def top_labels(df: DataFrame, group: str, label: str, by: str, n: int = 3) -> DataFrame:
    """The n labels of a group with the most volume, joined by commas; ties by the label."""
    sums = df.groupBy(group, label).agg(F.sum(by).alias("_v"))
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("_v"), label))
    best = sums.withColumn("_r", rank).where(F.col("_r") <= n)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", label))), lambda x: x[label]), ", ")
    return best.groupBy(group).agg(listed.alias(f"top_{label}"))


def segment_profile(profile: DataFrame, segment: str) -> DataFrame:
    """Nine numbers of each segment and its three largest groups and tiers."""
    weighted = lambda c: F.sum(F.col(c) * F.col("gdv_cop")) / F.sum("gdv_cop")
    out = profile.groupBy(segment).agg(
        F.count("*").alias("merchants"), F.sum("gdv_cop").alias("gdv_cop"), F.sum("n_txns").alias("n_txns"),
        F.median("avg_ticket_cop").alias("median_ticket_cop"), F.median("relative_burden").alias("median_burden"),
        weighted("effective_mdr_rate").alias("effective_mdr_rate"), weighted("effective_interchange_rate").alias("effective_interchange_rate"),
        weighted("cnp_share").alias("cnp_share"), weighted("cross_border_share").alias("cross_border_share"),
    )
    return out.join(top_labels(profile, segment, "mcc_group", "gdv_cop"), segment).join(top_labels(profile, segment, "size_tier", "gdv_cop"), segment)


def eta_squared(df: DataFrame, value: str, segment: str, weight: str | None = None) -> DataFrame:
    """1 - within / total sum of squares, weighted if asked; null where all values are equal. From moments of each segment, one pass."""
    w = F.col(weight) if weight else F.lit(1)
    part = df.groupBy(segment).agg(F.sum(w).alias("n"), F.sum(w * F.col(value)).alias("s"), F.sum(w * F.col(value) * F.col(value)).alias("q"))
    sums = part.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    total = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return sums.select(F.when(total > 1e-12, 1 - (F.col("q") - F.col("b")) / total).alias("eta_squared"))


def quantiles(df: DataFrame, group: str, value: str, points=(0.1, 0.5, 0.9)) -> DataFrame:
    """Interpolated quantiles by group."""
    return df.groupBy(group).agg(*(F.percentile(value, F.lit(p)).alias(f"p{int(100 * p)}") for p in points))


def nearest_quantile(df: DataFrame, group: str, value: str, point: float) -> DataFrame:
    """The value at rank round((n - 1) * point) of each group: no interpolation, halves to even as Python rounds."""
    w = W.partitionBy(group)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_r") == F.bround((F.col("_n") - 1) * point, 0).cast("bigint")).select(group, F.col(value).alias("quantile"))


def lorenz(profile: DataFrame, value: str = "gdv_cop", buckets: int = 20) -> DataFrame:
    """Cumulative share of merchants and of value, ascending, at `buckets` cuts; different values are summed in ranges."""
    counts = profile.groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col(value)).alias("sum"))
    run = running(counts, F.asc(value), upto=F.col("n"), value_upto=F.col("n") * F.col(value)).crossJoin(F.broadcast(total))
    bucket = F.ceil(F.col("upto") / F.col("rows") * buckets).cast("int")
    out = run.select(bucket.alias("bucket"), (F.col("upto") / F.col("rows")).alias("merchants"), (F.col("value_upto") / F.col("sum")).alias("value"))
    return out.groupBy("bucket").agg(F.max("merchants").alias("merchant_share"), F.max("value").alias("value_share"))


def on_us_excess(fact: DataFrame) -> DataFrame:
    """Observed share of on-us purchases against that of independent issuers and acquirers."""
    seen = fact.agg(F.avg(F.col("on_us").cast("double")).alias("observed"), F.count("*").alias("n"))
    a = fact.groupBy(F.col("issuer_id").alias("bank")).agg(F.count("*").alias("a"))
    b = fact.groupBy(F.col("acquirer_id").alias("bank")).agg(F.count("*").alias("b"))
    chance = a.join(b, "bank").agg(F.sum(F.col("a") * F.col("b")).cast("double").alias("ab"))
    return seen.crossJoin(chance).select("observed", (F.col("ab") / (F.col("n") * F.col("n"))).alias("independent"))  # one row each
