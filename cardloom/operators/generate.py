"""A seeded generator of card networks: every draw is a hash of what it is for, so any stage can be resized alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.money import hashed_uniform
from ..sources import fees
from ..sources.scratch import ranked

#: Yearly profile of spending and the mix of groups, in the order of fees.GROUPS.
GROUP_MIX = (0.24, 0.07, 0.06, 0.14, 0.07, 0.14, 0.04, 0.03, 0.09, 0.06, 0.02, 0.04)
MONTHS = (0.90, 0.92, 0.97, 0.96, 1.00, 1.04, 1.02, 0.99, 0.98, 1.00, 1.06, 1.30)
PAYDAYS, PAYDAY_BOOST, GROWTH = (1, 14, 15, 16, 29, 30, 31), 1.15, 1.19
WEEKEND_SHOPPING = (0.90, 0.90, 0.95, 1.00, 1.10, 1.30, 1.05)
PRODUCT_MIX = {"debit": 0.55, "credit_standard": 0.27, "credit_premium": 0.12, "commercial": 0.06}


def cdf(weights: DataFrame, key: str, weight: str, within: tuple[str, ...] = ()) -> DataFrame:
    """weights with [lo, hi): each key's interval of the unit interval, in key order inside its cell."""
    cell = W.partitionBy(*within) if within else W.partitionBy(F.lit(1))
    share = F.col(weight) / F.sum(weight).over(cell)
    out = weights.withColumn("_share", share)
    upto = F.sum("_share").over(cell.orderBy(key).rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("_share"))
    last = F.row_number().over(cell.orderBy(F.desc(key))) == 1
    return out.withColumn("hi", F.when(last, F.lit(1.0000001)).otherwise(F.col("hi"))).drop("_share")


def draw(rows: DataFrame, u: Column, intervals: DataFrame, key: str, within: tuple[str, ...] = ()) -> DataFrame:
    """rows with the key whose interval of their cell holds u; the intervals are a small configured table."""
    on = (F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi"))
    for c in within:
        on = on & (rows[c] == intervals[c])
    out = rows.withColumn("_u", u).join(F.broadcast(intervals.select(*within, key, "lo", "hi")), on)
    for c in within:
        out = out.drop(intervals[c])
    return out.drop("_u", "lo", "hi")


def normal(*parts) -> Column:
    """A standard normal number by Box and Muller from two hashed uniforms."""
    a, b = hashed_uniform(*parts, "radius"), hashed_uniform(*parts, "angle")
    return F.sqrt(-2 * F.ln(F.greatest(a, F.lit(1e-12)))) * F.cos(2 * 3.141592653589793 * b)


def lognormal(median: Column | float, sigma: float, *parts) -> Column:
    return (median if isinstance(median, Column) else F.lit(median)) * F.exp(sigma * normal(*parts))


def cardholders(spark: SparkSession, n: int, seed: str) -> DataFrame:
    key = F.col("cardholder_id").cast("string")
    rows = spark.range(n).select((F.col("id") + 1).alias("cardholder_id"))
    products = cdf(spark.createDataFrame(list(PRODUCT_MIX.items()), "product string, w double"), "product", "w")
    out = draw(rows, hashed_uniform(key, seed, "product"), products, "product")
    spend = F.when(hashed_uniform(key, seed, "spend") < 0.5, "low").when(hashed_uniform(key, seed, "spend") < 0.85, "mid").otherwise("high")
    activity = lognormal(1.0, 0.8, key, F.lit(seed), F.lit("activity"))
    return out.withColumns({"spend_segment": spend, "issuer_id": (F.pmod(F.xxhash64("cardholder_id"), F.lit(12))).cast("string"), "activity": activity})


def merchants(spark: SparkSession, n: int, seed: str) -> DataFrame:
    key = F.col("merchant_id").cast("string")
    rows = spark.range(n).select((F.col("id") + 1).alias("merchant_id"))
    groups = spark.createDataFrame(list(zip(fees.GROUPS, GROUP_MIX, strict=True)), "mcc_group string, w double")
    out = draw(rows, hashed_uniform(key, seed, "group"), cdf(groups, "mcc_group", "w"), "mcc_group")
    out = out.join(F.broadcast(fees.groups(spark).select("mcc_group", "group_margin", "online_share")), "mcc_group")
    online = hashed_uniform(key, seed, "online") < F.col("online_share")
    weight = lognormal(1.0, 1.2, key, F.lit(seed), F.lit("size"))
    margin = F.greatest(F.lit(0.005), F.least(F.lit(0.9), F.col("group_margin") * (0.75 + 0.5 * hashed_uniform(key, seed, "margin"))))
    return out.select("merchant_id", "mcc_group", F.when(online, "cnp").otherwise("cp").alias("channel"), weight.alias("size_weight"), margin.alias("sector_margin"), F.pmod(F.xxhash64("merchant_id"), F.lit(8)).cast("string").alias("acquirer_id"))


def day_weights(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Weight of each day: month, growth since the first year, paydays and weekday."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    by = lambda values, k: F.element_at(F.array(*map(F.lit, values)), k)
    growth = F.pow(F.lit(GROWTH), (F.year("day") - F.year(F.lit(start).cast("date"))).cast("double"))
    payday = F.when(F.dayofmonth("day").isin(*PAYDAYS), PAYDAY_BOOST).otherwise(1.0)
    return days.withColumn("weight", by(MONTHS, F.month("day")) * growth * payday * by(WEEKEND_SHOPPING, F.weekday("day") + 1))


def in_order(purchases: DataFrame, key: Column, seed: str, date: str = "txn_date") -> DataFrame:
    """purchases with their position by date; those of one day in the order of a hash of their key."""
    u = hashed_uniform(key, seed, "order")
    return ranked(purchases.withColumns({"_u": u, "_k": key}), date, "_u", "_k", name="position").drop("_u", "_k")


def fraud_probability(purchases: DataFrame, groups: DataFrame) -> DataFrame:
    """Channel base times the group's risk, abroad and token factors, at most 1."""
    base = F.when(F.col("channel") == "cnp", fees.FRAUD["cnp"]).otherwise(fees.FRAUD["cp"])
    factor = F.when(F.col("cross_border"), fees.FRAUD_CROSS_BORDER).otherwise(1.0) * F.when(F.col("tokenized"), fees.FRAUD_TOKENIZED).otherwise(1.0)
    out = purchases.join(F.broadcast(groups.select("mcc_group", "fraud_risk")), "mcc_group")
    return out.withColumn("fraud_probability", F.least(F.lit(1.0), base * F.col("fraud_risk") * factor)).drop("fraud_risk")


def purchases(spark: SparkSession, n: int, cards: DataFrame, shops: DataFrame, seed: str, start: str = "2024-01-01", end: str = "2025-12-31") -> DataFrame:
    """n purchases: a card by activity, a merchant by size, a day by weight, an amount; all by hashed draws.

    The intervals of cards and merchants are cut into cells of equal width that are joined by equality, so that a draw
    meets the few intervals of its cell and not the whole table.
    """
    rows = spark.range(n).select((F.col("id") + 1).alias("txn_id"))
    key = F.col("txn_id").cast("string")

    def pick(rows: DataFrame, table: DataFrame, name: str, weight: str, salt: str, cells: int) -> DataFrame:
        total = table.agg(F.sum(weight).alias("_t"))
        # running sums over hash ranges first: a partition's sum is added before its own rows are
        part = F.pmod(F.xxhash64(name), F.lit(64))
        sums = table.groupBy(part.alias("_p")).agg(F.sum(weight).alias("_s"))
        before = sums.select("_p", F.coalesce(F.sum("_s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_b"))
        inside = F.sum(weight).over(W.partitionBy("_p").orderBy(name).rowsBetween(W.unboundedPreceding, 0))
        ends = table.select(name, weight, part.alias("_p")).withColumn("_i", inside).join(F.broadcast(before), "_p").crossJoin(F.broadcast(total))
        hi = (F.col("_b") + F.col("_i")) / F.col("_t")
        ends = ends.select(name, (hi - F.col(weight) / F.col("_t")).alias("lo"), hi.alias("hi"))
        cell = lambda c: F.least(F.lit(cells - 1), F.floor(c * cells)).cast("int")
        ends = ends.withColumn("_cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
        asked = rows.withColumn("_u", F.least(hashed_uniform(key, seed, salt), F.lit(1 - 1e-12))).withColumn("_cell", cell(F.col("_u")))
        return asked.join(ends, (asked["_cell"] == ends["_cell"]) & (F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi"))).drop("_cell", "_u", "lo", "hi")

    out = pick(rows, cards, "cardholder_id", "activity", "card", 4_096)
    out = pick(out, shops, "merchant_id", "size_weight", "shop", 4_096)
    days = cdf(day_weights(spark, start, end), "day", "weight")
    out = draw(out, F.least(hashed_uniform(key, seed, "day"), F.lit(1 - 1e-12)), days, "day").withColumnRenamed("day", "txn_date")
    amount = F.greatest(F.round(lognormal(40_000.0, 0.9, key, F.lit(seed), F.lit("amount"))), F.lit(1.0)).cast("bigint")
    out = out.join(cards.select("cardholder_id", "product", "issuer_id"), "cardholder_id").join(shops.select("merchant_id", "mcc_group", "channel", "acquirer_id"), "merchant_id")
    abroad = hashed_uniform(key, seed, "abroad") < 0.04
    token = (F.col("channel") == "cnp") & (hashed_uniform(key, seed, "token") < 0.5)
    out = out.withColumns({"amount_cop": amount, "cross_border": abroad, "tokenized": token})
    out = fraud_probability(out, fees.groups(spark))
    fraud = hashed_uniform(key, seed, "fraud") < F.col("fraud_probability")
    out = out.withColumn("fraud_flag", fraud)
    charge = F.when(F.col("fraud_flag"), hashed_uniform(key, seed, "charge") < fees.CHARGEBACK_IF_FRAUD).otherwise(hashed_uniform(key, seed, "dispute") < 0.0005)
    return out.withColumn("chargeback_flag", charge).drop("fraud_probability")
