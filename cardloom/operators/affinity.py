"""Lifestyles of cardholders, clienteles of merchants, and draws of merchants by affinity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.money import hashed_uniform
from ..sources import fees
from . import generate

# Lifestyles by product, and how each lifestyle multiplies the base mix of groups.
LIFESTYLES = ("household", "young_urban", "traveler", "business", "driver", "student")
LIFESTYLE_MIX = {
    "debit": (0.34, 0.24, 0.04, 0.02, 0.14, 0.22),
    "credit_standard": (0.34, 0.22, 0.14, 0.06, 0.18, 0.06),
    "credit_premium": (0.20, 0.15, 0.40, 0.15, 0.08, 0.02),
    "commercial": (0.02, 0.03, 0.10, 0.75, 0.10, 0.00),
}
BOOSTS = {
    "household": {"grocery": 1.6, "health": 1.5, "utilities_telecom": 1.5, "home_electronics": 1.3, "entertainment": 0.7, "travel": 0.5},
    "young_urban": {"restaurants": 1.8, "entertainment": 1.8, "digital": 1.8, "transport": 1.5, "grocery": 0.6, "utilities_telecom": 0.6},
    "traveler": {"travel": 4.0, "restaurants": 1.4, "retail": 1.3, "digital": 1.2, "grocery": 0.6},
    "business": {"travel": 3.0, "fuel": 1.8, "restaurants": 1.5, "home_electronics": 1.3, "grocery": 0.4, "education": 0.3},
    "driver": {"fuel": 3.5, "transport": 0.5, "home_electronics": 1.3, "grocery": 1.1},
    "student": {"education": 4.0, "digital": 1.8, "transport": 1.8, "restaurants": 1.3, "home_electronics": 0.5, "travel": 0.5},
}
CONCENTRATION, CLIENTELE_BOOST, HABIT, FAVORITES = 15.0, 4.0, 0.6, (0.6, 0.3, 0.1)


def prototypes(spark: SparkSession) -> DataFrame:
    """segment, mcc_group, share: each lifestyle's mix of groups."""
    rows = [(s, g, w * BOOSTS[s].get(g, 1.0)) for s in LIFESTYLES for g, w in zip(fees.GROUPS, generate.GROUP_MIX, strict=True)]
    raw = spark.createDataFrame(rows, "segment string, mcc_group string, w double")
    return raw.select("segment", "mcc_group", (F.col("w") / F.sum("w").over(W.partitionBy("segment"))).alias("share"))


def segment_shares(spark: SparkSession, product_mix=generate.PRODUCT_MIX) -> DataFrame:
    """segment, share: what part of the cards has each lifestyle."""
    rows = [(p, s, x) for p, mix in LIFESTYLE_MIX.items() for s, x in zip(LIFESTYLES, mix, strict=True)]
    mix = spark.createDataFrame(rows, "product string, segment string, x double")
    products = spark.createDataFrame(list(product_mix.items()), "product string, p double")
    return mix.join(F.broadcast(products), "product").groupBy("segment").agg(F.sum(F.col("x") * F.col("p")).alias("share"))


def clienteles(spark: SparkSession) -> DataFrame:
    """mcc_group, segment, share: whose demand a group's purchases are."""
    demand = prototypes(spark).join(F.broadcast(segment_shares(spark).withColumnRenamed("share", "s")), "segment")
    demand = demand.withColumn("d", F.col("share") * F.col("s"))
    return demand.select("mcc_group", "segment", (F.col("d") / F.sum("d").over(W.partitionBy("mcc_group"))).alias("share"))


def with_clientele(merchants: DataFrame, seed: str) -> DataFrame:
    ends = generate.cdf(clienteles(merchants.sparkSession), "segment", "share", ("mcc_group",))
    return generate.draw(merchants, hashed_uniform(F.col("merchant_id").cast("string"), seed, "clientele"), ends, "segment", ("mcc_group",)).withColumnRenamed("segment", "clientele")


def with_lifestyle(cards: DataFrame, seed: str) -> DataFrame:
    rows = [(p, s, x) for p, mix in LIFESTYLE_MIX.items() for s, x in zip(LIFESTYLES, mix, strict=True)]
    ends = generate.cdf(cards.sparkSession.createDataFrame(rows, "product string, segment string, x double"), "segment", "x", ("product",))
    return generate.draw(cards, hashed_uniform(F.col("cardholder_id").cast("string"), seed, "lifestyle"), ends, "segment", ("product",))


def preferences(cards: DataFrame, seed: int = 1) -> DataFrame:
    """Each card's mix of groups: a Dirichlet draw around its lifestyle's, from a generator seeded by seed and card."""
    names = sorted(fees.GROUPS)
    alpha = prototypes(cards.sparkSession).groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("mcc_group", "share"))).alias("p"))
    rows = cards.select("cardholder_id", "segment").join(F.broadcast(alpha.select("segment", F.transform("p", lambda x: x["share"] * CONCENTRATION).alias("alpha"))), "segment")

    def one(frames):
        for pdf in frames:
            out = [np.random.default_rng([seed, int(k)]).dirichlet(a).tolist() for k, a in zip(pdf.cardholder_id, pdf.alpha, strict=True)]
            yield pd.DataFrame({"cardholder_id": pdf.cardholder_id, "preference": out})

    drawn = rows.mapInPandas(one, "cardholder_id bigint, preference array<double>")
    return drawn.select("cardholder_id", F.map_from_arrays(F.array(*map(F.lit, names)), F.col("preference")).alias("preference"))


def intervals(merchants: DataFrame, cells: int = 64) -> DataFrame:
    """mcc_group, segment, cell, merchant_id, lo, hi: merchants by size, those of the segment's clientele boosted.

    An interval stands under every one of `cells` equal cells that it touches, so that draws join by equality.
    """
    spark = merchants.sparkSession
    segments = F.broadcast(spark.createDataFrame([(s,) for s in LIFESTYLES], "segment string"))
    match = F.when(F.col("clientele") == F.col("segment"), CLIENTELE_BOOST).otherwise(0.0)
    weighted = merchants.join(segments).withColumn("_w", F.col("size_weight") * (1 + match))  # six rows a merchant
    w = W.partitionBy("mcc_group", "segment")
    run = F.sum("_w").over(w.orderBy("merchant_id").rowsBetween(W.unboundedPreceding, 0))
    ends = weighted.withColumns({"hi": run / F.sum("_w").over(w)}).withColumn("lo", F.lag("hi", 1, 0.0).over(w.orderBy("merchant_id")))
    last = F.row_number().over(w.orderBy(F.desc("merchant_id"))) == 1
    ends = ends.withColumn("hi", F.when(last, F.lit(1.0)).otherwise(F.col("hi")))
    at = lambda c: F.least(F.lit(cells - 1), F.floor(F.col(c) * cells)).cast("int")
    return ends.select("mcc_group", "segment", F.explode(F.sequence(at("lo"), at("hi"))).alias("cell"), "merchant_id", "lo", "hi")


def draw_merchant(rows: DataFrame, u: Column, ends: DataFrame, cells: int = 64) -> DataFrame:
    """rows (with mcc_group and segment) and the merchant whose interval holds u."""
    asked = rows.withColumn("_u", u).withColumn("cell", F.least(F.lit(cells - 1), F.floor(F.col("_u") * cells)).cast("int"))
    return asked.join(ends, ["mcc_group", "segment", "cell"]).where((F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi"))).drop("_u", "cell", "lo", "hi")


def favorites(cards: DataFrame, merchants: DataFrame, seed: str) -> DataFrame:
    """cardholder_id, mcc_group, rank, merchant_id: three habitual merchants of each card and group."""
    slots = cards.sparkSession.createDataFrame([(g, k) for g in fees.GROUPS for k in range(len(FAVORITES))], "mcc_group string, rank int")
    rows = cards.select("cardholder_id", "segment").join(F.broadcast(slots))  # 36 rows a card
    u = hashed_uniform(F.col("cardholder_id").cast("string"), F.col("mcc_group"), F.col("rank").cast("string"), seed, "favorite")
    return draw_merchant(rows, u, intervals(merchants)).select("cardholder_id", "mcc_group", "rank", "merchant_id")
