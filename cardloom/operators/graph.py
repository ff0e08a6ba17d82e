"""Cardholders and merchants as a bipartite graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import ranked, running


def last_months(edges: DataFrame, n: int) -> DataFrame:
    """Edges of the last n months that have data."""
    last = edges.agg(F.add_months(F.max("txn_month"), -(n - 1)).alias("_from"))
    return edges.join(F.broadcast(last), F.col("txn_month") >= F.col("_from")).drop("_from")


def collapse(edges: DataFrame) -> DataFrame:
    return edges.groupBy("cardholder_id", "merchant_id").agg(F.sum("n_txns").alias("n_txns"), F.sum("amount_cop").alias("amount_cop"))


def degrees(pairs: DataFrame, side: str) -> DataFrame:
    return pairs.groupBy(side).agg(F.count("*").alias("degree"))


def cap_degree(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs of cardholders with at most `most` merchants."""
    keep = degrees(pairs, "cardholder_id").where(F.col("degree") <= most).select("cardholder_id")
    return pairs.join(keep, "cardholder_id", "left_semi")


def stats(pairs: DataFrame) -> DataFrame:
    cards, shops = degrees(pairs, "cardholder_id"), degrees(pairs, "merchant_id")
    size = lambda d, name: d.agg(F.count("*").alias(f"n_{name}"), F.avg("degree").alias(f"mean_{name}_degree"), F.median("degree").alias(f"median_{name}_degree"))
    one = pairs.agg(F.count("*").alias("n_edges"))
    out = one.crossJoin(size(cards, "cardholders")).crossJoin(size(shops, "merchants"))  # one row each
    return out.withColumn("density", F.col("n_edges") / (F.col("n_cardholders") * F.col("n_merchants")))


def habitual(pairs: DataFrame, top: int) -> DataFrame:
    """Each cardholder's `top` merchants by purchases, ties by id."""
    rank = F.row_number().over(W.partitionBy("cardholder_id").orderBy(F.desc("n_txns"), "merchant_id"))
    return pairs.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")


def projection(pairs: DataFrame, top: int = 10, least: int = 3, neighbours: int = 30) -> DataFrame:
    """merchant_a < merchant_b with the number of cardholders that have both among their habitual merchants.

    The pairs that a cardholder makes are bounded by top; an edge stays if it is among the `neighbours` heaviest of
    either end.
    """
    mine = habitual(pairs, top).select("cardholder_id", "merchant_id")
    a, b = mine.withColumnRenamed("merchant_id", "merchant_a"), mine.withColumnRenamed("merchant_id", "merchant_b")
    both = a.join(b, "cardholder_id").where("merchant_a < merchant_b")
    edges = both.groupBy("merchant_a", "merchant_b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)
    rank = lambda mine, other: F.row_number().over(W.partitionBy(mine).orderBy(F.desc("weight"), other))
    ranked = edges.withColumn("_a", rank("merchant_a", "merchant_b")).withColumn("_b", rank("merchant_b", "merchant_a"))
    return ranked.where((F.col("_a") <= neighbours) | (F.col("_b") <= neighbours)).drop("_a", "_b")


def ppmi(pairs: DataFrame, shift: float = 1.0) -> DataFrame:
    """Positive pointwise mutual information of cardholder and merchant, weighted by purchases."""
    cards = pairs.groupBy("cardholder_id").agg(F.sum("n_txns").alias("n_c"))
    shops = pairs.groupBy("merchant_id").agg(F.sum("n_txns").alias("n_m"))
    total = pairs.agg(F.sum("n_txns").alias("n"))
    out = pairs.join(cards, "cardholder_id").join(shops, "merchant_id").crossJoin(F.broadcast(total))
    value = F.ln(F.col("n_txns") * F.col("n") / (F.col("n_c") * F.col("n_m"))) - F.ln(F.lit(float(shift)))
    return out.select("cardholder_id", "merchant_id", value.alias("ppmi")).where("ppmi > 0")


def modularity(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Modularity of (node_type, id, community) labels on the bipartite edges, as one row."""
    card = labels.where("node_type = 'c'").select(F.col("id").alias("cardholder_id"), F.col("community").alias("cc"))
    shop = labels.where("node_type = 'm'").select(F.col("id").alias("merchant_id"), F.col("community").alias("cm"))
    both = pairs.join(card, "cardholder_id").join(shop, "merchant_id")
    ends = both.select(F.explode(F.array("cc", "cm")).alias("community"), "n_txns").groupBy("community").agg(F.sum("n_txns").alias("d"))
    inside = both.agg(F.sum("n_txns").alias("m"), F.sum(F.when(F.col("cc") == F.col("cm"), F.col("n_txns")).otherwise(0)).alias("inside"))
    part = ends.crossJoin(F.broadcast(inside)).agg(F.first("inside").alias("inside"), F.first("m").alias("m"), F.sum(F.pow(F.col("d") / (2 * F.col("m")), F.lit(2.0))).alias("expected"))
    return part.select((F.col("inside") / F.col("m") - F.col("expected")).alias("modularity"))


def nmi(labelled: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information of two labellings of the same rows; 1 where both have one label."""
    joint = labelled.groupBy(a, b).agg(F.count("*").alias("n"))
    both = joint.select(
        "n", F.sum("n").over(W.partitionBy(a)).alias("na"), F.sum("n").over(W.partitionBy(b)).alias("nb"),
    ).crossJoin(F.broadcast(joint.agg(F.sum("n").alias("t"))))
    p, pa, pb = F.col("n") / F.col("t"), F.col("na") / F.col("t"), F.col("nb") / F.col("t")
    sums = both.agg(F.sum(p * F.ln(p / (pa * pb))).alias("mi"), (-F.sum(p * F.ln(pa))).alias("ha"), (-F.sum(p * F.ln(pb))).alias("hb"))
    flat = (F.col("ha") + F.col("hb")) < 1e-12
    return sums.select(F.when(flat, 1.0).otherwise(F.try_divide(2 * F.col("mi"), F.col("ha") + F.col("hb"))).alias("nmi"))


def top_share(values: DataFrame, column: str, fraction: float) -> DataFrame:
    """Share of the total in the ceil(fraction * n) largest values. Values are counted before they are ordered, in ranges."""
    counts = values.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col(column)).alias("sum"))
    took = running(counts, F.desc(column), upto=F.col("n")).withColumn("before", F.col("upto") - F.col("n")).crossJoin(F.broadcast(total))
    take = F.greatest(F.lit(0), F.least(F.col("n"), F.ceil(F.lit(fraction) * F.col("rows")) - F.col("before")))
    return took.agg((F.sum(take * F.col(column)) / F.first("sum")).alias("top_share"))


def dense_index(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """Distinct keys with their positions from 0 in ascending order."""
    return ranked(df.select(key).distinct(), key, name=name).withColumn(name, (F.col(name) - 1).cast("int"))


def shuffled_modularity(pairs: DataFrame, labels: DataFrame, times: int, seed: str = "null") -> DataFrame:
    """Modularity of `times` shuffles of the labels inside each side: what chance alone gives.

    A shuffle ranks the nodes of a side by a hash and hands them the labels in id order.
    """
    from ..functions.money import hashed_uniform

    out = None
    for k in range(times):
        u = hashed_uniform(F.col("id").cast("string"), F.col("node_type"), seed, str(k))
        side = W.partitionBy("node_type")
        to = labels.select("node_type", "id", F.row_number().over(side.orderBy(u, "id")).alias("r"))
        of = labels.select("node_type", "community", F.row_number().over(side.orderBy("id")).alias("r"))
        row = modularity(pairs, to.join(of, ["node_type", "r"]).select("node_type", "id", "community")).select(F.lit(k).alias("shuffle"), "modularity")
        out = row if out is None else out.union(row)
    return out
