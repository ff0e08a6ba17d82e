"""Where spend would go: link prediction, its metrics, substitutes, and redistribution of lost volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money
from ..sources import fees
from ..sources.scratch import kept
from . import nearest
from .graph import collapse


def temporal_split(edges: DataFrame, holdout: int = 3, most_candidates: int = 3_000, most_cards: int = 2_000, seed: str = "split") -> dict[str, DataFrame]:
    """train pairs, candidates (the most bought in training), new pairs of the held-out months, and their cardholders.

    Cardholders are capped, as a sample of evaluation, by a hash of their id.
    """
    last = edges.agg(F.add_months(F.max("txn_month"), -(holdout - 1)).alias("_from"))
    marked = edges.crossJoin(F.broadcast(last)).withColumn("held", F.col("txn_month") >= F.col("_from")).drop("_from")
    train = collapse(marked.where(~F.col("held")))
    held = collapse(marked.where("held"))
    sales = train.groupBy("merchant_id").agg(F.sum("n_txns").alias("purchases"))
    candidates = sales.orderBy(F.desc("purchases"), "merchant_id").limit(most_candidates)
    new = held.join(train, ["cardholder_id", "merchant_id"], "left_anti").join(candidates.select("merchant_id"), "merchant_id", "left_semi")
    known = new.join(train.select("cardholder_id").distinct(), "cardholder_id", "left_semi")
    cards = known.select("cardholder_id").distinct().orderBy(money.hashed_uniform(F.col("cardholder_id").cast("string"), seed), "cardholder_id").limit(most_cards)
    positives = known.join(cards, "cardholder_id", "left_semi").select("cardholder_id", "merchant_id")
    return {"train": train, "candidates": candidates, "positives": positives, "cardholders": cards}


def popularity(split: dict[str, DataFrame]) -> DataFrame:
    return split["candidates"].select("merchant_id", F.log1p("purchases").alias("score"))


def random_scores(split: dict[str, DataFrame], seed: str = "random") -> DataFrame:
    """A uniform score for each evaluated cardholder and candidate."""
    grid = split["cardholders"].crossJoin(F.broadcast(split["candidates"].select("merchant_id")))
    key = [F.col("cardholder_id").cast("string"), F.col("merchant_id").cast("string")]
    return grid.select("cardholder_id", "merchant_id", money.hashed_uniform(*key, seed).alias("score"))


def group_popularity(split: dict[str, DataFrame], merchants: DataFrame) -> DataFrame:
    """A cardholder's share of a group times the merchant's share of its group's purchases."""
    catalogue = merchants.select("merchant_id", "mcc_group")
    within = split["candidates"].join(catalogue, "merchant_id").withColumn("within", F.col("purchases") / F.sum("purchases").over(W.partitionBy("mcc_group")))
    mine = split["train"].join(split["cardholders"], "cardholder_id", "left_semi").join(catalogue, "merchant_id")
    mine = mine.groupBy("cardholder_id", "mcc_group").agg(F.sum("n_txns").alias("n"))
    mine = mine.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("cardholder_id")))
    return mine.join(within.select("merchant_id", "mcc_group", "within"), "mcc_group").select("cardholder_id", "merchant_id", (F.col("share") * F.col("within")).alias("score"))


def cardholder_vectors(pairs: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """Purchase-weighted mean of the merchants' vectors of each cardholder."""
    joined = pairs.join(vectors, "merchant_id")
    sums = [F.sum(F.col("n_txns") * F.col("vector")[k]).alias(f"s{k}") for k in range(dims)]
    out = joined.groupBy("cardholder_id").agg(F.sum("n_txns").alias("n"), *sums)
    return out.select("cardholder_id", F.array(*(F.col(f"s{k}") / F.greatest(F.col("n"), F.lit(1)) for k in range(dims))).alias("vector"))


def embedding_scores(split: dict[str, DataFrame], vectors: DataFrame, dims: int) -> DataFrame:
    """Cosine of each evaluated cardholder's profile and each candidate's vector; candidates without a vector raise."""
    if split["candidates"].join(vectors, "merchant_id", "left_anti").limit(1).count():
        raise ValueError("a candidate has no vector")
    cards = cardholder_vectors(split["train"].join(split["cardholders"], "cardholder_id", "left_semi"), vectors, dims)
    shops = split["candidates"].join(vectors, "merchant_id").select("merchant_id", money.unit("vector").alias("b"))
    grid = cards.select("cardholder_id", money.unit("vector").alias("a")).join(F.broadcast(shops))  # candidates are capped
    return grid.select("cardholder_id", "merchant_id", money.dot(F.col("a"), F.col("b")).alias("score"))


def restrict(split: dict[str, DataFrame], scorable: DataFrame) -> dict[str, DataFrame]:
    """The split with only scorable candidates; positives and cardholders that lose all of theirs go."""
    candidates = split["candidates"].join(scorable.select("merchant_id").distinct(), "merchant_id", "left_semi")
    positives = split["positives"].join(candidates.select("merchant_id"), "merchant_id", "left_semi")
    return split | {"candidates": candidates, "positives": positives, "cardholders": positives.select("cardholder_id").distinct()}


def vector_scores(split: dict[str, DataFrame], cards: DataFrame, merchants: DataFrame) -> DataFrame:
    """The product of the vectors (id, vector) of each evaluated cardholder and candidate; both are capped by the split."""
    mine = split["cardholders"].join(cards.withColumnRenamed("id", "cardholder_id"), "cardholder_id").withColumnRenamed("vector", "u")
    theirs = split["candidates"].select("merchant_id").join(merchants.withColumnRenamed("id", "merchant_id"), "merchant_id").withColumnRenamed("vector", "v")
    return mine.join(F.broadcast(theirs)).select("cardholder_id", "merchant_id", money.dot(F.col("u"), F.col("v")).alias("score"))  # candidates are capped


def top_k(scores: DataFrame, split: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """The k best new candidates of each cardholder, ties by the smaller merchant; pairs of training don't compete."""
    fresh = scores.join(split["train"].select("cardholder_id", "merchant_id"), ["cardholder_id", "merchant_id"], "left_anti")
    rank = F.row_number().over(W.partitionBy("cardholder_id").orderBy(F.desc("score"), "merchant_id"))
    return fresh.withColumn("rank", rank).where(F.col("rank") <= k)


def ranking_metrics(scores: DataFrame, split: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """recall, hit rate, reciprocal rank of the first hit and coverage, as one row."""
    top = top_k(scores, split, k)
    hits = top.join(split["positives"].withColumn("hit", F.lit(1)), ["cardholder_id", "merchant_id"], "left")
    found = hits.groupBy("cardholder_id").agg(F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    wanted = split["positives"].groupBy("cardholder_id").agg(F.count("*").alias("wanted"))
    each = wanted.join(found, "cardholder_id", "left").fillna(0, ["hits"])
    out = each.agg(
        F.avg(F.col("hits") / F.col("wanted")).alias("recall_at_k"), F.avg((F.col("hits") > 0).cast("double")).alias("hit_rate_at_k"),
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.count("*").alias("cardholders"), F.sum("wanted").alias("positives"),
    )
    seen = top.agg(F.countDistinct("merchant_id").alias("_seen")).crossJoin(split["candidates"].agg(F.count("*").alias("_all")))
    return out.crossJoin(seen.select((F.col("_seen") / F.col("_all")).alias("coverage")))  # one row each


def better_source(preferred: DataFrame, other: DataFrame, names: tuple[str, str] = ("sage", "svd")) -> DataFrame:
    """source, recall_at_k: of two rows of ranking_metrics, the preferred one unless the other recalls more."""
    both = preferred.select(F.col("recall_at_k").alias("a")).crossJoin(other.select(F.col("recall_at_k").alias("b")))  # one row each
    keeps = F.col("a") >= F.col("b")
    return both.select(F.when(keeps, names[0]).otherwise(names[1]).alias("source"), F.greatest("a", "b").alias("recall_at_k"))


def recall_by_card(scores: DataFrame, split: dict[str, DataFrame], k: int = 10) -> DataFrame:
    hits = top_k(scores, split, k).join(split["positives"], ["cardholder_id", "merchant_id"], "left_semi").groupBy("cardholder_id").agg(F.count("*").alias("hits"))
    wanted = split["positives"].groupBy("cardholder_id").agg(F.count("*").alias("wanted"))
    return wanted.join(hits, "cardholder_id", "left").select("cardholder_id", (F.coalesce("hits", F.lit(0)) / F.col("wanted")).alias("recall"))


#: P(Poisson(1) <= 0, 1, ..., 6); a weight of 8 and more would be one in a million.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
#: Cardholders whose draws are summed before anything is shuffled by draw.
TOGETHER = 256


def bootstrap_gap(a: DataFrame, b: DataFrame, draws: int = 2_000, seed: str = "bootstrap") -> DataFrame:
    """Mean difference of two recalls and its 95 % interval over resampled cardholders.

    A resample weighs every cardholder by a Poisson(1) number that a hash of draw and id gives: the same cardholders weigh
    the same for every pair of methods. Cardholders are gathered by TOGETHER, whose sums of all draws are made in place;
    what is shuffled by draw is a row for each of those groups.
    """
    both = kept(a.join(b.withColumnRenamed("recall", "other"), "cardholder_id").select("cardholder_id", (F.col("recall") - F.col("other")).alias("gap")), "gaps")
    groups = max(1, -(-both.count() // TOGETHER))
    one = F.struct(F.col("cardholder_id").cast("string").alias("id"), "gap")
    some = both.groupBy(F.pmod(F.xxhash64("cardholder_id"), F.lit(groups))).agg(F.collect_list(one).alias("cards"))

    def weight(card, draw):
        u = money.hashed_uniform(card["id"], draw.cast("string"), F.lit(seed))
        return sum(F.when(u >= c, 1).otherwise(0) for c in POISSON)

    def summed(draw):
        weighed = F.transform("cards", lambda card: F.struct(card["gap"].alias("gap"), weight(card, draw).alias("w")))
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("w"))
        return F.aggregate(weighed, zero, lambda sums, x: F.struct((sums["s"] + x["gap"] * x["w"]).alias("s"), (sums["w"] + x["w"]).alias("w")))

    drawn = some.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(draws)), summed)).alias("draw", "sums"))
    means = drawn.groupBy("draw").agg(F.try_divide(F.sum("sums.s"), F.sum("sums.w")).alias("mean"))
    ends = means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    return both.agg(F.avg("gap").alias("gap")).crossJoin(ends)  # one row each


def verdict(gap: float, low: float, high: float) -> str:
    return "beats" if low > 0 else "falls short" if high < 0 else "cannot be told apart"


def substitutes(vectors: DataFrame, top: int = 10, block: int = nearest.BLOCK) -> DataFrame:
    """merchant_id, substitute_id, similarity, rank: the `top` nearest others by cosine, ties by the smaller id."""
    return nearest.search(vectors, top, block).found


def redistribute(lost: DataFrame, near: DataFrame, leak: float = fees.LEAKAGE) -> DataFrame:
    """(merchant_id, substitute_id, moved_cop): lost volume less the leak, by similarity above the least of the merchant's."""
    w = W.partitionBy("merchant_id")
    weighted = near.withColumn("_w", F.col("similarity") - F.min("similarity").over(w) + 1e-6)
    shared = weighted.withColumn("_s", F.col("_w") / F.sum("_w").over(w))
    return shared.join(lost, "merchant_id").select("merchant_id", "substitute_id", (F.col("lost_cop") * (1 - leak) * F.col("_s")).alias("moved_cop"))


def leakage(lost: DataFrame, near: DataFrame, leak: float = fees.LEAKAGE) -> DataFrame:
    """lost, placed, moved and leaked volume: the leak of what can be placed, and all that can't."""
    can = lost.join(near.select("merchant_id").distinct(), "merchant_id", "left_semi").agg(F.coalesce(F.sum("lost_cop"), F.lit(0.0)).alias("placed"))
    all_ = lost.agg(F.coalesce(F.sum("lost_cop"), F.lit(0.0)).alias("lost"))
    return all_.crossJoin(can).select("lost", "placed", (F.col("placed") * (1 - leak)).alias("moved"), (F.col("lost") - F.col("placed") * (1 - leak)).alias("leaked"))
