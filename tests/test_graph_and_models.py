"""Graph, segments, acceptance, links, generator and tables on toy data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.functions import money
from cardloom.operators import acceptance, communities, generate, graph, links, profile, segment, spectral
from cardloom.sources import bridge, fees, tables
from cardloom.streaming import edges as stream_edges


def toy(spark):
    draw = random.Random(5)
    rows = []
    for card in range(40):
        for shop in range(24):
            inside = (card < 20) == (shop < 12)
            if draw.random() < (0.75 if inside else 0.1):
                rows.append((card, shop, draw.randint(1, 5), 100))
    return spark.createDataFrame(rows, "cardholder_id bigint, merchant_id bigint, n_txns bigint, amount_cop bigint")


def test_planted_communities(spark):
    pairs = toy(spark)
    labels = dict(map(tuple, communities.leiden(graph.projection(pairs, top=8, least=3, neighbours=30)).collect()))
    of = [{labels[m] for m in labels if (m < 12) == low} for low in (True, False)]
    assert len(of[0]) == len(of[1]) == 1 and of[0] != of[1]
    vectors = spectral.embedding(graph.ppmi(pairs), dims=4).collect()
    assert np.allclose(np.linalg.norm([r["vector"] for r in vectors], axis=1), 1)
    card = pairs.select(F.lit("c").alias("node_type"), F.col("cardholder_id").alias("id"), (F.col("cardholder_id") < 20).cast("int").alias("community")).distinct()
    shop = pairs.select(F.lit("m").alias("node_type"), F.col("merchant_id").alias("id"), (F.col("merchant_id") < 12).cast("int").alias("community")).distinct()
    assert graph.modularity(pairs, card.union(shop)).first()[0] > 0.2


def test_order_of_rows_does_not_matter(spark):
    pairs = toy(spark)
    other = pairs.orderBy(F.desc("merchant_id")).repartition(3)
    assert sorted(graph.projection(pairs).collect()) == sorted(graph.projection(other).collect())


def test_eta_and_nmi(spark):
    df = spark.createDataFrame([(1.0, "a", "x", 1), (1.0, "a", "y", 2), (2.0, "b", "x", 1), (2.0, "b", "y", 2)], "v double, good string, bad string, n int")
    assert profile.eta_squared(df, "v", "good").first()[0] == pytest.approx(1)
    assert profile.eta_squared(df, "v", "bad").first()[0] == pytest.approx(0)
    assert profile.eta_squared(df.withColumn("v", F.lit(1.0)), "v", "bad").first()[0] is None
    assert graph.nmi(df, "good", "good").first()[0] == pytest.approx(1)
    assert graph.nmi(df, "good", "bad").first()[0] == pytest.approx(0)
    assert graph.nmi(df.withColumn("one", F.lit(1)), "one", "one").first()[0] == 1


def test_verdicts_of_spaces():
    assert segment.compare_verdict(0.5, 0.4) == "adds information" and segment.compare_verdict(0.1, 0.4) == "tells less"


def solved(rows, level):
    """Slope and intercepts by nested bisection over all rows (group, term, shift)."""
    data = {g: np.array([(t, s) for h, t, s in rows if h == g]).T for g in level}
    curve = lambda x: np.clip(1 / (1 + np.exp(-np.clip(x, -500, 500))), fees.LOWEST, fees.HIGHEST)

    def root(f, low, high):
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if f(middle) < 0 else (low, middle)
        return (low + high) / 2

    def intercepts(slope):
        return {g: root(lambda a: curve(a + slope * t + s).mean() - level[g], -60 - slope * t.max(), 60.0) for g, (t, s) in data.items()}  # noqa: B023

    def rise(slope):
        alpha = intercepts(slope)
        return sum((curve(alpha[g] + slope * (1 + fees.SHOCK) * t + s) - curve(alpha[g] + slope * t + s)).sum() for g, (t, s) in data.items()) / len(rows)

    slope = root(lambda b: rise(b) - fees.SEMI_ELASTICITY, 0.0, 200.0)
    return slope, intercepts(slope)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.001"])
def test_calibration_over_all_merchants(spark, folder, monkeypatch):
    from cardloom.plans import registry

    passes, tried = [], acceptance._tried
    monkeypatch.setattr(acceptance, "_tried", lambda inputs, points: passes.append(len(points)) or tried(inputs, points))
    inputs = registry._inputs(spark, folder)
    targets = acceptance.level_targets(inputs)
    curve = acceptance.calibrate(inputs, targets)
    slope, alpha = solved([tuple(r) for r in inputs.select("mcc_group", "term", "shift").collect()], {r["mcc_group"]: r["target"] for r in targets.collect()})
    assert curve.slope == pytest.approx(slope, abs=1e-8) and curve.intercepts == pytest.approx(alpha, abs=1e-8)
    assert len(passes) <= 12
    with pytest.raises(ValueError, match="shares of groups"):
        acceptance.calibrate(inputs, targets.withColumn("target", F.lit(1.5)))


def test_calibration_meets_its_anchors(spark):
    draw = random.Random(2)
    rows = [(k, g, draw.uniform(0.1, 0.4), draw.uniform(0, 0.3), 1000.0, draw.uniform(0.1, 0.4)) for k, g in enumerate(list(fees.GROUPS) * 50)]
    inputs = spark.createDataFrame(rows, "merchant_id bigint, mcc_group string, term double, shift double, gdv_cop double, relative_burden double")
    curve = acceptance.calibrate(inputs, acceptance.level_targets(inputs))
    assert curve.achieved == pytest.approx(fees.ABANDONMENT, abs=1e-6)
    assert curve.semi_elasticity == pytest.approx(fees.SEMI_ELASTICITY, abs=1e-6)
    alpha = spark.createDataFrame([(g, float(a)) for g, a in curve.intercepts.items()], "mcc_group string, intercept double")
    shocked = acceptance.shock_response(inputs, alpha, curve.slope, 0.1)
    assert shocked.where("delta < 0").count() == 0
    with pytest.raises(ValueError, match="above -1"):
        acceptance.abandonment(inputs, alpha, 1.0, -1.0)


def test_redistribution_conserves(spark):
    near = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5), (1, 4, -0.2), (2, 1, 0.7), (2, 3, 0.7), (2, 4, 0.1)], "merchant_id bigint, substitute_id bigint, similarity double")
    lost = spark.createDataFrame([(1, 1000.0), (2, 250.0), (5, 80.0)], "merchant_id bigint, lost_cop double")
    moved = links.redistribute(lost, near).agg(F.sum("moved_cop")).first()[0]
    out = links.leakage(lost, near).first()
    assert moved == pytest.approx(out["moved"], rel=1e-9)
    assert out["moved"] + out["leaked"] == pytest.approx(1330, rel=1e-9) and out["leaked"] >= 80
    with pytest.raises(ValueError, match="substitutes"):
        links.substitutes(spark.createDataFrame([(1, [1.0, 0.0])], "merchant_id bigint, vector array<double>"))


def test_substitutes_over_blocks(spark):
    draw = np.random.default_rng(3)
    v = draw.normal(size=(60, 8))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "merchant_id bigint, vector array<double>")
    a = sorted((r[0], r[1], r[3]) for r in links.substitutes(df, top=5, block=7).select("merchant_id", "substitute_id", "similarity", "rank").collect())
    b = sorted((r[0], r[1], r[3]) for r in links.substitutes(df, top=5, block=100).select("merchant_id", "substitute_id", "similarity", "rank").collect())
    assert a == b


def test_verdicts():
    assert [links.verdict(0, 1, 2), links.verdict(0, -2, -1), links.verdict(0, -1, 1)] == ["beats", "falls short", "cannot be told apart"]


def test_generator(spark):
    cards, shops = generate.cardholders(spark, 2_000, "a"), generate.merchants(spark, 300, "a")
    got = generate.purchases(spark, 4_000, cards, shops, "a")
    assert got.count() == 4_000 and got.select("txn_id").distinct().count() == 4_000
    again = generate.purchases(spark, 4_000, cards.repartition(5), shops, "a")
    key = ["txn_id", "cardholder_id", "merchant_id", "txn_date", "amount_cop", "fraud_flag"]
    assert sorted(got.select(*key).collect()) == sorted(again.select(*key).collect())
    mix = {r[0]: r[1] / 2_000 for r in cards.groupBy("product").count().collect()}
    for product, share in generate.PRODUCT_MIX.items():
        assert mix[product] == pytest.approx(share, abs=0.04)
    more = generate.cardholders(spark, 3_000, "a").where("cardholder_id <= 2000")
    assert sorted(more.collect()) == sorted(cards.collect())


def test_ranks_and_quantiles(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 9.0), (4, 1.0)], "k int, v double")
    assert sorted((r["k"], r["rank"]) for r in bridge.rank_by_value(df, "v", "k").collect()) == [(1, 2), (2, 3), (3, 1), (4, 4)]
    assert graph.top_share(df, "v", 0.5).first()[0] == pytest.approx(14 / 20)


def test_tables(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))
    manifest = tables.write_tables({"t": df}, str(tmp_path), 7, {"a": 1})
    assert manifest["rows"] == {"t": 5}
    assert tables.read_optional(spark, str(tmp_path), "none") is None
    assert tables.read_optional(spark, str(tmp_path), "t", ("nope",)) is None
    assert tables.read_optional(spark, str(tmp_path), "t", ("id",)).count() == 5
    back = tables.narrow(tables.wide(df, "id", "v", 2), "id", "v")
    assert sorted(back.collect()) == sorted(df.collect())
    with pytest.raises(ValueError, match="table name"):
        tables.read_table(spark, "x; drop table y")
    with pytest.raises(ValueError, match="missing required"):
        tables.require(df, ("id", "w"))


def test_logistic_ends(spark):
    got = [r[0] for r in spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double").select(money.logistic(F.col("x"))).collect()]
    assert got == [0.0, 0.5, 1.0]


def test_stream_of_edges(spark, tmp_path):
    t = bridge.transactions(spark, "/root/testdata/sf0.001").select("txn_date", "cardholder_id", "merchant_id", "amount_cop")
    t.repartition(3).write.parquet(f"{tmp_path}/in")
    q = stream_edges.monthly_edges(spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("edges").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("edges").collect()) == sorted(stream_edges.monthly_edges(t).collect())


def test_queries_without_sql_run_on_all_pairs(spark, monkeypatch):
    from cardloom.operators import graphsage
    from cardloom.plans import registry

    folder, seen = "/root/testdata/sf0.1", []

    def train(pairs, cards, merchants):
        seen.append(pairs.count())
        return graphsage.Fit(cards, merchants, [])

    monkeypatch.setattr(graphsage, "train", train)
    registry.QUERIES["l12_graph_convolutions"](spark, folder)
    assert seen == [registry._split(spark, folder)["train"].count()] and seen[0] > 50_000
    split, caps = links.temporal_split, []
    monkeypatch.setattr(links, "temporal_split", lambda edges, **kwargs: caps.append(kwargs) or split(edges, **kwargs))
    registry.QUERIES["l20_bootstrap_gap"](spark, folder)
    assert caps == [{}]
