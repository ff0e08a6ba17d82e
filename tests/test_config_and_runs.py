"""Configuration checks, graph convolutions, and whole runs on the smallest tables."""

import copy
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.operators import graphsage, marts
from cardloom.plans import runs
from cardloom.sources import bridge, config, fees


def change(path, value):
    data = copy.deepcopy(config.default())
    at = data
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return data


@pytest.mark.parametrize(
    ("path", "value", "message"),
    [
        (("surprise",), 1, "unknown keys"), (("groups", "fuel", "colour"), 1, "unknown keys"), (("groups", "fuel", "blended_mdr_rate"), 1.55, "no rate"),
        (("base_rates", "debit", "fuel"), 0.3, "no rate"), (("product_mix", "debit"), 0.9, "add up"), (("group_mix", "fuel"), -0.1, "add up"), (("fixed",), {"debit": 0.0}, "missing"),
        (("small_groups",), ["nowhere"], "not among"), (("small_groups",), ["fuel", "fuel"], "repeated"), (("weekday_profile",), [1.0] * 6, "seven"), (("segmentation_k",), (9, 4), "out of order"),
        (("groups", "fuel", "sector_margin"), 0.0, "out of range"), (("base_rates", "debit"), {"fuel": 0.01}, "missing"),
    ],
)
def test_bad_configurations(path, value, message):
    with pytest.raises(config.ConfigError, match=message):
        config.checked(change(path, value))


def whole():
    """A network in which everything is given."""
    data = config.default()
    groups, products = list(data["groups"]), list(data["base_rates"])
    data["groups"]["fuel"] |= {"online_share": 0.0}
    mix = dict.fromkeys(products, 1 / len(products))
    return data | {
        "mccs": {f"{5000 + k}": {"group": g, "merchant_share": 1 / len(groups), "channel_mix": {"cp": 0.5, "cnp": 0.2, "mixed": 0.3}} for k, g in enumerate(groups)},
        "weekday_profiles": {"flat": [1.0] * 7}, "group_weekdays": {"fuel": "flat"}, "cities": {"north": 300, "south": 100}, "other_cities_share": 0.2,
        "foreign_countries": {"US": 0.6, "ES": 0.4}, "foreign_groups": {"fuel": 1.0}, "product_mixes": {"all": mix},
        "issuers": {"a": {"market_share": 0.7, "product_mix": "all"}, "b": {"market_share": 0.3, "product_mix": "all"}},
        "acquirers": {"x": dict.fromkeys(data["tier_shares"], 0.4), "y": dict.fromkeys(data["tier_shares"], 0.6)},
        "spend_segments": {p: {"low": 0.5, "mid": 0.3, "high": 0.2} for p in products}, "lifestyles": {p: {"home": 0.4, "away": 0.6} for p in products},
        "lifestyle_boosts": {"away": {"fuel": 2.0}}, "price_overrides": [("debit", "fuel")],
    }


def test_derived_parameters():
    net = config.checked(whole())
    assert net.city_weights == pytest.approx({"north": 0.6, "south": 0.2, "other": 0.2}) and sum(net.city_weights.values()) == pytest.approx(1)
    assert net.lifestyle_names == ("home", "away") and net.k_values == list(range(4, 13)) and net.days == 731


@pytest.mark.parametrize(
    ("path", "value", "message"),
    [
        (("mccs", "5000", "group"), "nowhere", "not among"), (("mccs", "5000", "merchant_share"), 0.5, "add up"), (("mccs", "5000", "channel_mix"), {"cp": 1.0}, "missing"),
        (("mccs", "5000", "colour"), 1, "unknown keys"), (("weekday_profiles", "flat"), [1.0] * 6, "seven"), (("weekday_profiles", "flat"), [0.0] + [1.0] * 6, "seven"),
        (("group_weekdays", "fuel"), "steep", "not among"), (("cities", "north"), 0, "inhabitants"), (("other_cities_share",), 1.5, "inhabitants"),
        (("foreign_countries",), {"CO": 0.5, "US": 0.5}, "home country"), (("foreign_countries", "US"), 0.5, "add up"), (("foreign_groups",), {"nowhere": 1.0}, "not among"),
        (("issuers", "a", "market_share"), 0.6, "add up"), (("issuers", "a", "product_mix"), "none", "not among"), (("product_mixes", "all", "debit"), 0.9, "add up"),
        (("acquirers", "x", "micro"), 0.1, "micro"), (("acquirers", "x"), {"micro": 0.4}, "missing"), (("spend_segments", "debit", "low"), 0.9, "add up"),
        (("spend_segments",), {"debit": {"low": 1.0, "mid": 0.0, "high": 0.0}}, "missing"), (("lifestyles", "commercial"), {"home": 1.0}, "missing"),
        (("lifestyle_boosts", "sea"), {}, "not among"), (("lifestyle_boosts", "away", "fuel"), 0.0, "above 0"), (("lifestyle_boosts", "away", "nowhere"), 1.0, "not among"),
        (("issuer_costs",), {"debit": 1}, "missing"), (("fraud_rates", "cp"), 0.2, "no rate"), (("fraud_rates", "moon"), 0.0, "unknown"),
        (("price_overrides",), [("gold", "fuel")], "not among"), (("price_overrides",), [("debit", "nowhere")], "not among"), (("abandonment",), (0.1, 0.05, 0.6), "between"),
        (("end",), "2024-01-01", "out of order"),
    ],
)
def test_tables_that_disagree(path, value, message):
    data = copy.deepcopy(whole())
    at = data
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    with pytest.raises(config.ConfigError, match=message):
        config.checked(data)


@pytest.mark.parametrize(("share", "channel", "message"), [(0.4, "cp", "sells online"), (0.4, "cnp", "sells in person"), (0.0, "cp", None), (1.0, "cnp", None)])
def test_a_group_sells_where_it_has_merchants(share, channel, message):
    data = whole()
    data["groups"]["fuel"] |= {"online_share": share}
    code = next(k for k, m in data["mccs"].items() if m["group"] == "fuel")
    data["mccs"][code]["channel_mix"] = dict.fromkeys(config.MERCHANT_CHANNELS, 0.0) | {channel: 1.0}
    if message is None:
        assert config.checked(data).groups["fuel"].online_share == share
    else:
        with pytest.raises(config.ConfigError, match=message):
            config.checked(data)


def test_a_group_without_codes():
    data = whole()
    first = next(iter(data["mccs"]))
    data["mccs"][first]["group"] = "fuel" if data["mccs"][first]["group"] != "fuel" else "grocery"
    with pytest.raises(config.ConfigError, match="no code"):
        config.checked(data)


def test_load(tmp_path):
    (tmp_path / "more.json").write_text(json.dumps({"start": "2024-03-01"}))
    (tmp_path / "net.json").write_text(json.dumps({"include": ["more.json"], "end": "2024-03-31"}))
    net = config.load(tmp_path / "net.json")
    assert net.days == 31 and net.k_values[0] == 4 and len(net.groups) == 12
    with pytest.raises(AttributeError):
        net.start = "x"


def test_means():
    mean = graphsage.Mean(np.array([0, 1, 1]), np.array([0, 0, 2]), 2, 3)
    x, g = np.array([[1.0], [3.0]]), np.array([[1.0], [1.0], [1.0]])
    assert mean(x).ravel().tolist() == [2.0, 0.0, 3.0]
    assert mean.back(g).ravel().tolist() == [0.5, 1.5]


def test_runs(spark, small, tmp_path):
    tables = runs.build_warehouse(spark, small, str(tmp_path))
    fact = tables["fct_transactions"]
    assert fact.count() == 6_000 and tables["mart_pnl_by_actor"].count() > 0
    shops = bridge.merchants(spark, small)
    out = runs.run_segmentation(fact, shops, str(tmp_path / "s"), leaves=3, dims=4, ks=(4, 5), starts=2)
    assert out["segments"].columns == ["merchant_id", "mcc_group", "k_means", "graph", "hybrid", "communities", "supervised"] and out["comparison"].count() >= 5
    assert out["embeddings"].count() <= out["profile"].count() == out["segments"].count() and out["rules"].count() == out["segment_profiles"].count() <= 3
    assert {r["space"] for r in out["marginal"].collect()} == {"attributes", "graph", "hybrid"}
    vectors = bridge.read(spark, small, "embeddings").select((F.col("vec_id") + 1).alias("merchant_id"), F.col("embedding").cast("array<double>").alias("vector")).where("merchant_id <= 150")
    moved = runs.run_elasticity(fact, shops, vectors, str(tmp_path / "e"), cardholders=bridge.cardholders(spark, small))
    assert moved["leakage"].first()["leaked"] > 0 and moved["curve"].first()["abandonment"] == pytest.approx(fees.ABANDONMENT)
    assert moved["curve_groups"].count() == 12 and moved["acceptance"].count() == moved["response"].count() and moved["cardholder_response"].count() == bridge.cardholders(spark, small).count()


def test_link_prediction_run(spark, small, tmp_path):
    purchases = bridge.transactions(spark, small).withColumn("txn_month", F.trunc("txn_date", "MM"))
    groups = bridge.read(spark, small, "supplier").select(F.col("s_suppkey").alias("merchant_id"), bridge.by_number((F.col("s_suppkey") % 12).cast("int"), fees.GROUPS).alias("mcc_group"))
    out = runs.run_link_prediction(marts.graph_edges(purchases, "shop_id"), groups, bridge.cardholders(spark, small), str(tmp_path), dims=4, draws=50, epochs=4)
    found = {r["method"]: r["recall_at_k"] for r in out["link_prediction"].collect()}
    assert set(found) == {"random", "popularity", "group_popularity", "svd", "sage"} and all(0 <= x <= 1 for x in found.values())
    assert out["link_prediction_gaps"].count() == 5 and out["graphsage_losses"].where("is_best").count() == 1
