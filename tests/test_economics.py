"""Hand-computed purchases, conservation over segmentations, and the guards."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cardloom.operators import expectations, pnl, shapley, waterfall
from cardloom.sources import bridge, fees

GRID = "product string, mcc_group string, channel string, region string, rate double, fixed_cop double, small_ticket_max_cop double, small_ticket_rate double, small_ticket_fixed_cop double"


@pytest.fixture(scope="module")
def prices(spark):
    cells = [("credit_standard", "grocery", 0.017, 0.0), ("debit", "grocery", 0.004, 0.0), ("credit_premium", "travel", 0.025, 150.0), ("credit_premium", "retail", 0.023, 150.0)]
    rows = [
        (p, g, c, r, rate + 0.003 * (c == "cnp") + 0.008 * (r == "cross_border"), fixed, *((20_000.0, 0.002, 0.0) if p == "debit" and r == "domestic" else (None, None, None)))
        for p, g, rate, fixed in cells for c in fees.CHANNELS for r in fees.REGIONS
    ]
    network = spark.createDataFrame([(0.0005, 40.0, 0.008, 0.0013, 80.0, 0.0045)], fees.network_fees(spark).schema)
    groups = fees.groups(spark).withColumn("blended_mdr_rate", F.lit(0.025))
    terms = spark.createDataFrame([("A", 0.0035, 200.0, 0.015)], "acquirer_id string, icpp_markup_rate double, icpp_markup_fixed_cop double, blended_cross_border_rate double")
    return waterfall.Prices(spark.createDataFrame(rows, GRID), groups, fees.issuer_costs(spark), network, terms)


def purchase(spark, product="credit_standard", group="grocery", channel="cp", amount=100_000, abroad=False, fraud=False, charged=False, model="blended"):
    names = "merchant_id int, issuer_id string, acquirer_id string, product string, mcc_group string, channel string, cross_border boolean, amount_cop bigint, fraud_flag boolean, chargeback_flag boolean, pricing_model string"
    return spark.createDataFrame([(1, "I", "A", product, group, channel, abroad, amount, fraud, charged, model)], names)


@pytest.mark.parametrize(
    ("options", "want"),
    [
        ({}, {"mdr_cop": 2500, "interchange_cop": 1700, "issuer_network_fee_cop": 90, "acquirer_network_fee_cop": 210, "network_revenue_cop": 300, "network_assessment_cop": 180, "network_authorization_cop": 120, "network_cross_border_cop": 0, "issuer_gross_cop": 1610, "acquirer_gross_cop": 590, "issuer_contribution_cop": 560, "acquirer_contribution_cop": 390, "merchant_cost_cop": 2500}),
        ({"model": "icpp"}, {"mdr_cop": 2460, "acquirer_gross_cop": 550, "issuer_gross_cop": 1610, "network_revenue_cop": 300}),
        ({"product": "debit", "amount": 15_000}, {"interchange_cop": 30, "issuer_gross_cop": -17.5, "acquirer_gross_cop": 245.5, "network_revenue_cop": 147}),
        ({"product": "credit_premium", "group": "travel", "channel": "cnp", "amount": 1_000_000, "abroad": True}, {"interchange_cop": 36150, "issuer_network_fee_cop": 8540, "acquirer_network_fee_cop": 5880, "network_cross_border_cop": 12500, "mdr_cop": 40000, "acquirer_gross_cop": -2030}),
        ({"product": "credit_premium", "group": "retail", "channel": "cnp", "amount": 200_000, "fraud": True}, {"fraud_loss_cop": 200000, "merchant_cost_cop": 5000}),
        ({"product": "credit_premium", "group": "retail", "channel": "cnp", "amount": 200_000, "fraud": True, "charged": True}, {"fraud_loss_cop": 0, "issuer_contribution_cop": 1610, "chargeback_cop": 200000, "merchant_cost_cop": 205000}),
    ],
)
def test_hand_cases(spark, prices, options, want):
    row = waterfall.price(purchase(spark, **options), prices).first()
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=1e-6), name


def test_repricing_is_idempotent(spark, prices):
    once = waterfall.price(purchase(spark), prices)
    assert waterfall.price(once.drop("region"), prices).select(*waterfall.MONEY).first() == once.select(*waterfall.MONEY).first()


def test_a_gap_raises(spark, prices):
    with pytest.raises(PySparkException, match="interchange price"):
        waterfall.price(purchase(spark, group="fuel"), prices).select("interchange_cop").collect()
    with pytest.raises(PySparkException, match="MDR"):
        waterfall.price(purchase(spark, model=None), prices).select("mdr_cop").collect()
    with pytest.raises(ValueError, match="missing required columns"):
        waterfall.price(purchase(spark).drop("channel"), prices)
    with pytest.raises(ValueError, match="pricing_model"):
        waterfall.price(purchase(spark).drop("pricing_model"), prices)
    assert waterfall.gaps(purchase(spark, group="fuel"), prices).first()["cell_missing"] == 1


def test_grid(spark):
    cells = {r[:4]: tuple(r) for r in fees.grid(spark).collect()}
    assert len(cells) == 192
    assert cells["debit", "grocery", "cp", "domestic"][4:] == (0.004, 0.0, 20_000.0, 0.002, 0.0, date(2024, 1, 1), None)
    assert cells["credit_premium", "travel", "cnp", "cross_border"][4:6] == (0.036, 150.0)
    key = ("debit", "fuel", "cp", "domestic")
    assert fees.cell(fees.grid(spark, overrides=[(*key, 0.5, 1.0)]), *key)[4:6] == (0.5, 1.0)
    assert fees.cell(fees.grid(spark, channels={"cp": (0.001, 7.0), "cnp": (0.0, 0.0)}), *key)[4:6] == (0.004, 7.0)
    for low in ((-0.5, 1.0), (0.5, -1.0)):
        with pytest.raises(Exception, match="below 0"):
            fees.grid(spark, overrides=[(*key, *low)]).collect()


def test_one_cell(spark):
    table = fees.grid(spark)
    assert fees.cell(table, "credit_premium", "travel", "cnp", "cross_border")["rate"] == 0.036
    with pytest.raises(KeyError):
        fees.cell(table, "debit", "nothing", "cp", "domestic")
    with pytest.raises(ValueError, match="more than one"):
        fees.cell(table.union(table), "debit", "fuel", "cp", "domestic")


@pytest.mark.parametrize("part", ["grid", "groups", "costs", "network", "terms"])
def test_a_price_that_stands_twice_raises(spark, prices, part):
    twice = replace(prices, **{part: getattr(prices, part).union(getattr(prices, part))})
    with pytest.raises(Exception, match="more than one"):
        waterfall.price(purchase(spark), twice).collect()


def test_a_merchant_that_stands_twice_raises(spark, prices):
    shops = spark.createDataFrame([(1, "blended"), (1, "icpp")], "merchant_id bigint, pricing_model string")
    with pytest.raises(Exception, match="more than one"):
        waterfall.price(purchase(spark).drop("pricing_model"), prices, shops).collect()


@pytest.mark.parametrize("keys", [[], ["product"], ["mcc_group"], ["channel"], ["region"], ["pricing_model"], ["issuer_id"], ["acquirer_id"], ["product", "mcc_group"], ["channel", "region"], ["txn_month"]])
def test_every_segmentation_conserves(spark, small, keys):
    for r in pnl.pnl_by(waterfall.fact(spark, small), keys).collect():
        assert r["issuer_gross_cop"] + r["network_revenue_cop"] + r["acquirer_gross_cop"] == pytest.approx(r["mdr_cop"], rel=1e-9)


def test_a_corrupted_fact_is_found(spark, small):
    fact = waterfall.fact(spark, small).withColumn("mdr_cop", F.col("mdr_cop") + F.when(F.col("l_orderkey") == 1, 5.0).otherwise(0.0))
    found = {r["check_name"]: r["violations"] for r in expectations.conservation(fact, bridge.transactions(spark, small), bridge.merchants(spark, small)).collect()}
    assert found["rows"] > 0
    with pytest.raises(ValueError, match="rules violated"):
        expectations.validate({"x": fact.limit(1)})


def bridge_rows(spark, rows):
    return spark.createDataFrame([(p, "retail", "cp", x, v, r) for p, x, v, r in rows], "product string, mcc_group string, channel string, cross_border boolean, amount_cop double, network_revenue_cop double")


BASE = [("debit", False, 600.0, 1.2), ("credit", False, 300.0, 1.5), ("credit", True, 100.0, 2.0)]


@pytest.mark.parametrize(
    ("new", "only"),
    [
        ([(p, x, v * 1.1, r * 1.1) for p, x, v, r in BASE], "volume"),
        ([(p, x, v, r * 1.2) for p, x, v, r in BASE], "rate"),
        ([("debit", False, 500.0, 1.0), ("credit", False, 400.0, 2.0), BASE[2]], "mix"),
    ],
)
def test_pure_drivers(spark, new, only):
    out = {r["step"]: r["value_cop"] for r in shapley.bridge(bridge_rows(spark, BASE), bridge_rows(spark, new)).collect()}
    assert sum(out[d] for d in shapley.DRIVERS) == pytest.approx(out["new"] - out["base"], abs=1e-9)
    for d in shapley.DRIVERS:
        assert (abs(out[d]) > 1e-6) == (d == only)


def test_a_new_segment(spark):
    new = [*BASE, ("prepaid", True, 50.0, 1.3)]
    out = {r["step"]: r["value_cop"] for r in shapley.bridge(bridge_rows(spark, BASE), bridge_rows(spark, new)).collect()}
    assert out["base"] == pytest.approx(4.7) and out["new"] == pytest.approx(6.0)
    assert sum(out[d] for d in shapley.DRIVERS) == pytest.approx(1.3)
