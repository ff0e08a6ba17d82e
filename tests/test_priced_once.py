"""Purchases that are priced as a query reads them, without a store."""

import pytest
from pyspark.sql import functions as F

from cardloom.operators import acceptance, waterfall
from cardloom.plans import registry
from cardloom.sources import bridge, fees, warehouse


@pytest.fixture
def unstored(spark, small, monkeypatch):
    """A folder that this application hasn't stored, and none may be."""
    monkeypatch.setattr(warehouse, "_seen", {})
    monkeypatch.setattr(warehouse.FactStore, "refresh", lambda *_, **__: pytest.fail("stored"))
    return small


def test_one_read_stores_nothing_and_gives_the_same_purchases(spark, unstored):
    got, want = warehouse.priced(spark, unstored), waterfall.fact(spark, unstored)
    assert set(got.columns) == set(want.columns) and got.count() == want.count() and got.select(want.columns).exceptAll(want).count() == 0
    plan = got.groupBy("mcc_group").agg(F.sum("amount_cop"))._jdf.queryExecution().executedPlan().toString()
    assert "pricing_model" not in plan and plan.count("Exchange hashpartitioning(l_partkey") == 1


@pytest.mark.parametrize("name", ["w01_share_of_group", "a01_pnl_by_actor", "j01_fct_waterfall", "p09_population", "m09_test_split", "m11_compare", "a13_merchant_profile", "m03_feature_space", "l05_shock_response", "e25_schema_rules"])
def test_queries_store_nothing(spark, unstored, name):
    assert registry.QUERIES[name](spark, unstored).count()


def test_a_profile_is_the_same_from_a_store_and_without_one(spark, small, monkeypatch):
    warehouse.fact(spark, small)
    of_store = registry.QUERIES["a13_merchant_profile"](spark, small)
    monkeypatch.setattr(warehouse, "_seen", {})
    alone = registry.QUERIES["a13_merchant_profile"](spark, small)
    assert alone.schema.simpleString() == of_store.schema.simpleString() and alone.exceptAll(of_store).count() == 0 and alone.count() == of_store.count()


def test_a_shock_reads_its_inputs_once(spark, unstored):
    found = registry.QUERIES["l05_shock_response"](spark, unstored)
    scans = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation [" in line and "l_extendedprice" in line]
    assert len(scans) == 1
    inputs = acceptance.curve_inputs(registry._profile(spark, unstored), fees.groups(spark))
    with pytest.raises(ValueError, match="above -1"):
        acceptance.shock_response(inputs, registry._intercepts(spark), 12.5, -1.0)
    assert bridge.read(spark, unstored, "part").count() >= found.count() > 0


def test_purchases_written_once_are_the_same(spark, unstored):
    purchases, fact = warehouse.written(spark, unstored)
    want, all_of = bridge.transactions(spark, unstored), waterfall.fact(spark, unstored)
    assert purchases.count() == want.count() and purchases.select(want.columns).exceptAll(want).count() == 0
    assert fact.count() == all_of.count() and fact.select(all_of.columns).exceptAll(all_of).count() == 0
