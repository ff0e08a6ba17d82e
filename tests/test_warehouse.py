"""The stored fact: what is priced again, what is read, and that it is what pricing everything gives."""

import datetime

import pytest
from pyspark.sql import functions as F

from cardloom.operators import profile, waterfall
from cardloom.sources import bridge, warehouse


@pytest.fixture
def parts(spark, small):
    purchases, shops = bridge.transactions(spark, small), bridge.merchants(spark, small)
    prices = waterfall.Prices.configured(spark, bridge.acquirers(spark, small))
    return purchases, shops, {n: getattr(prices, n) for n in prices.__dataclass_fields__}


def refreshed(store, purchases, shops, prices, **more):
    return store.refresh(purchases, shops, prices, lambda p: waterfall.price(p, waterfall.Prices(**prices), shops), **more)


def same(store, purchases, shops, prices):
    want = waterfall.price(purchases, waterfall.Prices(**prices), shops).withColumn("txn_month", F.trunc("txn_date", "MM"))
    got = store.read().select(want.columns)
    return got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_only_changed_months_are_priced(spark, small, parts, tmp_path):
    purchases, shops, prices = parts
    store = warehouse.FactStore(spark, f"file://{tmp_path}/store")
    months = refreshed(store, purchases, shops, prices, stamped="a")
    assert len(months) > 70 and same(store, *parts)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "store/fct").rglob("*.parquet")}
    assert refreshed(store, purchases, shops, prices, stamped="a") == [] and refreshed(store, purchases.repartition(3), shops, prices, stamped="b") == []
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "store/fct").rglob("*.parquet")} == files
    at, gone = datetime.date(1995, 3, 1), datetime.date(1996, 7, 1)
    later = purchases.withColumn("amount_cop", F.col("amount_cop") + F.when(warehouse.month() == F.lit(at), 5).otherwise(0)).where(warehouse.month() != F.lit(gone))
    assert refreshed(store, later, shops, prices) == [at] and same(store, later, shops, prices)
    kept = {p for p in (tmp_path / "store/fct").rglob("*.parquet")} & set(files)
    assert kept and not any(f"txn_month={m}" in str(p) for p in kept for m in (at, gone))
    other = shops.withColumn("pricing_model", F.when(F.col("merchant_id") == 7, "icpp").otherwise(F.col("pricing_model")))
    of = {r[0] for r in later.where("merchant_id = 7").select(warehouse.month()).distinct().collect()}
    changed = refreshed(store, later, other, prices)
    assert set(changed) in (of, set()) and same(store, later, other, prices)
    dearer = {**prices, "network": prices["network"].withColumn("issuer_assessment_rate", F.lit(0.01))}
    assert len(refreshed(store, later, other, dearer)) == len(months) - 1 and same(store, later, other, dearer)
    spark.sql(f"drop table {store.table}")  # as in a session that didn't write it
    assert refreshed(store, later, other, dearer) == [] and same(store, later, other, dearer)


def test_models_are_worked_out_once(spark, parts, tmp_path):
    """Several slices meet the same written models: what ranks all merchants doesn't run for each."""
    purchases, shops, prices = parts
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    models = shops.select("merchant_id", "pricing_model")
    store = warehouse.FactStore(spark, f"file://{tmp_path}/store", slice_rows=2_500)
    store.refresh(purchases, models.mapInArrow(counted, models.schema), prices, lambda p: waterfall.price(p, waterfall.Prices(**prices), shops), rows=purchases.count(), apart="l_orderkey")
    assert seen.value == shops.count() and same(store, *parts)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_months_are_pruned_and_merchants_not_shuffled(spark, small):
    fact = warehouse.fact(spark, small)
    one = fact.where(F.col("txn_month") == F.lit(datetime.date(1995, 3, 1)))
    scan = one._jdf.queryExecution().optimizedPlan().toString()
    assert len(one.inputFiles()) < 20 < len(fact.inputFiles()) and "1995-03-01" in scan
    shops = spark.table(warehouse.store_of(spark, small).table).select("merchant_id").distinct().withColumn("x", F.lit(1))
    by = fact.join(shops.hint("merge"), "merchant_id").groupBy("merchant_id").agg(F.sum("mdr_cop"))
    assert "Exchange" not in plan(by) and "Bucketed: true" in plan(by)
    assert warehouse.fact(spark, small).count() == bridge.transactions(spark, small).count()


def test_an_empty_folder_of_purchases(spark, parts, tmp_path):
    purchases, shops, prices = parts
    store = warehouse.FactStore(spark, f"file://{tmp_path}/none")
    assert refreshed(store, purchases.limit(0), shops, prices) == [] and store.read().count() == 0
    assert len(refreshed(store, purchases, shops, prices)) > 70 and same(store, *parts)


def test_rates_are_stored_and_amounts_follow(spark, small):
    fact = warehouse.fact(spark, small)
    stored = spark.table(warehouse.store_of(spark, small).table)
    assert not set(stored.columns) & set(waterfall.MONEY) and set(waterfall.MONEY) <= set(fact.columns)
    assert all(stored.select(c).distinct().count() <= 192 for c in waterfall.RATES)
    want = waterfall.fact(spark, small)
    assert fact.count() == want.count() and fact.select(want.columns).exceptAll(want).count() == 0


def test_slices_make_the_same_store_and_reach_both_sides_of_the_join(spark, small, parts, tmp_path):
    purchases, shops, prices = parts
    store = warehouse.FactStore(spark, f"file://{tmp_path}/slices", slice_rows=4_000)
    deal = lambda n: bridge.transactions(spark, small, n)
    assert len(refreshed(store, deal, shops, prices, apart="l_orderkey")) > 70 and same(store, *parts)
    slices = [s.select("l_orderkey", "cardholder_id") for s in store._slices(deal(8), purchases.count(), "l_orderkey")]
    assert len(slices) == -(-purchases.count() // 4_000) and sum(s.count() for s in slices) == purchases.count()
    filters = slices[0]._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"xxhash64({key}" in filters for key in ("l_orderkey", "o_orderkey"))
    at = datetime.date(1995, 3, 1)
    later = lambda n: deal(n).withColumn("amount_cop", F.col("amount_cop") + F.when(warehouse.month() == F.lit(at), 5).otherwise(0))
    assert refreshed(store, later, shops, prices, apart="l_orderkey") == [at] and same(store, later(1), shops, prices)
    assert refreshed(store, later, shops, prices, apart="l_orderkey") == []


def test_suppliers_and_models_dont_shuffle_lines_again(spark, small, parts):
    _, shops, prices = parts
    text = plan(waterfall.rated(waterfall.modelled(bridge.transactions(spark, small, 8), shops, 8), waterfall.Prices(**prices)))
    assert "hashpartitioning(l_suppkey" not in text and text.count("Exchange hashpartitioning(l_partkey") == 1
    assert text.count("Exchange hashpartitioning(merchant_id") <= 2  # the models': counted, then dealt


def test_profiles_count_cardholders_apart_from_the_sums_and_in_slices(spark, small, monkeypatch):
    """Pairs of merchant and cardholder carry no sums, which spilled; other sums don't look for pairs; slices give the same numbers."""
    fact, shops = warehouse.fact(spark, small), bridge.merchants(spark, small)
    found = profile.merchant_profile(fact, shops)
    keys = [line for line in plan(found).splitlines() if "HashAggregate(keys=[merchant_id" in line and "cardholder_id" in line.split("functions")[0]]
    assert keys and all("functions=[]" in line for line in keys) and "cardholder_id" not in plan(found.select("merchant_id", "mdr_cop"))
    want = fact.groupBy("merchant_id").agg(F.countDistinct("cardholder_id").alias("n_customers"))
    monkeypatch.setattr(profile, "SLICE_ROWS", 2_000)
    sliced = profile.merchant_profile(fact, shops, fact.count())
    assert plan(sliced).count("pmod(xxhash64(merchant_id") >= 3 and sliced.dtypes == found.dtypes
    assert sliced.select("merchant_id", "n_customers").exceptAll(want).count() == 0 and sliced.count() == want.count()
    odd = fact.withColumn("cardholder_id", F.when(F.col("merchant_id") % 2 == 0, F.col("cardholder_id")))
    assert profile.merchant_profile(odd, shops, fact.count()).where("(merchant_id % 2 = 1) <> (n_customers = 0)").count() == 0


def test_copies_are_not_stored_and_files_are_zstd(spark, small):
    fact = warehouse.fact(spark, small)
    stored = spark.table(warehouse.store_of(spark, small).table)
    assert not set(stored.columns) & set(warehouse.COPIES) and all("zstd" in f for f in stored.inputFiles())
    purchases = bridge.transactions(spark, small)
    assert fact.columns[:5] == ["merchant_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    assert fact.select(purchases.columns).exceptAll(purchases).count() == 0 and fact.count() == purchases.count()


def test_a_slice_is_sorted_in_memory():
    """Rows of a bucket and slice, at some 400 bytes each, stay under the 540 MB that a task of a 3,000 MB executor of two cores has."""
    for rows in (10_000_000, 36_000_000, 216_000_000, 1_000_000_000):
        buckets = min(warehouse.MOST, max(warehouse.FEWEST, 1 << (rows // warehouse.BUCKET_ROWS).bit_length()))
        assert min(rows, warehouse.SLICE_ROWS) / buckets * 400 <= 540e6
