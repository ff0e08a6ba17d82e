"""Card-network tables derived from the driver's star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fees


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def group_number(brand: str) -> Column:
    return F.substring(brand, 7, 10).cast("int") % 12


def by_number(number: Column, values) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), number + 1)


def rank_by_value(df: DataFrame, value: str, tie: str) -> DataFrame:
    """df with rank: 1 for the largest value, ties by the smaller tie column.

    Values are counted before they are ordered: the only ordering over everything is that of different values.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(value, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(value).orderBy(tie))
    return df.join(counts, value).withColumn("rank", F.col("_before") + inside).drop("_before")


def tiers(ranked: DataFrame, rows: int, shares=fees.TIERS) -> Column:
    """The tier of a rank among `rows` rows: tiers end at the rounded cumulative share."""
    out, total = None, 0.0
    for name, share in shares[:-1]:
        total += share
        upto = F.col("rank") <= int(round(total * rows + 1e-9))
        out = F.when(upto, name) if out is None else out.when(upto, name)
    return out.otherwise(shares[-1][0])


#: The product of a customer's segment, by its place here; of all other segments the last.
PRODUCT_OF = {"BUILDING": "credit_standard", "FURNITURE": "credit_premium", "MACHINERY": "commercial", None: "debit"}


def transactions(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """One purchase for each line item; dealt to `parts` partitions by merchant_id where parts are given."""
    # what lines are shuffled with is narrow (names follow from numbers after the last join), and customers meet the orders, of
    # which there are fewer than lines
    line = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor("l_extendedprice").cast("bigint").alias("amount_cop"), (F.col("l_discount") >= 0.1).alias("fraud_flag"),
        (F.col("l_linestatus") == "O").alias("_cnp"), ((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")).alias("tokenized"),
        (F.col("l_returnflag") == "R").alias("chargeback_flag"),
    )
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("txn_date"))
    number = F.lit(len(PRODUCT_OF) - 1)
    for k, name in reversed([*enumerate(PRODUCT_OF)][:-1]):
        number = F.when(F.col("c_mktsegment") == name, k).otherwise(number)
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", number.alias("_product"))
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # dealt lines meet suppliers alone, before their nations: so Spark sees how small they are, and doesn't shuffle lines for them;
    # others are shuffled by supplier, which spares groupings by shop a shuffle of their own
    at_home = lambda t: t.join(F.broadcast(nation), F.col("s_nationkey") == nation.n_nationkey)
    supplier = supplier if parts else at_home(supplier)
    joined = line.join(orders.join(customer, orders.o_custkey == customer.c_custkey), line.l_orderkey == orders.o_orderkey)
    joined = joined.drop("o_orderkey", "c_custkey").join(supplier, F.col("l_suppkey") == supplier.s_suppkey).drop("s_suppkey")
    if parts:
        joined, part = joined.repartition(parts, "l_partkey"), part.repartition(parts, "p_partkey")
    joined = joined.join(part, F.col("l_partkey") == part.p_partkey)
    joined = at_home(joined) if parts else joined
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "txn_date",
        F.col("o_custkey").alias("cardholder_id"), F.col("l_partkey").alias("merchant_id"), F.col("l_suppkey").alias("shop_id"),
        F.col("c_nationkey").cast("string").alias("issuer_id"), F.col("s_nationkey").cast("string").alias("acquirer_id"),
        by_number(F.col("_product"), PRODUCT_OF.values()).alias("product"), F.col("p_brand").alias("mcc"), by_number(group_number("p_brand"), fees.GROUPS).alias("mcc_group"),
        F.when(F.col("_cnp"), "cnp").otherwise("cp").alias("channel"), "tokenized",
        (F.col("n_regionkey") == 0).alias("cross_border"), (F.col("c_nationkey") == F.col("s_nationkey")).alias("on_us"),
        "amount_cop", "fraud_flag", "chargeback_flag",
    )


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice", "p_type")
    ranked = rank_by_value(part, "p_retailprice", "p_partkey")
    rows = part.count()
    number = group_number("p_brand")
    margin = by_number(number, [g[0] for g in fees.GROUPS.values()]) * (F.lit(0.75) + F.col("p_size") / F.lit(100.0))
    out = ranked.select(
        F.col("p_partkey").alias("merchant_id"), F.col("p_brand").alias("mcc"), by_number(number, fees.GROUPS).alias("mcc_group"),
        F.element_at(F.array(F.lit("cp"), F.lit("cnp"), F.lit("mixed")), F.col("p_size") % 3 + 1).alias("channel"),
        tiers(ranked, rows).alias("size_tier"), (F.col("p_retailprice") / 1000).alias("size_weight"),
        (F.col("p_partkey") % 25).cast("string").alias("acquirer_id"), F.col("p_size"),
        F.greatest(F.lit(0.005), F.least(F.lit(0.9), margin)).alias("sector_margin"),
    )
    icpp = F.col("size_tier").isin("large", "medium") & (F.col("p_size") % 2 == 0)
    return out.withColumn("pricing_model", F.when(icpp, "icpp").otherwise("blended")).drop("p_size")


def cardholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    balance = F.col("c_acctbal")
    product = (
        F.when(F.col("c_mktsegment") == "BUILDING", "credit_standard").when(F.col("c_mktsegment") == "FURNITURE", "credit_premium")
        .when(F.col("c_mktsegment") == "MACHINERY", "commercial").otherwise("debit")
    )
    return c.select(
        F.col("c_custkey").alias("cardholder_id"), F.col("c_nationkey").cast("string").alias("issuer_id"), product.alias("product"),
        F.when(balance < 2000, "low").when(balance < 7000, "mid").otherwise("high").alias("spend_segment"),
    )


def issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    kind = F.when(F.col("n_regionkey") % 2 == 0, "bank").otherwise("fintech")
    return n.select(
        F.col("n_nationkey").cast("string").alias("issuer_id"), kind.alias("issuer_type"), F.col("n_name").alias("country"),
        F.when(F.col("n_regionkey") % 2 == 0, F.col("n_regionkey").cast("string")).alias("bank_group"),
    )


def acquirers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    kind = F.when(F.col("n_regionkey") == 0, "foreign").when(F.col("n_nationkey") % 2 == 0, "bank").otherwise("aggregator")
    model = F.element_at(F.array(F.lit("blended"), F.lit("icpp"), F.lit("mixed")), F.col("n_nationkey") % 3 + 1)
    return n.select(
        F.col("n_nationkey").cast("string").alias("acquirer_id"), kind.alias("acquirer_type"), F.col("n_name").alias("country"),
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("string")).alias("bank_group"), model.alias("pricing_model"),
    )


def mccs(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = read(spark, sf_dir, "part").select(F.col("p_brand").alias("mcc")).distinct()
    named = brands.select("mcc", F.concat(F.lit("Code "), F.substring("mcc", 7, 10)).alias("mcc_name"), by_number(group_number("mcc"), fees.GROUPS).alias("mcc_group"))
    return named.join(F.broadcast(fees.groups(spark)), "mcc_group").select(
        "mcc", "mcc_name", "mcc_group", F.col("group_margin").alias("sector_margin"), "base_elasticity", "blended_mdr_rate"
    )
