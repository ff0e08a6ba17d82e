"""The entry without the corpus operators, positions in a total order, and the row contract."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cardloom.operators import segment
from cardloom.sources import contract, scratch

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["cardloom/llm"], ["cardloom/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_the_entry_without_the_corpus_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = tmp_path / "repo" / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
q = e.queries()
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("SAID", e.__file__, len([k for k in q if not k.startswith("op") and k != "pipeline"]), "pipeline" in q, set(e.oracle_sql()) <= set(q), q["p02_issuers"](spark, e.SMALL).count())
"""
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # else the original's modules are found for the deleted ones
    said = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path / "repo", env=clean, capture_output=True, text=True, check=True)
    file, n, pipeline, named, rows = said.stdout.partition("SAID")[2].split()
    assert file == str(tmp_path / "repo" / "__spark_entry__.py")
    assert int(n) > 120 and pipeline == "False" and named == "True" and int(rows) == 25


def test_positions(spark):
    df = spark.createDataFrame([(k, k * 7919 % 1000 // 3, f"x{k}") for k in range(1000)], "id bigint, v bigint, other string").repartition(7)
    got = {r["id"]: r["rank"] for r in scratch.ranked(df, "v", "id").collect()}
    want = {i: n for n, (_, i) in enumerate(sorted((k * 7919 % 1000 // 3, k) for k in range(1000)), 1)}
    assert got == want
    assert scratch.ranked(df.limit(0), "v", "id").count() == 0


def test_contract(spark):
    rows = spark.createDataFrame([("a", "bank", "large", "CO", None, 0.5), ("b", "shop", None, "CO", None, 0.5)], contract.ENTITIES["issuers"])
    contract.check_columns(rows, "issuers")
    assert contract.broken_rows(rows, "issuers").first().asDict() == {"issuer_id": 0, "issuer_type": 1, "size": 1, "country": 0, "market_share": 0}
    with pytest.raises(ValueError, match="market_share: string, not double"):
        contract.check_columns(rows.withColumn("market_share", rows.market_share.cast("string")), "issuers")
    with pytest.raises(ValueError, match="more: string, not expected"):
        contract.check_columns(rows.withColumn("more", rows.size), "issuers")


def test_sweep_and_marginal_information(spark):
    rows = [(k, float(k % 4) + (k * 37 % 11) / 100, [float(k % 4 == j) for j in range(4)], [float(k * 31 % 7)], "grocery", 1.0, 0.01) for k in range(400)]
    p = spark.createDataFrame(rows, "merchant_id bigint, relative_burden double, good array<double>, noise array<double>, mcc_group string, gdv_cop double, effective_interchange_rate double")
    labels = p.selectExpr("merchant_id", "cast(merchant_id % 4 as int) as segment")
    got = segment.sweep(p, {"own": {4: labels, 2: labels.selectExpr("merchant_id", "segment % 2 as segment")}, "one": {4: labels.selectExpr("merchant_id", "0 as segment")}})
    by = {r["method"]: r for r in got.collect()}
    assert by["own"]["k4"] > 0.99 > 0.5 > by["own"]["k2"] and by["one"]["k2"] is None and by["one"]["k4"] < 0.05
    found = {r["space"]: r for r in segment.marginal_information(p, {"good": p.selectExpr("merchant_id", "good as vector"), "noise": p.selectExpr("merchant_id", "noise as vector")}, "good").collect()}
    assert found["good"]["r2"] > 0.99 and found["good"]["gap"] == 0 and found["good"]["verdict"] == "adds nothing" and found["noise"]["verdict"] == "tells less"
    with pytest.raises(ValueError, match="labels no merchant"):
        segment.compare(p, {"none": labels.selectExpr("merchant_id", "-1 as segment")})


def test_compare_writes_what_it_reads(spark, monkeypatch):
    """Every method writes a copy of the merchants: of their profile only what the comparison reads."""
    rows = [(k, float(k % 4) + (k * 37 % 11) / 100, f"g{k % 3}", 1.0 + k, 0.01 * (k % 5), "junk") for k in range(200)]
    p = spark.createDataFrame(rows, "merchant_id bigint, relative_burden double, mcc_group string, gdv_cop double, effective_interchange_rate double, other string")
    written, keep = {}, segment.kept
    monkeypatch.setattr(segment, "kept", lambda df, name: written.setdefault(name, df.columns) and keep(df, name))
    got = segment.compare(p, {"own": p.selectExpr("merchant_id", "cast(merchant_id % 4 as int) as segment")}).first()
    assert got["coverage"] == 1 and got["merchants"] == 60 and got["r2"] > 0.99
    assert "labelled" in written and not any("other" in columns for columns in written.values())


def test_running_sums(spark):
    """Sums in order over ranges: a value that is null, values of several types, a table of one row and one without."""
    rows = [(k * 7919 % 1_000, None if k % 10 == 0 else k, float(k % 3)) for k in range(1_000)]
    df = spark.createDataFrame(rows, "at int, n bigint, x double").repartition(9)
    got = scratch.running(df, F.desc("at"), upto=F.col("n"), x_upto=F.col("x"), exact=F.col("n").cast("decimal(20,2)"))
    n, x = 0, 0.0
    for r in sorted(got.collect(), key=lambda r: -r["at"]):
        n, x = n + (r["n"] or 0), x + r["x"]
        assert (r["upto"], r["x_upto"], r["exact"]) == (n, x, n)
    assert set(got.columns) == {"at", "n", "x", "upto", "x_upto", "exact"}
    assert scratch.running(df.limit(1), F.asc("at"), s=F.col("x")).count() == 1
    assert scratch.running(df.where("false"), F.asc("at"), s=F.col("x")).count() == 0
