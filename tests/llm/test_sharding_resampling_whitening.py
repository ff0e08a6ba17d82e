"""op11 to op13 against brute force and SQL, on odd, hot and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.llm import common, numbering, queries, resampling, sharding, whitening

SCHEMA = "doc_id bigint, text string, shard string, slot string, n bigint, start string, position string, score string"


def odd_docs(spark, more=()):
    draw = random.Random(4)
    rows = [(0, None), (1, ""), (2, " \n"), (None, "a b c"), (None, None), (3, "Zwei ÄPFEL 7x7 é" * 20), (4, "x" * 100_000), (5, "word " * 60_000), (6, "same text"), (6, "same text"), (6, "other text"), (9, "𝔘nicode \u0000 and space")]
    rows += [(k, " ".join(draw.choice("alpha beta GAMMA delta eps".split()) for _ in range(draw.randint(0, 60)))) for k in range(20, 300)]
    return spark.createDataFrame([(i, t, "s", "t", 1, "u", "v", "w") for i, t in [*rows, *more]], SCHEMA).repartition(5)


def brute_shard(key, shards):
    name, best = "null" if key is None else str(key), None
    for j in range(shards):
        number = int(hashlib.sha256(f"{name}:{j // 8}".encode()).hexdigest()[8 * (j % 8) :][:8], 16)
        strength = -1 / math.log((number + 0.5) / 2**32)
        if best is None or strength > best[0]:
            best = strength, j
    return best[1]


def checked_shards(docs):
    got = sharding.report(docs).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = {}
    for r in got:
        assert r["law"] == "key" and r["shard"] == brute_shard(r["doc_id"], 40) and r["grown_shard"] == brute_shard(r["doc_id"], 41)
        assert r["grown_shard"] in (r["shard"], 40)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return got


def test_shards_of_odd_documents(spark):
    docs = odd_docs(spark)
    got = checked_shards(docs)
    assert sorted(got, key=str) == sorted(sharding.report(docs.repartition(2)).collect(), key=str)
    assert sharding.report(docs.limit(0)).collect() == []


def test_hot_records_leave_no_task_with_all(spark, monkeypatch):
    monkeypatch.setattr(numbering, "BLOCK", 16)
    checked_shards(odd_docs(spark, [(7, "hot")] * 300 + [(None, "hot")] * 33))


def test_weights_and_growth(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    placed = sharding.place(ids, weights=[1, 2, 5], grown_weight=2)
    n = {r[0]: r[1] / 20_000 for r in placed.groupBy("shard").count().collect()}
    assert [n[k] for k in range(3)] == pytest.approx([1 / 8, 2 / 8, 5 / 8], abs=0.015)
    moved = placed.where("shard <> grown_shard")
    assert moved.where("grown_shard <> 3").count() == 0 and moved.count() / 20_000 == pytest.approx(0.2, abs=0.015)
    again = sharding.place(ids, weights=[1, 2, 5, 2])
    assert placed.select("doc_id", F.col("grown_shard").alias("shard")).exceptAll(again.select("doc_id", "shard")).count() == 0
    with pytest.raises(ValueError, match="above zero"):
        sharding.place(ids, weights=[1, 0])


def test_written_shards(spark, tmp_path):
    docs = odd_docs(spark).drop("shard")
    back = sharding.write_shards(docs, str(tmp_path / "shards"))
    assert back.drop("shard").exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert all(r["shard"] == brute_shard(r["doc_id"], 40) for r in back.collect())


def brute_features(text, longest):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return words, [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    cut = [(i, *brute_features(t, longest)) for i, t in docs]
    of = lambda runs: Counter(zlib.crc32(x) % buckets for x in runs)
    s, t = of(x for _, _, f in cut for x in f), of(x for y in target for x in brute_features(y, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, words, f in cut:
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(enough):
        r.append(k + 1 if k < len(enough) * percent // 100 else None)
    return Counter(tuple([*r, None][:6]) for r in rows)


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (2, 100, 60), (3, 10_000, 100)])
def test_resampling(spark, monkeypatch, longest, buckets, percent):
    monkeypatch.setattr(resampling, "PART", 1000)
    monkeypatch.setattr(resampling, "FLUSH_WORDS", 640)
    monkeypatch.setattr(resampling, "DICTIONARY_BYTES", 500)
    docs = odd_docs(spark, [(7, "alpha beta gamma " * 20)] * 30)
    target = spark.createDataFrame([("beta GAMMA beta",), (None,), ("delta",)], "text string")
    got = resampling.resample(docs, target, longest=longest, buckets=buckets, percent=percent).collect()
    want = brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r[0] for r in target.collect()], longest, buckets, 20, percent)
    assert Counter(tuple(r) for r in got) == want
    for a, b in ((docs.limit(0), target), (docs, target.limit(0)), (docs.limit(0), target.limit(0))):
        assert resampling.resample(a, b).count() == a.count()


def test_of_one_word(spark):
    assert resampling.word_ids("Éa-B2 é".encode(), resampling.Dictionary()).tolist() == [0, 1, 2]
    assert resampling.word_ids(b" - ", resampling.Dictionary()).tolist() == []


@pytest.mark.parametrize("name", ["op11_sharding", "op12_resampling"])
def test_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    got = queries.QUERIES[name](spark, small)
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL[name]}) q").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def brute_whiten(vectors, most=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    off = n * x - sums
    v = np.array((off.T @ off), float) / float(n) ** 3
    values, turn = np.linalg.eigh(v)
    values, turn = values[::-1][:most], turn[:, ::-1][:, :most]
    return (off * off).sum(axis=1).tolist(), (off / n).astype(float) @ turn / np.sqrt(values), values / np.trace(v)


def close(rows, vectors, m, most=32):
    deviation, white, explained = brute_whiten([v for _, v in vectors], most)
    at = {i: k for k, (i, _) in enumerate(vectors)}
    got = np.zeros((len(vectors), m))
    for r in rows:
        assert r["n"] == len(vectors) and r["deviation"] == deviation[at[r["vec_id"]]] and r["identity_error"] < 1e-8
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        got[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    signs = np.sign((got * white[:, :m]).sum(axis=0))
    assert np.allclose(got, white[:, :m] * signs, atol=1e-7)
    assert len(rows) == len(vectors) * m


def test_whitening(spark, small):
    rows = common.read(spark, small, "embeddings").collect()
    close(queries.op13_whitening(spark, small).collect(), [(r["vec_id"], r["embedding"]) for r in rows], 32)


def planted(spark, dims, strong, rows=400, noise=0.01):
    draw = np.random.default_rng(7)
    v = draw.normal(size=(rows, strong)) @ (draw.normal(size=(strong, dims)) * 100) + draw.normal(size=(rows, dims)) * noise + 3
    return spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id bigint, embedding array<double>").repartition(3)


def test_range_finder_and_widening(spark):
    strong = planted(spark, 60, 4)
    rows = whitening.usable(strong, "vec_id", "embedding")
    found = whitening.fit(rows, 60, most=4, oversample=8, passes=6)
    assert not found.widened and found.residual <= whitening.TOLERANCE
    close(whitening.whiten(strong, most=4, passes=6).collect(), [(r[0], r[1]) for r in strong.collect()], 4, 4)
    even = planted(spark, 60, 4, noise=20.0)
    assert whitening.fit(whitening.usable(even, "vec_id", "embedding"), 60, most=20, oversample=2, passes=1).widened
    close(whitening.whiten(even, most=20, oversample=2, passes=1).collect(), [(r[0], r[1]) for r in even.collect()], 20, 20)


def test_odd_vectors(spark):
    good = planted(spark, 5, 3, 50, 5.0).collect()
    odd = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [1.0, float("nan"), 2.0, 3.0, 4.0]), (903, [1.0, float("inf"), 2.0, 3.0, 4.0]), (904, []), (905, [1.0]), (906, [1e300, 1.0, 1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in [*map(tuple, good), *odd]], "vec_id bigint, embedding array<double>, component int, v string, k string")
    close(whitening.whiten(table).collect(), [tuple(r) for r in good], 5)
    assert whitening.whiten(table.limit(0)).count() == 0 and whitening.whiten(table.where("vec_id = 900")).count() == 0
    assert whitening.whiten(table.where("vec_id = 3")).count() == 0
    same = spark.createDataFrame([(None, [1.0, 2.0])] * 3 + [(1, [4.0, 2.0])], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(same).collect()
    assert len(got) == 4 and {r["component"] for r in got} == {1} and sum(r["vec_id"] is None for r in got) == 3
    assert [r["whitened"] ** 2 for r in got if r["vec_id"] == 1] == [pytest.approx(3.0)]


def test_deviations_beyond_longs(spark):
    rows = spark.createDataFrame([(1, [4e12, 1.0]), (2, [-4e12, 2.0]), (3, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(rows).collect()}
    want = brute_whiten([r[1] for r in rows.collect()])[0]
    assert [got[k] for k in (1, 2, 3)] == want and max(want) > 1 << 63
    assert {r["vec_id"] for r in whitening.report(rows).where("deviation is null").collect()} == {1, 2}
