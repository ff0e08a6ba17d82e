"""Substitutes by pruned search against all pairs."""

from pathlib import Path

import numpy as np
import pytest

from cardloom.operators import links, nearest
from cardloom.sources import scratch

SCHEMA = "merchant_id bigint, vector array<double>"


def by_all_pairs(rows, top):
    """merchant -> substitutes in order, by all pairs; similarities on the same decimals."""
    rows = [(k, v) for k, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ids = np.array([k for k, _ in rows])
    x = np.array([v for _, v in rows], float)
    x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    s = np.round(x @ x.T, nearest.DIGITS)
    out = {}
    for i, k in enumerate(ids.tolist()):
        order = [j for j in np.lexsort((ids, -s[i])) if j != i][:top]
        out[k] = [(int(ids[j]), float(s[i, j])) for j in order]
    return out


def searched(spark, rows, top, block):
    found = nearest.search(spark.createDataFrame(rows, SCHEMA), top, block)
    out = {}
    for r in sorted(found.found.collect(), key=lambda r: (r["merchant_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["merchant_id"], [])) + 1
        out[r["merchant_id"]].append((r["substitute_id"], r["similarity"]))
    return out, found


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert [i for i, _ in got[k]] == [i for i, _ in want[k]]
        assert [s for _, s in got[k]] == pytest.approx([s for _, s in want[k]], abs=1e-11)


def test_planted_clusters_are_pruned(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(40, 16))
    rows = [(k, (centres[k % 40] + 0.05 * draw.normal(size=16)).tolist()) for k in range(2_000)]
    got, found = searched(spark, rows, 10, 64)
    same(got, by_all_pairs(rows, 10))
    assert found.classes == 2_000 and found.compared < 0.25 * 2_000**2


def test_flat_vectors_lose_nothing(spark):
    draw = np.random.default_rng(2)
    rows = [(k, draw.normal(size=12).tolist()) for k in range(400)]
    got, found = searched(spark, rows, 7, 32)
    same(got, by_all_pairs(rows, 7))
    assert found.compared <= 400**2


def test_copies_ties_and_odd_vectors(spark):
    """A third of all merchants share one vector; zero, null and broken vectors; opposite and proportional ones; extra columns."""
    draw = np.random.default_rng(3)
    one = [1.0, 2.0, -1.0, 0.5]
    rows = [(3 * k, one) for k in range(200)]
    rows += [(3 * k + 1, draw.integers(-1, 2, size=4).astype(float).tolist()) for k in range(200)]  # few directions, zero among them
    rows += [(3 * k + 2, (draw.normal(size=4)).tolist()) for k in range(200)]
    rows += [(1_000, [-x for x in one]), (1_001, [2 * x for x in one]), (1_002, None), (1_003, [1.0, None, 0.0, 0.0]), (1_004, [float("nan"), 1.0, 0.0, 0.0]), (1_005, [float("inf"), 1.0, 0.0, 0.0])]
    got, found = searched(spark, rows, 5, 16)
    same(got, by_all_pairs(rows, 5))
    assert not got.keys() & {1_002, 1_003, 1_004, 1_005}
    assert found.classes < 300


def test_too_few_and_empty(spark):
    for rows in ([], [(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (2, None)]):
        with pytest.raises(ValueError, match="substitutes"):
            links.substitutes(spark.createDataFrame(rows, SCHEMA), top=1)


def test_extra_columns_and_partitions(spark):
    draw = np.random.default_rng(4)
    df = spark.createDataFrame([(k, draw.normal(size=6).tolist(), k, "x") for k in range(150)], SCHEMA + ", block int, ids string")
    a = sorted(map(tuple, links.substitutes(df, 3, 20).collect()))
    assert a == sorted(map(tuple, links.substitutes(df.repartition(7), 3, 20).collect())) and len(a) == 450
    assert [r[:2] + r[3:] for r in a] == [r[:2] + r[3:] for r in sorted(map(tuple, links.substitutes(df, 3, 1_000).collect()))]


def test_bounds_hold():
    """No vector of a block is nearer than its block's bound."""
    draw = np.random.default_rng(5)
    x = nearest._unit(draw.normal(size=(300, 5)) * [5, 1, 1, 1, 0.2])
    centres = nearest._unit(draw.normal(size=(6, 5)))
    at = (x @ centres.T).argmax(axis=1)
    angle = 2 * np.arcsin(np.linalg.norm(x - centres[at], axis=1) / 2)
    number = np.arange(6)
    blocks = nearest.Blocks(np.vstack([centres, np.zeros(5)]), number, np.bincount(at, minlength=6), np.array([angle[at == b].max(initial=0) for b in number]))
    _, bound = nearest.bounds(x, blocks)
    for b in number[blocks.size > 0]:
        assert ((x @ x[at == b].T).max(axis=1) <= bound[:, b] + nearest.SLACK).all()


def test_vectors_are_not_shuffled_for_each_block(spark, monkeypatch):
    """Flat vectors ask nearly every block: those who ask meet blocks in a product, dealt once, on several sides as on one."""
    draw = np.random.default_rng(6)
    rows = [(k, draw.normal(size=12).tolist()) for k in range(500)]
    monkeypatch.setattr(nearest, "SIDE_BYTES", 20_000)
    met = []
    compare = nearest.compare
    monkeypatch.setattr(nearest, "compare", lambda *a: met.append(compare(*a)) or met[-1])
    got, found = searched(spark, rows, 7, 16)
    same(got, by_all_pairs(rows, 7))
    assert found.compared > 0.5 * 500**2 and len(met) == 2
    for df in met:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in text and text.count("Exchange") == 2 and "hashpartitioning" not in text


@pytest.mark.parametrize("block", [16, 1024])
def test_no_vectors_are_left_behind(spark, block):
    """What a search leaves in the shared folder are classes by merchant and lists by class, with few blocks and with many."""
    folder = Path(scratch.shared(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    draw = np.random.default_rng(3)
    rows = [(k, draw.standard_normal(8).tolist()) for k in range(300)]
    found = nearest.search(spark.createDataFrame(rows, "merchant_id bigint, vector array<double>"), 5, block).found
    assert sorted(p.name.partition("-")[0] for p in set(folder.iterdir()) - before) == ["lists", "mine"]
    assert found.count() == 1_500 and "vector" not in found._jdf.queryExecution().optimizedPlan().toString()
