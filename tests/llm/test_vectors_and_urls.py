import math

import duckdb
import numpy as np
import pytest

from cardloom.llm import common, queries, url_filter, vector_dedup


def brute(rows):
    good = {}
    for k, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links, group = {k: 0 for k in range(len(rows))}, list(range(len(rows)))
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.98:
                links[a] += 1
                links[b] += 1
                old, new = group[b], group[a]
                group = [new if g == old else g for g in group]
    low = {}
    for k, g in enumerate(group):
        low[g] = min(rows[k][0], low.get(g, rows[k][0]))
    return sorted((rows[k][0], links[k], low[g], rows[k][0] == low[g]) for k, g in enumerate(group))


@pytest.mark.parametrize("block", [1_024, 16])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    draw = np.random.default_rng(9)
    base = draw.normal(size=(6, 8))
    rows = [(k, (base[k % 6] * (1 + k % 3) + draw.normal(size=8) * 0.05).tolist(), k % 2) for k in range(90)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], None), (203, None, 0), (204, [0.0] * 8, 0), (205, [None, *[1.0] * 7], 0), (206, [math.nan] * 8, 0), (207, [math.inf] * 8, 0), (208, [], 0), (209, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = vector_dedup.near_vectors(df)
    assert sorted(tuple(r)[:4] for r in got.collect()) == brute(rows)


def test_what_the_graph_misses_is_found_by_comparing_all(spark, monkeypatch):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(5, 8))
    rows = [(k, (base[k % 5] + draw.normal(size=8) * 0.03).tolist(), k % 2) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    searched = []

    def links(nodes, counts, overlap, exact=False, real=vector_dedup._links):
        searched.append((overlap, exact))
        out = real(nodes, counts, overlap, exact)
        return out if exact else out.limit(0)

    monkeypatch.setattr(vector_dedup, "_links", links)
    monkeypatch.setattr(vector_dedup, "BLOCK", 32)
    monkeypatch.setattr(vector_dedup, "AGAINST", 16)
    monkeypatch.setattr(vector_dedup, "ASKED", 1)
    got = vector_dedup.near_vectors(df).collect()
    assert [e for _, e in searched] == [False, False, False, True]
    assert sorted(tuple(r)[:4] for r in got) == brute(rows) and {r["audit_recall"] for r in got} == {1.0}


def test_vectors_of_the_driver_and_none(spark, small):
    rows = [tuple(r) for r in common.read(spark, small, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert sorted(tuple(r)[:4] for r in queries.op5_vector_dedup(spark, small).collect()) == brute(rows)
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert vector_dedup.near_vectors(none).count() == 0


def test_graph_reaches_a_hot_group():
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(size=64) + draw.normal(size=(300, 64)) * 0.07, draw.normal(size=(200, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = vector_dedup.range_search(x, x, vector_dedup.build_graph(x), np.arange(len(x)))
    true = x @ x.T >= vector_dedup.RADIUS
    assert (found & true).sum() >= 0.99 * true.sum() and not (found & ~true & ~np.eye(len(x), dtype=bool)).any()


URLS = [
    (1, "https://WWW.Example.com/en/1?x#y"), (2, "http://a.example.com/en/2"), (3, "http://a.example.com/fr/3"), (4, "http://x.net/es/4"), (5, "http://net/fr/5"), (6, "http://notnet/fr/6"),
    (7, None), (8, "no scheme"), (9, "ftp://h.org"), (10, "://"), (11, "http://example.com?en/"), (12, "http://b.org/de/7"), (12, "http://b.org/de/7"), (None, "http://b.org/de/8"), (13, "http://x.com/a://b/c"),
]
LABELS = [(7, 0, 0), (7, 1, 0), (8, 1, 1), (3, 1, 0), (None, 0, 1), (99, None, None)]


def test_urls(spark):
    pages = spark.createDataFrame(URLS, "page_id bigint, url string").selectExpr("*", "'x' as host", "1 as n")
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    got = url_filter.url_verdicts(pages, labels).collect()
    by = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in got}
    assert len(got) == len(URLS)
    assert by[1] == ("www.example.com", "/en/1", "www.example.com/en/") and by[2][2] == "example.com/en/" and by[3][2] == "com/"
    assert by[4][2] == "net/es/" and by[5][2] == "net/fr/" and by[6][2] is None
    assert by[7] == by[8] == by[10] == ("", "", None) and by[9] == ("h.org", "", None) and by[11] == ("example.com", "", None)
    assert by[13] == ("x.com", "/a://b/c", "com/")
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", URLS)
    con.execute("create table labels(doc_id bigint, quality int, toxic int)")
    con.executemany("insert into labels values (?, ?, ?)", LABELS)
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(map(tuple, got)) == text(con.execute(url_filter.sql()).fetchall())
    assert url_filter.url_verdicts(pages.limit(0), labels).count() == 0
    assert url_filter.url_verdicts(pages, labels.limit(0)).where("verdict is null").count() == 0


def test_bad_hosts_are_blocked(spark):
    pages = spark.createDataFrame([(k, f"http://{'bad' if k % 2 else 'good'}.example.org/en/{k}") for k in range(80)], "page_id bigint, url string")
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(60)], "doc_id bigint, quality int, toxic int")
    got = {(r["host"], r["verdict"]) for r in url_filter.url_verdicts(pages, labels).collect()}
    assert got == {("bad.example.org", "block"), ("good.example.org", "allow")}


def test_registered_domains_and_the_limit(spark):
    urls = [(k, f"http://{h}/en/{k}") for k, h in enumerate(["a.b.co.uk", "b.co.uk", "co.uk", "x.y.z.org", "localhost", ""])]
    page = url_filter.host_and_path(spark.createDataFrame(urls, "page_id bigint, url string"))
    assert [(r["domain"], r["suffix"]) for r in page.orderBy("page_id").collect()] == [
        ("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("z.org", "org"), ("localhost", "localhost"), ("", ""),
    ]
    # two of twelve hosts are bad; the others differ by chance
    pages = [(k, f"http://h{k % 12}.example.org/de/{k}") for k in range(1_200)]
    labels = [(k, 0 if k * 7 % 10 < (9 if k % 12 in (3, 8) else 2) else 1, 0) for k in range(1_200)]
    pages, labels = spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r["host"]: r["verdict"] for r in url_filter.url_verdicts(pages, labels).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"h3.example.org", "h8.example.org"} and len(got) == 12


def test_the_oracle_blocks_the_same_planted_hosts(spark, small):
    pages, labels = common.read(spark, small, "pages"), common.read(spark, small, "labels")
    bad = pages.selectExpr("page_id + 1000000 as page_id", "concat('http://', if(page_id % 3 = 0, 'spam.bad.co.uk', 'ok.fine.org'), '/en/', page_id + 1000000) as url")
    pages = pages.select("page_id", "url").union(bad)
    labels = labels.select("doc_id", "quality", "toxic").union(bad.selectExpr("page_id as doc_id", "if(page_id % 3 = 1 and page_id % 10 < 9, 0, 1) as quality", "0 as toxic"))
    con = duckdb.connect()
    for name, df in (("pages", pages), ("labels", labels)):
        con.register(name, df.toPandas())
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    got = url_filter.url_verdicts(pages, labels).collect()
    assert text(map(tuple, got)) == text(con.execute(url_filter.sql()).fetchall())
    assert any(r["rule"] is None and r["verdict"] == "block" for r in got)
