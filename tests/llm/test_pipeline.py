"""run() against its stages' rules, one by one, on the smallest documents."""

import random
from collections import Counter

import corpus_pipeline
from cardloom.llm import common, decontaminate, jaccard_join, language_id, mixing, queries


def test_run(spark, small):
    docs = common.read(spark, small, "documents")
    schema = docs.schema
    item = common.read(spark, small, "benchmark")
    rejected = {r["doc_id"] for r in language_id.languages(docs).collect() if r["lang_pred"] == "und" or r["shared"] < 0.6}
    assert len(rejected) < 0.02 * docs.count()
    left = spark.createDataFrame([r for r in docs.collect() if r["doc_id"] not in rejected], schema)
    near = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(left).collect()}
    left = spark.createDataFrame([r for r in left.collect() if near[r["doc_id"]] == r["doc_id"]], schema)
    bad = {r[0] for r in decontaminate.contamination(left, item).where("contaminated").collect()}
    left = spark.createDataFrame([r for r in left.collect() if r["doc_id"] not in bad], schema)
    labels = {r["doc_id"]: "toxic" if r["toxic"] == 1 else "poor" if r["quality"] == 0 else "good" for r in common.read(spark, small, "labels").collect()}
    rates = mixing.mixing_report(left, spark.createDataFrame(list(labels.items()), "doc_id bigint, domain string"))
    draws = {r[0]: r[1] for r in left.select("doc_id", common.hash_share("doc_id", "mix")).collect()}
    want = Counter()
    for r in rates.collect():
        if times := int(r["rate"] + 1 - draws[r["doc_id"]] - 1e-12):
            want[r["doc_id"]] = times
    got = corpus_pipeline.run(spark, small).collect()
    assert Counter(r["doc_id"] for r in got) == want
    tokens = {r["doc_id"]: r["n_tokens"] for r in queries.op4_token_output(spark, small).collect()}
    assert all(r["n_tokens"] == tokens[r["doc_id"]] for r in got)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_stages(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontaminate", "mixing", "token_output"]
    docs = common.read(spark, small, "documents")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, small).columns == docs.columns, name


def test_stages_on_odd_tables(spark, small):
    docs = common.read(spark, small, "documents")
    odd = docs.limit(30).unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (901, "", "en", "s", 0), (902, "x " * 200_000, "en", "s", 400_000), (None, "the of and is", "en", "s", 13)], docs.schema))
    clashing = ("_draw", "_stays", "_gone", "_left", "node", "n", "name", "shard", "group", "fold", "bucket", "rate", "domain", "posterior", "key")
    odd = odd.selectExpr("*", *(f"{k} as {c}" for k, c in enumerate(clashing)))
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, odd, small)
        assert got.columns == odd.columns, name
        rows = got.collect()
        assert all(tuple(r)[5:] == tuple(range(len(clashing))) for r in rows) and rows, name
        assert stage(spark, odd.limit(0), small).count() == 0, name
    assert corpus_pipeline.STAGES[4][1](spark, odd, small).count() == odd.count()
    assert corpus_pipeline.STAGES[4][1](spark, odd.limit(0), small).count() == 0


def test_language_stage_rejects_what_was_never_learned(spark, small):
    docs = common.read(spark, small, "documents")
    draw = random.Random(3)
    junk = [(1_000_000 + k, "".join(draw.choice("bcdfghjklmnpqrstvwxz ") for _ in range(400)), None, "s", 400) for k in range(20)]
    junk += [(1_000_100, "kahden viikon kuluttua tulee kes\u00e4 ja aurinko paistaa", None, "s", 0), (1_000_101, "12 34 !", None, "s", 0), (1_000_102, None, None, "s", 0)]
    kept = {r[0] for r in language_id.keep_identified(docs.unionByName(spark.createDataFrame(junk, docs.schema))).select("doc_id").collect()}
    assert not kept & {r[0] for r in junk}
    assert len(kept) >= 0.98 * docs.count()
