"""Whole runs: the warehouse, the segmentation and the elasticity of a data folder, written as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import acceptance, communities, expectations, graph, graphsage, kmeans, links, marts, profile, segment, spectral, trees, waterfall
from ..sources import bridge, fees
from ..sources.tables import read_raw


def _write(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    out = {}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        out[name] = read_raw(table.sparkSession, folder, name)
    return out


def build_warehouse(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, DataFrame]:
    """Fact, dimensions and marts; the fact is written once and read by all marts. Raises if a rule is violated."""
    shops, cards, issuers = bridge.merchants(spark, sf_dir), bridge.cardholders(spark, sf_dir), bridge.issuers(spark, sf_dir)
    purchases = bridge.transactions(spark, sf_dir)
    fact = _write({"fct_transactions": waterfall.fact(spark, sf_dir)}, folder)["fct_transactions"]
    out = _write({
        "dim_issuer": issuers, "dim_acquirer": bridge.acquirers(spark, sf_dir), "dim_cardholder": marts.dim_cardholder(cards, issuers),
        "dim_merchant": marts.dim_merchant(shops, bridge.mccs(spark, sf_dir)), "dim_date": marts.dim_date(purchases),
        "mart_effective_interchange": marts.effective_interchange(fact), "mart_pnl_by_actor": marts.pnl_by_actor(fact),
        "mart_merchant_relative_burden": marts.merchant_burden(fact, shops), "mart_graph_edges": marts.graph_edges(fact),
    }, folder)
    checks = expectations.conservation(fact, purchases, shops).where("violations > 0")
    expectations.validate({"conservation": checks, "merchant unique": expectations.unique(shops, "merchant_id")})
    return {"fct_transactions": fact, **out}


def run_segmentation(fact: DataFrame, merchants: DataFrame, folder: str, least: int = 10, leaves: int = 8, dims: int = spectral.DIMS, ks=kmeans.KS, starts: int = kmeans.STARTS) -> dict[str, DataFrame]:
    """Segments of merchants with enough purchases by clusters of attributes, of graph vectors and of both, by communities and by trees.

    Tables: embeddings, segments side by side, their comparison, profiles and rules of the tree's segments, and what each
    feature space tells out of sample.
    """
    p = profile.population(profile.merchant_profile(fact, merchants), least)
    if p.limit(2).count() < 2:
        raise ValueError("too few merchants to segment")
    p = _write({"profile": p}, folder)["profile"]
    pairs = graph.collapse(marts.graph_edges(fact)).join(p.select("merchant_id"), "merchant_id", "left_semi")
    tables = {"profile": p} | _write({"embeddings": spectral.embedding(graph.ppmi(pairs), dims=dims), "attributes": segment.feature_space(p)}, folder)
    attributes, vectors = tables["attributes"], tables["embeddings"]
    both = segment.combine(attributes.withColumnRenamed("vector", "a").join(vectors.withColumnRenamed("vector", "b"), "merchant_id"), "a", "b")
    spaces = {"attributes": attributes, "graph": vectors, "hybrid": _write({"hybrid": both}, folder)["hybrid"]}
    train = segment.split_test(p).where(~F.col("test")).select("merchant_id", F.col("relative_burden").alias("y"))
    tree = trees.grow(attributes.join(train, "merchant_id"), leaves)
    clusters = {name: kmeans.k_means(space, ks, starts) for name, space in spaces.items()}
    methods = {
        "mcc_group": segment.group_segments(p), "k_means": clusters["attributes"][0], "graph": clusters["graph"][0], "hybrid": clusters["hybrid"][0],
        "communities": communities.merchant_communities(graph.projection(pairs), p), "supervised": trees.segments(attributes, tree),
    }
    tables |= _write({"segments": segment.side_by_side(p, methods)}, folder)
    methods = {name: tables["segments"].select("merchant_id", F.col(name).alias("segment")) for name in methods}
    told = {name: labels for name, labels in methods.items() if labels.where(F.col("segment") != segment.UNASSIGNED).limit(1).count()}
    scores = {("k_means" if name == "attributes" else name): max(s.values()) for name, (_, s) in clusters.items()}
    names = [f"log_{c.removesuffix('_cop')}" for c in segment.NUMBERS] + ["cnp_share", "cross_border_share", *(f"share_{x}" for x in fees.PRODUCTS)] + [f"mcc_group={g}" for g in fees.GROUPS]
    rules = p.sparkSession.createDataFrame(list(enumerate(trees.rules(tree, names))), "segment int, rule string")
    return tables | _write({
        "comparison": segment.compare(p, told, silhouettes=scores), "segment_profiles": profile.segment_profile(p.join(methods["supervised"], "merchant_id"), "segment"),
        "rules": rules, "marginal": segment.marginal_information(p, spaces, "attributes", leaves),
    }, folder)


def run_link_prediction(edges: DataFrame, groups: DataFrame, cardholders: DataFrame, folder: str, dims: int = spectral.DIMS, draws: int = 2_000, **training) -> dict[str, DataFrame]:
    """How well chance, popularity, popularity by group, singular vectors and graph convolutions find new pairs.

    Tables: comparison (a row a method), gaps of the methods' recalls with their intervals and verdicts, and the
    convolutions' losses by epoch. edges: by month; groups: merchant_id, mcc_group.
    """
    spark = edges.sparkSession
    split = {name: part for name, part in links.temporal_split(edges).items()}
    split = _write({f"split_{name}": part for name, part in split.items()}, folder)
    split = {name.removeprefix("split_"): part for name, part in split.items()}
    pairs = split["train"]
    known = cardholders.select("cardholder_id", "spend_segment", "product")
    cards = graphsage.activity_features(pairs, "cardholder_id", known, {"spend_segment": ("low", "mid", "high"), "product": fees.PRODUCTS})
    fit = graphsage.train(pairs, cards, graphsage.activity_features(pairs, "merchant_id"), **training)
    vectors = _write({"vectors": spectral.embedding(graph.ppmi(pairs), dims=dims)}, folder)["vectors"]
    wide = len((vectors.first() or {"vector": []})["vector"])
    scores = {
        "random": links.random_scores(split), "popularity": split["cardholders"].crossJoin(F.broadcast(links.popularity(split))), "group_popularity": links.group_popularity(split, groups),
        "svd": links.embedding_scores(split, vectors, wide), "sage": links.vector_scores(split, fit.cards, fit.merchants),
    }
    scores = _write({f"scores_{name}": s.select("cardholder_id", "merchant_id", "score") for name, s in scores.items()}, folder)
    rows = None
    for name, s in scores.items():
        row = links.ranking_metrics(s, split).select(F.lit(name.removeprefix("scores_")).alias("method"), "*")
        rows = row if rows is None else rows.union(row)
    recalls = _write({f"recalls_{name}": links.recall_by_card(scores[f"scores_{name}"], split) for name in ("group_popularity", "popularity", "random", "svd", "sage")}, folder)
    gaps = []
    for a, b in (("sage", "svd"), ("sage", "group_popularity"), ("svd", "group_popularity"), ("group_popularity", "popularity"), ("popularity", "random")):
        g = links.bootstrap_gap(recalls[f"recalls_{a}"], recalls[f"recalls_{b}"], draws).first()
        gaps.append((a, b, g["gap"], g["low"], g["high"], links.verdict(g["gap"] or 0.0, g["low"] or 0.0, g["high"] or 0.0)))
    best = 1 + min(range(len(fit.validation)), key=fit.validation.__getitem__)
    losses = [(k + 1, a, b, k + 1 == best) for k, (a, b) in enumerate(zip(fit.losses, fit.validation, strict=True))]
    return {"sage_vectors": fit.merchants, "svd_vectors": vectors} | _write({
        "link_prediction": rows, "link_prediction_gaps": spark.createDataFrame(gaps, "method string, other string, gap double, low double, high double, verdict string"),
        "graphsage_losses": spark.createDataFrame(losses, "epoch int, loss double, validation_loss double, is_best boolean"),
    }, folder)


def run_elasticity(fact: DataFrame, merchants: DataFrame, vectors: DataFrame, folder: str, shock: float = fees.SHOCK, cardholders: DataFrame | None = None, rewards_change: float = -0.01) -> dict[str, DataFrame]:
    """Calibrated acceptance, response to a shock, substitutes and where the lost volume goes; checks conservation.

    With cardholders also their response to a change of rewards. Link prediction is a run of its own.
    """
    spark = fact.sparkSession
    inputs = _write({"inputs": acceptance.curve_inputs(profile.merchant_profile(fact, merchants), fees.groups(spark))}, folder)["inputs"]
    curve = acceptance.calibrate(inputs, acceptance.level_targets(inputs))
    alpha = spark.createDataFrame([(g, float(a)) for g, a in curve.intercepts.items()], "mcc_group string, intercept double")
    response = acceptance.shock_response(inputs, alpha, curve.slope, shock)
    lost = response.select("merchant_id", (F.col("delta") * F.col("gdv_cop")).alias("lost_cop"))
    near = links.substitutes(vectors)
    anchors = [(float(curve.slope), curve.achieved, curve.semi_elasticity, fees.ABANDONMENT, fees.SEMI_ELASTICITY)]
    tables = _write({
        "curve": spark.createDataFrame(anchors, "slope double, abandonment double, semi_elasticity double, abandonment_target double, semi_elasticity_target double"),
        "curve_groups": alpha.join(acceptance.level_targets(inputs), "mcc_group"), "acceptance": acceptance.abandonment(inputs, alpha, curve.slope), "response": response, "substitutes": near,
    }, folder)
    if cardholders is not None:
        tables |= _write({"cardholder_response": acceptance.spend_response(cardholders, rewards_change)}, folder)
    tables |= _write({"moved": links.redistribute(lost, tables["substitutes"]), "leakage": links.leakage(lost, tables["substitutes"])}, folder)
    total = tables["leakage"].first()
    moved = tables["moved"].agg(F.coalesce(F.sum("moved_cop"), F.lit(0.0))).first()[0]
    if abs(moved + total["leaked"] - total["lost"]) > 1e-9 * max(1.0, abs(total["lost"])):
        raise ValueError("moved and leaked volume don't add up to what was lost")
    return tables
