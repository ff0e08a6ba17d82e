"""Near-duplicate vectors with a robust-pruned flat graph.

1. Equal vectors of a label are one node. Each label's nodes are dealt to overlapping shards: those of the OVERLAP
   nearest centroids, which come from a bounded sample. A shard of more than BLOCK nodes is cut into blocks by hash.
2. Each block builds a flat graph: of a node's nearest candidates, those are kept that no kept one is clearly nearer to
   (robust pruning with slack ALPHA), at most DEGREE; edges go both ways. The lists that a node has from all its shards are united.
3. Each block is searched by the nodes of its shard: greedy search with a beam of BEAM from the block's medoid, then
   range expansion along the graph, from node to node for as long as nodes within the radius turn up. Every pair is
   verified by its cosine in double precision, counted in the first shard that both nodes share and in no other, and
   only links that join groups are returned. So a hot group of g near-equal vectors sends rows in proportion to g.
4. The audit counts the links of every vector whose vec_id is divisible by AUDIT by brute force against all nodes, in
   blocks. If fewer than RECALL of them were found, all is done again with twice the overlap, and at last by comparing
   the blocks of a label with each other as a whole, which finds all links.

Defined results: a null or zero vector, one with a null or non-finite component, one whose length differs from that of
another vector and one with a null label link only with vectors of their own length and label, or with nothing; such a
vector is its own component. Rows with the same vec_id are judged row by row; n_links counts rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, components, hash_share, map_arrow, prepare, ranges, write_out

RADIUS = 0.98
OVERLAP, BLOCK, DEGREE, MOST, ALPHA, BEAM, CANDIDATES = 3, 1_024, 24, 64, 1.2, 8, 96
#: Vectors that centroids are fitted on; vectors a shard is to have; centroids at most, beyond which shards have more blocks.
SAMPLE, SHARD, MAX_CENTROIDS = 20_000, 512, 4_096
#: Every AUDIT-th vec_id is audited, so many at once against so many.
AUDIT, ASKED, AGAINST, RECALL = 50, 4_096, 65_536, 0.99
#: Labels are classes: each has a shard at least, and its row in a list that all tasks get.
MAX_KINDS = 100_000


def _nodes(vectors: DataFrame) -> DataFrame:
    """vec_id, node (null for what links with nothing), kind (label and length), unit vector."""
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    good &= ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    ).withColumn("good", F.coalesce(good, F.lit(False)))
    kind = F.concat_ws("/", F.col("label"), F.size("embedding").cast("string"))
    rows = rows.select("vec_id", F.when(F.col("good"), kind).alias("kind"), F.when(F.col("good"), F.col("embedding")).alias("embedding"))

    def unit(batch: pa.RecordBatch) -> dict:
        out, nodes = [], []
        for kind, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            v = None if x is None else np.array(x, float)
            scale = 0 if v is None else np.abs(v).max()
            if not scale:
                out.append(None)
                nodes.append(None)
                continue
            v = v / scale
            v /= math.sqrt(math.fsum(v * v))
            out.append(v.tobytes())
            nodes.append(int.from_bytes(hashlib.blake2b(kind.encode() + b"\0" + np.array(x).tobytes(), digest_size=8).digest(), "little", signed=True))
        return {"vec_id": batch.column(0), "kind": batch.column(1), "node": pa.array(nodes, pa.int64()), "unit": pa.array(out, pa.binary())}

    return map_arrow(rows, unit, "vec_id bigint, kind string, node bigint, unit binary")


def _centroids(nodes: DataFrame, counts: dict[str, int]) -> dict[str, tuple[int, np.ndarray]]:
    """For each kind, the number of its first shard and its centroids."""
    total = sum(counts.values())
    rate = min(1.0, SAMPLE / max(1, total))
    sample = nodes.where(hash_share("node", "centroids") < rate).select("kind", "node", "unit").limit(2 * SAMPLE).collect()
    of: dict[str, list] = {}
    for kind, node, unit in sorted(map(tuple, sample)):
        of.setdefault(kind, []).append(np.frombuffer(unit))
    out, first = {}, 0
    for kind, n in sorted(counts.items()):
        x = np.array(of.get(kind, [np.ones(int(kind.rpartition("/")[2]))]))
        k = max(1, min(len(x) // 4, math.ceil(n / SHARD), math.ceil(MAX_CENTROIDS * n / total)))
        centers = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(5):
            near = (x @ centers.T).argmax(axis=1)
            sums = np.zeros_like(centers)
            np.add.at(sums, near, x)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centers = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centers)
        out[kind] = (first, centers)
        first += k
    return out


def build_graph(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each vector of a block, robustly pruned."""
    similar = x @ x.T
    np.fill_diagonal(similar, -np.inf)
    n = len(x)
    width = min(CANDIDATES, n - 1)
    if width <= 0:
        return [np.zeros(0, int)] * n
    near = np.argpartition(-similar, width - 1, axis=1)[:, :width]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(similar, near, 1), axis=1, kind="stable"), 1)
    # far candidates keep the graph in one piece: some of all nodes, spread evenly
    spread = np.linspace(0, n - 1, min(8, n)).astype(int)
    out = []
    for p in range(n):
        candidates = np.r_[near[p], spread[spread != p]]
        distance = 1 - similar[p, candidates]
        alive, kept = np.ones(len(candidates), bool), []
        for k in range(len(candidates)):
            if alive[k]:
                kept.append(candidates[k])
                if len(kept) == DEGREE:
                    break
                alive &= ALPHA * (1 - similar[candidates[k], candidates]) > distance
        out.append(np.unique(kept))
    # edges go both ways, so that every node can be reached from those that it reaches
    a = np.repeat(np.arange(n), [len(k) for k in out])
    b = np.concatenate(out)
    edges = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.split(edges % n, np.searchsorted(edges // n, np.arange(1, n)))


def _padded(lists: list[np.ndarray]) -> np.ndarray:
    """Lists as rows; of a list of more than MOST, MOST spread over it."""
    lists = [x if len(x) <= MOST else x[np.linspace(0, len(x) - 1, MOST).astype(int)] for x in lists]
    out = np.full((len(lists), max(1, max(map(len, lists), default=1))), -1)
    for row, x in zip(out, lists, strict=True):
        row[: len(x)] = x
    return out


def range_search(queries: np.ndarray, x: np.ndarray, lists: list[np.ndarray], own: np.ndarray, radius: float = RADIUS) -> np.ndarray:
    """in_range[q, i]; lists: neighbours; own: a query's own place in x, or -1.

    The beam looks at MOST neighbours of a node, range expansion at all of them.
    """
    nq, n = len(queries), len(x)
    graph = _padded(lists)
    degree = np.array([len(k) for k in lists])
    flat, begins = np.concatenate(lists), np.cumsum(degree) - degree
    medoid = int((x @ x.mean(axis=0)).argmax())
    seen = np.zeros((nq, n + 1), bool)
    seen[:, n] = True
    rows = np.arange(nq)
    beam = np.full((nq, BEAM), n)
    score = np.full((nq, BEAM), -np.inf)
    open_ = np.zeros((nq, BEAM), bool)
    beam[:, 0], score[:, 0], open_[:, 0] = medoid, queries @ x[medoid], True
    seen[:, medoid] = True
    known = np.where(own >= 0)[0]
    beam[known, 1], score[known, 1], open_[known, 1] = own[known], 1.0, True
    seen[known, own[known]] = True
    in_range = np.zeros((nq, n), bool)
    in_range[:, medoid] = score[:, 0] >= radius
    in_range[known, own[known]] = True
    while open_.any():
        best = np.where(open_, score, -np.inf).argmax(axis=1)
        active = np.flatnonzero(open_.any(axis=1))
        at = beam[active, best[active]]
        open_[active, best[active]] = False
        next_ = graph[at]
        next_ = np.where(next_ < 0, n, next_)
        fresh = ~seen[active[:, None], next_]
        seen[active[:, None], next_] = True
        value = np.einsum("qd,qkd->qk", queries[active], x[np.minimum(next_, n - 1)])
        value = np.where(fresh, value, -np.inf)
        hit = value >= radius
        q, k = np.nonzero(hit)
        in_range[active[q], next_[q, k]] = True
        nodes = np.concatenate([beam[active], next_], axis=1)
        values = np.concatenate([score[active], value], axis=1)
        opened = np.concatenate([open_[active], fresh], axis=1)
        top = np.argsort(-values, axis=1, kind="stable")[:, :BEAM]
        beam[active], score[active] = np.take_along_axis(nodes, top, 1), np.take_along_axis(values, top, 1)
        open_[active] = np.take_along_axis(opened, top, 1) & np.isfinite(score[active])
    # range expansion: what is within the radius leads on to its neighbours
    q, at = np.nonzero(in_range)
    while len(q):
        next_q, next_at = [], []
        for k in range(0, len(q), 16_384):
            part, of = at[k : k + 16_384], q[k : k + 16_384]
            to = flat[ranges(begins[part], degree[part])]
            pairs = np.unique(np.repeat(of, degree[part]) * (n + 1) + to)
            pq, pn = pairs // (n + 1), pairs % (n + 1)
            # nodes that the beam saw and found out of range need no second look; the rest is new
            fresh = ~seen[pq, pn]
            pq, pn = pq[fresh], pn[fresh]
            seen[pq, pn] = True
            near = np.einsum("kd,kd->k", queries[pq], x[pn]) >= radius
            next_q.append(pq[near])
            next_at.append(pn[near])
        q, at = np.concatenate(next_q), np.concatenate(next_at)
        in_range[q, at] = True
    return in_range


def _search(table: pa.Table, exact: bool = False) -> pa.Table:
    """Links between the queries and the index of one task, by the graph or by comparing all."""
    rows = table.select(["node", "unit", "near", "shards", "copies", "shard", "query", "index"]).to_pydict()
    index = sorted((k for k, yes in enumerate(rows["index"]) if yes), key=lambda k: rows["node"][k])
    query = sorted((k for k, yes in enumerate(rows["query"]) if yes), key=lambda k: rows["node"][k])
    out_a, out_b, out_n = [], [], []
    if index and query:
        place = {rows["node"][k]: i for i, k in enumerate(index)}
        x = np.array([np.frombuffer(rows["unit"][k]) for k in index])
        q = np.array([np.frombuffer(rows["unit"][k]) for k in query])
        own = np.array([place.get(rows["node"][k], -1) for k in query])
        if exact:
            found = q @ x.T >= RADIUS - 1e-9
        else:
            found = range_search(q, x, [np.array([place[m] for m in rows["near"][k] if m in place], int) for k in index], own)
        found[np.flatnonzero(own >= 0), own[own >= 0]] = False
        copies = np.array([rows["copies"][k] for k in index])
        here = rows["shard"][0]
        nodes = np.array([rows["node"][k] for k in index])
        # a pair counts in the first shard that both have
        mine = np.array([_pad_shards(rows["shards"][k]) for k in query])
        theirs = np.array([_pad_shards(rows["shards"][k]) for k in index])
        group: dict[int, int] = {}

        def root(v: int) -> int:
            while group.setdefault(v, v) != v:
                group[v] = group[group[v]]
                v = group[v]
            return v

        for i, k in enumerate(query):
            hits = np.flatnonzero(found[i])
            if not len(hits):
                continue
            hits = hits[(q[i] * x[hits]).sum(axis=1) >= RADIUS]
            common = np.where((theirs[hits][:, :, None] == mine[i][None, None, :]) & (theirs[hits][:, :, None] >= 0), theirs[hits][:, :, None], np.iinfo(np.int64).max)
            first = hits[common.min(axis=(1, 2)) == here]
            if len(first):
                out_a.append(rows["node"][k])
                out_b.append(None)
                out_n.append(int(copies[first].sum()))
            for j in hits.tolist():
                a, b = root(rows["node"][k]), root(int(nodes[j]))
                if a != b:
                    group[a] = b
                    out_a.append(rows["node"][k])
                    out_b.append(int(nodes[j]))
                    out_n.append(0)
    return pa.table([out_a, out_b, out_n], schema=arrow_schema("a bigint, b bigint, n bigint"))


def _pad_shards(shards: list[int], width: int = 4 * OVERLAP) -> list[int]:
    return (shards + [-1] * width)[:width]


def _links(nodes: DataFrame, counts: dict[str, int], overlap: int, exact: bool = False) -> DataFrame:
    """(a, b, n): links that join groups (b not null), and links to n rows (b null). exact: a label is one shard, blocks are compared whole."""
    spark = nodes.sparkSession
    whole = {kind: (k, np.ones((1, int(kind.rpartition("/")[2])))) for k, kind in enumerate(sorted(counts))}
    centers = spark.sparkContext.broadcast(whole if exact else _centroids(nodes, counts))

    def assign(batch: pa.RecordBatch) -> dict:
        cols = {k: [] for k in ("shard", "node", "unit", "shards", "copies")}
        for node, kind, unit, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            first, c = centers.value[kind]
            value = c @ np.frombuffer(unit)
            k = min(overlap, len(c))
            near = sorted((np.argpartition(-value, k - 1)[:k] + first).tolist())
            for s in near:
                for name, v in zip(cols, (s, node, unit, near, copies), strict=True):
                    cols[name].append(v)
        return {k: pa.array(v, t) for (k, v), t in zip(cols.items(), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64()), strict=True)}

    kinds = "shard bigint, node bigint, unit binary, shards array<bigint>, copies bigint"
    members = write_out(map_arrow(nodes.select("node", "kind", "unit", "copies"), assign, kinds), "members")
    sizes = members.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))  # a row a centroid
    members = members.join(F.broadcast(sizes), "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("node").to_numpy())
        names = table.column("node").to_numpy()[order]
        if exact:
            return pa.table([names, [[]] * len(names)], schema=arrow_schema("node bigint, near array<bigint>"))
        units = table.column("unit").to_pylist()
        graph = build_graph(np.array([np.frombuffer(units[k]) for k in order]))
        return pa.table([names, [names[g].tolist() for g in graph]], schema=arrow_schema("node bigint, near array<bigint>"))

    lists = members.select("shard", "block", "node", "unit").groupBy("shard", "block").applyInArrow(build, "node bigint, near array<bigint>")
    united = write_out(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    full = members.join(united, "node")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = full.where("blocks = 1").select("shard", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "unit", "near", "shards", "copies", F.lit(True).alias("query"), F.lit(True).alias("index"))
    several = full.where("blocks > 1").withColumn("other", other)
    asked = several.select("shard", F.col("block").cast("int"), F.col("other").cast("int"), "node", "unit", F.array().cast("array<bigint>"), "shards", "copies", F.lit(True), F.lit(False))
    index = several.select("shard", F.col("other").cast("int"), F.col("block").cast("int"), "node", "unit", "near", "shards", "copies", F.lit(False), F.lit(True))
    return write_out(one.union(asked).union(index).groupBy("shard", "i", "j").applyInArrow(lambda table: _search(table, exact), "a bigint, b bigint, n bigint"), "found")


def _audit(nodes: DataFrame, rows: DataFrame, counted: DataFrame) -> float:
    """Of the links that brute force finds for the nodes of every AUDIT-th vec_id, the share that was counted."""
    asked = rows.where(F.col("node").isNotNull() & (F.col("vec_id") % AUDIT == 0)).select("node").distinct()
    asked = nodes.join(asked, "node", "left_semi").select("node", "kind", "unit")
    n_asked, n_all = asked.count(), nodes.count()
    if not n_asked:
        return 1.0
    across, down = math.ceil(n_asked / ASKED), math.ceil(n_all / AGAINST)
    block = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(block(across, "asked").alias("i"), each(down).alias("j"), "node", "kind", "unit", F.lit(0).cast("bigint").alias("copies"))
    right = nodes.select(each(across).alias("i"), block(down, "against").alias("j"), "node", "kind", "unit", "copies")

    def count(table: pa.Table) -> pa.Table:
        cols = table.to_pydict()
        by: dict[str, tuple[list[int], list[int]]] = {}
        for k, (kind, copies) in enumerate(zip(cols["kind"], cols["copies"], strict=True)):
            by.setdefault(kind, ([], []))[copies > 0].append(k)
        names, found = [], []
        for queries, index in by.values():
            if queries and index:
                q, x = (np.array([np.frombuffer(cols["unit"][k]) for k in part]) for part in (queries, index))
                mine, theirs = (np.array([cols["node"][k] for k in part]) for part in (queries, index))
                near = (q @ x.T >= RADIUS) & (mine[:, None] != theirs)
                names += mine.tolist()
                found += (near * np.array([cols["copies"][k] for k in index])).sum(axis=1).tolist()
        return pa.table([names, found], schema=arrow_schema("node bigint, n bigint"))

    true = left.union(right).groupBy("i", "j").applyInArrow(count, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n"))
    both = true.join(counted, "node", "left").agg(F.sum("n"), F.sum(F.least("n", F.coalesce("found", F.lit(0))))).first()
    return float(both[1]) / both[0] if both[0] else 1.0


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_recall for every row of vectors."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = write_out(_nodes(vectors), "vectors")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.first("kind").alias("kind"), F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("vec_id")
    )
    nodes = write_out(nodes, "nodes")
    counts = {r[0]: r[1] for r in nodes.groupBy("kind").count().collect()}
    if len(counts) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} labels")
    for overlap, exact in ((OVERLAP, False), (2 * OVERLAP, False), (4 * OVERLAP, False), (1, True)):
        found = _links(nodes, counts, overlap, exact)
        counted = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("found"))
        recall = _audit(nodes, rows, counted)
        if recall >= RECALL:
            break
    groups = components(found.where("b is not null").select("a", "b")).withColumnRenamed("component", "root")
    named = nodes.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "vec_id", "copies")
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    judged = named.join(least, "root").join(counted, "node", "left")
    judged = write_out(judged.select("node", "component_id", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "judged")
    out = rows.select("vec_id", "node").join(judged, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(recall).alias("audit_recall"),
    )
