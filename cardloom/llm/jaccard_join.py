"""N-gram Jaccard join: a blocked sparse product of the document by shingle incidence.

1. Each text becomes its set of shingles. Texts with equal sets are one node, named by a hash of the set.
2. All sets are counted into a sketch of shingle frequencies (at least as large as the true ones), which puts the
   shingles in one order: rare ones first, then by the power of two of their counts. Two sets that link share one of
   their first n - ceil(0.8 n) + 1 shingles in that order, so only those columns of the incidence matrix are multiplied.
3. The columns are dealt into blocks by hash. A block finds the nodes of each of its shingles and adds up, for each pair
   of nodes, how many they share. The sums of all blocks meet, and pairs are discarded whose sum, plus what the columns
   not multiplied could add, is below the overlap that their sizes ask for.
4. A shingle that more than LIST nodes have makes no pairs: its nodes are tied to its smallest node. A task that holds
   as many itself ties them at once and sends one node, marked, in place of all. A pair that shares such a shingle is in
   one cluster by these ties, whatever its sum; the sum of any other pair is exact.
5. What remains falls into clusters, in which all pairs are multiplied over all columns: several small clusters in a
   task, a large cluster of g nodes in pairs of blocks of BLOCK nodes, which moves each set g / BLOCK times. They return
   the links that join groups, not all links.

Copies are one node, so a group of equal texts of any size costs a row a text. Which pairs are candidates never depends on
the sketch, only on how many there are: it has at most 2^26 counters (64 MB to every executor), and with more text than 2^30
shingles the order gets coarser, so that a shingle counts as more frequent than others from a higher number on.

Sets and texts are known by 64-bit hashes; two different sets of one name would be taken for equal (one in 2^64 for a pair).

Defined results: null, empty and blank texts have no shingles and link with nothing; rows with the same doc_id are
judged each by its text, and a null doc_id is named by the other members of its group, or null. Sets of equal size and
frequency are ordered by hash, so ties don't change the result. Other columns of docs may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cleared, components, fresh, map_arrow, prepare, released, utf8, write_out
from .shingles import mix, shingle_sets

WORDS = 5
#: Two sets link when DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
LIST, BLOCK, COLUMNS = 64, 512, 1_000_000
SLICE_BITS, TIES = 16, -1
_NULL_ID = -(1 << 63)
#: n is negative for the mark of a shingle whose other nodes its task has tied.
_POSTING = np.dtype([("shingle", "<u8"), ("node", "<i8"), ("n", "<i4")])
_PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("na", "<i4"), ("nb", "<i4"), ("count", "<i4")])


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = mix(shingles).sum(dtype=np.uint64) ^ mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _split(x: np.ndarray, bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return list(zip(found.tolist(), np.split(x[order], first[1:]), strict=True)) if len(x) else []


def _sets(docs: DataFrame, sketch_bits: int) -> DataFrame:
    """A row for each text (doc_id, body, node, n), and the task's counts of shingles in slices of the sketch."""
    kinds = "doc_id bigint, body bigint, node bigint, n int, slice int, counts binary"
    schema = arrow_schema(kinds)
    shift = np.uint64(64 - sketch_bits)

    def rows(size: int, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches):
        counts = np.zeros(1 << sketch_bits, np.uint16)
        for batch in released(batches):
            sets = shingle_sets(list(utf8(batch.column(2))), WORDS)
            nodes = [node_of(s) if len(s) else None for s in sets]
            yield rows(batch.num_rows, doc_id=batch.column(0), body=batch.column(1), node=nodes, n=[len(s) for s in sets])
            if any(map(len, sets)):
                at, times = np.unique((mix(np.concatenate(sets)) >> shift).astype(np.int64), return_counts=True)
                counts[at] = np.minimum(65_535, counts[at] + times)
        parts = [(k, _pack(part)) for k, part in enumerate(np.split(counts, max(1, len(counts) >> SLICE_BITS))) if part.any()]
        yield rows(len(parts), slice=[k for k, _ in parts], counts=[x for _, x in parts])

    return docs.select("doc_id", "body", "text").mapInArrow(run, kinds)


def _sketch(rows: DataFrame, bits: int) -> np.ndarray:
    """Of the counts of all tasks, 0 up to LIST and else the power of two; its size depends on `bits` alone."""

    def add(table: pa.Table) -> pa.Table:
        total = 0
        for x in table.column("counts").to_pylist():
            total = total + _unpack(x, np.uint16).astype(np.int64)
        power = np.where(total > LIST, np.log2(np.maximum(1, total)), 0).astype(np.uint8)
        return pa.table([[table.column("slice")[0].as_py()], [_pack(power)]], schema=arrow_schema("slice int, counts binary"))

    parts = rows.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, counts binary")
    out = np.zeros(1 << bits, np.uint8)
    size = min(1 << bits, 1 << SLICE_BITS)
    for k, x in parts.collect():
        out[k * size : (k + 1) * size] = _unpack(x, np.uint8)
    return out


def _columns(docs: DataFrame, sketch, bits: int, buckets: int) -> DataFrame:
    """The prefix columns of every set, packed, dealt into blocks by the shingle's hash."""
    shift = np.uint64(64 - bits)
    schema = arrow_schema("bucket int, data binary")

    def batch_postings(texts: list[bytes | None], seen: set) -> list[np.ndarray]:
        out = []
        for s in shingle_sets(texts, WORDS):
            if not len(s) or (node := node_of(s)) in seen:
                continue
            seen.add(node)
            p = prefix_length(len(s))
            order = mix(s)
            power = sketch.value[(order >> shift).astype(np.int64)].astype(np.uint64)
            rank = power << np.uint64(58) | mix(order) >> np.uint64(6)
            first = np.argpartition(rank, p - 1)[:p] if p < len(s) else np.arange(len(s))
            rows = np.zeros(p, _POSTING)
            rows["shingle"], rows["node"], rows["n"] = s[first], node, len(s)
            out.append(rows)
        return out

    def flush(parts: list[np.ndarray]):
        rows, ties = tie(np.concatenate(parts), LIST)
        cut = _split(rows, (mix(rows["shingle"]) % np.uint64(buckets)).astype(np.int64))
        if len(ties):
            # a task's ties need not meet those of others: any bucket below 0 will do
            cut.append((-1 - len(ties) % buckets, ties))
        data = [[k for k, _ in cut], [_pack(x) for _, x in cut]]
        return pa.RecordBatch.from_arrays([pa.array(data[0], pa.int32()), pa.array(data[1], pa.binary())], schema=schema)

    def run(batches):
        parts, size, seen = [], 0, set()
        for batch in released(batches):
            new = batch_postings(list(utf8(batch.column(0))), seen)
            parts += new
            size += sum(map(len, new))
            if size > COLUMNS:
                yield flush(parts)
                parts, size, seen = [], 0, set()
        if parts:
            yield flush(parts)

    return docs.select("text").mapInArrow(run, "bucket int, data binary")


def tie(rows: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with one marked row for each shingle of more than `limit` nodes, ties of those nodes)."""
    rows = rows[np.lexsort((rows["node"], rows["shingle"]))]
    first = np.flatnonzero(np.r_[True, rows["shingle"][1:] != rows["shingle"][:-1]])
    length = np.diff(np.r_[first, len(rows)])
    many = length > limit
    if not many.any():
        return rows, np.zeros((0, 2), np.int64)
    of_many = np.repeat(many, length)
    ties = np.stack([np.repeat(rows["node"][first[many]], length[many]), rows["node"][of_many]], axis=1)
    marks = rows[first[many]].copy()
    marks["n"] = -marks["n"]
    return np.concatenate([rows[~of_many], marks]), np.unique(ties[ties[:, 0] != ties[:, 1]], axis=0)


def block_pairs(rows: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs with counts, ties of frequent shingles) of one block of columns."""
    # of equal rows the marked one is first, and stays
    rows = rows[np.lexsort((rows["n"], rows["node"], rows["shingle"]))]
    same = (rows["shingle"][1:] == rows["shingle"][:-1]) & (rows["node"][1:] == rows["node"][:-1])
    rows = rows[np.r_[True, ~same]]
    first = np.flatnonzero(np.r_[True, rows["shingle"][1:] != rows["shingle"][:-1]])
    length = np.diff(np.r_[first, len(rows)])
    pairs, ties = [], []
    many = (length > limit) | (np.minimum.reduceat(rows["n"], first) < 0)
    for a, k in zip(first[many].tolist(), length[many].tolist()):
        nodes = rows["node"][a : a + k]
        ties.append(np.stack([np.full(k - 1, nodes[0]), nodes[1:]], axis=1))
    for k in np.unique(length[(length > 1) & ~many]).tolist():
        left, right = np.triu_indices(k, 1)
        of = first[(length == k) & ~many]
        step = max(1, 2_000_000 // len(left))
        for at in range(0, len(of), step):
            x = (of[at : at + step, None] + left).ravel()
            y = (of[at : at + step, None] + right).ravel()
            na, nb = rows["n"][x].astype(np.int64), rows["n"][y].astype(np.int64)
            fits = DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)
            x, y = x[fits], y[fits]
            out = np.zeros(len(x), _PAIR)
            out["a"], out["b"], out["na"], out["nb"] = rows["node"][x], rows["node"][y], rows["n"][x], rows["n"][y]
            out["count"] = 1
            pairs.append(add_up(out))
    pairs = add_up(np.concatenate(pairs)) if pairs else np.zeros(0, _PAIR)
    return pairs, np.unique(np.concatenate(ties), axis=0) if ties else np.zeros((0, 2), np.int64)


def add_up(pairs: np.ndarray) -> np.ndarray:
    """One row for each pair, with the sum of its counts."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    new = np.r_[True, (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])]
    first = np.flatnonzero(new)
    out = pairs[first]
    out["count"] = np.add.reduceat(pairs["count"], first)
    return out


def may_link(pairs: np.ndarray) -> np.ndarray:
    """Whether the overlap that the sizes ask for can be reached.

    Of the set whose prefix ends first in the common order, every prefix shingle that the other set has is in the
    other's prefix too; so the overlap is at most the prefix columns shared plus what that set has behind its prefix.
    Shared columns of tied shingles weren't counted, but what shares one is in one cluster already.
    """
    na, nb = pairs["na"].astype(np.int64), pairs["nb"].astype(np.int64)
    need = -(-NUM * (na + nb) // (NUM + DEN))
    behind = np.maximum(-(-NUM * na // DEN), -(-NUM * nb // DEN)) - 1
    return pairs["count"] + behind >= need


def cluster_links(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a cluster that join groups; with sides, only those between side 0 and side 1."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum([0, *map(len, sets)])
    sizes = np.diff(begins)
    group = np.arange(len(sets))
    out, here = [], np.zeros(column.max() + 1, bool)
    last = len(sets) if side is None else int((side == 0).sum())
    for k in range(last):
        rest = begins[k + 1 if side is None else last]
        if rest >= len(column):
            break
        here[column[begins[k] : begins[k + 1]]] = True
        shared = np.bincount(owner[rest:][here[column[rest:]]], minlength=len(sets))
        here[column[begins[k] : begins[k + 1]]] = False
        linked = np.flatnonzero((shared > 0) & (DEN * shared >= NUM * (sizes + sizes[k] - shared)))
        for other in linked.tolist():
            if group[k] != group[other]:
                group[group == group[other]] = group[k]
                out.append((int(nodes[k]), int(nodes[other])))
    return out


def _verify(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, parallel: int) -> DataFrame:
    """(a, b): verified links that join the groups of every cluster. nodes: doc_id, body and node of a text of each node."""
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    placed = (
        clusters.join(sizes, "component")
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .join(nodes, "node")
        .select("doc_id", "body", "node", "component", "blocks")
    )
    # the list of wanted documents grows with the corpus, so it is never broadcast
    texts = docs.join(placed.hint("merge"), ["doc_id", "body"]).select("node", "component", "blocks", "text")

    def to_sets(batch: pa.RecordBatch) -> dict:
        # repeated rows bring their text again; the set's name tells whether it is the one that is meant
        sets = shingle_sets(list(utf8(batch.column(3))), WORDS)
        good = pa.array([len(s) > 0 and node_of(s) == x for s, x in zip(sets, batch.column(0).to_pylist(), strict=True)])
        data = pa.array([s.tobytes() for s in sets], pa.binary())
        return {k: v.filter(good) for k, v in zip(("node", "component", "blocks", "data"), (*batch.columns[:3], data), strict=True)}

    sets = map_arrow(texts, to_sets, "node bigint, component bigint, blocks int, data binary")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.withColumn("mine", mine).withColumn("other", other).select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(parallel)))
        .otherwise(F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other"))).alias("task"),
        "component", "node", "data",
        F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), (F.col("mine") != F.col("other")).alias("two"),
    )

    def links(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        order = sorted(range(len(rows["node"])), key=lambda k: (rows["component"][k], rows["two"][k], rows["side"][k], rows["node"][k]))
        out, at = [], 0
        while at < len(order):
            end = at
            key = rows["component"][order[at]], rows["two"][order[at]]
            while end < len(order) and (rows["component"][order[end]], rows["two"][order[end]]) == key:
                end += 1
            # one text of each node: repeated rows bring the same set again
            part = [k for j, k in enumerate(order[at:end]) if j == 0 or rows["node"][k] != rows["node"][order[at + j - 1]]]
            if len(part) > 1:
                side = np.array([rows["side"][k] for k in part]) if key[1] else None
                out += cluster_links(np.array([rows["node"][k] for k in part]), [np.frombuffer(rows["data"][k], np.uint64) for k in part], side)
            at = end
        return pa.table([[x for x, _ in out], [y for _, y in out]], schema=arrow_schema("a bigint, b bigint"))

    return dealt.groupBy("task").applyInArrow(links, "a bigint, b bigint")


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id (known if null too), body (a hash of the text) and text."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("body"), text.alias("text"))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, body, node, n of every row of _narrow's docs; root of every node)."""
    spark = docs.sparkSession
    prepare(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shingles = max(1, size // 6)
    bits = min(26, max(SLICE_BITS, math.ceil(math.log2(shingles / 16 + 1))))
    buckets = math.ceil(shingles / 5 / COLUMNS) + 7
    rows = write_out(_sets(docs, bits), "sets")
    sketch = spark.sparkContext.broadcast(_sketch(rows, bits))
    texts = rows.where("slice is null").select("doc_id", "body", "node", "n")

    def block(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            data = table.column("data").to_pylist()
            return pa.table([[TIES] * len(data), data], schema=arrow_schema("bucket int, data binary"))
        pairs, ties = block_pairs(np.concatenate([_unpack(x, _POSTING) for x in table.column("data").to_pylist()]), LIST)
        out = _split(pairs, (mix(pairs["a"].view(np.uint64) ^ mix(pairs["b"].view(np.uint64))) % np.uint64(buckets)).astype(np.int64))
        return pa.table([[k for k, _ in out] + [TIES], [_pack(x) for _, x in out] + [_pack(ties)]], schema=arrow_schema("bucket int, data binary"))

    columns = _columns(docs, sketch, bits, buckets)
    blocks = write_out(columns.groupBy("bucket").applyInArrow(block, "bucket int, data binary"), "pairs")
    cleared(spark)

    def decide(table: pa.Table) -> pa.Table:
        pairs = add_up(np.concatenate([_unpack(x, _PAIR) for x in table.column("data").to_pylist()]))
        pairs = pairs[may_link(pairs)]
        return pa.table([pairs["a"], pairs["b"]], schema=arrow_schema("a bigint, b bigint"))

    def untie(batch: pa.RecordBatch) -> dict:
        ties = np.concatenate([_unpack(x, np.int64).reshape(-1, 2) for x in batch.column(0).to_pylist()])
        return {"a": ties[:, 0], "b": ties[:, 1]}

    candidates = (
        blocks.where("bucket >= 0").groupBy("bucket").applyInArrow(decide, "a bigint, b bigint")
        .union(map_arrow(blocks.where("bucket < 0").select("data"), untie, "a bigint, b bigint"))
    )
    clusters = write_out(components(candidates), "clusters")
    a_text = F.min(F.struct("doc_id", "body")).alias("one")
    of_node = texts.join(clusters.select("node"), "node", "left_semi").groupBy("node").agg(a_text).select("node", "one.doc_id", "one.body")
    links = _verify(docs, of_node, clusters, 4 * buckets)
    return texts, components(links).withColumnRenamed("component", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    texts, groups = _grouped(_narrow(docs))
    known = F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id"))
    least = texts.where("node is not null").groupBy("node").agg(F.min(known).alias("known_id"))
    named = least.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "known_id")
    least = named.groupBy("root").agg(F.min("known_id").alias("component_id"))
    roots = write_out(named.join(least, "root").select("node", "component_id"), "groups")
    named = texts.withColumn("doc_id", known).join(roots, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return named.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: the one with the smallest doc_id, a null one last.

    Rows without shingles all stay. Of repeated rows with the kept doc_id and text one stays, any of them if other
    columns differ; another text under the same doc_id is judged by its own group.
    """
    texts, groups = _grouped(_narrow(docs))
    nodes = texts.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id") == _NULL_ID, "doc_id", "body")).alias("one"))
    rooted = nodes.join(groups, "node", "left").select(F.coalesce("root", "node").alias("root"), "one")
    one = rooted.groupBy("root").agg(F.min("one").alias("one")).select("one.doc_id", "one.body")
    times = texts.groupBy("doc_id", "body").agg(F.count("*").alias("times"), F.max(F.col("node").isNull()).alias("blank"))
    doc_, body_, times_, own_, text_ = (fresh(docs, x) for x in ("doc", "body", "times", "own", "text"))
    stays = times.join(one.withColumn("kept", F.lit(True)), ["doc_id", "body"], "left").where("kept or blank")
    again = F.when(F.col("blank"), 1).otherwise(F.col("times"))
    stays = write_out(stays.select(F.col("doc_id").alias(doc_), F.col("body").alias(body_), again.alias(times_)), "stays")
    keyed = docs.withColumns({own_: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)), text_: F.xxhash64(F.col("text").cast("string"))})
    kept = keyed.join(stays.hint("merge"), (F.col(own_) == F.col(doc_)) & (F.col(text_) == F.col(body_)))
    once, more = kept.where(F.col(times_) == 1), kept.where(F.col(times_) > 1).dropDuplicates([own_, text_])
    return once.union(more).select(*(F.col(f"`{c}`") for c in docs.columns))
