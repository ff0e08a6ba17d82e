"""Removal of long repeated substrings, with suffix arrays built by linear grouping.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in this document or another.

1. Every string of LENGTH bytes has an anchor: of its substrings of ANCHOR bytes the one with the least hash (the
   leftmost of equal ones). Equal strings have equal anchors at the same place, so only strings with equal anchors need
   comparing. Consecutive strings with one anchor make a context of at most 2 * LENGTH - ANCHOR bytes. One pass over
   the texts gives the contexts' places and hashes; the bytes stay where they are.
2. Contexts meet by anchor, after each task has settled what it can: of equal contexts that it holds itself it marks
   all and sends one, so that a passage of a third of all documents sends a few rows. Equal contexts are repeated as a
   whole. Anchors that occur once are done. Where an anchor has different contexts, one of each is fetched.
3. Tasks of about SHARD bytes of such contexts build a suffix array each: neighbours in it that share LENGTH bytes are
   repeated strings.
4. An anchor with more than CONTEXTS different contexts (a passage in very many documents: its edges are different in
   each) isn't gathered in one task, nor are its contexts' places where one task of the first pass has as many; the
   hashes of its contexts' strings are dealt over all tasks instead.

The suffix array (group_suffixes): suffixes start in groups by first byte. Groups are processed in descending order;
each suffix finds the nearest position before it that stands in a lower group (previous-smaller pointers, followed over
all that is already processed); the suffixes so found move up within their group, ordered by how often they were found.
At the end a group holds the suffixes with one Lyndon prefix, and one ascending pass over the array emits each group's
order from that of the suffixes behind the prefix. Nothing is renamed or sorted again.

Documents of equal SHA-256 are one text that occurs several times: each is repeated as a whole if it has LENGTH bytes.
Contexts are equal if their anchors' hashes, their own hashes and their lengths are (128 bits in all); strings of one task's
suffix array are compared byte by byte, and those of hot anchors by their 64-bit hashes among the strings of such anchors.

Defined results: null and empty texts have no bytes; kept_sha256 is that of what is left, of no bytes for all removed;
a null doc_id and rows with the same doc_id are judged row by row.
"""

from __future__ import annotations

import hashlib
import math
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_arrow, prepare, released, utf8, write_out
from .shingles import _BYTE, _power, mix

LENGTH, ANCHOR = 400, 128
SHARD, CONTEXTS, PIECE_BITS = 131_072, 512, 20
RUNS = 500_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: at: where in the context its anchor is; times: 2 if its task has seen the context twice or more; hot: 1 for the mark of an anchor that its task found hot.
_RUN = np.dtype([("anchor", "<u8"), ("text", "<i8"), ("start", "<i8"), ("length", "<i4"), ("at", "<i4"), ("hash", "<u8"), ("times", "u1"), ("hot", "u1")])
_DOC, _RUNS, _SPANS, _HOT = range(4)  # rows of the first pass
_SPAN = np.dtype([("start", "<i8"), ("length", "<i8")])
_NEED = np.dtype([("start", "<i8"), ("length", "<i4"), ("at", "<i4"), ("anchor", "<u8"), ("hot", "<u1")])
_NULL_ID = -(1 << 63)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def text_name(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


class Rolling:
    """Hashes of any substring of one piece of bytes."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n] + np.uint64(length))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values, from running minima of blocks in both directions."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(right[:m], left[width - 1 : width - 1 + m])


def contexts(texts: list[bytes], names: list[int]) -> np.ndarray:
    """The contexts of all texts."""
    out, begin = [], 0
    while begin < len(texts):
        # texts are joined up to a piece; a longer text is cut into pieces that overlap by LENGTH - 1 bytes
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= 1 << (PIECE_BITS - 1)):
            size += len(texts[end])
            end += 1
        if end == begin + 1:
            step = (1 << PIECE_BITS) - LENGTH
            for at in range(0, max(1, len(texts[begin]) - LENGTH + 1), step):
                out.append(_piece([texts[begin][at : at + step + LENGTH - 1]], [names[begin]], at))
        else:
            out.append(_piece(texts[begin:end], names[begin:end], 0))
        begin = end
    return np.concatenate(out) if out else np.zeros(0, _RUN)


def _piece(texts: list[bytes], names: list[int], offset: int) -> np.ndarray:
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return np.zeros(0, _RUN)
    rolling = Rolling(data)
    low = np.uint64((1 << PIECE_BITS) - 1)
    hashes = rolling.all(ANCHOR)
    least = sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), LENGTH - ANCHOR + 1)
    at = (least & low).astype(np.int64)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    valid = np.arange(len(at)) + LENGTH <= (begins + sizes)[owner]
    new = np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])] & valid
    first = np.flatnonzero(new)
    # a context ends where the next one begins or where its text has no more strings
    last = np.minimum(np.r_[first[1:], len(at)], (begins + sizes)[owner[first]] - LENGTH + 1) - 1
    out = np.zeros(len(first), _RUN)
    out["anchor"], out["text"] = hashes[at[first]], np.array(names, np.int64)[owner[first]]
    out["start"], out["length"] = first - begins[owner[first]] + offset, last - first + LENGTH
    out["at"], out["hash"], out["times"] = at[first] - first, rolling.of(first, last + LENGTH), 1
    return out


def _kinds(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs in order; the first of each different context; how often each occurs; where each anchor's contexts begin."""
    runs = runs[np.lexsort((runs["start"], runs["text"], runs["length"], runs["hash"], runs["anchor"]))]
    same = lambda *names: np.logical_and.reduce([runs[n][1:] == runs[n][:-1] for n in names])
    again = np.r_[False, same("anchor", "hash", "length", "text", "start")]
    first = np.flatnonzero(np.r_[True, ~same("anchor", "hash", "length")])
    # a place that came twice counts once, or as often as its own task has counted
    times = np.add.reduceat(np.where(again, 0, runs["times"]), first)
    times = np.maximum(times, np.maximum.reduceat(runs["times"], first))
    anchors = runs["anchor"][first]
    return runs, first, times, np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])


def settle(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs to send, repeated runs, runs of hot anchors) of one task of the first pass."""
    if not len(runs):
        return runs, runs, runs
    runs, first, times, begins = _kinds(runs)
    kinds = runs[first].copy()
    kinds["times"] = np.minimum(times, 2)
    different = np.diff(np.r_[begins, len(kinds)])
    hot = np.repeat(different > CONTEXTS, different)
    marks = kinds[begins[different > CONTEXTS]]
    marks["hot"] = 1
    return np.concatenate([kinds[~hot], marks]), runs[np.repeat(times > 1, np.diff(np.r_[first, len(runs)]))], kinds[hot]


def meet(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(repeated runs, runs to fetch, which of these are of hot anchors) of all tasks' runs of some anchors."""
    marked = np.unique(runs["anchor"][runs["hot"] == 1])
    runs = runs[runs["hot"] == 0]
    if not len(runs):
        return runs, runs, np.zeros(0, bool)
    runs, first, times, begins = _kinds(runs)
    kinds = runs[first]
    different = np.diff(np.r_[begins, len(kinds)])
    mark = np.isin(kinds["anchor"][begins], marked)
    hot = mark | (different > CONTEXTS)
    # with every context known as repeated there is nothing left to compare
    open_ = np.add.reduceat(times == 1, begins) > 0
    fetch = np.repeat(mark | (different > 1) & open_, different)
    return runs[np.repeat(times > 1, np.diff(np.r_[first, len(runs)]))], kinds[fetch], np.repeat(hot, different)[fetch]


def group_suffixes(text: bytes) -> list[int]:
    """The suffix array of a text by linear grouping."""
    n = len(text)
    group = list(text)  # of each suffix
    members: list[list[int]] = [[] for _ in range(256)]
    for i, c in enumerate(text):
        members[c].append(i)
    span = [1] * 256  # length of the Lyndon prefix that a group has in common
    size = [len(m) for m in members]
    below = list(range(-1, 255))
    above = [*range(1, 256), -1]
    done = bytearray(n)
    prev = [-1] * n
    top = current = 255
    while current >= 0:
        own = members[current]
        if size[current] != len(own):
            own = members[current] = [i for i in own if group[i] == current]
        if own:
            own.sort()
            found: dict[int, int] = {}
            for i in own:
                done[i] = 1
                p = i - 1
                while p >= 0 and done[p]:
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    found[p] = found.get(p, 0) + 1
            if found:
                move: dict[tuple[int, int], list[int]] = {}
                for p, times in found.items():
                    key = (times, group[p])
                    if key in move:
                        move[key].append(p)
                    else:
                        move[key] = [p]
                length = span[current]
                for times, old in sorted(move, reverse=True) if len(move) > 1 else move:
                    part = move[times, old]
                    if len(part) == size[old]:
                        span[old] += times * length
                        continue
                    new = len(members)
                    members.append(part)
                    span.append(span[old] + times * length)
                    size[old] -= len(part)
                    size.append(len(part))
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                    for p in part:
                        group[p] = new
        current = below[current]
    while above[top] >= 0:
        top = above[top]
    head, at = [0] * len(members), n
    while top >= 0:
        at -= size[top]
        head[top] = at
        top = below[top]
    behind: list[list[int] | None] = [None] * (n + 1)
    for i in range(n):
        p = i + span[group[i]]
        if behind[p] is None:
            behind[p] = [i]
        else:
            behind[p].append(i)
    order = [n] * n
    for k in range(-1, n):
        for i in behind[order[k] if k >= 0 else n] or ():
            g = group[i]
            order[head[g]] = i
            head[g] += 1
    return order


def _shared(strings: list[bytes]) -> list[int]:
    """Of each string, how many bytes at its front another string has too."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    out = [0] * len(strings)
    for i, j in zip(order, order[1:]):
        a, b = strings[i], strings[j]
        low, high = 0, min(len(a), len(b))
        while low < high:
            middle = (low + high + 1) // 2
            if a[:middle] == b[:middle]:
                low = middle
            else:
                high = middle - 1
        out[i], out[j] = max(out[i], low), max(out[j], low)
    return out


def trim(group: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Contexts of one anchor, (place of the anchor, bytes), without what no other has: (bytes cut in front, rest).

    A string around the anchor that another context has reaches no further to the left, and no further to the right,
    than the context agrees with any other one on that side.
    """
    left = _shared([data[:at][::-1] for at, data in group])
    right = _shared([data[at:] for at, data in group])
    return [(at - a, data[at - a : at + b]) for (at, data), a, b in zip(group, left, right, strict=True)]


def repeated_starts(parts: list[bytes]) -> list[np.ndarray]:
    """For each context, where in it strings of LENGTH bytes start that start elsewhere too."""
    text = b"\0".join(parts) + b"\0"
    data = np.frombuffer(text, np.uint8)
    order = np.array(group_suffixes(text))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    begins = ends - [len(p) for p in parts]
    owner = np.searchsorted(ends, order)
    order = order[ends[owner] - order >= LENGTH]  # whole strings of one context
    hashes = Rolling(data).of(order, order + LENGTH)
    equal = np.flatnonzero(hashes[1:] == hashes[:-1])
    equal = [k for k in equal.tolist() if text[order[k] : order[k] + LENGTH] == text[order[k + 1] : order[k + 1] + LENGTH]]
    hit = np.unique(np.r_[order[equal], order[np.array(equal, int) + 1]]) if len(equal) else np.zeros(0, int)
    cut = np.searchsorted(hit, np.r_[begins, len(text)])
    return [hit[a:b] - s for a, b, s in zip(cut, cut[1:], begins)]


def union_spans(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of the bytes that spans cover."""
    if not len(spans):
        return spans
    spans = np.sort(spans, order="start")
    reach = np.maximum.accumulate(spans["start"] + spans["length"])
    first = np.flatnonzero(np.r_[True, spans["start"][1:] > reach[:-1]])
    out = spans[first].copy()
    out["length"] = reach[np.r_[first[1:], len(spans)] - 1] - out["start"]
    return out


def _starts_to_spans(starts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), _SPAN)
    out["start"], out["length"] = starts, LENGTH
    return union_spans(out)


def _spans_by_text(text: np.ndarray, spans: np.ndarray) -> tuple[list[int], list[bytes]]:
    order = np.argsort(text, kind="stable")
    names, first = np.unique(text[order], return_index=True)
    parts = np.split(spans[order], first[1:]) if len(text) else []
    return names.tolist(), [_pack(union_spans(p) if p.dtype == _SPAN else p) for p in parts]


def _needs(runs: np.ndarray, hot) -> np.ndarray:
    out = np.zeros(len(runs), _NEED)
    for x in ("start", "length", "at", "anchor"):
        out[x] = runs[x]
    out["hot"] = hot
    return out


def _spans(runs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(runs), _SPAN)
    out["start"], out["length"] = runs["start"], runs["length"]
    return out


def _scan(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of documents; runs packed by the anchor's bucket; spans and hot contexts by text."""
    kinds = "kind int, key bigint, mark bigint, text bigint, n_bytes bigint, sha string, bucket int, data binary"
    schema = arrow_schema(kinds)

    def rows(kind: int, n: int, **columns):
        got = columns | {"kind": [kind] * n}
        return pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) if f.name in got else pa.nulls(n, f.type) for f in schema], schema=schema)

    def flush(parts):
        send, repeated, hot = settle(np.concatenate(parts))
        bucket = (mix(send["anchor"]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, first = np.unique(bucket[order], return_index=True)
        yield rows(_RUNS, len(found), bucket=found, data=[_pack(x) for x in np.split(send[order], first[1:])] if len(send) else [])
        for kind, part, data in ((_SPANS, repeated, _spans(repeated)), (_HOT, hot, _needs(hot, 1))):
            names, blobs = _spans_by_text(part["text"], data)
            yield rows(kind, len(names), text=names, data=blobs)

    def run(batches):
        parts, size, seen = [], 0, set()
        for batch in released(batches):
            texts = [t or b"" for t in utf8(batch.column(2))]
            names = [text_name(t) for t in texts]
            yield rows(_DOC, len(texts), key=batch.column(0), mark=batch.column(1), text=names, n_bytes=[len(t) for t in texts], sha=[hashlib.sha256(t).hexdigest() for t in texts])
            new = {name: t for name, t in zip(names, texts, strict=True) if len(t) >= LENGTH and name not in seen}
            seen.update(new)
            runs = contexts(list(new.values()), list(new))
            parts.append(runs)
            size += len(runs)
            if size > RUNS:
                yield from flush(parts)
                parts, size, seen = [], 0, set()
        if size:
            yield from flush(parts)

    return docs.select("key", "mark", "body").mapInArrow(run, kinds)


def _with_bodies(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (key, mark, text, ...) with the body of that key and mark; repeated rows of docs bring theirs as often."""
    return docs.join(rows, ["key", "mark"])


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    body = F.col("text").cast("string")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)).alias("key"), F.xxhash64(body).alias("mark"), body.alias("body"))
    size = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = math.ceil(size / 100 / RUNS) + 7
    scan = write_out(_scan(docs, buckets), "contexts")
    rows = scan.where(F.col("kind") == _DOC).select("key", "mark", "text", "n_bytes", "sha")
    many = "text bigint, spans binary, needs binary"

    def by_anchor(table: pa.Table) -> pa.Table:
        repeated, fetch, hot = meet(np.concatenate([_unpack(x, _RUN) for x in table.column("data").to_pylist()]))
        names, blobs = _spans_by_text(repeated["text"], _spans(repeated))
        wanted, needs = _spans_by_text(fetch["text"], _needs(fetch, hot))
        return pa.table([names + wanted, blobs + [None] * len(wanted), [None] * len(names) + needs], schema=arrow_schema(many))

    met = scan.where(F.col("kind") == _RUNS).select("bucket", "data").groupBy("bucket").applyInArrow(by_anchor, many)
    met = write_out(met, "met").union(
        scan.where(F.col("kind").isin(_SPANS, _HOT)).select(
            "text", F.when(F.col("kind") == _SPANS, F.col("data")), F.when(F.col("kind") == _HOT, F.col("data"))
        )
    )
    a_row = rows.groupBy("text").agg(F.min(F.struct("key", "mark")).alias("one")).select("text", "one.key", "one.mark")
    needed = met.where("needs is not null").groupBy("text").agg(F.collect_list("needs").alias("needs")).join(a_row, "text")
    piece_kinds = "bucket int, hot boolean, data binary"
    shards = max(6, math.ceil(size / 20 / SHARD))

    def cut(batch: pa.RecordBatch) -> dict:
        """Contexts of the texts, packed by bucket; of hot anchors the hashes of all their strings."""
        out: dict[tuple[int, bool], list] = {}
        for body, name, blobs in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            body = body or b""
            if text_name(body) != name:
                continue
            needs = np.concatenate([_unpack(x, _NEED) for x in blobs])
            cold = needs[needs["hot"] == 0]
            for start, length, at, anchor in cold[["start", "length", "at", "anchor"]].tolist():
                out.setdefault((anchor % shards, False), []).append((name, start, at, anchor, body[start : start + length]))
            hot = needs[needs["hot"] == 1]
            if len(hot):
                rolling = Rolling(np.frombuffer(body, np.uint8))
                starts = np.unique(np.concatenate([np.arange(s, s + n - LENGTH + 1) for s, n in hot[["start", "length"]].tolist()]))
                rows = np.zeros(len(starts), [("hash", "<u8"), ("text", "<i8"), ("start", "<i8")])
                rows["hash"], rows["text"], rows["start"] = rolling.of(starts, starts + LENGTH), name, starts
                of = (mix(rows["hash"]) % np.uint64(shards)).astype(np.int64)
                for k in np.unique(of).tolist():
                    out.setdefault((k, True), []).append(rows[of == k])
        keys = list(out)
        data = []
        for k in keys:
            if k[1]:
                data.append(_pack(np.concatenate(out[k])))
            else:
                data.append(zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out[k])))
        return {"bucket": [k[0] for k in keys], "hot": [k[1] for k in keys], "data": pa.array(data, pa.binary())}

    pieces = map_arrow(_with_bodies(docs, needed).select("body", "text", "needs"), cut, piece_kinds)
    found_kinds = "text bigint, spans binary"

    def shard(table: pa.Table) -> pa.Table:
        texts, spans = [], []
        cold: dict[int, dict[tuple[int, int], tuple[int, bytes]]] = {}
        windows = []
        for hot, blob in zip(table.column("hot").to_pylist(), table.column("data").to_pylist(), strict=True):
            raw = zstandard.ZstdDecompressor().decompress(blob)
            if hot:
                windows.append(np.frombuffer(raw, [("hash", "<u8"), ("text", "<i8"), ("start", "<i8")]))
                continue
            for text, start, at, anchor, data in pickle.loads(raw):
                cold.setdefault(anchor, {})[text, start] = (at, data)
        # equal strings have equal anchors: anchors may be told apart, but not the contexts of one
        part: dict[tuple[int, int], bytes] = {}
        size = 0
        for k, anchor in enumerate(sorted(cold)):
            for (text, start), (cut, data) in zip(cold[anchor], trim(list(cold[anchor].values())), strict=True):
                if len(data) >= LENGTH:
                    part[text, start + cut] = data
                    size += len(data)
            if k + 1 == len(cold) or size > SHARD:
                for (text, start), hits in zip(part, repeated_starts(list(part.values())) if part else (), strict=True):
                    if len(hits):
                        texts.append(np.full(len(x := _starts_to_spans(hits + start)), text))
                        spans.append(x)
                part, size = {}, 0
        if windows:
            rows = np.unique(np.concatenate(windows))
            twice = np.r_[False, rows["hash"][1:] == rows["hash"][:-1]]
            rows = rows[twice | np.r_[twice[1:], False]]
            x = np.zeros(len(rows), _SPAN)
            x["start"], x["length"] = rows["start"], LENGTH
            texts.append(rows["text"])
            spans.append(x)
        names, blobs = _spans_by_text(np.concatenate(texts), np.concatenate(spans)) if texts else ([], [])
        return pa.table([names, blobs], schema=arrow_schema(found_kinds))

    found = pieces.groupBy("bucket").applyInArrow(shard, found_kinds)
    spans = met.where("spans is not null").select("text", "spans").union(found)
    spans = spans.groupBy("text").agg(F.collect_list("spans").alias("spans"))
    spans = write_out(spans, "spans")
    # documents are copies if their SHA-256 is equal; hot texts have many rows: the small sides of these joins have one row a text
    copies = rows.groupBy("text", "sha").agg(F.count("*").alias("copies"))
    rows = rows.join(copies, ["text", "sha"]).join(spans.select("text", F.lit(True).alias("found")), "text", "left").withColumn("partly", F.col("found").isNotNull())
    rows = write_out(rows, "rows")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    plain = rows.where(whole | ~F.col("partly")).select(
        "key", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(whole, 1).otherwise(0).cast("bigint").alias("n_spans"),
        F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    partly = rows.where(~whole & F.col("partly")).select("key", "mark", "text").join(spans, "text")
    cut_kinds = "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def keep(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("key", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for key, body, name, blobs in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            body = body or b""
            if text_name(body) == name:
                gone = union_spans(np.concatenate([_unpack(x, _SPAN) for x in blobs]))
                ends = [0, *(gone["start"] + gone["length"]).tolist()]
                kept = b"".join(body[a:b] for a, b in zip(ends, [*gone["start"].tolist(), len(body)], strict=True))
                for k, v in zip(out, (key, len(body), int(gone["length"].sum()), len(gone), hashlib.sha256(kept).hexdigest()), strict=True):
                    out[k].append(v)
        return out

    cut_rows = map_arrow(_with_bodies(docs, partly).select("key", "body", "text", "spans"), keep, cut_kinds)
    out = plain.union(cut_rows)
    return out.select(F.when(F.col("key") != _NULL_ID, F.col("key")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
