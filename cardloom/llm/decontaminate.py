"""Benchmark decontamination with suffix arrays of the training text.

Each shard of documents (whole texts, about SHARD_BYTES of them) becomes a sequence of word numbers, where every word that
no benchmark item has is 0; no match reaches over a 0. The shard's suffix array holds all its suffixes up to their first
0 (one that begins with 0 is empty), sorted by words packed into 64-bit keys and, where keys are equal, by the ranks of
the suffixes behind them, twice as far each round. Every benchmark suffix is binary-searched in it. The range of suffixes
that share a window with it gives all places of the window, and runs of places on one diagonal give a document's longest
verbatim match with an item; the deepest range that isn't empty is the suffix's own longest match (longest_matches).

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, that is runs of 0-9, a-z and all that
is not ASCII. A window is 13 consecutive words of an item; an item of fewer words, but not none, is one window.

Defined results: null and empty texts have no words, no hits, and are clean. Items that are null, empty or without
words have no windows. Items with equal words are all found; repeated item ids count once; a null item id is written
as an empty string. An empty benchmark leaves every document clean. Rows with the same doc_id are judged one by one. Of
equally long matches of a document the first is given. Other columns of docs may have any name.

The benchmark goes to the executors in blocks of at most BLOCK_BYTES of text: one block as a broadcast value, more as
files of the shared folder that are loaded one after the other, so a large benchmark costs time and no memory.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import arrow_schema, as_arrow, new_path, prepare, ranges, released, utf8

WINDOW, BLOCK_BYTES, SHARD_BYTES = 13, 8_000_000, 2_000_000
#: Share of hit words from which a document is contaminated: 1 in CLEAN_BELOW.
CLEAN_BELOW = 20

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: Lower-cases A-Z and turns what is not part of a word into a space.
TO_WORDS = bytes(c if c in _WORD else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TO_WORDS).split()


def _packing(words: int) -> tuple[int, int]:
    """Bits of a word's number, and words in a 64-bit key."""
    bits = max(1, int(words).bit_length())
    return bits, 63 // bits


def packed(numbers: np.ndarray, bits: int, per_key: int) -> np.ndarray:
    """For each place the next `per_key` numbers as one key, 0 from the first 0 on; a key of 0 after the last place."""
    padded = np.concatenate([numbers, np.zeros(per_key, numbers.dtype)]).astype(np.int64)
    n = len(numbers)
    key, alive = np.zeros(n + 1, np.int64), np.ones(n, bool)
    for j in range(per_key):
        word = padded[j : j + n]
        alive &= word > 0
        key[:n] = key[:n] << bits | np.where(alive, word, 0)
    return key


def suffix_array(key: np.ndarray, bits: int, per_key: int) -> np.ndarray:
    """Starts of all suffixes that aren't empty, in the order of their words up to the first 0; key: of every place."""
    starts = np.flatnonzero(key)
    order = starts[np.argsort(key[starts], kind="stable")]
    if not len(order):
        return order
    sorted_ = key[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    size = np.diff(np.r_[first, len(order)])
    #: One more than where the suffix's group begins; 0 for an empty suffix. Whether it goes on behind what is compared.
    rank, goes_on = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    rank[order] = np.repeat(first + 1, size)
    goes_on[order] = (sorted_ & ((1 << bits) - 1)) > 0
    places = np.flatnonzero(np.repeat(size > 1, size) & goes_on[order])
    length = per_key
    while len(places):
        at = order[places]
        behind = np.minimum(at + length, len(key) - 1)
        own, next_, open_ = rank[at], rank[behind], goes_on[behind]
        by = np.lexsort((next_, own))
        at, own, next_, open_ = at[by], own[by], next_[by], open_[by]
        order[places] = at
        first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (next_[1:] != next_[:-1])])
        size = np.diff(np.r_[first, len(at)])
        rank[at], goes_on[at] = np.repeat(places[first] + 1, size), open_
        places = places[np.repeat(size > 1, size) & open_]
        length *= 2
    return order


class Shard:
    """The suffix array of a sequence of word numbers, and searches in it."""

    def __init__(self, numbers: np.ndarray, words: int) -> None:
        self.bits, self.per_key = _packing(words)
        self.key = packed(numbers, self.bits, self.per_key)
        self.order = suffix_array(self.key, self.bits, self.per_key)
        self.first_keys = self.key[self.order]

    def narrow(self, low: np.ndarray, high: np.ndarray, behind: int, wanted: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Of ranges of suffixes with equal first `behind` words, those parts whose next `words` words are as in wanted."""
        shift = self.bits * (self.per_key - words)
        wanted = wanted >> shift
        if not behind:
            keys = self.first_keys >> shift
            return np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")

        def bound(after: bool) -> np.ndarray:
            a, b = low.copy(), high.copy()
            while (open_ := np.flatnonzero(a < b)).size:
                middle = (a[open_] + b[open_]) // 2
                keys = self.key[np.minimum(self.order[middle] + behind, len(self.key) - 1)] >> shift
                less = keys <= wanted[open_] if after else keys < wanted[open_]
                a[open_[less]] = middle[less] + 1
                b[open_[~less]] = middle[~less]
            return a

        return bound(False), bound(True)

    def ranges(self, keys: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with the `length` words at place `at` of a text with these keys."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.order))
        for done in range(0, int(length.max(initial=0)), self.per_key):
            for words in range(1, self.per_key + 1):
                of = (length - done >= self.per_key) if words == self.per_key else (length - done == words)
                if (k := np.flatnonzero(of & (low < high))).size:
                    low[k], high[k] = self.narrow(low[k], high[k], done, keys[at[k] + done], words)
        return low, high

    def deepest(self, keys: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(longest match in words, a place of it or -1) of the suffixes of up to `length` words at `at`."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.order))
        best, place = np.zeros(len(at), np.int64), np.full(len(at), -1)
        active, done = np.arange(len(at)), 0
        while active.size:
            going = np.zeros(len(at), bool)
            left = active
            for words in range(self.per_key, 0, -1):
                k = left[length[left] - done >= words]
                if not k.size:
                    continue
                a, b = self.narrow(low[k], high[k], done, keys[at[k] + done], words)
                found = a < b
                hit = k[found]
                low[hit], high[hit], best[hit] = a[found], b[found], done + words
                place[hit] = self.order[a[found]]
                going[hit] = words == self.per_key
                left = np.setdiff1d(left, hit)
            active, done = np.flatnonzero(going), done + self.per_key
        return best, place


class Benchmark:
    """A block of items: its words, its different texts, their suffixes, and the items that hold each text."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW) -> None:
        ids: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            if found := tuple(words(text)):
                ids.setdefault(found, set()).add(item)
        self.items = [sorted(x) for x in ids.values()]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for t in ids for w in t}), 1)}
        flat, sizes = [], np.array([len(t) for t in ids], np.int64)
        for t in ids:
            flat += [self.vocabulary[w] for w in t]
            flat.append(0)
        self.keys = packed(np.array(flat, np.int32), *_packing(len(self.vocabulary)))
        begins = np.cumsum(sizes + 1) - sizes - 1
        #: Of each suffix its text, its offset in it, its place among the keys, its words.
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.offset = ranges(np.zeros(len(sizes), np.int64), sizes)
        self.place = begins[self.text] + self.offset if len(sizes) else np.zeros(0, np.int64)
        self.left = sizes[self.text] - self.offset if len(sizes) else np.zeros(0, np.int64)
        #: Words of a window of each text, and the suffixes that begin one.
        self.window = np.minimum(window, sizes)
        self.begin_window = np.flatnonzero(self.left >= self.window[self.text]) if len(sizes) else np.zeros(0, np.int64)

    def number(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, a 0 after each; where each begins."""
        get, flat = self.vocabulary.get, []
        begins = [0]
        for t in texts:
            flat += map(get, t)
            flat.append(None)
            begins.append(len(flat))
        return np.array([x or 0 for x in flat], np.int32), np.array(begins)

    def shard(self, texts: list[list[bytes]]) -> tuple[Shard, np.ndarray]:
        numbers, begins = self.number(texts)
        return Shard(numbers, len(self.vocabulary)), begins

    def matches(self, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """(start, suffix) of every occurrence of every window of the benchmark."""
        of = self.begin_window
        low, high = shard.ranges(self.keys, self.place[of], self.window[self.text[of]])
        return shard.order[ranges(low, high - low)], np.repeat(of, high - low)


def longest(start: np.ndarray, text: np.ndarray, offset: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of windows on one diagonal of one text: first start and words, for each run."""
    order = np.lexsort((start, start - offset, text))
    start, text, diagonal, length = start[order], text[order], (start - offset)[order], length[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (diagonal[1:] != diagonal[:-1]) | (start[1:] != start[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    return start[first], start[last] + length[last] - start[first]


def judge(blocks, texts: list[bytes | None]) -> dict[str, list]:
    """Columns for a shard of documents, against every block of the benchmark."""
    split = [words(t) for t in texts]
    n = len(split)
    begins = np.cumsum([0, *(len(t) + 1 for t in split)])
    covered, items = np.zeros(begins[-1] + 1, np.int64), [set() for _ in range(n)]
    best, best_at = np.zeros(n, np.int64), np.full(n, -1)
    for block in blocks:
        shard, _ = block.shard(split)
        start, suffix = block.matches(shard)
        if not len(start):
            continue
        text = block.text[suffix]
        length = block.window[text]
        np.add.at(covered, start, 1)
        np.add.at(covered, start + length, -1)
        doc = np.searchsorted(begins, start, "right") - 1
        for d, t in np.unique(np.stack([doc, text], 1), axis=0).tolist():
            items[d].update(block.items[t])
        run_at, run = longest(start, text, block.offset[suffix], length)
        doc = np.searchsorted(begins, run_at, "right") - 1
        for k in np.lexsort((-run_at, run)).tolist():
            if run[k] >= best[doc[k]]:
                best[doc[k]], best_at[doc[k]] = run[k], run_at[k] - begins[doc[k]]
    total = np.diff(begins) - 1
    sums = np.r_[0, np.cumsum(np.cumsum(covered) > 0)]
    hit = sums[begins[1:]] - sums[begins[:-1]]
    return {
        "n_words": total,
        "n_hit": hit,
        "n_items": [len(x) for x in items],
        "items": [sorted(x) for x in items],
        "contaminated": (hit > 0) & (CLEAN_BELOW * hit >= total),
        "longest_match": best,
        "longest_at": best_at,
    }


def _shards(batches, at: int):
    """Parts of batches with about SHARD_BYTES of text, and their texts."""
    for batch in released(batches):
        texts, begin, size = list(utf8(batch.column(at).cast(pa.string()))), 0, 0
        for k, text in enumerate(texts):
            size += len(text or b"")
            if size >= SHARD_BYTES or k + 1 == len(texts):
                yield batch.slice(begin, k + 1 - begin), texts[begin : k + 1]
                begin, size = k + 1, 0


SCHEMA = "n_words bigint, n_hit bigint, n_items bigint, items array<string>, contaminated boolean, longest_match bigint, longest_at bigint"


def _blocks(benchmark: DataFrame):
    """A function that gives the blocks of the benchmark on an executor."""
    spark = benchmark.sparkSession
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")
    ).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n = math.ceil(size / BLOCK_BYTES)
    if n <= 1:
        value = spark.sparkContext.broadcast(Benchmark([(i, t.encode()) for i, t in rows.collect()]))
        return lambda: [value.value]
    folder = new_path(spark, "benchmark")
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        files.write(f"{folder}/{k}", pickle.dumps(Benchmark([(i, t.encode()) for i, t in part])))
    return lambda: (pickle.loads(files.read(f"{folder}/{k}")) for k in range(n))


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and the columns of SCHEMA for every row of docs; one pass over docs, no shuffle."""
    prepare(docs.sparkSession)
    blocks, schema = _blocks(benchmark), arrow_schema("doc_id bigint, " + SCHEMA)

    def judged(batches):
        for part, texts in _shards(batches, 1):
            columns = {"doc_id": part.column(0)} | judge(blocks(), texts)
            yield pa.RecordBatch.from_arrays([as_arrow(columns[f.name], f.type) for f in schema], schema=schema)

    return _narrow(docs).mapInArrow(judged, "doc_id bigint, " + SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    prepare(docs.sparkSession)
    blocks, schema, at = _blocks(benchmark), docs.schema, docs.columns.index("text")

    def clean(batches):
        for part, texts in _shards(batches, at):
            yield part.filter(pa.array(~judge(blocks(), texts)["contaminated"]))

    return docs.mapInArrow(clean, schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """item_id, item_word, n_words, doc_id, doc_word: the longest verbatim match of every benchmark suffix that has one.

    A suffix is an item from its item_word-th word on; matches of fewer than `least` words are left out. Of equally long
    matches that with the smallest (doc_id, doc_word) among the shards' own is given; a null doc_id comes first.
    """
    prepare(docs.sparkSession)
    blocks = _blocks(benchmark)
    kinds = "item_id string, item_word bigint, n_words bigint, doc_id bigint, doc_word bigint"
    schema = arrow_schema(kinds)

    def searched(batches):
        for part, texts in _shards(batches, 1):
            split = [words(t) for t in texts]
            for block in blocks():
                shard, begins = block.shard(split)
                n, place = shard.deepest(block.keys, block.place, block.left)
                found = np.flatnonzero(n >= max(1, least))
                doc = np.searchsorted(begins, place[found], "right") - 1
                held = [block.items[t] for t in block.text[found].tolist()]
                times = [len(x) for x in held]
                columns = [
                    [i for x in held for i in x], np.repeat(block.offset[found], times), np.repeat(n[found], times),
                    part.column(0).take(pa.array(np.repeat(doc, times))), np.repeat(place[found] - begins[doc], times),
                ]
                yield pa.RecordBatch.from_arrays([as_arrow(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    found = _narrow(docs).mapInArrow(searched, kinds)
    best = F.min(F.struct((-F.col("n_words")).alias("n"), "doc_id", "doc_word")).alias("best")
    found = found.groupBy("item_id", "item_word").agg(best)
    return found.select("item_id", "item_word", (-F.col("best.n")).alias("n_words"), "best.doc_id", "best.doc_word")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest: items_sha256 in place of the items."""
    found = contamination(docs, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated", "longest_match", "longest_at",
    )
