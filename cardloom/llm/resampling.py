"""Importance resampling towards a target's word distribution.

Words are known by integers from a dictionary, runs of words by tuples of those integers, and every distinct tuple's
bytes are put together and hashed once, after which counts are joined back by integer. A dictionary belongs to a task:
one for all documents would need a shuffle of every word, and hashes come out the same. It starts anew beyond
DICTIONARY_BYTES, which changes no result. Texts are cut once; what is kept of them is a row of (bucket, count) pairs.

Defined for odd rows: null and empty texts, and texts without a word, have no features and weight 0; a null doc_id draws
as the empty name does and stands before others of the same score; equal rows have ranks of their own; other columns,
whatever their names, aren't read; empty tables give empty results, an empty target takes all buckets as equally rare.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, released, utf8, write_out
from .numbering import counted, numbered, told_apart

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of words that a task's dictionary holds before it starts anew.
DICTIONARY_BYTES = 32 << 20
#: Words worked on at once, and bytes cut at once.
FLUSH_WORDS = 1 << 19
PART = 1 << 20

#: Letters a-z, digits and bytes from 0x80 on belong to words, A-Z to the words of their small letters, all else is space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FEATURES = "doc_id bigint, n_words bigint, n_features bigint, buckets array<int>, counts array<bigint>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


class Dictionary(dict):
    """Word to integer; an unknown word gets the next one."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.size = 0
        self.hashed = np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        self.size += len(word) + 100
        return n

    def checksums(self) -> np.ndarray:
        """crc32 of each word; those known before aren't hashed again."""
        if new := self.words[len(self.hashed) :]:
            self.hashed = np.concatenate([self.hashed, np.fromiter(map(zlib.crc32, new), np.int64, len(new))])
        return self.hashed


def word_ids(text: bytes, known: Dictionary) -> np.ndarray:
    """The integers of all words of a text, cut in parts that end between words."""
    data, out, at = text.translate(_WORDS), [], 0
    while at < len(data):
        end = len(data) if len(data) - at <= PART else data.rfind(b" ", at, at + PART) + 1 or data.find(b" ", at + PART) + 1 or len(data)
        words = data[at:end].split()
        out.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def bucket_counts(ids: list[np.ndarray], known: Dictionary, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count), in this order, of the features of some documents: runs of 1 to `longest` words."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    found, codes, at = [doc * buckets + known.checksums()[flat] % buckets], flat, np.arange(len(flat))
    for n in range(2, longest + 1):
        # a run is the code of the run before, and a word more of the same document
        inside = at + n - 1 < len(flat)
        inside[inside] = doc[at[inside]] == doc[at[inside] + n - 1]
        at, codes = at[inside], codes[inside]
        _, first, codes = np.unique(codes * max(1, len(known.words)) + flat[at + n - 1], return_index=True, return_inverse=True)
        runs = (b" ".join(known.words[w] for w in flat[at[i] : at[i] + n]) for i in first)
        hashed = np.fromiter(map(zlib.crc32, runs), np.int64, len(first)) % buckets
        found.append(doc[at] * buckets + hashed[codes])
    keys, counts = np.unique(np.concatenate(found), return_counts=True)
    return keys // buckets, keys % buckets, counts


def features(docs: DataFrame, text: str = "text", key: str | None = "doc_id", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """A row a document: doc_id, n_words, n_features (with repeats), and its buckets with their counts."""
    prepare(docs.sparkSession)

    def flush(rows: list, known: Dictionary) -> pa.RecordBatch:
        ids = [x for _, x in rows]
        doc, bucket, count = bucket_counts(ids, known, longest, buckets)
        words = np.array([len(x) for x in ids], np.int64)
        total = sum(np.maximum(words - n, 0) for n in range(longest))
        offsets = pa.array(np.searchsorted(doc, np.arange(len(rows) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((bucket, pa.int32()), (count, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array(words), pa.array(total), *lists], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows, size = Dictionary(), [], 0
        for batch in released(batches):
            for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                rows.append((i, word_ids(t or b"", known)))
                size += len(rows[-1][1])
                if size >= FLUSH_WORDS or len(rows) >= FLUSH_WORDS // 64:
                    yield flush(rows, known)
                    rows, size = [], 0
                    if known.size > DICTIONARY_BYTES:
                        known = Dictionary()
        if rows:
            yield flush(rows, known)

    name = F.col(key).cast("bigint") if key else F.lit(None).cast("bigint")
    return docs.select(name.alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, FEATURES)


def bucket_totals(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all documents fall into each bucket. A task sends a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    return found.select("buckets", "counts").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): thousandths of the log ratio of the bucket's smoothed share of the target and of the corpus."""
    all_s, all_t = (x.agg(F.sum("n")).first()[0] or 0 for x in (corpus, target))
    s = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").fillna(0)
    more = lambda c, by: F.col(c).cast("double") + F.lit(float(by))
    ratio = (more("t", 1) * F.lit(float(all_s + buckets))) / (more("s", 1) * F.lit(float(all_t + buckets)))
    return every.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("bigint").alias("gain"))


def weights(found: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of a document's features; 0 without any.

    The gains are as many numbers as there are buckets, a parameter, and go to every task.
    """
    of = np.zeros(buckets, np.int64)
    for bucket, value in gain.collect():
        of[bucket] = value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = np.concatenate([[0], np.cumsum(of[lists.flatten().to_numpy()] * batch.column(4).flatten().to_numpy())])
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            n = batch.column(2).to_numpy()
            mean = (values[at[1:]] - values[at[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(mean)], names=["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(key: str, seed: int) -> Column:
    """Thousandths of a Gumbel draw that depends on the seed and the key alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score, and rank among the drawn (null for the others).

    Of the documents of enough words the `percent` highest scores are drawn, which is a draw without replacement in
    proportion to exp(weight / 1000). Scores are whole numbers between limits that the logarithms set, about 10^5 of
    them: their counts go to the driver for the lowest score drawn, and only documents from it on are sorted.
    """
    found = write_out(features(docs, text, key, longest, buckets), "features")
    totals = [write_out(bucket_totals(x, buckets), "totals") for x in (found, features(target, target_text, None, longest, buckets))]
    gain = gains(*totals, buckets)
    scored = write_out(weights(found, gain, buckets).withColumn("score", F.col("weight") + noise("doc_id", seed)), "scores")
    enough = F.col("n_words") >= least_words
    counts = sorted(map(tuple, scored.where(enough).groupBy("score").count().collect()), reverse=True)
    drawn = sum(n for _, n in counts) * percent // 100
    lowest, above = None, 0
    for value, n in counts:
        if above >= drawn:
            break
        lowest, above = value, above + n
    chosen = enough & (F.col("score") >= F.lit(lowest)) if lowest is not None else F.lit(False)
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.col("n_words"), F.col("n_features"), F.col("weight")]
    ranked = told_apart(numbered(counted(scored.where(chosen)), order)).withColumn("rank", F.when(F.col("position") < drawn, F.col("position") + 1)).drop("position")
    return scored.where(~chosen).withColumn("rank", F.lit(None).cast("bigint")).unionByName(ranked)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op12: single words, 10,000 buckets, a tenth of the documents of 20 words and more."""
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


def sql() -> str:
    from .sharding import bytes_sql, crc32_sql, crc32_table_sql

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""with {crc32_table_sql()},
docs as (select row_number() over () as r, doc_id, {words("text")} as w from documents),
bench as (select {words("text")} as w from benchmark),
d as (select r, word, count(*) as n from (select r, unnest(w) as word from docs) x group by all),
b as (select word, count(*) as n from (select unnest(w) as word from bench) x group by all),
known as (select word, {crc32_sql(bytes_sql("word"))} % {BUCKETS} as bucket from (select word from d union select word from b) x, crc32_table),
dc as (select bucket, sum(n)::double as s from d join known using (word) group by bucket),
bc as (select bucket, sum(n)::double as t from b join known using (word) group by bucket),
totals as (select (select coalesce(sum(s), 0) from dc)::double as ss, (select coalesce(sum(t), 0) from bc)::double as tt),
gain as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + {BUCKETS}) / ((coalesce(s, 0) + 1) * (tt + {BUCKETS}))))::bigint as gain from dc full join bc using (bucket), totals),
weights as (select r, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n))::bigint as weight from d join known using (word) join gain using (bucket) group by r),
scored as (select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8) as bigint) + 0.5) / 4294967296.0)))::bigint as score from docs left join weights using (r)),
ranked as (select *, row_number() over (order by n_features < {LEAST_WORDS}, score desc, doc_id nulls first) as k, count(*) filter (n_features >= {LEAST_WORDS}) over () as n from scored)
select doc_id, n_features, weight, score, if(k <= n * {PERCENT} // 100, k, null)::bigint as rank from ranked"""
