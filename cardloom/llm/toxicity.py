"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text. The ordinary one comes from ordinary text. The toxic one
comes from the stretches of toxic texts whose byte n-grams several toxic texts share and ordinary ones hardly have,
followed by the ordinary dictionary: what both have costs the same with either, so that the difference of two
compressed lengths is what a window has of toxic text. Every window of WINDOW words of every whole text is compressed with both. A text's
largest gain, its mean gain and its share of windows that gain go into a logistic curve, calibrated on labelled texts
that the dictionaries didn't see and weighted back to the labels' true shares; predicted is a score of at least 0.5.

Learning takes about PER_LABEL texts of each label, chosen by a hash of the id from all rows that may be learned from,
of each at most SAMPLE_WINDOWS windows spread over the whole text. Scoring takes every window.

Defined results: null and empty texts are scored as one empty window. Where labels has no row of one of the two
values, every score is the share of toxic labels (0 without labels). A null doc_id is scored and never learned from.
Of repeated labels of an id the largest counts. Rows with the same doc_id are scored one by one.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, map_arrow, prepare, utf8

FOLDS, HELD_OUT = 5, 0
WINDOW, LEVEL, PER_LABEL, SAMPLE_WINDOWS = 10, 9, 2_500, 400
ORDINARY_BYTES, TOXIC_BYTES = 8_192, 3_072
#: A stretch is of n-grams that this share of the toxic sample has (two texts at least), this many times the share of
#: the ordinary sample that has them.
GRAM, SHARED, TIMES = 5, 0.02, 8
#: Of the sample, the part in 10 that the dictionaries are trained on.
FOR_DICTIONARIES = 5
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def windows(text: bytes | None) -> list[bytes]:
    words = (text or b"").translate(_NORMAL).split()
    return [b" ".join(words[k : k + WINDOW]) for k in range(0, len(words), WINDOW)] or [b""]


#: The repeat offsets that end the header of a trained dictionary; what follows is its content.
_HEADER_END = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """The content of a trained dictionary, or the samples themselves where they fit or are too few to train on."""
    plain = b"".join(dict.fromkeys(samples))
    if len(plain) <= size:
        return plain
    try:
        data = zstandard.train_dictionary(size + 256, samples, level=LEVEL).as_bytes()
        return data[data.index(_HEADER_END) + len(_HEADER_END) :]
    except (zstandard.ZstdError, ValueError):
        return plain[-size:]


def _grams(text: bytes) -> list[bytes]:
    return [text[k : k + GRAM] for k in range(len(text) - GRAM + 1)]


def _own_stretches(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The stretches of each toxic text that are made of n-grams of toxic texts."""
    has = Counter(g for t in toxic for g in set(_grams(t)))
    least = max(2, SHARED * len(toxic))
    has = {g: n for g, n in has.items() if n >= least}
    other = Counter(g for t in ordinary for g in set(_grams(t)) if g in has)
    own = {g for g, n in has.items() if n / len(toxic) >= TIMES * other[g] / len(ordinary)}
    out = []
    for text in toxic:
        begin = end = -1
        for k, g in enumerate(_grams(text)):
            if g in own:
                if k > end:
                    out += [text[begin:end]] * (end > begin)
                    begin = k
                end = k + GRAM
        out += [text[begin:end]] * (end > begin)
    return out


class Compressors:
    """Gains of windows: bytes saved by the toxic dictionary over the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        make = zstandard.ZstdCompressionParameters.from_level
        options = make(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.pair = []
        for content in (ordinary, toxic):
            known = zstandard.ZstdCompressionDict(content or bytes(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=options)
            self.pair.append(zstandard.ZstdCompressor(dict_data=known, compression_params=options).compress)

    def features(self, cut: list[bytes]) -> tuple[float, float, float]:
        ordinary, toxic = self.pair
        gains = np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in cut), np.float64, len(cut))
        return float(gains.max()), float(gains.mean()), float((gains > 2).mean())


class ToxicityModel:
    def __init__(self, rows: list[tuple[int, bool, list[bytes]]], counts: dict[int, int]) -> None:
        """rows: (toxic, for the dictionaries, windows); counts: labelled texts by toxic."""
        self.share = counts.get(1, 0) / max(1, sum(counts.values()))
        self.weights = None
        if not all(any(r[0] == k and r[1] == part for r in rows) for k in (0, 1) for part in (False, True)):
            return
        ordinary = [r[2] for r in rows if r[0] == 0 and r[1]]
        toxic = [r[2] for r in rows if r[0] == 1 and r[1]]
        base = _dictionary([b" ".join(t[k : k + 3]) for t in ordinary for k in range(0, len(t), 3)], ORDINARY_BYTES)
        join = lambda cut: b" " + b" ".join(cut) + b" "
        extra = _dictionary(_own_stretches([join(t) for t in toxic], [join(t) for t in ordinary]), TOXIC_BYTES)
        self.dictionaries = (base, extra + base)
        self.fit([r for r in rows if not r[1]], counts)

    def fit(self, rows, counts) -> None:
        pair = Compressors(*self.dictionaries)
        x = np.array([pair.features(r[2]) for r in rows])
        y = np.array([r[0] for r in rows], float)
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = np.c_[(x - self.mean) / self.spread, np.ones(len(x))]
        # weights bring the sample's shares of labels back to those of all labelled texts
        part = np.array([(y == 0).sum(), (y == 1).sum()])
        true = np.array([counts[0], counts[1]]) / sum(counts.values())
        w = (true / part)[y.astype(int)] * len(y)
        beta = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            gradient = x.T @ (w * (p - y)) + 1e-3 * beta
            step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(beta)), gradient)
            beta -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = beta

    def scorer(self):
        if self.weights is None:
            return lambda text: self.share
        pair = Compressors(*self.dictionaries)

        def score(text: bytes | None) -> float:
            x = (np.array(pair.features(windows(text))) - self.mean) / self.spread
            return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30))))

        return score


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """From labels.toxic of the rows whose fold is not held out."""
    toxic = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    toxic = toxic.where(fold("doc_id", FOLDS) != HELD_OUT)
    counts = {r[0]: r[1] for r in toxic.groupBy("toxic").count().collect()}
    # the sample is drawn from the narrow table of labels; of the texts only its own are moved
    picked = bounded_sample(toxic, "doc_id", "toxic", PER_LABEL, "toxicity")
    found = docs.join(F.broadcast(picked), "doc_id").select(
        "doc_id", "text", "toxic", (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(10)) < FOR_DICTIONARIES).alias("part")
    )

    def cut(batch: pa.RecordBatch) -> dict:
        out = []
        for text in utf8(batch.column(1)):
            found = windows(text)
            out.append(b"\n".join(found[:: -(-len(found) // SAMPLE_WINDOWS)]))
        return {"doc_id": batch.column(0), "toxic": batch.column(2), "part": batch.column(3), "text": pa.array(out, pa.binary())}

    rows = sorted(map(tuple, map_arrow(found, cut, "doc_id bigint, toxic int, part boolean, text binary").collect()))
    return ToxicityModel([(t, p, bytes(x).split(b"\n")) for _, t, p, x in rows], counts)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    held = docs.select("doc_id", "text", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"))

    def scored(batch: pa.RecordBatch) -> dict:
        score = model.value.scorer()
        scores = np.array([score(t) for t in utf8(batch.column(1))])
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

    return map_arrow(held, scored, "doc_id bigint, held_out boolean, score double, predicted int")
