"""Language identification with a string kernel.

A text is the set of its byte n-grams of 1 to 4 bytes (A-Z lower-cased, all ASCII that is no letter one space), each
n-gram hashed to one of SLOTS slots. The kernel of two texts is |X and Y| / sqrt(|X| |Y|), the blended-spectrum
presence kernel. LANDMARKS texts of the training sample span the Nyström approximation: features are the kernel values
against them times K^(-1/2). One ridge regression for each language against the rest is fitted on those features;
with the Nyström factor multiplied in, a batch is scored by two matrix products: presence x landmarks, kernel x weights.

Learning takes about PER_LANGUAGE texts of each language, chosen by a hash of the id from all rows that may be learned
from; every text is scored whole.

Defined results: `und` with score 0 for a null or empty text, a text without letters, or where nothing could be learned. Rows
with a null lang are not learned from but are scored; a null doc_id is scored and never learned from; rows with the
same doc_id are scored one by one; of languages with equal values the first by name wins. The score is the winning regression's value, (1 + value) / 2 cut to [0, 1].
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, map_arrow, prepare, released, utf8

GRAMS, SLOTS, PER_LANGUAGE, LANDMARKS, RIDGE, EPS = 4, 1 << 16, 400, 96, 1e-2, 1e-6
#: What a document has to share with a landmark for the pipeline to keep it. On sf0.1 a thousandth of all documents share
#: less than 0.62; random letters 0.14 to 0.44 (0.6 in texts of 30,000), Finnish 0.40, Dutch 0.55, Russian 0.14, Chinese 0.11.
LEAST_SHARED = 0.6
#: Languages that one model can tell apart.
MAX_LANGUAGES = 500
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPACES = re.compile(rb" {2,}")
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: bytes | None) -> bool:
    return text is not None and _LETTER.search(text.decode()) is not None


def presence(text: bytes, out: np.ndarray) -> None:
    """Set out[slot] for each n-gram of the text."""
    codes = np.frombuffer(b" " + _SPACES.sub(b" ", text.translate(_NORMAL)) + b" ", np.uint8).astype(np.uint32)
    gram = codes
    for n in range(1, GRAMS + 1):
        if n > 1:
            if len(gram) < 2:
                return
            gram = (gram[:-1] << np.uint32(8)) | codes[n - 1 :]
        out[((gram ^ np.uint32(n * 0x1BD1E995)) * np.uint32(0x9E3779B1)) >> np.uint32(16)] = 1


def presence_matrix(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), SLOTS), np.uint8)
    for row, text in zip(out, texts, strict=True):
        presence(text, row)
    return out


def unpacked(rows: np.ndarray) -> np.ndarray:
    """Presence rows of packed ones; others as they are."""
    return rows if rows.shape[1] == SLOTS else np.unpackbits(rows, axis=1)


class KernelModel:
    """fit() on presence rows, best packed (of which it unpacks a part at a time); scores() of presence rows."""

    def fit(self, rows: np.ndarray, labels: list[str]) -> KernelModel:
        self.languages = sorted(set(labels))
        if not self.languages:
            return self
        of = np.array([self.languages.index(x) for x in labels])
        each = -(-LANDMARKS // len(self.languages))
        chosen = np.concatenate([np.flatnonzero(of == k)[:each] for k in range(len(self.languages))])
        marks = unpacked(rows[chosen])
        self.columns = np.flatnonzero(marks.any(axis=0))
        self.marks = np.ascontiguousarray(marks[:, self.columns].T.astype(np.float32))
        self.sizes = np.sqrt(marks.sum(axis=1, dtype=np.float64))
        gram = self.kernel(marks)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        keep = values > EPS * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        features = np.concatenate([self.kernel(unpacked(rows[k : k + 128])) for k in range(0, len(rows), 128)]) @ root
        features = np.c_[features, np.ones(len(features))]
        target = np.where(of[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        weight = 1.0 / np.bincount(of)[of]
        weight /= weight.mean()
        left = (features * weight[:, None]).T @ features + RIDGE * len(rows) / 100 * np.eye(features.shape[1])
        solved = np.linalg.solve(left, (features * weight[:, None]).T @ target)
        self.weights, self.bias = root @ solved[:-1], solved[-1]
        return self

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(1, rows.sum(axis=1, dtype=np.float64)))
        return (rows[:, self.columns].astype(np.float32) @ self.marks) / size[:, None] / self.sizes

    def scores(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the regressions, the largest share of n-grams in common with a landmark, of those of the one that has fewer)."""
        kernel, n = self.kernel(rows), np.maximum(1, rows.sum(axis=1, dtype=np.float64))[:, None]
        common = kernel * np.sqrt(n) * self.sizes
        return kernel @ self.weights + self.bias, (common / np.minimum(n, self.sizes**2)).max(axis=1)


def train(docs: DataFrame) -> KernelModel:
    """From text and lang of documents whose fold is not held out."""
    ok = docs.where((F.col("fold") != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    picked = bounded_sample(ok, "doc_id", "lang", PER_LANGUAGE, "language")

    def rows(batch: pa.RecordBatch) -> dict:
        texts = list(utf8(batch.column(1)))
        good = [has_letter(t) for t in texts]
        packed = np.packbits(presence_matrix([t for t, g in zip(texts, good, strict=True) if g]), axis=1)
        return {"doc_id": batch.column(0).filter(pa.array(good)), "lang": batch.column(2).filter(pa.array(good)), "bits": pa.array([r.tobytes() for r in packed], pa.binary())}

    found = sorted(map(tuple, map_arrow(picked.select("doc_id", "text", "lang"), rows, "doc_id bigint, lang string, bits binary").collect()))
    if len({r[1] for r in found}) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    bits = np.frombuffer(b"".join(r[2] for r in found), np.uint8).reshape(len(found), SLOTS // 8)
    return KernelModel().fit(bits, [r[1] for r in found])


def _predict(model: KernelModel, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, largest share of n-grams in common with a landmark) of each text."""
    names, scores, shared = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    if model.languages:
        good = [k for k, t in enumerate(texts) if has_letter(t)]
        for at in range(0, len(good), 128):
            part = good[at : at + 128]
            value, shared[part] = model.scores(presence_matrix([texts[k] for k in part]))
            best = value.argmax(axis=1)
            scores[part] = np.clip((1 + value[np.arange(len(part)), best]) / 2, 0, 1)
            for k, b in zip(part, best, strict=True):
                names[k] = model.languages[b]
    return names, scores, shared


def _prepared(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"), fold("doc_id", FOLDS).alias("fold"),
    )


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, shared of every row; shared: of n-grams, with the landmark that has most in common."""
    docs = _prepared(docs)
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    held = docs.select("doc_id", "text", F.coalesce(F.col("fold") == HELD_OUT, F.lit(False)).alias("held_out"))

    def scored(batch: pa.RecordBatch) -> dict:
        names, scores, shared = _predict(model.value, list(utf8(batch.column(1))))
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": names, "score": scores, "shared": shared}

    return map_arrow(held, scored, "doc_id bigint, held_out boolean, lang_pred string, score double, shared double")


def keep_identified(docs: DataFrame, least_shared: float = LEAST_SHARED) -> DataFrame:
    """The rows whose language is known, with all their columns.

    `und` goes, and so does a text that shares less than `least_shared` of its n-grams (or of the landmark's, where that has
    fewer) with any landmark: it is in none of the languages learned. Rows with the same doc_id are judged one by one; an
    empty table stays empty; other columns may have any name.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(_prepared(docs)))
    at = docs.columns.index("text")

    def kept(batches):
        for batch in released(batches):
            if batch.num_rows:
                names, _, shared = _predict(model.value, list(utf8(batch.column(at).cast(pa.string()))))
                yield batch.filter(pa.array((np.array(names) != UNKNOWN) & (shared >= least_shared)))

    return docs.mapInArrow(kept, docs.schema)
