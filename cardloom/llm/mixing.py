"""Mixing sources to target weights with soft membership.

Domains come from a labelled table: (doc_id, domain), for the query the quality and toxicity that `labels` marks (good,
poor, toxic). A naive Bayes classifier over hashed words, learned from a bounded sample of labelled texts and tempered on
a part of it that it didn't count, gives every document posteriors p over the domains. Labels whose domain has no target
are one more class, OTHER, so that they aren't counted as something else. Document rates r >= 0 (how often a document is
to be read) are found by projected gradient descent on the squares

    sum over target domains d of ((sum over documents i of r_i n_i p_id) / N - w_d)^2

with n_i the document's words, N all words and w the target weights: expected words of each domain match their
targets. Rates start at 1; a step moves each along its gradient, measured in the second moments of the posteriors of
the documents whose rate isn't 0 (damped by DAMPING of the largest, so that directions in which the posteriors hardly differ
are moved slowly), and is projected to r >= 0. A step that makes the squares larger is taken back and halved. The descent
ends where the totals are within CLOSE of the targets or where a step gains less than GAIN of what is left: then the
targets can't be reached with these posteriors and the rates are the nearest. It raises where neither happens in
STEPS steps. A step needs a few numbers for each domain from all documents; a document's rate is replayed from the steps so far,
so that no state but the posteriors is kept and a lost executor costs nothing but its share of one pass.

Learning takes about PER_DOMAIN texts of each domain, chosen by a hash of the id, and of each text at most LEARN_WORDS
words, spread over the whole text; both bounds hold for the fit alone. Every whole text gets its posteriors from all of
its words.

Defined results: null and empty texts have no words, the domains' shares as posteriors, and a rate all the same;
without any labelled text the posteriors are equal shares; null labels count nowhere, and of repeated labels of an id the
last in the order of the targets, OTHER after them; a null doc_id is mixed and never learned from; rows with the same
doc_id are mixed one by one. A table without words keeps rate 1. Columns of docs may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fresh, hash_share, map_arrow, prepare, released, utf8, write_out
from .shingles import word_hashes

#: Domain and its weight: what the mixed corpus is to hold.
TARGETS = (("good", 0.85), ("poor", 0.075), ("toxic", 0.075))
OTHER = "other"
SLOT_BITS, PER_DOMAIN, LEARN_WORDS, SMOOTH = 16, 2_500, 20_000, 0.02
STEPS, CLOSE, GAIN, DAMPING = 60, 1e-4, 1e-3, 1e-6
_TEMPERATURES = (0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0)


class DomainModel:
    """Posteriors of texts; log-likelihoods of a text of n words are scaled by temperature / sqrt(n)."""

    def __init__(self, domains: list[str], rows: list[tuple[int, bool, np.ndarray]], counts: np.ndarray) -> None:
        """rows: (domain, counted, slots of the text's words)."""
        self.domains = domains
        k = len(domains)
        # without a label of another domain there is no other domain
        seen = (counts + 1) * ((np.array(domains) != OTHER) | (counts > 0))
        self.log_prior = np.log(np.maximum(seen, 1e-300) / seen.sum())
        tally = np.full((k, 1 << SLOT_BITS), SMOOTH)
        for domain, counted, slots in rows:
            if counted:
                tally[domain] += np.bincount(slots, minlength=1 << SLOT_BITS) / np.sqrt(max(1, len(slots)))
        self.table = np.log(tally / tally.sum(axis=1, keepdims=True)).T.copy()
        self.table -= self.table.mean(axis=1, keepdims=True)
        self.temperature = _TEMPERATURES[0]
        held = [(d, s) for d, counted, s in rows if not counted and len(s)]
        if held:
            sums = np.array([self.table[s].sum(axis=0) for _, s in held])
            sizes, of = np.array([len(s) for _, s in held]), np.array([d for d, _ in held])
            weight = (counts / np.maximum(1, np.bincount(of, minlength=k)))[of]
            losses = [-(weight * np.log(self._posterior(sums, sizes, t)[np.arange(len(of)), of] + 1e-12)).sum() for t in _TEMPERATURES]
            self.temperature = _TEMPERATURES[int(np.argmin(losses))]

    def _posterior(self, sums: np.ndarray, sizes: np.ndarray, temperature: float) -> np.ndarray:
        value = self.log_prior + temperature * sums / np.sqrt(np.maximum(1, sizes))[:, None]
        value = np.exp(value - value.max(axis=1, keepdims=True))
        return value / value.sum(axis=1, keepdims=True)

    def posteriors(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(words, posteriors) of texts."""
        words, begins = word_hashes(texts)
        sizes = np.diff(begins)
        owner = np.repeat(np.arange(len(texts)), sizes)
        slots = (words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        sums = np.stack([np.bincount(owner, self.table[slots, d], len(texts)) for d in range(len(self.domains))], axis=1)
        return sizes, self._posterior(sums, sizes, self.temperature)


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labels(doc_id, quality, toxic): toxic, else poor or good by quality; null where neither is known."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


def train(docs: DataFrame, labels: DataFrame, targets: list[str]) -> DomainModel:
    domains = [*targets, OTHER]
    known = F.array_position(F.array(*map(F.lit, targets)), F.col("domain").cast("string"))
    number = F.when(F.col("domain").isNotNull(), F.when(known > 0, known).otherwise(len(domains)))
    # of several labels of an id the last domain in the list counts
    labelled = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(number).alias("domain")).where("domain > 0")
    counts = np.zeros(len(domains))
    for k, n in labelled.groupBy("domain").count().collect():
        counts[int(k) - 1] = n
    picked = bounded_sample(labelled, "doc_id", "domain", PER_DOMAIN, "mixing")
    found = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "domain", (hash_share("doc_id", "temper") < 0.7).alias("counted"), "text")

    def slots(batch: pa.RecordBatch) -> dict:
        words, begins = word_hashes(list(utf8(batch.column(3))))
        data = (words >> np.uint64(64 - SLOT_BITS)).astype(np.uint16)
        parts = [data[a:b][:: -(-(b - a) // LEARN_WORDS) or 1].tobytes() for a, b in zip(begins.tolist(), begins[1:].tolist())]
        return {"doc_id": batch.column(0), "domain": batch.column(1), "counted": batch.column(2), "slots": pa.array(parts, pa.binary())}

    rows = sorted(map(tuple, map_arrow(found, slots, "doc_id bigint, domain bigint, counted boolean, slots binary").collect()))
    return DomainModel(domains, [(int(d) - 1, c, np.frombuffer(s, np.uint16).astype(np.int64)) for _, d, c, s in rows], counts)


def replay(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates of documents with posteriors p after the steps."""
    rate = np.ones(len(p))
    for g in steps:
        rate = np.maximum(0.0, rate - p @ g)
    return rate


def fit_rates(mixed: DataFrame, weights: np.ndarray) -> np.ndarray:
    """All steps, from (n_words, posterior) of every document; of the posteriors only the targets' part counts."""
    steps = np.zeros((0, k := len(weights)))
    total = mixed.agg(F.sum("n_words")).first()[0] or 0
    if not total:
        return steps
    kinds = "domain int, words double, " + ", ".join(f"m{d} double" for d in range(k))

    def measure(past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(totals less targets, second moments) at the rates that the steps lead to."""

        def sums(batch: pa.RecordBatch) -> dict:
            n = batch.column(0).to_numpy().astype(float)
            p = batch.column(1).flatten().to_numpy().reshape(len(n), -1)[:, :k]
            rate = replay(p, past)
            moments = (p * (n * (rate > 0))[:, None]).T @ p
            return {"domain": np.arange(k), "words": (rate * n) @ p} | {f"m{d}": moments[:, d] for d in range(k)}

        got = map_arrow(mixed.select("n_words", "posterior"), sums, kinds).groupBy("domain").sum().drop("sum(domain)")
        rows = np.array(sorted(map(tuple, got.collect())))[:, 1:] / total
        return rows[:, 0] - weights, rows[:, 1:]

    off, moments = measure(steps)
    for _ in range(STEPS):
        if np.abs(off).max() < CLOSE:
            return steps
        step, left = np.linalg.solve(moments + DAMPING * np.linalg.norm(moments, 2) * np.eye(k), off), np.square(off).sum()
        while True:
            tried = np.vstack([steps, np.round(step, 9)])
            new_off, new_moments = measure(tried)
            gained = left - np.square(new_off).sum()
            if gained > 0 or np.abs(step).max() < 1e-6:
                break
            step = step / 2
        if gained > 0:
            steps, off, moments = tried, new_off, new_moments
        if gained < GAIN * left:
            return steps
    raise RuntimeError(f"rates did not settle in {STEPS} steps; the totals are off by {np.abs(off).max():.2g}")


def mix(docs: DataFrame, labels: DataFrame, targets=TARGETS) -> DataFrame:
    """doc_id, n_words, posterior (in the order of targets, OTHER last) and rate of every row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    domains, weights = [t[0] for t in targets], np.array([t[1] for t in targets], float)
    weights = weights / weights.sum()
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(train(narrow, labels, domains))

    def judged(batch: pa.RecordBatch) -> dict:
        sizes, p = model.value.posteriors(list(utf8(batch.column(1))))
        return {"doc_id": batch.column(0), "n_words": sizes, "posterior": pa.array(list(p), pa.list_(pa.float64()))}

    kinds = "doc_id bigint, n_words bigint, posterior array<double>"
    mixed = write_out(map_arrow(narrow, judged, kinds), "posteriors")
    steps = fit_rates(mixed, weights)

    def rated(batch: pa.RecordBatch) -> dict:
        p = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)[:, : len(weights)]
        return dict(zip(("doc_id", "n_words", "posterior"), batch.columns, strict=True)) | {"rate": replay(p, steps)}

    return map_arrow(mixed, rated, kinds + ", rate double")


def mixing_report(docs: DataFrame, labels: DataFrame, targets=TARGETS) -> DataFrame:
    """doc_id, n_words, rate and a posterior of each domain and of OTHER, for every row of docs."""
    out = mix(docs, labels, targets)
    return out.select("doc_id", "n_words", "rate", *(F.col("posterior")[k].alias(f"p_{name}") for k, name in enumerate([*(n for n, _ in targets), OTHER])))


def apply_rates(docs: DataFrame, labels: DataFrame, targets=TARGETS) -> DataFrame:
    """docs as mixed: each row as often as its rate says, the fraction decided by a hash of the id; all columns kept."""
    spark = docs.sparkSession
    prepare(spark)
    domains, weights = [t[0] for t in targets], np.array([t[1] for t in targets], float)
    weights = weights / weights.sum()
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(train(narrow, labels, domains))

    def judged(batch: pa.RecordBatch) -> dict:
        sizes, p = model.value.posteriors(list(utf8(batch.column(0))))
        return {"n_words": sizes, "posterior": pa.array(list(p), pa.list_(pa.float64()))}

    steps = fit_rates(write_out(map_arrow(narrow.select("text"), judged, "n_words bigint, posterior array<double>"), "posteriors"), weights)
    at, schema, k = docs.columns.index("text"), docs.schema, len(weights)

    def repeated(batches):
        for batch in released(batches):
            if batch.num_rows:
                _, p = model.value.posteriors(list(utf8(batch.column(at).cast(pa.string()))))
                draw = batch.column(batch.num_columns - 1).fill_null(0.0).to_numpy(zero_copy_only=False)
                times = np.floor(replay(p[:, :k], steps) + 1 - draw - 1e-12).astype(int).clip(0)
                rows = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), times)))
                yield pa.RecordBatch.from_arrays(rows.columns[:-1], names=rows.schema.names[:-1])

    return docs.withColumn(fresh(docs, "draw"), hash_share("doc_id", "mix")).mapInArrow(repeated, schema)
