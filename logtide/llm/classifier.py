"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

A document is a sparse vector: the hashed words of its whole text, weighted by the root of their counts and scaled
to unit length, and dense statistics of its structure (capitals, punctuation, symbols, digits, repeated lines and
words, line and word lengths) and metadata (length, share of non-ASCII text).  The model adds a weight for each
feature and, for every pair of features, the product of their low-rank factors; all pairs together are scored in
linear time, as ``sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2``.

It is fitted with Adam on the driver, on at most ``max_rows`` labelled rows (a documented bound, chosen by hash);
scoring covers every row, inside the tasks.  Labels, language, source and ids are never inputs of a score.

Defined results: null text counts as empty and is scored; repeated rows are scored alike; with no labelled rows, or
one class only, every score is the (smoothed) share of label 1; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship_package
from .common import pick

_PUNCTUATION = "!?.,;:'\"()-"
_SYMBOLS = "#*$%&|<>=_/\\{}[]@^~+"
N_STATS = 18


def statistics(text: str, words: list[str]) -> list[float]:
    """Structure and metadata of a text."""
    n, w = len(text), len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda k, of: k / of if of else 0.0
    count = lambda chars: sum(map(text.count, chars))
    upper = sum(map(str.isupper, words))
    return [
        np.log1p(n), np.log1p(w), share(sum(map(len, words)), w), share(upper, w), share(len(set(words)), w),
        share(count("!"), w), share(count("?"), w), share(count("|"), w), share(count(_PUNCTUATION), n), share(count(_SYMBOLS), n),
        share(count("0123456789"), n), share(len(text.encode("utf-8", "replace")) - n, n), np.log1p(len(lines)),
        share(len(lines) - len(set(lines)), len(lines)), np.log1p(share(w, len(lines))), share(count(" \t"), n),
        share(sum(x.endswith((".", "!", "?")) for x in lines), len(lines)), 1.0 if not w else 0.0,
    ]


def features(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word buckets (distinct, ascending), their values, and the statistics."""
    text = text or ""
    words = text.split()
    sums: dict[int, int] = {}
    for word, k in Counter(text.lower().split()).items():
        b = zlib.crc32(word.encode("utf-8", "replace")) % buckets
        sums[b] = sums.get(b, 0) + k
    at = np.fromiter(sums.keys(), np.int64, len(sums))
    x = np.sqrt(np.fromiter(sums.values(), np.float64, len(sums)))
    return at, x / np.sqrt((x * x).sum()) if len(x) else x, statistics(text, words)


@dataclass
class FactorisationMachine:
    buckets: int
    bias: float
    weights: np.ndarray  # buckets + N_STATS
    factors: np.ndarray  # the same by rank
    mean: np.ndarray
    scale: np.ndarray

    def _row(self, at: np.ndarray, x: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / 4
        return np.concatenate([at, np.arange(self.buckets, self.buckets + len(z))]), np.concatenate([x, z])

    def score(self, text: str | None) -> float:
        at, x, stats = features(text, self.buckets)
        at, x = self._row(at, x, np.asarray(stats))
        v = self.factors[at]
        sums = x @ v
        pairs = 0.5 * float((sums * sums).sum() - ((x * x) @ (v * v)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.weights[at] @ x) + pairs, -30, 30))))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: np.ndarray, buckets: int, rank: int, epochs: int, seed: int = 7) -> FactorisationMachine:
        rng = np.random.default_rng(seed)
        stats = np.array([r[2] for r in rows]) if rows else np.zeros((1, N_STATS))
        good = (labels.sum() + 1) / (len(labels) + 2)
        d = buckets + N_STATS
        model = cls(buckets, float(np.log(good / (1 - good))), np.zeros(d), rng.normal(0, 0.02, (d, rank)), stats.mean(0), stats.std(0) + 1e-6)
        if len(set(labels.tolist())) < 2:
            model.factors[:] = 0
            return model
        data = [model._row(a, x, np.asarray(s)) for a, x, s in rows]
        params = {"b": np.array([model.bias]), "w": model.weights, "v": model.factors}
        first = {k: np.zeros_like(p) for k, p in params.items()}
        second = {k: np.zeros_like(p) for k, p in params.items()}
        step = 0
        # Small samples get more passes, so that the model takes some hundred steps in any case.
        for _ in range(max(epochs, -(-400 * 256 // len(data)))):
            order = rng.permutation(len(data))
            for lo in range(0, len(order), 256):
                batch = order[lo : lo + 256]
                at = np.concatenate([data[i][0] for i in batch])
                x = np.concatenate([data[i][1] for i in batch])
                lens = np.array([len(data[i][0]) for i in batch])
                starts = np.cumsum(lens) - lens
                v = params["v"][at]
                vx = v * x[:, None]
                sums = np.add.reduceat(vx, starts)
                raw = params["b"][0] + np.add.reduceat(params["w"][at] * x, starts) + 0.5 * ((sums**2).sum(1) - np.add.reduceat(vx**2, starts).sum(1))
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[batch]) / len(batch)
                e = np.repeat(error, lens) * x
                grads = {"b": np.array([error.sum()]), "w": np.bincount(at, e, d) + 1e-5 * params["w"]}
                gv = e[:, None] * (np.repeat(sums, lens, axis=0) - vx)
                grads["v"] = np.stack([np.bincount(at, gv[:, f], d) for f in range(gv.shape[1])], 1) + 1e-5 * params["v"]
                step += 1
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    params[k] -= 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        model.bias = float(params["b"][0])
        return model


def fit_quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 6000, buckets: int = 4096, rank: int = 6, epochs: int = 6) -> FactorisationMachine:
    """Fit on at most ``max_rows`` rows of ``labels`` (doc_id, ``label``), those with the least hash of their id."""
    ship_package(docs.sparkSession)
    some = pick(labels, "doc_id", label).filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    # At most max_rows rows of two numbers: small enough to broadcast whatever the input.
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).withColumnRenamed(label, "label").withColumnRenamed("doc_id", "l_id")
    texts = pick(docs, "doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("l_id")).select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py(), buckets) for t in batch.column(2)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1).cast(pa.float64()), pa.array([a.astype("<u4").tobytes() for a, _, _ in rows], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x, _ in rows], pa.binary()), pa.array([s for _, _, s in rows], pa.list_(pa.float64()))],
                ["doc_id", "label", "at", "x", "stats"],
            )

    found = texts.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(run, "doc_id long, label double, at binary, x binary, stats array<double>").toArrow()
    rows = sorted(found.to_pylist(), key=lambda r: r["doc_id"])
    data = [(np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(np.float64), r["stats"]) for r in rows]
    return FactorisationMachine.fit(data, np.array([r["label"] for r in rows]), buckets, rank, epochs)


def score_quality(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted (1 from ``threshold`` on)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(t.as_py()) for t in batch.column(1)], np.float64)
            yield pa.record_batch([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
