"""Quality: a byte-level convolutional network in numpy, over overlapping chunks of the whole document.

Input: the bytes of the UTF-8 text, nothing else. A byte has a learned vector; learned filters go over WIDTH
bytes, every STRIDE bytes; the rectified responses are max-pooled over chunks of 2 * HALF bytes, each of
which overlaps the next by HALF; a document is the mean and the maximum of its chunks, and one
logistic unit makes these a probability. Scoring adds up one table row per byte of a filter, so its
cost and memory per batch are in proportion to the bytes, and every byte of a document counts.

Training (on the driver): Adam on a bounded sample, ``max_each`` documents of either label with ``max_chars``
characters at most, chosen by a hash of doc_id from all labelled rows. Scored documents have no bound.

Defined results: null and empty texts are scored as a document of padding; without training documents
of both kinds every score is the share of label 1 in the sample, or 0 without any; labels other than 0
and 1, or null, are not used; ids are passed through, repeated ones with a score for each row, and equal texts score alike; very
long texts are scored whole; an empty table gives no rows; further columns are not read. The query's held_out is null
where doc_id is; a score of 0.7 is predicted 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import labelled

WIDTH, STRIDE, HALF, DIMS, FILTERS = 16, 4, 256, 8, 32
PADDING = 256
BATCH = 1 << 20


def encoded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as numbers, each padded to whole halves (two at least), and the halves' first numbers."""
    parts, first = [], [0]
    for t in texts:
        raw = (t or "").encode()
        n = max(2, -(-(len(raw) + WIDTH) // HALF)) * HALF
        part = np.full(n, PADDING, np.int16)
        part[: len(raw)] = np.frombuffer(raw, np.uint8)
        parts.append(part)
        first.append(first[-1] + n // HALF)
    parts.append(np.full(WIDTH, PADDING, np.int16))
    return np.concatenate(parts), np.array(first)


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {
            "byte": n(257, DIMS), "filter": n(WIDTH, DIMS, FILTERS) * 0.5, "bias": np.zeros(FILTERS, np.float32),
            "out": n(2 * FILTERS) * 0.5, "constant": np.zeros(1, np.float32)
        }
        self.p["byte"][PADDING] = 0

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Filters' responses, every STRIDE bytes."""
        tables = np.einsum("rd,wdf->wrf", self.p["byte"], self.p["filter"])
        n = (len(x) - WIDTH) // STRIDE
        out = np.empty((n, FILTERS), np.float32)
        out[:] = self.p["bias"]
        for k in range(WIDTH):
            out += tables[k].take(x[k : k + n * STRIDE : STRIDE], axis=0)
        return out

    def pooled(self, x: np.ndarray, first: np.ndarray):
        r = self.responses(x).reshape(-1, HALF // STRIDE, FILTERS)
        r[first[1:] - 1, 1 - WIDTH // STRIDE :] = -np.inf  # places from which a filter would reach into the next document
        halves = np.maximum(r.max(1), 0)
        later = np.concatenate([halves[1:], halves[-1:]])
        chunks = np.maximum(halves, later)
        inside = np.ones(len(halves), bool)
        inside[first[1:] - 1] = False  # the last half of a document begins no chunk
        n = np.diff(first) - 1
        kept = chunks[inside]
        at = np.cumsum(n) - n
        mean = np.add.reduceat(kept, at) / n[:, None]
        top = np.maximum.reduceat(kept, at)
        return r, halves, inside, kept, at, n, np.hstack([mean, top])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out, held, size = [], [], 0
        for i, t in enumerate(texts):
            held.append(t)
            size += len(t or "") + HALF
            if size >= BATCH // 4 or i == len(texts) - 1:
                v = self.pooled(*encoded(held))[-1]
                out.append(1 / (1 + np.exp(-np.clip(v @ self.p["out"] + self.p["constant"], -50, 50, dtype=np.float64))))
                held, size = [], 0
        return np.concatenate(out) if out else np.zeros(0)

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        r, halves, inside, kept, at, n, v = self.pooled(x, first)
        p = 1 / (1 + np.exp(-np.clip(v @ self.p["out"] + self.p["constant"], -30, 30)))
        dz = ((p - y) / len(y)).astype(np.float32)
        g = {"out": v.T @ dz, "constant": np.array([dz.sum()])}
        dv = dz[:, None] * self.p["out"]
        doc = np.repeat(np.arange(len(n)), n)
        top = kept == v[doc, FILTERS:]
        share = top / np.add.reduceat(top.astype(np.float32), at)[doc]
        dk = dv[doc, :FILTERS] / n[doc][:, None] + dv[doc, FILTERS:] * share
        dh = np.zeros_like(halves)
        own = np.flatnonzero(inside)
        left = halves[own] >= halves[own + 1]
        np.add.at(dh, own, dk * left)
        np.add.at(dh, own + 1, dk * ~left)
        dh *= halves > 0
        half, f = np.nonzero(dh)
        d = dh[half, f]
        place = (half * (HALF // STRIDE) + r.argmax(1)[half, f]) * STRIDE
        g["bias"] = np.bincount(f, d, FILTERS)
        rows = self.p["byte"]
        g["filter"], g["byte"] = np.zeros_like(self.p["filter"]), np.zeros_like(rows)
        for k in range(WIDTH):
            dt = np.bincount(x[place + k].astype(np.int64) * FILTERS + f, d, len(rows) * FILTERS).reshape(-1, FILTERS)
            g["filter"][k] = rows.T @ dt
            g["byte"] += dt @ self.p["filter"][k].T
        g["byte"][PADDING] = 0
        return g


def train(
    texts: list[str], labels: list[int], epochs: int = 10, size: int = 32, rate: float = 0.01, decay: float = 1e-4,
    seed: int = 11
) -> Network | float:
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    net, rng = Network(seed), np.random.default_rng(seed)
    net.p["constant"][:] = np.log(y.mean() / (1 - y.mean()))
    ready = [encoded([t]) for t in texts]
    epochs = max(epochs, min(60, 12_000 // max(1, len(y))))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, total = 0, epochs * -(-len(y) // size)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), size):
            some = order[at : at + size]
            x = np.concatenate([*(ready[i][0][:-WIDTH] for i in some), np.full(WIDTH, PADDING, np.int16)])
            first = np.concatenate([[0], np.cumsum([ready[i][1][-1] for i in some])])
            step += 1
            now = rate * (1 - step / (total + 1))
            for k, g in net.gradients(x, first, y[some]).items():
                m, v = moment[k]
                g = g.astype(np.float32) + (decay * net.p[k] if k != "constant" else 0)
                m += 0.1 * (g - m)
                v += 0.005 * (g * g - v)
                net.p[k] -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-6)
    return net


def model_of(docs: DataFrame, labels: DataFrame, where="true", max_each: int = 1000, max_chars: int = 10_000) -> Network | float:
    rows = labelled(docs, labels, "quality", where, {1: max_each * 2, 0: max_each}, max_chars)
    return train([t for _, t in rows], [k for k, _ in rows])


def score_texts(model: Network | float, texts: list[str | None]) -> np.ndarray:
    return np.full(len(texts), model) if isinstance(model, float) else model.scores(texts)


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """doc_id and score of each row of docs. The model (under 100 kB, whatever the input) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score_texts(m, batch.column(1).to_pylist()), pa.float64())],
                ["doc_id", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.tidied(run), "doc_id long, score double")


def op1(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held = common.held_out(F.col("doc_id"), 4, 2)
    out = score(docs, model_of(docs, labels, ~held))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
