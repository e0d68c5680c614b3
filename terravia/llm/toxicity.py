"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel. A text becomes symbols: small letters, one symbol for white space, look-alike digits and
signs as their letters; letters beyond Latin-1, of all planes, have the symbols 60 to 127 by their code
point's remainder, so the letters of an alphabet that lie within 68 code points are told apart, while the
characters of larger scripts (CJK, Hangul) share these symbols; what is no letter (punctuation, emoji,
combining marks) is dropped, and so is white space between single letters. The
kernel of two segments counts their common subsequences of three symbols, each occurrence weighted by
DECAY to the power of the places it spans, up to SPAN of them: an insult with inserted or left-out
characters still shares most subsequences with the insult.

Training (on the driver, from a bounded sample). Segments are WINDOW places long. Landmarks are the
strings of four to six symbols that tell toxic documents most from others, and strings of clean
documents. Segments are mapped by the kernel to the landmarks and the inverse square root of the
landmarks' own kernel matrix (Nyström); a linear machine with squared hinge loss is trained on these, the
segments of toxic documents being those that score highest, those of clean documents likewise (three
rounds). A logistic model of the highest segment and of the sum and share of positive segments gives a
document's probability.

Scoring. The machine's decision is linear in the segment's subsequences, so all landmarks fold into
one weight per subsequence (128^3 of them; those of Latin-1 symbols stand in the first 64^3); each document is scored whole, every segment of it.

``max_toxic`` and ``max_clean`` bound the training sample (chosen by a hash of doc_id from all labelled
rows), ``max_chars`` the length of a document that may be in it. Scored documents have no bound.

Defined results: null and empty texts have the score of a document without segments; without
training documents of both kinds every score is 0; labels other than 0 and 1, or null, are not used; of
labels that repeat a doc_id the smallest counts; ids are passed through, repeated ones with a score for each row; equal texts
score alike; very long texts are scored whole; an empty table gives no rows; further columns are not read by score(), and
stay as they are in filtered(). The query's held_out is null where doc_id is; a score of 0.5 is predicted 1.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DECAY, SPAN, WINDOW, PAD, N_SYMBOLS = np.float32(0.75), 7, 12, 20, 128
SPACE, OTHER, ROUNDS = 27, 60, 3
BATCH = 1 << 19


def _alphabet() -> np.ndarray:
    """Code point -> symbol; 0 is the padding, 255 dropped."""
    out = np.full(0x110000, 255, np.uint8)
    for cp in range(0x80, 0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = 28 + low - 0xE0 if 0xE0 <= low <= 0xFF else OTHER + low % (N_SYMBOLS - OTHER)
        elif c.isspace():
            out[cp] = SPACE
    for i in range(26):
        out[97 + i] = out[65 + i] = 1 + i
    for c in " \t\n\r\x0b\x0c":
        out[ord(c)] = SPACE
    for a, b in zip("013457$@", "oieastsa", strict=True):
        out[ord(a)] = ord(b) - 96
    out[0] = 0
    return out


_ALPHABET = _alphabet()


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as symbols, PAD zeros after each, and where each begins (and the end)."""
    texts = [(t or "").replace("\0", " ") for t in texts]
    points = np.frombuffer(("\0" * PAD).join([*texts, ""]).encode("utf-32-le"), np.uint32)
    got = _ALPHABET[points]
    first = np.concatenate([[0], np.cumsum([len(t) + PAD for t in texts])])
    keep = got != 255
    place = np.concatenate([[0], np.cumsum(keep)])
    got, first = got[keep], place[first]
    # runs of white space are one; between single letters none ("i d i o t")
    blank = got == SPACE
    keep = np.ones(len(got), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    place = np.concatenate([[0], np.cumsum(keep)])
    got, first = got[keep], place[first]
    edge = np.pad((got == SPACE) | (got == 0), 2, constant_values=True)
    lone = (got == SPACE) & edge[:-4] & edge[4:]
    keep = ~lone
    place = np.concatenate([[0], np.cumsum(keep)])
    return got[keep].astype(np.int32), place[first]


def _spread(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a symbol adds to the number of a subsequence as its first, second and third."""
    low, high = symbols & 63, symbols >> 6
    return (low << 12) + (high << 20), (low << 6) + (high << 19), low + (high << 18)


def _steps():
    """Places of the second and the third symbol after the first."""
    for d2 in range(2, SPAN):
        for d1 in range(1, d2):
            yield d1, d2


def place_sums(got: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each place, the sum of DECAY^span * weight over the subsequences that begin there."""
    out = np.empty(len(got), np.float32)
    for at in range(0, len(got), BATCH):  # a block at a time: memory doesn't grow with the text
        block = np.concatenate([got[at : at + BATCH + SPAN], np.zeros(SPAN, got.dtype)])
        n = min(BATCH, len(got) - at)
        (a, b, c), total = _spread(block), np.zeros(n, np.float32)
        for d1, d2 in _steps():
            total += weights.take(a[:n] + b[d1 : n + d1] + c[d2 : n + d2]) * DECAY ** np.float32(d2 + 1)
        out[at : at + n] = total
    return out


def segments(sums: np.ndarray) -> np.ndarray:
    """The kernel machine's value (without its constant) of the segment that begins at each place."""
    total = np.concatenate([[0], np.cumsum(sums, dtype=np.float64), np.full(WINDOW, 0.0)])
    n = len(sums)
    total[n + 1 :] = total[n]
    return (total[WINDOW : n + WINDOW] - total[:n]).astype(np.float32)


def subsequences(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences of a segment, as numbers, and their weights; those with padding are left out."""
    n = len(segment)
    first, second, third = _spread(segment)
    ats, ws = [], []
    for d1, d2 in _steps():
        if n > d2:
            a, b, c = segment[: n - d2], segment[d1 : n - d2 + d1], segment[d2:]
            m = (a > 0) & (b > 0) & (c > 0)
            ats.append((first[: n - d2] + second[d1 : n - d2 + d1] + third[d2:])[m])
            ws.append(np.full(int(m.sum()), DECAY ** np.float32(d2 + 1), np.float32))
    return (np.concatenate(ats), np.concatenate(ws)) if ats else (np.zeros(0, np.int32), np.zeros(0, np.float32))


def _dense(items: list[tuple[np.ndarray, np.ndarray]], columns: np.ndarray) -> np.ndarray:
    """Items as rows over the given subsequences."""
    out = np.zeros((len(items), len(columns)), np.float32)
    for row, (at, w) in zip(out, items, strict=True):
        k = np.searchsorted(columns, at)
        k[k == len(columns)] = 0
        hit = columns[k] == at
        row += np.bincount(k[hit], w[hit], len(columns)).astype(np.float32)
    return out


class Machine:
    """Landmarks, and the weight of each subsequence that they and the support vector machine give."""

    def __init__(self, landmarks: list[np.ndarray], ridge: float = 1e-3):
        self.marks = [subsequences(x) for x in landmarks]
        self.columns = np.unique(np.concatenate([a for a, _ in self.marks]))
        self.phi = _dense(self.marks, self.columns)
        kernel = (self.phi @ self.phi.T).astype(np.float64)
        values, vectors = np.linalg.eigh(kernel)
        keep = values > ridge * values.max()
        self.root = vectors[:, keep] / np.sqrt(values[keep])  # to Nyström coordinates

    def features(self, items: list[np.ndarray]) -> np.ndarray:
        out = [_dense([subsequences(x) for x in items[i : i + 500]], self.columns) @ self.phi.T for i in range(0, len(items), 500)]
        return np.concatenate(out).astype(np.float64) @ self.root

    def fit(self, items: list[np.ndarray], y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
        """Squared hinge loss, by Newton steps on the items within the margin."""
        x = np.hstack([self.features(items), np.ones((len(items), 1))])
        w = np.zeros(x.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-3
        for _ in range(25):
            inside = y * (x @ w) < 1
            a, c = x[inside], weight[inside]
            new = np.linalg.solve(np.diag(penalty) + (a * c[:, None]).T @ a, (a * c[:, None]).T @ y[inside])
            if np.allclose(new, w, atol=1e-6):
                break
            w = new
        table = np.zeros(N_SYMBOLS**3, np.float32)
        table[self.columns] = self.phi.T @ (self.root @ w[:-1])
        return table, float(w[-1])


def telling(toxic: list[np.ndarray], clean: list[np.ndarray], most: int) -> list[np.ndarray]:
    """Strings of four to six symbols whose presence tells toxic documents most, none within another's reach."""
    found = []
    for size in (4, 5, 6):
        counts = []
        for docs in (toxic, clean):
            codes = [np.zeros(0, np.int64)]
            for d in docs:
                if len(d) >= size:
                    code = np.zeros(len(d) - size + 1, np.int64)
                    fine = np.ones(len(code), bool)
                    for k in range(size):
                        code = code << 7 | d[k : len(d) - size + 1 + k]
                        fine &= (d[k : len(d) - size + 1 + k] > 0) & (d[k : len(d) - size + 1 + k] != SPACE)
                    codes.append(np.unique(code[fine]))
            counts.append(np.unique(np.concatenate(codes), return_counts=True))
        (code, n1), (other, n0) = counts
        k = np.searchsorted(other, code)
        k[k == len(other)] = 0
        against = np.where(other[k] == code, n0[k], 0) if len(other) else np.zeros(len(code), np.int64)
        p1, p0 = (n1 + 0.1) / (len(toxic) + 1), (against + 0.5) / (len(clean) + 1)
        gain = n1 * np.log(p1 / p0)
        enough = (n1 >= 2) & (p1 > 3 * p0)
        for i in np.argsort(-gain * enough, kind="stable")[: most * 2]:
            if enough[i]:
                found.append((float(gain[i]) * (1 + 0.1 * size), size, int(code[i])))
    out: list[np.ndarray] = []
    texts: list[str] = []
    for _, size, code in sorted(found, key=lambda x: (-x[0], x[2])):
        s = np.array([code >> 7 * (size - 1 - k) & 127 for k in range(size)], np.int32)
        t = s.astype(np.uint8).tobytes().decode("latin-1")
        if not any(t in u or u in t for u in texts):
            out.append(s)
            texts.append(t)
        if len(out) == most:
            break
    return out


def document_features(values: np.ndarray, first: np.ndarray, constant: float) -> np.ndarray:
    """For each document: its highest segment, the sum and the share of its positive ones, 1."""
    out = np.zeros((len(first) - 1, 4))
    out[:, 3] = 1
    v = values + np.float32(constant)
    step = WINDOW // 2
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), (first[1:] - PAD).tolist(), strict=True)):
        if b > a:
            part = v[a:b]
            tops = np.maximum.reduceat(part, np.arange(0, b - a, step))
            positive = np.maximum(tops, 0)
            out[i, :3] = max(tops.max(), -2.0), np.log1p(positive.sum()), positive.sum() / np.sqrt(len(tops))
        else:
            out[i, 0] = -2.0
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """Scale of the columns and weights, by Newton steps."""
    scale = np.maximum(np.abs(x).mean(0), 1e-3)
    x, w = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return scale, w


def train(texts: list[str], labels: list[int], seed: int = 5, n_marks: int = 96) -> dict | None:
    y = np.array(labels)
    if not (y == 1).any() or not (y == 0).any():
        return None
    rng = np.random.default_rng(seed)
    got, first = symbols(texts)
    docs = [got[a:b] for a, b in zip(first[:-1], first[1:] - PAD, strict=True)]
    toxic, clean = [d for d, k in zip(docs, y, strict=True) if k], [d for d, k in zip(docs, y, strict=True) if not k]
    marks = telling(toxic, clean, n_marks)
    if not marks:
        return None
    long = WINDOW + SPAN - 1
    some = [d for d in clean if len(d) > long]
    for d in (some[i] for i in rng.permutation(len(some))[:n_marks]):
        at = int(rng.integers(0, len(d) - long))
        marks.append(d[at : at + 8])
    machine = Machine(marks)
    # To begin with, a segment counts by the telling strings that it holds.
    table, constant = machine.fit(
        [*marks], np.array([1.0] * (len(marks) - min(n_marks, len(some))) + [-1.0] * min(n_marks, len(some))),
        np.ones(len(marks))
    )
    negatives: list[np.ndarray] = []
    for d in (some[i] for i in rng.permutation(len(some))[:1500]):
        at = int(rng.integers(0, len(d) - long))
        negatives.append(d[at : at + long])
    for _ in range(ROUNDS):
        values = segments(place_sums(got, table))
        positives = []
        for a, b, k in zip(first[:-1].tolist(), (first[1:] - PAD).tolist(), y.tolist(), strict=True):
            if b <= a:
                continue
            part = values[a:b].copy()
            for _ in range(3 if k else 2):
                at = int(part.argmax())
                if k and part[at] + constant <= -1:
                    break
                (positives if k else negatives).append(got[a + at : min(b, a + at + long)])
                part[max(0, at - WINDOW) : at + WINDOW] = -np.inf
                if not k and rng.random() < 0.7:
                    break
        if not positives:
            break
        if len(negatives) > 12_000:
            negatives = [negatives[i] for i in rng.permutation(len(negatives))[:12_000]]
        items = positives + negatives
        target = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
        weight = np.where(target > 0, 0.5 * len(items) / len(positives), 0.5 * len(items) / len(negatives)) * 0.05
        table, constant = machine.fit(items, target, weight)
    x = document_features(segments(place_sums(got, table)), first, constant)
    scale, w = logistic(x, y)
    return {"table": table, "constant": constant, "scale": scale, "w": w}


def score_texts(model: dict | None, texts: list[str | None]) -> np.ndarray:
    if model is None or not texts:
        return np.zeros(len(texts))
    out, held, size = [], [], 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t or "")
        if size >= BATCH or i == len(texts) - 1:
            got, first = symbols(held)
            x = document_features(segments(place_sums(got, model["table"])), first, model["constant"])
            out.append(1 / (1 + np.exp(-np.clip(x / model["scale"] @ model["w"], -50, 50))))
            held, size = [], 0
    return np.concatenate(out)


def labelled(docs: DataFrame, labels: DataFrame, column: str, where, most: dict[int, int], max_chars: int) -> list:
    """(label, text) of a bounded sample of the labelled documents, the same for the same tables."""
    known = labels.where(
        F.col(column).isin(list(most)) & F.col("doc_id").isNotNull()
    ).groupBy("doc_id").agg(F.min(column).alias("label")).where(where)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = None
    for label, n in most.items():  # bounded: n ids of each label
        part = known.where(F.col("label") == label).orderBy(*order).limit(n)
        ids = part if ids is None else ids.unionAll(part)
    rows = ids.collect()
    if not rows:
        return []
    wanted = docs.sparkSession.createDataFrame([(r.doc_id, int(r.label)) for r in rows], "doc_id long, label int")
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).where(F.length("text") <= max_chars).join(F.broadcast(wanted), "doc_id")
    picked = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text")).collect()
    return [(r.label, r.text) for r in sorted(picked, key=lambda r: r.doc_id)]


def _score(model):
    def run(batches):
        m = model.value
        for batch in batches:
            scores = score_texts(m, batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def model_of(
    docs: DataFrame, labels: DataFrame, where: str | object = "true", max_toxic: int = 1000, max_clean: int = 2000,
    max_chars: int = 10_000
) -> dict | None:
    rows = labelled(docs, labels, "toxic", where, {1: max_toxic, 0: max_clean}, max_chars)
    return train([t for _, t in rows], [k for k, _ in rows])


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score of each row of docs. The model (8 MB, whatever the input) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.tidied(_score(shared)), "doc_id long, score double")


def filtered(docs: DataFrame, model: dict | None, most: float = 0.5) -> DataFrame:
    """The rows of docs whose score is less than most, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def run(batches):
        m = shared.value
        for batch in batches:
            keep = score_texts(m, batch.column(batch.num_columns - 1).to_pylist()) < most
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(keep))

    named = docs.select(
        *(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(docs.schema.fields)),
        F.col("text").cast("string").alias("scored")
    )
    return named.mapInArrow(common.tidied(run), ddl).toDF(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = model_of(docs, labels, ~common.held_out(F.col("doc_id"), 5, 0))
    out = score(docs, model)
    return out.select(
        "doc_id", common.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
