"""Substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash of the last WINDOW bytes (each byte moves what is before it by SHIFT of 32 bits) is kept for each byte of a text; a chunk
ends after white space where the hash's BITS top bits are 0, after MIN bytes at least; a piece of MAX bytes without
such a place ends at the last whole character. Where a chunk ends depends only on the bytes near it, so an insertion moves the
ends near it and no others. Equal chunks are found by their 128-bit digests: the document with the smallest doc_id
keeps them, and within a document the first place. A run of neighbouring repeated chunks is taken out where it has
``run`` bytes or more (RUN: some 15 words); shorter ones, which common phrases and lines give, stay. What is taken out
begins and ends at word borders, except in words of more than MAX bytes.

Only (digest, doc_id) rows are shuffled for the search, one for each distinct chunk of a document; minima are
taken before the shuffle, and the rows that come back to them are joined on the digest, which Spark splits
where one digest is frequent. The texts are then chunked again, and what is repeated is taken out.

Defined results: null text stays null and empty text empty, with no chunks; a null doc_id keeps
nothing that a numbered document has too (it counts as the largest); rows of equal doc_id count as one
document, and keep what the others of that id have; an empty table gives no rows; texts of any length are chunked whole;
further columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, SHIFT, MIN, BITS, MAX, RUN = 16, 2, 24, 2, 512, 100
LAST_ID = (1 << 63) - 1
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """sum(_GEAR[raw[i - j]] << SHIFT * j for j < WINDOW) for each i, by doubling the window."""
    h = _GEAR[raw]
    for s in (1, 2, 4, 8):
        if len(h) <= s:
            break
        h[s:] = h[s:] + (h[:-s] << np.uint32(SHIFT * s))
    return h


def ends(raw: np.ndarray) -> list[int]:
    """Where chunks end."""
    n = len(raw)
    if not n:
        return []
    inside = (raw & 0xC0) == 0x80  # not the first byte of a character
    whole = np.append(~inside, True)
    places = np.flatnonzero((gear(raw) >> np.uint32(32 - BITS) == 0) & common.SPACE[raw]) + 1
    out, last = [], 0
    for p in [*places.tolist(), n]:
        while p - last > MAX:
            cut = last + MAX
            while not whole[cut]:
                cut -= 1
            out.append(cut)
            last = cut
        if p - last >= MIN:
            out.append(p)
            last = p
    if last < n:
        out.append(n)
    return out


def chunked(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text's bytes, its chunks' ends, and their digests of 16 bytes, joined."""
    data = (text or "").encode()
    to = ends(np.frombuffer(data, np.uint8))
    digest = xxhash.xxh3_128_digest
    digests = b"".join([digest(data[a:b]) for a, b in zip([0, *to], to, strict=False)])
    return data, np.array(to, np.int64), digests


def _pieces(digests: bytes) -> list[bytes]:
    return [digests[i : i + 16] for i in range(0, len(digests), 16)]


def _emit(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            ids, digests = [], [np.zeros((0, 2), np.int64)]
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                own = np.frombuffer(b"".join(sorted(set(_pieces(chunked(text)[2])))), ">i8").reshape(-1, 2) if text else digests[0]
                digests.append(own)
                ids.append(np.full(len(own), LAST_ID if doc_id is None else doc_id))
            flat = np.concatenate(digests).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array(np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64))],
                ["hi", "lo", "doc_id"]
            )


def _spans(to: np.ndarray, again: np.ndarray, run: int) -> list[tuple[int, int]]:
    """Runs of repeated chunks that have so many bytes at least, as (from, to)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
    starts = np.concatenate([[0], to])[edge[::2]]
    stops = to[edge[1::2] - 1]
    long = stops - starts >= run
    return list(zip(starts[long].tolist(), stops[long].tolist(), strict=True))


def _kept(text: str | None, first: dict[bytes, int], run: int) -> tuple:
    """The text without its repeated runs, how many chunks it has and how many are taken out, where, and who keeps them."""
    data, to, digests = chunked(text)
    pieces, seen = _pieces(digests), set()
    again = np.zeros(len(to), bool)
    for i, key in enumerate(pieces):
        again[i] = key in seen or key in first
        seen.add(key)
    spans = _spans(to, again, run)
    if not spans:
        return text, len(to), 0, [], []
    edges = [0, *(x for span in spans for x in span), len(data)]
    text = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
    gone = np.zeros(len(to), bool)
    for a, b in spans:
        gone |= (to > a) & (to <= b)
    sources = {first[p] for p, x in zip(pieces, gone.tolist(), strict=True) if x and p in first}
    return text, len(to), int(gone.sum()), [{"start": a, "end": b} for a, b in spans], sorted(sources - {LAST_ID})


_NEW = [
    ("text", pa.string()), ("n_chunks", pa.int64()), ("n_repeated", pa.int64()),
    ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("first_ids", pa.list_(pa.int64()))
]


def _apply(run: int):
    def applied(batches):
        for batch in batches:
            n = batch.num_columns
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts, known, firsts = (part.column(n - 3 + k).to_pylist() for k in range(3))
                rows = [_kept(text, dict(zip(keys or (), ids or (), strict=True)), run) for text, keys, ids in zip(texts, known, firsts, strict=True)]
                new = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_NEW)]
                yield pa.RecordBatch.from_arrays([*part.columns[: n - 3], *new], [*part.schema.names[: n - 3], *(name for name, _ in _NEW)])

    return applied


def dedup(docs: DataFrame, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """doc_id, the columns named in keep, text without repeated passages, n_chunks, n_repeated (chunks taken out), removed
    (byte spans of the text as it was), first_ids (documents that keep what was taken out)."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)),
        F.col(text_col).cast("string").alias("text")
    )
    chunks = rows.select("doc_id", "text").mapInArrow(common.tidied(_emit), "hi long, lo long, doc_id long")
    first = chunks.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("other")).where("first < other").drop("other")
    key = F.unhex(F.concat(F.lpad(F.hex("hi"), 16, "0"), F.lpad(F.hex("lo"), 16, "0")))
    again = chunks.join(first, ["hi", "lo"]).where("doc_id > first").select("doc_id", key.alias("key"), "first")
    by_doc = again.groupBy("doc_id").agg(F.collect_list(F.struct("key", "first")).alias("again")).select(
        F.col("doc_id").alias("to_id"), F.col("again.key").alias("keys"), F.col("again.first").alias("firsts")
    )
    joined = rows.join(by_doc, F.coalesce(F.col("doc_id"), F.lit(LAST_ID)) == F.col("to_id"), "left").drop("to_id")
    kept = [f for f in joined.schema.fields if f.name == "doc_id" or f.name[0] == "k" and f.name[1:].isdigit()]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    out = joined.select(*(f.name for f in kept), "text", "keys", "firsts").mapInArrow(
        common.tidied(_apply(run)),
        f"{ddl}, text string, n_chunks long, n_repeated long, removed array<struct<start:long,end:long>>, first_ids array<long>"
    )
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def cleaned(docs: DataFrame, run: int = RUN) -> DataFrame:
    """docs with texts that have no repeated passage, all other columns as they are; where n_chars is one, it counts what is left."""
    names = docs.columns
    kept = {i: c for i, c in enumerate(names) if c != "text"}
    own = docs.select(F.col("doc_id").alias("own_id"), F.col("text").alias("own_text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in kept.items()))
    out = dedup(own, tuple(f"c{i}" for i in kept), "own_id", "own_text", run)
    columns = {c: F.col(f"c{i}") for i, c in kept.items()} | {"text": F.col("text")}
    if "n_chars" in names:
        columns["n_chars"] = F.when(F.size("removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*(columns[c].alias(c) for c in names))


def op2(spark, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"))
