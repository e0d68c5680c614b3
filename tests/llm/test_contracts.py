"""The registered queries over a whole small table: their columns, and their rows against plain versions."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

import __spark_entry__ as entry
from terravia.llm import bpe, decontamination, media, sharding, toxicity

from .test_corpus import brute, brute_dedup, naive_hits

SF = "/root/testdata/sf0.001"


def rows_of(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] for r in rows_of("documents")}


def result(spark, n, columns):
    name = next(q for q in entry.queries() if q.startswith(f"op{n}_"))
    df = entry.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in columns} == columns
    return df.collect()


@pytest.mark.parametrize("n, folds, fold, least", [(1, 4, 2, 0.7), (6, 5, 0, 0.5)])
def test_scores(spark, texts, n, folds, fold, least):
    got = result(spark, n, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert sorted(r.doc_id for r in got) == sorted(texts) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and r.predicted == (r.score >= least) for r in got)
    by_text = defaultdict(set)
    for r in got:
        by_text[texts[r.doc_id]].add(round(r.score, 5))
    assert all(len(s) == 1 for s in by_text.values())


def test_substring_dedup(spark, texts):
    got = {r.doc_id: (r.text, r.n_repeated) for r in result(spark, 2, {"doc_id": "bigint", "text": "string", "n_repeated": "bigint"})}
    assert got == brute_dedup(sorted(texts.items()))


def test_bpe(spark, texts):
    ranks = {}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        for line in f.read().splitlines():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = result(spark, 3, {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    assert len(got) == len(texts)
    for r in got:
        ids = plain.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def naive_fingerprint(payload):
    """Transforms by their definition, peaks and pairs by loops."""
    x = [b - 128 for b in payload]
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / media.FRAME) for i in range(media.FRAME)]
    turns = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME)
    spectra = [np.abs(turns @ np.array([x[a + i] * window[i] for i in range(media.FRAME)])) for a in range(0, len(x) - media.FRAME + 1, media.HOP)]
    found = []
    for t in range(len(spectra)):
        for b, (low, high) in enumerate(media.BANDS):
            tops = [max(s[low:high]) for s in spectra]
            before, after = tops[t - 1] if t else -1, tops[t + 1] if t + 1 < len(tops) else -1
            if tops[t] > np.mean(spectra[t][low:high]) and tops[t] >= before and tops[t] > after and tops[t] > 1e-6:
                found.append((t, low + int(np.argmax(spectra[t][low:high]))))
    codes = []
    for i, (t, f) in enumerate(found):
        codes += [t << 24 | f << 15 | g << 6 | u - t for u, g in found[i + 1 : i + 1 + media.FAN] if u - t <= media.REACH]
    return sorted(codes)


def test_media(spark, texts):
    got = {
        r.doc_id: r for r in result(
            spark, 4,
            {
                "doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string",
                "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"
            }
        )
    }
    assert set(got) == set(texts)
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (
            len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])
        )
    for i in sorted(texts, key=lambda i: len(texts[i] or ""))[10:60:10]:
        assert list(got[i].fingerprint) == naive_fingerprint(media.payload_of(texts[i])[1]), i


def test_decontamination(spark, texts):
    bench = [(r["item_id"], r["text"]) for r in rows_of("benchmark")]
    ids = sorted(texts)
    want = naive_hits(bench, [texts[i] or "" for i in ids], 0.5, 0.8)
    got = result(spark, 5, {"doc_id": "bigint", "item_id": "bigint", "score": "double"})
    assert {(r.doc_id, r.item_id) for r in got} == {(ids[k], i) for k, i in want} and len(got) == len(want) > 0


def test_toxicity_scores_are_those_of_the_kernel(spark):
    """A document's score from the machine's own weights, segment by segment, by loops."""
    docs = [
        (r["text"], y) for r in rows_of("documents") for y in [
            {x["doc_id"]: x["toxic"] for x in rows_of("labels")}.get(r["doc_id"])
        ] if y in (0, 1) and r["text"] and len(r["text"]) < 3000
    ]
    model = toxicity.train([t for t, _ in docs], [y for _, y in docs], n_marks=24)
    for text in [docs[0][0][:300], docs[3][0][:200], "y0u a r e", "ab", ""]:
        got, first = toxicity.symbols([text])
        s = got[: first[1] - toxicity.PAD].tolist()
        values = []
        for at in range(len(s)):
            total = 0.0
            for i in range(at, min(at + toxicity.WINDOW, len(s))):  # a segment's subsequences are those that begin in it
                span = s[i : i + toxicity.SPAN] + [0] * toxicity.SPAN
                for j in range(1, toxicity.SPAN):
                    for k in range(j + 1, toxicity.SPAN):
                        at_, w = toxicity.subsequences(np.array([span[0], span[j], span[k]], np.int32)) if span[j] and span[k] else ([], [])
                        total += sum(float(model["table"][a]) * float(toxicity.DECAY) ** (k + 1) for a in list(at_)[:1])
            values.append(total + model["constant"])
        x = np.array([-2.0, 0, 0, 1])
        if values:
            tops = [max(values[a : a + toxicity.WINDOW // 2]) for a in range(0, len(values), toxicity.WINDOW // 2)]
            plus = sum(max(0, t) for t in tops)
            x = np.array([max(max(tops), -2.0), math.log1p(plus), plus / math.sqrt(len(tops)), 1])
        want = 1 / (1 + math.exp(-float(x / model["scale"] @ model["w"])))
        assert toxicity.score_texts(model, [text])[0] == pytest.approx(want, abs=2e-3)


def test_warc(spark):
    pages = rows_of("pages")
    payload = {r["page_id"]: (r["html"] or "").encode() for r in pages}
    first = {}
    for i in sorted(payload):
        first.setdefault(payload[i], i)
    got = result(
        spark, 8,
        {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}
    )
    want = {
        i: (
            len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first[p] == i else "revisit",
            None if first[p] == i else first[p]
        ) for i,
        p in payload.items()
    }
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and len(got) == len(pages)


def test_jaccard(spark, texts):
    got = result(spark, 9, {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"})
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(sorted(texts.items()), 3, 90)


def test_sharding(spark, texts):
    got = result(
        spark, 10,
        {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    )
    assert sorted(r.doc_id for r in got) == sorted(texts) and {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    raw = {i: (t or "").encode() for i, t in texts.items()}
    groups = Counter()
    for t in raw.values():
        groups[t] += len(t) + 8
    textbook = sharding.lpt([(n, t) for t, n in groups.items()], 24)
    want, loads, slots = Counter(), Counter(), defaultdict(list)
    for t, n in groups.items():
        want[textbook[t]] += n
    for r in got:
        assert (r.size, r.text_crc32) == (len(raw[r.doc_id]) + 8, zlib.crc32(raw[r.doc_id]))
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert loads == want and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(raw[r.doc_id], r.shard) for r in got}) == len(groups)


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "a b", 7, 8, 9)], "doc_id long, text string, ids long, IDS_in long, n_tokens long")
    got = bpe.encode(df)
    assert got.columns == ["doc_id", "text", "ids_in_in", "IDS_in", "n_tokens_in", "n_tokens", "ids", "decoded"] and got.first()[2:5] == (7, 8, 9)


def test_index_parts_have_the_statistics_of_all(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole, parts = decontamination.index_of(bench)[0], decontamination.index_of(bench, part_chars=1000)
    weights = {(ix.ids[d], int(ix.words[t])): x for ix in parts for t in range(len(ix.words)) for d, x in zip(*ix.postings(t), strict=True)}
    assert len(parts) > 3 and len(weights) == len(whole.items)
    assert all(
        weights[whole.ids[d], int(whole.words[t])] == pytest.approx(x) for t in range(len(whole.words)) for d,
        x in zip(*whole.postings(t), strict=True)
    )
