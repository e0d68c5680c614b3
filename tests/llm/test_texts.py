"""Byte-level BPE, media columns, chat formatting, WARC and sharding against plain versions."""

import base64
import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from terravia.llm import bpe, chat, media, sharding, warc

from .conftest import EDGES


@pytest.fixture(scope="module")
def reference():
    t = bpe.tokenizer(*bpe.default_vocabulary())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=t.rank, special_tokens={})


def encoded(texts):
    t = bpe.tokenizer(*bpe.default_vocabulary())
    return [(sum((x.tolist() for x in ids), []), b"".join(r.tobytes() for r in raw)) for ids, raw in bpe.encode_texts(t, texts)]


def test_bpe_is_exact(reference):
    rng = random.Random(1)
    texts = [
        "", " ", "  ", "a  b", "a \n b", "it's we'll they're 'sx ''s !'s 've\n's", "x\t's", "日本語 テスト", "a" * 5000,
        "!" * 3000, " " * 3000, "'", "😀 a😀'll", "\r\n\r\n  \tq", "　x y"
    ]
    texts += ["".join(rng.choice("ab'srtvelmd \n!1é　😀.THEing") for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    for text, (ids, raw) in zip(texts, encoded(texts), strict=True):
        assert ids == reference.encode_ordinary(text) and raw == text.encode()


def test_bpe_compatibility_is_what_merging_gives():
    t = bpe.tokenizer(*bpe.default_vocabulary())
    rng = random.Random(2)
    short = [r for r, b in t.token.items() if len(b) <= 6]
    for _ in range(3000):
        a, b = rng.choice(short), rng.choice(short)
        assert t.compatible(a, b) == (bpe.merged(t.token[a] + t.token[b], t.rank) == [a, b])


def test_bpe_long_texts_are_cut_without_a_trace(monkeypatch, reference):
    text = "some words, here'll be 123 more\n\n" * 300
    monkeypatch.setattr(bpe, "CHUNK", 1000)
    assert encoded([text, None, "x"]) == [(reference.encode_ordinary(text), text.encode()), ([], b""), (reference.encode_ordinary("x"), b"x")]


def test_bpe_collisions_are_seen(monkeypatch, reference):
    monkeypatch.setattr(bpe, "piece_hashes", lambda raw, a, b: (b - a).astype("uint64"))
    text = "all words of one length have one hash now"
    assert encoded([text])[0][0] == reference.encode_ordinary(text)


def test_bpe_columns(spark, edge_docs, no_docs, reference):
    got = bpe.encode(edge_docs).collect()
    assert len(got) == len(EDGES)
    for r in got:
        assert r.ids == reference.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids) and r.decoded == (r.text or "") and r.score == "x"
    want = sorted(
        (
            r.doc_id or -1, r.n_tokens, hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r.ids)).hexdigest(),
            hashlib.sha256(r.decoded.encode()).hexdigest()
        ) for r in got
    )
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(edge_docs).collect()) == want
    assert bpe.encode(no_docs).count() == 0


def test_media_round_trip(spark, edge_docs, no_docs):
    got = media.media_column(edge_docs).collect()
    texts = Counter(t for _, t in EDGES)
    assert len(got) == len(EDGES)
    for text in texts:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        media_bytes = media.to_wav(payload)
        assert media.from_wav(media_bytes) == payload and media_bytes[:4] == b"RIFF"
        mine = [r for r in got if r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.n_bytes == len(raw)]
        assert len(mine) >= texts[text] and {(r.payload_bytes, r.tail_crc32, r.media_bytes, r.media_sha256) for r in mine} == {
            (len(payload), zlib.crc32(payload[-32:]), len(media_bytes), hashlib.sha256(media_bytes).hexdigest())
        }
        assert len({r.feature for r in mine}) == 1
    assert media.media_column(no_docs).count() == 0


def test_fingerprints_find_a_part_of_a_sound():
    import numpy as np

    rng = np.random.default_rng(3)
    tone = lambda f, n: 128 + 90 * np.sin(2 * np.pi * f * np.arange(n) / media.RATE)
    song = np.concatenate([tone(f, 288 * 6) for f in rng.integers(200, 3500, 60)]).astype(np.uint8)
    part = song[288 * 90 : 288 * 210]
    whole, cut = media.fingerprint(song.tobytes()), media.fingerprint(part.tobytes())
    offsets = Counter()
    places = defaultdict(list)
    for c in whole.tolist():
        places[c & 0xFFFFFF].append(c >> 24)
    for c in cut.tolist():
        offsets.update(t - (c >> 24) for t in places[c & 0xFFFFFF])
    assert offsets.most_common(1)[0][0] == 90
    assert (whole[1:] >= whole[:-1]).all()
    times, bins = media.peaks(tone(1000, 576 * 8).astype(np.uint8).tobytes())
    assert set(bins.tolist()) & {72}  # 1000 Hz of 8000 in 576 samples


def turns(*texts, role="assistant"):
    return [("user" if i % 2 == 0 else role, t) for i, t in enumerate(texts)]


def test_chat_prefix_and_masks(spark):
    pairs = [
        (1, turns("q", "a", "q2", "good"), turns("q", "a", "q2", "bad")), (2, turns("q", "a"), turns("q", "a")),
        (3, turns("x"), turns("y")), (4, [], turns("q", "a")), (5, turns("q", "a", "b", "c"), turns("q", "a"))
    ]
    schema = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    for r in chat.format_preferences(spark.createDataFrame(pairs, schema)).collect():
        _, a, b = pairs[r.pair_id - 1]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        show = lambda ts: "".join(f"<|im_start|>{x}\n{y}<|im_end|>\n" for x, y in ts)
        assert (r.common_turns, r.prompt, r.chosen, r.rejected) == (n, show(a[:n]), show(a[n:]), show(b[n:]))
        for text, spans, rest in ((r.chosen, r.chosen_mask, a[n:]), (r.rejected, r.rejected_mask, b[n:])):
            got = [text[slice(*map(int, s.split("-")))] for s in spans.split(",") if s]
            assert got == [f"{t}<|im_end|>\n" for role, t in rest if role == "assistant"]


def test_chat_pairs(spark):
    c = [
        (0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 1, "assistant", "a"), (1, 0, "user", None),
        (1, 1, "assistant", "b"), (1, 2, "user", "thanks"), (2, 0, "user", "alone"), (4, 0, None, "s"),
        (4, 1, "assistant", "z"), (None, 0, "user", "x"), (7, None, "assistant", "first")
    ]
    d = spark.createDataFrame([(*x, "extra") for x in c], "conv_id long, turn long, role string, text string, turns string")
    got = {r.pair_id: r for r in chat.format_preferences(chat.preference_pairs(d)).collect()}
    assert set(got) == {0, 1, 4, 7}
    assert got[0].common_turns == 2 and got[0].rejected.endswith("b<|im_end|>\n")
    assert "thanks" in got[1].chosen and "thanks" not in got[1].rejected
    assert got[4].rejected_mask == "22-33" and got[7].common_turns == 0
    assert chat.format_preferences(chat.preference_pairs(d.where("false"))).count() == 0


def test_warc(spark, tmp_path):
    import gzip
    import os

    long = "<p>" + "x" * 300_000 + "é</p>"
    data = [
        (5, "http://a", "same"), (3, "http://b", "same"), (9, None, "same"), (1, "http://c\r\nX: y", None),
        (2, "http://d", ""), (4, "http://e", long), (4, "http://e", long), (None, "http://f", "same"),
        (None, "http://g", "lone"), (6, "u", "WARC/1.1\r\n\r\nContent-Length: 3")
    ]
    pages = spark.createDataFrame([(*x, "z") for x in data], "page_id long, url string, html string, digest string")
    got = warc.archive_pages(pages).collect()
    assert len(got) == len(data)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter(
        (p, len((h or "").encode()), digest(h)) for p, _, h in data
    )
    kinds = {(r.page_id, r.payload_digest): (r.record_type, r.refers_to) for r in got}
    assert kinds[3, digest("same")] == ("response", None) and kinds[5, digest("same")] == kinds[9, digest("same")] == kinds[
        None, digest("same")
    ] == ("revisit", 3)
    assert kinds[1, digest("")] == ("response", None) and kinds[2, digest("")] == ("revisit", 1)
    assert kinds[4, digest(long)] == ("response", None) and kinds[None, digest("lone")] == ("response", None)
    assert {r.record_type for r in warc.archive_pages(pages, 10).where("payload_bytes < 10").collect()} == {"response"}
    assert warc.archive_pages(pages.where("false")).count() == 0
    # any gzip reader reads the archives, and each index line leads to one member
    one = got[0]
    folder = next(d for d, _, names in os.walk(spark.sparkContext.getCheckpointDir().split("file:")[-1].rsplit("/", 1)[0]) if one.archive in names)
    raw = open(f"{folder}/{one.archive}", "rb").read()
    lines = [x.split() for x in open(f"{folder}/{one.archive}.idx")]
    assert gzip.decompress(raw) == b"".join(zlib.decompress(raw[int(a) : int(a) + int(n)], 31) for a, n, *_ in lines)


def test_warc_streams_are_inflated_in_pieces():
    import io

    parts = [warc.response(i, "http://x", b"y" * n, "D") for i, n in enumerate((0, 1, 50_000, 7))]
    whole = io.BytesIO(warc.member(b"".join(parts[:2]), 6) + warc.member(b"".join(parts[2:]), 1))
    stream = warc.inflated(whole)
    assert list(warc.records(x[i : i + 777] for x in stream for i in range(0, len(x), 777))) == parts
    with pytest.raises(ValueError):
        list(warc.records(iter([parts[2][:-9]])))


def test_lpt_is_the_textbook_rule():
    rng = random.Random(5)
    sizes = [(rng.randint(1, 50), i) for i in range(300)]
    loads, want = [(0, s) for s in range(7)], {}
    for size, i in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(loads)
        want[i] = s
        heapq.heappush(loads, (load + size, s))
    assert sharding.lpt(sizes, 7) == want


@pytest.mark.parametrize("most", [3, 40, 5000])
def test_classes_of_size_are_scheduled_as_their_groups_would_be(most):
    rng = random.Random(most)
    sizes = [rng.randint(1, most) for _ in range(4000)]
    plan = sharding.schedule(list(Counter(sizes).items()), 7)
    loads, want = [0] * 7, sharding.lpt([(x, i) for i, x in enumerate(sizes)], 7)
    for size, shards, upto in plan:
        for shard, n in zip(shards, np.diff([0, *upto]).tolist(), strict=True):
            loads[shard] += n * size
    assert loads == [sum(x for i, x in enumerate(sizes) if want[i] == s) for s in range(7)]


def test_sharding(spark, edge_docs, no_docs, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 20)
    rng = random.Random(6)
    rows = [(i, "hot text" if i % 3 == 0 else f"text {rng.randint(0, 400)} " * rng.randint(1, 9)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.assign(docs, 6).collect()
    assert sorted(r.doc_id for r in got) == list(range(1500))
    text = dict(rows)
    homes, slots, loads = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        assert (r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 8, zlib.crc32(text[r.doc_id].encode()))
        homes[text[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(len(h) == 1 for h in homes.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for i, t in rows:
        groups[t] += len(t) + 8
    assert max(loads.values()) - min(loads.values()) <= max(groups.values())
    assert sorted(sharding.assign(docs.repartition(7), 6).collect()) == sorted(got)
    textbook = sharding.lpt([(n, t) for t, n in groups.items()], 6)
    assert loads == Counter({s: sum(n for t, n in groups.items() if textbook[t] == s) for s in range(6)})
    twins = sharding.assign(spark.createDataFrame([(None if i % 2 else 7, "same text") for i in range(300)], "doc_id long, text string"), 3).collect()
    assert len({r.shard for r in twins}) == 1 and sorted(r.slot for r in twins) == list(range(300))
    edge = sharding.assign(edge_docs).collect()
    assert Counter(r.doc_id for r in edge) == Counter(i for i, _ in EDGES)
    assert {r.size for r in edge if r.doc_id in (2, 3)} == {8} and all(r.text_crc32 == 0 for r in edge if r.doc_id in (2, 3))
    assert sharding.assign(no_docs).count() == 0
