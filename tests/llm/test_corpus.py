"""Dedup, decontamination, classifiers and the pipeline against brute force and planted cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravia.llm import common, components, decontamination, jaccard, quality, substrings, toxicity

from .conftest import EDGES, PROSE, documents

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return [rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice("bcdfglmnprst") + rng.choice(["", "a", "en", "ing", "o"]) for _ in range(n)]


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        n = min(k, len(w))
        out[i] = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else frozenset()
    return out


def brute(rows, k, percent):
    sets, parent = sets_of(rows, k), {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def families(seed, n):
    """Texts with copies that differ a little, around the thresholds."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        base = words(rng, rng.choice([2, 3, 4, 8, 12, 20, 45, 120, 300]))
        out.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], words(rng, 1), [w[at], *words(rng, 1)]])
            out.append(w)
    return [(i * 3 + 1, rng.choice([" ", "\n", "\t "]).join(w)) for i, w in enumerate(out[:n])]


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_jaccard_is_exact(spark, k, percent):
    rows = families(k, 220)
    got = {
        r.doc_id: (r.n, r.component) for r in jaccard.groups(
            spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, percent
        ).collect()
    }
    assert got == brute(rows, k, percent)


def test_jaccard_is_exact_where_clusters_are_dealt_to_many_parts(spark, monkeypatch):
    """Near copies of one text around the threshold, many more than a part holds; parts are asked in several shares."""
    for name, value in (("PART_MEMBERS", 5), ("PART_TOKENS", 900), ("ASKS", 3)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(4)
    base, rows = words(rng, 90), families(9, 60)
    for i in range(120):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.randint(1, 3)):
            w[at] = words(rng, 1)[0]
        rows.append((1000 + i, " ".join(w)))
    got = {
        r.doc_id: (r.n, r.component) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 90).collect()
    }
    assert got == brute(rows, 3, 90)
    assert 1 < len({c for i, (_, c) in got.items() if i >= 1000}) < 110


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_jaccard_matrix_finds_what_brute_force_finds(percent):
    rng = np.random.default_rng(percent)
    bases, sets = [rng.integers(0, 1 << 64, 60, dtype=np.uint64) for _ in range(5)], []
    for i in range(300):
        own = bases[i % 5][rng.random(60) < rng.choice([0.5, 0.9, 0.97])]
        sets.append(np.unique(np.concatenate([own, rng.integers(0, 1 << 64, int(rng.integers(1, 8)), dtype=np.uint64)])))
    names = rng.permutation(10_000)[:300].astype(np.int64)
    want = {(a, b) for a in range(300) for b in range(300) if jaccard.linked(jaccard.overlap(sets[a], sets[b]), len(sets[a]), len(sets[b]), percent)}
    groups = jaccard.grouped(names, sets)
    matrix, place = jaccard.Matrix(groups), {n: i for i, n in enumerate(names.tolist())}
    assert {(a, place[n]) for a in range(300) for g, some in matrix.search(sets[a], percent) for n in groups[g].names[some].tolist()} == want
    root = jaccard.roots(names, sets, percent)
    parent = list(range(300))
    for _ in range(300):
        for a, b in want:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert len({(root[n], parent[i]) for i, n in enumerate(names.tolist())}) == len(set(parent)) == len(set(root.values()))


def test_jaccard_keys_meet_for_every_linked_pair():
    """What leaves out classes without pairing them never leaves out a link."""
    for k, percent in ((3, 90), (5, 80), (2, 95)):
        rows = families(7 * k, 400)
        bands = jaccard.Bands(percent, 1 << 20)
        sets = [jaccard.tokens_of(t, k) for _, t in rows]
        often = np.sort(np.random.default_rng(k).choice(np.unique(np.concatenate(sets)), 3000))
        keys = [bands.keys(s, often if k != 2 else None) for s in sets]
        links = 0
        for a in range(len(sets)):
            for b in range(a):
                o = jaccard.overlap(sets[a], sets[b])
                if len(sets[a]) and len(sets[b]) and jaccard.linked(o, len(sets[a]), len(sets[b]), percent) and not np.array_equal(sets[a], sets[b]):
                    links += 1
                    both = len(np.intersect1d(keys[a][0], keys[b][0]))
                    assert both >= max(keys[a][1], keys[b][1], 1)
        assert links > 10


@pytest.mark.parametrize("percent, least, most", [(90, 220, 240), (90, 360, 580), (80, 220, 240), (80, 360, 580)])
@pytest.mark.parametrize("share", [0.0, 0.2, 0.4])
def test_jaccard_keys_meet_where_one_of_a_pair_keeps_its_light_blocks(percent, least, most, share):
    """Pairs at the threshold, where one set leaves its light blocks out and the other has too many of them to do so."""
    rng, bands, apart = np.random.default_rng(1), jaccard.Bands(percent, 1 << 20), 0
    for _ in range(500):
        size = int(rng.integers(least, most))
        gone = (100 - percent) * size // (100 + percent)
        a, new = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64)), rng.integers(0, 1 << 64, gone, dtype=np.uint64)
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], new]))
        assert jaccard.linked(jaccard.overlap(a, b), len(a), len(b), percent)
        either = np.union1d(a, b)
        often = np.sort(rng.choice(either, int(share * len(either)), replace=False))
        (keys_a, need_a), (keys_b, need_b) = bands.keys(a, often), bands.keys(b, often)
        assert len(np.intersect1d(keys_a, keys_b)) >= max(need_a, need_b, 3)
        band = int(np.searchsorted(bands.lows, size, "right")) - 1
        apart += (len(keys_a) % bands.blocks[band] == 0) != (len(keys_b) % bands.blocks[band] == 0)
    assert apart or not share  # without frequent tokens few blocks are light


def test_jaccard_finds_pairs_where_one_keeps_its_light_blocks(spark):
    """Each pair of its own words, at the threshold."""
    rng, rows = np.random.default_rng(2), []
    for i in range(400):
        size = int(rng.integers(222, 242))
        w = [f"d{i}w{j}" for j in range(size)]
        v = [*w[: size - 10], *(f"d{i}v{j}" for j in range(10))]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = {
        r.doc_id: (r.n, r.component) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 90).collect()
    }
    assert all(got[2 * i + 1][1] == 2 * i for i in range(400))


def test_jaccard_edge_cases(spark, edge_docs, no_docs):
    got = [(r.doc_id, r.n, r.component) for r in jaccard.groups(edge_docs, 3, 90).collect()]
    sizes = {1: 28, 2: 0, 3: 0, 4: 0, 7: 1}
    assert len(got) == len(EDGES) and all((i, n, i) in got for i, n in sizes.items())
    assert sum(i == 1 for i, _, _ in got) == 2 and {c for i, _, c in got if i is None} == {None}
    assert jaccard.groups(no_docs, 3, 90).count() == 0
    kept = jaccard.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == len(EDGES)
    twice = documents(
        spark,
        [(1, "one two three four"), (1, "other words that stand here"), (2, "other words that stand here"), (9, "one two three four")]
    )
    assert {(r.doc_id, r.component) for r in jaccard.groups(twice, 3, 90).collect()} == {(1, 1), (2, 1), (9, 1)}


def test_components(spark):
    rng = random.Random(8)
    e = [
        (rng.randrange(300), rng.randrange(300)) for _ in range(220)
    ] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(60)] + [(None, 5), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in e:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(e, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_bitmap_passes_all_that_it_holds(spark):
    ids = spark.range(0, 3000, 3).toDF("x")
    got = common.marked(spark.range(3000).toDF("y"), "y", common.bitmap(ids, "x"), "m").where("m").collect()
    assert {r.y for r in got} >= set(range(0, 3000, 3)) and len(got) < 1100


def test_chunks_are_the_text_and_resist_insertions():
    rng = random.Random(9)
    text = " ".join(words(rng, 4000)) + "é" * 700
    data, to, digests = substrings.chunked(text)
    assert to[-1] == len(data) and all(len(data[a:b].decode()) for a, b in zip([0, *to[:-1]], to, strict=True))
    assert max(np.diff([0, *to])) <= substrings.MAX + substrings.MIN and substrings.chunked("")[0] == b""
    other = substrings.chunked("inserted words " + text)[2]
    same = set(substrings._pieces(digests)) & set(substrings._pieces(other))
    assert len(same) > 0.95 * len(set(substrings._pieces(digests)))
    raw = np.frombuffer(data[:300], np.uint8)
    slow = [
        sum(int(substrings._GEAR[raw[i - j]]) << (substrings.SHIFT * j) for j in range(min(substrings.WINDOW, i + 1))) % 2**32 for i in range(300)
    ]
    assert substrings.gear(raw).tolist() == slow


def brute_dedup(rows):
    chunked = {i: substrings.chunked(t) for i, t in rows}
    first = {}
    for i in sorted(chunked):
        for p in substrings._pieces(chunked[i][2]):
            first.setdefault(p, i)
    out, many = {}, {}
    for i, t in rows:
        data, to, digests = chunked[i]
        seen, again = set(), []
        for p in substrings._pieces(digests):
            again.append(p in seen or first[p] < i)
            seen.add(p)
        many[i] = 0
        keep, at, run = [], 0, []
        for end, x in [*zip(to.tolist(), again, strict=True), (None, False)]:
            if x:
                run.append((at, end))
            else:
                if run and run[-1][1] - run[0][0] < substrings.RUN:
                    keep += run
                else:
                    many[i] += len(run)
                run = []
                if end is not None:
                    keep.append((at, end))
            at = end
        out[i] = b"".join(data[a:b] for a, b in keep).decode()
    return {i: (t, many[i]) for i, t in out.items()}


def test_substring_dedup(spark, edge_docs, no_docs):
    rng = random.Random(10)
    rows = [(i, " ".join(words(rng, rng.randint(5, 200)))) for i in range(80)]
    passage = " ".join(words(rng, 60))
    for i in (3, 20, 41, 77):
        w = rows[i][1].split(" ")
        at = rng.randrange(len(w))
        rows[i] = (i, " ".join([*w[:at], passage, *w[at:]]))
    rows.append((90, rows[5][1]))
    got = {r.doc_id: r for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {i: (r.text, r.n_repeated) for i, r in got.items()} == brute_dedup(rows)
    assert all(set(r.text.split()) <= set(dict(rows)[i].split()) for i, r in got.items())  # no word is cut
    assert all(got[i].first_ids == [3] and len(got[i].text) < len(dict(rows)[i]) - 150 for i in (20, 41, 77))
    assert got[3].text == dict(rows)[3] and got[90].text == "" and got[90].first_ids == [5]
    assert sum(r.text != t for i, t in rows for r in [got[i]]) == 4
    edge = substrings.dedup(edge_docs, ("lang", "k0", "removed")).collect()
    assert len(edge) == len(EDGES) and Counter(r[0] for r in edge) == Counter(i for i, _ in EDGES)
    assert [r.text for r in edge if r.doc_id == 1] == [PROSE, PROSE] and [r.text for r in edge if r.doc_id == 2] == [None]
    assert substrings.dedup(no_docs).count() == 0


def items(rng, n):
    return [
        (
            i,
            " ".join(words(rng, rng.randint(6, 40))).capitalize() + ". " + " ".join(words(rng, rng.randint(3, 12))).capitalize() + "."
        ) for i in range(n)
    ]


def test_decontamination_finds_what_brute_force_finds():
    rng = random.Random(11)
    bench = items(rng, 120)
    ix = decontamination.Index(bench, 0.5, 0.8)
    for _ in range(200):
        own = rng.choice(bench)[1]
        h, f = decontamination.word_hashes([" ".join(w for w in own.split() if rng.random() < 0.7) + " " + " ".join(words(rng, 30))])
        terms = sorted({int(t) for t in ix.terms(h) if t >= 0})
        score = np.zeros(len(bench))
        for t in terms:
            for d, x in zip(*ix.postings(t), strict=True):
                score[d] += x
        assert {i for i, _ in ix.search_all(terms)} == set(np.flatnonzero(score >= 0.5 - 1e-6).tolist())


def naive_hits(bench, texts, threshold, overlap):
    """BM25 shares by dictionaries, of every passage against every item, and the overlaps of their words."""
    split = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t)]
    held = {i: Counter(split(t)) for i, t in bench if split(t)}
    df = Counter(w for c in held.values() for w in c)
    mean = sum(sum(c.values()) for c in held.values()) / len(held)
    impact = {}
    for i, c in held.items():
        n = sum(c.values())
        raw = {w: np.log1p((len(held) - df[w] + 0.5) / (df[w] + 0.5)) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * n / mean)) for w, k in c.items()}
        impact[i] = {w: x / sum(raw.values()) for w, x in raw.items()}

    def shares(part, passage):
        k = min(5, len(part))
        grams = lambda w: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
        return len(grams(part) & grams(passage)) / len(grams(part)) if part else 1.0

    step, out = max(sum(c.values()) for c in held.values()), {}
    for k, t in enumerate(texts):
        w = split(t)
        for at in range(0, max(1, len(w) - step), step):
            passage = w[at : at + 2 * step]
            for i, t in bench:
                score = sum(impact[i].get(x, 0) for x in set(passage))
                if score >= threshold:
                    q, a = (shares(split(x), passage) for x in decontamination.question_and_answer(t))
                    if q >= overlap and a >= overlap and score > out.get((k, i), (0,))[0] + 1e-9:
                        out[k, i] = (score, q, a, at)
    return out


@pytest.mark.parametrize("threshold, overlap", [(0.5, 0.8), (0.3, 0.0), (0.8, 0.4)])
def test_decontamination_hits_are_those_of_brute_force(monkeypatch, threshold, overlap):
    monkeypatch.setattr(decontamination, "ENTRIES", 300)  # many rounds
    rng = random.Random(13)
    common_words = words(rng, 30)  # so that items share words, and blocks hold several
    bench = [
        (
            i,
            " ".join(
                rng.choice(common_words) if rng.random() < 0.5 else words(rng, 1)[0] for _ in range(rng.randint(3, 25))
            ) + ". " + " ".join(words(rng, rng.randint(2, 8))) + "."
        ) for i in range(70)
    ]
    texts = []
    for _ in range(40):
        w = [rng.choice(common_words) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            at, share = rng.randrange(len(w) + 1), rng.choice([0.6, 0.95, 1])
            w[at:at] = [x for x in rng.choice(bench)[1].split() if rng.random() < share]
        texts.append(" ".join(w))
    want = naive_hits(bench, texts, threshold, overlap)
    got = {(k, bench[i][0]): rest for k, i, *rest in decontamination.Index(bench, threshold, overlap).hits(texts)}
    assert len(want) > 10 and set(got) == set(want)
    assert all(np.allclose(got[x][:3], want[x][:3]) and got[x][3] == want[x][3] for x in want)


def test_decontamination_of_documents(spark, edge_docs, no_docs):
    rng = random.Random(12)
    bench = items(rng, 40)
    docs, want = [], set()
    for i in range(60):
        w = words(rng, rng.randint(10, 400))
        if i % 3 == 0:
            item, text = rng.choice(bench)
            text = rng.choice([text, text.upper(), text.replace(".", " ,"), text.replace(" ", "\n")])
            at = rng.randrange(len(w))
            w[at:at] = [text]
            want.add((i, item))
        elif i % 3 == 1:
            w += bench[i % 40][1].split(". ")[0].split()  # a question without its answer
        docs.append((i, " ".join(w)))
    b = spark.createDataFrame([*bench, (98, None), (99, "")], "item_id long, text string")
    ix = decontamination.index_of(b)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.search(d, ix).collect()} == want
    assert {r.doc_id for r in decontamination.filtered(d, ix).collect()} == set(range(60)) - {i for i, _ in want}
    kept = decontamination.filtered(edge_docs, ix)
    assert kept.columns == edge_docs.columns and kept.count() == len(EDGES)
    assert decontamination.search(no_docs, ix).count() == 0
    assert decontamination.search(d, decontamination.index_of(b.where("false"))).count() == 0
    parts = decontamination.index_of(b, part_chars=500)
    assert len(parts) > 5 and sum(len(p.ids) for p in parts) == 40
    assert sorted(decontamination.search(d, parts).collect()) == sorted(decontamination.search(d, ix).collect())
    assert sorted(decontamination.filtered(d, parts).collect()) == sorted(decontamination.filtered(d, ix).collect())


def labelled(spark, column):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return [(r.doc_id, r.text, r[column]) for r in docs.join(labels, "doc_id").orderBy("doc_id").collect()]


def auc(scores, y):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def test_quality_on_held_out_rows(spark):
    rows = labelled(spark, "quality")
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows])
    train = [r for r, h in zip(rows, held, strict=True) if not h and len(r[1]) <= 6000]
    net = quality.train([t for _, t, _ in train], [y for _, _, y in train], epochs=8)
    test = [r for r, h in zip(rows, held, strict=True) if h]
    assert auc(net.scores([t for _, t, _ in test]), np.array([y for _, _, y in test])) > 0.95


def test_quality_gradients():
    net = quality.Network(1)
    net.p["bias"][:] = 0.05  # at 0 the padding's responses stand at the rectifier's corner, where there is no gradient
    x, first = quality.encoded(["some text of words " * 30, "X!! Y!! " * 60, None])
    y = np.array([1, 0, 1], np.float32)

    def loss():
        p = 1 / (1 + np.exp(-(net.pooled(x, first)[-1] @ net.p["out"] + net.p["constant"]).astype(np.float64)))
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))

    g = net.gradients(x, first, y)
    for name, at in (("out", (3,)), ("out", (30,)), ("bias", (2,)), ("filter", (1, 2, 3)), ("byte", (ord("t"), 4)), ("byte", (ord("X"), 1))):
        old, step = net.p[name][at], 2e-3
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        down = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=0.15, abs=2e-3)


def test_quality_forward_pass_is_the_plain_one():
    """Filter by filter, place by place, chunk by chunk."""
    net, texts = quality.Network(5), ["a few words, ü and more " * 40, "short", "", "x" * 700]
    net.p["bias"][:] = np.linspace(-0.2, 0.2, quality.FILTERS)
    vectors, filters = net.p["byte"].astype(float), net.p["filter"].astype(float)
    for text, got in zip(texts, net.scores(texts), strict=True):
        raw = list(text.encode())
        halves = max(2, -(-(len(raw) + quality.WIDTH) // quality.HALF))
        raw += [quality.PADDING] * (halves * quality.HALF - len(raw))
        top = []
        for h in range(halves):
            places = [i for i in range(h * quality.HALF, (h + 1) * quality.HALF, quality.STRIDE) if i + quality.WIDTH <= len(raw)]
            top.append(
                np.max([np.maximum(0, net.p["bias"] + sum(vectors[raw[i + k]] @ filters[k] for k in range(quality.WIDTH))) for i in places], axis=0)
            )
        chunks = [np.maximum(a, b) for a, b in zip(top, top[1:], strict=False)]
        z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ net.p["out"] + net.p["constant"][0]
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_quality_chunks_cover_the_document():
    net = quality.Network(2)
    base = "plain words only " * 400
    a = net.pooled(*quality.encoded([base]))[-1]
    for at in (0, 3000, len(base) - 9):
        assert not np.allclose(a, net.pooled(*quality.encoded([base[:at] + "\x01\x02\x03\x04\x05\x06" + base[at:]]))[-1])
    texts = [base, "x", None, PROSE] * 3
    assert np.allclose(net.scores(texts), np.concatenate([net.scores([t]) for t in texts]), atol=1e-5)
    assert quality.train([], []) == 0.0 and quality.train(["a"], [1]) == 1.0


def toxic_model():
    rng = random.Random(13)
    insults = ["glorpface", "snivelrat", "mudbrained"]
    texts, y = [], []
    for i in range(300):
        w = words(rng, rng.randint(15, 90))
        if i % 3 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(insults))
        texts.append(" ".join(w))
        y.append(int(i % 3 == 0))
    return toxicity.train(texts[:240], y[:240]), texts[240:], np.array(y[240:]), insults


def test_toxicity_learns_and_tolerates_gaps():
    model, texts, y, insults = toxic_model()
    assert auc(toxicity.score_texts(model, texts), y) > 0.98
    rng = random.Random(14)
    clean = [" ".join(words(rng, 30)) for _ in range(40)]
    low = toxicity.score_texts(model, clean)
    spoil = (lambda s: ".".join(s), lambda s: s[:3] + "x" + s[3:], lambda s: s[:4] + "-" + s[4:], lambda s: " ".join(s), lambda s: s.upper())
    for f in spoil:
        bad = [c + " " + f(insults[i % 3]) + " " + f(insults[(i + 1) % 3]) + " " + c for i, c in enumerate(clean)]
        assert np.median(toxicity.score_texts(model, bad)) > np.quantile(low, 0.95)


@pytest.mark.parametrize("first, letters", [(0x430, 32), (0x3B1, 24), (0x5D0, 27), (0x627, 20), (0x4E00, 60), (0x10428, 40)])
def test_toxicity_tells_letters_of_other_scripts_apart(first, letters):
    """Cyrillic, Greek, Hebrew, Arabic, CJK and Deseret, which lies beyond U+FFFF."""
    script = [chr(first + i) for i in range(letters) if chr(first + i).isalpha()]
    assert len({int(toxicity.symbols([c])[0][0]) for c in script}) == len(script)
    rng, texts = random.Random(16), []
    other = lambda n: "".join(rng.choice(script) for _ in range(n))
    insults = [other(8) for _ in range(3)]
    for i in range(360):
        w = [other(rng.randint(3, 8)) for _ in range(rng.randint(15, 60))]
        if i % 3 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(insults))
        texts.append(" ".join(w))
    y = np.array([int(i % 3 == 0) for i in range(360)])
    model = toxicity.train(texts[:240], y[:240])
    assert auc(toxicity.score_texts(model, texts[240:]), y[240:]) > 0.98


def test_toxicity_folding_is_the_kernel():
    """The weight of each subsequence gives the same value as the kernel with all landmarks."""
    marks = [np.array([3, 5, 7, 9], np.int32), np.array([3, 5, 8, 2, 1], np.int32), np.array([4, 4, 4], np.int32)]
    m = toxicity.Machine(marks)
    items = [np.array(x, np.int32) for x in ([3, 5, 7, 9, 1], [3, 1, 5, 7, 2, 9], [4, 4, 4, 4], [1, 2, 3, 4, 5])]
    table, c = m.fit(items, np.array([1.0, 1, -1, -1]), np.ones(4))
    w = np.linalg.lstsq(m.root.T @ m.phi @ m.phi.T @ m.root, m.root.T @ m.phi @ table[m.columns], rcond=None)[0]
    direct = m.features(items) @ w
    folded = [sum(float(table[a]) * float(x) for a, x in zip(*toxicity.subsequences(i), strict=True)) for i in items]
    assert np.allclose(direct, folded, atol=1e-3)
    slow = Counter()
    s = [3, 5, 7, 9, 1, 3, 5]
    for i in range(7):
        for j in range(i + 1, 7):
            for k in range(j + 1, min(7, i + toxicity.SPAN)):
                slow[(s[i] << 12) + (s[j] << 6) + s[k]] += float(toxicity.DECAY) ** (k - i + 1)
    at, x = toxicity.subsequences(np.array(s, np.int32))
    got = Counter()
    for a, b in zip(at.tolist(), x.tolist(), strict=True):
        got[a] += b
    assert {k: round(v, 5) for k, v in got.items()} == {k: round(v, 5) for k, v in slow.items()}
    sums = toxicity.place_sums(np.array([*s, *[0] * toxicity.PAD], np.int32), table)
    assert sums.sum() == pytest.approx(sum(float(table[k]) * v for k, v in slow.items()), abs=1e-4)


def test_toxicity_of_documents(spark, edge_docs, no_docs):
    model = toxic_model()[0]
    got = toxicity.score(edge_docs, model).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.train([], []) is None and {r.score for r in toxicity.score(edge_docs, None).collect()} == {0.0}
    kept = toxicity.filtered(edge_docs, model)
    assert kept.columns == edge_docs.columns
    labels = spark.createDataFrame([(1, None), (1, 1), (None, 1), (5, 7), (3, 0)], "doc_id long, toxic int")
    assert toxicity.labelled(edge_docs, labels, "toxic", "true", {1: 10, 0: 10}, 500) == [(1, PROSE), (0, "")]


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "jaccard_join", "substring_dedup", "decontamination", "byte_bpe"]
    docs = common.table(spark, SF, "documents")
    rng = random.Random(15)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    clean, long = " ".join(words(rng, 200)), words(rng, 300)
    near = [*long[:150], "changed", *long[151:]]
    passage = " ".join(words(rng, 70))
    planted = [
        (10_001, clean), (10_002, " ".join(long)), (10_003, " ".join(near)),
        (10_004, " ".join(words(rng, 50)) + " " + item + " " + " ".join(words(rng, 50))),
        (10_005, " ".join(words(rng, 80)) + " " + passage), (10_006, passage + " " + " ".join(words(rng, 80)))
    ]
    docs = common.stored(docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in planted], docs.schema)), "test-docs")
    before = docs
    for name, stage in p.STAGES[:-1]:
        after = common.stored(stage(spark, docs, SF), "test-stage")
        assert after.columns == before.columns, name
        docs = after
    final = {r.doc_id: r for r in p.STAGES[-1][1](spark, docs, SF).collect()}
    assert {10_001, 10_002, 10_005, 10_006} <= set(final) and not {10_003, 10_004} & set(final)
    assert final[10_001].text == clean and final[10_005].text == dict(planted)[10_005] and len(final[10_006].text) < len(dict(planted)[10_006]) - 200
    assert all(r.decoded == r.text and len(r.ids) == r.n_tokens and r.n_chars == len(r.text) for r in final.values() if r.doc_id > 10_000)
    for name, stage in p.STAGES:
        assert stage(spark, before.where("false"), SF).count() == 0, name


def test_pipeline_on_odd_rows(spark, edge_docs):
    """Nulls in any column, empty and very long texts, rows that repeat, ids that repeat, further columns with clashing names."""
    import corpus_pipeline as p

    again = documents(
        spark,
        [
            (1, PROSE), (None, None), (11, None), (12, "one of a kind and nothing else"),
            (12, "another text of the same document"), (13, "another text of the same document")
        ]
    )
    nulls = documents(spark, [(14, "a row of nulls")]).select(
        "doc_id", "text", *(F.lit(None).cast(f.dataType).alias(f.name) for f in edge_docs.schema.fields[2:])
    )
    docs = common.stored(edge_docs.unionByName(again).unionByName(nulls), "odd-docs")
    rows = docs.collect()
    assert "ids" in docs.columns and "n_tokens" in docs.columns
    for name, stage in p.STAGES[:-1]:
        after = common.stored(stage(spark, docs, SF), "odd-stage")
        assert after.columns == docs.columns, name
        docs = after
    got = p.STAGES[-1][1](spark, docs, SF).collect()
    gone = {13}  # its text is one of document 12's
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows if r.doc_id not in gone)
    assert all(r.decoded == (r.text or "") and r.n_tokens == len(r.ids) and r.ids_in in ("x", None) for r in got)
    assert sum(r.doc_id == 1 and r.text == PROSE for r in got) == 3 and sum(r.doc_id is None and r.text is None for r in got) == 2
    assert {r.text for r in got if r.doc_id == 12} == {"one of a kind and nothing else", "another text of the same document"}


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {n.split("_")[0] for n in names if n[:2] == "op" and n[2].isdigit()} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(e.oracle_sql()) <= names
