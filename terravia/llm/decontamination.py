"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

Words are runs of letters, digits and marks, in small letters. The impact of a word in an item is its
BM25 weight over the item's own total, so a score is the share of an item that a passage holds, and one
threshold fits items of all lengths. Every document is cut into passages of twice the words of the longest
item, each overlapping the next by half, so any item stands whole in one; every passage is a query,
whatever its words.

Postings are lists by word, in blocks of PER items, aligned for all words; a word has its largest impact in each block
that holds it, and its largest of all. For a batch of passages, the words whose largest impacts together do not reach a share
of the threshold are set aside (no item is found by these alone); the block impacts of the others are summed by passage and block, and
where these and what was set aside could reach the threshold, the block impacts of the words set aside are looked up. Only blocks whose bound
still reaches the threshold are opened, and WAND goes through their items: lists in order of their next item, the bounds of
the words so far up to the threshold give the pivot, lists before it skip to it. Every item at or above the threshold comes
out. These are verified: at least ``overlap`` of the question's shingles of five words, and of the answer's, stand in the passage (a
question or answer with fewer words is one shingle). The answer is what follows the last question mark, else the last
sentence, of a single sentence its last third.

Memory follows the passages at hand (ENTRIES sums at once), and the index: this is made in parts of ``part_chars`` characters of
test items or so, each broadcast and searched in turn, with the word counts of all items; so a benchmark may be of any
size, and scores do not depend on its parts. Documents have no bound.

Defined results: null and empty texts hold nothing; items without words are never found; null item_ids and
doc_ids are passed through; rows that repeat an id are searched alone, each with rows of its own; of passages that
score alike the first is told; very long texts are searched whole; an empty benchmark finds nothing, and empty documents give no rows;
further columns are not read by search(), and stay as they are in filtered().
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K1, B, SHINGLE = 1.2, 0.75, 5
#: Items in a block; sums of passage and block that are held at once; characters of texts in a batch.
PER, ENTRIES, BATCH = 4, 1 << 20, 1 << 19
#: The words set aside can give this share of the threshold at most: more spares sums, less spares looking up.
ASIDE = 0.3
EPS, TIE = 1e-6, 1e-9


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below 0x10000: the hash of its small letter, and whether it is part of a word."""
    import unicodedata

    low, word = np.arange(0x10000, dtype=np.uint64), np.zeros(0x10000, bool)
    for cp in range(0x10000):
        c = chr(cp)
        if cp < 0x80 or unicodedata.category(c)[0] in "LNM":
            word[cp] = cp >= 0x80 or c.isalnum()
            low[cp] = ord(c.lower()[0])
    return common.mix(low + np.uint64(0x5851F42D4C957F2D)), word


_TABLES: list = []


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as hashes, and the number of the first word of each text (and the end)."""
    if not _TABLES:
        _TABLES.extend(_tables())
    low, word = _TABLES
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    clipped = np.minimum(points, 0xFFFF)
    inside = word[clipped] | (points > 0xFFFF)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    with np.errstate(over="ignore"):
        size = ends - starts
        at = np.flatnonzero(inside)
        place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        value = low[clipped[at]] + np.where(points[at] > 0xFFFF, points[at], 0).astype(np.uint64)
        terms = value * common._powers(int(place.max()) + 1)[place]
        hashes = common.mix(np.add.reduceat(terms, np.cumsum(size) - size) + size.astype(np.uint64))
    return hashes, np.searchsorted(starts, first)


def shingles(words: np.ndarray) -> np.ndarray:
    return common.shingle_hashes(words, SHINGLE)


def question_and_answer(text: str) -> tuple[str, str]:
    for pattern in (r"(?s)(.*\?)(.*\w.*)", r"(?s)(.*[.!?。])\s+(\S.*)"):
        if (m := re.fullmatch(pattern, text.rstrip())) and re.search(r"\w", m[1]):
            return m[1], m[2]
    words = text.split()
    cut = max(1, len(words) - max(1, len(words) // 3))
    return " ".join(words[:cut]), " ".join(words[cut:])


class Statistics:
    """What BM25 weighs with: the number of items, their mean and greatest length, and how many hold each word."""

    def __init__(self):
        self.words, self.held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.items, self.length, self.longest = 0, 0, 1

    def add(self, texts: list[str]) -> None:
        hashes, first = word_hashes(texts)
        n = np.diff(first)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        words, held = np.unique(h[new], return_counts=True)
        self.words, at = np.unique(np.concatenate([self.words, words]), return_inverse=True)
        self.held = np.bincount(at, np.concatenate([self.held, held]), len(self.words)).astype(np.int64)
        self.items += int((n > 0).sum())
        self.length += int(n.sum())
        self.longest = max(self.longest, int(n.max(initial=0)))


class Index:
    """Postings by word, in order of items: impacts, and the largest impact of each block and of all."""

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float, overlap: float, statistics: Statistics | None = None):
        self.threshold, self.overlap = threshold, overlap
        kept = [(i, t) for i, t in items if t]
        if statistics is None:
            statistics = Statistics()
            statistics.add([t for _, t in kept])
        hashes, first = word_hashes([t for _, t in kept])
        n = np.diff(first)
        kept, n = [k for k, x in zip(kept, n.tolist(), strict=True) if x], n[n > 0]
        self.ids, self.longest = [i for i, _ in kept], statistics.longest
        self.words, term = np.unique(hashes, return_inverse=True)
        self.blocks = max(1, -(-len(n) // PER))
        pair, count = np.unique(term * max(1, len(n)) + np.repeat(np.arange(len(n)), n), return_counts=True)
        term, self.items = pair // max(1, len(n)), pair % max(1, len(n))
        held = statistics.held[np.searchsorted(statistics.words, self.words)]
        idf = np.log1p((statistics.items - held + 0.5) / (held + 0.5))
        mean = statistics.length / max(1, statistics.items)
        weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * n[self.items] / max(mean, 1e-9)))
        self.impacts = weight / np.bincount(self.items, weight, len(n))[self.items]
        # (word, block): where its postings begin, and its largest impact; then the same by word
        key = term * self.blocks + self.items // PER
        self.begin = np.flatnonzero(np.diff(key, prepend=-1))
        self.keys, self.end = key[self.begin], np.append(self.begin, len(key))[1:]
        self.bounds = np.maximum.reduceat(self.impacts, self.begin) if len(key) else np.zeros(0)
        self.first = np.searchsorted(self.keys, np.arange(len(self.words) + 1) * self.blocks)
        self.most = np.maximum.reduceat(self.bounds, self.first[:-1]) if len(key) else np.zeros(0)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.words >> np.uint64(48)).astype(np.int64)] = True
        parts = [question_and_answer(t) for _, t in kept]
        self.parts = []
        for q, a in parts:
            h, f = word_hashes([q, a])
            self.parts.append((shingles(h[f[0] : f[1]]), shingles(h[f[1] : f[2]])))

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        out = np.full(len(hashes), -1)
        if not len(self.words):
            return out
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, hashes[some]), len(self.words) - 1)
        hit = self.words[at] == hashes[some]
        out[some[hit]] = at[hit]
        return out

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """The items that hold a word, and its impacts."""
        a, b = self.first[term], self.first[term + 1]
        if a == b:
            return self.items[:0], self.impacts[:0]
        some = slice(self.begin[a], self.end[b - 1])
        return self.items[some], self.impacts[some]

    def _bounds(self, word: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each (word, block), and its largest impact, 0 where the block doesn't hold the word."""
        key = word * self.blocks + block
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, np.where(self.keys[at] == key, self.bounds[at], 0.0)

    def opened(self, of: np.ndarray, word: np.ndarray, n: int) -> list[tuple[int, int]]:
        """(passage, block) where the sum of the largest impacts reaches the threshold. Passage of[i] (from 0, sorted) holds word[i], once."""
        need = self.threshold - 1e-5
        if not len(word):
            return []
        order = np.lexsort((self.most[word], of))  # by passage, the least impacts first
        most = np.cumsum(self.most[word[order]])
        cut = np.searchsorted(of, np.arange(n + 1))
        before = np.concatenate([[0.0], most])[cut[:-1]]
        upto = most - before[of[order]]  # of is sorted, so of[order] is of
        essential = upto >= need * ASIDE
        aside = np.zeros(n)
        np.maximum.at(aside, of[~essential], upto[~essential])
        ranked, out = word[order], []
        step = max(1, ENTRIES // self.blocks)
        for low in range(0, n, step):
            high = min(n, low + step)
            here = np.arange(cut[low], cut[high])
            some = here[essential[here]]
            if not len(some):
                continue
            a, size = self.first[ranked[some]], np.diff(self.first)[ranked[some]]
            sums = np.zeros((high - low) * self.blocks)
            at = 0
            ends = np.cumsum(size)
            while at < len(some):  # as many words at once as have ENTRIES blocks
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ENTRIES, "right")))
                k = size[at:to]
                entry = np.repeat(a[at:to] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                where = np.repeat((of[some[at:to]] - low) * self.blocks, k) + self.keys[entry] % self.blocks
                sums += np.bincount(where, self.bounds[entry], len(sums))
                at = to
            found = np.flatnonzero(sums + np.repeat(aside[low:high], self.blocks) >= need)
            found = found[sums[found] > 0]
            passage, block, total = found // self.blocks + low, found % self.blocks, sums[found]
            # what was set aside stands before the rest of its passage
            n_aside = np.bincount(of[here[~essential[here]]] - low, minlength=high - low)[passage - low]
            pick = np.repeat(cut[passage] - (np.cumsum(n_aside) - n_aside), n_aside) + np.arange(n_aside.sum())
            _, more = self._bounds(ranked[pick], np.repeat(block, n_aside))
            total += np.bincount(np.repeat(np.arange(len(found)), n_aside), more, len(found))
            out += [(int(p), int(k)) for p, k in zip(passage[total >= need], block[total >= need], strict=True)]
        return out

    def search(self, terms: np.ndarray, block: int) -> list[tuple[int, float]]:
        """Every item of the block whose score for a query of these words is at least the threshold."""
        need, found, end = self.threshold - EPS, [], (block + 1) * PER
        at, bounds = self._bounds(np.asarray(terms), np.full(len(terms), block))
        lists = []
        for i in np.flatnonzero(bounds).tolist():
            some = slice(self.begin[at[i]], self.end[at[i]])
            docs = self.items[some].tolist()
            lists.append([docs[0], i, 0, docs, self.impacts[some].tolist(), float(bounds[i])])
        while True:
            lists.sort()
            total, pivot = 0.0, None
            for x in lists:
                total += x[5]
                if total >= need:
                    pivot = x[0]
                    break
            if pivot is None:
                return found
            if lists[0][0] == pivot:
                here = [x for x in lists if x[0] == pivot]
                score = sum(x[4][x[2]] for x in here)
                if score >= need:
                    found.append((pivot, score))
                skip, to = here, pivot + 1
            else:
                skip, to = [x for x in lists if x[0] < pivot], pivot
            for x in skip:
                x[2] = bisect_left(x[3], to, x[2])
                x[0] = x[3][x[2]] if x[2] < len(x[3]) else end
            lists = [x for x in lists if x[0] < end]

    def search_all(self, terms: list[int]) -> list[tuple[int, float]]:
        """Every item whose score for a query of these distinct words is at least the threshold."""
        words = np.array(terms, np.int64)
        return [x for _, k in self.opened(np.zeros(len(words), np.int64), words, 1) for x in self.search(words, k)]

    def verified(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and the answer's shingles in the passage."""
        out = []
        for part in self.parts[item]:
            if not len(part):
                out.append(1.0)
                continue
            out.append(float(np.isin(part, self._runs(passage, part)).mean()))
        return out[0], out[1]

    def _runs(self, passage: np.ndarray, part: np.ndarray) -> np.ndarray:
        # a part shorter than a shingle is one shingle of all its words: try its possible lengths
        sizes = range(1, SHINGLE + 1) if len(part) == 1 else (SHINGLE,)
        return np.concatenate([common.shingle_hashes(passage, k) for k in sizes])

    def hits(self, texts: list[str | None]) -> list[tuple[int, int, float, float, float, int]]:
        """(text's number, item's number, score, question, answer, passage's first word), the best passage of each text and item."""
        hashes, first = word_hashes([t or "" for t in texts])
        terms = self.terms(hashes)
        step, out, n = self.longest, {}, np.diff(first)
        known = np.flatnonzero(terms >= 0)
        if not len(known):
            return []
        # A passage is a half and the next of its text; the last half begins one only if it is the only one.
        halves = np.maximum(1, -(-n // step))
        count = np.maximum(1, halves - 1)
        base = np.cumsum(count) - count
        text = np.repeat(np.arange(len(n)), n)[known]
        half = (known - first[:-1][text]) // step
        words = max(1, len(self.words))
        own = half < count[text]
        keys = np.concatenate([((base[text] + half) * words + terms[known])[own], ((base[text] + half - 1) * words + terms[known])[half > 0]])
        keys = np.unique(keys)
        of, word = keys // words, keys % words
        cut = np.searchsorted(of, np.arange(count.sum() + 1))
        for k, block in self.opened(of, word, int(count.sum())):
            i = int(np.searchsorted(base, k, "right")) - 1
            a = int(first[i]) + step * (k - int(base[i]))
            b = min(a + 2 * step, int(first[i + 1]))
            for item, score in self.search(word[cut[k] : cut[k + 1]], block):
                question, answer = self.verified(item, hashes[a:b])
                if question >= self.overlap and answer >= self.overlap:
                    key = i, item
                    row = (*key, score, question, answer, a - int(first[i]))
                    if key not in out or out[key][2] < score - TIE:
                        out[key] = row
        return [out[k] for k in sorted(out)]

    def hits_of(self, texts: list[str | None]):
        held, size = [], 0
        for i, t in enumerate(texts):
            held.append(t)
            size += len(t or "")
            if size >= BATCH or i == len(texts) - 1:
                for n, *rest in self.hits(held):
                    yield i + 1 - len(held) + n, *rest
                held, size = [], 0


def index_of(benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, part_chars: int = 4_000_000) -> list[Index]:
    """The index of the test items, in parts; each part's items pass the driver, one part at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // part_chars))

    def part(i: int) -> list[tuple[int | None, str]]:
        rows = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == i).collect()
        return sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))

    statistics = Statistics()
    for i in range(n):
        statistics.add([t for _, t in part(i)])
    return [Index(part(i), threshold, overlap, statistics) for i in range(n)]


def _search(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        ix = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[i], ix.ids[item], *rest) for i, item, *rest in ix.hits_of(batch.column(1).to_pylist())]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        common.tidied(run),
        "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    )


def search(docs: DataFrame, index: list[Index]) -> DataFrame:
    """doc_id and item_id of every verified hit, with its score, overlaps and place."""
    out = _search(docs, index[0])
    for part in index[1:]:
        out = out.unionByName(_search(docs, part))
    return out


def _filtered(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    ddl = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def run(batches):
        ix = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i, *_ in ix.hits_of(batch.column(batch.num_columns - 1).to_pylist()):
                keep[i] = False
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(keep))

    named = docs.select(
        *(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(docs.schema.fields)),
        F.col("text").cast("string").alias("searched")
    )
    return named.mapInArrow(common.tidied(run), ddl).toDF(*docs.columns)


def filtered(docs: DataFrame, index: list[Index]) -> DataFrame:
    """The rows of docs without a verified hit, all columns as they are. Between parts of the index what is left is stored, so a
    worker has one part at a time."""
    out = _filtered(docs, index[0])
    for part in index[1:]:
        out = _filtered(common.stored(out, "decontaminated"), part)
    return out


def op5(spark, sf_dir: str) -> DataFrame:
    found = search(common.table(spark, sf_dir, "documents"), index_of(common.table(spark, sf_dir, "benchmark")))
    shares = (F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap"))
    return found.select("doc_id", "item_id", *shares, "first_word")


def _words_sql(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: x <> '')"


def _shingles_sql(words: str, k: str) -> str:
    return f"CASE WHEN len({words}) < {k} THEN [] ELSE list_transform(range(1, len({words}) - {k} + 2), lambda i: array_to_string({words}[i:i + {k} - 1], ' ')) END"


def _overlap_sql(side: str) -> str:
    return f"coalesce((SELECT len(list_intersect(g, {_shingles_sql('w', 'k')})) / len(g) FROM shingled s WHERE s.item_id = hit.item_id AND side = '{side}'), 1.0)"


def sql(threshold: float = 0.5, overlap: float = 0.8) -> str:
    """The rows of op5, by scoring every passage against every item that shares a word."""
    cut = "greatest(1, len(ws) - greatest(1, len(ws) // 3))"
    word = "'[\\p{L}\\p{N}_]'"
    return f"""
WITH b AS (SELECT item_id, rtrim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text, {_words_sql("text")} AS w FROM benchmark WHERE len({_words_sql("text")}) > 0),
size AS (SELECT count(*) AS items, avg(len(w)) AS mean, max(len(w)) AS step FROM b),
tf AS (SELECT item_id, word, count(*) AS n FROM (SELECT item_id, unnest(w) AS word FROM b) GROUP BY ALL),
df AS (SELECT word, count(*) AS held FROM tf GROUP BY word),
raw AS (
  SELECT item_id, word, ln(1 + (items - held + 0.5e0) / (held + 0.5e0)) * n * {K1 + 1}e0 / (n + {K1}e0 * ({1 - B}e0 + {B}e0 * len(w) / mean)) AS x
  FROM tf JOIN df USING (word) JOIN b USING (item_id), size),
impact AS MATERIALIZED (SELECT item_id, word, x / sum(x) OVER (PARTITION BY item_id) AS x FROM raw),
cutting AS (
  SELECT *, regexp_extract(text, '(?s)^(.*\\?)(.*[\\p{{L}}\\p{{N}}_].*)$', ['q', 'a']) AS one,
    regexp_extract(text, '(?s)^(.*[.!?。])\\s+(\\S.*)$', ['q', 'a']) AS two, string_split_regex(trim(text), '\\s+') AS ws
  FROM b),
part AS (
  SELECT item_id, unnest(['q', 'a']) AS side, unnest(
    CASE WHEN one.q <> '' AND regexp_matches(one.q, {word}) THEN [one.q, one.a] WHEN two.q <> '' AND regexp_matches(two.q, {word}) THEN [two.q, two.a]
    ELSE [array_to_string(ws[1:{cut}], ' '), array_to_string(ws[{cut} + 1:], ' ')] END) AS p
  FROM cutting),
shingled AS MATERIALIZED (
  SELECT item_id, side, list_distinct({_shingles_sql("w", f"least({SHINGLE}, len(w))")}) AS g, least({SHINGLE}, len(w)) AS k
  FROM (SELECT item_id, side, {_words_sql("p")} AS w FROM part) WHERE len(w) > 0),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words_sql("text")} AS w FROM documents),
passage AS MATERIALIZED (
  SELECT r, doc_id, j, w[j * step + 1:j * step + 2 * step] AS w, j * step AS first_word
  FROM (SELECT *, unnest(range(greatest(1, CAST(ceil(len(w) / step) AS BIGINT) - 1))) AS j FROM d, size)),
words AS (SELECT DISTINCT r, j, unnest(w) AS word FROM passage),
hit AS MATERIALIZED (SELECT r, j, item_id, sum(x) AS score FROM words JOIN impact USING (word) GROUP BY ALL HAVING sum(x) >= {threshold} - {EPS}),
verified AS (SELECT hit.*, doc_id, first_word, {_overlap_sql("q")} AS q, {_overlap_sql("a")} AS a FROM hit JOIN passage USING (r, j)),
best AS (SELECT *, row_number() OVER (PARTITION BY r, item_id ORDER BY round(score, 8) DESC, j) AS nth FROM verified WHERE q >= {overlap} AND a >= {overlap})
SELECT doc_id, item_id, round(score, 6) AS score, round(q, 6) AS question_overlap, round(a, 6) AS answer_overlap, first_word FROM best WHERE nth = 1
"""
