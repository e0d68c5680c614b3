"""Byte-level BPE: exact merges in linear time by backtracking over longest matches.

A text is cut into pieces by the tokenizer's pattern; every distinct piece is encoded once. Its bytes,
as Latin-1 characters, go through a pyahocorasick automaton of the vocabulary, which gives the
longest token at each place. A row of tokens is what the merges give if and only if each two
neighbours are compatible, that is, if merging the bytes of both gives the two again; compatibility
is memoised. Where the longest token fails, the next shorter one at that place is tried, and where
none is left, the token before is given up; places that lead nowhere are remembered, so a piece
takes steps in proportion to its length.

Pieces are found with numpy, for batches of texts at once: classes of characters from a table made
with the pattern's own classes, boundaries from runs of a class. Equal pieces are found by a 64-bit
hash. The ids of a batch are decoded and held against its bytes, so a collision can't pass: the
batch is then done again piece by piece.

Texts over CHUNK characters are cut before white space, where a piece always ends. Null text is
empty: no ids, empty decoded. Null and repeated ids pass through as they are, equal texts have equal ids, an empty table
gives no rows; a column of the input that is called n_tokens, ids or decoded stays, with _in after its name. The cache of
encoded pieces is emptied when it holds CACHE pieces; this bounds memory and changes no result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK, CACHE = 1 << 19, 200_000
_BREAK = "Ā"  # in no token, so no match goes over it


class Tokenizer:
    """A vocabulary of byte strings by rank."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.token = dict(zip(self.rank.values(), self.rank.keys(), strict=True))
        self.match = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.match.add_word(token.decode("latin-1"), rank)
        self.match.make_automaton()
        self.shorter: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}
        self.cache: dict[bytes, bytes] = {}
        size = max(self.token) + 1
        self.length = np.zeros(size, np.int64)
        for rank, token in self.token.items():
            self.length[rank] = len(token)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(size)), np.uint8)
        self.kind = classes()

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        if (found := self.shorter.get(token)) is None:
            raw = self.token[token]
            found = next((self.rank[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in self.rank), -1)
            self.shorter[token] = found
        return found

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; itself twice for a single byte."""
        if (found := self.halves.get(token)) is None:
            parts = merged(self.token[token], self.rank, below=token)
            found = (parts[0], parts[1]) if len(parts) == 2 else (token, token)
            self.halves[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of left's and right's bytes end with these two tokens.

        Undoes the merges of both sides, latest first, and looks at the pair that then meets in the
        middle: had it a merge that comes before the one just undone, that merge would have been made.
        """
        key = left << 32 | right
        if (known := self.fits.get(key)) is not None:
            return known
        a, b, undone, fine = left, right, 1 << 62, True
        while True:
            joint = self.rank.get(self.token[a] + self.token[b])
            if joint is not None and joint < undone:
                fine = False
                break
            a_left, a_right = self.split(a)
            b_left, b_right = self.split(b)
            a_whole, b_whole = a_left == a == a_right, b_left == b == b_right
            if a_whole and b_whole:
                break
            # Of equal ranks the one on the left was merged first, so the right one is undone first.
            if b_whole or (not a_whole and a > b):
                undone, a = a, a_right
            else:
                undone, b = b + 1, b_left
        self.fits[key] = fine
        return fine

    def backtrack(self, piece: str) -> list[int]:
        n, at, out = len(piece), 0, []
        longest = self.match.iter_long
        token = next(longest(piece, 0, n))[1]
        dead = set()
        while True:
            end = at + int(self.length[token])
            if end not in dead and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = next(longest(piece, at, n))[1]
                continue
            token = self.next_shorter(token)
            while token < 0:  # no token leads on from here
                dead.add(at)
                token = out.pop()
                at -= int(self.length[token])
                token = self.next_shorter(token)

    def forget(self) -> None:
        """Empties the caches that grow with what has been encoded."""
        self.cache.clear()
        if len(self.fits) > CACHE:
            self.fits.clear()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        cache = self.cache
        if len(cache) > CACHE:
            self.forget()
        new = [p for p in pieces if p not in cache]
        if new:
            texts = [p.decode("latin-1") for p in new]
            ends, ids = zip(*self.match.iter_long(_BREAK.join(texts)), strict=True)
            ids = np.array(ids, np.int64)
            sizes = np.array([len(p) for p in new])
            lasts = np.cumsum(sizes + 1) - 2  # place of each piece's last character
            of = np.searchsorted(lasts, np.array(ends))
            same = of[1:] == of[:-1]
            pairs = ids[:-1] << 32 | ids[1:]
            codes, back = np.unique(pairs[same], return_inverse=True)
            fine = np.array([self.compatible(c >> 32, c & 0xFFFFFFFF) for c in codes.tolist()], bool)
            wrong = np.zeros(len(new), bool)
            wrong[of[1:][same][~fine[back]]] = True
            cut = np.searchsorted(of, np.arange(len(new) + 1))
            flat, cut = ids.astype("<u4").tobytes(), (cut * 4).tolist()
            rank = self.rank
            for i, (p, bad) in enumerate(zip(new, wrong.tolist(), strict=True)):
                if p in rank:  # as the library: a piece that is a token is that token
                    cache[p] = rank[p].to_bytes(4, "little")
                else:
                    cache[p] = np.array(self.backtrack(texts[i]), "<u4").tobytes() if bad else flat[cut[i] : cut[i + 1]]
        return [cache[p] for p in pieces]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return gathered(self.bytes, self.start[ids], self.length[ids])

    def encoded(self, held: list[tuple[int, str]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        texts = [c for _, c in held]
        ids, counts = self.encode_batch(texts)
        raw = self.decode(ids)
        sizes = np.add.reduceat(np.append(self.length[ids], 0), np.minimum(np.cumsum(counts) - counts, len(ids))) * (counts > 0)
        yield from zip([i for i, _ in held], np.split(ids, np.cumsum(counts)[:-1]), np.split(raw, np.cumsum(sizes)[:-1]), strict=True)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the number of each text's."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        raw = np.frombuffer("".join(texts).encode("utf-8"), np.uint8)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        marks = starts(points, self.kind[points], first[:-1])
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        place = np.cumsum(width) - width
        at = np.flatnonzero(marks)
        from_, to = place[at], np.append(place[at[1:]], len(raw))
        hashes = piece_hashes(raw, from_, to)
        _, some, back = np.unique(hashes, return_index=True, return_inverse=True)
        buffer = raw.tobytes()
        codes = self.encode_pieces([buffer[a:b] for a, b in zip(from_[some].tolist(), to[some].tolist(), strict=True)])
        sizes = np.array([len(c) for c in codes]) // 4
        ids = gathered(np.frombuffer(b"".join(codes), "<u4"), (np.cumsum(sizes) - sizes)[back], sizes[back])
        if not np.array_equal(self.decode(ids), raw):  # two pieces of one hash
            codes = self.encode_pieces([buffer[a:b] for a, b in zip(from_.tolist(), to.tolist(), strict=True)])
            sizes, back = np.array([len(c) for c in codes]) // 4, np.arange(len(codes))
            ids = np.frombuffer(b"".join(codes), "<u4")
        counts = np.concatenate([[0], np.cumsum(sizes[back])])
        return ids, np.diff(counts[np.searchsorted(at, first)])


def merged(raw: bytes, rank: dict[bytes, int], below: int = 1 << 62) -> list[int]:
    """The plain merges: the pair of lowest rank first, the leftmost of equals."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        best, i = min((rank.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [rank[p] for p in parts]


def gathered(source: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """source[start : start + length] of each pair, joined."""
    ends = np.cumsum(length)
    if not len(ends):
        return source[:0]
    return source[np.repeat(start - (ends - length), length) + np.arange(ends[-1])]


LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        text = "".join(map(chr, range(lo, hi)))
        for kind, cls in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(cls, text):
                out[lo + m.start() : lo + m.end()] = kind
    return out


def starts(points: np.ndarray, kind: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Marks the first character of each piece of public_tokenizers.PATTERN."""
    n = len(points)
    mark = np.ones(n, bool)
    mark[1:] = kind[1:] != kind[:-1]
    firsts = firsts[firsts < n]
    mark[firsts] = True
    begin = np.flatnonzero(mark)
    end = np.append(begin[1:], n)
    ends_text = np.zeros(n + 1, bool)
    ends_text[firsts] = True
    ends_text[n] = True
    # White space before a word gives up its last character: a blank joins the word, others stand alone.
    blank = (kind[begin] == SPACE) & ~ends_text[end]
    last = end[blank] - 1
    mark[last] = True
    mark[last[points[last] == 0x20] + 1] = False
    # An apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it.
    lone = begin[(kind[begin] == OTHER) & (points[begin] == 0x27) & (end - begin == 1)]
    lone = lone[mark[lone]]
    padded = np.append(points, [0, 0])
    tail = np.append(ends_text, [True])
    one, two = padded[lone + 1], padded[lone + 2]
    near = ~tail[lone + 1]
    near_two = near & ~tail[np.minimum(lone + 2, n)]
    single = near & np.isin(one, [ord(c) for c in "stmd"])
    double = near_two & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    for which, size in ((lone[single], 2), (lone[double], 3)):
        mark[which + 1] = False
        after = which + size
        mark[after[after < n]] = True
    return mark


def piece_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - begin
    with np.errstate(over="ignore"):
        place = np.arange(len(raw)) - np.repeat(begin, size)
        terms = common._BYTE[raw] * common._powers(int(place.max()) + 1)[place]
        return common.mix(np.add.reduceat(terms, begin) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chunks(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > CHUNK:
        found = _CUT.search(text, at + CHUNK)
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


_CUT = regex.compile(r"(?<=\S)(?=\s)")
_OPEN: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for each Python worker."""
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = Tokenizer(path, pattern)
    return _OPEN[path, pattern]


def chunk_ids(t: Tokenizer, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk of each text: the text's number, the ids, the bytes decoded from them."""
    held: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        for chunk in chunks(text or ""):
            held.append((i, chunk))
            size += len(chunk)
            if size >= CHUNK:
                yield from t.encoded(held)
                held, size = [], 0
    if held:
        yield from t.encoded(held)


def encode_texts(t: Tokenizer, texts: list[str | None]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """For each text: the ids and the decoded bytes of each of its chunks."""
    now, ids_of, raw_of = 0, [], []
    for i, ids, raw in chunk_ids(t, texts):
        if i != now:
            yield ids_of, raw_of
            now, ids_of, raw_of = i, [], []
        ids_of.append(ids)
        raw_of.append(raw)
    if texts:
        yield ids_of, raw_of


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _digests(path: str, pattern: str):
    def run(batches):
        t = tokenizer(path, pattern)
        for batch in batches:
            rows = []
            for ids, raw in encode_texts(t, batch.column(1).to_pylist()):
                of_ids, of_raw = hashlib.sha256(), hashlib.sha256()
                for x in ids:
                    of_ids.update(x.astype("<u4").tobytes())
                for x in raw:
                    of_raw.update(x.tobytes())
                rows.append((sum(map(len, ids)), of_ids.hexdigest(), of_raw.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string())))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )
        t.forget()

    return run


def _columns(path: str, pattern: str):
    def run(batches):
        t = tokenizer(path, pattern)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for at in range(0, max(1, len(texts)), 512):
                ids, decoded, part = [], [], texts[at : at + 512]
                for x, raw in encode_texts(t, part):
                    ids.append(np.concatenate([*x, np.zeros(0, np.uint32)]).astype(np.int32))
                    decoded.append(b"".join(r.tobytes() for r in raw).decode("utf-8"))
                kept = batch.slice(at, 512).columns[:-1]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                    [*batch.schema.names[:-1], *("n_tokens", "ids", "decoded")]
                )
        t.forget()

    return run


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids and decoded (the text decoded from the ids); columns that had these names end in _in."""
    path, pat = default_vocabulary()
    kept, new = docs.schema.fields, ("n_tokens", "ids", "decoded")
    taken, names = {f.name.lower() for f in kept} | set(new), []
    for f in kept:
        name = f.name
        while name.lower() in new or (name != f.name and name.lower() in taken):
            name += "_in"
        taken.add(name.lower())
        names.append(name)
    named = docs.select(*(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)), F.col(text_col).cast("string").alias("encoded"))
    ddl = "".join(f"c{i} {f.dataType.simpleString()}, " for i, f in enumerate(kept))
    return named.mapInArrow(
        common.tidied(_columns(vocabulary or path, pattern or pat)),
        ddl + "n_tokens long, ids array<int>, decoded string"
    ).toDF(*names, *new)


def digests(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """The same ids and decoded bytes, as their digests."""
    path, pat = default_vocabulary()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(
        common.tidied(_digests(vocabulary or path, pattern or pat)),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op3(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
