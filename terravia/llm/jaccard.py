"""Exact n-gram Jaccard join by a token-group matrix.

Documents with equal sets are one class. Classes are linked when 100 * intersection >= percent * union.

1. Candidate keys. Sets in a size band that are linked differ in at most H tokens, so of n blocks of the hash range
   n - H at least hold the same tokens in both. A class has a key for each block: a hash of the block's tokens. Bands
   overlap by what a link may differ in size. Blocks of very few tokens, or only of such as many documents share
   (light ones), are the same in unlike sets; a class leaves them out unless it has more of them than there are blocks to spare. From its size and its light blocks,
   or the most that the other may have left out where it keeps its own, follows how many keys a class has in common with
   any class it is linked to, at least: ``need``.
2. Rows (key, class) are sorted over all tasks by range, so a key that a third of all classes have is spread over
   tasks; keys of one class go. A class with fewer than ``need`` keys left has no link and goes, and the keys that
   are then of one class again, and so once more: what chance has brought together is gone without pairing it.
3. Clusters. Each class points to the class that it meets first for most of its keys; what hangs together so is a
   cluster of similar classes, dealt to parts of PART_TOKENS tokens or PART_MEMBERS classes at most.
4. Token-group matrix. A part's classes, similar ones next to each other, are stored in groups of at most MEMBERS with
   the union of each group's tokens. A class's overlap with a union bounds its overlap with every member, so only groups
   that could reach the threshold are opened, and their members compared exactly. Within a part the links are
   followed class by class, each held only against the classes that no link has reached yet. A class asks a part
   that is not its own if they have PREFIX keys in common that are not among the need - PREFIX most frequent of
   either's, and is told one link to each component of that part, not one to each member.

So no two documents that links join are kept apart, and neither copies nor near copies, however many, become rows of
pairs. Tokens are 64-bit hashes of shingles, classes 64-bit digests of their tokens.

Defined results: null and empty texts, and texts of white space, have no shingles and no links; a text of fewer words
than a shingle is one shingle; rows of equal doc_id count as one document (their texts' components are one); a null
doc_id has no links and a null component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import components

RATIO, MARGIN, SEEN = 1.6, 0.15, 500_000
#: Classes in a group of the matrix; tokens and classes in a part, which a worker holds at once; classes that ask a part in one task.
MEMBERS, PART_TOKENS, PART_MEMBERS, ASKS = 32, 2_000_000, 4096, 2048
#: What counts as a frequent token: see _often() and frequent_tokens().
LOCAL, PIECE, MOST = 4, 4_000_000, 200_000
#: So many keys a class must share with a part that it asks, of those that are not its most frequent.
PREFIX = 4


class Bands:
    """Sizes in bands, and the blocks of each: the least size, the blocks and how many of these are spare."""

    def __init__(self, percent: int, most: int = 1 << 40):
        self.percent = percent
        self.low, self.high, self.blocks, self.spare, self.extra, self.light = [], [], [], [], [], []
        low = 1
        while low < most:
            high = max(int(low * RATIO), low)
            differ = (100 - percent) * 2 * high // (100 + percent)
            extra = max(3, int(MARGIN * differ))  # blocks beyond the least number: so many more keys two linked sets share
            usual = high / RATIO**0.5
            blocks, spare, light = differ + 1 + extra, 0, -1
            for most_held in range(round(usual / (differ + 1 + extra) / 4), -1, -1) if differ else ():
                # until the spare blocks are as many as light ones are to be expected; sets too small for this keep all keys
                n, more = differ + 1 + extra, 0
                for _ in range(20):
                    rate = usual / n
                    p = sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(most_held + 1))
                    more = math.ceil(n * p + 2 * math.sqrt(n * p))
                    n = differ + 1 + extra + more
                if n <= 1.3 * (differ + 1 + extra) + 1:
                    blocks, spare, light = n, more, most_held
                    break
            self.low.append(low)
            self.high.append(high)
            self.blocks.append(blocks if differ else 0)
            self.spare.append(spare)
            self.extra.append(extra)
            self.light.append(light)
            low = high + 1
        self.lows = np.array(self.low)
        self.cuts: dict[int, np.ndarray] = {}

    def cut(self, n: int) -> np.ndarray:
        """The least hash of each of n blocks."""
        if n not in self.cuts:
            if len(self.cuts) > 200:
                self.cuts.clear()
            self.cuts[n] = np.array([(j << 64) // n for j in range(n)], np.uint64)
        return self.cuts[n]

    def keys(self, tokens: np.ndarray, frequent: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        """The keys of a sorted set of tokens, and how many of them a linked set has too, at least. A block is light by what it
        holds, so it is light in both sets or in neither: few tokens, or none that isn't frequent."""
        size, t = len(tokens), self.percent
        if not size:
            return np.zeros(0, np.uint64), 0
        home = int(np.searchsorted(self.lows, size, "right")) - 1
        out, need = [], []
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(tokens ^ np.uint64(0x6C62272E07BB0142)), dtype=np.uint64)])
            if frequent is not None and len(frequent):
                place = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                rare = np.concatenate([[0], np.cumsum(frequent[place] != tokens)])
            for band in (home, home + 1):
                n = self.blocks[band]
                if not n or band > home and 100 * size < t * self.low[band]:
                    continue
                at = np.append(np.searchsorted(tokens, self.cut(n)), size)
                held = np.diff(at)
                light = held <= self.light[band]
                if frequent is not None and len(frequent):
                    light |= np.diff(rare[at]) == 0
                keys = common.mix(
                    total[at[1:]] - total[at[:-1]]
                ) + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band) * np.uint64(0xC2B2AE3D27D4EB4F)
                few, most = int(light.sum()), self.spare[band] + self.extra[band] - 2
                out.append(common.mix(keys[~light] if few <= most else keys))
                largest = min(self.high[band], 100 * size // t)  # of the sets that may be linked and share this band
                # a set that keeps its light keys may be linked to one that has left out as many as `most` of them
                need.append(max(1, n - (100 - t) * (size + largest) // (100 + t) - min(few, most)))
        return (np.concatenate(out), min(need)) if out else (np.zeros(0, np.uint64), 0)


def digest(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        folded = np.sum(common.mix(tokens + np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64) + np.uint64(len(tokens)) * np.uint64(0x9E6C63D0876A9A47)
        return int(common.mix(np.array([folded], np.uint64)).view(np.int64)[0])


def tokens_of(text: str | None, k: int) -> np.ndarray:
    return common.shingle_hashes(common.word_hashes((text or "").encode()), k)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))


def _often(k: int):
    """Tokens that LOCAL documents or more have among those of PIECE tokens, and how many have them."""
    def counted(parts):
        tokens, n = np.unique(np.concatenate(parts), return_counts=True)
        some = n >= LOCAL
        return pa.RecordBatch.from_arrays([pa.array(tokens[some].view(np.int64)), pa.array(n[some])], ["token", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(tokens_of(text, k))
                size += len(held[-1])
                if size >= PIECE:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return run


def frequent_tokens(texts: DataFrame, k: int) -> np.ndarray:
    """At most MOST of the most frequent tokens, sorted. Which ones changes no result, only how many candidates there are."""
    found = texts.mapInArrow(common.tidied(_often(k)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = [r.token for r in found.orderBy(F.desc("n"), "token").limit(MOST).select("token").collect()]
    return np.sort(np.array(top, np.int64).view(np.uint64))


def _keyed(k: int, percent: int, shared):
    def run(batches):
        bands, seen, frequent = Bands(percent), set(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, classes, keys, needs = [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    tokens = tokens_of(text, k)
                    own = digest(tokens)
                    sizes.append(len(tokens))
                    classes.append(own)
                    new = doc_id is not None and own not in seen
                    found, need = bands.keys(tokens, frequent) if new else (np.zeros(0, np.uint64), 0)
                    keys.append(found)
                    needs.append(need if new else None)
                    if new:  # copies met again in this task need not repeat the keys; forgetting some does no harm
                        seen.add(own)
                        if len(seen) > SEEN:
                            seen.clear()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(needs, pa.int32()), _lists(keys)],
                    ["doc_id", "n", "cls", "need", "keys"]
                )

    return run


def _met(batches):
    """Of rows sorted by key, then class: the rows whose key several classes of this task have; and the task's first and last key
    with their first class, marked by the task's number, as the next task may have more of the same key."""
    key = hub = last = None
    task, ends, told = TaskContext.get().partitionId(), [], False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, classes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        carried = key is not None and bool(keys[0] == key)
        run = np.cumsum(new) - 1
        hubs = classes[np.flatnonzero(new)]
        if carried:
            hubs = hubs.copy()
            hubs[0] = hub
        copy = np.zeros(len(keys), bool)  # rows of one class that several tasks have met
        copy[1:] = ~new[1:] & (classes[1:] == classes[:-1])
        copy[0] = carried and bool(classes[0] == last)
        other = (classes != hubs[run]) & ~copy
        again = np.zeros(len(hubs), bool)
        again[run[other]] = True
        same = again.copy()  # runs whose first class is still to be told
        if carried and told:
            same[0] = False
        told = bool(again[-1]) or (told and carried and len(hubs) == 1)
        firsts = np.flatnonzero(same)
        start = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([keys[other], keys[start[firsts]]])),
                pa.array(np.concatenate([classes[other], hubs[firsts]])),
                pa.nulls(int(other.sum()) + len(firsts), pa.int32())
            ],
            ["key", "cls", "task"]
        )
        key, hub, last = keys[-1], hubs[-1], classes[-1]
        if not ends:
            ends.append((keys[0], hubs[0]))
    if ends:
        ends.append((key, hub))
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(k) for k, _ in ends]), pa.array([int(h) for _, h in ends]), pa.array([2 * task, 2 * task + 1], pa.int32())],
            ["key", "cls", "task"]
        )


def _classed(k: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(0)
            yield pa.RecordBatch.from_arrays([pa.array([digest(tokens_of(t, k)) for t in texts.to_pylist()], pa.int64()), texts], ["cls", "text"])

    return run


def linked(overlap, a, b, percent: int):
    """Whether sets of a and b tokens are linked; of numbers or of arrays."""
    return 100 * overlap >= percent * (a + b - overlap)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common tokens of two sorted sets."""
    return len(np.intersect1d(a, b, assume_unique=True))


class Group:
    """Some similar sets and the union of their tokens."""

    def __init__(self, names: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, union: np.ndarray):
        self.names, self.sizes, self.tokens, self.union = names, sizes, tokens, union
        self.starts = np.cumsum(sizes) - sizes


def grouped(names: np.ndarray, sets: list[np.ndarray]) -> list[Group]:
    """The sets in groups of MEMBERS; those with the same least hashes come next to each other."""
    least = np.array([[common.mix(t ^ np.uint64(salt)).min() for salt in (0, 0x5BD1E995, 0x1B873593)] for t in sets], np.uint64)
    order = np.lexsort(least.T)
    out = []
    for at in range(0, len(order), MEMBERS):
        some = order[at : at + MEMBERS]
        tokens = np.concatenate([sets[i] for i in some])
        out.append(Group(names[some], np.array([len(sets[i]) for i in some]), tokens, np.unique(tokens)))
    return out


class Matrix:
    """The token-group matrix: which tokens each group's union has."""

    def __init__(self, groups: list[Group]):
        self.groups = groups
        unions = [g.union for g in groups]
        self.tokens = np.unique(np.concatenate(unions))
        self.rows = np.searchsorted(self.tokens, np.concatenate(unions)).astype(np.int32)
        sizes = np.array([len(u) for u in unions])
        self.starts = np.cumsum(sizes) - sizes
        self.least = np.array([int(g.sizes.min()) for g in groups])
        self.mark = np.zeros(len(self.tokens), np.uint8)
        self.places: dict[int, np.ndarray] = {}

    def search(self, tokens: np.ndarray, percent: int, some: list[np.ndarray] | None = None):
        """(group, numbers of its members that are linked to the set), of the groups whose union could hold one.
        some: for each group which members are asked for."""
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        at = at[self.tokens[at] == tokens]
        self.mark[at] = 1
        bound = np.add.reduceat(self.mark[self.rows], self.starts, dtype=np.int64)
        for g in np.flatnonzero(linked(bound, len(tokens), np.maximum(bound, self.least), percent)).tolist():
            if some is not None and not some[g].any():
                continue
            if g not in self.places:
                self.places[g] = np.searchsorted(self.tokens, self.groups[g].tokens).astype(np.int32)
            both = np.add.reduceat(self.mark[self.places[g]], self.groups[g].starts, dtype=np.int64)
            hit = linked(both, len(tokens), self.groups[g].sizes, percent)
            if some is not None:
                hit &= some[g]
            if hit.any():
                yield g, np.flatnonzero(hit)
        self.mark[at] = 0


def roots(names: np.ndarray, sets: list[np.ndarray], percent: int) -> dict[int, int]:
    """For each set the first of its component. Each is held against those only that no link has reached."""
    own, root = dict(zip(names.tolist(), sets, strict=True)), {}
    matrix = Matrix(grouped(names, sets))
    rest = [np.ones(len(g.names), bool) for g in matrix.groups]
    left = held = len(own)
    for seed in own:
        if seed in root:
            continue
        root[seed], reached = seed, [seed]
        while reached and left:
            now = reached.pop()
            if left < held // 2:  # what is reached need not be carried on
                kept = np.array([n for g, some in zip(matrix.groups, rest, strict=True) for n in g.names[some].tolist()])
                matrix, held = Matrix(grouped(kept, [own[n] for n in kept.tolist()])), left
                rest = [np.ones(len(g.names), bool) for g in matrix.groups]
            for g, found in matrix.search(own[now], percent, rest):
                rest[g][found] = False
                left -= len(found)
                for name in matrix.groups[g].names[found].tolist():
                    if name not in root:
                        root[name] = seed
                        reached.append(name)
    return root


_MATRIX = "classes array<long>, roots array<long>, sizes array<long>, tokens array<long>, union array<long>"


def _parts(batches):
    """Of rows sorted by their first two columns: these and the rest of each row, part by part."""
    now, rows = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            piece = batch.slice(at, 64)
            for row in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                if row[:2] != now:
                    if rows:
                        yield now, rows
                    now, rows = row[:2], []
                rows.append(row[2:])
    if rows:
        yield now, rows


def _stored_groups(k: int, percent: int):
    """Of rows (grp, part, cls, text): the part's groups, each class with the first of its component in the part."""
    def run(batches):
        for (grp, part), rows in _parts(batches):
            names, sets = np.array([r[0] for r in rows], np.int64), [tokens_of(r[1], k) for r in rows]
            root = roots(names, sets, percent)
            for g in grouped(names, sets):
                first = np.array([root[n] for n in g.names.tolist()], np.int64)
                columns = [_lists([x.astype(np.int64, copy=False).view(np.uint64)]) for x in (g.names, first, g.sizes)] + [
                    _lists([g.tokens]), _lists([g.union])
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp], pa.int64()), pa.array([part], pa.int32()), *columns],
                    ["grp", "part", "classes", "roots", "sizes", "tokens", "union"]
                )

    return run


def _asked(k: int, percent: int):
    """Of rows sorted by grp, share and kind: the part's groups (kind 0), then the classes that ask it (kind 1). One link of
    an asking class to each component of the part. Memory holds one part, and no more than a few of the asking classes."""
    def run(batches):
        now, groups, first, matrix = None, [], {}, None
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 16):
                piece = batch.slice(at, 16)
                keys = list(zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True))
                for i, (grp, share, kind) in enumerate(keys):
                    if (grp, share) != now:
                        now, groups, first, matrix = (grp, share), [], {}, None
                    if kind == 0:
                        classes, own, sizes, tokens, union = (piece.column(j)[i].values.to_numpy() for j in range(5, 10))
                        groups.append(Group(classes, sizes, tokens.view(np.uint64), union.view(np.uint64)))
                        first |= zip(classes.tolist(), own.tolist(), strict=True)
                        continue
                    if not groups:
                        continue
                    matrix = matrix or Matrix(groups)
                    cls, text = piece.column(3)[i].as_py(), piece.column(4)[i].as_py()
                    seen = {first[n] for g, some in matrix.search(tokens_of(text, k), percent) for n in groups[g].names[some].tolist()}
                    found += [(cls, other) for other in sorted(seen)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return run


def _across(matrix: DataFrame, asks: DataFrame, texts: DataFrame, k: int, percent: int, tasks: int) -> DataFrame:
    """Links (a, b) between asking classes and the first of each component of the parts that they ask. Parts that very many ask
    are repeated with a share of the asking classes each."""
    many = asks.groupBy("grp", "part").agg(F.ceil(F.count(F.lit(1)) / ASKS).cast("int").alias("shares"))
    share = lambda nth: F.concat_ws("/", "part", nth).alias("share")
    own = matrix.join(many, ["grp", "part"]).withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    own = own.select(
        "grp", share("nth"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("cls"),
        F.lit(None).cast("string").alias("text"), "classes", "roots", "sizes", "tokens", "union"
    )
    theirs = asks.join(many, ["grp", "part"]).join(texts, "cls").select(
        "grp", share(F.pmod(F.xxhash64("cls"), "shares")), F.lit(1).alias("kind"), "cls", "text"
    )
    rows = own.unionByName(theirs, allowMissingColumns=True).repartition(tasks, "grp", "share").sortWithinPartitions("grp", "share", "kind", "cls")
    return rows.mapInArrow(common.tidied(_asked(k, percent)), "a long, b long")


def groups(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (distinct shingles), component (least doc_id that links lead to) of each row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_tokens(rows.select("text"), k))  # 8 bytes each, MOST at most
    keyed = common.stored(
        rows.mapInArrow(common.tidied(_keyed(k, percent, frequent)), "doc_id long, n long, cls long, need int, keys array<long>"),
        "jaccard-keys"
    )
    base = common.stored(keyed.drop("keys"), "jaccard-rows")

    # Keys that several classes have.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.select(F.explode("keys").alias("key"), "cls").repartitionByRange(tasks, "key", "cls").sortWithinPartitions("key", "cls")
    met = common.stored(dealt.mapInArrow(_met, "key long, cls long, task int"), "jaccard-met")
    del dealt
    common.dropped(keyed)
    common.released(spark)
    ends = sorted((r.task, r.key, r.cls) for r in met.where("task is not null").collect())  # two for each task
    over = {
        x for before,
        here in zip(ends[1::2], ends[2::2], strict=False) if before[1] == here[1] and before[2] != here[2] for x in (
            (here[1], here[2]), (here[1], before[2])
        )
    }
    held = met.where("task is null").select("key", "cls")
    if over:
        held = held.unionByName(spark.createDataFrame(sorted(over), "key long, cls long"))
    classes = base.where("doc_id is not null").groupBy("cls").agg(
        F.min("need").alias("need"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n")
    )
    classes = common.stored(classes, "jaccard-classes")
    enough = held.groupBy("cls").agg(F.count(F.lit(1)).alias("c")).join(classes, "cls").where("c >= need").select("cls")
    held = common.marked(held, "cls", common.bitmap(enough, "cls"), "maybe").where("maybe").select("key", "cls")
    held = common.stored(held, "jaccard-held")
    common.dropped(met)
    several = held.groupBy("key").agg(
        F.min("cls").alias("least"), F.max("cls").alias("most")
    ).where("least < most").select("key", F.col("least").alias("hub"))
    used = [held]
    held = common.stored(held.join(several, "key"), "jaccard-held")
    used.append(held)

    # Clusters: each class points to the class it meets first for most of its keys.
    shared = held.where("cls <> hub").groupBy("cls", "hub").agg(F.count(F.lit(1)).alias("keys"))
    nearest = shared.groupBy("cls").agg(F.max(F.struct("keys", F.negate("hub").alias("minus"))).alias("x")).select(
        "cls", F.negate("x.minus").alias("hub")
    )
    clusters = components(nearest, "cls", "hub")
    sized = clusters.join(classes, F.col("node") == F.col("cls"))
    parts = sized.groupBy("component").agg(F.ceil(F.greatest(F.sum("n") / PART_TOKENS, F.count(F.lit(1)) / PART_MEMBERS)).alias("parts"))
    placed = clusters.join(parts, "component").select(
        F.col("node").alias("cls"), F.col("component").alias("grp"),
        F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part")
    )
    placed = common.stored(placed, "jaccard-placed")
    used.append(placed)

    # The texts of the classes that are left, picked out by a bitmap of their documents.
    asked = common.stored(placed.select("cls").join(classes, "cls").select("cls", "doc_id"), "jaccard-asked")
    near = common.marked(rows, "doc_id", common.bitmap(asked, "doc_id"), "maybe").where("maybe").select("text")
    texts = near.mapInArrow(common.tidied(_classed(k)), "cls long, text string").join(asked.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
    texts = common.stored(texts, "jaccard-texts")

    # The token-group matrix of each part, and the links within it.
    dealt = placed.join(texts, "cls").select(
        "grp", "part", "cls", "text"
    ).repartition(tasks, "grp", "part").sortWithinPartitions("grp", "part", "cls")
    matrix = common.stored(dealt.mapInArrow(common.tidied(_stored_groups(k, percent)), f"grp long, part int, {_MATRIX}"), "jaccard-matrix")
    within = matrix.select(F.explode(F.arrays_zip("classes", "roots")).alias("x")).select(
        F.col("x.classes").alias("a"), F.col("x.roots").alias("b")
    ).where("a <> b")
    used += [asked, texts, matrix]
    common.released(spark)

    # Keys that stand in several parts; of these, for each class those that are not its most frequent: linked classes
    # share `need` keys or more, so PREFIX at least beside the need - PREFIX most frequent of either.
    apart = held.select("key", "cls").join(placed, "cls")
    where = F.struct("grp", "part")
    open_keys = apart.groupBy("key").agg(
        F.min(where).alias("x"), F.max(where).alias("y"), F.count(F.lit(1)).alias("often")
    ).where("x < y").select("key", "often")
    nth = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("often"), "key"))
    standing = apart.join(open_keys, "key").withColumn("nth", nth).join(classes.select("cls", "need"), "cls")
    standing = standing.where(F.col("nth") > F.col("need") - F.least(F.lit(PREFIX), "need")).select("key", "cls", "need", "grp", "part")
    standing = common.stored(standing, "jaccard-standing")
    ask = standing.select("key", F.col("cls").alias("ask"), where.alias("own"), "need")
    asks = ask.join(standing.select("key", "grp", "part", where.alias("other")).distinct(), "key").where("own > other")
    asks = asks.groupBy("grp", "part", F.col("ask").alias("cls")).agg(F.count(F.lit(1)).alias("c"), F.first("need").alias("need"))
    asks = common.stored(asks.where(F.col("c") >= F.least(F.lit(PREFIX), "need")).select("grp", "part", "cls"), "jaccard-asks")
    used += [standing, asks]
    across = _across(matrix, asks, texts, k, percent, tasks)

    # Rows of one doc_id are one document: their classes are joined too.
    several = base.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b")
    same = base.join(several.select("doc_id", "a"), "doc_id").where("cls <> a and n > 0").select("a", F.col("cls").alias("b"))
    joined = within.unionByName(across).unionByName(same)
    final = common.stored(components(joined, "a", "b"), "jaccard-components")
    for table in used:
        common.dropped(table)
    common.released(spark)

    names = classes.join(final, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("component", "cls").alias("component"), "doc_id")
    least_of = names.groupBy("component").agg(F.min("doc_id").alias("least_id"))
    by_class = names.select("cls", "component").join(least_of, "component").select("cls", "least_id")
    out = base.select("doc_id", "n", "cls").join(by_class, "cls", "left")
    return out.select(
        "doc_id", "n",
        F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("least_id"))).otherwise(F.col("doc_id")).alias("component")
    )


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose document is the first of its group, all columns as they are; rows without an id stay. Rows of one doc_id are
    one document: they stay or go together."""
    found = common.stored(groups(docs, k, percent).where("component <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct(), "jaccard-gone")
    named = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col("doc_id").cast("long").alias("own_id"))
    near = common.marked(named, "own_id", common.bitmap(found, "gone_id"), "maybe")
    kept = near.where("not maybe").drop("maybe").unionByName(
        near.where("maybe").drop("maybe").join(found, F.col("own_id") == F.col("gone_id"), "left_anti")
    )
    return kept.drop("own_id").toDF(*docs.columns)


def op9(spark, sf_dir: str) -> DataFrame:
    out = groups(common.table(spark, sf_dir, "documents"), 3, 90)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def sql(k: int, percent: int, rounds: int = 20) -> str:
    """The rows of op9, by pairing all documents that share a shingle; labels go along links in so many rounds."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = """, l{next} AS MATERIALIZED (
  SELECT node, min(label) AS label FROM (SELECT node, label FROM l{last} UNION ALL SELECT e.a, label FROM e JOIN l{last} ON node = e.b UNION ALL SELECT e.b, label FROM e JOIN l{last} ON node = e.a) GROUP BY node)"""
    return f"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all({lowered}, '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS shingle
  FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id > y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= {percent} * (x.n + y.n - both_)),
l0 AS (SELECT doc_id AS node, doc_id AS label FROM documents){"".join(step.format(last=i, next=i + 1) for i in range(rounds))}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, label AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN l{rounds} ON node = d.doc_id
"""
