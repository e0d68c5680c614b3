"""Longest-processing-time sharding: groups of equal texts go, largest first, to the least-loaded shard.

Groups of one size are interchangeable, so the heap of shards is run over classes of size instead of groups: a class
of many groups is dealt in one step, which gives each shard as many as the heap would give it one by one. All groups,
large and small, are scheduled so; the loads are those of the textbook rule. The driver holds one row for each
distinct size, of which there are sqrt(2 * all bytes) at most (sizes differ, so their sum is at least that of
1, 2, 3, ...); which shards a class goes to is joined to the groups by size, and a group takes its shard by its number
within the class. A group is never split over shards.

Numbers within a class, and places within a shard, come from counts of parts of PART rows or so, so that neither a size nor a
text which a third of all rows share is numbered by one task; rows that are alike in all that is returned are
counted before they are numbered.

Defined results: a null text has 0 bytes and null texts are one group; empty text is a group of its
own; groups of one size are told apart by the digest of their text; a null or repeated doc_id is a row like any other
(places follow doc_id, text_crc32 and size within a part, so only rows that are alike may change places); texts of any
length count whole; an empty table gives no rows; further columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

ROW_COST = 8
#: Groups or rows in a part, about.
PART = 4096


def lpt(sizes: list[tuple[int, object]], n_shards: int) -> dict[object, int]:
    """Unit -> shard. Units by falling size, ties by name; the least-loaded shard, ties by number."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for size, unit in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def dealt(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n units of one size each shard gets from the heap. A shard's k-th unit comes when its load, with the k - 1
    before, is the least of all; so the n units are the n least (load + k * size, shard)."""
    below = lambda at: [max(0, -(-(at - load) // size)) for load in loads]  # noqa: E731  units that come at loads under `at`
    low, high = min(loads), max(loads) + size * n + 1
    while high - low > 1:  # the greatest load under which no more than n units come
        mid = (low + high) // 2
        low, high = (mid, high) if sum(below(mid)) <= n else (low, mid)
    out = below(low)
    rest = n - sum(out)
    for shard, load in enumerate(loads):  # those that come at this load itself, by the shard's number
        if rest and load <= low and (low - load) % size == 0:
            out[shard] += 1
            rest -= 1
    return out


def schedule(classes: list[tuple[int, int]], n_shards: int) -> list[tuple[int, list[int], list[int]]]:
    """For each (size, groups): the size, the shards that get some of its groups, and up to which number each gets them."""
    heap, out = [(0, s) for s in range(n_shards)], []
    for size, n in sorted(classes, reverse=True):
        if n < 4 * n_shards:
            many = [0] * n_shards
            for _ in range(n):
                load, shard = heapq.heappop(heap)
                many[shard] += 1
                heapq.heappush(heap, (load + size, shard))
        else:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            many = dealt(loads, size, n)
            heap = [(load + size * k, s) for s, (load, k) in enumerate(zip(loads, many, strict=True))]
            heapq.heapify(heap)
        shards = [s for s, k in enumerate(many) if k]
        out.append((size, shards, np.cumsum([many[s] for s in shards]).tolist()))
    return out


def numbered(rows: DataFrame, by: list[str], parts: str, order: list, weight: str | None, name: str) -> DataFrame:
    """rows with their number, from 0, among those that agree in `by`: in `parts` parts by a hash, then by order. A row of
    `weight` counts as so many, and gets the first number of them."""
    spark_sum = F.sum(weight) if weight else F.count(F.lit(1))
    rows = rows.withColumn("nr_part", F.pmod(F.xxhash64(*order), F.col(parts)))
    earlier = Window.partitionBy(*by).orderBy("nr_part").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(*by, "nr_part").agg(spark_sum.alias("nr_n")).withColumn(
        "nr_first", F.coalesce(F.sum("nr_n").over(earlier), F.lit(0))
    ).drop("nr_n")
    within = Window.partitionBy(*by, "nr_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(weight if weight else F.lit(1)).over(within), F.lit(0))
    out = rows.withColumn("nr_before", before).join(first, [*by, "nr_part"])
    return out.withColumn(name, F.col("nr_first") + F.col("nr_before")).drop("nr_part", "nr_before", "nr_first")


def assign(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row of docs."""
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_COST).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(text.isNotNull(), F.unhex(F.md5(text.cast("binary")))).alias("grp"),
    ).withColumn("grp", F.coalesce("grp", F.lit(b"\0")))
    rows = common.stored(rows, "shard-rows")
    groups = common.stored(rows.groupBy("grp").agg(F.sum("size").alias("bytes")), "shard-groups")
    classes = [(r.bytes, r.n) for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()]
    plan = schedule(classes, n_shards)
    many = dict(classes)
    columns = [
        pa.array([p[0] for p in plan], pa.int64()), pa.array([p[1] for p in plan], pa.list_(pa.int32())),
        pa.array([p[2] for p in plan], pa.list_(pa.int64())),
        pa.array([-(-many[p[0]] // PART) for p in plan], pa.int64())
    ]
    goes = spark.createDataFrame(pa.table(columns, ["bytes", "shards", "upto", "parts"]))
    ranked = numbered(groups.join(goes, "bytes"), ["bytes"], "parts", ["grp"], None, "rank")
    place = F.size(F.filter("upto", lambda x: x <= F.col("rank")))
    placed = rows.join(ranked.select("grp", F.get("shards", place).alias("shard")), "grp").select("doc_id", "size", "text_crc32", "shard")
    alike = common.stored(placed.groupBy("shard", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")), "shard-places")
    common.dropped(rows)
    common.dropped(groups)
    parts = alike.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))  # a row for each shard
    order = ["doc_id", "text_crc32", "size"]
    out = numbered(alike.join(F.broadcast(parts), "shard"), ["shard"], "parts", order, "copies", "first")
    slots = F.explode(F.sequence(F.col("first").cast("long"), (F.col("first") + F.col("copies") - 1).cast("long"))).alias("slot")
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), slots)


def op10(spark, sf_dir: str) -> DataFrame:
    out = assign(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sql(n_shards: int = 24) -> str:
    """The rows of op10 where no size and no shard has more than PART rows: the greedy rule group by group, and CRC-32 byte by byte."""
    return f"""
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS MATERIALIZED (
  SELECT doc_id, text, coalesce(strlen(text), 0) + 8 AS size, coalesce(md5(text), '00') AS grp,
    list_transform(regexp_extract_all(coalesce(hex(encode(text)), ''), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes
  FROM documents),
crc AS MATERIALIZED (
  SELECT doc_id, size, grp, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS text_crc32
  FROM d, tab),
g AS MATERIALIZED (SELECT grp, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY grp),
seq AS MATERIALIZED (SELECT bytes, row_number() OVER (ORDER BY bytes DESC) AS i FROM g),
greedy AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS bytes, CAST(NULL AS INTEGER) AS shard, list_transform(range({n_shards}), lambda x: CAST(0 AS BIGINT)) AS loads
  UNION ALL
  SELECT seq.i, seq.bytes, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER),
    list_transform(loads, lambda x, nr: x + CASE WHEN nr = list_position(loads, list_min(loads)) THEN seq.bytes ELSE 0 END)
  FROM greedy JOIN seq ON seq.i = greedy.i + 1),
dealt AS (SELECT bytes, shard, row_number() OVER (PARTITION BY bytes ORDER BY shard, i) AS nth FROM greedy WHERE i > 0),
named AS (SELECT grp, bytes, row_number() OVER (PARTITION BY bytes ORDER BY grp) AS nth FROM g),
home AS (SELECT grp, shard FROM named JOIN dealt USING (bytes, nth))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM crc JOIN home USING (grp)
"""
