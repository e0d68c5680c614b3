"""OSM PBF files as tables of nodes, ways and road segments.

A file is cut into its blobs by one task that only copies bytes; blobs are then dealt over all tasks, inflated and decoded
there with numpy. What is read comes through Spark, so any file system will do. A file has 2 GB at most, as Spark hands over
whole files; larger regions are several extracts, put together by io.combined_network().
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from .io import ship

#: Tags that profiles look at; in a column's name ":" becomes "_".
TAGS = ("highway", "oneway", "maxspeed", "access", "junction", "bicycle", "foot", "surface", "oneway:bicycle")
_SCHEMA = "kind string, id long, lon double, lat double, refs array<long>, tags map<string,string>"
_ARROW = pa.schema(
    [
        ("kind", pa.string()), ("id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()),
        ("refs", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string()))
    ]
)


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message: numbers, or bytes where the field has a length."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            n, at = _varint(raw, at)
            value, at = raw[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = int.from_bytes(raw[at : at + n], "little"), at + n
        else:
            raise ValueError(f"a field of wire type {kind}")
        yield key >> 3, value


def packed(raw: bytes, signed: bool = False, delta: bool = False) -> np.ndarray:
    """A packed list of varints, all at once."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(b < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    v = np.add.reduceat((b & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), starts)
    out = (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64) if signed else v.astype(np.int64)
    return np.cumsum(out) if delta else out


def blobs(raw: bytes) -> Iterator[bytes]:
    """The data blobs of a file, as they are."""
    at = 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "big")
        header = dict(fields(raw[at + 4 : at + 4 + n]))
        at += 4 + n
        if header[1] == b"OSMData":
            yield raw[at : at + header[3]]
        at += header[3]


def _inflated(blob: bytes) -> bytes:
    parts = dict(fields(blob))
    if 1 in parts:
        return parts[1]
    if 3 not in parts:
        raise ValueError("a blob that is neither raw nor deflated")
    return zlib.decompress(parts[3])


def elements(blob: bytes) -> Iterator[pa.RecordBatch]:
    """The nodes and ways of a blob, a batch for each group of them."""
    block = list(fields(_inflated(blob)))
    strings = [v.decode("utf-8", "replace") for n, table in block if n == 1 for k, v in fields(table) if k == 1]
    numbers = {n: v for n, v in block if isinstance(v, int)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    unit, lat0, lon0 = numbers.get(17, 100), signed(numbers.get(19, 0)), signed(numbers.get(20, 0))
    degrees = lambda v, origin: 1e-9 * (origin + unit * v)
    zigzag = lambda v: (v >> 1) ^ -(v & 1)
    for number, group in block:
        if number != 2:
            continue
        ways, ids, lons, lats = [], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        for kind, raw in fields(group):
            part = dict(fields(raw)) if kind in (1, 2, 3) else {}
            if kind == 1:
                ids.append(np.array([zigzag(part[1])]))
                lats.append(np.array([degrees(zigzag(part[8]), lat0)]))
                lons.append(np.array([degrees(zigzag(part[9]), lon0)]))
            elif kind == 2:
                ids.append(packed(part.get(1, b""), True, True))
                lats.append(degrees(packed(part.get(8, b""), True, True), lat0))
                lons.append(degrees(packed(part.get(9, b""), True, True), lon0))
            elif kind == 3:
                names = zip(packed(part.get(2, b"")).tolist(), packed(part.get(3, b"")).tolist(), strict=True)
                ways.append(
                    {"kind": "way", "id": part[1], "refs": packed(part.get(8, b""), True, True), "tags": [(strings[k], strings[v]) for k, v in names]}
                )
        found = np.concatenate(ids)
        n = len(found)
        if n:
            columns = [
                pa.array(["node"] * n), pa.array(found), pa.array(np.concatenate(lons)), pa.array(np.concatenate(lats)),
                pa.nulls(n, _ARROW.field("refs").type), pa.nulls(n, _ARROW.field("tags").type)
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)
        if ways:
            yield pa.RecordBatch.from_pylist(ways, _ARROW)


def _cut(batches):
    for batch in batches:
        for raw in batch.column(0):
            for blob in blobs(raw.as_py()):
                yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])


def _decoded(batches):
    for batch in batches:
        for blob in batch.column(0):
            yield from elements(blob.as_py())


def read_pbf(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """kind (node or way), id, lon, lat, refs, tags."""
    ship(spark)
    whole = spark.read.format("binaryFile").load(path).select("content")
    cut = whole.mapInArrow(_cut, "blob binary").repartition(tasks or 4 * spark.sparkContext.defaultParallelism)
    return cut.mapInArrow(_decoded, _SCHEMA)


def extract(spark: SparkSession, path: str, box: Sequence[float] | None = None, tags: Sequence[str] = TAGS) -> tuple[DataFrame, DataFrame]:
    """nodes (id, lon, lat) and edges (id, u, v, length, a column per tag): the segments of all ways with a highway, their length
    great-circle metres; with a box (min_lon, min_lat, max_lon, max_lat) those between nodes within it."""
    rows = read_pbf(spark, path)
    nodes = rows.where("kind = 'node'").select("id", "lon", "lat").dropDuplicates(["id"])
    if box is not None:
        nodes = nodes.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    ways = rows.where("kind = 'way'").where(F.col("tags")["highway"].isNotNull())
    named = ways.select("id", "refs", *(F.col("tags")[t].alias(t.replace(":", "_")) for t in tags))
    pairs = F.arrays_zip(
        F.slice("refs", 1, F.greatest(F.size("refs") - 1, F.lit(0))).alias("u"),
        F.slice("refs", 2, F.greatest(F.size("refs") - 1, F.lit(0))).alias("v")
    )
    segments = named.withColumn("pair", F.explode(pairs)).select(
        "id", F.col("pair.u").alias("u"), F.col("pair.v").alias("v"), *(t.replace(":", "_") for t in tags)
    ).where("u <> v")
    a, b = (nodes.select(F.col("id").alias(n), F.col("lon").alias(f"{n}x"), F.col("lat").alias(f"{n}y")) for n in ("u", "v"))
    placed = segments.join(a, "u").join(b, "v").withColumn("length", X.haversine_m(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")))
    edges = placed.select("id", "u", "v", "length", *(t.replace(":", "_") for t in tags)).dropDuplicates(["id", "u", "v"])
    used = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return nodes.join(used, "id", "left_semi"), edges
