"""PBF files against an encoder written from the format."""

import random
import zlib

import numpy as np

from terravia.operators import network
from terravia.sources import io as S
from terravia.sources import pbf


def varint(v):
    v &= (1 << 64) - 1
    out = b""
    while v >= 0x80:
        out += bytes([v & 0x7F | 0x80])
        v >>= 7
    return out + bytes([v])


def zig(v):
    return varint((v << 1) ^ (v >> 63))


def message(*parts):
    return b"".join(varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v for n, v in parts)


def deltas(values, code=zig):
    return b"".join(code(b - a) for a, b in zip([0, *values], values, strict=False))


def blob(kind, raw, deflate=True):
    body = message((2, len(raw)), (3, zlib.compress(raw))) if deflate else message((1, raw))
    header = message((1, kind), (3, len(body)))
    return len(header).to_bytes(4, "big") + header + body


def file_of(nodes, ways):
    strings, place = [""], {}
    for _, _, tags in ways:
        for x in (y for kv in tags.items() for y in kv):
            if x not in place:
                place[x] = len(strings)
                strings.append(x)
    table = message(*((1, s.encode()) for s in strings))
    unit = lambda x: round(x * 1e7)
    dense = message(
        (1, deltas([i for i, _, _ in nodes[:-1]])), (8, deltas([unit(y) for _, _, y in nodes[:-1]])),
        (9, deltas([unit(x) for _, x, _ in nodes[:-1]]))
    )
    i, x, y = nodes[-1]
    single = b"".join([varint(1 << 3) + zig(i), varint(8 << 3) + zig(unit(y)), varint(9 << 3) + zig(unit(x))])
    roads = [
        message((1, i), (2, b"".join(varint(place[k]) for k in t)), (3, b"".join(varint(place[v]) for v in t.values())), (8, deltas(refs))) for i,
        refs, t in ways
    ]
    first, second = message(
        (1, table), (2, message((2, dense))), (2, message((1, single)))
    ), message((1, table), (2, message(*((3, r) for r in roads))))
    return blob(b"OSMHeader", b"x") + blob(b"OSMData", first) + blob(b"OSMData", second, False)


def test_packed_numbers():
    rng = random.Random(2)
    values = [rng.randrange(-(2 ** rng.randrange(1, 62)), 2 ** rng.randrange(1, 62)) for _ in range(500)]
    assert pbf.packed(b"".join(map(zig, values)), True).tolist() == values and pbf.packed(b"").tolist() == []
    assert pbf.packed(deltas(values), True, True).tolist() == values
    assert pbf.packed(b"".join(varint(abs(v)) for v in values)).tolist() == [abs(v) for v in values]


def test_extract_and_graph(spark, tmp_path):
    nodes = [(10, -72.0, -13.5), (7, -71.99, -13.5), (9_000_000_001, -71.98, -13.5), (12, -60.0, 10.0), (13, -71.97, -13.49)]
    ways = [
        (999, [10, 7, 9_000_000_001, 12], {"highway": "primary", "oneway": "yes"}),
        (5, [7, 13], {"highway": "steps", "oneway:bicycle": "no"}), (6, [10, 13], {"building": "yes"}),
        (8, [10], {"highway": "path"})
    ]
    path = tmp_path / "x.osm.pbf"
    path.write_bytes(file_of(nodes, ways))
    rows = pbf.read_pbf(spark, str(path)).collect()
    assert {(r.id, round(r.lon, 7), round(r.lat, 7)) for r in rows if r.kind == "node"} == set(nodes)
    assert {(r.id, tuple(r.refs)) for r in rows if r.kind == "way"} == {(i, tuple(refs)) for i, refs, _ in ways}
    n, e = pbf.extract(spark, str(path))
    edges = {(r.id, r.u, r.v): r for r in e.collect()}
    assert set(edges) == {(999, 10, 7), (999, 7, 9_000_000_001), (999, 9_000_000_001, 12), (5, 7, 13)}
    assert edges[5, 7, 13].oneway_bicycle == "no" and edges[999, 10, 7].oneway == "yes"
    assert np.isclose(edges[999, 10, 7].length, 6_371_000 * np.radians(0.01) * np.cos(np.radians(13.5)), rtol=1e-6)
    inside = pbf.extract(spark, str(path), (-73, -14, -71, -13))
    assert {(r.u, r.v) for r in inside[1].collect()} == {
        (10, 7), (7, 9_000_000_001), (7, 13)
    } and {r.id for r in inside[0].collect()} == {10, 7, 9_000_000_001, 13}
    both = S.combined_network(spark, str(tmp_path), {"a": (n, e), "b": inside})
    assert both[1].count() == 4 and both[0].count() == 5
    assert {(r.u, r.v) for r in network.graph(both[1], "car").collect()} == {(10, 7), (7, 9_000_000_001), (9_000_000_001, 12)}
