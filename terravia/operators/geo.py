"""Points and polygons: containment in the declared district, nearest node, bounding boxes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..functions import exprs as X

#: Polygons are arrays of rings, rings arrays of struct<x, y>; even-odd, so holes are rings like others.
RINGS = "array<array<struct<x:double,y:double>>>"


def _ring_hits(x: Column, y: Column, ring: Column) -> Column:
    """Edges of the ring that a ray to the right of the point crosses."""
    def crosses(i):
        a, b = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
        spans = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.when(spans, b["y"] - a["y"]).otherwise(1.0) + a["x"]
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.size(ring) - 1), crosses), F.lit(0), lambda n, c: n + c)


def contains(x: Column, y: Column, rings: Column) -> Column:
    """Whether the point is inside, by ray casting."""
    return F.aggregate(F.transform(rings, lambda r: _ring_hits(x, y, r)), F.lit(0), lambda n, c: n + c) % 2 == 1


def utm_rings(rings: Column) -> Column:
    """The rings with their points in metres; made once a polygon."""
    def metres(p):
        x, y = X.utm18s(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(rings, lambda r: F.transform(r, metres))


def ring_distance_m(px: Column, py: Column, rings: Column) -> Column:
    """Distance of a point to the nearest edge of rings, all in metres. Each step has the last one's results as its argument, so that no
    expression is evaluated twice."""
    def edge(ring, i):
        a, b = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
        return F.struct((px - a["x"]).alias("ox"), (py - a["y"]).alias("oy"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))

    def along(e):
        t = F.coalesce(F.try_divide(e["ox"] * e["dx"] + e["oy"] * e["dy"], e["dx"] * e["dx"] + e["dy"] * e["dy"]), F.lit(0.0))
        return F.struct(
            e["ox"].alias("ox"), e["oy"].alias("oy"), e["dx"].alias("dx"), e["dy"].alias("dy"),
            F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)).alias("t")
        )

    def distance(e):
        return F.sqrt(F.pow(e["ox"] - e["t"] * e["dx"], 2) + F.pow(e["oy"] - e["t"] * e["dy"], 2))

    edges = lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: edge(r, i))
    return F.array_min(F.transform(rings, lambda r: F.array_min(F.transform(F.transform(edges(r), along), distance))))


def within_declared(
    df: DataFrame, districts: DataFrame, key: str, lon: str = "lon", lat: str = "lat", rings: str = "rings",
    buffer_m: float = 1000.0, name: str = "within"
) -> DataFrame:
    """A boolean: whether the point is in the polygon of the district it declares, or nearer to it than the buffer; null for points without
    coordinates or with an unknown district. The polygon is found by its key, not by search (J13)."""
    polygons = districts.select(F.col(key).alias("_k"), F.col(rings).alias("_rings"), utm_rings(F.col(rings)).alias("_urings"))
    out = df.join(polygons, F.col(key) == F.col("_k"), "left")
    x, y = X.utm18s(F.col(lon), F.col(lat))
    near = contains(F.col(lon), F.col(lat), F.col("_rings"))
    if buffer_m > 0:
        out = out.withColumns({"_px": x, "_py": y})
        near = near | (ring_distance_m(F.col("_px"), F.col("_py"), F.col("_urings")) < buffer_m)
    judged = F.col("_rings").isNotNull() & F.col(lon).isNotNull() & F.col(lat).isNotNull()
    return out.withColumn(name, F.when(judged, near)).drop("_k", "_rings", "_urings", "_px", "_py")


def outside_declared(
    df: DataFrame, districts: DataFrame, key: str, lon: str = "lon", lat: str = "lat", rings: str = "rings",
    buffer_m: float = 1000.0
) -> DataFrame:
    """district_mismatch: the point is neither in the polygon of the district it declares nor within the buffer of it; points that can't be
    judged do not mismatch (rule 4)."""
    out = within_declared(df, districts, key, lon, lat, rings, buffer_m, "_within")
    return out.withColumn("district_mismatch", F.coalesce(~F.col("_within"), F.lit(False))).drop("_within")


def dissolve(polygons: DataFrame, groups: list[str], rings: str = "rings", firsts: tuple[str, ...] = ()) -> DataFrame:
    """All rings of a group as one multipolygon; its inner edges stay, which changes neither area nor containment."""
    return polygons.groupBy(*groups).agg(F.flatten(F.collect_list(rings)).alias(rings), *(F.min(c).alias(c) for c in firsts))


def bounds(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One row min_lon, min_lat, max_lon, max_lat; nulls where df is empty."""
    return df.agg(F.min(lon).alias("min_lon"), F.min(lat).alias("min_lat"), F.max(lon).alias("max_lon"), F.max(lat).alias("max_lat"))


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker."""
    keep, todo = {0, len(ring) - 1}, [(0, len(ring) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, p = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        size = math.hypot(*d)
        far = np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / size if size else np.hypot(p[:, 0], p[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return ring[sorted(keep)]


def simplify(polygons: DataFrame, rings: str = "rings", tolerance: float = 0.001) -> DataFrame:
    """Polygons with fewer points, for maps (V8)."""
    @F.pandas_udf(RINGS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(
                lambda rs: [[{"x": float(x), "y": float(y)} for x, y in simplified(np.array([(p["x"], p["y"]) for p in r]), tolerance)] for r in rs]
            )

    return polygons.withColumn(rings, run(rings))


#: Cells a side into which nodes are grouped to bound distances; their table has so many squared rows at most.
BOUND_CELLS = 32


def _far_cells(left: DataFrame, cells: DataFrame, scale: float) -> DataFrame:
    """left with each cell that may hold the nearest node: none of its nodes need be nearer than the farthest corner of another cell."""
    dx, dy = F.greatest(
        F.col("x0") - F.col("px"), F.col("px") - F.col("x1"), F.lit(0.0)
    ) * scale, F.greatest(F.col("y0") - F.col("py"), F.col("py") - F.col("y1"), F.lit(0.0))
    ex, ey = F.greatest(
        F.abs(F.col("px") - F.col("x0")), F.abs(F.col("px") - F.col("x1"))
    ) * scale, F.greatest(F.abs(F.col("py") - F.col("y0")), F.abs(F.col("py") - F.col("y1")))
    pairs = left.join(F.broadcast(cells)).select(
        "point_id", "px", "py", "cx", "cy", (dx * dx + dy * dy).alias("least"), (ex * ex + ey * ey).alias("most")
    )
    bound = pairs.groupBy("point_id", "px", "py").agg(F.min("most").alias("bound"))
    return pairs.join(bound, ["point_id", "px", "py"]).where(F.col("least") <= F.col("bound") * (1 + 1e-9)).select("point_id", "px", "py", "cx", "cy")


def snap(
    points: DataFrame, nodes: DataFrame, point_id: str, node_id: str, max_m: float, lon: str = "lon", lat: str = "lat",
    cell: float = 0.05
) -> DataFrame:
    """point_id, node_id, snap_distance_m, status, fail_reason.

    Nearest by longitude scaled with the cosine of the mean latitude; the distance reported is the great circle's. Points look in the
    3 x 3 cells around them; a find is final if it is nearer than the border of these. For the few others, nodes are grouped in BOUND_CELLS x
    BOUND_CELLS cells at most, and only cells that may hold the nearest node by the bounds of their nodes are searched. Both steps are
    equi-joins on a cell; no step pairs points with all nodes."""
    from ..sources import io

    io.checkpoint_dir(points.sparkSession)
    p = points.select(F.col(point_id).alias("point_id"), F.col(lon).alias("px"), F.col(lat).alias("py"))
    n = nodes.select(F.col(node_id).alias("node_id"), F.col(lon).alias("nx"), F.col(lat).alias("ny")).where("nx is not null and ny is not null")
    box = n.agg(
        F.avg("ny").alias("m"), F.count(F.lit(1)).alias("n"), F.min("nx").alias("a"), F.max("nx").alias("b"),
        F.min("ny").alias("c"), F.max("ny").alias("d")
    ).first()
    if not box.n:
        empty = p.select(
            "point_id", F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("double").alias("snap_distance_m"),
            F.lit("failure").alias("status")
        )
        return empty.withColumn("fail_reason", F.lit("grafo_vacio"))
    scale = math.cos(math.radians(box.m))

    def nearest(near: DataFrame) -> DataFrame:
        d2 = F.pow((F.col("px") - F.col("nx")) * scale, 2) + F.pow(F.col("py") - F.col("ny"), 2)
        return near.withColumn("d2", d2).groupBy("point_id", "px", "py").agg(F.min(F.struct("d2", "node_id", "nx", "ny")).alias("b"))

    have = p.where(F.col("px").isNotNull() & F.col("py").isNotNull()).distinct()
    cells = n.select("node_id", "nx", "ny", F.floor(F.col("nx") / cell).alias("cx"), F.floor(F.col("ny") / cell).alias("cy"))
    around = F.array(
        *(
            F.struct(
                (F.floor(F.col("px") / cell) + i).alias("cx"), (F.floor(F.col("py") / cell) + j).alias("cy")
            ) for i in (-1, 0, 1) for j in (-1, 0, 1)
        )
    )
    close = nearest(
        have.withColumn("c", F.explode(around)).select("*", "c.cx", "c.cy").drop("c").join(cells, ["cx", "cy"])
    ).where(F.sqrt("b.d2") <= cell * scale).checkpoint()
    left = have.join(close.select("point_id", "px", "py"), ["point_id", "px", "py"], "left_anti").checkpoint()
    wide = max(box.b - box.a, box.d - box.c, 1e-9) / BOUND_CELLS
    own = [
        F.least(F.floor((F.col(c) - F.lit(low)) / wide), F.lit(BOUND_CELLS - 1)).alias(name) for c, low,
        name in (("nx", box.a, "cx"), ("ny", box.c, "cy"))
    ]
    placed = n.select("node_id", "nx", "ny", *own)
    bounds_ = placed.groupBy("cx", "cy").agg(F.min("nx").alias("x0"), F.max("nx").alias("x1"), F.min("ny").alias("y0"), F.max("ny").alias("y1"))
    far = nearest(_far_cells(left, bounds_, scale).join(placed, ["cx", "cy"]))
    found = close.unionByName(far)
    metres = X.haversine_m(F.col("px"), F.col("py"), F.col("b.nx"), F.col("b.ny"))
    found = found.select(
        F.col("point_id").alias("_id"), F.col("px").alias("_x"), F.col("py").alias("_y"),
        F.col("b.node_id").alias("node_id"), metres.alias("snap_distance_m")
    )
    same = F.col("point_id").eqNullSafe(F.col("_id")) & (F.col("px") == F.col("_x")) & (F.col("py") == F.col("_y"))
    out = p.join(found, same, "left").select("point_id", "node_id", "snap_distance_m")
    ok = F.coalesce(F.col("snap_distance_m") <= max_m, F.lit(False))
    return out.withColumn("status", F.when(ok, "success").otherwise("failure")).withColumn(
        "fail_reason",
        F.when(ok, F.lit(None)).when(F.col("node_id").isNull(), "sin_coordenadas").otherwise("distancia_maxima")
    )


def snap_report(df: DataFrame) -> DataFrame:
    """One row on snapping: counts, and mean, median, p95 (exact, interpolated) and maximum of all distances."""
    d, failed = F.col("snap_distance_m"), F.count_if(F.col("status") != "success")
    return df.agg(
        F.count(F.lit(1)).alias("n_total"), failed.alias("n_failed"), X.percent(
            failed, F.nullif(F.count(F.lit(1)), F.lit(0))
        ).alias("pct_failed"), F.avg(d).alias("mean_snap_m"),
        F.percentile(d, F.lit(0.5)).alias("median_snap_m"), F.percentile(d, F.lit(0.95)).alias("p95_snap_m"), F.max(d).alias("max_snap_m"),
    )


def render_stats(df: DataFrame, value: str, color: str) -> DataFrame:
    return df.agg(
        F.count(value).alias("n"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.count_distinct(color).alias("n_colors")
    )
