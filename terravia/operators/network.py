"""Road networks: merging extracts, weighted graphs by mode, shortest paths, and comparisons of modes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X


def merge_nodes(*parts: DataFrame) -> DataFrame:
    return _union(parts).dropDuplicates(["id"])


def merge_edges(*parts: DataFrame) -> DataFrame:
    """A way has several segments: (id, u, v) tells them apart."""
    return _union(parts).dropDuplicates(["id", "u", "v"])


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def graph(edges: DataFrame, mode: str, track_kmh: float = K.TRACK_SPEED) -> DataFrame:
    """u, v, time_s, length, speed_kmh: the quickest of parallel edges, in the directions open to the mode."""
    w = X.make_edge_weight(mode, edges.columns, F.col("length"), track_kmh)
    rows = edges.where(F.col("length") > 0).withColumn("w", w).where("w is not null")
    ways = F.array(
        F.when(F.col("w.forward"), F.struct(F.col("u").alias("u"), F.col("v").alias("v"))),
        F.when(F.col("w.backward"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))),
    )
    directed = rows.select(F.explode(F.array_compact(ways)).alias("e"), "w").select(
        "e.u", "e.v", "w.time_s", F.col("w.length_m").alias("length"), "w.speed_kmh"
    )
    return directed.groupBy("u", "v").agg(F.min(F.struct("time_s", "length", "speed_kmh")).alias("b")).select(
        "u", "v", "b.time_s", "b.length", "b.speed_kmh"
    )


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"u": F.col("v"), "v": F.col("u")})


class Paths:
    """A compact adjacency for searches in one worker: the edges of a node stand together."""

    def __init__(self, u: np.ndarray, v: np.ndarray, weights: dict[str, np.ndarray]):
        self.nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = back[: len(u)], back[len(u) :]
        order = np.argsort(a, kind="stable")
        self.to, self.at = b[order].astype(np.int32), np.searchsorted(a[order], np.arange(len(self.nodes) + 1))
        self.weights = {k: w[order] for k, w in weights.items()}
        self.step = {k: float(w.mean()) * 2 if len(w) else 1.0 for k, w in weights.items()}

    def places(self, nodes: np.ndarray) -> np.ndarray:
        """The number of each node, or -1."""
        if not len(self.nodes):
            return np.full(len(nodes), -1)
        k = np.minimum(np.searchsorted(self.nodes, nodes), len(self.nodes) - 1)
        return np.where(self.nodes[k] == nodes, k, -1)

    def _from(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edges that leave some nodes, and for each the number of its node among these."""
        n = self.at[front + 1] - self.at[front]
        first = np.repeat(self.at[front] - (np.cumsum(n) - n), n)
        return first + np.arange(n.sum()), np.repeat(np.arange(len(front)), n)

    def search(self, sources: np.ndarray, by: str, carry: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each node the least cost from any source (inf: none leads there), the number of that source, and what was carried
        along; ties by source, then by the carried sum. Nodes are relaxed in steps of cost, all of a step at once."""
        n = len(self.nodes)
        cost, name, along = np.full(n, np.inf), np.full(n, len(sources)), np.full(n, np.inf)
        weight, carried = self.weights[by], self.weights[carry or by]
        places = self.places(sources)
        for i in np.flatnonzero(places >= 0)[::-1].tolist():
            cost[places[i]], name[places[i]], along[places[i]] = 0.0, i, 0.0
        later = np.zeros(n, bool)
        later[places[places >= 0]] = True
        while later.any():
            open_ = np.flatnonzero(later)
            limit = cost[open_].min() + self.step[by]
            front = open_[cost[open_] < limit]
            while len(front):
                later[front] = False
                edge, own = self._from(front)
                if carry is None and len(sources) == 1:  # the cost is all there is to tell
                    to, c = self.to[edge], cost[front][own] + weight[edge]
                    better = c < cost[to]
                    np.minimum.at(cost, to[better], c[better])
                    to = np.unique(to[better])
                    name[to], along[to], later[to] = 0, cost[to], True
                    front = to[cost[to] < limit]
                    continue
                to, c, s, m = self.to[edge], cost[front][own] + weight[edge], along[front][own] + carried[edge], name[front][own]
                better = c <= cost[to]
                to, c, s, m = to[better], c[better], s[better], m[better]
                order = np.lexsort((s, m, c, to))
                to, c, s, m = to[order], c[order], s[order], m[order]
                first = np.ones(len(to), bool)
                first[1:] = to[1:] != to[:-1]
                to, c, s, m = to[first], c[first], s[first], m[first]
                new = (c < cost[to]) | ((c == cost[to]) & ((m < name[to]) | ((m == name[to]) & (s < along[to]))))
                to = to[new]
                cost[to], name[to], along[to] = c[new], m[new], s[new]
                later[to] = True
                front = to[cost[to] < limit]
        return cost, name, along


#: Edges of one mode that a worker may hold (24 bytes each in numpy); larger graphs are searched on tables.
MAX_EDGES = 8_000_000


def _adjacency(edges: DataFrame):
    """The reversed graph, built once and broadcast; None where it has more than MAX_EDGES edges. edges: stored."""
    if edges.count() > MAX_EDGES:
        return None
    table = edges.select(
        F.col("v").cast("long").alias("a"), F.col("u").cast("long").alias("b"), F.col("time_s").cast("double"),
        F.col("length").cast("double")
    ).toPandas()
    paths = Paths(table["a"].to_numpy(), table["b"].to_numpy(), {"time": table["time_s"].to_numpy(), "length": table["length"].to_numpy()})
    return edges.sparkSession.sparkContext.broadcast(paths)


def relaxed(edges: DataFrame, sources: DataFrame, weight: str, carry: str | None = None, by: Sequence[str] = (), rounds: int = 100_000) -> DataFrame:
    """by..., node, cost, source, carried: the least cost from a node to any source of each value of `by`, ties by source and carried
    sum, by rounds of relaxation on distributed tables. sources: by..., node_id, source. Only what got better is carried on; lineage is cut by
    checkpoint(). Every shortest path has fewer edges than there are nodes; should `rounds` not be enough, an error says so."""
    _checkpoints(edges)
    keys = [*by, "node"]
    back = edges.select(
        F.col("v").alias("node"), F.col("u").alias("next"), F.col(weight).cast("double").alias("w"),
        F.col(carry or weight).cast("double").alias("c")
    ).checkpoint()
    best = sources.select(
        *by, F.col("node_id").cast("long").alias("node"),
        F.struct(F.lit(0.0).alias("cost"), F.col("source"), F.lit(0.0).alias("carried")).alias("b")
    )
    known = back.select(F.explode(F.array("node", "next")).alias("node")).distinct()
    best = best.join(known, "node", "left_semi").groupBy(*keys).agg(F.min("b").alias("b")).checkpoint()
    front = best
    for _ in range(rounds):
        step = F.struct(
            (F.col("b.cost") + F.col("w")).alias("cost"), F.col("b.source").alias("source"),
            (F.col("b.carried") + F.col("c")).alias("carried")
        )
        found = front.join(back, "node").select(*by, F.col("next").alias("node"), step.alias("new")).groupBy(*keys).agg(F.min("new").alias("new"))
        front = found.join(best, keys, "left").where(F.col("b").isNull() | (F.col("new") < F.col("b"))).select(
            *keys, F.col("new").alias("b")
        ).checkpoint()
        if front.isEmpty():
            return best.select(*keys, "b.cost", "b.source", "b.carried")
        best = best.unionByName(front).groupBy(*keys).agg(F.min("b").alias("b")).checkpoint()
    raise RuntimeError(f"shortest paths did not settle in {rounds} rounds")


def _checkpoints(df: DataFrame) -> None:
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        from ..sources import io

        io.checkpoint_dir(df.sparkSession)


def reach(edges: DataFrame, facilities: DataFrame, demand_nodes: DataFrame) -> DataFrame:
    """facility_id, node_id, time_s, distance_m of each facility and demand node that a path joins: quickest time and, of
    another search, shortest length (G3's kernel). One search a facility on the reversed graph, facilities spread over the workers; a
    graph of more than MAX_EDGES edges is relaxed on tables, for all facilities at once."""
    wanted = demand_nodes.select(F.col("node_id").cast("long")).where("node_id is not null").distinct()
    pairs = facilities.select(F.col("facility_id").cast("string"), F.col("node_id").cast("long")).where("node_id is not null")
    _checkpoints(edges)
    edges = edges.checkpoint()  # counted, then collected or relaxed
    shared = _adjacency(edges)
    if shared is None:
        seeds = pairs.select("facility_id", "node_id", F.col("facility_id").alias("source"))
        times, lengths = (
            relaxed(edges, seeds, w, by=["facility_id"]).select("facility_id", F.col("node").alias("node_id"), F.col("cost").alias(c)) for w,
            c in (("time_s", "time_s"), ("length", "distance_m"))
        )
        return times.join(lengths, ["facility_id", "node_id"]).join(wanted, "node_id", "left_semi")

    def run(batches):
        paths = shared.value
        for batch in batches:
            for fid, node in zip(batch["facility_id"], batch["node_id"], strict=True):
                time, length = (paths.search(np.array([node]), by)[0] for by in ("time", "length"))
                there = np.flatnonzero(np.isfinite(time))
                yield pd.DataFrame({"facility_id": fid, "node_id": paths.nodes[there], "time_s": time[there], "distance_m": length[there]})

    spark = edges.sparkSession
    tasks = max(1, min(pairs.count(), 4 * spark.sparkContext.defaultParallelism))
    found = pairs.repartitionByRange(tasks, "facility_id").mapInPandas(run, "facility_id string, node_id long, time_s double, distance_m double")
    return found.join(wanted, "node_id", "left_semi").select("facility_id", "node_id", "time_s", "distance_m")


def matrix(edges: DataFrame, demand: DataFrame, facilities: DataFrame, mode: str) -> DataFrame:
    """The complete matrix: a row for every demand point and facility, with a status where there is no route.
    demand: demand_id, node_id, dep; facilities: facility_id, node_id, dep (node_id null where snapping failed)."""
    found = reach(edges, facilities, demand)
    d = demand.select("demand_id", F.col("node_id").alias("origin_node"), F.col("dep").alias("d_dep"))
    f = facilities.select("facility_id", F.col("node_id").alias("dest_node"), F.col("dep").alias("f_dep"))
    cells = d.crossJoin(f)  # the matrix itself: every pair is a row of the result
    r = found.select(F.col("facility_id").alias("r_id"), F.col("node_id").alias("r_node"), "time_s", F.col("distance_m").alias("r_m"))
    same = F.col("d_dep") == F.col("f_dep")
    out = cells.join(r, (F.col("facility_id") == F.col("r_id")) & (F.col("origin_node") == F.col("r_node")) & same, "left")
    status = X.classify_pair(F.col("origin_node").isNotNull() & F.col("dest_node").isNotNull(), same, F.col("time_s").isNotNull())
    ok = F.col("routing_status") == K.ROUTED
    out = out.withColumn("routing_status", status)
    return out.select(
        "demand_id", "facility_id", F.lit(mode).alias("mode"), F.when(ok, F.col("r_m")).alias("distance_m"),
        F.when(ok, F.col("time_s") / 60).alias("travel_time_min"), ok.alias("reachable"), "routing_status",
        "origin_node", "dest_node"
    )


def nearest_multi_source(edges: DataFrame, demand: DataFrame, facilities: DataFrame, mode: str, same_department: bool = False) -> DataFrame:
    """The quickest facility of each demand point, by one search from all at once; distance_m is the length of that quickest path.
    Facilities of one node count as the one with the greatest id. With same_department, a search for each department."""
    dep = (F.col("dep") if same_department else F.lit("*")).cast("string").alias("dep")
    some = facilities.where("node_id is not null").select(
        dep, F.col("node_id").cast("long"), F.col("facility_id").cast("string")
    ).groupBy("dep", "node_id").agg(F.max("facility_id").alias("facility_id"))
    _checkpoints(edges)
    edges = edges.checkpoint()
    shared = _adjacency(edges)

    def run(table: pd.DataFrame) -> pd.DataFrame:
        paths, table = shared.value, table.sort_values("facility_id")
        cost, name, along = paths.search(table["node_id"].to_numpy(), "time", "length")
        there = np.flatnonzero(np.isfinite(cost))
        return pd.DataFrame(
            {
                "r_dep": table["dep"].iloc[0], "r_node": paths.nodes[there],
                "facility_id": table["facility_id"].to_numpy()[name[there]], "time_s": cost[there],
                "distance_m": along[there]
            }
        )

    if shared is None:
        found = relaxed(edges, some.withColumnRenamed("facility_id", "source"), "time_s", "length", ["dep"])
        found = found.select(
            F.col("dep").alias("r_dep"), F.col("node").alias("r_node"), F.col("source").alias("facility_id"),
            F.col("cost").alias("time_s"), F.col("carried").alias("distance_m")
        )
    else:
        found = some.groupBy("dep").applyInPandas(run, "r_dep string, r_node long, facility_id string, time_s double, distance_m double")
    d = demand.select("demand_id", "node_id", dep)
    out = d.join(found, (F.col("node_id") == F.col("r_node")) & (F.col("dep") == F.col("r_dep")), "left")
    ok = F.col("time_s").isNotNull()
    return out.select(
        "demand_id", "facility_id", F.lit(mode).alias("mode"), "distance_m",
        (F.col("time_s") / 60).alias("travel_time_min"), ok.alias("reachable"),
        X.classify_demand(F.col("node_id").isNotNull(), ok).alias("routing_status")
    )


def relaxed_times(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node, time_s of the quickest way from a node to any source, on distributed tables."""
    return relaxed(edges, sources.select("node_id", F.lit(0).alias("source")), "time_s").select("node", F.col("cost").alias("time_s"))


def nearest_by_mode(pairs: DataFrame) -> DataFrame:
    """The quickest reachable facility per demand point and mode, ties by facility_id; points without any are absent."""
    rows = pairs.where("reachable").groupBy("demand_id", "mode").agg(F.min(F.struct("travel_time_min", "facility_id", "distance_m")).alias("b"))
    return rows.select("demand_id", "mode", "b.facility_id", "b.distance_m", "b.travel_time_min", F.lit(True).alias("reachable"))


def with_failed(rows: DataFrame, ids: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Adds a snap_failed row for each id and mode that has none."""
    all_ = ids.select("demand_id").distinct().crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(m,) for m in modes], "mode string")))
    gone = all_.join(rows, ["demand_id", "mode"], "left_anti").withColumns({"reachable": F.lit(False), "routing_status": F.lit(K.SNAP_FAILED)})
    return rows.unionByName(gone, allowMissingColumns=True)


def status_table(snaps: DataFrame, rows: DataFrame, modes: Sequence[str] = ("car", "bike", "foot")) -> DataFrame:
    """A row per demand point: snap_status, snap_distance_m and, for each mode, status, facility, time and distance."""
    fields = F.first(F.struct("routing_status", "facility_id", "travel_time_min", "distance_m"))
    wide = rows.groupBy("demand_id").pivot("mode", list(modes)).agg(fields)
    out = snaps.select(F.col("point_id").alias("demand_id"), F.col("status").alias("snap_status"), "snap_distance_m").join(wide, "demand_id", "left")
    for m in modes:
        out = out.withColumns(
            {
                f"routing_status_{m}": F.coalesce(F.col(f"{m}.routing_status"), F.lit(K.SNAP_FAILED)),
                f"nearest_facility_{m}": F.col(f"{m}.facility_id"),
                f"travel_time_min_{m}": F.col(f"{m}.travel_time_min"), f"distance_m_{m}": F.col(f"{m}.distance_m")
            }
        )
    return out.drop(*modes)


def car_vs_foot(nearest: DataFrame) -> DataFrame:
    """Points that both modes have, by category, with the ratio of times where both reach a facility."""
    def side(mode):
        return nearest.where(F.col("mode") == mode).select(
            "demand_id", F.col("facility_id").alias(f"facility_id_{mode}"),
            X.number("travel_time_min").alias(f"{mode}_time_min"),
            F.coalesce("reachable", F.lit(False)).alias(f"{mode}_ok")
        )

    both = F.col("car_ok") & F.col("foot_ok")
    same = F.col("facility_id_car") == F.col("facility_id_foot")
    category = F.when(both & same, K.BOTH_SAME).when(both, K.BOTH_DIFFERENT).when(F.col("car_ok"), K.CAR_ONLY).when(
        F.col("foot_ok"), K.FOOT_ONLY
    ).otherwise(K.BOTH_UNREACHABLE)
    rows = side("car").join(side("foot"), "demand_id")
    return rows.select(
        "demand_id", category.alias("category"), "facility_id_car", "facility_id_foot", "car_time_min", "foot_time_min",
        F.when(both, X.ratio(F.col("foot_time_min"), F.col("car_time_min"))).alias("foot_over_car_ratio")
    )


def car_vs_foot_summary(table: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.col("category") == c)
    both = n(K.BOTH_SAME) + n(K.BOTH_DIFFERENT)
    return table.agg(
        F.count(F.lit(1)).alias("n_total"),
        *(n(c).alias(c) for c in (K.BOTH_SAME, K.BOTH_DIFFERENT, K.CAR_ONLY, K.FOOT_ONLY, K.BOTH_UNREACHABLE)),
        X.percent(n(K.BOTH_DIFFERENT), F.nullif(both, F.lit(0))).alias("pct_different")
    )


def ratio_extremes(table: DataFrame, n: int = 20) -> DataFrame:
    """The n largest ratios among points whose modes reach different facilities (K3)."""
    return table.where((F.col("category") == K.BOTH_DIFFERENT) & F.col("foot_over_car_ratio").isNotNull()).orderBy(
        F.desc("foot_over_car_ratio"), "demand_id"
    ).limit(n)


def three_modes(nearest: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for every id: facility, time and reachability of each mode, how many reach one, ratios, and whether they agree
    (null unless both reach one) (G8)."""
    modes = ("car", "bike", "foot")
    out = nearest.groupBy("demand_id").pivot("mode", list(modes)).agg(F.first(F.struct("facility_id", "travel_time_min"), ignorenulls=True))
    out = ids.select("demand_id").distinct().join(out, "demand_id", "left")
    for m in modes:
        out = out.withColumns({f"time_{m}_min": X.number(F.col(f"{m}.travel_time_min")), f"facility_{m}": F.col(f"{m}.facility_id")})
        out = out.withColumn(f"reachable_{m}", F.col(f"time_{m}_min").isNotNull())
    out = out.drop(*modes)
    n: Column = sum((F.col(f"reachable_{m}").cast("int") for m in modes), F.lit(0))
    out = out.withColumn("n_modes_reachable", n)
    names = F.array(*(F.lit(x) for x in K.MODES_REACHABLE))
    out = out.withColumn("reachability_category", F.get(names, F.col("n_modes_reachable")))
    for a, b in (("bike", "car"), ("foot", "car"), ("foot", "bike")):
        out = out.withColumn(f"{a}_over_{b}_ratio", X.ratio(F.col(f"time_{a}_min"), F.col(f"time_{b}_min")))
    for a, b in (("car", "bike"), ("car", "foot"), ("bike", "foot")):
        out = out.withColumn(
            f"{a}_{b}_same_facility",
            F.when(F.col(f"reachable_{a}") & F.col(f"reachable_{b}"), F.col(f"facility_{a}") == F.col(f"facility_{b}"))
        )
    return out


def straight_line_vs_network(rows: DataFrame, demand: DataFrame, facilities: DataFrame) -> DataFrame:
    """Network over great-circle distance of the rows that have a facility; null where the latter is 0."""
    d = demand.select("demand_id", F.col("lon").alias("d_lon"), F.col("lat").alias("d_lat"))
    f = facilities.select("facility_id", F.col("lon").alias("f_lon"), F.col("lat").alias("f_lat"))
    out = rows.where(F.col("facility_id").isNotNull()).join(d, "demand_id").join(f, "facility_id")
    metres = X.haversine_m(F.col("d_lon"), F.col("d_lat"), F.col("f_lon"), F.col("f_lat"))
    return out.withColumn("straight_m", metres).withColumn(
        "ratio", X.ratio(F.col("distance_m"), F.col("straight_m"))
    ).drop("d_lon", "d_lat", "f_lon", "f_lat")


def weak_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, component (least node) without regard to direction: labels spread to neighbours and then to the label's own label.
    Labels that have not settled in `rounds` are an error, not a result."""
    _checkpoints(edges)
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    label = both.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
    for _ in range(rounds):
        near = both.join(label, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("m"))
        new = label.join(near, F.col("node") == F.col("u"), "left").select("node", F.least("component", "m").alias("component"))
        jump = new.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        new = new.join(jump, F.col("component") == F.col("_n")).select("node", F.least("component", "_c").alias("component")).checkpoint()
        settled = new.join(label.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty()
        label = new
        if settled:
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def track_recovery(isolated: DataFrame, demand: DataFrame, edges: DataFrame, routed: DataFrame) -> DataFrame:
    """Of points on nodes that were isolated before: how many have edges now, how many a route, how many neither."""
    linked = edges.select(F.explode(F.array("u", "v")).alias("n")).distinct().withColumn("has_edge", F.lit(True))
    got = routed.where(F.col("routing_status") == K.ROUTED).select(F.col("demand_id").alias("r")).distinct().withColumn("has_route", F.lit(True))
    rows = demand.join(
        isolated.select("node_id").distinct(), "node_id", "left_semi"
    ).join(linked, F.col("node_id") == F.col("n"), "left").join(got, F.col("demand_id") == F.col("r"), "left")
    counts = rows.agg(
        F.count_if(F.col("has_edge")).alias("n_recovers_edges"),
        F.count_if(F.col("has_route")).alias("n_recovers_route"),
        F.count_if(F.col("has_edge").isNull()).alias("n_still_isolated")
    )
    return isolated.select("node_id").distinct().agg(F.count(F.lit(1)).alias("n_previously_isolated")).crossJoin(F.broadcast(counts))


def routing_quality(rows: DataFrame) -> DataFrame:
    """(metric, value) by mode: counts of each status."""
    n = lambda s: F.count_if(F.col("routing_status") == s)
    wide = rows.groupBy("mode").agg(
        n(K.SNAP_FAILED).alias("snap_failed"), (F.count(F.lit(1)) - n(K.SNAP_FAILED)).alias("snap_success"),
        n(K.ROUTED).alias("routed"), n(K.NO_ROUTE).alias(K.NO_ROUTE)
    )
    long = wide.unpivot("mode", ["snap_failed", "snap_success", "routed", K.NO_ROUTE], "name", "value")
    return long.select(F.concat_ws("_", "mode", "name").alias("metric"), "value")
