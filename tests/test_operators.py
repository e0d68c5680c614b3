"""Operators against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from terravia import constants as K
from terravia.functions import exprs as X
from terravia.plans import phases
from terravia.operators import access, filters, geo, inequality, linkage, network, quality, sampling, scenario, weights


def one(df):
    return df.first().asDict()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_match_report(spark):
    d = spark.createDataFrame([("d1", "k1"), ("d2", "k2"), ("d3", None), ("d4", "k9"), ("d5", "k3")], "id string, code string")
    p = spark.createDataFrame([("k1", 100), ("k2", 200), ("k3", 100), ("k3", 300)], "code string, pop long")
    got = {r.id: r for r in linkage.match_report(d, p, "code", "code", "pop").collect()}
    assert (got["d1"].match_status, got["d1"].population) == (K.MATCHED, 100)
    assert (got["d3"].match_status, got["d3"].match_method, got["d3"].population) == (K.UNMATCHED, "no_key", None)
    assert (got["d4"].match_status, got["d4"].population) == (K.UNMATCHED, None)
    assert (got["d5"].match_status, got["d5"].n_population_records, got["d5"].population) == (K.AMBIGUOUS, 2, None)


def test_duplicate_keys_are_counted_once(spark):
    d = spark.createDataFrame([("a", "k1"), ("b", "k1"), ("c", "k2")], "id string, code string")
    p = spark.createDataFrame([("k1", 100), ("k2", 200)], "code string, pop long")
    flagged = linkage.flag_representative(d, "code", "id", {"k1": "a"})
    got = linkage.match_report(flagged, p, "code", "code", "pop", representative="is_representative")
    assert rows(got, "id", "population", "match_status") == [("a", 100, K.MATCHED), ("b", None, K.DUPLICATE_EXCLUDED), ("c", 200, K.MATCHED)]
    assert not any(r.is_representative for r in linkage.flag_representative(d, "code", "id").where("code = 'k1'").collect())
    u = linkage.population_universe(flagged, p, "code", "code", "pop")
    assert u.count() == 2 and u.agg(F.sum("population")).first()[0] == 300


def test_secondary_key(spark):
    d = spark.createDataFrame([("d", "k1", "k2")], "id string, a string, b string")
    p = spark.createDataFrame([("k1", 100), ("k2", 300)], "code string, pop long")
    r = linkage.match_report(d, p, "a", "code", "pop", "b").first()
    assert (r.population, r.secondary_key_disagrees) == (100, True)


def test_calibration(spark):
    d = spark.createDataFrame([("D", 100.0), ("D", 50.0), (None, 7.0)], "dist string, w double")
    known = spark.createDataFrame([("D", 300.0), ("B", 9.0)], "dist string, known double")
    f = weights.calibration_factors(d, known, ["dist"], "w", "known")
    got = {r.dist: r for r in f.collect()}
    assert set(got) == {"D", "B"} and got["D"].calibration_factor == 2.0
    assert (got["B"].calibration_status, got["B"].calibration_factor) == (K.NO_SAMPLE, None)
    assert weights.calibrated(d, f, ["dist"], "w").agg(F.sum("calibrated_weight")).first()[0] == 300.0


def test_effective_sample_size(spark):
    n = lambda ws: spark.createDataFrame([(w,) for w in ws], "w double").agg(weights.effective_sample_size(F.col("w"))).first()[0]
    assert n([10.0] * 4) == pytest.approx(4)
    assert n([1000.0, 1.0, 1.0]) == pytest.approx(1.004002, abs=1e-5)


def test_bands(spark):
    d = spark.createDataFrame([(t, 1) for t in (30.0, 30.0001, 60.0, 60.0001, 120.0, 120.0001)] + [(None, 1)], "t_min double, weight long")
    assert [r.population for r in access.bands_of_timed(d).collect()] == [1, 2, 2, 1]
    assert [r.population for r in access.bands_of_all(d).collect()] == [1, 2, 2, 1, 1]
    assert sum(r.pct for r in access.bands_of_all(d).collect()) == pytest.approx(100)
    assert [r.population for r in access.bands_cumulative(d).collect()] == [1, 3, 5, 1, 1]
    empty = access.bands_of_timed(d.where("false")).collect()
    assert [(r.population, r.pct) for r in empty] == [(0, None)] * 4


def test_weighted_mean(spark):
    d = spark.createDataFrame([(None, 10), (None, 20)], "t_min double, weight long")
    r = one(access.weighted_mean_access(d))
    assert (r["total_pop"], r["pop_with_time"], r["share_with_time_pct"], r["weighted_mean"]) == (30, 0, 0.0, None)
    r = one(access.weighted_mean_access(spark.createDataFrame([(10.0, 1), (None, 5)], "t_min double, weight long")))
    assert (r["weighted_mean"], r["total_pop"], r["pop_with_time"]) == (10, 6, 1)
    assert one(access.weighted_mean_access(spark.createDataFrame([(10.0, None)], "t_min double, weight long")))["total_pop"] is None


def test_kpis(spark):
    d = spark.createDataFrame([(10.0, 100), (90.0, 50), (None, 30), (40.0, 20)], "t_min double, calibrated_weight long")
    r = one(access.kpis(d))
    assert (
        r["population_frame"], r["population_le"], r["pct_le"], r["population_gt"], r["population_no_time"],
        r["pct_no_time"]
    ) == (200, 120, 60.0, 50, 30, 15.0)
    assert r["weighted_mean"] == pytest.approx(6300 / 170)
    assert inequality.weighted_median(d, "t_min", "calibrated_weight").first()[0] == 10
    r = one(access.kpis(d.where("false")))
    assert (r["population_frame"], r["pct_le"], r["weighted_mean"]) == (0, None, None)


@pytest.mark.parametrize(
    "v, w, gini",
    [
        ((30, 30, 30), (1, 2, 3), 0), ((10, 100), (90, 10), 0.426316), ((10, 1000), (90, 10), 0.817431),
        ((10, 100), (50, 50), 0.409091), ((10, 100), (95, 5), 0.294828), ((0, 0), (1, 1), 1.0)
    ]
)
def test_gini(spark, v, w, gini):
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(v, w, strict=True)], "v double, w double")
    assert inequality.weighted_gini(d, "v", "w").first().gini == pytest.approx(gini, abs=1e-6)


def test_gini_and_lorenz_edges(spark):
    d = spark.createDataFrame([(10.0, 50.0), (None, 50.0)], "v double, w double")
    r = inequality.weighted_gini(d, "v", "w").first()
    assert (r.n_included, r.pct_population_excluded) == (1, 50.0)
    r = inequality.weighted_gini(d.where("false"), "v", "w").first()
    assert (r.gini, r.n_included, r.population_included) == (None, 0, 0)
    d = spark.createDataFrame([(10.0, 1.0), (20.0, 1.0), (5.0, 1.0)], "v double, w double")
    got = inequality.lorenz_curve(d, "v", "w").orderBy("ord").collect()
    assert [r.cum_value for r in got] == pytest.approx([0, 1 / 7, 3 / 7, 1])
    assert inequality.lorenz_curve(d.where("false"), "v", "w").count() == 0


def test_running_sums_over_many_buckets(spark):
    d = spark.range(5000).select(((F.col("id") * 7919) % 1000).cast("double").alias("v"), (1 + F.col("id") % 3).alias("w"))
    got = inequality.running(inequality.by_value(d, "v", "w"), buckets=16).orderBy("v").collect()
    total = 0
    for r in got:
        total += r.w
        assert r.cw == total


def test_ranks(spark):
    d = spark.createDataFrame(
        [("Good", 20.0, 90.0), ("Bad", 100.0, 90.0), ("Small", 15.0, 10.0), ("None", None, None)],
        "d string, weighted_mean double, share_with_time_pct double"
    )
    got = {r.d: (r["rank"], r.low_coverage_warning) for r in inequality.rank_gaps(d, ["d"]).collect()}
    assert got == {"None": (1, True), "Bad": (2, False), "Good": (3, False), "Small": (4, True)}
    assert inequality.worst_district(d, ["d"]).first().d == "Bad" and inequality.worst_district(d.where("false"), ["d"]).count() == 0


def test_district_quality(spark):
    d = spark.createDataFrame(
        [(K.NO_SAMPLE, 5, 5, 90.0), (None, 0, 0, None), (None, 2, 2, 90.0), (None, 5, 0, 0.0), (None, 5, 2, 20.0), (None, 5, 5, 80.0)],
        "c string, n long, t long, s double"
    )
    got = [r[0] for r in d.select(X.district_quality(F.col("n"), F.col("t"), F.col("s"), F.col("c"))).collect()]
    assert got == [K.CALIBRATION_IMPOSSIBLE, K.ZERO_SAMPLE, K.LOW_SAMPLE, K.ZERO_ROUTING, K.LOW_ROUTING, K.COMPUTABLE]


def test_urban_rural_summary_has_three_rows(spark):
    d = spark.createDataFrame([(10.0, 1, "urban"), (200.0, 1, "rural"), (40.0, 1, "urban")], "t_min double, weight long, urban_rural string")
    got = {r.urban_rural: r for r in access.urban_rural_summary(d).collect()}
    assert set(got) == {"urban", "rural", "unknown"} and (got["urban"].n_cp, got["urban"].weighted_mean) == (2, 25) and got["unknown"].n_cp == 0


def test_coordinates(spark):
    d = spark.createDataFrame(
        [("a", -71.9, -13.5), ("b", None, None), ("c", 0.0, 0.0), ("d", -7.8e-7, -6e-8), ("e", 10.0, 50.0), ("f", -13.52, -71.97)],
        "key string, lon double, lat double"
    )
    got = {r.key: r for r in quality.validated(d, "key", inside_swapped=F.col("key") == "f").collect()}
    assert [got[k].coord_missing for k in "abcd"] == [False, True, True, True]
    assert [got[k].coord_out_of_bbox for k in "abcdef"] == [False, False, False, False, True, True]
    assert (got["f"].swap_corrected, got["f"].lon, got["f"].lat, got["f"].qc_excluded_from_routing) == (True, -71.97, -13.52, False)
    r = quality.validated(d, "key").where("key = 'f'").first()
    assert (r.swap_ambiguous, r.lon, r.qc_excluded_from_routing) == (True, -13.52, True)


def test_duplicates(spark):
    d = spark.createDataFrame([("K1", "A"), ("K1", "A"), ("K2", "B"), ("K2", "C"), ("K3", "D"), (None, "E"), (None, "F")], "k string, v string")
    got = quality.duplicate_flags(d, "k")
    assert got.where("dup_any").count() == 4 and got.where("dup_drop").count() == 1 and rows(
        got.where("dup_conflict"), "k", "v"
    ) == [("K2", "B"), ("K2", "C")]


def test_mojibake_and_alarm(spark):
    d = spark.createDataFrame([("SEÃ‘OR",), ("CHACHAPOYAS",), ("NIÃ‘O",), (None,)], "s string")
    r = quality.encoding_report(d, ["s"]).first()
    assert (r.n_values, r.n_flagged, r.ok) == (3, 2, False)
    a = spark.createDataFrame([(20, 100), (10, 100), (0, 0)], "n long, t long").select(quality.alarm(F.col("n"), F.col("t"), 15, "x")).collect()
    assert a[0][0] and a[1][0] is None and a[2][0] is None


def test_categories(spark):
    d = spark.createDataFrame([("II - 1",), (" iii-e ",), ("0",), (None,), ("IV-9",)], "c string")
    assert [r[0] for r in d.select(X.normalize_category("c")).collect()] == ["II-1", "III-E", K.NO_CATEGORY, K.NO_CATEGORY, K.UNKNOWN_CATEGORY]


def test_quotas(spark):
    def quota(sizes, n):
        s = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(sizes)], "s string, size long")
        return [r.quota for r in sampling.quotas(s, "s", "size", n).orderBy("s").collect()]

    assert quota([100, 50, 5], 60) == [39, 19, 2]
    assert quota([100, 0, 2], 90) == [88, 0, 2]
    assert quota([600, 300, 100], 100) == [60, 30, 10]
    assert quota([3, 4], 100) == [3, 4]


def test_sample(spark):
    d = spark.createDataFrame([(f"p{i}", "s") for i in range(6)], "id string, s string")
    got = sampling.sample_if_needed(d, "s", "id", 3)
    assert got.count() == 3 and got.first().design_weight == 2.0 and got.first().stratum_n == 6
    assert rows(got, "id") == rows(sampling.sample_if_needed(d.repartition(5), "s", "id", 3), "id")
    assert {r.design_weight for r in sampling.sample_if_needed(d, "s", "id", 6).collect()} == {1.0}


def test_maxspeed(spark):
    d = spark.createDataFrame([(x,) for x in ("60", "60 km/h", "50;40", "signals", None, "30 mph", "50-60", "2")], "m string")
    got = [r[0] for r in d.select(X.parse_maxspeed("m")).collect()]
    assert got[:5] == [60, 60, 50, None, None] and got[5] == pytest.approx(48.28, abs=0.01) and got[6:] == [None, None]


TAGS = "highway string, maxspeed string, oneway string, access string, bicycle string, foot string, junction string, `oneway:bicycle` string"


def edge(spark, mode, **tags):
    names = ["highway", "maxspeed", "oneway", "access", "bicycle", "foot", "junction", "oneway:bicycle"]
    d = spark.createDataFrame([tuple(tags.get(n.replace(":", "_")) for n in names)], TAGS)
    r = d.select(X.make_edge_weight(mode, d.columns, F.lit(1000.0)).alias("w")).first().w
    return r and (round(r.speed_kmh, 2), r.forward, r.backward)


def test_edge_rules(spark):
    assert edge(spark, "car", highway="motorway") == (100, True, True)
    assert edge(spark, "car", highway="residential", maxspeed="50") == (50, True, True)
    assert edge(spark, "car", highway="track") == (12, True, True) and edge(spark, "car", highway="track", maxspeed="30")[0] == 30
    assert all(edge(spark, "car", highway=h) is None for h in ("footway", "path", "steps", "cycleway", "proposed", None))
    assert edge(spark, "car", highway="primary", access="no") is None
    assert edge(spark, "car", highway="primary", oneway="yes")[1:] == (True, False)
    assert edge(spark, "car", highway="primary", oneway="-1")[1:] == (False, True)
    assert edge(spark, "car", highway="primary", junction="roundabout")[1:] == (True, False)
    assert edge(spark, "bike", highway="motorway") is None and edge(spark, "bike", highway="motorway", bicycle="yes")
    assert edge(spark, "bike", highway="primary", oneway="yes", oneway_bicycle="no")[1:] == (True, True)
    assert edge(spark, "foot", highway="primary", oneway="yes") == (5, True, True) and edge(spark, "foot", highway="steps")[0] == 2


def test_merge_edges(spark):
    a = spark.createDataFrame([(999, 1, 2), (999, 2, 3), (999, 3, 4)], "id long, u long, v long")
    assert network.merge_edges(a, a.limit(1)).count() == 3


def small_graph(spark):
    e = [(1, 2, 60.0, 600.0), (2, 3, 60.0, 100.0), (1, 3, 600.0, 650.0), (4, 3, 5.0, 50.0), (7, 8, 1.0, 1.0)]
    return spark.createDataFrame(e, "u long, v long, time_s double, length double")


def test_matrix_statuses(spark):
    d = spark.createDataFrame(
        [("D1", 2, "A"), ("D2", 1, "A"), ("D3", 2, "B"), ("D4", None, "A"), ("D5", 7, "A")],
        "demand_id string, node_id long, dep string"
    )
    f = spark.createDataFrame([("F", 3, "A")], "facility_id string, node_id long, dep string")
    got = {r.demand_id: r for r in network.matrix(small_graph(spark), d, f, "car").collect()}
    assert {k: r.routing_status for k, r in got.items()} == {
        "D1": K.ROUTED, "D2": K.ROUTED, "D3": K.CROSS_DEPARTMENT, "D4": K.SNAP_FAILED, "D5": K.NO_ROUTE
    }
    assert (got["D1"].travel_time_min, got["D2"].travel_time_min, got["D2"].distance_m) == (1.0, 2.0, 650.0)  # quickest time, shortest length


def test_multi_source_agrees_with_relaxation(spark):
    import random

    rng = random.Random(4)
    e = [(rng.randrange(80), rng.randrange(80), rng.randint(1, 50) + 0.5, 1.0) for _ in range(200)]
    g = spark.createDataFrame(
        [x for x in e if x[0] != x[1]], "u long, v long, time_s double, length double"
    ).groupBy("u", "v").agg(F.min("time_s").alias("time_s"), F.min("length").alias("length"))
    f = spark.createDataFrame([("FA", 3, "x"), ("FB", 40, "x")], "facility_id string, node_id long, dep string")
    d = spark.createDataFrame([(f"n{i}", i, "x") for i in range(80)], "demand_id string, node_id long, dep string")
    got = {r.demand_id: r.travel_time_min for r in network.nearest_multi_source(g, d, f, "car").where("reachable").collect()}
    want = {f"n{r.node}": r.time_s / 60 for r in network.relaxed_times(g, f).collect()}
    assert {k: round(v, 9) for k, v in got.items() if k in want} == {k: round(v, 9) for k, v in want.items() if k in got}
    assert set(want) - set(got) <= {"n3", "n40"}


def test_large_graphs_are_searched_on_tables(spark, monkeypatch):
    """Beyond one worker the same rows come from relaxation on tables, ties included."""
    import random

    rng = random.Random(8)
    e = {(rng.randrange(40), rng.randrange(40)): (float(rng.randint(1, 6)), float(rng.randint(1, 9))) for _ in range(110)}
    g = spark.createDataFrame([(u, v, t, m) for (u, v), (t, m) in e.items() if u != v], "u long, v long, time_s double, length double")
    f = spark.createDataFrame(
        [("FA", 3, "x"), ("FB", 20, "x"), ("FC", 20, "y"), ("FD", None, "x"), ("FE", 999, "y")],
        "facility_id string, node_id long, dep string"
    )
    d = spark.createDataFrame([(f"n{i}", i if i % 9 else None, "xy"[i % 2]) for i in range(45)], "demand_id string, node_id long, dep string")
    runs = []
    for most in (8_000_000, 3):
        monkeypatch.setattr(network, "MAX_EDGES", most)
        near = [sorted(network.nearest_multi_source(g, d, f, "car", same).collect()) for same in (False, True)]
        runs.append([sorted(network.matrix(g, d, f, "car").collect()), *near])
    assert runs[0] == runs[1] and any(r.reachable for r in runs[0][0]) and {r.facility_id for r in runs[0][2]} > {"FA", "FC"}
    monkeypatch.undo()
    with pytest.raises(RuntimeError):
        network.relaxed(g, f.where("node_id = 3").selectExpr("node_id", "facility_id source"), "time_s", rounds=1)
    with pytest.raises(RuntimeError):
        network.weak_components(spark.range(30).selectExpr("id u", "id + 1 v"), rounds=1)


def test_weak_components(spark):
    got = {r.node: r.component for r in network.weak_components(small_graph(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}


def test_modes(spark):
    n = [
        ("D1", "F1", "car", 1.0, True), ("D1", "F1", "foot", 2.0, True), ("D2", "F1", "car", 1.0, True),
        ("D2", "F2", "foot", 5.0, True), ("D3", "F1", "car", 1.0, True), ("D3", None, "foot", None, False),
        ("D4", None, "car", None, False), ("D4", "F1", "foot", 1.0, True), ("D5", None, "car", None, False),
        ("D5", None, "foot", None, False)
    ]
    d = spark.createDataFrame(n, "demand_id string, facility_id string, mode string, travel_time_min double, reachable boolean")
    t = network.car_vs_foot(d)
    assert [r.category for r in t.orderBy("demand_id").collect()] == [K.BOTH_SAME, K.BOTH_DIFFERENT, K.CAR_ONLY, K.FOOT_ONLY, K.BOTH_UNREACHABLE]
    assert network.car_vs_foot_summary(t).first().pct_different == 50
    got = {r.demand_id: r for r in network.three_modes(d, d.select("demand_id")).collect()}
    assert got["D1"].reachability_category == "exactly_two_reachable" and got["D5"].reachability_category == "none_reachable"
    assert got["D1"].car_foot_same_facility is True and got["D3"].car_foot_same_facility is None


def test_snap(spark):
    nodes = spark.createDataFrame([(1, -71.0, -13.0)], "id long, lon double, lat double")
    p = spark.createDataFrame([("a", -71.0001, -13.0), ("b", -75.0, -13.0), ("c", None, None)], "id string, lon double, lat double")
    got = {r.point_id: r for r in geo.snap(p, nodes, "id", "id", 500).collect()}
    assert (got["a"].status, got["a"].node_id) == ("success", 1) and got["a"].snap_distance_m == pytest.approx(10.8345, abs=1e-3)
    assert (got["b"].status, got["b"].node_id) == ("failure", 1) and got["b"].snap_distance_m == pytest.approx(433375.576, abs=1)
    assert got["c"].node_id is None
    assert geo.snap(p, nodes.where("false"), "id", "id", 500).first().fail_reason == "grafo_vacio"
    r = geo.snap_report(spark.createDataFrame([("success", 10.0), ("failure", 3000.0)], "status string, snap_distance_m double")).first()
    assert (r.n_total, r.n_failed, r.pct_failed, r.max_snap_m, r.p95_snap_m) == (2, 1, 50, 3000, 2850.5)


def test_snap_finds_what_brute_force_finds(spark):
    """Near, far and very far points, and some alike."""
    import random

    rng = random.Random(3)
    nodes = [(i, -75 + rng.random() * rng.choice([0.2, 6]), -10 + rng.random() * rng.choice([0.2, 6])) for i in range(300)]
    points = [
        (
            f"p{i}",
            *rng.choice([(-75 + rng.random(), -10 + rng.random()), (-90 + 30 * rng.random(), -20 + 30 * rng.random()), (10.0, 50.0), (-74.9, -9.9)])
        ) for i in range(150)
    ]
    points.append(points[0])
    got = geo.snap(
        spark.createDataFrame(points, "id string, lon double, lat double"),
        spark.createDataFrame(nodes, "id long, lon double, lat double"), "id", "id", 500
    ).collect()
    scale = math.cos(math.radians(sum(n[2] for n in nodes) / len(nodes)))
    want = {p[0]: min((((p[1] - n[1]) * scale) ** 2 + (p[2] - n[2]) ** 2, n[0]) for n in nodes)[1] for p in points}
    assert len(got) == 151 and {r.point_id: r.node_id for r in got} == want


def test_large_strata_are_cut_before_they_are_sorted(spark, monkeypatch):
    df = spark.range(3000).selectExpr("cast(id as string) k", "if(id % 3 = 0, 'a', 'b') s")
    whole = sorted(sampling.stratified_sample(df, "s", "k", 200).collect())
    monkeypatch.setattr(sampling, "LARGE", 500)
    assert sorted(sampling.stratified_sample(df, "s", "k", 200).collect()) == whole and len(whole) == 200


def test_missing_numbers(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert [r.m for r in df.select(X.is_missing("x").alias("m")).collect()] == [False, True, True]
    r = {x.name: x.value for x in phases.macros(spark.sql("select 1234567L n, 2.345 p, cast(null as double) q, 'text' t")).collect()}
    assert r == {"n": "1,234,567", "p": "2.3", "q": "--"}


def test_analysis_without_a_frame_keeps_the_design_weight(spark):
    demand = spark.createDataFrame(
        [("1", "a", "A", "P", "X", 2), ("2", "b", "A", "P", "X", 3), ("3", None, "B", "P", "Y", 1)],
        "demand_id string, CPINEI string, dep string, prov string, dist string, design_weight long"
    )
    routing = spark.createDataFrame(
        [("1", "routed", 10.0), ("2", "snap_failed", 9.0)],
        "demand_id string, routing_status_car string, travel_time_min_car double"
    )
    pop = spark.createDataFrame([("a", 100), ("b", 10)], "code string, pop long")
    areas = spark.createDataFrame([("1", "urban")], "demand_id string, urban_rural string")
    out = phases.analyse(demand, routing, pop, areas)
    assert {r.demand_id: r.calibrated_weight for r in out["demand_analysis"].collect()} == {"1": 200, "2": 30, "3": None}
    total = {r.scope: r for r in out["access_by_department"].collect()}["Total"]
    assert (total.population, total.weighted_mean, round(total.pct_no_time, 4)) == (230, 10.0, round(100 * 30 / 230, 4)) and "calibration" not in out
    assert out["worst_computable"].count() + out["insufficient"].count() == 2 and out["header"].first().weighted_median == 10.0


def test_latex_and_numbers(spark):
    r = spark.range(1).select(
        X.latex_escape(F.lit("a\\b {c} ~^ 5%")).alias("t"), X.fmt_num(F.lit(1234567.86)).alias("n"),
        X.fmt_num(F.lit(None)).alias("none")
    ).first()
    assert tuple(r) == (r"a\textbackslash{}b \{c\} \textasciitilde{}\textasciicircum{} 5\%", "1,234,567.9", "--")
    assert X.map_component_key("map", ["b", "a"], None, [K.ALL]) == "map_a-b_todos_todos"


def test_phases_keep_a_trace_of_everything(spark):
    names = "COD_IPRESS NOMBRE DEPARTAMENTO PROVINCIA DISTRITO UBIGEO DIRECCION CATEGORIA ESTADO NORTE ESTE".split()
    own = lambda code, ub, lat, lon, name="N": (code, name, "cusco", "P", "D", ub, None, "II-1", "ACTIVO", lat, lon)
    rows = [
        own("1", "A", "-3.55", "-80.55"), own("1", "A", "-3.55", "-80.55"), own("2", "A", "-3.55", "-80.45"),
        own("3", "A", "-80.55", "-3.55"), own("4", "A", "-80.45", "-3.55"), own("5", "A", "-0.0000001", "0.0"),
        own("6", "B", "50", "10"), own("7", "B", "-3.55", "-80.45", "x"), own("7", "B", "-3.55", "-80.45", "y")
    ]
    ring = lambda a, b: [[{"x": a, "y": -3.6}, {"x": b, "y": -3.6}, {"x": b, "y": -3.5}, {"x": a, "y": -3.5}]]
    districts = spark.createDataFrame([("A", ring(-80.6, -80.5)), ("B", ring(-80.5, -80.4))], f"UBIGEO string, rings {geo.RINGS}")
    out = phases.process_facilities(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), ["Cusco"], districts)
    f = {(r.COD_IPRESS, r.NOMBRE): r for r in out["facilities"].collect()}
    assert len(f) == 8 and f["2", "N"].qc_district_mismatch and f["2", "N"].UBIGEO == "A" and f["2", "N"].usable_for_routing
    assert (f["3", "N"].lon, f["3", "N"].lat) == (-80.55, -3.55) and f["4", "N"].qc_excluded_from_routing and f["5", "N"].qc_excluded_from_routing
    report = {r.regla[0]: (r.n_afectados, r.n_corregidos, r.n_eliminados, r.n_warnings) for r in out["quality"].collect()}
    assert report == {"1": (1, 0, 0, 1), "2": (3, 0, 0, 3), "3": (2, 1, 0, 1), "4": (1, 0, 0, 1), "5": (4, 0, 1, 2), "6": (0, 0, 0, 0)}
    assert {r.record_key for r in out["audit"].collect()} == {"2", "3", "4", "5", "6", "7"} and [r.regla[0] for r in out["alarms"].collect()] == ["2"]


def test_declared_district(spark):
    ring = [{"x": -72.5, "y": -14.0}, {"x": -71.5, "y": -14.0}, {"x": -71.5, "y": -13.0}, {"x": -72.5, "y": -13.0}]
    box = spark.createDataFrame([("U", [ring])], f"code string, rings {geo.RINGS}")
    p = spark.createDataFrame(
        [
            ("in", "U", -71.97, -13.52), ("out", "U", -70.0, -13.52), ("near", "U", -71.495, -13.5),
            ("else", "X", -70.0, -13.0), ("none", "U", None, None)
        ],
        "id string, code string, lon double, lat double"
    )
    got = {r.id: r.district_mismatch for r in geo.outside_declared(p, box, "code").collect()}
    assert got == {"in": False, "out": True, "near": False, "else": False, "none": False}


def test_utm(spark):
    x, y = X.utm18s(F.lit(-75.0), F.lit(-13.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r.x == pytest.approx(500000, abs=1e-3) and r.y == pytest.approx(8562832, abs=300)


def test_scenario(spark):
    base = spark.createDataFrame(
        [("d1", 50.0, 10.0), ("d2", None, 20.0), ("d3", 200.0, 30.0), ("d4", 10.0, 40.0)],
        "demand_id string, t_min double, calibrated_weight double"
    )
    m = spark.createDataFrame(
        [("d1", "c1", 10.0), ("d2", "c1", 20.0), ("d3", "c1", None), ("d1", "c2", 5.0), ("d4", "c1", 100.0)],
        "demand_id string, facility_id string, travel_time_min double"
    )
    t = lambda sel: [r.scenario_t for r in scenario.scenario_time(base, m, sel).orderBy("demand_id").collect()]
    assert t(None) == t([]) == t(["zz"]) == [50, None, 200, 10]
    assert t(["c1"]) == [10, 20, 200, 10] and t(["c1", "c2"])[0] == 5
    r = scenario.baseline_vs_scenario(base, m, ["c1"]).first()
    assert (r.pop_gain_le_30, r.population_newly_routed) == (30, 20)
    s = {x.facility_id: x for x in scenario.candidate_scores(base, m, weight="calibrated_weight").collect()}
    assert s["c1"].pop_gain_le_30 == 30 and s["c1"].weighted_mean_reduction_min == pytest.approx(r.weighted_mean_reduction_min)
    assert s["c2"].pop_gain_le_30 == 10


def test_filters(spark):
    d = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "z"), (None, None)], "dep string, prov string")
    assert filters.geographic(d, {"dep": ["A"], "prov": [K.ALL]}).count() == 2
    assert [r.option for r in filters.options(d, "prov", {"dep": ["A"]}).collect()] == [K.ALL, "x", "y"]
    assert X.serialize_filter(["b", "a"]) == X.serialize_filter(["a", "b"])


def test_profile_hash_follows_parameters():
    assert X.profile_hash("car") != X.profile_hash("car", 15.0) and len(X.profile_hash("foot")) == 16
    assert math.isclose(access.track_impact(3313, 3721)["gain_pct"], 100 * 408 / 3313)


def test_demand_analysis(spark):
    demand = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "demand_id long, dist string")
    routing = spark.createDataFrame(
        [("1", "x", "routed", 5.0), ("2", "y", "snap_failed", 9.0)],
        "demand_id string, dist string, routing_status_car string, travel_time_min_car double"
    )
    weighted = spark.createDataFrame(
        [("1", 10, "matched", 30, 7), ("3", None, "unmatched", None, 7)],
        "demand_id string, population long, population_match_status string, analysis_weight long, other long"
    )
    areas = spark.createDataFrame([("1", "urban"), ("2", None)], "demand_id string, urban_rural string")
    got = linkage.demand_analysis(demand, routing, weighted, areas)
    assert got.columns == [
        "demand_id", "dist", "dist_routing", "routing_status_car", "travel_time_min_car", "population",
        "population_match_status", "analysis_weight", "urban_rural", "t_min", "ht_population_weight"
    ]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == [
        ("1", "a", "x", "routed", 5.0, 10, "matched", 30, "urban", 5.0, 30),
        ("2", "b", "y", "snap_failed", 9.0, None, None, None, "unknown", None, None),
        ("3", "c", None, None, None, None, "unmatched", None, "unknown", None, None),
        (None, "d", None, None, None, None, None, None, "unknown", None, None),
    ]
    both = linkage.merged(areas, areas, "demand_id")
    assert both.columns == ["demand_id", "urban_rural_x", "urban_rural_y"]
