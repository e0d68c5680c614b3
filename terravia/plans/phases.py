"""Whole phases: from raw records to facilities and demand points that may be routed, with a report of every rule, a detail of
every record that a rule touched, and alarms; and the tables a dashboard reads. No record goes without a trace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import exprs as X
from ..operators import access, filters, geo, inequality, linkage, quality, sampling, weights

#: Alarms: at most these shares in percent.
MISSING_PCT, OUT_PCT, MOJIBAKE_PCT = 15.0, 5.0, 1.0


def checked(
    df: DataFrame, key: str, code: str, texts: Sequence[str], districts: DataFrame | None, buffer_m: float = 1000.0,
    order: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The six rules on records with lon and lat: (records without exact copies, with their flags; the report, a row a rule).

    Copies go first, so that the other rules count each record once; then missing and far coordinates, exchanged ones (put right where the
    exchanged point lies in the declared district), the declared district, and text that was decoded wrongly (V6)."""
    own = df.columns
    flagged = quality.duplicate_flags(df, key, own, order)
    kept = flagged.where(~F.col("dup_drop"))
    kept = kept.withColumns({"lon": X.number("lon"), "lat": X.number("lat")})
    kept = kept.withColumn("coord_missing", quality.coord_missing(F.col("lon"), F.col("lat")))
    kept = kept.withColumn("coord_out_of_bbox", quality.coord_out_of_bbox(F.col("lon"), F.col("lat"), F.col("coord_missing")))
    inside = F.lit(False)
    if districts is not None:
        kept = geo.within_declared(kept, districts, code, "lat", "lon", buffer_m=buffer_m, name="_swapped_inside")
        inside = F.col("_swapped_inside")
    kept = quality.correct_swapped(kept, inside).drop("_swapped_inside")
    excluded = quality.excluded_from_routing(F.col("coord_missing"), F.col("coord_out_of_bbox"), F.col("swap_corrected"))
    kept = kept.withColumn("qc_excluded_from_routing", excluded).withColumn("qc_district_mismatch", F.lit(False))
    if districts is not None:
        kept = geo.within_declared(kept, districts, code, buffer_m=buffer_m, name="_inside")
        kept = kept.withColumn(
            "qc_district_mismatch", ~F.col("qc_excluded_from_routing") & F.coalesce(~F.col("_inside"), F.lit(False))
        ).drop("_inside")

    n = lambda c: F.count_if(F.col(c))
    values = sum((F.count(F.col(c)) for c in texts), F.lit(0))
    bad = sum((F.count_if(X.mojibake(c)) for c in texts), F.lit(0))
    copies = flagged.agg(n("dup_any").alias("dups"), n("dup_drop").alias("copies"), n("dup_conflict").alias("conflicts"))
    one = kept.agg(
        F.count(F.lit(1)).alias("total"), n("coord_missing").alias("missing"), n("coord_out_of_bbox").alias("out"), n("swap_candidate").alias("swaps"), n("swap_corrected").alias("fixed"),
        n("swap_ambiguous").alias("unclear"), n("qc_district_mismatch").alias("apart"), values.alias("values"), bad.alias("bad"),
    ).crossJoin(F.broadcast(copies))
    fine = F.coalesce(X.percent(F.col("bad"), F.nullif(F.col("values"), F.lit(0))), F.lit(0.0)) <= MOJIBAKE_PCT
    zero = F.lit(0).cast("long")

    def rule(name, n_, action, corrected=zero, dropped=zero, warned=None):
        return F.struct(
            F.lit(K.RULES[name]).alias("regla"), n_.alias("n_afectados"), action.alias("accion"),
            corrected.alias("n_corregidos"), dropped.alias("n_eliminados"),
            (n_ if warned is None else warned).alias("n_warnings")
        )

    c = F.col
    rows = F.array(
        rule("coord_missing", c("missing"), F.lit(K.EXCLUDE)),
        rule("coord_out_of_bbox", c("out"), F.lit(K.EXCLUDE)),
        rule("swap_candidate", c("swaps"), F.lit(f"{K.CORRECT} / {K.WARN}"), c("fixed"), zero, c("unclear")),
        rule("district_mismatch", c("apart"), F.lit(K.WARN if districts is not None else "n/a (sin límites IGN)")),
        rule("duplicates", c("dups"), F.lit(f"{K.DROP_COPY} / {K.WARN}"), zero, c("copies"), c("conflicts")),
        rule("encoding", c("bad"), F.when(fine, K.VERIFIED).otherwise(K.CORRECT), zero, zero, F.when(fine, zero).otherwise(c("bad"))),
    )
    report = one.select("total", F.inline(rows))
    return kept, report


def audit(records: DataFrame, key: str, dataset: str) -> DataFrame:
    """The records that a rule touched, with their flags."""
    names = {
        "qc_duplicate_conflicting": "dup_conflict", "qc_coord_missing": "coord_missing",
        "qc_coord_out_of_bbox": "coord_out_of_bbox", "qc_latlon_swap_corrected": "swap_corrected",
        "qc_latlon_swap_ambiguous": "swap_ambiguous"
    }
    rows = records.withColumnsRenamed({v: k for k, v in names.items()})
    flags = [*names, "qc_district_mismatch"]
    return quality.audit_detail(rows, key, flags).select(F.lit(dataset).alias("dataset"), "record_key", *flags)


def alarms(report: DataFrame, dataset: str) -> DataFrame:
    """regla, alarm of the rules whose share of records is over its bound."""
    bound = F.when(F.col("regla") == K.RULES["coord_missing"], MISSING_PCT).when(F.col("regla") == K.RULES["coord_out_of_bbox"], OUT_PCT)
    share = X.percent(F.col("n_afectados"), F.nullif(F.col("total"), F.lit(0)))
    text = F.concat(F.lit(f"ALARM {dataset}: "), F.col("n_afectados").cast("string"), F.lit("/"), F.col("total").cast("string"))
    return report.where(share > bound).select("regla", text.alias("alarm"))


def process_facilities(
    df: DataFrame, departments: Sequence[str], districts: DataFrame | None = None, order: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """Raw facility records (COD_IPRESS, NOMBRE, DEPARTAMENTO, PROVINCIA, DISTRITO, UBIGEO, DIRECCION, CATEGORIA, ESTADO, NORTE, ESTE)
    -> facilities, quality, audit, alarms. districts: UBIGEO, rings. order: which of exact copies stays is told by these."""
    rows = filters.scope(df, "DEPARTAMENTO", departments).withColumns({"lon": F.col("ESTE"), "lat": F.col("NORTE")})
    records, report = checked(rows, "COD_IPRESS", "UBIGEO", ["NOMBRE", "DIRECCION", "DISTRITO", "PROVINCIA"], districts, order=order)
    records = records.withColumns({"CATEGORIA_NORM": X.normalize_category("CATEGORIA"), "is_active": X.is_active("ESTADO")})
    records = records.withColumn("is_resolutive", F.col("is_active") & F.col("CATEGORIA_NORM").isin(*K.RESOLUTIVE))
    records = records.withColumn("usable_for_routing", F.col("is_resolutive") & ~F.col("qc_excluded_from_routing"))
    kept = [
        "COD_IPRESS", "NOMBRE", "DEPARTAMENTO", "PROVINCIA", "DISTRITO", "UBIGEO", "CATEGORIA", "CATEGORIA_NORM",
        "ESTADO", "is_active", "is_resolutive", "usable_for_routing", "qc_excluded_from_routing",
        "qc_district_mismatch", "lon", "lat"
    ]
    return {
        "facilities": records.select(*kept), "quality": report.drop("total"),
        "audit": audit(records, "COD_IPRESS", "facilities"), "alarms": alarms(report, "facilities")
    }


def process_demand(
    df: DataFrame, departments: Sequence[str], districts: DataFrame | None = None, max_points: int = 5000,
    seed: int = 42, order: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """Raw settlements (CODCP, NOMCP, DEP, PROV, DIST, UBIGEO, XGD, YGD and more) -> demand (a design sample where more than max_points are
    usable), quality, audit, alarms and counts (n_national, n_in_scope, n_usable)."""
    rows = filters.scope(df, "DEP", departments).withColumns({"lon": F.col("XGD"), "lat": F.col("YGD")})
    records, report = checked(rows, "CODCP", "UBIGEO", ["NOMCP", "DIST", "PROV"], districts, order=order)
    usable = records.where(~F.col("qc_excluded_from_routing"))
    sampled = sampling.sample_if_needed(usable, "UBIGEO", "CODCP", max_points, seed)
    kept = [
        c for c in ("CODCP", "NOMCP", "DEP", "PROV", "DIST", "UBIGEO", "CAPITAL", "CON_IE", "Z", "XGD", "YGD", "CPINEI", "CPINEI2") if c in df.columns
    ]
    final = sampled.select(
        *kept, "qc_district_mismatch", "stratum_n", "stratum_sample_n", "inclusion_prob", "design_weight", "lon", "lat",
        F.lit(None).cast("double").alias("estimated_population")
    )
    inside = F.upper(F.trim(F.col("DEP"))).isin([d.upper() for d in departments])
    counts = df.agg(
        F.count(F.lit(1)).alias("n_national"), F.count_if(inside).alias("n_in_scope")
    ).crossJoin(F.broadcast(usable.agg(F.count(F.lit(1)).alias("n_usable"))))
    return {
        "demand": final, "quality": report.drop("total"), "audit": audit(records, "CODCP", "demand"),
        "alarms": alarms(report, "demand"), "counts": counts
    }


def snap_group(points: DataFrame, nodes: DataFrame, label: str, point_id: str, node_id: str, max_m: float) -> DataFrame:
    """Snapped points with their kind; a point that failed has no node to be routed from."""
    out = geo.snap(points, nodes, point_id, node_id, max_m)
    return out.withColumn("routing_node", F.when(F.col("status") == "success", F.col("node_id"))).withColumn("point_type", F.lit(label))


# --- tables of a dashboard --------------------------------------------------------------------------------


def attach(df: DataFrame, other: DataFrame, on: Sequence[str], columns: Sequence[str], how: str = "left") -> DataFrame:
    """df with columns of another table by keys that are unique there (J17, J19, J22); inner keeps what both have."""
    return df.join(other.select(*on, *columns), list(on), how)


def facility_layer(facilities: DataFrame, raw: DataFrame, key: str = "COD_IPRESS") -> DataFrame:
    """Facilities with the institution of the raw records and the layer of the map they belong to."""
    out = attach(facilities, raw, [key], ["INSTITUCION"])
    upgrade = F.col("CATEGORIA_NORM").isin("I-3", "I-4") & F.col("is_active")
    return out.withColumn(
        "layer_category",
        F.when(F.col("is_resolutive"), K.LAYER_RESOLUTIVE).when(upgrade, K.LAYER_UPGRADE).otherwise(K.LAYER_OTHER)
    )


def heads(sizes: dict[str, tuple[DataFrame, str, int]]) -> dict[str, DataFrame]:
    """The first rows of some tables by a key, for a dry run (K5)."""
    return {name: df.orderBy(key).limit(n) for name, (df, key, n) in sizes.items()}


def captured_population(pop: DataFrame, demand: DataFrame, dep: str, code: str, value: str, key: str) -> DataFrame:
    """Records and population by department and by whether a demand point has the record's code."""
    known = demand.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_k")).distinct()
    rows = pop.join(known, F.col(code).cast("string") == F.col("_k"), "left").withColumn("matched", F.col("_k").isNotNull())
    return rows.groupBy(dep, "matched").agg(F.count(F.lit(1)).alias("n_cp"), F.sum(value).alias("population"))


def universe(
    demand: DataFrame, pop: DataFrame, key: str, id_col: str, pop_key: str, pop_value: str,
    override: dict[str, str] | None = None
) -> DataFrame:
    """The population that settlements stand for, each record once (J3, then J5)."""
    return linkage.population_universe(linkage.flag_representative(demand, key, id_col, override), pop, key, pop_key, pop_value)


def analyse(
    demand: DataFrame, routing: DataFrame, pop: DataFrame, areas: DataFrame, frame: DataFrame | None = None, *, key: str = "CPINEI", pop_key: str = "code", pop_value: str = "pop",
    groups: Sequence[str] = ("dep", "prov", "dist"), override: dict[str, str] | None = None, low_share: float = 50.0,
) -> dict[str, DataFrame]:
    """From demand, its routing, population and kinds of area to every table of the analysis. demand: demand_id, the key, the groups and
    design_weight; frame: all settlements before sampling; where it is given, weights are calibrated by district to the population of the
    frame, each record once; else the Horvitz-Thompson weight stands."""
    groups = list(groups)
    linked = linkage.match_report(
        linkage.flag_representative(demand, key, "demand_id", override), pop, key, pop_key, pop_value,
        representative="is_representative"
    )
    linked = linked.withColumns({"analysis_weight": weights.analysis_weight(), "population_match_status": F.col("match_status")})
    table = linkage.demand_analysis(demand, routing, linked, areas)
    out = {"match_summary": weights.match_summary(linked, groups[0])}
    if frame is not None:
        known = universe(
            frame, pop, key, "demand_id", pop_key, pop_value, override
        ).groupBy(*groups).agg(F.sum("population").alias("known_population"))
        out["calibration"] = weights.calibration_factors(table, known, groups, "ht_population_weight", "known_population")
        table = weights.calibrated(table, out["calibration"], groups, "ht_population_weight")
    else:
        table = table.withColumn("calibrated_weight", F.col("ht_population_weight"))
    weight = "calibrated_weight"
    districts = access.district_metrics(table, groups, weight=weight)
    districts = districts.withColumn(
        "district_status",
        X.district_quality(F.col("n_cp_with_weight"), F.col("n_cp_with_time"), F.col("share_with_time_pct"), least_share=low_share)
    )
    ranked, rest = inequality.split_gaps(districts, groups)
    return out | {
        "demand_analysis": table, "access_by_department": report_access(
            table, groups[0], weight=weight
        ), "districts": districts, "worst_computable": ranked, "insufficient": rest,
        "coverage": access.bands_cumulative(table, weight=weight), "urban_rural": access.urban_rural_summary(table, weight=weight), "inequality": inequality.weighted_gini(
            table, "t_min", weight
        ),
        "lorenz": inequality.lorenz_curve(table, "t_min", weight), "header": access.kpi_header(table, weight=weight),
    }


def report_access(df: DataFrame, dep: str, time: str = "t_min", weight: str = "weight") -> DataFrame:
    """The total and each department: population, mean time, and cumulative shares of all weight, in one rollup."""
    names = {"<=30": "pct_le_30", "<=60 (cum)": "pct_le_60", "<=120 (cum)": "pct_le_120", ">120": "pct_gt_120", "sin_tiempo_estimable": "pct_no_time"}
    t, w = F.col(time), F.col(weight)
    both = t.isNotNull() & w.isNotNull()
    rows = df.where(F.col(dep).isNotNull()).rollup(dep).agg(
        F.grouping(dep).alias("_g"), F.sum(w).alias("population"),
        X.ratio(F.sum(F.when(both, t * w)), F.sum(F.when(both, w))).alias("weighted_mean"),
        *access.cumulative_columns(time, weight)
    )
    shares = (X.percent(F.col(f"`{k}`"), F.nullif(F.col("population"), F.lit(0))).alias(v) for k, v in names.items())
    return rows.select(F.when(F.col("_g") == 1, "Total").otherwise(F.col(dep)).alias("scope"), "population", "weighted_mean", *shares)


def macros(one: DataFrame, digits: int = 1) -> DataFrame:
    """name, value of a one-row table: whole numbers with thousands set off, others with so many digits, a dash for none."""
    whole = ("tinyint", "smallint", "int", "bigint")
    rows = F.array(
        *(F.struct(F.lit(n).alias("name"), X.fmt_num(n, 0 if k in whole else digits).alias("value")) for n, k in one.dtypes if k != "string")
    )
    return one.select(F.inline(rows))


def audits(*each: DataFrame) -> DataFrame:
    """The details of several data sets as one table."""
    out = each[0]
    for a in each[1:]:
        out = out.unionByName(a)
    return out
