"""Vocabularies that results carry."""

# The statuses, bands and categories that outputs are compared by.
ROUTED, SNAP_FAILED = "routed", "snap_failed"
NO_ROUTE, CROSS_DEPARTMENT = "no_route_same_department", "cross_department_not_evaluated"
MATCHED, UNMATCHED, AMBIGUOUS = "matched", "unmatched", "ambiguous"
DUPLICATE_EXCLUDED = "duplicate_key_excluded_non_representative"
BANDS = ("<=30", ">30_<=60", ">60_<=120", ">120")
NO_TIME = "unroutable_or_not_estimated"
CUMULATIVE = ("<=30", "<=60 (cum)", "<=120 (cum)", ">120", "sin_tiempo_estimable")
URBAN, RURAL, UNKNOWN = "urban", "rural", "unknown"
COMPUTABLE = "computable"
LOW_ROUTING, ZERO_ROUTING = "low_routing_coverage", "zero_routing_coverage"
LOW_SAMPLE, ZERO_SAMPLE = "low_population_sample_coverage", "zero_population_sample_coverage"
CALIBRATION_IMPOSSIBLE = "calibration_impossible"
CALIBRATED, NO_SAMPLE = "calibrated", "impossible_no_sample"
BOTH_SAME, BOTH_DIFFERENT = "both_reachable_same_facility", "both_reachable_different_facility"
CAR_ONLY, FOOT_ONLY, BOTH_UNREACHABLE = "car_only_reachable", "foot_only_reachable", "both_unreachable"
MODES_REACHABLE = ("none_reachable", "exactly_one_reachable", "exactly_two_reachable", "all_three_reachable")
CATEGORIES = ("I-1", "I-2", "I-3", "I-4", "II-1", "II-2", "II-E", "III-1", "III-2", "III-E")
RESOLUTIVE = ("II-1", "II-2", "II-E", "III-1", "III-2", "III-E")
NO_CATEGORY, UNKNOWN_CATEGORY = "SIN_CATEGORIA", "DESCONOCIDA"
ALL, ALL_TOKEN = "Todos", "todos"
STATUS_LABELS = {
    "computable": "Computable",
    "low_routing_coverage": "Baja cobertura de ruteo",
    "zero_routing_coverage": "Sin ninguna ruta calculada",
    "low_population_sample_coverage": "Muestra insuficiente (población)",
    "zero_population_sample_coverage": "Sin muestra con población",
    "calibration_impossible": "Calibración imposible (sin muestra)",
}

# Road classes and speeds in km/h.
NEVER = ("proposed", "construction", "abandoned", "razed", "platform", "raceway")
CAR_EXCLUDED = ("footway", "path", "pedestrian", "steps", "cycleway", "bridleway", "corridor")
HIGH_SPEED = ("motorway", "motorway_link", "trunk", "trunk_link")
CAR_SPEED = {
    "motorway": 100, "motorway_link": 60, "trunk": 90, "trunk_link": 50, "primary": 80, "primary_link": 45,
    "secondary": 60, "secondary_link": 40, "tertiary": 50, "tertiary_link": 35, "unclassified": 40,
    "residential": 30, "living_street": 15, "service": 20,
}
CAR_DEFAULT, TRACK_SPEED = 30.0, 12.0
BIKE_SPEED = {
    "cycleway": 18, "primary": 16, "primary_link": 14, "secondary": 15, "secondary_link": 14, "tertiary": 15, "tertiary_link": 14,
    "unclassified": 14, "residential": 14, "living_street": 10, "service": 12, "track": 10, "path": 9, "footway": 8, "pedestrian": 6, "steps": 2,
}
BIKE_DEFAULT, FOOT_SPEED, FOOT_STEPS = 12.0, 5.0, 2.0
EARTH_M = 6_371_000.0
BBOX = (-81.4, -18.4, -68.6, 0.0)

# The rules of a quality report, as it names them, and what each does.
RULES = {
    "coord_missing": "1. coordenadas ausentes/null/cero",
    "coord_out_of_bbox": "2. coordenadas fuera del bbox de Perú",
    "swap_candidate": "3. lat/lon intercambiadas",
    "district_mismatch": "4. punto fuera de su distrito declarado",
    "duplicates": "5. códigos de establecimiento duplicados",
    "encoding": "6. problemas de encoding",
}
EXCLUDE, CORRECT, WARN, DROP_COPY, VERIFIED = "keep_flag_exclude_from_routing", "correct_with_audit", "keep_warning", "drop_duplicate_keep_first", "verificado_ok"
LAYER_RESOLUTIVE, LAYER_UPGRADE, LAYER_OTHER = "Resolutivo", "Candidato upgrade (I-3/I-4)", "Otro"
