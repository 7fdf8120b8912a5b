"""Object scores: component values, branch sums, penalties, caps and priority classes, all in one projection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.scalars import clamp01, feature_component, flag_union, number_or_zero

# Scale, caps, weights and class thresholds.
STRONG_Z, STATIC_CAP, SMALL_PIXELS = 3.0, 0.70, 12
CROPLAND = {"moisture": 0.20, "vegetation": 0.15, "brightness": 0.15, "thermal": 0.10, "sar": 0.10, "morphology": 0.10, "persistence": 0.10, "post_rain": 0.05, "geology": 0.05}
FOREST = {"morphology": 0.25, "canopy_structure": 0.15, "canopy_moisture": 0.15, "dem": 0.15, "sar": 0.10, "persistence": 0.10, "geology": 0.05, "cluster_adjacency": 0.05}
MIXED = {"object_integrity": 0.25, "morphology": 0.20, "cropland_signal": 0.15, "forest_signal": 0.15, "sar": 0.10, "dem": 0.10, "geology": 0.05}
UNKNOWN = {"morphology": 0.25, "persistence": 0.25, "sar": 0.25, "dem": 0.25}
THRESHOLDS = {"A": 0.75, "B": 0.55, "C": 0.35}


def weighted_sum(values: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Sum of weight times value; missing values are 0, weights aren't renormalised."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        if weight is not None and name in values:
            total = total + F.lit(float(weight)) * F.coalesce(values[name], F.lit(0.0))
    return total


def _less(penalty: Column | None) -> Column:
    return F.lit(0.0) if penalty is None else F.coalesce(penalty, F.lit(0.0))


def active_weights(configured: Mapping[str, float | None] | None, default: Mapping[str, float] = CROPLAND) -> dict[str, float]:
    """The configured weights that are set; the defaults if none is."""
    kept = {k: float(v) for k, v in (configured or {}).items() if v is not None}
    return kept or dict(default)


def cropland_score(values: Mapping[str, Column], penalty: Column | None = None, weights: Mapping[str, float | None] | None = None) -> Column:
    return clamp01(weighted_sum(values, active_weights(weights)) - _less(penalty))


def forest_score(values: Mapping[str, Column], penalty: Column | None = None) -> Column:
    return clamp01(weighted_sum(values, FOREST) - _less(penalty))


def mixed_score(values: Mapping[str, Column], penalty: Column | None = None) -> Column:
    return clamp01(weighted_sum(values, MIXED) - _less(penalty))


def branch_score(branch: Column, values: Mapping[str, Column], penalty: Column | None = None) -> Column:
    """Score by land-cover branch, in lower case; unknown branches take the mean of four supports."""
    b = F.lower(branch)
    other = clamp01(weighted_sum(values, UNKNOWN) - _less(penalty))
    return F.when(b == "cropland", cropland_score(values, penalty)).when(b == "forest", forest_score(values, penalty)).when(b == "mixed", mixed_score(values, penalty)).otherwise(other)


def component_values(per_feature_max: Column) -> Column:
    """map of component -> largest clamped z / 3 over the features of that component."""
    entries = F.transform(F.map_entries(per_feature_max), lambda e: F.struct(feature_component(e["key"]).alias("c"), clamp01(number_or_zero(e["value"]) / STRONG_Z).alias("v")))
    known = F.filter(entries, lambda e: e["c"].isNotNull())
    names = F.array_distinct(F.transform(known, lambda e: e["c"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_max(F.transform(F.filter(known, lambda e: e["c"] == n), lambda e: e["v"]))))


def evidence_maxima(per_feature_max: Column) -> Column:
    """map of component -> largest raw z, for exports."""
    entries = F.filter(F.transform(F.map_entries(per_feature_max), lambda e: F.struct(feature_component(e["key"]).alias("c"), e["value"].alias("v"))), lambda e: e["c"].isNotNull() & e["v"].isNotNull())
    names = F.array_distinct(F.transform(entries, lambda e: e["c"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_max(F.transform(F.filter(entries, lambda e: e["c"] == n), lambda e: e["v"]))))


def shape_support(circularity: Column, elongation: Column) -> Column:
    c, e = number_or_zero(circularity), number_or_zero(elongation)
    straight = F.when(e > 0, clamp01((4.0 - F.greatest(e, F.lit(1.0))) / 3.0)).otherwise(0.0)
    return F.when((c > 0) | (e > 0), clamp01(0.70 * clamp01(c) + 0.30 * straight)).otherwise(0.0)


def morphology_score(static_score: Column, circularity: Column, elongation: Column) -> Column:
    s = number_or_zero(static_score)
    return F.when(s > 0, s).otherwise(shape_support(circularity, elongation))


def persistence_score(seasons: Column, dates: Column, target: int = 2) -> Column:
    """Repeated seasons over the target, clamped; without them the distinct years of the dates."""
    n = number_or_zero(seasons)
    years = F.size(F.array_distinct(F.transform(F.filter(F.coalesce(dates, F.array().cast("array<string>")), lambda d: d != ""), lambda d: F.substring(d, 1, 4))))
    return clamp01(F.when(n > 0, n).otherwise(years.cast("double")) / F.lit(float(max(1, target))))


def object_score(evidence: Column, static: Column, dynamic: Column, morphology: Column, penalty: Column) -> Column:
    base = (
        F.when(evidence == "static_only", F.least(static, F.lit(STATIC_CAP)))
        .when(evidence == "static_dynamic", 0.55 * dynamic + 0.45 * static)
        .when(evidence == "dynamic_only", 0.85 * dynamic + 0.15 * morphology)
        .otherwise(0.50 * dynamic + 0.50 * static)
    )
    return clamp01(base - penalty)


def capped(score: Column, flags: Column, pixels: Column, strong: Column, thresholds: Mapping[str, float] = THRESHOLDS) -> Column:
    """Large or broad objects stay under class B; weak small or elongated ones under C; weak ones of few pixels under B."""
    has = lambda name: F.coalesce(F.array_contains(flags, name), F.lit(False))
    under = lambda name: F.lit(max(0.0, thresholds[name] - 1e-6))
    px, free = number_or_zero(pixels), F.lit(float("inf"))
    return F.least(
        score,
        F.when(has("too_large") | has("broad_patch"), under("B")).otherwise(free),
        F.when(~strong & (has("too_small") | has("elongated")), under("C")).otherwise(free),
        F.when(~strong & (px > 0) & (px <= SMALL_PIXELS), under("B")).otherwise(free),
    )


def strong_support(false_positive_flags: Column, features: Column, seasons: Column) -> Column:
    """No false-positive flag, three distinct features and two seasons."""
    none = F.coalesce(F.size(false_positive_flags), F.lit(0)) <= 0
    return none & (F.size(F.array_distinct(F.coalesce(features, F.array().cast("array<string>")))) >= 3) & (number_or_zero(seasons) >= 2)


def priority_class(score: Column, thresholds: Mapping[str, float] = THRESHOLDS) -> Column:
    return F.when(score >= thresholds["A"], "A").when(score >= thresholds["B"], "B").when(score >= thresholds["C"], "C").otherwise("D")


def dominant_evidence(evidence: Column, static: Column, dynamic: Column, branch: Column) -> Column:
    return (
        F.when(evidence == "static_dynamic", F.concat(branch, F.lit(" dynamic anomaly with static morphology")))
        .when(evidence == "static_only", F.lit("static morphology"))
        .when(dynamic > static, F.concat(branch, F.lit(" dynamic anomaly")))
        .otherwise(F.regexp_replace(evidence, "_", " "))
    )


_OPTIONAL = {
    "evidence_class": "string", "landcover_branch": "string", "static_score": "double", "circularity": "double", "elongation": "double", "per_feature_max": "map<string,double>",
    "max_anomaly": "double", "dynamic_max_anomaly": "double", "repeated_seasons": "int", "anomalous_dates": "array<string>", "false_positive_penalty": "double", "false_positive_flags": "array<string>",
    "source_feature_names": "array<string>", "dynamic_object_flags": "array<string>", "support_pixel_count": "int", "missing_data_flags": "array<string>",
}


def score_objects(objects: DataFrame, weights: Mapping[str, float | None] | None = None, thresholds: Mapping[str, float] | None = None, min_repeated_seasons: int = 2) -> DataFrame:
    """Candidates with static_score, dynamic_score, object_score, priority_class, dominant_evidence and missing_data_flags.

    Absent optional columns count as missing. One projection, no shuffle.
    """
    limits = dict(thresholds or THRESHOLDS)
    out = objects
    for name, kind in _OPTIONAL.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    c = F.col
    evidence = F.when(F.coalesce(c("evidence_class"), F.lit("")) == "", "dynamic_only").otherwise(c("evidence_class"))
    branch = F.when(F.coalesce(c("landcover_branch"), F.lit("")) == "", "unknown").otherwise(F.lower("landcover_branch"))
    out = out.withColumns({"__evidence": evidence, "__branch": branch, "__static": number_or_zero(c("static_score")), "__values": component_values(F.coalesce(c("per_feature_max"), F.create_map().cast("map<string,double>")))})
    out = out.withColumn("__morph", morphology_score(c("__static"), c("circularity"), c("elongation")))
    values = {k: F.try_element_at("__values", F.lit(k)) for k in ("moisture", "vegetation", "brightness", "thermal", "sar", "post_rain", "geology")}
    values |= {"morphology": c("__morph"), "persistence": persistence_score(c("repeated_seasons"), c("anomalous_dates"), min_repeated_seasons)}
    strongest = F.array_max(F.map_values("__values"))
    peak = F.when(number_or_zero(c("dynamic_max_anomaly")) != 0, c("dynamic_max_anomaly")).otherwise(c("max_anomaly"))
    generic = F.when(F.size("__values") > 0, strongest).otherwise(clamp01(number_or_zero(peak) / STRONG_Z))
    dynamic = F.when((c("__branch") == "cropland") & (F.size("__values") > 0), cropland_score(values, None, weights)).otherwise(generic)
    out = out.withColumn("__dynamic", F.when(c("__evidence") == "static_only", 0.0).otherwise(dynamic))
    score = object_score(c("__evidence"), c("__static"), c("__dynamic"), c("__morph"), number_or_zero(c("false_positive_penalty")))
    strong = strong_support(c("false_positive_flags"), c("source_feature_names"), c("repeated_seasons"))
    out = out.withColumn("__score", capped(score, c("dynamic_object_flags"), c("support_pixel_count"), strong, limits))
    added = F.filter(
        F.array(
            F.when(c("__evidence") == "static_only", F.lit("missing_dynamic_evidence")),
            F.when(c("__branch") == "forest", F.lit("missing_forest_branch_scoring")),
            F.when(c("__branch") == "mixed", F.lit("missing_mixed_branch_scoring")),
        ),
        lambda x: x.isNotNull(),
    )
    out = out.withColumns(
        {
            "static_score": c("__static"), "dynamic_score": c("__dynamic"), "object_score": c("__score"), "priority_class": priority_class(c("__score"), limits),
            "dominant_evidence": dominant_evidence(c("__evidence"), c("__static"), c("__dynamic"), c("__branch")), "missing_data_flags": flag_union(c("missing_data_flags"), added),
        }
    )
    return out.drop("__evidence", "__branch", "__static", "__values", "__morph", "__dynamic", "__score")
