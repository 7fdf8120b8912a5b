"""Ranking, review tables, learning rows and validation figures.

All outputs are ranked candidates for expert review, never confirmations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.scalars import finite, learning_label, number_or_zero, review_label
from orrery.staging import staged

# The closing sentence of explanations (its other phrases stand in `explanations`), the distance columns.
GUARDRAIL = "Candidate requires expert and field validation; this is not direct H2 detection."
DISTANCES = ("road_distance_m", "built_up_distance_m", "water_distance_m", "quarry_distance_m", "woody_patch_distance_m", "irrigation_distance_m", "cloud_shadow_distance_m", "harvest_pattern_distance_m", "excluded_zone_distance_m")
# Columns of the exported tables, in order.
SCORE_COLUMNS = (
    "rank priority_class candidate_id object_score morphology_type evidence_class landcover_branch dominant_landcover_branch source_landcover_context "
    "source_morphology_type source_false_positive_risk source_notes static_score dynamic_score area_m2 diameter_m circularity elongation annulus_contrast "
    "ringness_score support_pixel_count field_residual_max peer_residual_max temporal_residual_max residual_types_present field_id distance_to_field_edge_m "
    "moisture_anomaly vegetation_stress soil_brightness_bsi thermal_anomaly sar_anomaly persistence post_rain_drying geology_context false_positive_penalty "
    f"{' '.join(DISTANCES)} false_positive_profile evidence flags dominant_evidence false_positive_flags missing_data_flags anomalous_dates source_feature_names "
    "source_layer_ids passport_path"
).split()
REVIEW_COLUMNS = ("expert_label", "expert_confidence", "false_positive_reason", "reviewer_notes")
NOT_LABELED = ("area_m2", "diameter_m", "circularity", "elongation", "annulus_contrast", "ringness_score", "distance_to_field_edge_m", "geology_context", "evidence", "flags")
EVIDENCE = {"moisture_anomaly": "moisture", "vegetation_stress": "vegetation", "soil_brightness_bsi": "brightness", "thermal_anomaly": "thermal", "sar_anomaly": "sar", "post_rain_drying": "post_rain", "geology_context": "geology"}
LABELS = ("positive", "weak_positive", "hard_negative", "unlabeled", "uncertain")
POSITIVE, NEGATIVE = ("positive", "weak_positive"), ("hard_negative",)
ROLES = {"positive": "positive_seed", "weak_positive": "weak_positive_seed", "hard_negative": "hard_negative_control", "unlabeled": "unlabeled_pool", "uncertain": "exclude"}
SUPPORTS = "dynamic_score static_score moisture_anomaly vegetation_stress soil_brightness_bsi thermal_anomaly sar_anomaly post_rain_drying persistence annulus_contrast ringness_score".split()
COMPONENTS = (
    "object_score static_score dynamic_score moisture_anomaly vegetation_stress soil_brightness_bsi thermal_anomaly sar_anomaly post_rain_drying persistence annulus_contrast "
    f"ringness_score support_pixel_count field_residual_max peer_residual_max temporal_residual_max false_positive_penalty {' '.join(DISTANCES)}"
).split()


def ranked(candidates: DataFrame, score: str = "object_score", key: str = "candidate_id", top: int | None = None) -> DataFrame:
    """Candidates with rank by score (down, missing as 0) and id (up); only the first `top` if given.

    With a limit, the sort keeps `top` rows for each task. Without one, rows
    are dealt to ranges of (score, id) and written; a row's rank is its place
    in its range after the counts of the ranges before. No task sees all rows,
    and equal scores are split by id.
    """
    s = number_or_zero(F.col(score))
    if top is not None:
        few = candidates.orderBy(s.desc(), F.col(key)).limit(max(0, top))
        return few.withColumn("rank", F.row_number().over(Window.orderBy(s.desc(), F.col(key))))
    # Written first: a sample is drawn to find the ranges, and ranks are found on (score, id) alone.
    rows = staged(candidates.withColumns({"__s": s, "__row": F.monotonically_increasing_id()}), "candidates")
    dealt = staged(rows.select("__row", "__s", key).repartitionByRange(F.desc("__s"), F.col(key)).withColumn("__range", F.spark_partition_id()), "ranges")
    before, sizes = 0, []
    for r in dealt.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():  # one row for each range
        sizes.append((r["__range"], before))
        before += r["n"]
    offsets = candidates.sparkSession.createDataFrame(sizes, "__at int, __before long")
    inside = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__range").orderBy(F.desc("__s"), F.col(key))))
    placed = inside.join(F.broadcast(offsets), F.col("__range") == F.col("__at")).select("__row", (F.col("__before") + F.col("__r")).cast("int").alias("rank"))
    return rows.join(placed, "__row").drop("__s", "__row")


def _json(column: Column) -> Column:
    return F.to_json(F.array_sort(F.coalesce(column, F.array().cast("array<string>"))))


def score_rows(objects: DataFrame, top: int | None = None, passports: int | None = None, folder: str = "passports") -> DataFrame:
    """The 55 columns of the score table, typed; lists as JSON. Columns that the objects lack are null."""
    from orrery.functions.scalars import file_stem
    from orrery.operators.scoring import evidence_maxima

    rows = ranked(objects, top=top)
    have = lambda name, kind="string": F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
    lists = lambda name: _json(F.col(name)) if name in rows.columns else F.lit("[]")
    text = lambda name: F.coalesce(have(name), F.lit(""))
    evidence = evidence_maxima(F.coalesce(F.col("per_feature_max"), F.create_map().cast("map<string,double>"))) if "per_feature_max" in rows.columns else None
    out = {
        "rank": F.col("rank"), "priority_class": text("priority_class"), "candidate_id": text("candidate_id"), "evidence_class": text("evidence_class"), "morphology_type": F.coalesce(have("morphology_type"), have("static_morphology_type"), F.lit("")),
        "diameter_m": F.coalesce(have("equivalent_diameter_m", "double"), have("diameter_m", "double")), "support_pixel_count": have("support_pixel_count", "int"),
        "persistence": have("repeated_seasons", "double"), "false_positive_profile": F.coalesce(have("false_positive_profile"), F.lit("{}")), "dominant_evidence": text("dominant_evidence"),
        "evidence": F.to_json(F.struct(text("evidence_class").alias("evidence_class"))),
        "flags": _json(F.array_union(*[F.coalesce(F.col(c), F.array().cast("array<string>")) if c in rows.columns else F.array().cast("array<string>") for c in ("dynamic_object_flags", "false_positive_flags")])),
        "passport_path": F.when(F.col("rank") <= (passports or 0), F.concat(F.lit(f"{folder}/"), file_stem(have("candidate_id")), F.lit(".md"))).otherwise(""),
    }
    for name in ("residual_types_present", "false_positive_flags", "missing_data_flags", "anomalous_dates", "source_feature_names", "source_layer_ids"):
        out[name] = lists(name)
    for name, component in EVIDENCE.items():
        out[name] = F.try_element_at(evidence, F.lit(component)) if evidence is not None else have(name, "double")
    for name in ("landcover_branch", "dominant_landcover_branch", "source_landcover_context", "source_morphology_type", "source_false_positive_risk", "source_notes", "field_id"):
        out.setdefault(name, text(name))
    return rows.select(*[out.get(name, finite(have(name, "double"))).alias(name) for name in SCORE_COLUMNS])


def labeling_rows(scores: DataFrame) -> DataFrame:
    """The labeling table: score columns with blank review fields."""
    kept = [c for c in ["candidate_id", *[c for c in SCORE_COLUMNS if c != "candidate_id"]] if c not in NOT_LABELED and c in scores.columns]
    return scores.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in kept], *[F.lit("").alias(c) for c in REVIEW_COLUMNS])


def feature_rows(scores: DataFrame) -> DataFrame:
    """The object feature table: numbers of the score table as text."""
    kept = [c for c in SCORE_COLUMNS if c in scores.columns and c not in ("passport_path", "source_notes", "evidence")]
    return scores.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in kept])


def short_number(value: Column) -> Column:
    """Six significant digits, as %.6g: no trailing zeros, exponents beyond the range."""
    digits = F.floor(F.log10(F.abs(value)))
    fixed = F.element_at(F.array(*[F.format_string(f"%.{d}f", value) for d in range(0, 11)]), (F.greatest(F.lit(0), F.least(F.lit(10), F.lit(5) - digits)) + 1).cast("int"))
    trimmed = F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    science = F.regexp_replace(F.format_string("%.5e", value), r"\.?0*e", "e")
    return F.when(value == 0, "0").when((digits < -4) | (digits >= 6), science).otherwise(trimmed)


def explanations(scores: DataFrame) -> DataFrame:
    """Why each candidate has its rank: evidence, pressure against it, distances, missing context, components and one sentence."""
    number = lambda c: finite(F.col(c)) if c in scores.columns else F.lit(None).cast("double")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in scores.columns else F.lit("")
    listed = lambda c: F.from_json(F.when(text(c) == "", "[]").otherwise(text(c)), "array<string>")
    said = lambda parts: F.concat_ws("; ", F.filter(F.array(*parts), lambda x: x.isNotNull()))
    positive = said([F.when(text("dominant_evidence") != "", text("dominant_evidence")), *[F.when(number(c) > 0, F.concat(F.lit(f"{c}="), short_number(number(c)))) for c in SUPPORTS]])
    distances = said([F.when(number(c).isNotNull(), F.concat(F.lit(f"{c}="), short_number(number(c)))) for c in DISTANCES])
    out = scores.withColumns({"positive_evidence": positive, "false_positive_distances": distances})
    flags = listed("false_positive_flags")
    against = said(
        [
            F.when(number("false_positive_penalty") > 0, F.concat(F.lit("false_positive_penalty="), short_number(number("false_positive_penalty")))),
            F.when(F.size(flags) > 0, F.concat(F.lit("flags="), F.concat_ws("|", flags))),
            F.when(~text("false_positive_profile").isin("", "{}"), F.concat(F.lit("profile="), text("false_positive_profile"))),
            F.when(F.col("false_positive_distances") != "", F.concat(F.lit("distances="), F.col("false_positive_distances"))),
        ]
    )
    lacking = F.concat_ws("|", F.filter(listed("missing_data_flags"), lambda f: f.startswith("missing_") | f.startswith("below_")))
    out = out.withColumns({"false_positive_evidence": against, "missing_context": lacking})
    sentence = F.concat_ws(
        " ",
        F.concat(F.lit("Rank "), text("rank"), F.lit(" scored "), text("object_score"), F.lit(" as priority "), text("priority_class"), F.lit(".")),
        F.when(F.col("positive_evidence") != "", F.concat(F.lit("Main supporting evidence: "), "positive_evidence", F.lit("."))),
        F.when(F.col("false_positive_evidence") != "", F.concat(F.lit("False-positive pressure: "), "false_positive_evidence", F.lit("."))),
        F.when(F.col("false_positive_distances") != "", F.concat(F.lit("False-positive distances: "), "false_positive_distances", F.lit("."))),
        F.when(F.col("missing_context") != "", F.concat(F.lit("Missing or limited context: "), "missing_context", F.lit("."))),
        F.lit(GUARDRAIL),
    )
    components = F.to_json(F.struct(*[F.when(text(c) != "", text(c)).alias(c) for c in sorted(COMPONENTS)]))
    kept = ["rank", "candidate_id", "priority_class", "object_score", "dominant_evidence"]
    return out.withColumns({"explanation": sentence, "score_components": components}).select(
        *[text(c).alias(c) for c in kept], "positive_evidence", "false_positive_evidence", "false_positive_distances", "missing_context", "score_components", "explanation"
    )


def time_series(objects: DataFrame, top: int | None = None) -> DataFrame:
    """One row for each anomalous date of each (top) candidate."""
    rows = ranked(objects, top=top)
    return rows.select("candidate_id", F.explode("anomalous_dates").alias("date"), "object_score", "dynamic_score")


def last_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one id the last by order; blank ids go."""
    place = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def learning_rows(scores: DataFrame, labels: DataFrame, key: str = "candidate_id", order: str = "ordinal") -> DataFrame:
    """Scores with model_label, label_source, pu_role, split_group, leakage_notes and use_for_training.

    Blank labels are unlabeled, never negative; unknown ones raise, as do hard
    negatives without a reason.
    """
    last = last_rows(labels, key, order)
    have = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in last.columns else F.lit("")
    marked = last.select(F.col(key).alias("__k"), learning_label(have("expert_label")).alias("__label"), have("false_positive_reason").alias("false_positive_reason"), have("reviewer_id").alias("reviewer_id"), have("label_source").alias("__source"), have("expert_confidence").alias("label_confidence"))
    scores = scores.drop("false_positive_reason", "reviewer_id", "label_confidence", "expert_label", "expert_confidence", "reviewer_notes")
    out = scores.join(marked, scores[key] == F.col("__k"), "left").drop("__k")
    raw = F.coalesce("__label", F.lit(""))
    known = F.when(raw == "", "unlabeled").when(raw.isin(*LABELS), raw).otherwise(F.raise_error(F.concat(F.lit("unknown label "), raw)).cast("string"))
    reason = F.coalesce("false_positive_reason", F.lit(""))
    label = F.when((raw == "hard_negative") & (F.trim(reason) == ""), F.raise_error(F.concat(F.lit("hard_negative candidate "), F.col(key).cast("string"), F.lit(" requires false_positive_reason"))).cast("string")).otherwise(known)
    role = F.col("model_label")
    field = F.coalesce(F.col("field_id").cast("string"), F.lit("")) if "field_id" in scores.columns else F.lit("")
    return out.withColumn("model_label", label).withColumns(
        {
            "pu_role": F.element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), role),
            "use_for_training": F.when(role == "uncertain", "no").otherwise("yes"),
            "split_group": F.when(field != "", F.concat(F.lit("field:"), field)).otherwise(F.concat(F.lit("object:"), F.col(key).cast("string"))),
            "leakage_notes": F.when(field != "", "grouped by field_id").otherwise("grouped by candidate_id"),
            "label_source": F.when(F.coalesce("__source", F.lit("")) != "", F.col("__source")).when(raw != "", "expert").otherwise("detector_export"),
        }
    ).drop("__label", "__source")


def flag_histogram(rows: DataFrame, flags: str) -> DataFrame:
    return rows.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def agreement(rows: DataFrame, features: str) -> DataFrame:
    n = F.size(F.array_distinct(F.coalesce(features, F.array().cast("array<string>"))))
    return rows.agg(
        F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_source_feature_count"), F.coalesce(F.max(n), F.lit(0)).alias("max_source_feature_count"),
        F.count_if(n >= 2).alias("candidates_with_2plus"), F.coalesce(F.try_divide(F.count_if(n >= 2), F.count("*")), F.lit(0.0)).alias("share_with_2plus"),
    )


def persistence(rows: DataFrame, value: str) -> DataFrame:
    v = finite(F.expr(f"try_cast(`{value}` as double)"))
    return rows.agg(F.coalesce(F.avg(v), F.lit(0.0)).alias("mean_repeated_seasons"), F.coalesce(F.max(v), F.lit(0.0)).alias("max_repeated_seasons"), F.count_if(v >= 2).alias("persistent_candidates"))


def missing_data(rows: DataFrame, flags: str) -> DataFrame:
    return rows.agg(F.count_if(F.size(F.coalesce(flags, F.array().cast("array<string>"))) > 0).alias("affected_candidates"))


def recall_at(matches: DataFrame, sites: DataFrame, site: str, rank: str, ns: Sequence[int]) -> DataFrame:
    """(n, recall): share of sites matched by a candidate of rank n or better. matches has site and rank."""
    wanted = sorted({int(n) for n in ns if int(n) > 0})
    best = matches.groupBy(site).agg(F.min(rank).alias("__best"))
    rows = sites.select(site).join(best, site, "left")
    counts = rows.agg(*[F.avg(F.coalesce((F.col("__best") <= n).cast("double"), F.lit(0.0))).alias(f"top_{n}") for n in wanted])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"top_{n}").alias("recall")) for n in wanted])).alias("r")).select("r.*")


def site_labels(sites: DataFrame, labels: Sequence[str] = ("expert_label", "status", "label")) -> DataFrame:
    """(label, n) of known sites by the first of the label columns that there is; without one all sites are assumed positive."""
    name = next((c for c in labels if c in sites.columns), None)
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))), "[ -]", "_") if name else F.lit("positive_assumed_unlabeled_known_sites")
    return sites.select(F.when(text == "", "unknown").otherwise(text).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def site_confidences(sites: DataFrame, names: Sequence[str] = ("expert_confidence", "confidence", "review_confidence")) -> DataFrame:
    """(confidence, n) of known sites by the first of the columns that there is; without one no rows."""
    name = next((c for c in names if c in sites.columns), None)
    text = F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name else F.lit("")
    rows = sites.select(F.when(text == "", "unknown").otherwise(text).alias("confidence"))
    return (rows if name else rows.where("false")).groupBy("confidence").agg(F.count("*").alias("n"))


def precision_at(scores: DataFrame, labels: DataFrame, top: int, key: str = "candidate_id", order: str = "ordinal", label: str = "expert_label") -> DataFrame:
    """Precision among the reviewed candidates of the top; unlabeled ones don't count."""
    place = F.coalesce(F.expr("try_cast(rank as int)"), F.lit(1_000_000))
    few = scores.orderBy(place, F.col(key)).limit(top).select(key)
    last = last_rows(labels, key, order).select(F.col(key).alias("__k"), review_label(F.col(label)).alias("__l"))
    got = few.join(last, F.col(key) == F.col("__k"), "left").agg(F.count_if(F.col("__l").isin(*POSITIVE)).alias("positive_count"), F.count_if(F.col("__l").isin(*NEGATIVE)).alias("negative_count"))
    return got.select(F.lit(top).alias("top_n"), F.try_divide(F.col("positive_count"), F.col("positive_count") + F.col("negative_count")).alias("precision"), "positive_count", "negative_count")
