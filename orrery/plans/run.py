"""The whole chain: prepared stack, context layers and weather in; ranked, explained candidates out."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import polygons
from orrery.functions.scalars import flag_union
from orrery.operators import composite as comp
from orrery.operators import review, robust, scoring, segment, shapes, spatial, zonal
from orrery.plans import features as feat
from orrery.plans import reports
from orrery.sources import pixels as px
from orrery.sources import vectors as vec
from orrery.sources.config import RunConfig, resolved
from orrery.sources.manifest import Manifest, layers_frame, load_weather
from orrery.staging import staged

CONTEXTS = ("roads", "water", "built_up", "excluded_zones", "quarries", "woody_patches", "cloud_shadows", "harvest_patterns", "irrigation")


@dataclass
class Run:
    """What a run computed, before anything is written."""

    objects: DataFrame
    cells: DataFrame
    composite: DataFrame
    residuals: DataFrame
    grid: dict
    flags: list[str]
    residual_flags: list[str]
    weights: dict[str, float]
    features: list[feat.Feature]
    known_sites: DataFrame | None


def read_vectors(spark: SparkSession, manifest: Manifest, reproject: bool = False) -> dict[str, DataFrame | None]:
    """The manifest's vector layers; optional ones that are absent or empty are None."""
    out: dict[str, DataFrame | None] = {}
    for name, spec in manifest.vectors.items():
        here = "://" in spec.path or Path(spec.path).exists()
        if not here:
            if spec.required:
                raise vec.VectorError(f"{name}: {spec.path} is missing")
            out[name] = None
            continue
        try:
            out[name] = vec.load_vectors(spark, spec.path, name, spec.id_field, manifest.crs, reproject=reproject)
        except vec.VectorError as e:
            if spec.required or "contains no features" not in str(e):
                raise
            out[name] = None
    return out


def _wanted(config: RunConfig) -> tuple[bool, bool]:
    """Whether post-rain drying and SAR event responses are configured."""
    f, parts = config.features, config.anomaly_components
    rain = "post_rain_drying" in parts or (config.scoring.cropland.post_rain_weight or 0) > 0 or bool(f and f.weather and f.weather.features)
    sar = any("event_response" in i for i in (parts["sar"].inputs if "sar" in parts else [])) or bool(f and any("event_response" in n for n in f.sentinel1.features))
    return rain, sar


def choose_features(config: RunConfig, manifest: Manifest, shape_of: dict[str, tuple[int, int]], shape: tuple[int, int], rain) -> tuple[list[feat.Feature], list[feat.Feature], list[str]]:
    """(base features, event features, flags): on the reference grid and in season."""
    flags: list[str] = []

    def kept(found: list[feat.Feature], grid=lambda f: True) -> list[feat.Feature]:
        out = []
        for f in found:
            if not grid(f):
                flags.append(f"skipped_grid_mismatch_{f.name}_{f.date or 'undated'}")
            elif not feat.in_season(f, config.time.vegetation_months, config.time.bare_soil_months):
                flags.append(f"skipped_out_of_window_{f.name}_{f.date or 'undated'}")
            else:
                out.append(f)
        return out

    base: list[feat.Feature] = []
    for made in (feat.optical(manifest.layers), feat.sar(manifest.layers, shape_of), feat.thermal(manifest.layers)):
        base += kept(made[0], lambda f: shape_of.get(f.left) == shape)
        flags += made[1]
    events: list[feat.Feature] = []
    for wanted, make in zip(_wanted(config), (feat.post_rain, feat.sar_response), strict=True):
        if wanted:
            found, lacking = make(base, rain)
            events += kept(found)
            flags += lacking
    everything = base + events
    if (_wanted(config)[1] or "sar" in config.anomaly_components) and any(f.sensor == "sentinel1" for f in everything) and not any(f.name in ("NDVI", "red_edge", "NDRE") for f in everything):
        flags.append("missing_crop_density_context_for_sar")
    if _wanted(config)[0] and manifest.weather_path is None:
        flags.append("missing_weather_context")
    return base, events, flags


def zones(fields: DataFrame, grid: dict) -> DataFrame:
    """(row, col, zone): field numbers from 1 on the reference grid, rows from the top; touched cells count, later fields win."""
    cell, height, width = grid["a"], grid["height"], grid["width"]
    bottom = grid["f"] - cell * height
    inside = fields.where((F.col("maxx") > grid["c"]) & (F.col("minx") < grid["c"] + cell * width) & (F.col("maxy") > bottom) & (F.col("miny") < grid["f"]))
    got = spatial.rasterize(inside.withColumn("number", F.col("ordinal") + 1), "number", "number", cell, grid["c"], bottom)
    got = got.where((F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width))
    return got.select((F.lit(height - 1) - F.col("row")).cast("int").alias("row"), F.col("col").cast("int").alias("col"), "zone")


def _component(config: RunConfig, name: str) -> str | None:
    for component, c in config.anomaly_components.items():
        if name in c.inputs or component == "post_rain_drying" and name.startswith("post_rain_drying") or component == "sar" and name.startswith("sar_event_response"):
            return component
    return None


def _in_composite(config: RunConfig, component: str, name: str) -> bool:
    """A component's own map takes its literal inputs, and event features if the family is listed."""
    inputs = config.anomaly_components[component].inputs
    return name in inputs or any(name.startswith(p) and p in inputs for p in ("post_rain_drying", "sar_event_response"))


def objects_of(cells: DataFrame, grid: dict, limits: dict[str, float]) -> DataFrame:
    """Cells (zone, object, row, col, evidence) -> one row for each object: key, metrics, geometry (JSON), bounds, flags."""
    cell, x0, y0 = grid["a"], grid["c"], grid["f"]
    keyed = cells.withColumn("key", F.concat_ws(":", F.col("zone").cast("string"), F.col("object").cast("string")))
    sides = shapes.cell_metrics(keyed, "key", cell)

    @F.pandas_udf("string")
    def traced(lists: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(polygons.outline([(c["row"], c["col"]) for c in cs], cell, x0, y0)) for cs in lists])

    drawn = keyed.groupBy("key").agg(F.first("zone").alias("zone"), F.first("object").alias("object"), F.first("annulus_contrast").alias("annulus_contrast"), F.first("ringness_score").alias("ringness_score"), F.sort_array(F.collect_list(F.struct("row", "col"))).alias("cells"))
    out = sides.join(drawn.withColumn("geometry", traced("cells")).drop("cells"), "key")
    out = out.withColumns(
        {
            "minx": F.get_json_object("geometry", "$.none").cast("double"), "pixel_area_m2": F.lit(cell * cell),
            "dynamic_object_flags": shapes.object_flags(limits),
        }
    ).drop("minx")
    return spatial.with_bounds(out.withColumn("passes_dynamic_filters", F.size("dynamic_object_flags") == 0)).drop("area")


def run(spark: SparkSession, config: RunConfig, manifest: Manifest) -> Run:
    if config.dynamic_detector is not None and config.dynamic_detector.connected_components is False:
        raise ValueError("dynamic_detector.connected_components=false is not supported")
    layers = layers_frame(spark, manifest)
    raster, grids = px.read_layers(spark, layers)
    aoi = vec.with_bounds(vec.read_features(spark, manifest.aoi_path)[0]).agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
    grids = staged(grids, "grids")
    px.check_stack(layers, grids, manifest.crs, tuple(aoi))
    grid_of = {r["layer_id"]: r.asDict() for r in grids.collect()}  # one record for each layer
    reference = next((s for s in manifest.layers if abs(s.resolution_m - manifest.resolution_m) < 1e-9), manifest.layers[0])
    grid = grid_of[reference.layer_id]
    shape_of = {i: (g["height"], g["width"]) for i, g in grid_of.items()}
    vectors = read_vectors(spark, manifest, bool(config.prepared_data and config.prepared_data.allow_reprojection))
    fields = vectors.get("fields")
    if fields is None:
        raise vec.VectorError("the fields layer is missing")
    zone_cells = staged(zones(fields, grid), "zones")
    if zone_cells.limit(1).count() == 0:
        raise vec.VectorError("fields do not overlap the raster grid")
    rain = None
    if manifest.weather_path is not None:
        rain = [tuple(r) for r in load_weather(spark, manifest.weather_path).collect()]
    base, events, flags = choose_features(config, manifest, shape_of, (grid["height"], grid["width"]), rain)
    if "geology_context" in config.anomaly_components and vectors.get("geology") is None:
        flags.append("missing_geology_context")

    pixels = staged(raster, "pixels")
    values = feat.feature_pixels(spark, base, pixels, "layer_id")
    if events:
        base_values = staged(values, "features")
        values = base_values.unionByName(feat.feature_pixels(spark, events, base_values, "feature"))
    used = [f for f in base + events if _component(config, f.name)]
    flags += [f"missing_anomaly_component_for_{f.name}" for f in base + events if not _component(config, f.name)]
    if not used:
        raise ValueError("no feature belongs to a component")
    about = spark.createDataFrame([(f.key, f.name, f.date, f.direction, list(f.sources), _component(config, f.name), _in_composite(config, _component(config, f.name), f.name)) for f in used], "feature string, name string, obs_date string, direction string, sources array<string>, component string, in_composite boolean")
    rows = values.join(F.broadcast(about), "feature").join(zone_cells, ["row", "col"], "left")
    rows = staged(rows.where(F.col("zone").isNotNull() | F.col("value").isNotNull()), "values")
    norm = config.normalization
    epsilon = norm.mad_epsilon if norm and norm.mad_epsilon else robust.EPSILON
    least = norm.min_valid_pixels_per_field_date if norm and norm.min_valid_pixels_per_field_date else 1
    in_field = rows.where(F.col("zone").isNotNull())
    stats = staged(robust.group_statistics(in_field, ["feature", "zone"], "value", epsilon, least), "statistics")
    flags += sorted({r["flag"] for r in robust.zone_flags(stats, "zone").select("flag").distinct().collect()})
    by_field = robust._joined(in_field, stats.select("feature", "zone", "median", "scale"), ["feature", "zone"])
    from orrery.functions.scalars import oriented

    kept = ["feature", "name", "obs_date", "sources", "component", "in_composite", "zone", "row", "col"]
    field = by_field.withColumn("z", oriented((F.col("value") - F.col("median")) / F.col("scale"), F.col("direction"))).select(*kept, "z", F.lit("field").alias("residual_type"))
    residual_flags: list[str] = []
    parts = [field]
    context = _strata(fields)
    if context is None:
        residual_flags.append("missing_peer_residual_context")
    else:
        peers = robust.peer_residual(in_field, context, "zone", "stratum", "value", ["feature"], F.col("direction"), epsilon, least)
        parts.append(peers.select(*kept, "z", F.lit("peer").alias("residual_type")))
    again = {f.name for f in used if len({g.date for g in used if g.name == f.name and g.date}) >= 2}
    residual_flags += [f"missing_temporal_residual_{n}" for n in sorted({f.name for f in used if f.date} - again)]
    if again:
        temporal = robust.temporal_residual(rows.where(F.col("name").isin(*again)), ["name"], ["row", "col"], "obs_date", "value", F.col("direction"), epsilon)
        parts.append(temporal.select(*kept, "z", F.lit("temporal").alias("residual_type")))
    else:
        residual_flags.append("missing_temporal_residual_context")
    residuals = parts[0]
    for p in parts[1:]:
        residuals = residuals.unionByName(p)
    residuals = staged(residuals.where("z is not null"), "residuals")

    weights = {c: v.weight for c, v in config.anomaly_components.items()}
    supported = residuals.where("residual_type = 'field' and in_composite")
    flags += [r["flag"] for r in comp.composite_flags(supported, weights).collect()]
    composite = comp.composite_map(supported, weights, ["row", "col"]).join(zone_cells, ["row", "col"])
    composite = staged(composite.select("zone", "row", "col", F.col("composite").alias("value")), "composite")
    d, limits = config.dynamic_detector, config.object_constraints
    anomaly, support, pixels_least = (d.anomaly_percentile, d.support_percentile, d.min_support_pixels) if d else (95.0, None, 1)
    cells = staged(segment.multiscale_objects(composite.where("value is not null"), "zone", anomaly, support, pixels_least), "cells")
    bounds = {"min_area_m2": limits.min_area_ha * 1e4, "max_area_m2": limits.max_area_ha * 1e4, "min_diameter_m": limits.min_diameter_m, "max_diameter_m": limits.max_diameter_m, "min_support_pixels": pixels_least}
    objects = objects_of(cells, grid, bounds)
    layered = residuals.withColumn("layer", F.concat_ws("|", "feature", "residual_type"))
    keyed = cells.withColumn("key", F.concat_ws(":", F.col("zone").cast("string"), F.col("object").cast("string")))
    statistics = zonal.zonal_statistics(keyed, layered.select("row", "col", "layer", "residual_type", F.col("name").alias("feature"), "obs_date", "z"), ["key"])
    lineage = keyed.select("key", "row", "col").join(residuals.select("row", "col", "sources"), ["row", "col"]).groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("source_layer_ids"))
    objects = objects.join(statistics.drop("source_layer_ids"), "key", "left").join(lineage, "key", "left")
    size = max(250.0, 64 * grid["a"])
    context_fields = fields.select(F.col("stable_id").alias("field_id"), "ordinal", "geometry", *spatial.BOX)
    objects = staged(spatial.field_context(objects.drop("field_id"), context_fields, "key", "field_id", "ordinal", size, limits.min_distance_to_field_edge_m), "objects")
    objects = objects.withColumn("crs", F.lit(manifest.crs))
    objects = shapes.stable_ids(objects, "field_id", "cx", "cy", "geometry", "key").withColumn("object_id", F.col("candidate_id"))
    filters = config.false_positive_filters
    layers_at = {n: vectors.get(n) for n in CONTEXTS}
    layers_at = {n: (v.select("geometry", *spatial.BOX) if v is not None else None) for n, v in layers_at.items()}
    objects = spatial.risk_filters(objects, layers_at, "key", size, filters.buffers() if filters else None, config.penalties(), filters.disabled() if filters else ())
    cover = vectors.get("landcover")
    if cover is not None:
        cover = cover.withColumn("landcover_class", F.get_json_object("properties", "$.landcover_class")).select("landcover_class", "geometry", *spatial.BOX)
        objects = spatial.landcover_context(objects.withColumn("area", F.col("area_m2")), cover, "key", "landcover_class", config.land_cover.classes, size, config.land_cover.mixed_candidate_min_classes).drop("area")
    else:
        objects = spatial.assumed_landcover(objects, config.land_cover.primary_branch)
    run_flags = sorted(set(flags) | set(residual_flags))
    few = F.when(F.col("source_detection_count") < (d.min_valid_observations_per_season if d else 0), F.array(F.lit("below_min_valid_observations_per_season")))
    objects = objects.withColumn("missing_data_flags", flag_union(F.col("missing_data_flags"), F.col("landcover_context_flags"), F.array(*[F.lit(x) for x in run_flags]).cast("array<string>"), few))
    t = config.scoring.priority_thresholds
    objects = scoring.score_objects(objects, config.scoring.cropland.by_component(), {"A": t.A, "B": t.B, "C": t.C} if t else None, d.min_repeated_seasons if d else 2)
    return Run(staged(objects, "scored"), cells, composite, residuals, grid, run_flags, sorted(set(residual_flags)), weights, used, vectors.get("known_sites"))


def _strata(fields: DataFrame) -> DataFrame | None:
    """(zone, stratum) from whichever context properties the fields have."""
    names = [c for c in ("crop_type", "phenology_stage", "weather_stratum") if fields.where(F.get_json_object("properties", f"$.{c}").isNotNull()).limit(1).count()]
    if not names:
        return None
    return fields.select((F.col("ordinal") + 1).alias("zone"), robust.stratum_label(*[F.get_json_object("properties", f"$.{c}") for c in names]).alias("stratum"))


def validation_summary(result: Run, scores: DataFrame, config: RunConfig, labels: DataFrame | None = None) -> dict:
    """Small aggregates of the ranked candidates; what can't be known is null with a flag.

    labels has candidate_id, ordinal and expert_label of reviewed candidates.
    """
    v = config.validation
    top, recalls = (v.top_n, v.known_site_recall_top_n or [v.top_n]) if v else (20, [20])
    objects, flags = result.objects, set()
    recall: dict = {f"top_{n}": None for n in recalls}
    site_counts, confidences = {}, {}
    if result.known_sites is None:
        flags.add("missing_known_sites")
    else:
        ranked = review.ranked(objects.select("candidate_id", "object_score", "geometry", *spatial.BOX))
        sites = result.known_sites.select(F.col("ordinal").alias("site_id"), "geometry", *spatial.BOX, *[F.get_json_object("properties", f"$.{c}").alias(c) for c in ("expert_label", "status", "label")])
        label = F.coalesce("expert_label", "status", "label")
        given = _with_properties(result.known_sites, ("expert_label", "status", "label", "expert_confidence", "confidence", "review_confidence"))
        site_counts = {r["label"]: r["n"] for r in review.site_labels(given).orderBy("label").collect()}
        confidences = {r["confidence"]: r["n"] for r in review.site_confidences(given).orderBy("confidence").collect()}
        if sites.where(label.isNotNull()).limit(1).count():
            from orrery.functions.scalars import review_label

            sites = sites.where(review_label(label).isin(*review.POSITIVE))
        if sites.limit(1).count() == 0:
            flags.add("missing_positive_known_sites")
        else:
            met = spatial.measured_pairs(ranked, sites.select("site_id", "geometry", *spatial.BOX), 250.0).where("distance = 0").select(F.col("r_site_id").alias("site_id"), F.col("l_rank").alias("rank"))
            recall = {f"top_{r['n']}": r["recall"] for r in review.recall_at(met, sites, "site_id", "rank", recalls).collect()}
    reviewed_top = v.expert_precision_top_n if v and v.expert_precision_top_n else top
    precision = {"top_n": reviewed_top, "precision": None, "positive_count": 0, "negative_count": 0}
    if labels is not None:
        precision = review.precision_at(scores, labels, reviewed_top).first().asDict()
    precision["reviewed_count"] = precision["positive_count"] + precision["negative_count"]
    if not precision["reviewed_count"]:
        flags.add("missing_expert_labels")
    elif precision["reviewed_count"] < scores.limit(reviewed_top).count():
        flags.add("partial_expert_labels")
    counted = lambda c: {r["flag"]: r["n"] for r in review.flag_histogram(objects, c).orderBy("flag").collect()}
    missing = review.missing_data(objects, "missing_data_flags").first()["affected_candidates"]
    if missing:
        flags.add("candidate_missing_data_flags_present")
    return {
        "schema_version": "validation_summary.v1", "guardrail": reports.GUARD, "candidate_count": objects.count(), "top_n": top, "known_site_recall_at_n": recall,
        "known_site_label_counts": site_counts, "known_site_confidence_counts": confidences, "expert_precision_top_n": precision,
        "false_positive_counts": counted("false_positive_flags"), "multi_sensor_agreement": review.agreement(objects, "source_feature_names").first().asDict(),
        "persistence": review.persistence(scores, "persistence").first().asDict(), "missing_data": {"affected_candidate_count": missing, "flag_counts": counted("missing_data_flags")},
        "missing_data_flags": sorted(flags), "unlabeled_background_treated_as_negative": False,
    }


def _with_properties(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with a column for each of the properties that any of them has."""
    values = {n: F.get_json_object("properties", f"$.{n}") for n in names}
    there = rows.agg(*[F.count(v).alias(n) for n, v in values.items()]).first()
    return rows.select(*[v.alias(n) for n, v in values.items() if there[n]], F.lit(1).alias("__one"))


def _swept(folder: Path, pattern: str) -> Path:
    folder.mkdir(parents=True, exist_ok=True)
    for old in folder.glob(pattern):
        old.unlink()
    return folder


def write_artifacts(result: Run, config: RunConfig, manifest: Manifest, out: str | Path, labels: DataFrame | None = None) -> dict[str, Path]:
    """All files of a run; what is switched off is removed if an earlier run left it. Only review files stop at the top N.

    labels are reviews of an earlier look at the candidates, if there are any.
    """
    out = Path(out)
    out.mkdir(parents=True, exist_ok=True)
    o, limit = config.outputs, max(0, config.outputs.candidates_top_n)
    scores = staged(review.score_rows(result.objects, passports=limit if o.generate_passports else 0, folder=str(out / "passports")), "scores")
    top = scores.where(F.col("rank") <= limit)
    paths = {n: out / n for n in ("candidates.geojson", "candidate_scores.csv", "object_feature_table.csv", "rank_explanations.csv", "validation_summary.json", "resolved_config.json")}
    for name, on in (("candidates.geojson", o.export_geojson), ("candidate_scores.csv", o.export_csv), ("object_feature_table.csv", o.export_csv), ("rank_explanations.csv", o.export_csv), ("validation_summary.json", o.export_validation_summary is not False), ("resolved_config.json", o.export_resolved_config)):
        if not on:
            paths[name].unlink(missing_ok=True)
    if o.export_geojson:
        reports.write_geojson(scores.join(result.objects.select("candidate_id", "geometry"), "candidate_id"), paths["candidates.geojson"], manifest.crs, "rank")
    if o.export_csv:
        reports.write_csv(scores, paths["candidate_scores.csv"], "rank")
        reports.write_csv(review.feature_rows(scores), paths["object_feature_table.csv"])
        reports.write_csv(review.explanations(scores), paths["rank_explanations.csv"])
    paths["labeling_table.csv"] = reports.write_csv(review.labeling_rows(top), out / "labeling_table.csv")
    none = result.objects.sparkSession.createDataFrame([], "candidate_id string, ordinal int, expert_label string, false_positive_reason string")
    learning = review.learning_rows(scores, none).withColumns({"run_id": F.lit(manifest.run_id), "feature_snapshot_id": F.lit(manifest.snapshot_id()), "aoi_name": F.lit(config.aoi.name), "geometry_ref": F.lit(str(paths["candidates.geojson"]) if o.export_geojson else "")})
    paths["learning_dataset.csv"] = reports.write_csv(learning, out / "learning_dataset.csv")
    dump = lambda name, data: (out / name).write_text(json.dumps(data, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    if o.export_validation_summary is not False:
        dump("validation_summary.json", validation_summary(result, scores, config, labels))
    if o.export_resolved_config:
        dump("resolved_config.json", resolved(config))
    folder = _swept(out / "passports", "*.md")
    if o.generate_passports:
        for r in top.orderBy("rank").collect():  # the review limit bounds them
            (folder / Path(r["passport_path"]).name).write_text(reports.passport(r.asDict()), encoding="utf-8")
    folder = _swept(out / "time_series", "*.csv")
    if o.export_time_series is not False:
        by_id: dict[str, list[str]] = {}
        for r in review.time_series(result.objects, limit).collect():  # of the top N
            by_id.setdefault(r["candidate_id"], []).append(f"{r['candidate_id']},{r['date']},{r['object_score']},{r['dynamic_score']}")
        for i, lines in sorted(by_id.items()):
            (folder / f"{reports.safe_stems([i])[0]}.csv").write_text("\n".join(["candidate_id,date,object_score,dynamic_score", *lines]) + "\n", encoding="utf-8")
    folder = _swept(out / "quicklooks", "*.png")
    if o.generate_quicklooks is True:
        _quicklooks(result, top, folder)
    maps = out / "anomaly_maps"
    result.composite.write.mode("overwrite").parquet(str(maps / "composite_anomaly.parquet"))
    result.residuals.write.mode("overwrite").partitionBy("residual_type").parquet(str(maps / "hierarchical_residuals.parquet"))
    total = sum(w for w in result.weights.values() if w > 0)
    dump("anomaly_maps/composite_anomaly.json", {"component_weights": {c: w / total for c, w in result.weights.items() if w > 0} if total else {}, "missing_data_flags": result.flags, "source_feature_names": sorted({f.name for f in result.features}), "source_layer_ids": sorted({s for f in result.features for s in f.sources})})
    present = result.residuals.select("feature", "residual_type").distinct().orderBy("residual_type", "feature").collect()
    by = {f.key: f for f in result.features}
    dump("anomaly_maps/hierarchical_residuals.json", {"schema_version": "hierarchical_residuals.v1", "missing_data_flags": result.residual_flags, "layers": [{"name": f"{by[r['feature']].name}_{r['residual_type']}", "residual_type": r["residual_type"], "date": by[r["feature"]].date, "source_layer_ids": list(by[r["feature"]].sources)} for r in present]})
    dump("run_manifest.json", {"run_id": manifest.run_id, "crs": manifest.crs, "resolution_m": manifest.resolution_m, "grid": {k: v for k, v in result.grid.items() if k != "layer_id"}, "layers": [{"id": s.layer_id, "sensor": s.sensor, "feature_name": s.feature_name, "date": s.obs_date, "path": s.path, "quality_mask_path": s.quality_mask_path, "nodata": s.nodata, "role": s.role} for s in manifest.layers]})
    return paths


def _quicklooks(result: Run, top: DataFrame, folder: Path, padding: int = 5) -> None:
    """One picture for each top candidate: the windows of all of them are read in one pass over the composite."""
    keyed = result.cells.withColumn("key", F.concat_ws(":", F.col("zone").cast("string"), F.col("object").cast("string")))
    own = keyed.join(result.objects.select("key", "candidate_id"), "key").join(top.select("candidate_id"), "candidate_id")
    cells = {r["candidate_id"]: np.array([(c["row"], c["col"]) for c in r["cells"]]) for r in own.groupBy("candidate_id").agg(F.collect_list(F.struct("row", "col")).alias("cells")).collect()}
    if not cells:
        return
    bounds = {i: (np.maximum(c.min(axis=0) - padding, 0), c.max(axis=0) + padding) for i, c in cells.items()}
    boxes = result.composite.sparkSession.createDataFrame([(i, *map(int, (*lo, *hi))) for i, (lo, hi) in bounds.items()], "candidate_id string, r0 int, c0 int, r1 int, c1 int")
    near = F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
    seen = result.composite.join(F.broadcast(boxes), near).select("candidate_id", "row", "col", "value", "zone")  # the review limit bounds the boxes
    windows = {i: (np.full(hi - lo + 1, np.nan), np.zeros(hi - lo + 1, dtype=int)) for i, (lo, hi) in bounds.items()}
    numbers: dict = {}
    for p in seen.collect():
        at = p["row"] - bounds[p["candidate_id"]][0][0], p["col"] - bounds[p["candidate_id"]][0][1]
        values, fields = windows[p["candidate_id"]]
        values[at] = np.nan if p["value"] is None else p["value"]
        fields[at] = numbers.setdefault(p["zone"], len(numbers) + 1)
    for i, (values, fields) in windows.items():
        (folder / f"{reports.safe_stems([i])[0]}.png").write_bytes(reports.quicklook(values, cells[i] - bounds[i][0], padding, zones=fields))


def static_candidates(spark: SparkSession, path: str, config: RunConfig, out: str | Path) -> dict[str, Path]:
    """Candidates from drawn polygons alone: GeoJSON in input order, ranked scores, passports, labeling table."""
    out = Path(out)
    c = config.object_constraints
    limits = {"min_diameter_m": c.min_diameter_m, "max_diameter_m": c.max_diameter_m, "min_area": c.min_area_ha * 1e4, "max_area": c.max_area_ha * 1e4, "ellipse_circularity": config.static_ring_detector.circularity_min}
    rows = shapes.static_candidates(shapes.polygon_metrics(vec.load_candidates(spark, path)), limits)
    given = {"source_landcover_context": "landcover_context", "source_morphology_type": "morphology_type", "source_false_positive_risk": "false_positive_risk", "source_notes": "notes"}
    rows = rows.withColumns({n: F.coalesce(F.get_json_object("properties", f"$.{p}"), F.lit("")) for n, p in given.items()})
    rows = rows.withColumns(
        {
            "object_score": F.col("static_score"), "priority_class": scoring.priority_class(F.col("static_score")), "dominant_evidence": F.concat(F.lit("static "), "morphology_type", F.lit(" morphology")),
            "false_positive_flags": F.filter("flags", lambda f: f.endswith("_risk")), "dynamic_object_flags": F.col("flags"),
        }
    )
    rows = staged(rows, "static")
    scores = staged(review.score_rows(rows, passports=1 << 30, folder=str(out / "passports")), "scores")
    paths = {"candidates.geojson": reports.write_geojson(scores.join(rows.select("candidate_id", "geometry", "ordinal"), "candidate_id"), out / "candidates.geojson", None, "ordinal"), "candidate_scores.csv": reports.write_csv(scores, out / "candidate_scores.csv", "rank"), "labeling_table.csv": reports.write_csv(review.labeling_rows(scores), out / "labeling_table.csv")}
    folder = _swept(out / "passports", "*.md")
    ranked = scores.orderBy("rank")
    stems: dict[str, int] = {}
    for r in ranked.toLocalIterator():
        stem = reports.safe_stems([r["candidate_id"]])[0]
        stems[stem] = stems.get(stem, 0) + 1
        (folder / f"{stem}{'' if stems[stem] == 1 else f'-{stems[stem]}'}.md").write_text(reports.passport(r.asDict()), encoding="utf-8")
    return paths
