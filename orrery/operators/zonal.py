"""Statistics of objects over anomaly layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority(label: str) -> Column:
    """The most frequent label of a group, the smallest text of equal ones (to aggregate)."""
    return F.mode(F.col(label).cast("string"), True)


def _kept(name: str) -> Column:
    return F.array_sort(F.collect_set(name))


def zonal_statistics(cells: DataFrame, pixels: DataFrame, keys: list[str], layer: str = "layer", kind: str = "residual_type", feature: str = "feature", date: str = "obs_date", value: str = "z") -> DataFrame:
    """For each object: mean and max over all layers, mean and max of each feature (field layers only), max of each residual type, sources and dates.

    Two levels: object and layer first (partial sums before the shuffle), then
    objects. A date counts, and a layer is a supporting observation, if it has
    a value above 0 in the object.
    """
    rows = cells.select(*keys, "row", "col").join(pixels, ["row", "col"])
    per = rows.groupBy(*keys, layer, kind, feature, date).agg(F.sum(value).alias("s"), F.count(value).alias("n"), F.max(value).alias("m"))
    on_field = F.col(kind) == "field"
    per_feature = per.where(on_field & (F.col("n") > 0)).groupBy(*keys, feature).agg((F.sum("s") / F.sum("n")).alias("mean"), F.max("m").alias("max"))
    maps = per_feature.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(feature, "mean")))).alias("per_feature_mean"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(feature, "max")))).alias("per_feature_max"),
    )
    positive = F.col("m") > 0
    valid = F.col("n") > 0
    totals = per.groupBy(*keys).agg(
        (F.sum("s") / F.sum("n")).alias("mean_anomaly"), F.max("m").alias("max_anomaly"),
        *[F.max(F.when(F.col(kind) == k, F.col("m"))).alias(f"{k}_residual_max") for k in ("field", "peer", "temporal")],
        F.array_sort(F.collect_set(F.when(valid, F.col(kind)))).alias("residual_types_present"),
        F.array_sort(F.collect_set(F.when(valid, F.col(feature)))).alias("source_feature_names"),
        F.array_sort(F.collect_set(F.when(valid, F.col(layer)))).alias("source_layer_ids"),
        F.array_sort(F.collect_set(F.when(positive, F.col(date).cast("string")))).alias("anomalous_dates"),
        F.count_if(positive).alias("source_detection_count"),
    )
    seasons = F.size(F.array_distinct(F.transform("anomalous_dates", lambda d: F.substring(d, 1, 4))))
    return totals.join(maps, keys, "left").withColumn("repeated_seasons", seasons)


#: How the columns of merged detections come about; objects may lack any of them.
_MEANS, _MAXIMA, _SUMS = ("mean_anomaly",), ("max_anomaly", "annulus_contrast", "ringness_score", "field_residual_max", "peer_residual_max", "temporal_residual_max"), ("source_detection_count",)
_UNIONS, _MAPS = ("source_feature_names", "source_layer_ids", "anomalous_dates", "residual_types_present"), (("per_feature_mean", F.avg), ("per_feature_max", F.max))


def merged_statistics(objects: DataFrame, group: str) -> DataFrame:
    """Merged detections: means of means, maxima of maxima (also per feature), unions of sources and dates, sums of counts, seasons anew."""
    have = set(objects.columns)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    ways = [F.avg(number(c)).alias(c) for c in _MEANS if c in have] + [F.max(number(c)).alias(c) for c in _MAXIMA if c in have]
    ways += [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS if c in have] + [union(c).alias(c) for c in _UNIONS if c in have]
    out = objects.groupBy(group).agg(*ways, F.count("*").alias("merged_detections"))
    for name, how in _MAPS:
        if name in have:
            each = objects.select(F.col(group).alias("__g"), F.explode(name).alias("k", "v")).where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("__g", "k").agg(how("v").alias("v"))
            maps = each.groupBy("__g").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(name))
            out = out.join(maps, F.col(group) == F.col("__g"), "left").drop("__g").withColumn(name, F.coalesce(name, F.create_map().cast("map<string,double>")))
    return out.withColumn("repeated_seasons", F.size(F.array_distinct(F.transform("anomalous_dates", lambda d: F.substring(d, 1, 4))))) if "anomalous_dates" in have else out


def merged_objects(cells: DataFrame, objects: DataFrame, group: str, cell: float, limits: dict[str, float] | None = None) -> DataFrame:
    """Detections that were merged into groups, as objects again.

    cells has (group, row, col), a cell once for each detection that has it;
    objects has the detections' statistics and group. Shape metrics come from
    the union of the cells, the flags from those metrics, the rest from
    `merged_statistics`.
    """
    from orrery.operators import shapes

    union = cells.select(group, "row", "col").distinct()
    formed = shapes.cell_metrics(union, group, cell).withColumn("support_pixel_count", F.round(F.col("area_m2") / (cell * cell)).cast("int"))
    rows = formed.join(merged_statistics(objects, group), group)
    for c in ("ringness_score", "annulus_contrast"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(0.0))
    return rows.withColumn("dynamic_object_flags", shapes.object_flags(limits)).withColumn("passes_dynamic_filters", F.size("dynamic_object_flags") == 0)
