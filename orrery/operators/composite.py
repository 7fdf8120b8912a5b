"""Composite anomaly: weighted mean of component supports, renormalised at each pixel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.scalars import positive_support


def assign_components(layers: DataFrame, components: Mapping[str, Sequence[str]], name: str = "name") -> DataFrame:
    """Layers with component: the first configured component that lists the feature.

    Names that start with a configured post_rain_drying or sar input's prefix
    belong to that component too. Unmatched layers have null.
    """
    out = None
    for component, inputs in components.items():
        match = F.col(name).isin(*inputs) if inputs else F.lit(False)
        if component in ("post_rain_drying", "sar"):
            prefix = "post_rain_drying" if component == "post_rain_drying" else "sar_event_response"
            match = match | F.col(name).startswith(prefix)
        out = F.when(match, F.lit(component)) if out is None else out.when(match, F.lit(component))
    return layers.withColumn("component", out if out is not None else F.lit(None).cast("string"))


def component_map(rows: DataFrame, pixel: Sequence[str], component: str = "component", value: str = "z") -> DataFrame:
    """Mean positive support of each component at each pixel; nulls don't count."""
    return rows.where(F.col(component).isNotNull()).groupBy(*pixel, component).agg(F.avg(positive_support(F.col(value))).alias("support"))


def composite_map(rows: DataFrame, weights: Mapping[str, float], pixel: Sequence[str], component: str = "component", value: str = "z") -> DataFrame:
    """pixel, composite: sum of weight times support over sum of weights, among the components valid there.

    Normalising the weights over all components first would cancel here. Pixels
    without a valid weighted component have null.
    """
    active = {c: float(w) for c, w in weights.items() if w and w > 0}
    table = F.create_map(*[F.lit(x) for pair in active.items() for x in pair]) if active else None
    maps = component_map(rows, pixel, component, value)
    weight = F.try_element_at(table, F.col(component)) if active else F.lit(None).cast("double")
    weighted = maps.withColumn("__w", F.when(F.col("support").isNotNull(), weight))
    total = F.sum(F.col("support") * F.col("__w"))
    return weighted.groupBy(*pixel).agg(F.try_divide(total, F.sum("__w")).alias("composite"))


def composite_flags(rows: DataFrame, weights: Mapping[str, float], component: str = "component") -> DataFrame:
    """One row for each flag: missing_component_<c> for a weighted component without layers, and the two for nothing at all."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(c, float(w or 0)) for c, w in weights.items()], "wanted string, weight double")
    present = rows.where(F.col(component).isNotNull()).groupBy(F.col(component).alias("present")).agg(F.count("*").alias("n"))
    state = wanted.join(present, F.col("wanted") == F.col("present"), "left")
    missing = state.where("weight > 0 and present is null").select(F.concat(F.lit("missing_component_"), "wanted").alias("flag"))
    totals = state.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("layers"), F.count_if((F.col("weight") > 0) & F.col("present").isNotNull()).alias("usable"))
    none = totals.select(F.explode(F.filter(F.array(F.when(F.col("layers") == 0, F.lit("missing_anomaly_layers")), F.when(F.col("usable") == 0, F.lit("missing_weighted_components"))), lambda x: x.isNotNull())).alias("flag"))
    return missing.unionByName(none)
