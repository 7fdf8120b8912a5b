"""Shape metrics of polygons, boxes and cell sets; the static morphology detector; stable ids."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import polygons
from orrery.functions.scalars import flags, safe_part

METRICS = ("area_m2", "perimeter_m", "equivalent_diameter_m", "circularity", "compactness", "bbox_width", "bbox_height", "elongation")


def from_sides(area: Column, perimeter: Column, width: Column, height: Column) -> dict[str, Column]:
    """The eight metrics from area, perimeter and bounding box sides."""
    return {
        "area_m2": area,
        "perimeter_m": perimeter,
        "equivalent_diameter_m": F.when(area > 0, 2.0 * F.sqrt(area / F.lit(math.pi))).otherwise(0.0),
        "circularity": F.when(perimeter > 0, F.lit(4.0 * math.pi) * area / (perimeter * perimeter)).otherwise(0.0),
        "compactness": F.when(perimeter > 0, area / (perimeter * perimeter)).otherwise(0.0),
        "bbox_width": width,
        "bbox_height": height,
        "elongation": F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1e-9)),
    }


def box_metrics(df: DataFrame) -> DataFrame:
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    return df.withColumns(from_sides(w * h, 2.0 * (w + h), w, h))


def polygon_metrics(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """Rows with the metrics, has_hole and parts of a geometry held as JSON text; an empty geometry raises."""
    fields = ",".join(f"{m}:double" for m in METRICS)

    @F.pandas_udf(f"struct<{fields},has_hole:boolean,parts:int>")
    def measured(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            g = json.loads(t)
            rows.append({**polygons.metrics(g), "has_hole": polygons.has_hole(g), "parts": len(g["parts"])})
        return pd.DataFrame(rows, columns=[*METRICS, "has_hole", "parts"])

    return df.withColumn("__m", measured(geom)).select("*", "__m.*").drop("__m")


def cell_metrics(cells: DataFrame, key: str, size: float) -> DataFrame:
    """Metrics of sets of grid cells, exactly as of their outlines.

    The perimeter counts cell sides without a neighbour in the set: four for
    each cell less two for each pair of neighbours, found by two equi-joins.
    """
    a = cells.select(key, "row", "col")
    right = a.select(F.col(key).alias("__k"), F.col("row").alias("__r"), (F.col("col") - 1).alias("__c"))
    below = a.select(F.col(key).alias("__k"), (F.col("row") - 1).alias("__r"), F.col("col").alias("__c"))
    same = (F.col(key) == F.col("__k")) & (F.col("row") == F.col("__r")) & (F.col("col") == F.col("__c"))
    shared = a.join(right.unionByName(below), same).groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__pairs"))
    sums = a.groupBy(key).agg(
        F.count("*").alias("support_pixel_count"), (F.max("col") - F.min("col") + 1).alias("__w"), (F.max("row") - F.min("row") + 1).alias("__h"),
        F.avg("col").alias("centre_col"), F.avg("row").alias("centre_row"),
    )
    both = sums.join(shared, sums[key] == shared["__key"], "left")
    n = F.col("support_pixel_count")
    got = both.withColumns(from_sides(n * F.lit(size * size), (4 * n - 2 * F.coalesce("__pairs", F.lit(0))) * F.lit(size), F.col("__w") * F.lit(size), F.col("__h") * F.lit(size)))
    return got.drop("__key", "__pairs", "__w", "__h")


# Limits of the static detector.
STATIC = {"min_diameter_m": 40.0, "max_diameter_m": 1500.0, "min_area": 100.0, "max_area": 2_000_000.0, "circle_circularity": 0.85, "circle_elongation": 1.25, "ellipse_circularity": 0.45, "ellipse_elongation": 3.0, "chain_elongation": 3.0}


def static_candidates(df: DataFrame, limits: dict[str, float] | None = None, landcover: str | None = None) -> DataFrame:
    """Rows with metrics -> morphology_type, static_score and flags.

    Uses has_hole and parts if present. Holes make rings; long or several-part
    shapes chains; then circles, ellipses and irregular ones.
    """
    lim = STATIC | (limits or {})
    hole = F.col("has_hole") if "has_hole" in df.columns else F.lit(False)
    multi = F.col("parts") > 1 if "parts" in df.columns else F.lit(False)
    c, e, d, a = F.col("circularity"), F.col("elongation"), F.col("equivalent_diameter_m"), F.col("area_m2")
    long = e >= lim["chain_elongation"]
    kind = (
        F.when(hole, "ring").when(long | multi, "chain")
        .when((c >= lim["circle_circularity"]) & (e <= lim["circle_elongation"]), "circle")
        .when((c >= lim["ellipse_circularity"]) & (e <= lim["ellipse_elongation"]), "ellipse").otherwise("irregular")
    )
    built = F.lit(landcover is not None and landcover.lower() == "built_up")
    small, large = (d < lim["min_diameter_m"]) | (a < lim["min_area"]), (d > lim["max_diameter_m"]) | (a > lim["max_area"])
    base = F.when(F.col("morphology_type") == "ring", 0.95).when(F.col("morphology_type") == "circle", c).when(F.col("morphology_type") == "ellipse", 0.65).when(F.col("morphology_type") == "chain", 0.55).otherwise(0.25)
    less = F.when(built, 0.2).otherwise(0.0) + F.when(long & (F.col("morphology_type") != "chain"), 0.2).otherwise(0.0)
    score = F.when(small | large, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - less)))
    out = df.withColumn("morphology_type", kind)
    return out.withColumns({"static_score": score, "flags": flags((small, "too_small"), (large, "too_large"), (long, "elongated"), (multi, "multi_part"), (built, "built_up_risk"))})


# Limits of extracted objects.
OBJECT = {"min_area_m2": 1000.0, "max_area_m2": 800_000.0, "min_diameter_m": 40.0, "max_diameter_m": 1000.0, "max_elongation": 4.0, "min_support_pixels": 1, "broad_area_m2": 50_000.0, "broad_circularity": 1.0, "broad_ringness": 0.0}


def object_flags(limits: dict[str, float] | None = None) -> Column:
    """too_small, too_large, elongated and broad_patch from metrics, ringness_score and support_pixel_count."""
    lim = OBJECT | (limits or {})
    a, d = F.col("area_m2"), F.col("equivalent_diameter_m")
    return flags(
        ((a < lim["min_area_m2"]) | (d < lim["min_diameter_m"]) | (F.col("support_pixel_count") < lim["min_support_pixels"]), "too_small"),
        ((a > lim["max_area_m2"]) | (d > lim["max_diameter_m"]), "too_large"),
        (F.col("elongation") > lim["max_elongation"], "elongated"),
        ((a >= lim["broad_area_m2"]) & (F.col("circularity") <= lim["broad_circularity"]) & (F.col("ringness_score") <= lim["broad_ringness"]), "broad_patch"),
    )


def stable_ids(df: DataFrame, field: str, x: str, y: str, shape_text: str, order: str) -> DataFrame:
    """Rows with candidate_id: dyn-<field>-x<10 m>y<10 m>-<8 hex of the shape>, numbered where it repeats.

    Centres round half to even. The number follows `order`.
    """
    to_ten = lambda c: (F.bround(F.col(c) / 10.0) * 10).cast("long").cast("string")
    base = F.concat(F.lit("dyn-"), safe_part(F.col(field).cast("string")), F.lit("-x"), to_ten(x), F.lit("y"), to_ten(y), F.lit("-"), F.substring(F.sha2(F.col(shape_text).cast("binary"), 256), 1, 8))
    rows = df.withColumn("__base", base)
    same = Window.partitionBy("__base")
    number = F.row_number().over(same.orderBy(order))
    many = F.count("*").over(same)
    return rows.withColumn("candidate_id", F.when(many == 1, F.col("__base")).otherwise(F.concat(F.col("__base"), F.lit("-"), F.lpad(number.cast("string"), 2, "0")))).drop("__base")
