"""Which features a stack gives: small records on the driver; their pixels by joins on layer ids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.spectral import DIRECTIONS, EPSILON
from orrery.sources.manifest import RasterSpec

# Prepared optical features; the moisture features of events.
REQUIRED, OPTIONAL, MOISTURE = ("NDVI", "NDMI", "NDWI", "MSI", "BSI", "brightness"), ("red_edge", "NDRE"), ("NDMI", "NDWI", "MSI")
RAIN_MM = 1.0


@dataclass(frozen=True)
class Feature:
    name: str
    sensor: str
    date: str | None
    sources: tuple[str, ...]
    direction: str
    op: str
    left: str
    right: str | None = None

    @property
    def key(self) -> str:
        return "|".join((self.name, self.date or "undated", *self.sources))


def _dated(layers: Sequence[RasterSpec]) -> list[RasterSpec]:
    return sorted(layers, key=lambda s: (s.obs_date or "", s.layer_id))


def _prepared(layers: Sequence[RasterSpec], name: str, sensor: str) -> list[Feature]:
    return [Feature(name, sensor, s.obs_date, (s.layer_id,), DIRECTIONS[name], "same", s.layer_id) for s in _dated([s for s in layers if s.feature_name == name])]


def optical(layers: Sequence[RasterSpec]) -> tuple[list[Feature], list[str]]:
    own = [s for s in layers if s.sensor.lower() == "sentinel2"]
    names = {s.feature_name for s in own}
    out = [f for n in (*REQUIRED, *OPTIONAL) for f in _prepared(own, n, "sentinel2")]
    flags = [f"missing_sentinel2_{n}" for n in REQUIRED if n not in names]
    flags += ["missing_sentinel2_red_edge"] if not names & set(OPTIONAL) else []
    return out, flags + (["missing_sentinel2_EVI"] if "EVI" not in names else [])


def sar(layers: Sequence[RasterSpec], shapes: dict[str, tuple[int, int]] | None = None) -> tuple[list[Feature], list[str]]:
    """VV, VH, their ratio on each date, and the difference of the last layer to the first."""
    own = [s for s in layers if s.sensor.lower() == "sentinel1"]
    shape = lambda s: (shapes or {}).get(s.layer_id)
    by = {n: [s for s in own if s.feature_name == n] for n in ("VV", "VH")}
    out = [f for n in by for f in _prepared(own, n, "sentinel1")]
    flags = [f"missing_sentinel1_{n}" for n, found in by.items() if not found]
    first = {n: {} for n in by}
    for n, found in by.items():
        for s in _dated(found):
            first[n].setdefault(s.obs_date, s)
    for day in sorted(set(first["VV"]) | set(first["VH"]), key=lambda d: d or ""):
        a, b, label = first["VV"].get(day), first["VH"].get(day), day or "undated"
        if a is None or b is None:
            flags.append(f"missing_sentinel1_{'VV' if a is None else 'VH'}_for_ratio_{label}")
        elif shape(a) != shape(b):
            flags.append(f"VV_VH_ratio_shape_mismatch_{label}")
        else:
            out.append(Feature("VV_VH_ratio", "sentinel1", day, (a.layer_id, b.layer_id), DIRECTIONS["VV_VH_ratio"], "ratio", a.layer_id, b.layer_id))
    if not first["VV"] and not first["VH"]:
        flags.append("missing_sentinel1_VV_VH_ratio_inputs")
    for n in by:
        found = sorted(by[n], key=lambda s: s.obs_date or "")
        if len(found) >= 2:
            if shape(found[0]) != shape(found[-1]):
                flags.append("temporal_difference_shape_mismatch")
            else:
                out.append(Feature("temporal_difference", "sentinel1", found[-1].obs_date, (found[0].layer_id, found[-1].layer_id), DIRECTIONS["temporal_difference"], "gain", found[0].layer_id, found[-1].layer_id))
            break
    else:
        flags.append("missing_sentinel1_temporal_difference_inputs")
    return out, flags


def thermal(layers: Sequence[RasterSpec]) -> tuple[list[Feature], list[str]]:
    own = [s for s in layers if s.sensor.lower() == "landsat" and s.feature_name == "LST"]
    if not own:
        return [], ["missing_landsat_LST"]
    return [Feature("LST", "landsat", s.obs_date, (s.layer_id,), DIRECTIONS["LST"], "same", s.layer_id) for s in sorted(own, key=lambda s: s.obs_date or "")], []


def in_season(f: Feature, vegetation: Sequence[int], bare_soil: Sequence[int]) -> bool:
    if f.date is None:
        return True
    name, month = f.name.lower(), int(f.date[5:7])
    if any(t in name for t in ("ndvi", "ndre", "red_edge", "red-edge", "vegetation")):
        return month in vegetation
    if any(t in name for t in ("bsi", "brightness", "bare_soil", "bare-soil")):
        return month in bare_soil
    return True


def _bracket(found: list[Feature], day: str, inclusive: bool) -> tuple[Feature | None, Feature | None]:
    before = [f for f in found if f.date < day or inclusive and f.date == day]
    after = [f for f in found if f.date > day]
    return (before[-1] if before else None, after[0] if after else None)


def post_rain(features: Sequence[Feature], rain: list[tuple[str, float | None, str]] | None, least_mm: float = RAIN_MM) -> tuple[list[Feature], list[str]]:
    """Drying of each moisture feature across each rain event: strictly before, strictly after."""
    if not rain:
        return [], ["missing_weather_context"]
    own = [f for f in features if f.name in MOISTURE]
    if not own:
        return [], ["missing_moisture_features_for_post_rain_drying"]
    return _events(own, rain, least_mm, False, lambda f: (f.date, f.sources), lambda n: (f"post_rain_drying_{n}", "weather", "post_rain_drying", "gain" if n == "MSI" else "loss"), "missing_prior_rain_event", "missing_moisture_pair_for_post_rain_drying_")


def sar_response(features: Sequence[Feature], rain: list[tuple[str, float | None, str]] | None, least_mm: float = RAIN_MM) -> tuple[list[Feature], list[str]]:
    """Change of each SAR feature across each rain event: up to the day, and after it."""
    if not rain:
        return [], ["missing_weather_context"]
    own = [f for f in features if f.sensor == "sentinel1" and f.name in ("VV", "VH", "VV_VH_ratio") and f.date]
    if not own:
        return [], ["missing_sentinel1_event_response_inputs"]
    return _events(own, rain, least_mm, True, lambda f: f.date, lambda n: (f"sar_event_response_{n}", "sentinel1", "sar_event_response", "change"), "missing_prior_rain_event_for_sar_event_response", "missing_sar_pair_for_event_response_")


def _events(own, rain, least_mm, inclusive, order, made, no_rain, no_pair):
    wet = [r for r in rain if r[1] is not None and r[1] >= least_mm]
    if not wet:
        return [], [no_rain]
    out, flags = [], []
    names = list(dict.fromkeys(f.name for f in own if f.date))
    for day, _, context in wet:
        paired = False
        for n in names:
            before, after = _bracket(sorted([f for f in own if f.name == n and f.date], key=order), day, inclusive)
            if before and after:
                paired = True
                name, sensor, kind, op = made(n)
                out.append(Feature(name, sensor, after.date, (context, *before.sources, *after.sources), DIRECTIONS[kind], op, before.key, after.key))
        if not paired:
            flags.append(no_pair + day)
    return out, flags


def feature_pixels(spark, features: Sequence[Feature], pixels: DataFrame, key: str) -> DataFrame:
    """(feature, row, col, value) of features made from pixels of one or two sources named by `key`.

    One equi-join for the first sources, one for the second; the feature list is small and broadcast.
    """
    rows = spark.createDataFrame([(f.key, f.op, f.left, f.right) for f in features], "feature string, op string, left string, right string")
    one = pixels.select(F.col(key).alias("left"), "row", "col", F.col("value").alias("a")).join(F.broadcast(rows), "left")
    same = one.where("op = 'same'").select("feature", "row", "col", F.col("a").alias("value"))
    if all(f.op == "same" for f in features):
        return same
    two = pixels.select(F.col(key).alias("right"), "row", "col", F.col("value").alias("b"))
    both = one.where("op <> 'same'").join(two, ["right", "row", "col"])
    value = (
        F.when(F.col("op") == "ratio", F.try_divide(F.col("a"), F.col("b") + EPSILON)).when(F.col("op") == "gain", F.col("b") - F.col("a"))
        .when(F.col("op") == "loss", F.col("a") - F.col("b")).otherwise(F.abs(F.col("b") - F.col("a")))
    )
    return same.unionByName(both.select("feature", "row", "col", value.alias("value")))
