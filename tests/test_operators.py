"""Operators on small hand-made tables with known results."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import polygons, scalars, spectral
from orrery.operators import components, composite, linkage, review, robust, scoring, segment, shapes, spatial, temporal, zonal
from orrery.operators import segment_kernel as kernel
from orrery.plans import features
from orrery.sources.manifest import RasterSpec


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.first().asDict(recursive=True)


# scalars and indices ---------------------------------------------------------------


def test_indices(spark):
    df = frame(spark, [(0.2, 0.6, 0.3, 0.4, 0.1), (None, 0.6, 0.3, 0.4, 0.1)], "red double, nir double, green double, swir double, blue double")
    red, nir, green, swir, blue = (F.col(c) for c in df.columns)
    got = df.select(spectral.ndvi(red, nir), spectral.ndmi(nir, swir), spectral.ndwi(green, nir), spectral.msi(nir, swir), spectral.bsi(blue, red, nir, swir), spectral.brightness(red, green, blue)).collect()
    want = (0.4 / 0.8, 0.2 / 1.0, -0.3 / 0.9, 0.4 / 0.6, -0.1 / 1.3, 0.2)
    assert all(abs(a - b) < 1e-6 for a, b in zip(got[0], want, strict=True))
    assert got[1][0] is None and abs(got[1][5] - 0.2) < 1e-9
    with pytest.raises(ValueError):
        spectral.brightness()


def test_scalar_rules(spark):
    df = frame(spark, [(float("nan"), "  Hard-Negative ", "A b/ü.", 100.0, '["x","y"]'), (float("inf"), None, "", 0.5, "plain"), (2.0, "Unknown", "--", 1.25, None)], "v double, label string, id string, n double, l string")
    got = df.select(scalars.finite(F.col("v")).alias("f"), scalars.review_label(F.col("label")).alias("r"), scalars.safe_part(F.col("id")).alias("s"), scalars.plain_number(F.col("n")).alias("p"), scalars.text_list(F.col("l")).alias("t")).collect()
    assert [r["f"] for r in got] == [None, None, 2.0] and [r["r"] for r in got] == ["hard_negative", "", ""]
    assert [r["s"] for r in got] == ["a_b", "unknownfield", "unknownfield"] and [r["p"] for r in got] == ["100", "0.5", "1.25"] and [r["t"] for r in got] == [["x", "y"], ["plain"], []]


# robust statistics -------------------------------------------------------------------


def z_of(spark, values, direction=""):
    df = frame(spark, [(1, i, float(v) if v is not None else None) for i, v in enumerate(values)], "zone int, i int, v double")
    return [r["z"] for r in robust.robust_z(df, ["zone"], "v", direction).orderBy("i").collect()]


def test_robust_z(spark):
    a = z_of(spark, [1, 2, 3, 4, 100])
    assert np.allclose(a, [(v - 3) / 1.4826 for v in (1, 2, 3, 4, 100)])
    assert np.allclose(z_of(spark, [11, 12, 13, 14, 110]), a)  # a shift changes nothing
    std = z_of(spark, [300, 300, 300, 304])
    assert std[3] > 1 and abs(std[3] - 4 / np.std([300, 300, 300, 304])) < 1e-9
    assert z_of(spark, [5, 5, 5]) == [None] * 3 and z_of(spark, [None, float("nan"), 1.0, 2.0, 4.0])[:2] == [None, None]
    assert np.allclose(z_of(spark, [1, 2, 3, 4, 100], "lower_values_x"), [-x for x in a]) and np.allclose(z_of(spark, [1, 2, 3, 4, 100], "higher_or_lower_values"), np.abs(a))


def test_zone_flags_and_brackets(spark):
    rows = [("a", 300.0)] * 3 + [("a", 304.0), ("b", 1.0), ("b", 1.0), ("c", None), ("d", 1.0), ("d", 2.0), ("d", 9.0)]
    df = frame(spark, rows, "zone string, v double")
    stats = robust.group_statistics(df, ["zone"], "v")
    flags = {r["flag"] for r in robust.zone_flags(stats, "zone").collect()}
    assert flags == {"mad_fallback_std_a", "constant_field_b", "insufficient_valid_pixels_c"}
    r = np.random.default_rng(0)
    many = frame(spark, [(int(k), float(v)) for k, v in zip(r.integers(0, 3, 3000), r.choice(r.normal(size=900), 3000), strict=True)], "zone int, v double")
    for q in (0.5, 0.9, 0.05):
        plain = {x[0]: x[1] for x in robust.exact_quantile(many, ["zone"], "v", q, "m").collect()}
        narrow = {x[0]: x[1] for x in robust.exact_quantile(many, ["zone"], "v", q, "m", bracketed=True, accuracy=50).collect()}
        assert plain.keys() == narrow.keys() and all(abs(plain[k] - narrow[k]) < 1e-12 for k in plain)


def test_peer_residual_needs_two_fields(spark):
    pixels = frame(spark, [(z, float(v)) for z, v in [(1, 1), (1, 2), (2, 3), (2, 10), (3, 5), (3, 7), (4, 1)]], "zone int, v double")
    zones = frame(spark, [(1, "w"), (2, "w"), (3, "x"), (4, "")], "zone int, stratum string")
    got = robust.peer_residual(pixels, zones, "zone", "stratum", "v").collect()
    assert all((r["z"] is not None) == (r["zone"] in (1, 2)) for r in got)


def test_temporal_residual(spark):
    rows = [("NDVI", 0, d, v) for d, v in (("2023-05-01", 1.0), ("2024-05-01", 2.0), ("2025-05-01", 9.0))] + [("NDVI", 1, "2023-05-01", 4.0), ("LST", 0, "2023-05-01", 4.0), ("NDVI", 0, None, 3.0)]
    got = {(r["name"], r["px"], r["d"]): r["z"] for r in robust.temporal_residual(frame(spark, rows, "name string, px int, d string, v double"), ["name"], ["px"], "d", "v").collect()}
    assert abs(got["NDVI", 0, "2025-05-01"] - 7 / 1.4826) < 1e-9
    assert got["NDVI", 1, "2023-05-01"] is None and got["LST", 0, "2023-05-01"] is None and got["NDVI", 0, None] is None


def test_composite(spark):
    support = {"a": [2, -1], "b": [1, 3], "c": [0.5, 1], "d": [4, 0], "e": [1, 2]}
    df = frame(spark, [(i, c, float(v)) for c, vs in support.items() for i, v in enumerate(vs)], "px int, component string, z double")
    got = {r["px"]: r["composite"] for r in composite.composite_map(df, dict.fromkeys("abcde", 0.2), ["px"]).collect()}
    assert abs(got[0] - 1.7) < 1e-9 and abs(got[1] - 1.2) < 1e-9
    some = df.withColumn("z", F.when((F.col("component") != "d") | (F.col("px") != 0), F.col("z")))
    assert abs(composite.composite_map(some, dict.fromkeys("abcde", 0.2), ["px"]).where("px = 0").first()["composite"] - 4.5 / 4) < 1e-9
    flags = {r["flag"] for r in composite.composite_flags(df, {"a": 1.0, "x": 1.0, "y": 0.0}).collect()}
    assert flags == {"missing_component_x"}
    assert {r["flag"] for r in composite.composite_flags(df.where("false"), {"a": 1.0}).collect()} == {"missing_component_a", "missing_anomaly_layers", "missing_weighted_components"}


# time ---------------------------------------------------------------------------------


def test_brackets(spark):
    obs = frame(spark, [("s", "2024-05-01", "l1", 1.0), ("s", "2024-05-01", "l2", 2.0), ("s", "2024-05-10", "l3", 3.0), ("s", "2024-05-12", "l4", 4.0), ("s", "2024-05-12", "l5", 5.0)], "series string, t string, layer string, v double")
    events = frame(spark, [("s", "2024-05-10", 1), ("s", "2024-04-01", 2), ("other", "2024-05-10", 3)], "series string, t string, rain int")
    strict = {r["rain"]: r for r in temporal.bracket(obs, events, ["series"], "t", ["layer"], ["v"], "rain").collect()}
    wide = {r["rain"]: r for r in temporal.bracket(obs, events, ["series"], "t", ["layer"], ["v"], "rain", inclusive_before=True).collect()}
    assert strict[1]["before"]["v"] == 2.0 and strict[1]["after"]["v"] == 4.0 and wide[1]["before"]["v"] == 3.0 and wide[1]["after"]["v"] == 4.0
    assert strict[2]["before"] is None and strict[2]["after"]["v"] == 1.0 and strict[3]["before"] is None and strict[3]["after"] is None


def test_drying_and_days(spark):
    df = frame(spark, [("NDMI", 0.8, 0.5), ("MSI", 0.7, 1.0)], "n string, b double, a double")
    assert all(abs(r[0] - 0.3) < 1e-9 for r in df.select(temporal.drying_delta(F.col("n"), F.col("b"), F.col("a"))).collect())
    obs = frame(spark, [("k", "2024-05-10", 1), ("k", "2024-05-01", 2)], "k string, t string, o int")
    events = frame(spark, [("k", "2024-05-08", "a"), ("k", "2024-05-08", "b"), ("k", "2024-05-11", "c")], "k string, t string, e string")
    got = {r["o"]: (r["last_event"], r["days_since"]) for r in temporal.days_since(obs, events, ["k"], "t", "e").collect()}
    assert got == {1: ("b", 2), 2: (None, None)}


def test_ratio_pairs_undated_layers(spark):
    schema = "k int, d string, v double, layer string"
    vv = frame(spark, [(1, None, 4.0, "a"), (1, "2024-01-01", 8.0, "c"), (1, "2024-01-01", 6.0, "b")], schema)
    vh = frame(spark, [(1, None, 2.0, "a"), (1, "2024-02-01", 2.0, "b")], schema)
    got = {r["d"]: (r["ratio"], r["flag"]) for r in temporal.paired_ratio(vv, vh, ["k"], "d", "v", "layer").collect()}
    assert abs(got[None][0] - 2) < 1e-6 and got["2024-01-01"] == (None, "missing_sentinel1_VH_for_ratio_2024-01-01") and got["2024-02-01"][1] == "missing_sentinel1_VV_for_ratio_2024-02-01"


def spec(i, name, day, sensor="sentinel2"):
    return RasterSpec(i, sensor, name, f"{i}.tif", "EPSG:32637", 10.0, None, "input_feature", day)


def test_feature_choice():
    layers = [spec("n1", "NDMI", "2024-05-01"), spec("n2", "NDMI", "2024-05-20"), spec("m", "MSI", "2024-05-01"), spec("a", "VV", "2024-05-01", "sentinel1"), spec("b", "VV", "2024-05-11", "sentinel1"), spec("c", "VH", "2024-05-11", "sentinel1")]
    found, flags = features.optical(layers)
    assert [f.name for f in found] == ["NDMI", "NDMI", "MSI"] and {"missing_sentinel2_NDVI", "missing_sentinel2_red_edge", "missing_sentinel2_EVI"} <= set(flags)
    radar, radar_flags = features.sar(layers)
    assert [f.name for f in radar] == ["VV", "VV", "VH", "VV_VH_ratio", "temporal_difference"] and radar_flags == ["missing_sentinel1_VH_for_ratio_2024-05-01"]
    rain = [("2024-05-11", 5.0, "r1"), ("2024-05-12", 0.2, "r2"), ("2024-06-01", 9.0, "r3")]
    dry, dry_flags = features.post_rain(found, rain)
    assert [(f.name, f.date, f.sources) for f in dry] == [("post_rain_drying_NDMI", "2024-05-20", ("r1", "n1", "n2"))] and dry_flags == ["missing_moisture_pair_for_post_rain_drying_2024-06-01"]
    assert features.post_rain(found, None)[1] == ["missing_weather_context"] and features.post_rain(found, [("2024-05-11", 0.1, "x")])[1] == ["missing_prior_rain_event"]
    changed, _ = features.sar_response(radar, [("2024-05-01", 5.0, "r")])
    assert [(f.name, f.op) for f in changed] == [("sar_event_response_VV", "change")]  # the layer of the day counts as before
    assert not features.in_season(found[0].__class__("NDVI", "s", "2024-05-01", (), "", "same", "x"), [6], [5]) and features.in_season(found[0], [6], [6])


# scoring ----------------------------------------------------------------------------------


def scored(spark, **columns):
    kinds = {"evidence_class": "string", "landcover_branch": "string", "static_score": "double", "circularity": "double", "elongation": "double", "per_feature_max": "map<string,double>", "repeated_seasons": "int", "false_positive_penalty": "double", "false_positive_flags": "array<string>", "source_feature_names": "array<string>", "dynamic_object_flags": "array<string>", "support_pixel_count": "int", "max_anomaly": "double"}
    return one(scoring.score_objects(frame(spark, [tuple(columns.values())], ", ".join(f"{n} {kinds[n]}" for n in columns))))


STRONG = {"NDMI": 9.0, "NDVI": 9.0, "BSI": 9.0, "LST": 9.0, "VV": 9.0}


def test_branch_scores(spark):
    df = frame(spark, [(1.0,)], "x double")
    every = {n: F.col("x") for n in (*scoring.CROPLAND, *scoring.FOREST, *scoring.MIXED)}
    got = df.select(scoring.cropland_score(every), scoring.forest_score(every), scoring.mixed_score(every), scoring.branch_score(F.lit("??"), every), scoring.cropland_score(every, F.lit(0.4)), scoring.cropland_score(every, None, {"moisture": 0.5, "sar": None})).first()
    assert [round(v, 9) for v in got] == [1.0, 1.0, 1.0, 1.0, 0.6, 0.5]


def test_tiny_objects_need_support(spark):
    base = {"landcover_branch": "cropland", "per_feature_max": STRONG, "circularity": 0.9, "elongation": 1.0, "dynamic_object_flags": ["too_small"], "support_pixel_count": 9, "false_positive_flags": []}
    weak = scored(spark, **base, source_feature_names=["NDMI", "NDVI"], repeated_seasons=1)
    strong = scored(spark, **base, source_feature_names=["NDMI", "NDVI", "BSI"], repeated_seasons=2)
    assert weak["object_score"] < 0.35 and weak["priority_class"] == "D" and strong["object_score"] >= 0.35


def test_penalties_and_evidence(spark):
    base = {"landcover_branch": "cropland", "evidence_class": "static_dynamic", "static_score": 0.95, "per_feature_max": STRONG, "repeated_seasons": 2, "support_pixel_count": 50}
    assert scored(spark, **base)["priority_class"] == "A" and scored(spark, **base, false_positive_penalty=0.4)["priority_class"] == "C"
    static = scored(spark, landcover_branch="forest", evidence_class="static_only", static_score=0.9, per_feature_max=STRONG, support_pixel_count=50)
    assert static["object_score"] == 0.7 and static["dynamic_score"] == 0 and static["dominant_evidence"] == "static morphology" and static["missing_data_flags"] == ["missing_dynamic_evidence", "missing_forest_branch_scoring"]
    bare = scored(spark, max_anomaly=1.5, support_pixel_count=50)
    assert bare["dynamic_score"] == 0.5 and abs(bare["object_score"] - 0.425) < 1e-12 and bare["dominant_evidence"] == "unknown dynamic anomaly"


# segmentation ---------------------------------------------------------------------------------


def disk(shape, centre, radius, value, image=None):
    image = np.zeros(shape) if image is None else image
    y, x = np.ogrid[: shape[0], : shape[1]]
    image[(y - centre[0]) ** 2 + (x - centre[1]) ** 2 <= radius**2] = value
    return image


def pixel_frame(spark, image, zone=1):
    zones = zone if isinstance(zone, np.ndarray) else np.full(image.shape, zone)
    return frame(spark, [(int(zones[r, c]) if zones[r, c] else None, r, c, float(image[r, c])) for r in range(image.shape[0]) for c in range(image.shape[1])], "zone int, row int, col int, value double")


def test_seeded_components(spark):
    got = segment.seeded_components(pixel_frame(spark, disk((10, 10), (5, 5), 2, 4.0)), anomaly=90.0)
    assert got.count() == 13 and got.select("component").distinct().count() == 1
    plateau = np.zeros((10, 10))
    plateau[3:6, 3:6], plateau[4, 4] = 4, 10
    grown = segment.seeded_components(pixel_frame(spark, plateau), anomaly=99.0, support=80.0)
    assert grown.count() == 9
    zones = np.ones((10, 10), dtype=int)
    zones[:, 5:] = 2
    split = segment.seeded_components(pixel_frame(spark, disk((10, 10), (5, 5), 2, 4.0), zones), anomaly=90.0)
    assert split.select("zone", "component").distinct().count() == 2


def test_seeded_kernel_equals_the_frame(spark):
    r = np.random.default_rng(2)
    image = np.maximum(r.normal(size=(14, 17)), 0)
    labels = kernel.seeded(image, np.ones(image.shape, bool), 90.0, 70.0, 3)
    got = segment.seeded_components(pixel_frame(spark, image), anomaly=90.0, support=70.0, least=3).collect()
    by = {}
    for x in got:
        by.setdefault(x["component"], set()).add((x["row"], x["col"]))
    want = {frozenset(zip(*map(lambda a: a.tolist(), np.nonzero(labels == k)), strict=True)) for k in range(1, labels.max() + 1)}
    assert {frozenset(v) for v in by.values()} == want


def test_multiscale(spark):
    image = disk((10, 14), (4, 3), 1, 5.0)
    disk((10, 14), (4, 7), 1, 5.0, image)
    got = segment.multiscale_objects(pixel_frame(spark, image), anomaly=90.0)
    assert got.select("object").distinct().count() == 2 and got.count() == 11  # closing bridges the cell between them
    y, x = np.ogrid[:15, :15]
    ring = np.where(np.abs(np.hypot(y - 7, x - 7) - 4) <= 0.7, 5.0, 0.0)
    whole = segment.multiscale_objects(pixel_frame(spark, ring), anomaly=50.0, least=3)
    assert whole.select("object").distinct().count() == 1 and whole.first()["ringness_score"] > 0


def test_closing_and_labels():
    m = np.zeros((5, 7), bool)
    m[2, [1, 2, 4, 5]] = True
    assert kernel.closed(m)[2].tolist() == [False, True, True, True, True, True, False]
    edge = np.zeros((3, 3), bool)
    edge[0, 0] = True
    assert not kernel.closed(edge).any()  # beyond the grid nothing is set
    d = np.eye(4, dtype=bool)
    assert kernel.label(d).max() == 1 and kernel.label(d, diagonal=False).max() == 4
    seeds = np.zeros((1, 5), dtype=int)
    seeds[0, 0], seeds[0, 4] = 2, 1
    assert kernel.nearest_seed(seeds, np.ones((1, 5), bool)).tolist() == [[2, 2, 1, 1, 1]]


def test_ring_evidence_equals_the_kernel(spark):
    r = np.random.default_rng(5)
    image = r.random((12, 12))
    cells = [(4, 4), (4, 5), (4, 6), (5, 4), (5, 6), (6, 4), (6, 5), (6, 6)]
    mask = np.zeros((12, 12), bool)
    mask[tuple(zip(*cells, strict=True))] = True
    got = segment.ring_evidence(frame(spark, [(1, a, b) for a, b in cells], "k int, row int, col int"), pixel_frame(spark, image), ["k"]).first()
    assert np.allclose((got["annulus_contrast"], got["ringness_score"]), kernel.ring_evidence(image, mask))


def test_polygon_union():
    """Areas of unions of boxes, stars, shapes that share sides, lie apart, in each other, or in a hole."""
    from orrery.functions import polygons

    box = polygons.box
    cases = [(box(0, 0, 4, 4), box(2, 2, 6, 6)), (box(0, 0, 4, 4), box(4, 0, 8, 4)), (box(0, 0, 4, 4), box(4, 1, 8, 3)), (box(0, 0, 4, 4), box(1, 1, 2, 2)), (box(0, 0, 4, 4), box(0, 0, 4, 4)), (box(0, 0, 4, 4), box(0, 0, 2, 4)), (box(0, 0, 1, 1), box(5, 5, 6, 6)), (box(0, 0, 4, 4), box(4, 4, 8, 8))]
    ring = {"kind": "polygon", "parts": [[[[0, 0], [10, 0], [10, 10], [0, 10]], [[3, 3], [3, 7], [7, 7], [7, 3]]]]}
    cases += [(ring, box(4, 4, 6, 6)), (ring, box(3, 3, 7, 7)), (ring, box(5, 5, 12, 6)), (ring, box(2, 2, 8, 8))]
    r = np.random.default_rng(9)
    for _ in range(60):
        pair = []
        for _ in range(2):
            turn = np.sort(r.uniform(0, 2 * np.pi, r.integers(4, 12)))
            far = r.uniform(2, 10, len(turn))
            centre = r.uniform(-4, 4, 2) + 500_000
            pair.append({"kind": "polygon", "parts": [[(centre + np.stack([far * np.cos(turn), far * np.sin(turn)], axis=1)).tolist()]]})
        if not any(map(polygons.self_crossing, pair)):
            cases.append(tuple(pair))
    assert len(cases) > 60
    for a, b in cases:
        both = polygons.union(a, b)
        want = polygons.area(a) + polygons.area(b) - polygons.intersection_area(a, b)
        assert abs(polygons.area(both) - want) < 1e-5 * max(1, want), (a, b)
        points = np.random.default_rng(1).uniform(*(np.array(polygons.bounds(both)).reshape(2, 2)), (200, 2))
        assert (polygons.inside(both, points) == (polygons.inside(a, points) | polygons.inside(b, points))).mean() > 0.99
    assert len(polygons.union(*cases[0])["parts"][0][0]) == 8 and len(polygons.union(*cases[1])["parts"][0][0]) == 4
    assert len(polygons.union(ring, box(3, 3, 7, 7))["parts"][0]) == 1 and len(polygons.union(ring, box(4, 4, 6, 6))["parts"]) == 2


def test_fused_geometry(spark):
    import json

    from orrery.functions import polygons

    shape = lambda *b: json.dumps(polygons.box(*b))
    static = spatial.with_bounds(frame(spark, [("1", shape(0, 0, 30, 30), ["built_up_risk", "elongated"], 0.5), ("2", shape(900, 0, 930, 30), [], 0.1)], "s string, geometry string, flags array<string>, static_score double"))
    dynamic = spatial.with_bounds(frame(spark, [("x", shape(20, 0, 50, 30), 0.9, ["few_dates"], "n"), ("y", shape(400, 0, 410, 10), 0.2, None, "m")], "d string, geometry string, max_anomaly double, missing_data_flags array<string>, note string"))
    got = {r["candidate_id"]: r for r in linkage.fuse(static, dynamic, "s", "d", 100.0).collect()}
    assert set(got) == {"fused-1-x", "static-2", "dynamic-y"}
    f = got["fused-1-x"]
    assert polygons.area(json.loads(f["geometry"])) == 1500 and (f["minx"], f["maxx"]) == (0, 50) and f["source_static_candidate_ids"] == ["1"] and f["source_dynamic_object_ids"] == ["x"]
    assert f["false_positive_flags"] == ["built_up_risk"] and f["missing_data_flags"] == ["few_dates"] and f["dynamic_max_anomaly"] == 0.9 and f["static_score"] == 0.5 and f["note"] == "n"
    assert polygons.area(json.loads(got["static-2"]["geometry"])) == 900 and got["static-2"]["note"] is None and got["static-2"]["source_dynamic_object_ids"] == []
    assert got["dynamic-y"]["missing_data_flags"] == [] and got["dynamic-y"]["static_score"] is None and got["dynamic-y"]["maxx"] == 410


def test_merge_detections_against_all_pairs(spark):
    """Random detections of several fields, merged in order, against cell-by-cell distances."""
    r = np.random.default_rng(4)
    cells, shapes = [], {}
    for f in range(4):
        for d in range(25):
            y, x = r.integers(0, 90, 2)
            own = {(int(y + a), int(x + b)) for a, b in r.integers(0, 4, (6, 2))}
            shapes[f, d] = own
            cells += [(f"f{f}", d, (d * 7) % 25, a, b) for a, b in own]
    far = lambda p, q: min(np.hypot(max(abs(a - c) - 1, 0), max(abs(b - e) - 1, 0)) * 10 for a, b in p for c, e in q)
    want = {}
    for f in range(4):
        turn = sorted(range(25), key=lambda d: (d * 7) % 25)
        for k, first in enumerate(turn):
            if (f"f{f}", first) in want:
                continue
            want[f"f{f}", first], grown = first, set(shapes[f, first])
            for d in turn[k + 1 :]:
                if (f"f{f}", d) not in want and far(grown, shapes[f, d]) <= 45:
                    want[f"f{f}", d] = first
                    grown |= shapes[f, d]
    got = segment.merge_detections(frame(spark, cells, "f string, detection int, turn int, row int, col int"), "f", "detection", "turn", 10.0, 45.0).collect()
    assert {(x["f"], x["detection"]): x["merged"] for x in got} == want and len(got) == 100 and 4 < len(set(want.items())) and any(d != m for (_, d), m in want.items())


def test_merge_detections(spark):
    rows = [("f", "d1", 0, 0), ("f", "d2", 0, 3), ("f", "d3", 0, 9), ("g", "d4", 0, 1)]
    got = {r["detection"]: r["merged"] for r in segment.merge_detections(frame(spark, rows, "f string, detection string, row int, col int").withColumn("o", F.col("detection")), "f", "detection", "o", 10.0, 20.0).collect()}
    assert got == {"d1": "d1", "d2": "d1", "d3": "d3", "d4": "d4"}


def test_zonal_statistics(spark):
    cells = frame(spark, [(1, 0, 0), (1, 0, 1)], "k int, row int, col int")
    layer = lambda i, kind, name, day, vs: [(i, kind, name, day, 0, c, v) for c, v in enumerate(vs)]
    rows = layer("a", "field", "NDMI", "2024-05-01", [1.0, 3.0]) + layer("b", "field", "NDMI", "2024-06-01", [0.0, 0.0]) + layer("c", "field", "NDVI", "2024-05-01", [2.0, None]) + layer("d", "peer", "NDVI", "2024-05-01", [-1.0, -2.0])
    got = one(zonal.zonal_statistics(cells, frame(spark, rows, "layer string, residual_type string, feature string, obs_date string, row int, col int, z double"), ["k"]))
    assert got["source_detection_count"] == 2 and got["repeated_seasons"] == 1 and got["anomalous_dates"] == ["2024-05-01"] and got["per_feature_max"] == {"NDMI": 3.0, "NDVI": 2.0} and got["per_feature_mean"]["NDMI"] == 1.0
    assert abs(got["mean_anomaly"] - 3 / 7) < 1e-12 and got["peer_residual_max"] == -1.0 and got["temporal_residual_max"] is None and got["residual_types_present"] == ["field", "peer"]


# geometry -------------------------------------------------------------------------------------


def test_polygon_kernels():
    a, b = polygons.box(0, 0, 10, 10), polygons.box(5, 5, 15, 15)
    assert polygons.intersection_area(a, b) == 25 and abs(polygons.iou(a, b) - 25 / 175) < 1e-12 and polygons.distance(a, polygons.box(13, 14, 20, 20)) == 5
    holed = {"kind": "polygon", "parts": [[[[0, 0], [10, 0], [10, 10], [0, 10]], [[2, 2], [2, 8], [8, 8], [8, 2]]]]}
    assert polygons.area(holed) == 64 and polygons.intersection_area(holed, polygons.box(1, 1, 9, 9)) == 64 - 36 and polygons.distance(holed, polygons.box(4, 4, 5, 5)) == 2
    tri = {"kind": "polygon", "parts": [[[[0, 0], [4, 0], [0, 4]]]]}
    assert abs(polygons.intersection_area(tri, polygons.box(0, 0, 2, 2)) - 4) < 1e-12 and abs(polygons.intersection_area(tri, polygons.box(1, 1, 9, 9)) - 2) < 1e-12
    assert polygons.centroid(holed) == (5, 5) and polygons.distance_to_border(polygons.box(20, 20, 40, 40), polygons.box(0, 0, 100, 100)) == 20
    assert polygons.self_crossing({"kind": "polygon", "parts": [[[[0, 0], [2, 2], [2, 0], [0, 2]]]]}) and not polygons.self_crossing(holed)
    m = polygons.metrics(polygons.box(0, 0, 10, 20))
    assert m["perimeter_m"] == 60 and m["elongation"] == 2 and abs(m["circularity"] - 4 * math.pi * 200 / 3600) < 1e-12


def test_outlines():
    r = np.random.default_rng(1)
    for _ in range(40):
        mask = r.random((7, 8)) < 0.55
        cells = list(zip(*map(lambda a: a.tolist(), np.nonzero(mask)), strict=True))
        if not cells:
            continue
        g = polygons.outline(cells, 10.0, 100.0, 500.0)
        assert abs(polygons.area(g) - 100 * len(cells)) < 1e-6
        sides = sum((rr + a, cc + b) not in set(cells) for rr, cc in cells for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)))
        assert abs(polygons.length(g) - 10 * sides) < 1e-6
        centres = np.array([(100 + 10 * c + 5, 500 - 10 * rr - 5) for rr, c in np.ndindex(7, 8)])
        assert (polygons.inside(g, centres) == mask.ravel()).all()


def test_cell_metrics_equal_outlines(spark):
    cells = [(0, 0), (0, 1), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2)]
    got = one(shapes.cell_metrics(frame(spark, [("k", *c) for c in cells], "k string, row int, col int"), "k", 10.0))
    want = polygons.metrics(polygons.outline(cells, 10.0))
    assert all(abs(got[m] - want[m]) < 1e-9 for m in shapes.METRICS)


def boxes(spark, rows, key="k"):
    return frame(spark, [(i, *map(float, b)) for i, b in rows], f"{key} string, minx double, miny double, maxx double, maxy double")


def test_field_context(spark):
    fields = boxes(spark, [("f1", (0, 0, 100, 100)), ("f2", (100, 0, 200, 100))], "f").withColumn("n", F.col("f"))
    got = {r["k"]: r for r in spatial.field_context(boxes(spark, [("in", (20, 20, 40, 40)), ("edge", (90, 20, 130, 40)), ("out", (500, 500, 510, 510)), ("tie", (90, 50, 110, 60))]), fields, "k", "f", "n", 64.0, 15.0).collect()}
    assert got["in"]["field_id"] == "f1" and got["in"]["distance_to_field_edge_m"] == 20 and not got["in"]["near_field_edge"]
    assert got["edge"]["field_id"] == "f2" and got["edge"]["distance_to_field_edge_m"] == 0 and got["edge"]["field_context_flags"] == ["near_field_edge"]
    assert got["out"]["field_id"] == "" and got["out"]["distance_to_field_edge_m"] is None and got["out"]["field_context_flags"] == ["missing_field_context"] and got["tie"]["field_id"] == "f1"


def test_landcover(spark):
    cover = frame(spark, [("crops", 0.0, 0.0, 6.0, 10.0), ("trees", 6.0, 0.0, 10.0, 10.0), ("sand", 50.0, 50.0, 60.0, 60.0)], "c string, minx double, miny double, maxx double, maxy double")
    got = {r["k"]: r for r in spatial.landcover_context(boxes(spark, [("a", (0, 0, 10, 10)), ("b", (0, 0, 5, 5)), ("c", (50, 50, 55, 55))]), cover, "k", "c", {"cropland": ["crops"], "forest": ["trees"]}, 8.0).collect()}
    assert got["a"]["landcover_branch"] == "mixed" and got["a"]["dominant_landcover_branch"] == "cropland" and got["a"]["landcover_proportions"] == {"cropland": 0.6, "forest": 0.4}
    assert got["b"]["landcover_branch"] == "cropland" and got["c"]["landcover_branch"] == "unknown"
    assert spatial.assumed_landcover(boxes(spark, [("a", (0, 0, 1, 1))]), "cropland").first()["landcover_branch"] == "cropland"


def test_risks(spark):
    o = boxes(spark, [("a", (0, 0, 10, 10))]).withColumns({"support_pixel_count": F.lit(None).cast("double"), "elongation": F.lit(5.0)})
    near, over, far = boxes(spark, [("r", (12, 0, 14, 10))]), boxes(spark, [("x", (5, 5, 6, 6))]), boxes(spark, [("w", (5000, 0, 5001, 1))])
    got = one(spatial.risk_filters(o, {"roads": near, "built_up": over, "excluded_zones": over, "quarries": over, "water": far}, "k", 32.0, {"roads": 5.0}, disabled=("linear_objects", "irrigation")))
    assert got["false_positive_penalty"] == 1.45 and got["false_positive_flags"] == ["built_up_risk", "excluded_zone_risk", "quarry_risk", "road_risk"]
    assert got["road_distance_m"] == 2 and got["water_distance_m"] == 4990 and got["irrigation_distance_m"] is None
    assert got["missing_data_flags"] == ["missing_context_cloud_shadows", "missing_context_harvest_patterns", "missing_context_woody_patches"]


def test_nearest_of_many_copies(spark, monkeypatch):
    """Copies of objects and contexts in the same places: each object has its distance, and the search handles each place once."""
    sizes, write = [], spatial.staged
    monkeypatch.setattr(spatial, "staged", lambda df, tag: (out := write(df, tag), sizes.append(out.count()))[0])
    place = {"minx": F.col("id") % 7 * 1000.0, "miny": F.col("id") % 5 * 10.0}
    rows = lambda n: spark.range(n).withColumns(place).withColumns({"maxx": F.col("minx") + 10, "maxy": F.col("miny") + 10})
    context = {"roads": rows(6_000).drop("id").withColumn("minx", F.col("minx") + 3000).withColumn("maxx", F.col("maxx") + 3000)}
    objects = rows(4_000).unionByName(rows(1).select(F.lit(4_000).cast("long").alias("id"), *[F.lit(None).cast("double").alias(c) for c in spatial.BOX]))
    got = spatial.nearest_distances(objects, context, "id").toPandas().set_index("id")["distance"]
    want = {i: max(0.0, 3000 - (x + 10)) if x < 3000 else 0.0 for i in range(35) for x in [i % 7 * 1000]}
    assert sorted(got.index) == list(range(4_000))
    assert all(d == want[i % 35] for i, d in got.items())
    assert max(sizes) <= 36


def test_listed_boxes_are_not_broadcast(spark, tmp_path, monkeypatch):
    """A small table of large boxes is large once it is listed in buckets: neither search sends it through the driver."""
    plans, write = [], spatial.staged
    monkeypatch.setattr(spatial, "staged", lambda df, tag: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if tag == "nearest" else None, write(df, tag))[1])
    boxes(spark, [(f"b{i}", (i, 0, i + 3000, 3000)) for i in range(20)]).write.parquet(str(tmp_path / "b"))
    few = spark.read.parquet(str(tmp_path / "b"))
    plans.append(spatial.bucket_pairs(few, few, 10.0)._jdf.queryExecution().executedPlan().toString())
    assert spatial.nearest_distances(few, {"roads": few.drop("k")}, "k").where("distance = 0").count() == 20
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_bucket_pairs_equal_all_pairs(spark):
    r = np.random.default_rng(8)
    make = lambda n, p: [(f"{p}{i}", (x, y, x + w, y + h)) for i, (x, y, w, h) in enumerate(zip(r.uniform(-100, 100, n), r.uniform(-100, 100, n), r.uniform(0, 60, n), r.uniform(0, 60, n), strict=True))]
    a, b = make(40, "a"), make(40, "b")
    for reach in (0.0, 7.5):
        got = sorted((x["l_k"], x["r_k"]) for x in spatial.bucket_pairs(boxes(spark, a), boxes(spark, b), 25.0, reach).select("l_k", "r_k").collect())
        want = sorted((i, j) for i, p in a for j, q in b if p[0] <= q[2] + reach and q[0] - reach <= p[2] and p[1] <= q[3] + reach and q[1] - reach <= p[3])
        assert got == want


def test_polygon_rasterize(spark):
    tri = {"kind": "polygon", "parts": [[[[0, 0], [30, 0], [0, 30]]]]}
    rows = spatial.with_bounds(frame(spark, [(1, json.dumps(tri)), (2, json.dumps(polygons.box(0, 0, 10, 10)))], "n int, geometry string"))
    got = {(r["row"], r["col"]): r["zone"] for r in spatial.rasterize(rows, "n", "n", 10.0).collect()}
    assert got[0, 0] == 2 and got[0, 2] == 1 and (2, 2) not in got


def test_stable_ids(spark):
    df = frame(spark, [(1, "F 1", 14.9, 25.0, "s"), (2, "F 1", 15.1, 25.0, "s"), (3, None, 0.0, 0.0, "t")], "o int, f string, x double, y double, s string")
    got = {r["o"]: r["candidate_id"] for r in shapes.stable_ids(df, "f", "x", "y", "s", "o").collect()}
    assert got[1].startswith("dyn-f_1-x10y20-") and got[2].startswith("dyn-f_1-x20y20-") and got[3].startswith("dyn-unknownfield-x0y0-")
    twins = shapes.stable_ids(df.withColumn("x", F.lit(14.0)).where("o < 3"), "f", "x", "y", "s", "o").orderBy("o").collect()
    assert twins[0]["candidate_id"].endswith("-01") and twins[1]["candidate_id"].endswith("-02")


# linkage -------------------------------------------------------------------------------------


def centred(df):
    return df.withColumns({"cx": (F.col("minx") + F.col("maxx")) / 2, "cy": (F.col("miny") + F.col("maxy")) / 2})


def test_fusion(spark):
    static = centred(boxes(spark, [("s1", (0, 0, 10, 10)), ("s2", (1, 0, 11, 10)), ("s3", (900, 900, 910, 910))])).withColumn("flags", F.array(F.lit("built_up_risk"), F.lit("elongated")))
    dynamic = centred(boxes(spark, [("d1", (12, 0, 22, 10)), ("d2", (5000, 0, 5010, 10))], "d"))
    got = {r["candidate_id"]: r for r in linkage.fuse(static, dynamic, "k", "d", 50.0, {"centroid_m": 20.0}).collect()}
    assert set(got) == {"fused-s1-d1", "static-s2", "static-s3", "dynamic-d2"} and got["fused-s1-d1"]["false_positive_flags"] == ["built_up_risk"] and got["dynamic-d2"]["false_positive_penalty"] == 0


def test_fusion_of_copies_equals_one_loop(spark, monkeypatch):
    """Many ids in the same places, ties, ids with two shapes: the matching of all pairs, but no table of them is written."""
    from orrery.operators import components

    sizes = []
    for module in (linkage, components):
        monkeypatch.setattr(module, "staged", lambda df, tag, write=components.staged: (out := write(df, tag), sizes.append((tag, out.count())))[0], raising=False)
    r = np.random.default_rng(7)
    spots = [(0, 0, 10, 10), (2, 0, 12, 10), (0, 2, 10, 12), (4, 4, 14, 14), (500, 0, 510, 10), (505, 0, 515, 10), (900, 900, 910, 910)]
    a = [(int(i), spots[k]) for i, k in zip(r.permutation(260), r.integers(0, 7, 260), strict=True)]
    b = [(int(i), tuple(x + 3 for x in spots[k])) for i, k in zip(r.permutation(230), r.integers(0, 6, 230), strict=True)]
    a, b = [*a, (5, (0, 0, 10, 10)), (17, (500, 0, 510, 10))], [*b, (3, (503, 3, 513, 13)), (None, (3, 3, 13, 13))]
    side = lambda rows, k: centred(frame(spark, [(i, *map(float, x)) for i, x in rows], f"{k} long, minx double, miny double, maxx double, maxy double"))
    static, dynamic = side(a, "s"), side(b, "d")
    pairs = linkage.fusion_pairs(static, dynamic, "s", "d", 50.0, {"centroid_m": 6.0}).collect()
    options = {}
    for p in pairs:
        if p["d"] is not None:
            options.setdefault(p["s"], []).append((-p["iou"], p["distance"], str(p["d"]), p["d"]))
    used, want = set(), []
    for s in sorted(options, key=str):
        free = sorted(o for o in options[s] if o[3] not in used)
        if free:
            used.add(free[0][3])
            want.append((s, free[0][3]))
    sizes.clear()
    got = linkage.fuse(static, dynamic, "s", "d", 50.0, {"centroid_m": 6.0}).where("evidence_class = 'static_dynamic'").select(F.col("source_static_candidate_id").cast("long"), F.col("source_dynamic_object_id").cast("long")).distinct().collect()
    assert len(want) > 150 and sorted(map(tuple, got)) == sorted(want)
    assert len(pairs) > 10_000 and max(n for _, n in sizes) <= 300


def test_fusion_of_many_rows_without_a_partner(spark, monkeypatch):
    """Rows that overlap nothing are not written for the matching, and the result doesn't collect them in one task."""
    from orrery.operators import components

    sizes = []
    for module in (linkage, components):
        monkeypatch.setattr(module, "staged", lambda df, tag, write=components.staged: (out := write(df, tag), sizes.append((tag, out.count())))[0])
    far = [(i, (9000, 9000, 9010, 9010)) for i in range(10, 410)]
    side = lambda rows, k: centred(frame(spark, [(i, *map(float, x)) for i, x in rows], f"{k} long, minx double, miny double, maxx double, maxy double"))
    static = side([*far, *((i, (100 * i, 0, 100 * i + 10, 10)) for i in range(10)), (3, (9000, 9000, 9010, 9010)), (None, (0, 0, 10, 10))], "s")
    dynamic = side([*((i, (100 * i + 2, 0, 100 * i + 12, 10)) for i in range(8)), *((i, (5000, 0, 5010, 10)) for i in range(10, 210))], "d")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = linkage.fuse(static, dynamic, "s", "d", 50.0, {"centroid_m": 6.0}).select("candidate_id", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ids = [r["candidate_id"] for r in got]
    assert sorted(i for i in ids if i is not None) == sorted([*(f"fused-{i}-{i}" for i in range(8)), "fused-3-3", "static-8", "static-9", *(f"static-{i}" for i, _ in far), *(f"dynamic-{i}" for i in range(10, 210))])
    assert len(ids) == len([i for i in ids if i is not None]) + 1
    assert max(n for _, n in sizes) < 50
    parts = [r["part"] for r in got if (r["candidate_id"] or "").startswith("static-")]
    assert max(parts.count(p) for p in set(parts)) < 0.6 * len(parts)


def test_greedy_equals_one_loop(spark):
    r = np.random.default_rng(3)
    pairs = {(f"l{i:02d}", f"r{j}"): (round(float(r.random()), 2), round(float(r.random()), 1)) for i in range(25) for j in range(25) if r.random() < 0.12}
    got = sorted(map(tuple, linkage.greedy_matches(frame(spark, [(a, b, *v, a) for (a, b), v in pairs.items()], "l string, r string, iou double, distance double, o string"), "l", "r", "o").collect()))
    used, want = set(), []
    for a in sorted({p[0] for p in pairs}):
        free = sorted((-v[0], v[1], b) for (x, b), v in pairs.items() if x == a and b not in used)
        if free:
            used.add(free[0][2])
            want.append((a, free[0][2]))
    assert got == sorted(want)


def labels(spark, rows):
    return frame(spark, [(i, n, lab, "", "", "") for n, (i, lab) in enumerate(rows)], "candidate_id string, ordinal int, expert_label string, expert_confidence string, false_positive_reason string, reviewer_notes string")


def shaped(spark, rows):
    return frame(spark, [(i, f, *map(float, b)) for i, f, b in rows], "candidate_id string, field_id string, minx double, miny double, maxx double, maxy double")


def test_migration_ladder(spark):
    old = [("a", "f", (0, 0, 10, 10)), ("b", "f", (100, 0, 110, 10)), ("c", "f", (200, 0, 210, 10)), ("d", "f", (300, 0, 310, 10)), ("e", "f", (400, 0, 410, 10)), ("g", "f", (500, 0, 510, 10)), ("h", "f", (600, 0, 610, 10)), ("h", "f", (600, 0, 610, 10)), ("i", "f", (700, 0, 710, 10))]
    new = [("a", "f", (1, 0, 11, 10)), ("n1", "f", (101, 0, 111, 10)), ("n2", "f", (220, 0, 230, 10)), ("n3", "f", (300, 0, 310, 10)), ("n4", "f", (300, 0, 310, 10)), ("e", "f", (900, 0, 910, 10)), ("n5", "other", (500, 0, 510, 10)), ("n6", "f", (700, 0, 710, 10))]
    got = linkage.migrate_labels(labels(spark, [(i, "positive") for i in "abcdeghik"] + [("n", "")]), shaped(spark, old), labels(spark, [(i, "") for i in ("a", "n1", "n2", "n3", "n4", "e", "n5")]), shaped(spark, new), 64.0)
    report = {r["old_candidate_id"]: (r["match_method"], r["migration_status"], r["new_candidate_id"]) for r in got["report"].collect()}
    assert report == {
        "a": ("exact_id", "migrated", "a"), "b": ("field_iou", "migrated", "n1"), "c": ("field_centroid_area", "migrated", "n2"), "d": ("field_iou", "ambiguous", ""), "e": ("exact_id", "geometry_changed", "e"),
        "g": ("", "retired", ""), "h": ("", "missing_or_duplicate_old_geometry", ""), "i": ("field_iou", "migrated_missing_target_row", "n6"), "k": ("", "missing_or_duplicate_old_geometry", ""),
    }
    updated = {r["candidate_id"]: r["expert_label"] for r in got["updated"].collect()}
    assert updated == {"a": "positive", "n1": "positive", "n2": "positive", "n3": "", "n4": "", "e": "", "n5": "", "n6": "positive"}
    assert {r["candidate_id"] for r in got["retired"].collect()} == {"d", "e", "g", "h", "k"} and {r["candidate_id"] for r in got["new_candidates"].collect()} == {"n3", "n4", "e", "n5"}


def test_migration_uses_a_target_once(spark):
    old, new = [("a", "f", (0, 0, 10, 10)), ("b", "f", (1, 0, 11, 10))], [("n", "f", (0, 0, 10, 10))]
    got = linkage.migrate_labels(labels(spark, [("b", "x"), ("a", "y")]), shaped(spark, old), labels(spark, [("n", "")]), shaped(spark, new), 64.0)
    assert {r["old_candidate_id"]: r["migration_status"] for r in got["report"].collect()} == {"b": "migrated", "a": "retired"}


def test_migration_of_copies_equals_one_loop(spark, monkeypatch):
    """Many ids in the same places, equal and repeated ids, repeated rows, blank fields: the ladder over all pairs, but no table of them is written."""
    from orrery.operators import components

    sizes, write = [], components.staged
    for module in (linkage, components):
        monkeypatch.setattr(module, "staged", lambda df, tag: (out := write(df, tag), sizes.append((tag, out.count())))[0], raising=False)
    r = np.random.default_rng(11)
    spots = [(0, 0, 10, 10), (1, 0, 11, 10), (0, 25, 10, 35), (500, 0, 510, 10), (528, 0, 538, 10), (900, 900, 910, 910), (5000, 0, 5004, 4)]
    draw = lambda n, names, kinds: [(i, kinds[k % len(kinds)], spots[j]) for i, k, j in zip(names, r.integers(0, 9, n), r.integers(0, 7, n), strict=True)]
    old = draw(200, [f"c{i}" for i in range(200)], ["f", "g", None])
    new = draw(240, [f"{'cn'[i % 2]}{i}" for i in range(240)], ["f", "f", "g", None])
    old += [(f"z{i}", "h", (100 * i, 3000, 100 * i + 10, 3010)) for i in range(12)]  # alone in their field
    new += [(f"y{i}", "h", (100 * i + 2 + 10 * (i % 2), 3000, 100 * i + 12 + 10 * (i % 2), 3010)) for i in range(9)]
    new += [("n1", "f", spots[0]), ("n1", "f", spots[0]), ("c2", "f", spots[3]), ("y0", "g", spots[1]), ("y3", "h", (312, 3000, 322, 3010))]
    asked = [*(i for i, _, _ in old), "z1", "c0"]
    turns = [*r.permutation(len(old)).tolist(), 1000, 0]
    turns[0] = 0  # c0 twice on one turn
    rows = frame(spark, [(i, int(t), "positive", "", "", "") for i, t in zip(asked, turns, strict=True)], labels(spark, [("a", "b")]).schema)
    got = linkage.migrate_labels(rows, shaped(spark, old), labels(spark, [(i, "") for i in dict.fromkeys(i for i, _, _ in new)]), shaped(spark, new), 64.0)["report"].collect()

    def pair(p, q):
        over = max(min(p[2], q[2]) - max(p[0], q[0]), 0) * max(min(p[3], q[3]) - max(p[1], q[1]), 0)
        area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
        gap = (((p[0] + p[2] - q[0] - q[2]) / 2) ** 2 + ((p[1] + p[3] - q[1] - q[3]) / 2) ** 2) ** 0.5
        return over / (area(p) + area(q) - over) >= 0.6, gap <= 30 and 0.5 <= area(q) / area(p) <= 2

    where, groups, used, want, made = {i: (f, b) for i, f, b in old}, {}, set(), [], 0
    for i, t in zip(asked, turns, strict=True):
        groups.setdefault((t, i), []).append(i)
    for (_, i), times in sorted(groups.items()):
        f, box = where[i]
        free = [(n, g, *pair(box, b)) for n, g, b in new for _ in times if n not in used]
        own, near = [x for x in free if x[0] == i], [x for x in free if f is not None and x[1] == f]
        high, close = [x for x in near if x[2]], [x for x in near if x[3]]
        made += len({x[0] for x in near if x[2] or x[3]})
        if own:
            status, method, to = ("ambiguous", "exact_id", "") if len(own) > 1 else ("migrated" if own[0][2] or own[0][3] else "geometry_changed", "exact_id", i)
        else:
            method, part = ("field_iou", high) if high else ("field_centroid_area", close) if close else ("", [])
            status, to = ("migrated", part[0][0]) if len(part) == 1 else ("ambiguous" if part else "retired", "")
        if status == "migrated":
            used.add(to)
        want += [(i, to, method, status)] * len(times)
    assert sorted((x["old_candidate_id"], x["new_candidate_id"], x["match_method"], x["migration_status"]) for x in got) == sorted(want)
    assert len({w[2:] for w in want}) >= 6 and made > 2000 and max(n for _, n in sizes) < made / 2


def test_components(spark):
    links = frame(spark, [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["id"]: r["comp"] for r in components.connected_components(links).collect()}
    assert set(got) == {*range(1, 41), 100, 101} and {got[i] for i in range(1, 41)} == {1} and got[101] == 100
    assert components.connected_components(links.where("false")).count() == 0


# review ---------------------------------------------------------------------------------------


def test_ranks(spark):
    df = frame(spark, [("b", 0.5), ("a", 0.5), ("c", None), ("d", 0.9), ("e", float("nan")), ("f", 0.0)], "candidate_id string, object_score double")
    for kind in ({}, {"top": 10}):
        got = [(r["rank"], r["candidate_id"]) for r in review.ranked(df, **kind).orderBy("rank").collect()]
        assert got == [(1, "d"), (2, "a"), (3, "b"), (4, "c"), (5, "e"), (6, "f")]
    assert review.ranked(df, top=2).count() == 2 and review.ranked(df, top=-1).count() == 0
    assert review.ranked(df.where("false")).count() == 0


def test_ranks_over_many_tasks(spark):
    """Equal scores are split by id; every row has its own rank, and no task holds most of them."""
    rows = spark.range(4000).select(F.format_string("c%05d", (F.col("id") * 7919) % 4000).alias("candidate_id"), F.when(F.col("id") % 4 == 0, F.col("id") % 5 / 5.0).otherwise(0.25).alias("object_score"))
    got = review.ranked(rows.repartition(5)).collect()
    want = sorted(rows.collect(), key=lambda r: (-r["object_score"], r["candidate_id"]))
    assert [r["candidate_id"] for r in sorted(got, key=lambda r: r["rank"])] == [r["candidate_id"] for r in want]
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 4001))


def test_merged_statistics(spark):
    rows = [
        ("g", 0.2, 0.5, 2, ["NDMI"], ["a"], ["2021-05-01"], ["field"], {"NDMI": 0.2}, {"NDMI": 0.5}, 0.1, None),
        ("g", 0.4, float("nan"), 3, ["NDVI", "NDMI"], ["b", "a"], ["2022-05-01", "2021-05-01"], ["peer"], {"NDMI": 0.6, "NDVI": 0.3}, {"NDMI": 0.4, "NDVI": float("nan")}, float("nan"), None),
        ("h", 0.1, 0.1, None, [], [], [], [], {}, {}, 0.0, 2.0),
    ]
    schema = "part string, mean_anomaly double, max_anomaly double, source_detection_count int, source_feature_names array<string>, source_layer_ids array<string>, anomalous_dates array<string>, residual_types_present array<string>, per_feature_mean map<string,double>, per_feature_max map<string,double>, ringness_score double, peer_residual_max double"
    from orrery.operators import zonal

    got = {r["part"]: r for r in zonal.merged_statistics(frame(spark, rows, schema), "part").collect()}
    g, h = got["g"], got["h"]
    assert abs(g["mean_anomaly"] - 0.3) < 1e-12 and g["max_anomaly"] == 0.5 and g["source_detection_count"] == 5 and g["merged_detections"] == 2 and g["repeated_seasons"] == 2
    assert g["source_feature_names"] == ["NDMI", "NDVI"] and g["source_layer_ids"] == ["a", "b"] and g["residual_types_present"] == ["field", "peer"]
    assert abs(g["per_feature_mean"]["NDMI"] - 0.4) < 1e-12 and g["per_feature_max"] == {"NDMI": 0.5} and g["ringness_score"] == 0.1 and g["peer_residual_max"] is None
    assert h["source_detection_count"] == 0 and h["per_feature_mean"] == {} and h["repeated_seasons"] == 0 and h["peer_residual_max"] == 2.0


def test_short_numbers(spark):
    values = [0.5, 1234567.0, 0.000012345678, 100.0, -2.5, 0.1234567, 999999.5, 12345.678, 1e-5, 0.0]
    got = [r[0] for r in frame(spark, [(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(review.short_number(F.col("v"))).collect()]
    assert [float(g) for g in got] == [float(f"{v:.6g}") for v in values] and got[0] == "0.5" and got[3] == "100" and got[9] == "0"


def test_precision_and_recall(spark):
    scores = frame(spark, [("a", "1"), ("b", "2"), ("c", "x")], "candidate_id string, rank string")
    given = frame(spark, [("a", 1, "positive"), ("b", 1, "positive"), ("b", 2, "Hard Negative"), ("c", 1, "uncertain"), ("", 1, "positive")], "candidate_id string, ordinal int, expert_label string")
    got = one(review.precision_at(scores, given, 3))
    assert got["precision"] == 0.5 and got["positive_count"] == got["negative_count"] == 1
    assert one(review.precision_at(scores, given.where("false"), 3))["precision"] is None
    sites = frame(spark, [("s",), ("t",)], "site string")
    recall = {r["n"]: r["recall"] for r in review.recall_at(frame(spark, [("s", 1), ("t", 3)], "site string, rank int"), sites, "site", "rank", (1, 2, 3, 0, 3)).collect()}
    assert recall == {1: 0.5, 2: 0.5, 3: 1.0}


def test_learning_rows(spark):
    scores = frame(spark, [("a", "f1"), ("b", ""), ("c", "")], "candidate_id string, field_id string")
    given = frame(spark, [("a", 1, "positive", ""), ("a", 2, " weak-positive", ""), ("b", 1, "hard_negative", "road")], "candidate_id string, ordinal int, expert_label string, false_positive_reason string")
    got = {r["candidate_id"]: r for r in review.learning_rows(scores, given).collect()}
    assert got["a"]["model_label"] == "weak_positive" and got["a"]["split_group"] == "field:f1" and got["b"]["pu_role"] == "hard_negative_control" and got["c"]["model_label"] == "unlabeled" and got["c"]["label_source"] == "detector_export"
    for bad in ([("a", 1, "maybe", "")], [("a", 1, "hard_negative", " ")]):
        with pytest.raises(Exception, match="maybe|requires false_positive_reason"):
            review.learning_rows(scores, frame(spark, bad, "candidate_id string, ordinal int, expert_label string, false_positive_reason string")).collect()


def test_static_detector(spark):
    df = frame(spark, [(json.dumps(polygons.box(0, 0, 100, 100)),), (json.dumps(polygons.box(0, 0, 400, 50)),), (json.dumps({"kind": "polygon", "parts": [polygons.box(0, 0, 60, 60)["parts"][0], polygons.box(80, 0, 140, 60)["parts"][0]]}),)], "geometry string")
    got = shapes.static_candidates(shapes.polygon_metrics(df), landcover="Built_Up").collect()
    assert [r["morphology_type"] for r in got] == ["ellipse", "chain", "chain"] and abs(got[0]["static_score"] - 0.45) < 1e-12 and got[2]["flags"] == ["multi_part", "built_up_risk"] and abs(got[1]["static_score"] - 0.35) < 1e-12
