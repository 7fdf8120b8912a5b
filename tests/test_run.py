"""End to end on a drawn stack: two wet patches on a valley floor of 16 by 12 pixels, 20 m each."""

from __future__ import annotations

import csv
import json

import numpy as np
import pytest
import yaml

from orrery.functions import polygons
from orrery.plans import cli
from orrery.sources import pixels, vectors
from orrery.sources.config import load_config
from orrery.sources.manifest import ManifestError, load_manifest, weather_records

CRS = "EPSG:32637"


def collection(shapes, crs=CRS):
    return {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": crs}}, "features": [{"type": "Feature", "properties": p, "geometry": g} for p, g in shapes]}


def square(x0, y0, x1, y1):
    return polygons.to_geojson(polygons.box(x0, y0, x1, y1))


ROWS, COLS, CELL, WEST, NORTH = 12, 16, 20.0, 3000.0, 7240.0
EAST, SOUTH = WEST + COLS * CELL, NORTH - ROWS * CELL
#: Rows and columns of the two patches: 4 by 4 and 2 by 4 pixels, an eighth of the scene.
LARGE, SMALL = (slice(2, 6), slice(9, 13)), (slice(8, 10), slice(2, 6))
#: Ground and patch of each layer.
LEVELS = {"NDMI": (0.42, 0.11), "NDVI": (0.55, 0.21), "BSI": (0.15, 0.63)}


def middle(patch):
    """Coordinates of a patch's centre."""
    r, c = patch
    return WEST + CELL * (c.start + c.stop) / 2, NORTH - CELL * (r.start + r.stop) / 2


def config_of():
    part = lambda inputs, weight: {"inputs": inputs, "high_score_means": "wetter", "weight": weight}
    off = ("water", "built_up", "field_edges", "linear_objects", "cloud_shadows", "harvest_patterns", "irrigation", "quarries")
    return {
        "project": {"name": "valley", "version": "3"}, "aoi": {"name": "valley floor", "input_geojson": "aoi.geojson"}, "time": {"start_year": 2021, "end_year": 2021, "vegetation_months": [7], "bare_soil_months": [7]},
        "land_cover": {"primary_branch": "cropland", "classes": {"cropland": ["arable"], "forest": ["wood"]}, "mixed_candidate_min_classes": 2},
        "object_constraints": {"min_diameter_m": 12.0, "max_diameter_m": 240.0, "min_area_ha": 0.05, "max_area_ha": 6.0, "min_distance_to_field_edge_m": 8.0},
        "dynamic_detector": {"anomaly_percentile": 88.0, "min_valid_observations_per_season": 1, "min_repeated_seasons": 1},
        "false_positive_filters": {f"flag_{n}": False for n in off},
        "anomaly_components": {"moisture": part(["NDMI"], 0.5), "vegetation_stress": part(["NDVI"], 0.3), "soil_brightness": part(["BSI"], 0.2)},
        "scoring": {"priority_thresholds": {"A": 0.8, "B": 0.6, "C": 0.3, "D": 0.0}, "cropland": {"moisture_weight": 0.5, "vegetation_weight": 0.3, "brightness_weight": 0.2}},
        "validation": {"top_n": 12, "known_site_recall_top_n": [1, 12]}, "outputs": {"candidates_top_n": 1, "generate_quicklooks": True},
    }


@pytest.fixture()
def stack(tmp_path):
    """Three layers over one field, a track along the large patch, and sites: in the large patch, in the small one (refuted), far from both."""
    transform = (CELL, 0.0, WEST, 0.0, -CELL, NORTH)
    layers = []
    for name, (ground, patch) in LEVELS.items():
        v = np.full((ROWS, COLS), ground)
        v[LARGE] = v[SMALL] = patch
        v[11, 0] = -1
        (tmp_path / f"{name}.tif").write_bytes(pixels.write_tiff(v, transform, -1, 32637))
        layers.append({"id": f"july_{name.lower()}", "sensor": "sentinel2", "feature_name": name, "date": "2021-07-19", "path": f"{name}.tif", "crs": CRS, "resolution_m": CELL, "nodata": -1, "role": "input_feature"})
    clear = np.ones((ROWS, COLS))
    clear[0, 15] = 0
    (tmp_path / "clear.tif").write_bytes(pixels.write_tiff(clear, transform, None, 32637))
    layers[0]["quality_mask_path"] = "clear.tif"
    site = lambda label, x, y, **more: ({"expert_label": label} | more, {"type": "Point", "coordinates": [x, y]})
    track_y = middle(LARGE)[1] + 5
    drawn = {
        "aoi": [({}, square(WEST, SOUTH, EAST, NORTH))], "fields": [({"parcel": "north-7"}, square(WEST, SOUTH, EAST, NORTH))], "tracks": [({}, {"type": "LineString", "coordinates": [[WEST, track_y], [EAST, track_y]]})],
        "sites": [site("positive", *middle(LARGE), confidence="high"), site("Hard Negative", *middle(SMALL)), site("Positive", EAST - 10, SOUTH + 10)],
    }
    for name, shapes in drawn.items():
        (tmp_path / f"{name}.geojson").write_text(json.dumps(collection(shapes)))
    vector = lambda name, role, required=False, **more: {"path": f"{name}.geojson", "crs": CRS, "role": role, "required": required} | more
    vectors_ = {"fields": vector("fields", "fields", True, id_field="parcel"), "roads": vector("tracks", "roads"), "known_sites": vector("sites", "known_sites"), "water": vector("no_such_file", "water")}
    manifest = {"run": {"id": "valley-july"}, "crs": CRS, "resolution_m": CELL, "aoi": {"path": "aoi.geojson", "crs": CRS}, "vectors": vectors_, "raster_layers": layers, "quality": {}}
    (tmp_path / "manifest.yaml").write_text(yaml.safe_dump(manifest))
    (tmp_path / "config.yaml").write_text(yaml.safe_dump(config_of()))
    return tmp_path


def rows_of(path):
    with open(path, newline="") as f:
        return list(csv.DictReader(f))


def test_run_writes_ranked_candidates(spark, stack):
    out = stack / "out"
    assert cli.main(["run-mvp", "-c", str(stack / "config.yaml"), "-m", str(stack / "manifest.yaml"), "-o", str(out)]) == 0
    scores = rows_of(out / "candidate_scores.csv")
    assert sorted(r["support_pixel_count"] for r in scores) == ["16", "8"] and [r["rank"] for r in scores] == ["1", "2"] and len(scores[0]) == 55
    large, small = sorted(scores, key=lambda r: -int(r["support_pixel_count"]))
    assert float(large["area_m2"]) == 16 * CELL**2 and float(small["area_m2"]) == 8 * CELL**2
    for r, patch in ((large, LARGE), (small, SMALL)):
        x, y = middle(patch)
        assert r["candidate_id"].startswith(f"dyn-north-7-x{x:.0f}y{y:.0f}-") and r["field_id"] == "north-7"
        assert json.loads(r["source_feature_names"]) == ["BSI", "NDMI", "NDVI"] and json.loads(r["anomalous_dates"]) == ["2021-07-19"]
        assert {"missing_sentinel2_EVI", "landcover_context_assumed_cropland_fields", "missing_context_woody_patches"} <= set(json.loads(r["missing_data_flags"]))
        assert "missing_context_water" not in r["missing_data_flags"]
    assert json.loads(large["false_positive_flags"]) == ["road_risk"] and float(large["road_distance_m"]) == 0 and float(large["false_positive_penalty"]) == 0.3
    assert json.loads(small["false_positive_flags"]) == ["small_object_risk"] and abs(float(small["road_distance_m"]) - (middle(LARGE)[1] + 5 - (middle(SMALL)[1] + CELL))) < 1e-6
    shapes = json.loads((out / "candidates.geojson").read_text())
    assert {f["properties"]["candidate_id"] for f in shapes["features"]} == {r["candidate_id"] for r in scores}
    assert sorted(polygons.area(polygons.from_geojson(f["geometry"])) for f in shapes["features"]) == [8 * CELL**2, 16 * CELL**2]
    assert len(rows_of(out / "labeling_table.csv")) == 1 and len(list((out / "passports").glob("*.md"))) == 1 and len(list((out / "quicklooks").glob("*.png"))) == 1
    assert len(rows_of(out / "learning_dataset.csv")) == 2 and {r["pu_role"] for r in rows_of(out / "learning_dataset.csv")} == {"unlabeled_pool"}
    summary = json.loads((out / "validation_summary.json").read_text())
    assert summary["candidate_count"] == 2 and summary["known_site_recall_at_n"]["top_12"] == 0.5
    assert summary["known_site_label_counts"] == {"hard_negative": 1, "positive": 2} and summary["known_site_confidence_counts"] == {"high": 1, "unknown": 2}
    assert summary["expert_precision_top_n"] == {"top_n": 12, "precision": None, "reviewed_count": 0, "positive_count": 0, "negative_count": 0} and "missing_expert_labels" in summary["missing_data_flags"]
    assert "hydrogen" in (out / "passports").glob("*.md").__next__().read_text()
    told = rows_of(out / "rank_explanations.csv")[0]
    assert "this is not direct H2 detection" in told["explanation"]
    # the same run with a reviewed table
    (stack / "reviewed.csv").write_text(f"candidate_id,expert_label,false_positive_reason\n{large['candidate_id']},positive,\n")
    cli.main(["run-mvp", "-c", str(stack / "config.yaml"), "-m", str(stack / "manifest.yaml"), "-o", str(out), "--labels", str(stack / "reviewed.csv")])
    summary = json.loads((out / "validation_summary.json").read_text())
    assert summary["expert_precision_top_n"] == {"top_n": 12, "precision": 1.0, "reviewed_count": 1, "positive_count": 1, "negative_count": 0} and "partial_expert_labels" in summary["missing_data_flags"]


def test_quicklook_outlines():
    import zlib

    from orrery.plans import reports

    values, zones = np.linspace(0, 1, 48).reshape(6, 8), np.repeat([[1] * 4 + [2] * 4], 6, axis=0)
    data = reports.quicklook(values, np.array([(2, 2), (2, 3), (3, 2)]), zoom=6, zones=zones)
    at = data.index(b"IDAT")
    size = int.from_bytes(data[at - 4 : at], "big")
    rows = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + size]), dtype=np.uint8).reshape(36, 1 + 48 * 3)[:, 1:].reshape(36, 48, 3)
    red, yellow = (rows == (230, 30, 30)).all(axis=2), (rows == (240, 210, 40)).all(axis=2)
    assert red[12, 12:24].all() and red[12:18, 11].all() and not red[14, 14] and not red[:10].any() and not red[26:].any()
    assert yellow[0, 23] and yellow[35, 24] and not yellow[:, :22].any() and not yellow[:, 26:].any()


def test_switched_off_outputs_are_removed(spark, stack):
    c = config_of()
    c["outputs"] = {"export_csv": False, "export_geojson": False, "generate_passports": False, "export_time_series": False, "export_validation_summary": False, "export_resolved_config": False}
    (stack / "config.yaml").write_text(yaml.safe_dump(c))
    out = stack / "out"
    out.mkdir()
    (out / "candidate_scores.csv").write_text("old")
    cli.main(["run-mvp", "-c", str(stack / "config.yaml"), "-m", str(stack / "manifest.yaml"), "-o", str(out)])
    assert not {"candidate_scores.csv", "candidates.geojson", "validation_summary.json", "resolved_config.json"} & {p.name for p in out.iterdir()}
    assert (out / "labeling_table.csv").exists() and not list((out / "passports").iterdir())


def test_strict_inputs(tmp_path, stack):
    c = config_of() | {"surprise": 1}
    (tmp_path / "bad.yaml").write_text(yaml.safe_dump(c))
    with pytest.raises(ValueError):
        load_config(tmp_path / "bad.yaml")
    m = yaml.safe_load((stack / "manifest.yaml").read_text())
    for change in ({"extra": 1}, {"raster_layers": m["raster_layers"] * 2}, {"vectors": {"fields": m["vectors"]["fields"] | {"required": "yes"}}}):
        (tmp_path / "m.yaml").write_text(yaml.safe_dump(m | change))
        with pytest.raises(ManifestError):
            load_manifest(tmp_path / "m.yaml")
    assert weather_records([{"date": "2024-06-01", "precipitation_mm": "3"}, {"date": "2024-05-01", "source_id": "a"}]) == [("2024-05-01", None, "a"), ("2024-06-01", 3.0, "weather_event_2024-06-01")]
    for bad in ({"date": "May"}, {"date": "2024-05-01", "rainfall_mm": True}, {"date": "2024-05-01", "x": 1}):
        with pytest.raises(ManifestError):
            weather_records([bad])


def test_tiff_round_trip():
    v = np.arange(12.0).reshape(3, 4)
    v[1, 2] = -9999
    t = pixels.read_tiff(pixels.write_tiff(v, (10.0, 0.0, 5.0, 0.0, -10.0, 50.0), -9999, 32637))
    assert np.isnan(t["values"][1, 2]) and t["values"][2, 3] == 11 and t["transform"] == (10.0, 0.0, 5.0, 0.0, -10.0, 50.0) and t["epsg"] == 32637
    with pytest.raises(pixels.RasterError):
        pixels.read_tiff(b"II+\0" + b"\0" * 20)


def packed(values, kind, packing=1, predictor=1, tile=None, big=False, strip=None):
    """A TIFF written plainly for the reader's tests: any sample type, packing, predictor, strips or tiles, classic or big."""
    import struct
    import zlib

    import zstandard

    def runs(data):
        return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100))

    def words(data):
        table, out, held, bits, width, word = {bytes([i]): i for i in range(256)}, bytearray(), 0, 0, 9, b""

        def put(code):
            nonlocal held, bits
            held, bits = (held << width) | code, bits + width
            while bits >= 8:
                bits -= 8
                out.append(held >> bits & 255)
            held &= (1 << bits) - 1

        put(256)
        size = 258
        for b in data:
            new = word + bytes([b])
            if new in table:
                word = new
                continue
            put(table[word])
            table[new], size = size, size + 1
            width = max(9, min(12, size.bit_length()))
            if size == 4094:
                put(256)
                table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
            word = bytes([b])
        if word:
            put(table[word])
            size += 1
            width = max(9, min(12, size.bit_length()))
        put(257)
        if bits:
            out.append(held << (8 - bits) & 255)
        return bytes(out)

    pack = {1: bytes, 5: words, 8: zlib.compress, 32773: runs, 50000: lambda d: zstandard.ZstdCompressor().compress(d)}[packing]
    h, w = values.shape
    th, tw = tile or (strip or h, w)
    blocks = []
    for r in range(0, h, th):
        for c in range(0, w, tw):
            part = values[r : r + th, c : c + tw]
            if tile:
                part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1])))
            part = part.astype(kind)
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((part.shape[0], 1), dtype=kind)).astype(kind)
            raw = part.tobytes()
            if predictor == 3:
                planes = part.astype(np.dtype(kind).newbyteorder(">")).view(np.uint8).reshape(part.shape[0], part.shape[1], -1).transpose(0, 2, 1).reshape(part.shape[0], -1)
                raw = np.diff(planes, axis=1, prepend=np.zeros((planes.shape[0], 1), dtype=np.uint8)).astype(np.uint8).tobytes()
            blocks.append(pack(raw))
    start = 16 if big else 8
    offsets = [start + sum(map(len, blocks[:i])) for i in range(len(blocks))]
    form = {"u": 1, "i": 2, "f": 3}[np.dtype(kind).kind]
    entries = {256: (w,), 257: (h,), 258: (np.dtype(kind).itemsize * 8,), 259: (packing,), 277: (1,), 317: (predictor,), 339: (form,)}
    entries |= {322: (tw,), 323: (th,), 324: offsets, 325: list(map(len, blocks))} if tile else {273: offsets, 278: (th,), 279: list(map(len, blocks))}
    at, word, head, entry, inline = start + sum(map(len, blocks)), *(("Q", "Q", 20, 8) if big else ("I", "H", 12, 4))
    table, extra, room = b"", b"", at + struct.calcsize("<" + head) + entry * len(entries) + inline
    for tag, v in sorted(entries.items()):
        raw = struct.pack(f"<{len(v)}{word}", *v)
        if len(raw) > inline:
            raw, extra = struct.pack("<" + word, room + len(extra)), extra + raw
        table += struct.pack("<HH" + word, tag, 16 if big else 4, len(v)) + raw
    first = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)
    return first + b"".join(blocks) + struct.pack("<" + head, len(entries)) + table + bytes(inline) + extra


@pytest.mark.parametrize("packing", [1, 5, 8, 32773, 50000])
def test_tiff_forms(packing):
    r = np.random.default_rng(packing)
    ground = np.cumsum(r.integers(-3, 4, (150, 70)), axis=1)
    for kind, predictor in (("<f4", 3), ("<f8", 3), ("<i2", 2), ("<u2", 1), ("<f8", 1), ("<i4", 2)):
        v = ground / 4 if "f" in kind else np.abs(ground)
        for form in ({}, {"tile": (32, 16)}, {"strip": 40}, {"big": True, "tile": (64, 64)}, {"big": True, "strip": 7}):
            got = pixels.read_tiff(packed(v, kind, packing, predictor, **form))["values"]
            assert got.shape == v.shape and (got == v).all(), (kind, predictor, form)


def test_stack_checks(spark, stack):
    from orrery.sources.manifest import layers_frame

    m = load_manifest(stack / "manifest.yaml")
    layers = layers_frame(spark, m)
    table, grids = pixels.read_layers(spark, layers)
    assert table.count() == 3 * ROWS * COLS and table.where("layer_id = 'july_ndmi' and value is null").count() == 2 and table.where("layer_id = 'july_bsi' and value is null").count() == 1
    area = (WEST, SOUTH, EAST, NORTH)
    pixels.check_stack(layers, grids, CRS, area)
    for crs, box in ((CRS, (WEST, SOUTH, EAST + CELL, NORTH)), ("EPSG:32638", None)):
        with pytest.raises(pixels.RasterError):
            pixels.check_stack(layers, grids, crs, box)


def test_vector_contracts(spark, tmp_path):
    put = lambda name, data: str((tmp_path / name).write_text(json.dumps(data)) and tmp_path / name)
    good = put("a.geojson", collection([({"id": " "}, square(0, 0, 10, 10)), ({"id": "x"}, square(20, 0, 30, 10))]))
    ids = [r["stable_id"] for r in vectors.load_vectors(spark, good, "a", "id").orderBy("ordinal").collect()]
    assert ids[1] == "x" and ids[0].startswith("geom-") and len(ids[0]) == 21
    turned = put("b.geojson", collection([({}, {"type": "Polygon", "coordinates": [[[10, 10], [10, 0], [0, 0], [0, 10], [10, 10]]]})]))
    assert vectors.load_vectors(spark, turned, "b").first()["stable_id"] == ids[0]
    bow = collection([({}, {"type": "Polygon", "coordinates": [[[0, 0], [10, 10], [10, 0], [0, 10], [0, 0]]]})])
    for data in (collection([]), collection([({}, square(0, 0, 1, 1))], "EPSG:4326"), bow, collection([({}, {"type": "Polygon", "coordinates": [[[0, 0], [10, 10], [0, 0]]]})])):
        with pytest.raises(vectors.VectorError):
            vectors.load_vectors(spark, put("c.geojson", data), "c", repair=False)
    mended = vectors.load_vectors(spark, put("c.geojson", bow), "c").first()
    assert mended["repaired"] and mended["area"] == 50
    degrees = put("f.geojson", collection([({}, square(39.0, 52.0, 39.001, 52.001))], "urn:ogc:def:crs:OGC:1.3:CRS84"))
    moved = vectors.load_vectors(spark, degrees, "f", crs=CRS, reproject=True).first()
    assert abs(moved["minx"] - 500_000) < 0.001 and abs(moved["miny"] - 5_761_038.21) < 0.02 and abs(moved["maxx"] - moved["minx"] - 68.64) < 0.1
    lonlat = put("d.geojson", {"type": "Polygon", "coordinates": [[[39, 51], [39.1, 51], [39.1, 51.1], [39, 51]]]})
    with pytest.raises(vectors.VectorError):
        vectors.load_candidates(spark, lonlat)
    with pytest.raises(Exception, match="not supported"):
        vectors.load_candidates(spark, put("e.geojson", collection([({}, {"type": "Point", "coordinates": [500, 500]})]))).collect()


def test_static_candidates(spark, tmp_path, stack):
    ring = [[[x * 40 + 5000, y * 40 + 5000] for x, y in r] for r in ([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)])]
    shapes = [({"candidate_id": "b", "notes": "seen"}, square(1000, 1000, 1060, 1060)), ({}, {"type": "Polygon", "coordinates": ring}), ({}, square(0, 0, 2, 2)), ({}, square(2000, 2000, 2400, 2050))]
    (tmp_path / "in.geojson").write_text(json.dumps(collection(shapes)))
    cli.main(["static-candidates", "-i", str(tmp_path / "in.geojson"), "-c", str(stack / "config.yaml"), "-o", str(tmp_path / "out")])
    scores = {r["candidate_id"]: r for r in rows_of(tmp_path / "out/candidate_scores.csv")}
    assert scores["static-000002"]["morphology_type"] == "ring" and float(scores["static-000002"]["static_score"]) == 0.95 and scores["static-000002"]["rank"] == "1"
    assert scores["static-000003"]["static_score"] == "0.0" and "too_small" in scores["static-000003"]["flags"] and scores["static-000004"]["morphology_type"] == "chain"
    assert scores["b"]["source_notes"] == "seen" and scores["b"]["dynamic_score"] == ""
    order = [f["properties"]["candidate_id"] for f in json.loads((tmp_path / "out/candidates.geojson").read_text())["features"]]
    assert order == ["b", "static-000002", "static-000003", "static-000004"] and len(list((tmp_path / "out/passports").glob("*.md"))) == 4


def test_migrate_and_learning_commands(spark, tmp_path):
    put = lambda name, shapes: (tmp_path / name).write_text(json.dumps(collection(shapes)))
    put("old.geojson", [({"candidate_id": "a", "field_id": "f"}, square(0, 0, 10, 10)), ({"candidate_id": "z", "field_id": "f"}, square(500, 0, 510, 10))])
    put("new.geojson", [({"candidate_id": "n1", "field_id": "f"}, square(1, 0, 11, 10)), ({"candidate_id": "n2", "field_id": "f"}, square(900, 0, 910, 10))])
    (tmp_path / "old.csv").write_text("candidate_id,rank,expert_label,expert_confidence,false_positive_reason,reviewer_notes\na,1,positive,high,,ok\nz,2,hard_negative,,road,\n")
    (tmp_path / "new.csv").write_text("candidate_id,rank,expert_label,expert_confidence,false_positive_reason,reviewer_notes\nn1,1,,,,\nn2,2,,,,\n")
    args = [x for n, f in (("old-labels", "old.csv"), ("old-candidates", "old.geojson"), ("new-labels", "new.csv"), ("new-candidates", "new.geojson"), ("output-dir", "out")) for x in (f"--{n}", str(tmp_path / f))]
    cli.main(["migrate-labels", *args])
    report = {r["old_candidate_id"]: r for r in rows_of(tmp_path / "out/label_migration_report.csv")}
    assert report["a"]["match_method"] == "field_iou" and report["a"]["migration_status"] == "migrated" and report["a"]["iou"] == "0.818182" and report["z"]["migration_status"] == "retired"
    updated = {r["candidate_id"]: r for r in rows_of(tmp_path / "out/updated_labeling_table.csv")}
    assert updated["n1"]["expert_label"] == "positive" and updated["n2"]["expert_label"] == ""
    assert [r["candidate_id"] for r in rows_of(tmp_path / "out/new_candidates.csv")] == ["n2"] and [r["candidate_id"] for r in rows_of(tmp_path / "out/retired_labels.csv")] == ["z"]
    cli.main(["export-learning-dataset", "--scores", str(tmp_path / "new.csv"), "--labels", str(tmp_path / "out/updated_labeling_table.csv"), "--output", str(tmp_path / "learn.csv"), "--run-id", "r1"])
    learned = {r["candidate_id"]: r for r in rows_of(tmp_path / "learn.csv")}
    assert learned["n1"]["pu_role"] == "positive_seed" and learned["n2"]["model_label"] == "unlabeled" and learned["n1"]["run_id"] == "r1"


def test_small_commands(capsys, stack):
    assert cli.main(["status"]) == 0 and cli.main(["validate-config", str(stack / "config.yaml")]) == 0
    assert '"anomaly_percentile": 88.0' in capsys.readouterr().out
