"""Files for reviewers: passports, quicklooks, GeoJSON and CSV, written row by row from ranked tables."""

from __future__ import annotations

import csv
import json
import re
import struct
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from orrery.functions import polygons

GUARD = "A ranked surface anomaly candidate for expert review. It does not detect hydrogen and proves no degassing without expert and field validation."
# The columns of a passport's sections.
_SECTIONS = {
    "Identity": ("candidate_id", "rank", "priority_class", "evidence_class", "passport_path"),
    "Score": ("object_score", "static_score", "dynamic_score", "dominant_evidence"),
    "Shape": ("morphology_type", "area_m2", "diameter_m", "circularity", "elongation", "flags"),
    "Dynamic evidence": ("landcover_branch", "dominant_landcover_branch", "field_id", "anomalous_dates", "source_feature_names", "source_layer_ids", "moisture_anomaly", "vegetation_stress", "soil_brightness_bsi", "thermal_anomaly", "sar_anomaly", "persistence", "post_rain_drying", "geology_context"),
    "Reasons against": ("false_positive_flags", "false_positive_penalty", "false_positive_profile", "missing_data_flags"),
    "Source context": ("source_landcover_context", "source_morphology_type", "source_false_positive_risk", "source_notes"),
}


def _shown(value) -> str:
    if value is None:
        return ""
    if isinstance(value, str) and value.startswith("["):
        try:
            return ", ".join(map(str, json.loads(value)))
        except ValueError:
            return value
    return str(value)


def passport(row: dict) -> str:
    """A Markdown page about one candidate, with its blank review fields."""
    lines = [f"# Candidate {row.get('candidate_id', '')}", "", GUARD, ""]
    for title, names in _SECTIONS.items():
        if title == "Source context" and not any(row.get(n) for n in names):
            continue
        lines += [f"## {title}", "", *(f"- `{n}`: {_shown(row.get(n)) or ('unavailable' if n == 'dynamic_score' else '')}" for n in names), ""]
    return "\n".join([*lines, "## Review", "", *(f"- `{n}`: " for n in ("expert_label", "expert_confidence", "false_positive_reason", "reviewer_notes")), ""])


def safe_stems(ids: list[str]) -> list[str]:
    """File stems for ids in order; repeated ones get -2, -3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for i in ids:
        stem = re.sub(r"[^A-Za-z0-9._-]+", "_", i).strip("._-") or "candidate"
        seen[stem] = seen.get(stem, 0) + 1
        out.append(stem if seen[stem] == 1 else f"{stem}-{seen[stem]}")
    return out


def write_csv(rows: DataFrame, path: Path, order: str | None = None) -> Path:
    """A single CSV file, streamed from the executors in order; null is blank."""
    path.parent.mkdir(parents=True, exist_ok=True)
    rows = rows.orderBy(order) if order else rows
    with path.open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(rows.columns)
        for r in rows.toLocalIterator():
            out.writerow(["" if v is None else v for v in r])
    return path


def write_geojson(rows: DataFrame, path: Path, crs: str | None, order: str, geometry: str = "geometry") -> Path:
    """A feature collection with its CRS; all other columns are properties, lists in JSON text as lists."""
    path.parent.mkdir(parents=True, exist_ok=True)
    head = {"type": "FeatureCollection", **({"crs": {"type": "name", "properties": {"name": crs}}} if crs else {})}

    def value(v):
        if isinstance(v, str) and v[:1] in ("[", "{"):
            try:
                return json.loads(v)
            except ValueError:
                return v
        return v

    with path.open("w", encoding="utf-8") as f:
        f.write(json.dumps(head, sort_keys=True)[:-1] + ', "features": [')
        for i, r in enumerate(rows.orderBy(order).toLocalIterator()):
            d = r.asDict(recursive=True)
            shape = polygons.to_geojson(json.loads(d.pop(geometry)))
            f.write(("," if i else "") + "\n" + json.dumps({"type": "Feature", "properties": {k: value(v) for k, v in d.items()}, "geometry": shape}, sort_keys=True))
        f.write("\n]}\n")
    return path


def png(image: np.ndarray) -> bytes:
    """An RGB image as PNG."""
    h, w, _ = image.shape
    raw = b"".join(b"\0" + image[r].astype(np.uint8).tobytes() for r in range(h))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _edges(labels: np.ndarray, zoom: int) -> np.ndarray:
    """Pixels of the zoomed picture along the sides where neighbouring cells' labels differ."""
    out = np.zeros((labels.shape[0] * zoom, labels.shape[1] * zoom), dtype=bool)
    for r, c in zip(*np.nonzero(labels[1:] != labels[:-1]), strict=True):
        out[(r + 1) * zoom - 1 : (r + 1) * zoom + 1, c * zoom : (c + 1) * zoom] = True
    for r, c in zip(*np.nonzero(labels[:, 1:] != labels[:, :-1]), strict=True):
        out[r * zoom : (r + 1) * zoom, (c + 1) * zoom - 1 : (c + 1) * zoom + 1] = True
    return out


def quicklook(values: np.ndarray, cells: np.ndarray, padding: int = 5, zoom: int = 8, zones: np.ndarray | None = None) -> bytes:
    """The composite around an object as PNG, with the outlines of the object (red) and of the fields (yellow).

    values and zones (a number for each field, 0 outside): a window that starts
    at row and column 0 of cells.
    """
    r0, c0 = np.maximum(cells.min(axis=0) - padding, 0)
    r1, c1 = np.minimum(cells.max(axis=0) + padding + 1, values.shape)
    part = values[r0:r1, c0:c1]
    known = part[np.isfinite(part)]
    low, high = (float(known.min()), float(known.max())) if len(known) else (0.0, 1.0)
    grey = np.where(np.isfinite(part), 40 + 215 * (np.nan_to_num(part) - low) / max(high - low, 1e-9), 0)
    own = np.zeros(part.shape, dtype=int)
    for r, c in cells - [r0, c0]:
        own[r, c] = 1
    image = np.kron(np.repeat(grey[..., None], 3, axis=2), np.ones((zoom, zoom, 1)))
    if zones is not None:
        image[_edges(zones[r0:r1, c0:c1], zoom)] = (240, 210, 40)
    image[_edges(own, zoom)] = (230, 30, 30)
    return png(image)
