"""Prepared-stack manifests and weather lists: strict YAML, small, read on the driver."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field
from datetime import date
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession


class ManifestError(ValueError):
    """A manifest or weather list breaks its contract."""


@dataclass(frozen=True)
class RasterSpec:
    layer_id: str
    sensor: str
    feature_name: str
    path: str
    crs: str
    resolution_m: float
    nodata: float | None
    role: str
    obs_date: str | None = None
    quality_mask_path: str | None = None


@dataclass(frozen=True)
class VectorSpec:
    name: str
    path: str
    crs: str
    role: str
    required: bool
    id_field: str | None = None


@dataclass(frozen=True)
class Manifest:
    path: str
    run_id: str
    crs: str
    resolution_m: float
    aoi_path: str
    aoi_crs: str
    vectors: dict[str, VectorSpec]
    layers: tuple[RasterSpec, ...]
    quality: dict[str, Any]
    weather_path: str | None = None
    notes: tuple[str, ...] = field(default_factory=tuple)

    def snapshot_id(self) -> str:
        return f"prepared_manifest:{self.run_id}:{hashlib.sha256(Path(self.path).read_bytes()).hexdigest()[:16]}"


def _mapping(value: object, section: str, required: set[str], optional: set[str] = frozenset()) -> dict[str, Any]:
    if not isinstance(value, dict):
        raise ManifestError(f"{section} must be a mapping")
    missing, unknown = required - set(value), set(value) - required - set(optional)
    if missing or unknown:
        raise ManifestError(f"{section}: missing keys {sorted(missing)}, unknown keys {sorted(map(str, unknown))}")
    return value


def _flag(value: object, name: str) -> bool:
    if not isinstance(value, bool):
        raise ManifestError(f"{name} must be true or false, not {value!r}")
    return value


def _text(value: object) -> str | None:
    return None if value is None else str(value)


def _place(base: Path, value: object) -> str:
    """Absolute paths stay; others are relative to the manifest, or for data/... to the project that holds it."""
    path = Path(str(value))
    if path.is_absolute() or "://" in str(value):
        return str(value)
    near = (base / path).resolve()
    if not near.exists() and path.parts and path.parts[0] == "data":
        for top in (base, *base.parents):
            if (top / "pyproject.toml").exists():
                return str((top / path).resolve())
    return str(near)


def load_manifest(path: str | Path) -> Manifest:
    path = Path(path)
    top = _mapping(yaml.safe_load(path.read_text(encoding="utf-8")) or {}, "manifest", {"run", "crs", "resolution_m", "aoi", "vectors", "raster_layers", "quality"}, {"notes", "weather_context"})
    base = path.parent
    run = _mapping(top["run"], "run", {"id"}, {"description", "created_by", "notes"})
    aoi = _mapping(top["aoi"], "aoi", {"path", "crs"})
    vectors = {}
    for name, raw in _mapping(top["vectors"], "vectors", set(), set(top["vectors"] or {})).items():
        v = _mapping(raw, f"vectors.{name}", {"path", "crs", "role", "required"}, {"id_field"})
        vectors[str(name)] = VectorSpec(str(name), _place(base, v["path"]), str(v["crs"]), str(v["role"]), _flag(v["required"], f"vectors.{name}.required"), _text(v.get("id_field")))
    if not isinstance(top["raster_layers"], list):
        raise ManifestError("raster_layers must be a list")
    layers = []
    for i, raw in enumerate(top["raster_layers"], 1):
        r = _mapping(raw, f"raster_layers[{i}]", {"id", "sensor", "feature_name", "path", "crs", "resolution_m", "nodata", "role"}, {"date", "quality_mask_path"})
        layers.append(
            RasterSpec(
                str(r["id"]), str(r["sensor"]), str(r["feature_name"]), _place(base, r["path"]), str(r["crs"]), float(r["resolution_m"]), None if r["nodata"] is None else float(r["nodata"]), str(r["role"]),
                _text(r.get("date")), None if r.get("quality_mask_path") is None else _place(base, r["quality_mask_path"]),
            )
        )
    ids = [x.layer_id for x in layers]
    if len(set(ids)) < len(ids):
        raise ManifestError(f"raster layer ids repeat: {sorted({i for i in ids if ids.count(i) > 1})}")
    q = _mapping(top["quality"], "quality", set(), {"reject_mismatched_crs", "reject_mismatched_grid", "allow_resampling", "min_valid_observations_per_season"})
    quality = {k: _flag(q.get(k, d), f"quality.{k}") for k, d in (("reject_mismatched_crs", True), ("reject_mismatched_grid", True), ("allow_resampling", False))}
    quality["min_valid_observations_per_season"] = None if q.get("min_valid_observations_per_season") is None else int(q["min_valid_observations_per_season"])
    weather = None if top.get("weather_context") is None else _place(base, _mapping(top["weather_context"], "weather_context", {"path"})["path"])
    return Manifest(str(path), str(run["id"]), str(top["crs"]), float(top["resolution_m"]), _place(base, aoi["path"]), str(aoi["crs"]), vectors, tuple(layers), quality, weather, tuple(map(str, top.get("notes") or [])))


def layers_frame(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """One row for each raster layer, with its place in the manifest as ordinal."""
    schema = "ordinal int, layer_id string, sensor string, feature_name string, path string, crs string, resolution_m double, nodata double, role string, obs_date string, quality_mask_path string"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(({"ordinal": i} | asdict(s))[n] for n in names) for i, s in enumerate(manifest.layers)], schema)


def weather_records(records: list[dict]) -> list[tuple[str, float | None, str]]:
    """(event_date, rainfall_mm, context_id), sorted; strict keys, ISO dates, precipitation_mm as another name."""
    out = []
    for i, raw in enumerate(records):
        r = _mapping(raw, f"events[{i}]", {"date"}, {"rainfall_mm", "precipitation_mm", "source_id", "source"})
        try:
            day = str(r["date"])
            date.fromisoformat(day)
        except ValueError as e:
            raise ManifestError(f"events[{i}].date must be an ISO date") from e
        amount = r.get("rainfall_mm", r.get("precipitation_mm"))
        try:
            if isinstance(amount, bool):
                raise ValueError(amount)
            rain = None if amount is None else float(amount)
        except (TypeError, ValueError) as e:
            raise ManifestError(f"events[{i}].rainfall_mm must be a number") from e
        out.append((day, rain, str(r["source_id"]) if r.get("source_id") else f"weather_event_{day}"))
    return sorted(out, key=lambda x: (x[0], x[2]))


def load_weather(spark: SparkSession, path: str | Path) -> DataFrame:
    top = _mapping(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}, "weather context", {"events"})
    if not isinstance(top["events"], list):
        raise ManifestError("events must be a list")
    return spark.createDataFrame(weather_records(top["events"]), "event_date string, rainfall_mm double, context_id string")
