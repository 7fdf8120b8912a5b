"""Run configuration: a strict tree read from YAML; unknown keys are errors."""

from __future__ import annotations

from pathlib import Path
from typing import Any, Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field, PositiveFloat, PositiveInt, model_validator


# The keys and defaults of all sections.


class Section(BaseModel):
    model_config = ConfigDict(extra="forbid")


class Project(Section):
    name: str
    version: str
    mode: str | None = None
    claim_guardrail: str | None = None
    metadata: dict[str, Any] = Field(default_factory=dict)
    provenance: dict[str, Any] = Field(default_factory=dict)


class Area(Section):
    name: str
    input_geojson: str
    metric_crs: str | None = None
    metadata: dict[str, Any] = Field(default_factory=dict)
    provenance: dict[str, Any] = Field(default_factory=dict)


class Time(Section):
    start_year: int
    end_year: int
    vegetation_months: list[int]
    bare_soil_months: list[int]
    minimum_repeated_seasons: PositiveInt | None = None


class LandCover(Section):
    primary_branch: str | None = None
    classes: dict[str, list[str]]
    mixed_candidate_min_classes: PositiveInt


class Constraints(Section):
    min_diameter_m: float = 40.0
    max_diameter_m: float = 1500.0
    min_area_ha: float = 0.1
    max_area_ha: float = 200.0
    min_distance_to_field_edge_m: float = 20.0

    @model_validator(mode="after")
    def in_order(self):
        for low, high, what in ((self.min_diameter_m, self.max_diameter_m, "diameter"), (self.min_area_ha, self.max_area_ha, "area")):
            if not 0 < low <= high:
                raise ValueError(f"{what} limits must be positive and in order")
        return self


class Prepared(Section):
    raster_stack_manifest: str
    reject_lonlat_for_metric_operations: bool = True
    allow_reprojection: bool = False
    allow_resampling: bool = False


class Vector(Section):
    path: str
    required: bool = False
    id_field: str | None = None
    role: str | None = None
    crs: str | None = None


class Optical(Section):
    cloud_threshold: float = 30.0
    indices: list[str]
    optional_indices: list[str] = Field(default_factory=list)


class Listed(Section):
    features: list[str]


class Weather(Section):
    features: list[str] = Field(default_factory=list)


class Features(Section):
    sentinel2: Optical
    sentinel1: Listed
    landsat: Listed
    weather: Weather | None = None


class Normalization(Section):
    cropland_method: str
    forest_method: str | None = None
    center: Literal["median"]
    scale: Literal["MAD"]
    min_valid_pixels_per_field_date: PositiveInt | None = None
    mad_epsilon: PositiveFloat | None = None
    missing_field_policy: str | None = None


class StaticDetector(Section):
    enabled: bool = True
    circularity_min: float = Field(default=0.45, ge=0.0, le=1.0)
    ringness_min: float = Field(default=0.10, ge=0.0, le=1.0)
    multiscale_radii_m: list[PositiveFloat] = Field(default_factory=list)


class DynamicDetector(Section):
    anomaly_percentile: float = Field(default=95.0, ge=0.0, le=100.0)
    support_percentile: float | None = Field(default=None, ge=0.0, le=100.0)
    min_support_pixels: PositiveInt = 1
    min_valid_observations_per_season: PositiveInt = 4
    min_repeated_seasons: PositiveInt = 2
    connected_components: bool = True
    morphology_filter: bool = True
    merge_distance_m: float | None = None
    merge_across_dates: bool | None = None


class Filters(Section):
    use_penalties: bool = True
    flag_roads: bool = True
    flag_water: bool = True
    flag_builtup: bool | None = None
    flag_built_up: bool | None = None
    flag_excluded_zones: bool = True
    flag_field_edges: bool = True
    flag_linear_objects: bool = True
    flag_cloud_shadows: bool = True
    flag_harvest_patterns: bool = True
    flag_forest_clearcuts: bool | None = None
    flag_forest_roads: bool | None = None
    flag_wetlands: bool | None = None
    flag_irrigation: bool | None = None
    flag_quarries: bool = True
    flag_woody_patches: bool = True
    road_buffer_m: float | None = None
    water_buffer_m: float | None = None
    builtup_buffer_m: float | None = None
    woody_patch_buffer_m: float | None = None
    field_edge_buffer_m: float | None = None
    max_elongation_without_penalty: float | None = None
    missing_context_policy: str | None = None

    def disabled(self) -> list[str]:
        """Names of the risks that are switched off."""
        built = self.flag_built_up if self.flag_built_up is not None else self.flag_builtup
        on = {
            "roads": self.flag_roads, "water": self.flag_water, "built_up": built is not False, "excluded_zones": self.flag_excluded_zones, "quarries": self.flag_quarries,
            "woody_patches": self.flag_woody_patches, "cloud_shadows": self.flag_cloud_shadows, "harvest_patterns": self.flag_harvest_patterns, "irrigation": self.flag_irrigation is not False,
            "field_edges": self.flag_field_edges, "linear_objects": self.flag_linear_objects,
        }
        return [name for name, used in on.items() if not used]

    def buffers(self) -> dict[str, float]:
        """Buffers that are set; 0 means the default."""
        given = {"roads": self.road_buffer_m, "water": self.water_buffer_m, "built_up": self.builtup_buffer_m, "woody_patches": self.woody_patch_buffer_m}
        return {k: v for k, v in given.items() if v}


class Weights(Section):
    moisture_weight: float | None = None
    vegetation_weight: float | None = None
    brightness_weight: float | None = None
    thermal_weight: float | None = None
    sar_weight: float | None = None
    morphology_weight: float | None = None
    persistence_weight: float | None = None
    post_rain_weight: float | None = None
    geology_weight: float | None = None
    canopy_structure_weight: float | None = None
    canopy_moisture_weight: float | None = None
    dem_weight: float | None = None
    cluster_adjacency_weight: float | None = None
    object_integrity_weight: float | None = None
    cropland_signal_weight: float | None = None
    forest_signal_weight: float | None = None

    def by_component(self) -> dict[str, float | None]:
        names = ("moisture", "vegetation", "brightness", "thermal", "sar", "morphology", "persistence", "post_rain", "geology")
        return {n: getattr(self, f"{n}_weight") for n in names}


class Thresholds(Section):
    A: float = Field(ge=0.0, le=1.0)
    B: float = Field(ge=0.0, le=1.0)
    C: float = Field(ge=0.0, le=1.0)
    D: float = Field(ge=0.0, le=1.0)


class Penalties(Section):
    field_edge: float | None = None
    road: float | None = None
    water: float | None = None
    built_up: float | None = None
    quarry: float | None = None
    woody_patch: float | None = None
    linear_object: float | None = None
    cloud_shadow: float | None = None
    harvest_pattern: float | None = None


class Scoring(Section):
    cropland: Weights
    forest: Weights | None = None
    mixed: Weights | None = None
    priority_thresholds: Thresholds | None = None
    penalties: Penalties | None = None


class Component(Section):
    inputs: list[str]
    high_score_means: str
    weight: float


class Validation(Section):
    top_n: PositiveInt = 20
    known_site_recall_top_n: list[PositiveInt] = Field(default_factory=list)
    expert_precision_top_n: PositiveInt | None = None
    export_false_positive_counts: bool = True
    do_not_treat_unlabeled_as_negative: bool = True


class Outputs(Section):
    output_dir: str | None = None
    candidates_top_n: int = 30
    export_geojson: bool = True
    export_csv: bool = True
    generate_passports: bool = True
    generate_quicklooks: bool | None = None
    export_time_series: bool | None = None
    export_validation_summary: bool | None = None
    export_resolved_config: bool = True


class RunConfig(Section):
    project: Project
    aoi: Area
    time: Time
    land_cover: LandCover
    object_constraints: Constraints = Field(default_factory=Constraints)
    prepared_data: Prepared | None = None
    vectors: dict[str, Vector] = Field(default_factory=dict)
    sentinel2: Optical | None = None
    sentinel1: Listed | None = None
    landsat: Listed | None = None
    features: Features | None = None
    normalization: Normalization | None = None
    static_ring_detector: StaticDetector = Field(default_factory=StaticDetector)
    dynamic_detector: DynamicDetector | None = None
    false_positive_filters: Filters | None = None
    anomaly_components: dict[str, Component] = Field(default_factory=dict)
    scoring: Scoring
    validation: Validation | None = None
    outputs: Outputs = Field(default_factory=Outputs)

    def penalties(self) -> dict[str, float] | None:
        """Penalties by risk: the defaults overlaid by what is set; all 0 if they are switched off."""
        from orrery.operators.spatial import FIELD_EDGE_PENALTY, LINEAR_PENALTY, RISKS

        default = {kind: p for _, _, kind, _, p, _ in RISKS} | {"field_edge": FIELD_EDGE_PENALTY, "linear_object": LINEAR_PENALTY}
        if self.false_positive_filters is not None and not self.false_positive_filters.use_penalties:
            return dict.fromkeys(default, 0.0)
        given = self.scoring.penalties.model_dump() if self.scoring.penalties else {}
        return default | {k: float(v) for k, v in given.items() if v is not None}


def load_config(path: str | Path) -> RunConfig:
    return RunConfig.model_validate(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


def resolved(config: RunConfig) -> dict[str, Any]:
    """The configuration with all defaults, ready for JSON."""
    return config.model_dump(mode="json")
