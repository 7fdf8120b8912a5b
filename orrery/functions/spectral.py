"""Spectral indices as column expressions. Null bands give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to every denominator.
EPSILON = 1e-9

# Which way each feature points to evidence.
DIRECTIONS = {
    "NDVI": "lower_values_indicate_vegetation_stress",
    "NDMI": "lower_values_indicate_moisture_stress",
    "NDWI": "lower_values_indicate_water_or_moisture_stress",
    "MSI": "higher_values_indicate_moisture_stress",
    "BSI": "higher_values_indicate_bare_soil_or_brightness",
    "brightness": "higher_values_indicate_brightness",
    "red_edge": "lower_values_indicate_red_edge_vegetation_stress",
    "NDRE": "lower_values_indicate_red_edge_vegetation_stress",
    "VV": "backscatter_supporting_context",
    "VH": "backscatter_supporting_context",
    "VV_VH_ratio": "higher_or_lower_values_indicate_sar_anomaly",
    "temporal_difference": "larger_absolute_values_indicate_temporal_sar_change",
    "sar_event_response": "larger_absolute_values_indicate_supporting_sar_event_response_not_moisture_proof",
    "LST": "higher_values_indicate_heat_or_thermal_support",
    "post_rain_drying": "higher_values_indicate_supporting_post_rain_drying_evidence_not_standalone",
    "rain_event": "supporting_weather_event_context_not_standalone_evidence",
    "rainfall_mm": "supporting_rainfall_amount_context_not_standalone_evidence",
}


def ratio(top: Column, bottom: Column) -> Column:
    """top / (bottom + epsilon); null where that is a division by zero."""
    return F.try_divide(top, bottom + F.lit(EPSILON))


def ndvi(red: Column, nir: Column) -> Column:
    return ratio(nir - red, nir + red)


def ndmi(nir: Column, swir: Column) -> Column:
    return ratio(nir - swir, nir + swir)


def ndwi(green: Column, nir: Column) -> Column:
    return ratio(green - nir, green + nir)


def msi(nir: Column, swir: Column) -> Column:
    return ratio(swir, nir)


def bsi(blue: Column, red: Column, nir: Column, swir: Column) -> Column:
    return ratio((swir + red) - (nir + blue), (swir + red) + (nir + blue))


def brightness(*bands: Column) -> Column:
    """Mean of the bands that are not null; null if all are."""
    if not bands:
        raise ValueError("brightness needs at least one band")
    total = sum((F.coalesce(b, F.lit(0.0)) for b in bands[1:]), F.coalesce(bands[0], F.lit(0.0)))
    known = sum((b.isNotNull().cast("int") for b in bands[1:]), bands[0].isNotNull().cast("int"))
    return F.when(known > 0, total / known)


def band_ratio(vv: Column, vh: Column) -> Column:
    return ratio(vv, vh)
