"""Vector layers: GeoJSON through Spark's JSON reader, with CRS gates, validity checks and stable ids."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import polygons
from orrery.functions.projection import to_utm
from orrery.operators.spatial import with_bounds


class VectorError(ValueError):
    """A vector layer breaks its contract."""


def crs_code(value: object) -> str:
    """EPSG:n of the usual spellings; CRS84 for its own."""
    text = str(value or "").strip()
    if re.search(r"CRS:?84$", text, re.I):
        return "CRS84"
    found = re.search(r"EPSG[:/]*(?:[\d.]*[:/])?(\d+)$", text, re.I)
    if not found:
        raise VectorError(f"CRS {value!r} is not known")
    return f"EPSG:{found[1]}"


def is_geographic(code: str) -> bool:
    return code in ("CRS84", "EPSG:4326", "EPSG:4258", "EPSG:4269", "EPSG:4284")


def is_metric(code: str) -> bool:
    """Projected in metres: UTM zones, Pulkovo and Gauss-Kruger zones, ETRS89 grids, web Mercator."""
    n = int(code.split(":")[1]) if code.startswith("EPSG:") else 0
    return 32601 <= n <= 32660 or 32701 <= n <= 32760 or 25828 <= n <= 25838 or 28402 <= n <= 28432 or 20004 <= n <= 20032 or n in (3857, 3035, 5070, 2154, 27700)


def require_metric(value: object, layer: str) -> str:
    if value is None or str(value) == "":
        raise VectorError(f"{layer} has no CRS")
    code = crs_code(value)
    if is_geographic(code) or not is_metric(code):
        raise VectorError(f"{layer} is in {code}; coordinates in metres are needed")
    return code


def same_metric_crs(a: object, b: object, what: str) -> str:
    one, two = require_metric(a, what), require_metric(b, what)
    if one != two:
        raise VectorError(f"{what}: {one} and {two} differ")
    return one


def looks_geographic(bounds: tuple[float, float, float, float]) -> bool:
    x0, y0, x1, y1 = bounds
    return -180 <= x0 <= x1 <= 180 and -90 <= y0 <= y1 <= 90


def _declared(head: dict) -> str | None:
    crs = head.get("crs")
    name = (crs or {}).get("properties", {}).get("name") if isinstance(crs, dict) else None
    return None if name is None else crs_code(name)


def read_features(spark: SparkSession, path: str, kinds: tuple[str, ...] = ()) -> tuple[DataFrame, str | None]:
    """(ordinal, properties JSON, geometry JSON (kind, parts)) of a GeoJSON file, and its declared CRS.

    Takes a feature collection, one feature or a bare geometry. Files are read
    whole as text; features are exploded in Spark.
    """
    text = spark.read.text(path, wholetext=True)
    collection = "struct<type:string,crs:struct<properties:struct<name:string>>,features:array<string>,geometry:string,properties:string>"
    got = text.select("value", F.from_json("value", collection, {"allowNonNumericNumbers": "false"}).alias("j"))
    head = got.select("j.type", "j.crs.properties.name").first()
    if head is None or head["type"] is None:
        raise VectorError(f"{path} is not GeoJSON")
    if head["type"] == "FeatureCollection":
        rows = got.select(F.posexplode("j.features").alias("ordinal", "f")).select("ordinal", F.from_json("f", "struct<type:string,geometry:string,properties:string>").alias("x"))
        rows = rows.select("ordinal", "x.type", "x.geometry", "x.properties")
    elif head["type"] == "Feature":
        rows = got.select(F.lit(0).alias("ordinal"), "j.type", "j.geometry", "j.properties")
    else:
        rows = got.select(F.lit(0).alias("ordinal"), F.lit("Feature").alias("type"), F.col("value").alias("geometry"), F.lit("{}").alias("properties"))

    @F.pandas_udf("string")
    def plain(geometries: pd.Series) -> pd.Series:
        out = []
        for g in geometries:
            if g is None:
                raise VectorError(f"{path}: a feature has no geometry")
            raw = json.loads(g)
            if kinds and raw.get("type") not in kinds:
                raise VectorError(f"{path}: geometry {raw.get('type')} is not supported")
            out.append(json.dumps(polygons.from_geojson(raw)))
        return pd.Series(out)

    declared = None if head["name"] is None else crs_code(head["name"])
    return rows.select("ordinal", F.coalesce("properties", F.lit("{}")).alias("properties"), plain("geometry").alias("geometry")), declared


def with_stable_ids(rows: DataFrame, id_field: str | None = None, column: str = "stable_id") -> DataFrame:
    """Rows with the source id where it is not blank, else geom- and 16 hex digits of the canonical geometry."""

    @F.pandas_udf("string")
    def canonical(geometries: pd.Series) -> pd.Series:
        return pd.Series([polygons.canonical(json.loads(g)) for g in geometries])

    own = F.concat(F.lit("geom-"), F.substring(F.sha2(canonical("geometry").cast("binary"), 256), 1, 16))
    source = F.get_json_object("properties", f"$.{id_field}") if id_field else F.lit(None).cast("string")
    return rows.withColumn(column, F.when(F.trim(F.coalesce(source, F.lit(""))) != "", source).otherwise(own))


def geometry_issues(rows: DataFrame) -> DataFrame:
    """(ordinal, reason) of polygons whose rings cross themselves or have no area."""

    @F.pandas_udf("string")
    def reason(geometries: pd.Series) -> pd.Series:
        out = []
        for t in geometries:
            g = json.loads(t)
            bad = g["kind"] == "polygon" and ("no area" if polygons.area(g) <= 0 else "rings cross themselves" if polygons.self_crossing(g) else None)
            out.append(bad or None)
        return pd.Series(out, dtype=object)

    return rows.select("ordinal", reason("geometry").alias("reason")).where("reason is not null")


def repaired(rows: DataFrame) -> DataFrame:
    """Rows whose self-crossing polygons are replaced by the region they enclose oddly often, with repaired telling which."""

    @F.pandas_udf("struct<geometry:string,repaired:boolean>")
    def mended(geometries: pd.Series) -> pd.DataFrame:
        out = []
        for t in geometries:
            g = json.loads(t)
            bad = g["kind"] == "polygon" and polygons.self_crossing(g)
            out.append((json.dumps(polygons.repaired(g)) if bad else t, bad))
        return pd.DataFrame(out, columns=["geometry", "repaired"])

    return rows.withColumn("__r", mended("geometry")).withColumns({"geometry": F.col("__r.geometry"), "repaired": F.col("__r.repaired")}).drop("__r")


def reprojected(rows: DataFrame, target: str) -> DataFrame:
    """Rows in longitude and latitude -> a UTM zone of WGS 84."""
    epsg = int(target.split(":")[1])

    @F.pandas_udf("string")
    def moved(geometries: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(polygons.mapped(json.loads(t), lambda p: to_utm(p, epsg))) for t in geometries])

    return rows.withColumn("geometry", moved("geometry"))


def load_vectors(spark: SparkSession, path: str, name: str, id_field: str | None = None, crs: str | None = None, repair: bool = True, reproject: bool = False) -> DataFrame:
    """A vector layer with ordinal, properties, geometry, repaired, stable_id and bounds.

    The CRS must be in metres and agree with crs; with reproject, longitudes and
    latitudes are taken to crs if that is a UTM zone. Empty layers are errors,
    and polygons without area; self-crossing ones too unless repair is on.
    """
    rows, declared = read_features(spark, path)
    if rows.limit(1).count() == 0:
        raise VectorError(f"{name} contains no features")
    source = declared or crs
    if reproject and source is not None and is_geographic(crs_code(source)):
        if crs is None or not re.match(r"EPSG:32[67]\d\d$", require_metric(crs, name)):
            raise VectorError(f"{name}: the target of a reprojection is a UTM zone")
        rows = reprojected(rows, crs_code(crs))
    else:
        code = require_metric(source, name)
        if crs is not None:
            same_metric_crs(code, crs, name)
    rows = repaired(rows) if repair else rows.withColumn("repaired", F.lit(False))
    bad = geometry_issues(rows).where("reason = 'no area'" if repair else "true").limit(5).collect()
    if bad:
        raise VectorError(f"{name}: " + "; ".join(f"feature {r['ordinal'] + 1}: {r['reason']}" for r in bad))
    return with_bounds(with_stable_ids(rows, id_field))


def load_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Polygons for the static detector: candidate_id from the properties or static-000001 on; longitudes and latitudes are refused."""
    rows, declared = read_features(spark, path, ("Polygon", "MultiPolygon"))
    if rows.limit(1).count() == 0:
        raise VectorError(f"{path} contains no features")
    if declared is not None:
        require_metric(declared, path)
    out = with_bounds(rows)
    whole = out.agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
    if declared is None and looks_geographic(tuple(whole)):
        raise VectorError(f"{path} seems to hold longitudes and latitudes")
    given = F.coalesce(F.get_json_object("properties", "$.candidate_id"), F.get_json_object("properties", "$.id"))
    number = F.concat(F.lit("static-"), F.lpad((F.col("ordinal") + 1).cast("string"), 6, "0"))
    return out.withColumn("candidate_id", F.when(F.trim(F.coalesce(given, F.lit(""))) != "", given).otherwise(number))
