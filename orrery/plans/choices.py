"""Queries: which features a stack gives, their pixels, and the text and flag rules of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import scalars
from orrery.operators import robust, shapes, spatial
from orrery.plans import features
from orrery.plans.geometry import objects
from orrery.plans.statistics import read
from orrery.sources.manifest import RasterSpec

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_SENSORS = {0: ("sentinel2", ("NDVI", "NDMI", "BSI", "EVI")), 1: ("Sentinel1", ("VV", "VH")), 2: ("landsat", ("LST", "QA"))}


def layers(spark, sf_dir) -> list[RasterSpec]:
    """A manifest's layers, one for each nation: a list that the driver holds, as in a run."""
    out = []
    for (k,) in read(spark, sf_dir, "nation").select("n_nationkey").orderBy(F.desc("n_nationkey")).collect():
        sensor, names = _SENSORS[k % 3]
        out.append(RasterSpec(f"l{k:02d}", sensor, names[k // 3 % len(names)], "", "", 10.0, None, "input_feature", None if k % 11 == 10 else f"2024-0{k % 5 + 3}-1{k % 4}"))
    return out


_LAYERS = (
    "l AS (SELECT n_nationkey AS k, 'l' || lpad(n_nationkey::VARCHAR, 2, '0') AS id, CASE n_nationkey % 3 WHEN 0 THEN ['NDVI', 'NDMI', 'BSI', 'EVI'][n_nationkey // 3 % 4 + 1] WHEN 1 THEN ['VV', 'VH'][n_nationkey // 3 % 2 + 1] ELSE ['LST', 'QA'][n_nationkey // 3 % 2 + 1] END AS name, "
    "CASE WHEN n_nationkey % 11 = 10 THEN NULL ELSE '2024-0' || (n_nationkey % 5 + 3) || '-1' || (n_nationkey % 4) END AS day FROM nation)"
)
_ROW = "feature string, date string, sources string, op string, flag string"


def _told(spark, found, flags):
    return spark.createDataFrame([(f.name, f.date, "|".join(f.sources), f.op, None) for f in found] + [(None, None, None, None, x) for x in flags], _ROW)


@query(
    f"WITH {_LAYERS}, s AS (SELECT * FROM l WHERE k % 3 = 0), m AS (SELECT unnest(['NDVI', 'NDMI', 'NDWI', 'MSI', 'BSI', 'brightness']) AS n) "
    "SELECT name AS feature, day AS date, id AS sources, 'same' AS op, NULL::VARCHAR AS flag FROM s WHERE name <> 'EVI' UNION ALL SELECT name, day, id, 'same', NULL FROM l WHERE name = 'LST' "
    "UNION ALL SELECT NULL, NULL, NULL, NULL, 'missing_sentinel2_' || n FROM m WHERE n NOT IN (SELECT name FROM s) UNION ALL SELECT NULL, NULL, NULL, NULL, 'missing_sentinel2_red_edge' "
    "UNION ALL SELECT NULL, NULL, NULL, NULL, 'missing_sentinel2_EVI' WHERE NOT EXISTS (SELECT 1 FROM s WHERE name = 'EVI')"
)
def optical_thermal_choice(spark, sf_dir):
    """Prepared optical and thermal layers, and flags of what is missing."""
    rows = layers(spark, sf_dir)
    (a, a_flags), (b, b_flags) = features.optical(rows), features.thermal(rows)
    return _told(spark, a + b, a_flags + b_flags)


_SAR = (
    f"{_LAYERS}, s AS (SELECT * FROM l WHERE k % 3 = 1), v AS (SELECT day, min(id) AS id FROM s WHERE name = 'VV' GROUP BY day), h AS (SELECT day, min(id) AS id FROM s WHERE name = 'VH' GROUP BY day), "
    "j AS (SELECT coalesce(v.day, h.day) AS day, v.id AS a, h.id AS b FROM v FULL JOIN h ON v.day IS NOT DISTINCT FROM h.day), "
    "t AS (SELECT id, day, row_number() OVER (ORDER BY coalesce(day, ''), k DESC) AS i, count(*) OVER () AS n FROM s WHERE name = 'VV'), "
    "f AS (SELECT name AS feature, day AS date, id AS sources, 'same' AS op FROM s UNION ALL SELECT 'VV_VH_ratio', day, a || '|' || b, 'ratio' FROM j WHERE a IS NOT NULL AND b IS NOT NULL "
    "UNION ALL SELECT 'temporal_difference', y.day, x.id || '|' || y.id, 'gain' FROM t x JOIN t y ON x.i = 1 AND y.i = y.n WHERE y.n >= 2)"
)


@query(
    f"WITH {_SAR} SELECT *, NULL::VARCHAR AS flag FROM f UNION ALL SELECT NULL, NULL, NULL, NULL, 'missing_sentinel1_' || CASE WHEN a IS NULL THEN 'VV' ELSE 'VH' END || '_for_ratio_' || coalesce(day, 'undated') FROM j WHERE a IS NULL OR b IS NULL"
)
def radar_choice(spark, sf_dir):
    """Backscatter, ratios of one date, the difference of the last layer to the first."""
    return _told(spark, *features.sar(layers(spark, sf_dir)))


_RAIN = [("2024-04-11", 12.0, "r1"), ("2024-05-01", 0.4, "r2"), ("2024-05-12", 3.0, "r3"), ("2024-08-30", 9.0, "r4")]
_WET = "r(day, context) AS (VALUES ('2024-04-11', 'r1'), ('2024-05-12', 'r3'), ('2024-08-30', 'r4'))"


@query(
    f"WITH {_LAYERS}, {_WET}, o AS (SELECT * FROM l WHERE name = 'NDMI' AND day IS NOT NULL), "
    "p AS (SELECT r.day, r.context, (SELECT arg_max(id, row(o.day, o.id)) FROM o WHERE o.day < r.day) AS b, (SELECT arg_min(id, row(o.day, o.id)) FROM o WHERE o.day > r.day) AS a FROM r) "
    "SELECT 'post_rain_drying_NDMI' AS feature, o.day AS date, context || '|' || b || '|' || a AS sources, 'loss' AS op, NULL::VARCHAR AS flag FROM p JOIN o ON o.id = a WHERE b IS NOT NULL "
    "UNION ALL SELECT NULL, NULL, NULL, NULL, 'missing_moisture_pair_for_post_rain_drying_' || day FROM p WHERE a IS NULL OR b IS NULL"
)
def drying_choice(spark, sf_dir):
    """Moisture before and after each rain event of 1 mm or more."""
    return _told(spark, *features.post_rain(features.optical(layers(spark, sf_dir))[0], _RAIN))


@query(
    f"WITH {_SAR}, {_WET}, o AS (SELECT feature, date AS day, sources, row_number() OVER (ORDER BY CASE feature WHEN 'VV' THEN 0 WHEN 'VH' THEN 1 ELSE 2 END, date, sources) AS i FROM f WHERE feature <> 'temporal_difference' AND date IS NOT NULL), n AS (SELECT DISTINCT feature FROM o), "
    "p AS (SELECT r.day, context, n.feature, (SELECT arg_max(i, row(o.day, i)) FROM o WHERE o.feature = n.feature AND o.day <= r.day) AS b, (SELECT arg_min(i, row(o.day, i)) FROM o WHERE o.feature = n.feature AND o.day > r.day) AS a FROM r, n) "
    "SELECT 'sar_event_response_' || p.feature AS feature, x.day AS date, context || '|' || y.sources || '|' || x.sources AS sources, 'change' AS op, NULL::VARCHAR AS flag FROM p JOIN o x ON x.i = p.a JOIN o y ON y.i = p.b "
    "UNION ALL SELECT NULL, NULL, NULL, NULL, 'missing_sar_pair_for_event_response_' || day FROM p GROUP BY day HAVING bool_and(a IS NULL OR b IS NULL)"
)
def response_choice(spark, sf_dir):
    """Radar features up to the day of each rain event and after it."""
    return _told(spark, *features.sar_response(features.sar(layers(spark, sf_dir))[0], _RAIN))


_MADE = [("same|a", "same", "0", None), ("ratio|b", "ratio", "1", "2"), ("gain|c", "gain", "0", "3"), ("loss|d", "loss", "0", "3"), ("change|e", "change", "2", "1")]


@query(
    "WITH p AS (SELECT vec_id % 4 AS layer, vec_id // 4 AS r, unnest(range(len(embedding))) AS c, unnest(embedding)::DOUBLE AS v FROM embeddings), "
    "j AS (SELECT a.layer AS la, b.layer AS lb, a.r, a.c, a.v AS x, b.v AS y FROM p a JOIN p b ON a.r = b.r AND a.c = b.c) "
    "SELECT 'same' AS feature, r AS \"row\", c AS col, round(v, 6) AS value FROM p WHERE layer = 0 UNION ALL SELECT 'ratio', r, c, round(x / (y + 1e-9), 6) FROM j WHERE la = 1 AND lb = 2 "
    "UNION ALL SELECT 'gain', r, c, round(y - x, 6) FROM j WHERE la = 0 AND lb = 3 UNION ALL SELECT 'loss', r, c, round(x - y, 6) FROM j WHERE la = 0 AND lb = 3 UNION ALL SELECT 'change', r, c, round(abs(y - x), 6) FROM j WHERE la = 2 AND lb = 1"
)
def feature_pixels(spark, sf_dir):
    """Pixels of features made from one layer or two."""
    cells = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).cast("string").alias("layer"), F.floor(F.col("vec_id") / 4).alias("row"), F.posexplode("embedding").alias("col", "v"))
    made = [features.Feature(n, "", None, (), "", op, a, b) for n, op, a, b in _MADE]
    rows = features.feature_pixels(spark, made, cells.withColumn("value", F.col("v").cast("double")), "layer")
    return rows.select(F.substring_index("feature", "|", 1).alias("feature"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.round("value", 6).alias("value"))


@query(
    "SELECT p_partkey AS object_id, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'a|b' WHEN 2 THEN 'plain' WHEN 3 THEN '[broken' ELSE '' END AS listed, "
    "CASE p_partkey % 5 WHEN 0 THEN 'candidate' WHEN 1 THEN 'a_b' WHEN 2 THEN 'plain' WHEN 3 THEN 'broken' ELSE 'candidate' END AS stem, "
    "CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 1 END AS seasons, p_partkey % 6 NOT IN (0, 1) AS zone_known FROM part"
)
def text_and_season_rules(spark, sf_dir):
    """Lists in texts, file names, distinct years of dates, background zones."""
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, " ").when(k % 5 == 1, '["a", "b", ""]').when(k % 5 == 2, "plain").when(k % 5 == 3, "[broken")
    dates = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("2021-05-01"), F.lit("2021-09-01"))).when(k % 4 == 2, F.array(F.lit("2021-05-01"), F.lit("2023-05-01"))).otherwise(F.array(F.lit(""), F.lit("2020-01-01")))
    zone = F.when(k % 6 == 1, F.lit(float("nan"))).when(k % 6 > 0, k.cast("double"))
    rows = read(spark, sf_dir, "part").select(k.alias("object_id"), text.alias("t"), dates.alias("d"), zone.alias("z"))
    return rows.select("object_id", F.array_join(scalars.text_list(F.col("t")), "|").alias("listed"), scalars.file_stem(F.when(F.col("t").startswith('["a'), F.lit("a b")).otherwise(F.col("t"))).alias("stem"), scalars.season_count(F.col("d")).alias("seasons"), robust.zone_known(F.col("z"), "double").alias("zone_known"))


@query(
    "WITH m AS (SELECT p_partkey AS k, (p_size + 10)::DOUBLE AS w, (p_partkey % 40 + 10)::DOUBLE AS h, p_partkey % 7 AS n, (p_partkey % 5)::DOUBLE / 10 - 0.2::DOUBLE AS ring FROM part), "
    "s AS (SELECT *, w * h AS a, 2 * sqrt(w * h / pi()) AS d, greatest(w, h) / least(w, h) AS el, 4 * pi() * w * h / pow(2 * (w + h), 2) AS ci FROM m) "
    "SELECT k AS object_id, array_to_string(list_filter([CASE WHEN a < 500 OR d < 30 OR n < 2 THEN 'too_small' END, CASE WHEN a > 1500 OR d > 60 THEN 'too_large' END, CASE WHEN el > 2 THEN 'elongated' END, CASE WHEN a >= 1000 AND ci <= 0.78 AND ring <= 0.0 THEN 'broad_patch' END], lambda x: x IS NOT NULL), '|') AS flags, "
    "'cropland' AS landcover_branch, 'landcover_context_assumed_cropland_fields' AS context_flags FROM s"
)
def object_flag_rules(spark, sf_dir):
    """Flags of extracted objects with own limits; the land cover that is assumed without a layer."""
    k = F.col("object_id")
    rows = shapes.box_metrics(objects(spark, sf_dir)).withColumns({"support_pixel_count": k % 7, "ringness_score": k % 5 / 10.0 - 0.2})
    limits = {"min_area_m2": 500.0, "max_area_m2": 1500.0, "min_diameter_m": 30.0, "max_diameter_m": 60.0, "max_elongation": 2.0, "min_support_pixels": 2, "broad_area_m2": 1000.0, "broad_circularity": 0.78, "broad_ringness": 0.0}
    got = spatial.assumed_landcover(rows.withColumn("flags", shapes.object_flags(limits)), "Cropland fields")
    return got.select("object_id", F.array_join("flags", "|").alias("flags"), "landcover_branch", F.array_join("landcover_context_flags", "|").alias("context_flags"))
