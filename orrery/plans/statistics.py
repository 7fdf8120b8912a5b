"""Queries: robust statistics, residuals, composites, indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import scalars, spectral
from orrery.operators import composite, robust

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STATS = """
m AS (SELECT {k}, count(v) AS n, quantile_cont(v, 0.5) AS med, stddev_pop(v) AS sd FROM x GROUP BY {k}),
d AS (SELECT x.{k}, quantile_cont(abs(v - med), 0.5) AS mad FROM x JOIN m ON x.{k} = m.{k} GROUP BY x.{k}),
s AS (SELECT m.{k}, n, med, sd, mad, CASE WHEN n < 1 THEN 'insufficient' WHEN mad * 1.4826::DOUBLE > 1e-6 THEN 'ok' WHEN sd > 1e-6 THEN 'mad_fallback_std' ELSE 'constant' END AS status FROM m JOIN d ON m.{k} = d.{k}),
z AS (SELECT *, CASE status WHEN 'ok' THEN mad * 1.4826::DOUBLE WHEN 'mad_fallback_std' THEN sd END AS scale FROM s)
"""


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice AS v FROM lineitem), " + _STATS.format(k="l_suppkey") + "SELECT l_orderkey, l_linenumber, x.l_suppkey, round((v - med) / scale, 6) + 0.0 AS z FROM x JOIN z ON x.l_suppkey = z.l_suppkey")
def field_robust_z(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return robust.robust_z(rows, ["l_suppkey"], "l_extendedprice").select("l_orderkey", "l_linenumber", "l_suppkey", (F.round("z", 6) + 0.0).alias("z"))


@query("WITH x AS (SELECT l_suppkey, l_extendedprice AS v FROM lineitem), " + _STATS.format(k="l_suppkey") + "SELECT l_suppkey, n::BIGINT AS valid_count, round(med, 6) AS median, round(mad, 6) AS mad, round(scale, 6) AS scale, status FROM z")
def field_statistics(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice")
    got = robust.group_statistics(rows, ["l_suppkey"], "l_extendedprice")
    return got.select("l_suppkey", "valid_count", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), F.round("scale", 6).alias("scale"), "status")


@query(ORACLES["field_statistics"])
def field_statistics_bracketed(spark, sf_dir):
    """The same with medians by rank brackets, the form for groups of any size."""
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice")
    got = robust.group_statistics(rows, ["l_suppkey"], "l_extendedprice", bracketed=True)
    return got.select("l_suppkey", "valid_count", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), F.round("scale", 6).alias("scale"), "status")


@query(
    "WITH x AS (SELECT l_partkey, CASE WHEN l_discount < 0.05 THEN l_tax END AS v FROM lineitem), " + _STATS.format(k="l_partkey")
    + "SELECT l_partkey, CASE WHEN n < 3 THEN 'insufficient_valid_pixels_' || l_partkey WHEN status = 'constant' THEN 'constant_field_' || l_partkey ELSE 'mad_fallback_std_' || l_partkey END AS flag FROM z WHERE n < 3 OR status IN ('constant', 'mad_fallback_std')"
)
def field_robust_z_flags(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_discount") < 0.05, F.col("l_tax")).alias("v"))
    return robust.zone_flags(robust.group_statistics(rows, ["l_partkey"], "v", least=3), "l_partkey")


@query(
    "WITH w AS (SELECT l_orderkey, l_linenumber, n_name AS stratum, l_quantity::DOUBLE AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey), "
    "p AS (SELECT n_name AS stratum, count(DISTINCT s_suppkey) AS peers FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem) GROUP BY n_name), "
    "x AS (SELECT l_orderkey, l_linenumber, w.stratum, CASE WHEN peers >= 2 THEN v END AS v FROM w JOIN p ON w.stratum = p.stratum), "
    + _STATS.format(k="stratum") + "SELECT l_orderkey, l_linenumber, x.stratum, round((v - med) / scale, 6) + 0.0 AS z FROM x LEFT JOIN z ON x.stratum = z.stratum"
)
def peer_residual(spark, sf_dir):
    zones = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), robust.stratum_label(F.col("n_name")).alias("stratum"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("double").alias("v"))
    got = robust.peer_residual(rows, zones, "l_suppkey", "stratum", "v")
    return got.select("l_orderkey", "l_linenumber", "stratum", (F.round("z", 6) + 0.0).alias("z"))


_DAILY = "x AS (SELECT user_id, event_type, ts::DATE AS d, avg(value) AS v FROM events GROUP BY ALL)"


@query(
    f"WITH {_DAILY}, m AS (SELECT user_id, event_type, count(v) AS n, quantile_cont(v, 0.5) AS med, stddev_pop(v) AS sd FROM x GROUP BY ALL), "
    "q AS (SELECT x.user_id, x.event_type, quantile_cont(abs(v - med), 0.5) AS mad FROM x JOIN m USING (user_id, event_type) GROUP BY ALL), "
    "e AS (SELECT event_type, count(DISTINCT d) AS dates FROM x GROUP BY ALL) "
    "SELECT user_id, event_type, d::VARCHAR AS obs_date, round(CASE WHEN n >= 2 AND dates >= 2 THEN (v - med) / CASE WHEN mad * 1.4826::DOUBLE > 1e-6 THEN mad * 1.4826::DOUBLE WHEN sd > 1e-6 THEN sd END END, 5) + 0.0 AS z "
    "FROM x JOIN m USING (user_id, event_type) JOIN q USING (user_id, event_type) JOIN e USING (event_type)"
)
def temporal_residual(spark, sf_dir):
    daily = read(spark, sf_dir, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("obs_date")).agg(F.avg("value").alias("v"))
    return robust.temporal_residual(daily, ["event_type"], ["user_id"], "obs_date", "v").select("user_id", "event_type", F.col("obs_date").cast("string").alias("obs_date"), (F.round("z", 5) + 0.0).alias("z"))


@query(
    "SELECT event_id, round(CASE event_type WHEN 'click' THEN abs(v) WHEN 'view' THEN abs(v) WHEN 'error' THEN -v ELSE v END, 6) + 0.0 AS oriented "
    "FROM (SELECT event_id, event_type, value - 50 AS v FROM events)"
)
def orient_direction(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", (F.col("value") - 50).alias("v"))
    direction = (
        F.when(F.col("event_type") == "click", spectral.DIRECTIONS["VV_VH_ratio"]).when(F.col("event_type") == "view", spectral.DIRECTIONS["temporal_difference"])
        .when(F.col("event_type") == "error", spectral.DIRECTIONS["NDVI"]).otherwise(spectral.DIRECTIONS["BSI"])
    )
    return rows.select("event_id", (F.round(scalars.oriented(F.col("v"), direction), 6) + 0.0).alias("oriented"))


@query(
    "WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS red, l_extendedprice::DOUBLE AS nir, l_discount * 100 AS green, l_tax * 100 AS swir, l_quantity / 2 AS blue FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, round((nir - red) / (nir + red + 1e-9), 6) AS ndvi, round((nir - swir) / (nir + swir + 1e-9), 6) AS ndmi, round((green - nir) / (green + nir + 1e-9), 6) AS ndwi, "
    "round(swir / (nir + 1e-9), 6) AS msi, round(((swir + red) - (nir + blue)) / ((swir + red) + (nir + blue) + 1e-9), 6) AS bsi, round((red + green + blue) / 3, 6) AS brightness FROM b"
)
def spectral_indices(spark, sf_dir):
    b = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("red"), F.col("l_extendedprice").cast("double").alias("nir"), (F.col("l_discount") * 100).alias("green"), (F.col("l_tax") * 100).alias("swir"), (F.col("l_quantity") / 2).alias("blue"))
    red, nir, green, swir, blue = (F.col(c) for c in ("red", "nir", "green", "swir", "blue"))
    made = {"ndvi": spectral.ndvi(red, nir), "ndmi": spectral.ndmi(nir, swir), "ndwi": spectral.ndwi(green, nir), "msi": spectral.msi(nir, swir), "bsi": spectral.bsi(blue, red, nir, swir), "brightness": spectral.brightness(red, green, blue)}
    return b.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for n, c in made.items()])


@query(
    "WITH x AS (SELECT l_partkey AS k, l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS v FROM lineitem), m AS (SELECT k, quantile_cont(v, 0.5) AS med FROM x GROUP BY k), "
    "q AS (SELECT x.k, quantile_cont(abs(v - med), 0.5) AS mad FROM x JOIN m ON x.k = m.k GROUP BY x.k) "
    "SELECT l_orderkey, l_linenumber, round((v - med) / (mad * 1.4826::DOUBLE + 1e-9), 3) + 0.0 AS z FROM x JOIN m ON x.k = m.k JOIN q ON x.k = q.k WHERE mad > 0"
)
def series_robust_z(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("v"))
    stats = robust.group_statistics(rows, ["l_partkey"], "v").where("mad > 0").select(F.col("l_partkey").alias("k"))
    return robust.series_z(rows, ["l_partkey"], "v").join(stats, F.col("l_partkey") == F.col("k"), "left_semi").select("l_orderkey", "l_linenumber", (F.round("z", 3) + 0.0).alias("z"))


COMPONENTS = {"moisture": (["view"], 0.3), "vegetation": (["click"], 0.2), "brightness": (["purchase", "add_to_cart", "signup"], 0.3), "thermal": (["error"], 0.2), "geology": (["none"], 0.1)}
_COMPONENT_SQL = "CASE WHEN event_type = 'view' THEN 'moisture' WHEN event_type = 'click' THEN 'vegetation' WHEN event_type IN ('purchase', 'add_to_cart', 'signup') THEN 'brightness' WHEN event_type = 'error' THEN 'thermal' END"


@query(
    f"WITH c AS (SELECT user_id, ts::DATE AS obs_date, {_COMPONENT_SQL} AS component, avg(greatest(value - 50, 0)) AS s FROM events WHERE {_COMPONENT_SQL} IS NOT NULL GROUP BY ALL), "
    "w AS (SELECT *, CASE component WHEN 'moisture' THEN 0.3 WHEN 'vegetation' THEN 0.2 WHEN 'brightness' THEN 0.3 ELSE 0.2 END::DOUBLE AS w FROM c) "
    "SELECT user_id, obs_date::VARCHAR AS obs_date, round(sum(s * w) / sum(w), 8) AS composite FROM w GROUP BY ALL"
)
def composite_map(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("obs_date"), F.col("event_type").alias("name"), (F.col("value") - 50).alias("z"))
    rows = composite.assign_components(rows, {c: i for c, (i, _) in COMPONENTS.items()})
    got = composite.composite_map(rows, {c: w for c, (_, w) in COMPONENTS.items()}, ["user_id", "obs_date"])
    return got.select("user_id", F.col("obs_date").cast("string").alias("obs_date"), F.round("composite", 8).alias("composite"))


@query(
    f"WITH p AS (SELECT DISTINCT {_COMPONENT_SQL} AS c FROM events), w(c, w) AS (VALUES ('moisture', 0.3), ('vegetation', 0.2), ('brightness', 0.3), ('thermal', 0.2), ('geology', 0.1)) "
    "SELECT 'missing_component_' || w.c AS flag FROM w LEFT JOIN p ON w.c = p.c WHERE p.c IS NULL"
)
def composite_missing_components(spark, sf_dir):
    rows = composite.assign_components(read(spark, sf_dir, "events").select(F.col("event_type").alias("name")), {c: i for c, (i, _) in COMPONENTS.items()})
    return composite.composite_flags(rows, {c: w for c, (_, w) in COMPONENTS.items()})
