"""Robust z-scores: median and scaled MAD within groups, population deviation where the MAD vanishes.

Statistics are aggregates (partial sums before the shuffle), joined back to
the rows; a group's rows never meet in one task. `percentile` keeps a group's
distinct values; for groups too large for that, `exact_quantile` with
`bracketed=True` first narrows the rank by a sketch of bounded size and then
counts only the few values around it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.scalars import finite, oriented

MAD_SCALE, EPSILON = 1.4826, 1e-6


def zone_known(zone: Column, kind: str) -> Column:
    """False for background: null, empty text, 0 and NaN."""
    if kind == "string":
        return zone.isNotNull() & (zone != "")
    if kind in ("double", "float"):
        return zone.isNotNull() & ~F.isnan(zone) & (zone != 0)
    return zone.isNotNull() & (zone != 0)


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str, bracketed: bool = False, accuracy: int = 1000) -> DataFrame:
    """The q quantile (linear between neighbours) of each group, exactly; nulls don't count."""
    if not bracketed:
        return df.groupBy(*keys).agg(F.percentile(value, F.lit(q)).alias(name))
    gap = 2.0 / accuracy
    rough = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("__n"), F.percentile_approx(value, F.array(F.lit(max(0.0, q - gap)), F.lit(min(1.0, q + gap))), accuracy * 2).alias("__b")
    )
    on = None
    right = rough.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__n", F.col("__b")[0].alias("__lo"), F.col("__b")[1].alias("__hi"))
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        on = same if on is None else on & same
    near = df.where(F.col(value).isNotNull()).join(right, on)
    v = F.col(value)
    inside = near.groupBy(*keys).agg(
        F.first("__n").alias("__n"),
        F.count_if(v < F.col("__lo")).alias("__below"),
        F.sort_array(F.collect_list(F.when((v >= F.col("__lo")) & (v <= F.col("__hi")), v))).alias("__v"),
    )
    rank = F.lit(q) * (F.col("__n") - 1)
    at = F.floor(rank) - F.col("__below")
    low = F.try_element_at("__v", (at + 1).cast("int"))
    high = F.coalesce(F.try_element_at("__v", (at + 2).cast("int")), low)
    return inside.select(*keys, (low + (high - low) * (rank - F.floor(rank))).alias(name))


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on null-safe keys; the right side has one row for each group."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"__r_{k}"])
        on = same if on is None else on & same
    return left.join(renamed, on, "left").drop(*[f"__r_{k}" for k in keys])


def group_statistics(df: DataFrame, keys: Sequence[str], value: str, epsilon: float = EPSILON, least: int = 1, bracketed: bool = False) -> DataFrame:
    """One row for each group: valid_count, median, mad, deviation, scale and status.

    status is ok, mad_fallback_std, constant or insufficient; scale is null for
    the last two.
    """
    rows = df.withColumn("__v", finite(F.col(value)))
    first = rows.groupBy(*keys).agg(F.count("__v").alias("valid_count"), F.percentile("__v", F.lit(0.5)).alias("median") if not bracketed else F.lit(None).cast("double").alias("median"), F.stddev_pop("__v").alias("deviation"))
    if bracketed:
        first = _joined(first.drop("median"), exact_quantile(rows, keys, "__v", 0.5, "median", True), keys)
    apart = _joined(rows.where(F.col("__v").isNotNull()), first.select(*keys, "median"), keys).withColumn("__d", F.abs(F.col("__v") - F.col("median")))
    spread = exact_quantile(apart, keys, "__d", 0.5, "mad", bracketed)
    both = _joined(first, spread, keys)
    scaled = F.col("mad") * MAD_SCALE
    status = (
        F.when(F.col("valid_count") < max(least, 1), "insufficient")
        .when(scaled > epsilon, "ok")
        .when(F.col("deviation") > epsilon, "mad_fallback_std")
        .otherwise("constant")
    )
    scale = F.when(status == "ok", scaled).when(status == "mad_fallback_std", F.col("deviation"))
    return both.select(*keys, "valid_count", "median", "mad", "deviation", scale.alias("scale"), status.alias("status"))


def robust_z(df: DataFrame, keys: Sequence[str], value: str, direction: Column | str = "", epsilon: float = EPSILON, least: int = 1, bracketed: bool = False) -> DataFrame:
    """Rows with z: the oriented robust z-score within their group, null where there is none."""
    stats = group_statistics(df, keys, value, epsilon, least, bracketed).select(*keys, "median", "scale")
    out = _joined(df, stats, keys)
    return out.withColumn("z", oriented((finite(F.col(value)) - F.col("median")) / F.col("scale"), direction)).drop("median", "scale")


def zone_flags(stats: DataFrame, zone: str) -> DataFrame:
    """Flags of group statistics: one row for each zone with something to tell."""
    names = {"insufficient": "insufficient_valid_pixels_", "constant": "constant_field_", "mad_fallback_std": "mad_fallback_std_"}
    text = None
    for status, prefix in names.items():
        label = F.concat(F.lit(prefix), F.col(zone).cast("string"))
        text = F.when(F.col("status") == status, label) if text is None else text.when(F.col("status") == status, label)
    return stats.select(zone, text.alias("flag")).where("flag is not null")


def stratum_label(*columns: Column) -> Column:
    """Trimmed context values joined by underscores; null if one is blank."""
    parts = [F.trim(F.coalesce(c.cast("string"), F.lit(""))) for c in columns]
    blank = parts[0] == ""
    for p in parts[1:]:
        blank = blank | (p == "")
    return F.when(~blank, F.concat_ws("_", *[F.regexp_replace(p, " ", "_") for p in parts]))


def peer_residual(pixels: DataFrame, zones: DataFrame, zone: str, stratum: str, value: str, layer: Sequence[str] = (), direction: Column | str = "", epsilon: float = EPSILON, least: int = 1) -> DataFrame:
    """Pixels with z against all pixels of the zones that share a stratum; strata with fewer than two zones give null.

    zones has one row for each zone; blank strata take no part. Only zones
    that have pixels count.
    """
    z = zones.select(F.col(zone).alias("__zone"), F.col(stratum).alias("__stratum")).where("__stratum is not null and __stratum <> ''")
    rows = pixels.join(z, pixels[zone] == z["__zone"], "left").drop("__zone")
    # Zones per stratum come from the distinct (layer, stratum, zone), small however many pixels there are.
    peers = rows.where("__stratum is not null").groupBy(*layer, "__stratum", zone).agg(F.lit(1).alias("__one")).groupBy(*layer, "__stratum").agg(F.count("*").alias("__peers"))
    keys = [*layer, "__stratum"]
    enough = _joined(rows, peers, keys)
    enough = enough.withColumn("__v", F.when(F.col("__peers") >= 2, F.col(value)))
    return robust_z(enough, keys, "__v", direction, epsilon, least).drop("__v", "__peers").withColumnRenamed("__stratum", "stratum")


def temporal_residual(rows: DataFrame, series: Sequence[str], place: Sequence[str], date: str, value: str, direction: Column | str = "", epsilon: float = EPSILON, least_dates: int = 2) -> DataFrame:
    """Rows with z of each value against the same place on all dates of its series.

    Undated rows give null, as do series with fewer than least_dates dates and
    places with fewer than two values. The deviation stands in for a vanishing
    MAD without a flag.
    """
    keys = [*series, *place]
    dated = rows.withColumn("__v", F.when(F.col(date).isNotNull(), finite(F.col(value))))
    dates = dated.where(F.col(date).isNotNull()).groupBy(*series).agg(F.count_distinct(date).alias("__dates"))
    stats = group_statistics(dated, keys, "__v", epsilon, 2).select(*keys, "median", "scale")
    out = _joined(_joined(dated, dates, list(series)), stats, keys)
    z = (F.col("__v") - F.col("median")) / F.col("scale")
    return out.withColumn("z", F.when(F.col("__dates") >= least_dates, oriented(z, direction))).drop("__v", "__dates", "median", "scale")


def series_z(rows: DataFrame, keys: Sequence[str], value: str, epsilon: float = 1e-9) -> DataFrame:
    """(x - median) / (1.4826 MAD + epsilon), without a fallback."""
    stats = group_statistics(rows, keys, value).select(*keys, "median", "mad")
    out = _joined(rows, stats, keys)
    return out.withColumn("z", (finite(F.col(value)) - F.col("median")) / (F.col("mad") * MAD_SCALE + epsilon)).drop("median", "mad")
