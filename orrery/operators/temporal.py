"""Pairing by time: ratios on a date, brackets around events, days since the last event, first-to-last differences.

Brackets are found on layer records (an id, a date, a value or key), sorted
once by a window for each series; pixels follow by an equi-join on the layer
ids, so no range join is needed however many pixels there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.spectral import EPSILON


def first_of_date(layers: DataFrame, series: Sequence[str], date: str, layer: str) -> DataFrame:
    """Of several layers of a series on one date (null is a date too) the one with the smallest id."""
    place = Window.partitionBy(*series, date).orderBy(layer)
    return layers.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def paired_ratio(vv: DataFrame, vh: DataFrame, keys: Sequence[str], date: str, value: str, layer: str) -> DataFrame:
    """Full outer pairing by date: keys, date, ratio and flag.

    Dates may be null on both sides and then pair. The flag names the missing
    side; the ratio is null then.
    """
    a = first_of_date(vv, keys, date, layer).select(*[F.col(k).alias(f"a_{k}") for k in keys], F.col(date).alias("a_date"), F.col(value).alias("a_value"), F.lit(True).alias("has_a"))
    b = first_of_date(vh, keys, date, layer).select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col(date).alias("b_date"), F.col(value).alias("b_value"), F.lit(True).alias("has_b"))
    on = F.col("a_date").eqNullSafe(F.col("b_date"))
    for k in keys:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    both = a.join(b, on, "full_outer")
    label = F.coalesce(F.col("a_date").cast("string"), F.col("b_date").cast("string"), F.lit("undated"))
    flag = F.when(F.col("has_a").isNull(), F.concat(F.lit("missing_sentinel1_VV_for_ratio_"), label)).when(F.col("has_b").isNull(), F.concat(F.lit("missing_sentinel1_VH_for_ratio_"), label))
    return both.select(
        *[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys], F.coalesce("a_date", "b_date").alias(date),
        F.try_divide(F.col("a_value"), F.col("b_value") + EPSILON).alias("ratio"), flag.alias("flag"),
    )


def bracket(observations: DataFrame, events: DataFrame, series: Sequence[str], when: str, order: Sequence[str], payload: Sequence[str], event_id: str, inclusive_before: bool = False) -> DataFrame:
    """For each event of a series the last observation before and the first after it.

    before is strictly earlier, or not later with inclusive_before; after is
    strictly later. Of observations at one time the last by `order` is taken
    before and the first after. Returns the series, the event's id and time,
    before and after (structs of `when` and the payload, null if there is
    none). One sort for each series: observations and events are merged.
    """
    item = F.struct(F.col(when).alias(when), *[F.col(c) for c in payload])
    none = F.lit(None)
    obs = observations.select(*series, F.col(when).alias("__t"), item.alias("__item"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], none.cast(events.schema[event_id].dataType).alias("__event"), F.lit(1).alias("__kind"))
    types = [observations.schema[c].dataType for c in order]
    evt = events.select(*series, F.col(when).alias("__t"), none.cast(obs.schema["__item"].dataType).alias("__item"), *[none.cast(t).alias(f"__o{i}") for i, t in enumerate(types)], F.col(event_id).alias("__event"), F.lit(0).alias("__kind"))
    rows = obs.unionByName(evt)
    ties = [F.col(f"__o{i}") for i in range(len(order))]
    kind = F.col("__kind")
    # Before: events stand in front of observations of their time (behind them if inclusive). After: always behind.
    early = Window.partitionBy(*series).orderBy("__t", (-kind if inclusive_before else kind), *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    late = Window.partitionBy(*series).orderBy("__t", -kind, *ties).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = rows.withColumn("before", F.last("__item", ignorenulls=True).over(early)).withColumn("after", F.first("__item", ignorenulls=True).over(late))
    return found.where(kind == 0).select(*series, F.col("__event").alias(event_id), F.col("__t").alias(when), "before", "after")


def drying_delta(name: Column, before: Column, after: Column) -> Column:
    """Moisture lost: before less after, the other way round for MSI."""
    return F.when(name == "MSI", after - before).otherwise(before - after)


def event_response(before: Column, after: Column) -> Column:
    return F.abs(after - before)


def days_since(observations: DataFrame, events: DataFrame, series: Sequence[str], when: str, event_id: str) -> DataFrame:
    """Observations with the latest event on or before their day (of equals the largest id) and the days since then."""
    seen = F.struct(F.col(when).alias("t"), F.col(event_id).alias("id"))
    columns = observations.columns
    obs = observations.select(*columns, F.to_date(when).alias("__day"), F.lit(None).cast(events.select(seen.alias("s")).schema["s"].dataType).alias("__seen"), F.lit(1).alias("__kind"))
    evt = events.select(*[F.col(c) if c in series else F.lit(None).cast(observations.schema[c].dataType).alias(c) for c in columns], F.to_date(when).alias("__day"), seen.alias("__seen"), F.lit(0).alias("__kind"))
    upto = Window.partitionBy(*series).orderBy("__day", "__kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = obs.unionByName(evt).withColumn("__last", F.max("__seen").over(upto))
    return found.where("__kind = 1").select(*columns, F.col("__last.id").alias("last_event"), F.date_diff("__day", F.to_date("__last.t")).alias("days_since"))


def first_to_last(rows: DataFrame, keys: Sequence[str], date: str, layer: str, value: str) -> DataFrame:
    """Last value less first by (date, layer) for groups with two layers or more."""
    at = F.struct(F.coalesce(F.col(date).cast("string"), F.lit("")), F.col(layer))
    got = rows.groupBy(*keys).agg(F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"), F.count_distinct(layer).alias("layers"))
    return got.where("layers >= 2").select(*keys, (F.col("last_value") - F.col("first_value")).alias("difference"))


def in_months(name: Column, date: Column, vegetation: Sequence[int], bare_soil: Sequence[int]) -> Column:
    """Whether a layer lies in its season: vegetation-like names in the vegetation months, brightness-like in the bare-soil months; others and undated ones always."""
    n, month = F.lower(name), F.month(F.to_date(date))

    def has(*tokens: str) -> Column:
        return F.exists(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(n, t))

    green = has("ndvi", "ndre", "red_edge", "red-edge", "vegetation")
    bare = has("bsi", "brightness", "bare_soil", "bare-soil")
    return F.when(date.isNull(), F.lit(True)).when(green, month.isin(*vegetation)).when(bare, month.isin(*bare_soil)).otherwise(F.lit(True))


def season_filter(layers: DataFrame, name: str, date: str, vegetation: Sequence[int], bare_soil: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(layers in season, flags of the others)."""
    keep = in_months(F.col(name), F.col(date), vegetation, bare_soil)
    out = layers.where(~keep).select(F.concat_ws("_", F.lit("skipped_out_of_window"), name, F.coalesce(F.col(date).cast("string"), F.lit("undated"))).alias("flag")).distinct()
    return layers.where(keep), out


def rain_scalars(events: DataFrame, date: str = "event_date", rainfall: str = "rainfall_mm", context: str = "context_id") -> DataFrame:
    """Two records for each event, rain_event (1) and rainfall_mm; the latter's flag if the amount is missing."""
    pairs = F.array(
        F.struct(F.lit("rain_event").alias("name"), F.lit(1.0).alias("value"), F.lit(None).cast("string").alias("flag")),
        F.struct(F.lit("rainfall_mm").alias("name"), F.col(rainfall).cast("double").alias("value"), F.when(F.col(rainfall).isNull(), F.concat(F.lit("missing_rainfall_mm_"), F.col(date).cast("string"))).alias("flag")),
    )
    return events.select(F.col(context), F.col(date), F.explode(pairs).alias("p")).select(context, date, "p.name", "p.value", "p.flag")
