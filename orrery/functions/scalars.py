"""Small scalar rules shared by the operators, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """The value where it is a finite number, else null (NaN is above infinity here)."""
    v = value.cast("double")
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def number_or_zero(value: Column) -> Column:
    return F.coalesce(finite(value), F.lit(0.0))


def clamp01(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def positive_support(value: Column) -> Column:
    """max(value, 0), null where the value is."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def ringness(annulus: Column, centre: Column, background: Column) -> Column:
    return annulus - F.greatest(centre, background)


def oriented(z: Column, direction: Column | str) -> Column:
    """A z-score turned so that higher means stronger evidence.

    Directions that name higher or lower values, or larger absolute ones, take
    the absolute value; lower values the negative; the rest stay.
    """
    d = F.lower(F.lit(direction) if isinstance(direction, str) else direction)
    both = d.contains("higher_or_lower") | d.contains("larger_absolute")
    return F.when(both, F.abs(z)).when(d.contains("lower_values"), -z).otherwise(z)


def plain_number(value: Column) -> Column:
    """Six decimals without trailing zeros: 0.5, 100, 1.25."""
    return F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")


def safe_part(text: Column, default: str = "unknownfield") -> Column:
    """Text fit for an id: other characters to one underscore, no leading or trailing dots, dashes or underscores, lower case."""
    cleaned = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", ""))
    return F.when(cleaned == "", F.lit(default)).otherwise(cleaned)


def file_stem(text: Column, default: str = "candidate") -> Column:
    """Text fit for a file name."""
    cleaned = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.when(cleaned == "", F.lit(default)).otherwise(cleaned)


def learning_label(text: Column) -> Column:
    return F.translate(F.lower(F.trim(F.coalesce(text, F.lit("")))), "-", "_")


def review_label(text: Column) -> Column:
    """Lower case with underscores; blank, unlabeled, unknown and uncertain become empty."""
    label = F.translate(F.lower(F.trim(F.coalesce(text, F.lit("")))), " -", "__")
    return F.when(label.isin("unlabeled", "unknown", "uncertain"), F.lit("")).otherwise(label)


def text_list(text: Column) -> Column:
    """A JSON list of texts; other text is a list of one; blank is empty."""
    parsed = F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})
    looks = F.trim(text).startswith("[")
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.array().cast("array<string>")).when(looks & parsed.isNotNull(), F.filter(parsed, lambda x: x.isNotNull() & (x != ""))).otherwise(F.array(text))


def feature_component(name: Column) -> Column:
    """The evidence component of a feature name; the first rule that matches, null if none."""
    n = F.lower(name)

    def has(*tokens: str) -> Column:
        found = n.contains(tokens[0])
        for t in tokens[1:]:
            found = found | n.contains(t)
        return found

    # Tokens of each component.
    return (
        F.when(has("post_rain", "drying"), "post_rain")
        .when(has("ndmi", "ndwi", "msi", "moisture"), "moisture")
        .when(has("ndvi", "ndre", "red_edge", "red-edge", "vegetation"), "vegetation")
        .when(has("bsi", "brightness", "bare_soil", "bare-soil"), "brightness")
        .when(has("lst", "thermal", "temperature"), "thermal")
        .when(has("sar", "vv", "vh"), "sar")
        .when(has("geology"), "geology")
    )


def season_count(dates: Column) -> Column:
    """Distinct years of a list of ISO dates."""
    return F.size(F.array_distinct(F.transform(F.filter(dates, lambda d: d != ""), lambda d: F.substring(d, 1, 4))))


def flags(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in order."""
    return F.filter(F.array(*[F.when(condition, F.lit(name)) for condition, name in rules]), lambda x: x.isNotNull())


def flag_union(*lists: Column) -> Column:
    """Sorted distinct flags of several lists; null lists are empty."""
    out = F.coalesce(lists[0], F.array().cast("array<string>"))
    for other in lists[1:]:
        out = F.array_union(out, F.coalesce(other, F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(out))
