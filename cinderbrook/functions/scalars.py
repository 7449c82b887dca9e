"""Column expressions for codes, units, texts, dates, event sets, categories and spectral bands."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameter code -> (factor to the element's mass, whether the unit label changes).
CODE_FACTORS = {"71851": 14.0 / 62.0, "71856": 14.0 / 46.0, "71846": 14.0 / 18.0, "71845": 14.0 / 18.0, "00660": 0.3261}
#: Factors of lower-case unit patterns, tried in order, by analyte.
PATTERN_FACTORS = {
    "nitrate": (("%micromoles%", 14.0 / 1000.0), ("%um%", 14.0 / 1000.0)),
    "ammonium": (("%micromoles%", 0.014007), ("%um%", 0.014007)),
    "orthop": (("%um%", 0.030974),),
}
#: Unit arithmetic.
CFS_TO_M3S = 0.028316846592
ACRES_TO_KM2 = 0.0040468564
ACRES_PER_KM2 = 247.11
NUMERIC_TEXT = r"^[+-]?([0-9]*\.?[0-9]+)([eE][+-]?[0-9]+)?$"
IDENTIFIER = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")


def convert_by_code(value: Column, code: Column, factors: Mapping[str, float] = CODE_FACTORS) -> Column:
    """value times its code's factor; codes without one leave it as it is."""
    factor = F.lit(1.0)
    for one, f in factors.items():
        factor = F.when(code == one, F.lit(float(f))).otherwise(factor)
    return value * factor


def unit_by_code(unit: Column, code: Column, label: str, factors: Mapping[str, float] = CODE_FACTORS) -> Column:
    return F.when(code.isin(*factors), F.lit(label)).otherwise(unit)


def convert_by_pattern(value: Column, unit: Column, factors: Sequence[tuple[str, float]]) -> Column:
    """value times the factor of the first pattern that the unit matches without regard to case."""
    found = value
    for pattern, factor in reversed(factors):
        found = F.when(unit.ilike(pattern), value * F.lit(float(factor))).otherwise(found)
    return found


def mapped(column: Column, pairs: Mapping[str, object], default: Column | None = None) -> Column:
    """Value by exact key; other keys as they are, or `default`."""
    found = column if default is None else default
    for key, value in pairs.items():
        found = F.when(column == F.lit(key), F.lit(value)).otherwise(found)
    return found


def first_match(column: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Label of the first regular expression, without regard to case, that is found in the column; else null."""
    found = F.lit(None).cast("string")
    for pattern, label in reversed(patterns):
        found = F.when(column.rlike(f"(?i){pattern}"), F.lit(label)).otherwise(found)
    return found


def matches(column: Column, pattern: str) -> Column:
    """Unanchored, without regard to case; null stays null, also when negated."""
    return column.rlike(f"(?i){pattern}")


def checked_identifier(name: str) -> str:
    if not IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def numeric_text(column: Column) -> Column:
    """The number that a trimmed text spells out; null for any other text."""
    text = F.trim(column)
    return F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double"))


def blank_to_null(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def without_sentinels(column: Column, sentinels: Sequence[float], low: float | None = None, high: float | None = None) -> Column:
    """null for fill values and for what lies outside [low, high]."""
    keep = ~column.isin(*sentinels) if sentinels else F.lit(True)
    if low is not None:
        keep &= column >= low
    if high is not None:
        keep &= column <= high
    return F.when(keep, column)


def is_summer(day: Column, first: int = 110, last: int = 250) -> Column:
    return F.dayofyear(day).between(first, last)


def years_before(day: Column, years: int) -> Column:
    """29 February becomes the 28th in common years."""
    return F.add_months(day, -12 * years)


def years_after(day: Column, years: int) -> Column:
    return F.add_months(day, 12 * years)


def local_date(text: Column, pattern: str = "yyyy-MM-dd'T'HH:mm") -> Column:
    """The date in a local time stamp's text, without a detour through UTC."""
    return F.to_date(F.try_to_timestamp(text, F.lit(pattern)))


def interval(low: Column, high: Column) -> Column:
    """[low, high); a null bound is open."""
    return F.struct(low.alias("lo"), high.alias("hi"))


def interval_is_empty(low: Column, high: Column) -> Column:
    return F.coalesce(low >= high, F.lit(False))


def event_set(column: Column) -> Column:
    """Distinct members in order: the form in which sets are compared."""
    return F.array_sort(F.array_distinct(column))


def set_text(column: Column) -> Column:
    """An array as {a,b}."""
    return F.concat(F.lit("{"), F.array_join(column, ","), F.lit("}"))


def parse_set(column: Column) -> Column:
    """The members of a text {a,b}; none of {}."""
    inner = F.regexp_replace(column, "[{}]", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))


def parse_histogram(column: Column) -> Column:
    """The map of a text {code=count, ...}."""
    inner = F.regexp_replace(F.regexp_replace(column, r"[{}]", ""), r"\s", "")
    return F.str_to_map(inner, F.lit(","), F.lit("="))


def quartile_code(value: Column, p25: Column, p50: Column, p75: Column) -> Column:
    """1 to 4; a value on a boundary belongs to the lower quarter."""
    return F.when(value <= p25, 1).when(value <= p50, 2).when(value <= p75, 3).otherwise(4)


def percentile_band(value: Column, cuts: Sequence[Column], labels: Sequence[str]) -> Column:
    """Label of the first cut that value doesn't exceed; the last label beyond all cuts; null for null."""
    found = F.when(value.isNotNull(), F.lit(labels[-1]))
    for cut, label in reversed(list(zip(cuts, labels))):
        found = F.when(value <= cut, F.lit(label)).otherwise(found)
    return found


def slope_direction(slope: Column, edge: float = 0.2) -> Column:
    return F.when(slope >= edge, "positive").when(slope <= -edge, "negative").when(slope.isNotNull(), "neutral")


def bits_clear(mask: Column, bits: Sequence[int] = (3, 4, 5, 7)) -> Column:
    """None of the flags (cloud shadow, snow, cloud, water) is set."""
    return mask.bitwiseAND(F.lit(sum(1 << b for b in bits))) == 0


def reflectance(band: Column) -> Column:
    return band * F.lit(0.0000275) - F.lit(0.2)


def normalised_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def evi(nir: Column, red: Column, blue: Column) -> Column:
    return F.try_divide(F.lit(2.5) * (nir - red), nir + F.lit(6.0) * red - F.lit(7.5) * blue + F.lit(1.0))


def mirbi(swir1: Column, swir2: Column) -> Column:
    return F.lit(10.0) * swir1 - F.lit(9.8) * swir2 + F.lit(2.0)


def circular_mean(degrees: Column) -> Column:
    """Aggregate: the mean direction of angles in degrees."""
    return F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))))


def decade(day: Column) -> Column:
    return (F.floor(F.year(day) / 10) * 10).cast("int")


def depth_to_discharge(depth_mm: Column, area_m2: Column) -> Column:
    """mm a day over an area, in litres a second."""
    return depth_mm * F.lit(0.001) * area_m2 * F.lit(1000.0) / F.lit(86400.0)


def segment_years(day: Column, event_day: Column, years: int) -> Column:
    """'pre' in [event - years, event), 'post' in (event, event + years]; null elsewhere."""
    return F.when((day >= years_before(event_day, years)) & (day < event_day), "pre").when((day > event_day) & (day <= years_after(event_day, years)), "post")
