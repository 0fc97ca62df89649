"""Column expressions shared by the operators. Built-ins only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Time to live of a cached answer by query type, in seconds.
TTL_SECONDS = {"Q1": 300, "Q2": 300, "Q3": 180, "Q4": 120, "Q5": 600}
DEFAULT_TTL_SECONDS = 300

# Length of one degree of latitude, in kilometres.
KM_PER_DEGREE = 111.32

# Epoch seconds from the year 10000 on have no four-digit year.
_MAX_EPOCH_SECONDS = 253402300800


def ratio(part: Column, whole: Column, digits: int = 4, empty: float | None = 0.0) -> Column:
    """``part / whole`` rounded; ``empty`` where the denominator is not positive."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(empty).cast("double"))


def query_type_name(query_type: Column) -> Column:
    """Upper-cased query type; null and empty text become UNK."""
    return F.upper(F.coalesce(F.nullif(query_type, F.lit("")), F.lit("UNK")))


def epoch_seconds_to_timestamp(seconds: Column) -> Column:
    """Epoch seconds (double) to a timestamp, to the nearest microsecond.

    NaN, infinities and values beyond the calendar give null; a plain cast
    would raise on them under ANSI.
    """
    usable = F.abs(seconds) < _MAX_EPOCH_SECONDS  # false for NaN: Spark orders it last
    return F.when(usable, F.timestamp_micros(F.round(seconds * 1e6).cast("long")))


def iso_utc(timestamp: Column) -> Column:
    """ISO-8601 text with six fraction digits and an explicit offset (session time zone UTC)."""
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hundredths(size: Column) -> Column:
    """A number from 0 to 2^53 in hundredths: the exact binary value rounded, ties to even.

    With k the hundredths cut off the fraction, 25 * fraction is compared with (2k + 1) / 8: the
    fraction in two halves, so that their products are exact, and the difference near a tie too.
    """

    def rounded(rest: Column) -> Column:
        cut = F.floor(rest * 100)
        spread = rest * float(2**27 + 1)
        high = spread - (spread - rest)
        past = (high * 25 - (2 * cut + 1) / 8) + (rest - high) * 25
        up = F.when(past == 0, cut % 2).otherwise((past > 0).cast("long"))
        return cut + up

    return F.floor(size) * 100 + _once(size - F.floor(size), rounded)


# Nearer to a tie than this, or than this share of the number, the shortest decimal of a number may round the other way.
_NEAR_TIE, _NEAR_SHARE = 1e-6, 100 / 2**52


def two_digits(value: Column) -> Column:
    """Text with two fraction digits: the exact binary value rounded, ties to even, up to 2^53.

    ``format_string`` rounds the shortest decimal instead, and ties away from zero. That
    only matters beside a tie, and the long way is only taken there.
    """
    sign = F.when(value.cast("string").startswith("-"), "-").otherwise("")

    def split(n: Column) -> Column:
        digits = F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(3)), F.lit("0"))
        return F.regexp_replace(digits, "(..)$", ".$1")

    size = F.abs(value)
    rest = (size - F.floor(size)) * 100
    beside = (size < float(2**53)) & (F.abs(rest - F.floor(rest) - 0.5) < _NEAR_TIE + size * _NEAR_SHARE)
    exact = F.concat(sign, _once(_hundredths(size), split))
    return F.when(beside, exact).otherwise(F.format_string("%.2f", value))


def can_be_keyed(query_type: Column, params: dict[str, Column]) -> Column:
    """Whether ``cache_key`` gives a key: the type is known and its zones are there."""
    kind = F.upper(query_type)
    zones = F.when(kind == "Q4", params["zone_a"].isNotNull() & params["zone_b"].isNotNull()).otherwise(params["zone_id"].isNotNull())
    return F.coalesce(kind.isin(*TTL_SECONDS), F.lit(False)) & zones


def cache_key(query_type: Column, params: dict[str, Column]) -> Column:
    """Key text of a request; null where the type is unknown or a zone is missing."""
    kind = F.upper(query_type)
    confidence = two_digits(F.coalesce(params["confidence_min"], F.lit(0.0)))
    bins = F.coalesce(params["bins"], F.lit(5)).cast("string")
    zone = params["zone_id"]
    first = (
        F.when(kind == "Q1", F.concat(F.lit("count:"), zone))
        .when(kind == "Q2", F.concat(F.lit("area:"), zone))
        .when(kind == "Q3", F.concat(F.lit("density:"), zone))
        .when(kind == "Q4", F.concat(F.lit("compare:density:"), params["zone_a"], F.lit(":"), params["zone_b"]))
        .when(kind == "Q5", F.concat(F.lit("confidence_dist:"), zone))
    )
    # The number once, not once per type: its expression is long.
    name = F.when(kind == "Q5", ":bins=").otherwise(":conf=")
    return F.concat(first, name, F.when(kind == "Q5", bins).otherwise(confidence))


def ttl_seconds(query_type: Column) -> Column:
    """Time to live of an answer. Five fixed types, so a literal map instead of a join."""
    table = F.create_map(*[F.lit(v) for pair in TTL_SECONDS.items() for v in pair])
    return F.coalesce(F.try_element_at(table, F.upper(query_type)), F.lit(DEFAULT_TTL_SECONDS))


def safe_label(label: Column) -> Column:
    """Label usable in a file name."""
    return F.translate(label, "/ ", "__")


def box_area_km2(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> Column:
    """Flat-earth area of a bounding box."""
    height = (lat_max - lat_min) * KM_PER_DEGREE
    width = (lon_max - lon_min) * KM_PER_DEGREE * F.cos(F.radians((lat_min + lat_max) / 2))
    return F.abs(height * width)


def in_box(lat: Column, lon: Column, lat_min, lat_max, lon_min, lon_max) -> Column:
    """Inclusive on all four sides. NaN is in no box: Spark orders it above every bound."""
    return lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max)


def passes_confidence(confidence: Column, minimum: Column) -> Column:
    """Threshold filter; a minimum of zero or less lets every row pass, null ones too."""
    above = F.coalesce(~F.isnan(confidence) & (confidence >= minimum), F.lit(False))
    return (minimum <= 0) | above
