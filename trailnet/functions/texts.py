"""File names, lists, countries and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Countries of a route code's first two letters that are in scope.
COUNTRIES = ("ES", "PT")


def listed(text: Column) -> Column:
    """The entries of a comma-separated list, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def fallback_filename(label: Column, ending: str = ".kml") -> Column:
    """Hyphens as underscores, and an ending."""
    return F.concat(F.translate(label, "-", "_"), F.lit(ending))


def header_filename(header: Column, fallback: Column) -> Column:
    """The base name in a Content-Disposition header, quoted or not; the fallback where there is none."""
    named = F.regexp_extract(header, r"""(?i)filename="?([^";]*)"?""", 1)
    return F.coalesce(F.nullif(base_name(F.trim(named)), F.lit("")), fallback)


def country(code: Column) -> Column:
    """ES for codes that start so, else PT."""
    return F.when(F.startswith(code, F.lit("ES")), "ES").otherwise("PT")


def cursor_label(metres: Column, slope: Column) -> Column:
    """Whole metres and, with its sign, whole percent."""
    return F.concat(F.format_string("%.0f m", metres), F.lit("  "), F.format_string("%+.0f%%", slope))


def newest_build(days: Column, today: Column, within: int = 14) -> Column:
    """The latest of an array of dates that is no later than today and less than within days old."""
    return F.array_max(F.filter(days, lambda d: (d <= today) & (d > F.date_sub(today, within))))
