"""Strings of labels, paths and annotation files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def replaced_suffix(name: Column, old: str, new: str) -> Column:
    """Every occurrence is replaced, wherever it stands."""
    return F.replace(name, F.lit(old), F.lit(new))


def player_label(number: Column, name: Column, null_text: str | None = "None") -> Column:
    """'#7 Name'; what is unknown reads as ``null_text``, or makes the label null where that is None."""
    if null_text is not None:
        number, name = F.coalesce(number, F.lit(null_text)), F.coalesce(name, F.lit(null_text))
    return F.concat(F.lit("#"), number, F.lit(" "), name)


def score_label(name: Column, score: Column) -> Column:
    return F.format_string("%s %.2f", name, score)


def xml_escaped(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value
