"""Column functions of labels and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_label(c: Column) -> Column:
    """Anything but letters, digits, dot and dash becomes an underscore, outer ones go, and nothing left is NA."""
    s = F.regexp_replace(F.trim(c), r"[^\p{L}\p{N}_.\-]+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.coalesce(F.when(s != "", s), F.lit("NA"))


def base_name(c: Column) -> Column:
    """A variable's name before a disambiguating suffix."""
    return F.split_part(c, F.lit("__"), F.lit(1))


def column_name(c: Column, ident: Column) -> Column:
    """A name for a column: blank or missing-like names give way to the id, white space to underscores."""
    s = F.regexp_replace(F.trim(c), r"\s+", "_")
    return F.when(s.isNull() | s.isin("", "nan", "NaN", "None"), ident).otherwise(s)
