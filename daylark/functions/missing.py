"""Three different notions of a missing value, kept apart: at ingest, at preprocessing, at modelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TRUE, FALSE = ("true", "t", "1", "yes", "y"), ("false", "f", "0", "no", "n")


def number_or_null(text: Column) -> Column:
    """A finite double, or null: a pattern guards the cast, which takes more than numbers."""
    value = F.when(F.trim(text).rlike(NUMBER), F.trim(text)).try_cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def ingest_text(text: Column) -> Column:
    """Trimmed text; null if empty, ``nan`` or ``null`` in any case."""
    trimmed = F.trim(text)
    return F.when(~F.lower(trimmed).isin("", "nan", "null"), trimmed)


def ingest_value(text: Column, kind: str) -> Column:
    """Coercion of a CSV field to string, number, int (truncated), bool or json text."""
    clean = ingest_text(text)
    if kind == "number":
        return number_or_null(clean)
    if kind == "int":
        value = number_or_null(clean)
        return F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("int")
    if kind == "bool":
        return F.when(F.lower(clean).isin(*TRUE), F.lit(True)).when(F.lower(clean).isin(*FALSE), F.lit(False))
    if kind in ("string", "json"):
        return clean
    raise ValueError(f"no such coercion: {kind}")


def is_placeholder(text: Column) -> Column:
    return F.trim(text).isin("-", "--")


def preprocess_missing(text: Column) -> Column:
    """Whether preprocessing takes the text for missing; the word ``null`` is not missing here."""
    return text.isNull() | F.upper(F.trim(text)).isin("", "-", "--", "NA", "N/A", "NAN")


def preprocess_number(text: Column) -> Column:
    return F.when(~preprocess_missing(text), number_or_null(text))


def preprocess_ordinal(text: Column) -> Column:
    """Numbers in their shortest form, other text as it is."""
    clean = F.when(~preprocess_missing(text), F.trim(text))
    return F.coalesce(number_or_null(clean).cast("string"), clean)


def model_number(text: Column) -> Column:
    return F.when(~F.upper(F.trim(text)).isin("", "-", "--", "NA", "N/A"), number_or_null(text))
