"""Labels and badges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a leading phrase in capitals, digits, commas and hyphens before a capitalised word.
CAPS_PHRASE = r"^([A-Z0-9 ,\-]+?)(?=\s[A-Z][a-z])"


def fill_missing_label(label: Column, description: Column, code: Column) -> Column:
    """A null label becomes the description's leading phrase in capitals, else the code; ``''`` stays."""
    return F.coalesce(label, F.btrim(F.regexp_substr(description, F.lit(CAPS_PHRASE)), F.lit(" \t\r\n")), code)


def badge_label(status: Column) -> Column:
    return F.when(status == "current", "Current").otherwise("Archived reference")


def badge_style(status: Column) -> Column:
    return F.when(status == "current", "success").otherwise("secondary")
