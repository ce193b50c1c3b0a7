"""Text normalisation: column functions, and the same for a query on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is trimmed from either end, and the white space that collapses to one space.
TRIMMED = " \t\r\n"
SPACES = r"[\t\n\f\r\p{Z}]+"
_PY_SPACES = re.compile("[\\t\\n\\f\\r\\u0020\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def norm_ws(c: Column) -> Column:
    """Trimmed, then every run of white space one space; case stays, null stays null."""
    return F.regexp_replace(F.btrim(c, F.lit(TRIMMED)), SPACES, " ")


def norm_text(c: Column) -> Column:
    return norm_ws(F.lower(c))


def norm_query(query: str) -> str:
    """What ``norm_text`` makes of a query string."""
    return _PY_SPACES.sub(" ", query.lower().strip(TRIMMED))


def is_blank(query: str | None) -> bool:
    return query is None or query.strip(TRIMMED) == ""
