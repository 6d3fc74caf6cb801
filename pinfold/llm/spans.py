"""Cut a text at the matches of a pattern and put it together again, in native columns.

``pieces`` has one element more than ``matches``; joining them alternately gives the text
back exactly, so a replacement touches nothing but its own match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def pieces(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def rebuild(parts: Column, inserts: Column) -> Column:
    """``parts[0] + inserts[0] + parts[1] + ...``; ``inserts`` is one shorter."""
    return F.array_join(F.zip_with(parts, F.concat(inserts, F.array(F.lit(""))), lambda p, i: F.concat(p, i)), "")
