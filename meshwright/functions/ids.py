"""Identifier and text normalisation as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space at the ends of ids and texts.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def trim_sql(c: str) -> str:
    """SQL of ``trimmed``. (One SQL text is one call to the JVM; the same as column functions is dozens.)"""
    return f"nullif(btrim({c}, '{BLANKS}'), '')"


def id_sql(c: str) -> str:
    return f"lower({trim_sql(c)})"


def _named(value: str) -> str:
    return value if re.fullmatch(r"[A-Za-z_][\w.]*", value) else f"`{value}`"


def trimmed(value: str | Column) -> Column:
    """The text without white space at its ends, null where nothing is left."""
    if isinstance(value, str):
        return F.expr(trim_sql(_named(value)))
    text = F.btrim(value, F.lit(BLANKS))
    return F.when(text != "", text)


def norm_id(value: str | Column) -> Column:
    """The id trimmed and in lower case, null where it has no value."""
    return F.expr(id_sql(_named(value))) if isinstance(value, str) else F.lower(trimmed(value))


def text_or_empty(value: str | Column) -> Column:
    """The trimmed text with letter case kept; null becomes the empty text."""
    return F.expr(f"coalesce({trim_sql(_named(value))}, '')") if isinstance(value, str) else F.coalesce(trimmed(value), F.lit(""))


def id_or_empty(value: str | Column) -> Column:
    return F.expr(f"coalesce({id_sql(_named(value))}, '')") if isinstance(value, str) else F.coalesce(norm_id(value), F.lit(""))
