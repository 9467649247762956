"""Free attributes: names mapped to fields, masking, expansion of definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import trimmed
from .text import token_text


def alias_map(aliases: dict[str, list[str]]) -> Column:
    """Map from a name's token text to its field; the first field that claims a name has it."""
    pairs: dict[str, str] = {}
    for field, names in aliases.items():
        for name in (field, *names):
            key = " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split())
            pairs.setdefault(key, field)
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def semantic_fields(entries: Column, aliases: dict[str, list[str]]) -> Column:
    """map field -> value of array<struct(key, value)>: names resolved by alias, the first value of a field stays, blank ones don't count."""
    known = alias_map(aliases)
    named = F.transform(entries, lambda e: F.struct(known[token_text(e["key"], accents=False)].alias("f"), trimmed(e["value"]).alias("v")))
    useful = F.filter(named, lambda e: e["f"].isNotNull() & e["v"].isNotNull())
    first = F.filter(useful, lambda e, i: F.array_position(F.transform(useful, lambda x: x["f"]), e["f"]) == i + 1)
    return F.map_from_entries(first)


def masked(value: Column, permitted: Column | bool) -> Column:
    """The trimmed value for those who may see it, else null."""
    return F.when(F.lit(permitted) if isinstance(permitted, bool) else permitted, F.trim(value))


def port_ids(owner: Column, kind: Column, count: Column) -> Column:
    """``owner/interface/<slug>/<ordinal>`` for each of ``count`` ports; none for a count below 1 or null."""
    slug = F.regexp_replace(token_text(kind, accents=False), " ", "-")
    some = F.coalesce(count, F.lit(0))
    return F.when(some > 0, F.transform(F.sequence(F.lit(1), F.greatest(some, F.lit(1))), lambda i: F.concat_ws("/", owner, F.lit("interface"), slug, F.lpad(i.cast("string"), 2, "0")))).otherwise(F.array().cast("array<string>"))
