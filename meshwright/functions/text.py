"""Text functions: tokens, labels, folder paths."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words at the end of a device label that don't belong to its name.
LABEL_SUFFIXES = ("exp", "extended", "wp", "rekomendasi", "recommendation")
#: Names of folders that hold a layer, not a place.
LAYER_MARKERS = ("cable", "kabel", "cctv", "camera", "junction box", "juction box", "jucntion box", "tiang", "server", "switch", "router")
#: The same for the scope of mountings.
MOUNTING_MARKERS = ("cable", "kabel", "cctv", "camera", "junction", "junction box", "tiang", "pole", "server", "switch", "router", "lan", "fiber optic")
#: The folder below which places are named, and the group of everything else.
ROOT_FOLDER, OTHER_GROUP = "rjbt", "lainnya"


@F.pandas_udf(StringType())
def _without_accents(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ"), na_action="ignore")


def token_text(column: Column, accents: bool = True) -> Column:
    """Lower-case words of letters a-z and digits, apart by single blanks; null gives the empty text.

    ``accents``: resolve compatibility forms and drop combining marks, which
    takes a pass through Python; leave it out for plain ASCII columns.
    """
    text = _without_accents(column) if accents else column
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def snake_case(column: Column) -> Column:
    """camelCase and separators to words joined by ``_``."""
    parted = F.regexp_replace(F.regexp_replace(F.coalesce(column, F.lit("")), "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(parted, "^_+|_+$", ""))


def label_tokens(tokens: Column) -> Column:
    """Words of a token text, numbers without leading zeros."""
    words = F.filter(F.split(tokens, " "), lambda w: w != "")
    return F.transform(words, lambda w: F.when(w.rlike("^[0-9]+$"), F.regexp_replace(w, "^0+(?=[0-9])", "")).otherwise(w))


def without_decorators(words: Column) -> Column:
    """The label without its trailing decorations; two words always stay."""
    back = F.reverse(words)
    plain = F.filter(F.transform(back, lambda w, i: F.when(~w.isin(*LABEL_SUFFIXES), i)), lambda i: i.isNotNull())
    first = F.coalesce(F.try_element_at(plain, F.lit(1)), F.size(words))
    return F.slice(words, 1, F.greatest(F.size(words) - first, F.least(F.size(words), F.lit(2))))


def label_aliases(words: Column, tokens: Column) -> Column:
    """The names by which a line may call the device, as arrays of words."""
    base = without_decorators(words)
    head, rest = F.try_element_at(base, F.lit(1)), F.slice(base, 2, F.greatest(F.size(base) - 1, F.lit(0)))
    second = F.try_element_at(base, F.lit(2))
    say = lambda *w: F.array(*map(F.lit, w))
    many, none = F.size(base) > 1, F.lit(None).cast("array<string>")
    rack = tokens.rlike(r"(^|\s)(jb\s+)?(rack\s+server|server\s+rack)(\s|$)")
    candidates = F.array(
        F.when(F.size(words) > 0, words),
        F.when(F.size(words) > 0, base),
        F.when((head == "jb") & many, rest),
        F.when((head == "jb") & (second == "cctv") & (F.size(base) > 2), F.concat(say("jb"), F.slice(base, 3, F.greatest(F.size(base) - 2, F.lit(0))))),
        F.when(head.isin("cam", "camera", "kamera") & many, F.concat(say("c"), rest)),
        F.when(head == "server", say("svr")),
        *[F.when(rack, alias).otherwise(none) for alias in (say("rs"), say("cr"), say("svr", "office"))],
    )
    return F.array_distinct(F.filter(candidates, lambda a: a.isNotNull()))


def sequence_at(words: Column, alias: Column) -> Column:
    """The offsets (from 0) at which ``alias`` occurs in ``words``."""
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - F.size(alias), F.lit(0)))
    return F.filter(places, lambda i: F.slice(words, i + 1, F.greatest(F.size(alias), F.lit(1))) == alias)


def folder_segments(path: Column) -> Column:
    """The token texts of a folder path's segments."""
    parts = F.split(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), "/")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(F.lower(p), "[^a-z0-9]+", " "))), lambda p: p != "")


def _first_marker(segments: Column, markers: tuple[str, ...]) -> Column:
    marked = F.transform(segments, lambda s, i: F.when(s.rlike("|".join(markers)), i))
    return F.try_element_at(F.filter(marked, lambda i: i.isNotNull()), F.lit(1))


def location_key(segments: Column) -> Column:
    """The folders before the first that names a layer; else the first two."""
    at = _first_marker(segments, LAYER_MARKERS)
    n = F.when(at > 0, at).otherwise(F.least(F.size(segments), F.lit(2)))
    return F.array_join(F.slice(segments, 1, n), "/")


def _below_root(segments: Column) -> Column:
    return F.try_element_at(segments, F.array_position(segments, F.lit(ROOT_FOLDER)).cast("int") + 1)


def facility_scope(segments: Column) -> Column:
    """The folder below the root, else the first; null for no path."""
    at = F.array_position(segments, F.lit(ROOT_FOLDER))
    return F.coalesce(F.when(at > 0, _below_root(segments)), F.try_element_at(segments, F.lit(1)))


def mounting_scope(segments: Column) -> Column:
    """The folder below the root, else the folders before the first that names a layer."""
    at, marker = F.array_position(segments, F.lit(ROOT_FOLDER)), _first_marker(segments, MOUNTING_MARKERS)
    prefix = F.array_join(F.slice(segments, 1, F.coalesce(marker, F.size(segments))), "/")
    return F.coalesce(F.when(at > 0, _below_root(segments)), F.when(prefix != "", prefix))


def location_group(segments: Column) -> Column:
    """Slug of the folder below the root."""
    at = F.array_position(segments, F.lit(ROOT_FOLDER))
    return F.coalesce(F.when(at > 0, F.regexp_replace(_below_root(segments), " ", "-")), F.lit(OTHER_GROUP))


def first_number(column: Column) -> Column:
    """The first run of digits as a number; null where there is none."""
    return F.regexp_extract(column, "[0-9]+", 0).try_cast("long")


def shared_tokens(left: Column, right: Column) -> Column:
    """How many words of ``right`` longer than two letters occur in ``left``."""
    return F.size(F.filter(F.split(right, " "), lambda w: (F.length(w) > 2) & F.array_contains(F.split(left, " "), w)))


def contains_token(text: Column, token: Column) -> Column:
    """Whether a token text holds a token: short ones as a word, others anywhere."""
    word = F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), token, F.lit(" ")))
    return (text == token) | F.when(F.length(token) <= 3, word).otherwise(text.contains(token))
