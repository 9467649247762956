"""Mapping free-entered values to a canonical list.

Method: the entries of the list, with their labels, aliases and the paths that
stand for the same words in another order, form a trie; each value is turned
into a Levenshtein automaton (its states kept as bits, one word per number of
errors) that runs down the trie and returns every entry within the distance
that the entry's length allows. Forms of more than ``ORDERED_WORDS`` words, whose
orders are too many for paths, are found in other orders by their words: of
``MOST`` errors at most so many words can be wrong, the others lead to the form.

Before that a value is brought to a plain form: compatibility forms and accents
are resolved, invisible characters dropped, separators become blanks (the trie
compares without them), and remarks around the name are removed. What a remark
is, the values themselves tell: words, with any numbers in them, that stand
before or after the exact names of many different entries (``REMARK_ENTRIES`` and
``REMARK_SHARE`` of all entries at least), counted over all different values;
others may be given.

Where: values are matched where they lie, no shuffle; each task keeps the
answers of the last values it met. The tries are built once and broadcast, in
pieces of at most ``LIST_ROWS`` entries; a longer list takes several passes.

Defined results: a value that is literally an entry is left out; a null or
blank value is none; the nearest entry wins, of equally near ones that with the
longer matching form, then the first in order; ``''`` where none is near.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter, OrderedDict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import trimmed

LIST_ROWS = 20_000
CACHE = 200_000

#: Different entries around which words must stand to be a remark, and the share of all entries.
REMARK_ENTRIES, REMARK_SHARE = 4, 0.05
#: Remarks in common use, for lists of values too short to tell theirs; numbers as ``#``. ``p7_found`` does without.
COMMON_REMARKS = (("eks", "type", "merk tak jelas", "#x"), ("baru", "lama", "rusak", "lantai #", "# unit", "#"))
#: Remarks at most, those around most entries first.
REMARKS = 1_000
#: Longest form -> errors allowed in it.
ALLOWED = ((3, 0), (7, 1))
ALLOWED_BEYOND = 2
MOST = 2
#: Words of a form up to which all their orders are paths of the trie.
ORDERED_WORDS = 4


def plain(text: str) -> str:
    """Lower case, without accents and invisible characters, words apart by single blanks."""
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return " ".join(re.findall(r"[^\W_]+", text))


def allowed(length: int) -> int:
    return next((k for most, k in ALLOWED if length <= most), ALLOWED_BEYOND)


def edits(a: str, b: str) -> int:
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Trie:
    """Forms without blanks; each end holds (canonical value, length of the form)."""

    def __init__(self, entries: list[tuple[str, list[str]]], remarks: tuple[list[str], list[str]] = ((), ())):
        self.remarks = remarks
        self.longest = 0
        self.exact: dict[tuple[str, ...], str] = {}
        self.long: dict[tuple[str, ...], set[str]] = {}
        self.by_word: dict[tuple[int, str], set[tuple[str, ...]]] = {}
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[str]] = [[]]
        self.literal = {c for c, _ in entries}
        self.namespaces = {plain(c.partition(":")[0]) for c, _ in entries if ":" in c}
        for canonical, others in sorted(entries):
            names = [canonical, *([canonical.partition(":")[2]] if ":" in canonical else []), *others]
            for name in names:
                words = plain(name).split()
                self.exact.setdefault(tuple(words), canonical)
                if len(words) > ORDERED_WORDS:
                    form = tuple(sorted(words))
                    self.long.setdefault(form, set()).add(canonical)
                    for w in form:
                        self.by_word.setdefault((len(form), w), set()).add(form)
                for path in {"".join(p) for p in self.orders(words)}:
                    self.add(path, canonical)

    @staticmethod
    def orders(words: list[str]) -> Iterator[tuple[str, ...]]:
        if len(words) <= ORDERED_WORDS:
            yield from itertools.permutations(words)
        else:
            yield tuple(words)

    def add(self, path: str, canonical: str) -> None:
        if not path:
            return
        self.longest = max(self.longest, len(path))
        at = 0
        for c in path:
            nxt = self.children[at].get(c)
            if nxt is None:
                nxt = self.children[at][c] = len(self.children)
                self.children.append({})
                self.ends.append([])
            at = nxt
        if canonical not in self.ends[at]:
            self.ends[at].append(canonical)

    def within(self, word: str, most: int = MOST) -> list[tuple[int, int, str]]:
        """All (errors, length of form, canonical) with no more errors than the form's length allows."""
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        end, full = 1 << len(word), (1 << len(word) + 1) - 1
        start, states = 1, []
        for _ in range(most + 1):  # bit i of state k: i letters of the word read with at most k errors
            states.append(start)
            start |= start << 1 & full
        found, held = [], [(0, 0, tuple(states))]
        while held:
            node, depth, states = held.pop()
            if self.ends[node]:
                errors = next((k for k in range(most + 1) if states[k] & end), None)
                if errors is not None and errors <= allowed(depth):
                    found += [(errors, depth, c) for c in self.ends[node]]
            for c, child in self.children[node].items():
                mask, after, before = masks.get(c, 0), [], None
                for k in range(most + 1):
                    state = (states[k] & mask) << 1
                    if k:
                        # a letter too many in the form, another letter, a letter too many in the word
                        state |= states[k - 1] | states[k - 1] << 1 | before << 1
                    before = state & full
                    after.append(before)
                if before:
                    held.append((child, depth + 1, tuple(after)))
        return found

    def reordered(self, words: list[str]) -> list[tuple[int, int, str]]:
        """The same for forms of more than ``ORDERED_WORDS`` words, in any order of whole words."""
        n, found = len(words), []
        if n <= ORDERED_WORDS:
            return found
        shared = Counter(form for w in set(words) for form in self.by_word.get((n, w), ()))
        for form in shared:
            a, b = list((Counter(words) - Counter(form)).elements()), list((Counter(form) - Counter(words)).elements())
            if len(a) <= MOST:  # each of these words has an error at least
                errors = min(sum(map(edits, a, order)) for order in itertools.permutations(b))
                size = sum(map(len, form))
                if errors <= min(MOST, allowed(size)):
                    found += [(errors, size, c) for c in self.long[form]]
        return found

    def around(self, text: str) -> Iterator[tuple[str, str, str]]:
        """(side, words, canonical): what stands before and after the longest exact name of an entry in the value, numbers as ``#``."""
        words = plain(text).split()
        n = len(words)
        most = max((len(f) for f in self.exact), default=0)
        for size in range(min(n - 1, most), 0, -1):
            for i in range(n - size + 1):
                canonical = self.exact.get(tuple(words[i : i + size]))
                if canonical is not None:
                    before = words[:i]
                    while before and before[0] in self.namespaces:
                        before = before[1:]
                    for side, rest in (("before", before), ("after", words[i + size :])):
                        if rest:
                            yield side, re.sub(r"\d+", "#", " ".join(rest)), canonical
                    return

    def forms_of(self, text: str) -> list[str]:
        """The value's plain form, and the same without remarks."""
        words = plain(text)
        if not (self.remarks[0] or self.remarks[1]):
            return [words]
        space = "|".join(map(re.escape, sorted(self.namespaces))) or "(?!)"
        before, after = ("|".join(re.escape(r).replace(r"\#", r"\d+") for r in remarks) or "(?!)" for remarks in self.remarks)
        bare, last = words, None
        while bare != last:
            last = bare
            bare = re.sub(rf"^((?:(?:{space}) )?)(?:{before}) (?=\S)", r"\1", bare)
            bare = re.sub(rf"(?<=\S) (?:{after})$", "", bare)
        return [words] if bare == words else [words, bare]

    def match(self, text: str) -> tuple[int, int, str] | None:
        """(errors, -length of form, canonical) of the nearest entry."""
        best = None
        for form in self.forms_of(text):
            word, found = form.replace(" ", ""), []
            if word and len(word) <= self.longest + MOST:  # a longer one has more errors
                for most in range(MOST + 1):
                    found = self.within(word, most)
                    if found:
                        break
            found += self.reordered(form.split())
            if found:
                nearest = min((e, -n, c) for e, n, c in found)
                best = nearest if best is None else min(best, nearest)
        return best


def _entries(vocabulary: DataFrame, list_rows: int) -> Iterator[dict[str, list[tuple[str, list[str]]]]]:
    """The list in pieces, by field."""
    held, n = {}, 0
    for row in vocabulary.filter("canonical_value != ''").orderBy("field_name", "canonical_value").toLocalIterator():
        held.setdefault(row["field_name"], []).append((row["canonical_value"], [x for x in row["names"] or [] if x]))
        n += 1
        if n == list_rows:
            yield held
            held, n = {}, 0
    if held:
        yield held


def find_remarks(values: DataFrame, tries: list[Broadcast], entries: int) -> tuple[list[str], list[str]]:
    """The remarks before and after names, from all different values (field_name, value)."""
    different = values.select("field_name", "value").distinct()

    def passed(held: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = held.value
                out = [(*a[:2], f"{f} {a[2]}") for f, v in zip(batch.column("field_name").to_pylist(), batch.column("value").to_pylist()) if f in own for a in own[f].around(v)]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(3)], ["side", "words", "entry"])

        return different.mapInArrow(run, "side string, words string, entry string")

    every = reduce(DataFrame.unionByName, [passed(t) for t in tries]).distinct()
    least = max(REMARK_ENTRIES, REMARK_SHARE * entries)
    found = every.groupBy("side", "words").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "side", "words").limit(REMARKS).collect()
    return tuple([r["words"] for r in found if r["side"] == side] for side in ("before", "after"))


def map_values(values: DataFrame, vocabulary: DataFrame, list_rows: int = LIST_ROWS, known: tuple = COMMON_REMARKS) -> DataFrame:
    """(id, field_name, canonical_value) of values (id, field_name, value) by vocabulary (field_name, canonical_value, names array<string>); ``known``: remarks before and after names besides those that the values tell."""
    spark = values.sparkSession
    values = values.filter(trimmed("value").isNotNull())
    tries = [spark.sparkContext.broadcast({f: Trie(e) for f, e in piece.items()}) for piece in _entries(vocabulary, list_rows)]
    if not tries:
        tries = [spark.sparkContext.broadcast({})]
    remarks = tuple(sorted({*a, *b}) for a, b in zip(known, find_remarks(values, tries, vocabulary.count())))
    pieces = tries

    def passed(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tries, known = pieces[number].value, OrderedDict()
            for trie in tries.values():
                trie.remarks = remarks
            for batch in batches:
                kept, out = [], []
                for i, (field, value) in enumerate(zip(batch.column("field_name").to_pylist(), batch.column("value").to_pylist())):
                    if field in tries and value in tries[field].literal:
                        if len(pieces) > 1:  # another piece must not map it
                            kept.append(i)
                            out.append((-1, 0, value))
                        continue
                    key = (field, value)
                    if key not in known:
                        if len(known) >= CACHE:
                            known.popitem(last=False)
                        known[key] = (tries[field].match(value) if field in tries else None) or (99, 0, "")
                    kept.append(i)
                    out.append(known[key])
                rows = batch.take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("field_name"), rows.column("value"), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string())],
                    ["id", "field_name", "value", "errors", "size", "canonical_value"],
                )

        return values.select("id", "field_name", "value").mapInArrow(run, "id string, field_name string, value string, errors int, size int, canonical_value string")

    if len(pieces) == 1:
        # Deliveries of one record agree in value, so they collapse here.
        return passed(0).select("id", "field_name", "value", "canonical_value").distinct().drop("value")
    every = reduce(DataFrame.unionByName, [passed(k) for k in range(len(pieces))])
    best = every.groupBy("id", "field_name", "value").agg(F.min(F.struct("errors", "size", "canonical_value")).alias("m"))
    return best.filter("m.errors >= 0").select("id", "field_name", "m.canonical_value")
