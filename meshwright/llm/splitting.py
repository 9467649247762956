"""Splitting oversized texts at natural boundaries.

Method: agglomerative merging. A text longer than the limit is cut into atomic
segments at the ends of sentences; segments that don't fit are cut further at
clauses, at words, and where there is nothing else at tokens. Adjacent pairs
wait in a heap by the strength of the boundary between them (paragraph, line,
sentence, clause, word, none), the weakest first, the smaller pair first among
equals; a pair is merged while its size and the overlap fit. Each piece is then
given the last ``overlap`` tokens before it.

Boundaries are places where both a token of the whole text and a character
end. Pieces and overlaps count as texts of their own, as the same characters can
make another number of tokens inside the whole: the overlap starts where what
is shared has just the tokens asked for, or as few more as the places allow,
and a piece that has too many is cut in two at its strongest boundary. Only the
words cut at either end of a piece and the white space it ends with can differ
from the whole, so just those are encoded again; the rest is a difference.

Where: texts are cut where they lie, no shuffle; the time for a text grows with
its length times the logarithm. The limits are a broadcast table.

Defined results: texts within the limit, empty and null ones have no pieces
(they need none); an overlap not below the limit is an error, and so is a
character that alone has more tokens than the limit: no piece is ever above it.
Pieces without their overlaps put together are the text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame

from .sizes import ranks_path, tokenizer
from .words import PATTERN, stretches, word_starts

NONE, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
#: Characters that end sentences and clauses.
SENTENCE_ENDS = frozenset(".!?…。！？")
CLAUSE_ENDS = frozenset(",;:、，；：")
WIDE_ENDS = frozenset("。！？、，；：")
CLOSING = "\"')]}»”’"
LIMITS = 10_000
#: Different parts of words whose tokens a task keeps.
HELD_PARTS = 200_000


def _table(characters) -> np.ndarray:
    """Whether a code below 65,536 is one of the characters."""
    out = np.zeros(1 << 16, dtype=bool)
    out[[ord(c) for c in characters]] = True
    return out


IS_SENTENCE, IS_CLAUSE, IS_WIDE, IS_CLOSING = map(_table, (SENTENCE_ENDS, CLAUSE_ENDS, WIDE_ENDS, CLOSING))
IS_SPACE = _table(c for c in map(chr, range(0x3001)) if c.isspace())


_WORD = regex.compile(PATTERN)
#: White space as the pattern sees it.
SPACES = frozenset(regex.findall(r"\s", "".join(map(chr, range(0xD800)))))


@lru_cache(maxsize=4)
def token_bytes(encoding: tiktoken.Encoding) -> np.ndarray:
    """Bytes of each token."""
    out = np.zeros(encoding.n_vocab, dtype=np.int64)
    for rank in encoding._mergeable_ranks.values():
        out[rank] = len(encoding.decode_single_token_bytes(rank))
    return out


@lru_cache(maxsize=4)
def _held_parts(encoding: tiktoken.Encoding) -> dict[str, int]:
    """Tokens of parts of words met so far."""
    return {}


class Places:
    """Places of a text where it may be cut: token numbers, characters, and the strength of each."""

    def __init__(self, text: str, encoding: tiktoken.Encoding, token: np.ndarray, char: np.ndarray, strength: np.ndarray, starts: np.ndarray, begins: np.ndarray, base: int):
        self.token, self.char, self.strength, self.size = token, char, strength, int(token[-1])
        self._text, self._encoding = text, encoding
        # Where words start in all texts of the batch, whether one does at each character of this text, and where that starts in the batch.
        self._starts, self._begins, self._base = starts, begins, base

    def count(self, a: int, b: int) -> int:
        """Tokens of what lies between two places, as a text of its own."""
        begins, text, char, token = self._begins, self._text, self.char, self.token
        at, end = int(char[a]), int(char[b])
        stop = end  # from here on the text must be encoded again: a word cut, or the white space at its end
        if end > at and text[end - 1] in SPACES:
            while stop > at and text[stop - 1] in SPACES:
                stop -= 1
        elif not begins[end]:
            stop = int(self._starts[self._starts.searchsorted(end + self._base) - 1]) - self._base
        if stop <= at:
            return self._part(at, end)
        first = 0
        while not begins[at]:  # words from within a word on, until they fall in with those of the whole
            after = _WORD.match(text, at).end()
            if after > stop:
                return self._part(int(char[a]), end)
            first, at = first + self._part(at, after), after
        n = first + int(token[char.searchsorted(stop)] - token[char.searchsorted(at) if first else a])
        return n + self._part(stop, end) if stop < end else n

    def _part(self, a: int, b: int) -> int:
        part = self._text[a:b]
        parts = _held_parts(self._encoding)
        n = parts.get(part)
        if n is None:
            n = len(self._encoding.encode_ordinary(part))
            if len(part) <= 40:
                if len(parts) >= HELD_PARTS:
                    parts.clear()
                parts[part] = n
        return n


def _strengths(codes: np.ndarray, texts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Strength of each place ``at`` in code points of texts, one after the other, which start at ``texts``."""
    n, codes = len(codes), np.minimum(codes, 0xFFFF)
    out = np.zeros(len(at), dtype=np.int8)
    opens = np.zeros(n + 1, dtype=bool)
    opens[texts] = opens[n] = True
    text_of = lambda k: np.searchsorted(texts, k, side="right") - 1
    space = np.zeros(n + 2, dtype=bool)
    space[1:-1] = IS_SPACE[codes]
    start = np.flatnonzero(space[1:-1] & (~space[:-2] | opens[:-1]))
    end = np.flatnonzero(space[1:-1] & (~space[2:] | opens[1:])) + 1
    inner = ~opens[end]
    start, end = start[inner], end[inner]
    begin = texts[text_of(start)]
    # The place of a gap is the last one in it, so that white space stays with what it follows.
    k = np.searchsorted(at, end, side="right") - 1
    held = (at[k] > begin) & (at[k] >= start)
    start, end, k, begin = start[held], end[held], k[held], begin[held]
    count = lambda c: (lambda where: np.searchsorted(where, end) - np.searchsorted(where, start))(np.flatnonzero(codes == c))
    lines = np.where((feeds := count(10)) > 0, feeds, count(13))
    before = start - 1
    for _ in range(3):
        before = np.where((before >= begin) & IS_CLOSING[codes[before]], before - 1, before)
    last = np.where(before >= begin, codes[before], 0)
    kind = np.where(IS_SENTENCE[last], SENTENCE, np.where(IS_CLAUSE[last], CLAUSE, WORD))
    out[k] = np.where(lines > 1, PARAGRAPH, np.where(lines == 1, LINE, kind))
    wide = np.flatnonzero(IS_WIDE[codes]) + 1
    wide = wide[~opens[wide]]
    k = np.minimum(np.searchsorted(at, wide), len(at) - 1)
    hit = at[k] == wide
    out[k[hit]] = np.maximum(out[k[hit]], np.where(IS_SENTENCE[codes[wide[hit] - 1]], SENTENCE, CLAUSE))
    return out


def places_of(texts: list[str], encoding: tiktoken.Encoding, least: int = 0) -> list[Places | None]:
    """The places of texts, worked out for all of them together; None for those of ``least`` tokens or fewer."""
    every = [encoding.encode_to_numpy(t, disallowed_special=()) for t in texts]
    chosen = [i for i, tokens in enumerate(every) if len(tokens) > least]
    out: list[Places | None] = [None] * len(texts)
    if not chosen:
        return out
    own, tokens = [texts[i] for i in chosen], [every[i] for i in chosen]
    data = "".join(own).encode()
    codes = np.frombuffer(data.decode().encode("utf-32-le"), dtype=np.uint32)
    base = np.cumsum([0, *map(len, own)])
    sizes = np.array(list(map(len, tokens)))
    ends = np.cumsum(token_bytes(encoding)[np.concatenate(tokens)])
    number = np.arange(len(ends)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    if len(data) == len(codes):
        char = ends
    else:
        first = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80  # first bytes of characters
        whole = np.append(first, True)[ends]
        char, number = np.concatenate([[0], np.cumsum(first)])[ends[whole]], number[whole]
    # The start of each text is a place too.
    ahead = np.searchsorted(char, base[:-1], side="right")
    char, number = np.insert(char, ahead, base[:-1]), np.insert(number, ahead, 0)
    cuts = np.append(ahead + np.arange(len(own)), len(char))
    strength = _strengths(codes, base[:-1], char)
    starts = word_starts(codes, base[:-1])
    begins = np.zeros(len(codes) + 1, dtype=bool)
    begins[starts] = begins[-1] = True
    for i, text, a, b, low, high in zip(chosen, own, cuts[:-1].tolist(), cuts[1:].tolist(), base[:-1].tolist(), base[1:].tolist()):
        out[i] = Places(text, encoding, number[a:b], char[a:b] - low, strength[a:b], starts, begins[low : high + 1], low)
    return out


def atoms(places: Places, room: int) -> list[int]:
    """Numbers of the places that bound the atomic segments, from 0 to the last."""
    token, strength = places.token, places.strength
    out, last = [0], len(token) - 1
    strong = {s: np.flatnonzero(strength >= s) for s in (WORD, CLAUSE, SENTENCE)}

    def cut(a: int, b: int, level: int) -> None:
        """Bounds after a, up to b."""
        if token[b] - token[a] <= room and level < SENTENCE:
            out.append(b)
            return
        if level == NONE:
            at = a
            while token[b] - token[at] > room:
                at = max(at + 1, int(np.searchsorted(token, token[at] + room, side="right")) - 1)
                out.append(at)
            if at < b:
                out.append(b)
            return
        inner = strong[level]
        for k in [*inner[np.searchsorted(inner, a, side="right") : np.searchsorted(inner, b)].tolist(), b]:
            if token[k] - token[a] <= room:
                out.append(k)
            else:
                cut(a, k, level - 1)
            a = k

    cut(0, last, SENTENCE)
    return out


def agglomerate(places: Places, bounds: list[int], limit: int, overlap: int) -> list[int]:
    """The bounds that are left when the weakest have been merged away while pieces fit."""
    token, strength = places.token, places.strength
    n = len(bounds) - 1
    if n < 2:
        return bounds
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    gone = [False] * n
    at = token[bounds].tolist()
    kind = strength[bounds].tolist()

    def fits(i: int, stop: int) -> bool:
        return at[stop] - at[i] + (overlap if i else 0) <= limit

    heap = [(kind[i + 1], at[i + 2] - at[i], i, i + 1, i + 2) for i in range(n - 1) if fits(i, i + 2)]
    heapq.heapify(heap)
    while heap:
        _, _, i, middle, stop = heapq.heappop(heap)
        if gone[i] or end[i] != middle or gone[middle] or end[middle] != stop:
            continue
        gone[middle], end[i] = True, stop
        after[i] = after[middle]
        if after[i] < n:
            before[after[i]] = i
            j = after[i]
            if fits(i, end[j]):
                heapq.heappush(heap, (kind[j], at[end[j]] - at[i], i, j, end[j]))
        h = before[i]
        if h >= 0 and fits(h, stop):
            heapq.heappush(heap, (kind[i], at[stop] - at[h], h, i, stop))
    return [b for k, b in enumerate(bounds[:-1]) if not gone[k]] + [bounds[-1]]


def _overlapped(places: Places, a: int, overlap: int) -> int:
    """The place where the piece with core from ``a`` starts: the text between has ``overlap`` tokens as a text of its own, or as few more as can be."""
    if not a or not overlap:
        return a
    start = max(0, int(np.searchsorted(places.token, places.token[a] - overlap, side="right")) - 1)
    n = places.count(start, a)
    while start and n < overlap:
        start -= 1
        n = places.count(start, a)
    while n > overlap and start + 1 < a and (less := places.count(start + 1, a)) >= overlap:
        start, n = start + 1, less
    return start


def split(text: str, encoding: tiktoken.Encoding, limit: int, overlap: int, places: Places | None = None) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, core) of each piece, in characters; ``core`` is where the text not seen before begins. None if the text fits."""
    if not 0 <= overlap < limit:
        raise ValueError(f"an overlap of {overlap} tokens in pieces of {limit}")
    places = places or places_of([text], encoding, limit)[0]
    if places is None or places.size <= limit:
        return []
    token, char = places.token, places.char
    bounds = agglomerate(places, atoms(places, limit - overlap), limit, overlap)
    waiting, out = [(a, b) for a, b in zip(bounds, bounds[1:])][::-1], []
    while waiting:
        a, b = waiting.pop()
        start = _overlapped(places, a, overlap)
        n = places.count(start, b)
        if n > limit and b - a > 1:
            inner = places.strength[a + 1 : b]
            best = np.flatnonzero(inner == inner.max()) + a + 1
            middle = int(best[np.argmin(np.abs(token[best] - (token[a] + token[b]) / 2))])
            waiting += [(middle, b), (a, middle)]
            continue
        while n > limit and start < a:  # one place only: less overlap
            start += 1
            n = places.count(start, b)
        if n > limit:
            raise ValueError(f"{text[char[a] : char[b]]!r} has {n} tokens, more than the limit of {limit}")
        out.append((int(char[start]), int(char[b]), n, int(char[a])))
    return out


def pieces(documents: DataFrame, limits: DataFrame, folder: str | None = None) -> DataFrame:
    """(limit_id, doc_id, piece_no, start_char, end_char, core_char, n_tokens, text) of documents (doc_id, text) by limits (limit_id, tokenizer, max_tokens, overlap_tokens)."""
    rows = limits.select("limit_id", "tokenizer", "max_tokens", "overlap_tokens").filter("max_tokens > 0 and tokenizer is not null").limit(LIMITS + 1).collect()
    if len(rows) > LIMITS:
        raise ValueError(f"more than {LIMITS} limits")
    plan = [(r["limit_id"], ranks_path(r["tokenizer"], folder) if folder else ranks_path(r["tokenizer"]), r["max_tokens"], r["overlap_tokens"] or 0) for r in rows]
    for _, _, most, overlap in plan:
        if not 0 <= overlap < most:
            raise ValueError(f"an overlap of {overlap} tokens in pieces of {most}")
    kinds = [("limit_id", pa.string()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("core_char", pa.int32()), ("n_tokens", pa.int32()), ("text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

        least = min((p[2] for p in plan), default=0)
        for rows in batches:
            # A token has a byte at least, so shorter texts are within every limit.
            long = rows.filter(pc.fill_null(pc.greater(pc.binary_length(rows.column("text")), least), False))
            for start, stop in stretches(long.column("text")):
                docs, texts = (long.column(c).slice(start, stop - start).to_pylist() for c in ("doc_id", "text"))
                known = {path: places_of(texts, tokenizer(path), min(p[2] for p in plan if p[1] == path)) for path in dict.fromkeys(p[1] for p in plan)}
                for i, (doc, text) in enumerate(zip(docs, texts)):
                    for limit_id, path, most, overlap in plan:
                        if known[path][i] is None:
                            continue
                        for k, (a, b, n, core) in enumerate(split(text, tokenizer(path), most, overlap, known[path][i])):
                            out.append((limit_id, doc, k, a, b, core, n, text[a:b]))
                            held += b - a
                        if held > 4_000_000 or len(out) > 20_000:
                            yield batch()
                            out, held = [], 0
        yield batch()

    return documents.select("doc_id", "text").mapInArrow(run, "limit_id string, doc_id long, piece_no int, start_char int, end_char int, core_char int, n_tokens int, text string")
