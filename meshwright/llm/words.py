"""Words of texts: the matches of the public vocabulary's splitting pattern, found for many texts at once.

The pattern tells apart letters, numbers, white space and all else, so the
starts of its matches follow from the runs of these classes; they are worked
out by numpy over whole buffers of UTF-8 instead of match by match:

- a run of letters, numbers or other characters is a word, with one blank
  before it, if there is one;
- what is left of a run of white space is a word; its last character is one of
  its own, if it is no blank and a word follows;
- ``'s 't 're 've 'm 'll 'd`` where a word may start with ``'`` are words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Splitting pattern of the vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of texts that are worked on together.
STRETCH = 1_000_000
OTHER, LETTER, NUMBER, SPACE = range(4)
_BLANK, _QUOTE = ord(" "), ord("'")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, every):
            a, b = found.span()
            lift = lambda i: i if i < 0xD800 else i + 0x800
            for low, high in ((a, min(b, 0xD800)), (max(a, 0xD800), b)):
                if low < high:
                    out[lift(low) : lift(high - 1) + 1] = kind
    return out


def word_starts(codes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where words start in code points of texts, one after the other, which start at ``texts`` (no text is empty)."""
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = classes().take(codes)
    begins = np.empty(n + 1, dtype=bool)  # of runs
    begins[0] = begins[n] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:n])
    begins[texts] = True
    edge = np.flatnonzero(begins)
    start, end = edge[:-1], edge[1:]
    opens = np.zeros(n + 1, dtype=bool)
    opens[texts] = opens[n] = True
    first, final = opens[start], opens[end]  # of their texts
    of = kind[start]
    blank = codes == _BLANK
    out = np.zeros(n + 1, dtype=bool)
    word = of != SPACE
    fed = word & ~first & blank[start - 1]
    out[start[word & ~fed]] = True
    out[start[fed] - 1] = True
    space = ~word
    long = end - start > 1
    last_blank = blank[end - 1]
    out[start[space & (final | long | ~last_blank)]] = True
    out[end[space & ~final & long & ~last_blank] - 1] = True
    quote = (of == OTHER) & ~long & ~fed & ~final & (codes[start] == _QUOTE)
    if quote.any():
        at = np.flatnonzero(quote)
        at = at[of[at + 1] == LETTER]
        s, size = start[at], (end - start)[at + 1]
        one = codes[s + 1]
        two = np.where(size > 1, codes[np.minimum(s + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = ~short & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for hit, letters in ((short, 1), (pair, 2)):
            out[s[hit] + 1] = False
            more = hit & (size > letters)
            out[s[more] + 1 + letters] = True
    return np.flatnonzero(out[:n])


def codes_of(data: bytes | memoryview) -> np.ndarray:
    return np.frombuffer(str(data, "utf-8").encode("utf-32-le"), dtype=np.uint32)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, sizes, counts): the texts' bytes, where words start in them and how many bytes they have, and the number of words of each text."""
    if texts.type != pa.string():
        texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=texts.offset + len(texts) + 1)[texts.offset :].astype(np.int64)
    if texts.null_count:  # a null may stand over bytes
        lengths = np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        if int(lengths.sum()) != offsets[-1] - offsets[0]:
            return words_of(texts.fill_null(""))
    base, stop = int(offsets[0]), int(offsets[-1])
    if base == stop:
        return np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    raw = memoryview(texts.buffers()[2])[base:stop]
    data, offsets = np.frombuffer(raw, dtype=np.uint8), offsets - base
    codes = codes_of(raw)
    begin = np.unique(offsets[:-1][np.diff(offsets) > 0])
    if len(codes) == len(data):
        starts = word_starts(codes, begin)
    else:
        place = np.flatnonzero((data & 0xC0) != 0x80)  # bytes at which characters start
        starts = place[word_starts(codes, np.searchsorted(place, begin))]
    sizes = np.diff(np.append(starts, len(data)))
    return data, starts, sizes, np.diff(np.searchsorted(starts, offsets))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from differences of running sums."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    return (sums[starts + sizes] - sums[starts]) * _powers(_INVERSE, len(data))[starts] + sizes.astype(np.uint64)


def stretches(texts: pa.Array, most: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of texts of about ``most`` bytes."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield start, stop
        start = stop
