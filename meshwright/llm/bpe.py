"""Encoding of a corpus by a public byte-level BPE vocabulary.

Method: the frequent words of the corpus, counted over all of it, are encoded
once and compiled into a minimal acyclic transducer: an automaton that shares
prefixes and suffixes and whose arcs carry numbers; their sum along a word is
the place of its ids in a table. The arrays are one file in the shared folder,
which Spark brings to every machine and the tasks map into memory, so all
workers of a machine share it. The words of a batch run through it all at once,
a byte a step. Words it does not hold are merged exactly, by rank.

A word here is a match of the vocabulary's own splitting pattern (see
``words``), so the ids are those of the public tokenizer, without special
tokens; strings that spell a special token are ordinary text.

Defined results: an empty or null text has the empty list of ids. A text given
twice under one ``doc_id`` is encoded once. Lone surrogates can't occur in
Arrow's UTF-8 texts.
"""

from __future__ import annotations

import base64
import heapq
import os
import tempfile
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import shared_path, stage
from .words import PATTERN, stretches, word_hashes, words_of

__all__ = ["PATTERN", "encode", "load_ranks", "merge"]

#: Words of the lexicon at most; the most frequent ones of the whole corpus.
LEXICON_WORDS = 60_000
#: Bytes of a word of the lexicon at most.
LEXICON_BYTES = 64
#: Different words that a task holds at once, while counting and as merged ones.
HELD_WORDS = 400_000
LONG = 48
#: States up to which a task holds a table of arcs by state and byte (1 KB each); beyond it arcs are searched.
TABLE_STATES = 65_536
#: Steps a doubling of the count is divided into, to find how often the lexicon's words must occur.
CUTS = 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of least rank is merged, the leftmost first, until none is left."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, for words without end."""
    n = len(word)
    end, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        gone = end[i]
        alive[gone], end[i] = False, stop
        if stop < n:
            left[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (before := left[i]) >= 0 and (r := ranks.get(word[before:stop])) is not None:
            heapq.heappush(heap, (r, before, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Transducer:
    """Minimal acyclic transducer from words to ids, in arrays."""

    ARRAYS = ("keys", "targets", "numbers", "final", "starts", "ids")

    def __init__(self, **arrays: np.ndarray):
        self.table = None
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, words: Iterable[bytes], encode) -> Transducer:
        """From words in any order; states of equal futures are one."""
        words = sorted(set(words))
        arcs: list[dict[int, int]] = [{}]
        final, register, path, last = [False], {}, [0], b""

        def settle(down: int) -> None:
            while len(path) > down + 1:
                state, parent = path.pop(), path[-1]
                key = (final[state], tuple(arcs[state].items()))
                known = register.setdefault(key, state)
                if known != state:
                    arcs[parent][last[len(path) - 1]] = known

        for word in words:
            common = len(os.path.commonprefix([word, last]))
            settle(common)
            for byte in word[common:]:
                arcs[path[-1]][byte] = len(arcs)
                path.append(len(arcs))
                arcs.append({})
                final.append(False)
            final[path[-1]] = True
            last = word
        settle(0)
        count: dict[int, int] = {}
        order, held = [], [0]
        while held:  # states after all states that they lead to
            state = held[-1]
            ahead = [t for t in arcs[state].values() if t not in count]
            if ahead:
                held += ahead
                continue
            held.pop()
            if state not in count:
                count[state] = final[state] + sum(count[t] for t in arcs[state].values())
                order.append(state)
        number = {s: i for i, s in enumerate(reversed(order))}
        keys, targets, numbers = [], [], []
        for state in reversed(order):
            before = int(final[state])
            for byte, target in sorted(arcs[state].items()):
                keys.append(number[state] << 8 | byte)
                targets.append(number[target])
                numbers.append(before)
                before += count[target]
        ids = [encode(w) for w in words]
        return cls(
            keys=np.array(keys, dtype=np.int64), targets=np.array(targets, dtype=np.int32), numbers=np.array(numbers, dtype=np.int32), final=np.array([final[s] for s in reversed(order)], dtype=bool),
            starts=np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64), ids=np.array([x for i in ids for x in i], dtype=np.int32),
        )

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            self.write(f)

    def write(self, f) -> None:
        """One file: a header line with the arrays' types and lengths, then their bytes at multiples of 64."""
        arrays = [np.ascontiguousarray(getattr(self, n)) for n in self.ARRAYS]
        head = " ".join(f"{n}:{a.dtype.str}:{len(a)}" for n, a in zip(self.ARRAYS, arrays)).encode() + b"\n"
        f.write(head)
        for a in arrays:
            f.write(b"\0" * (-f.tell() % 64))
            f.write(a.tobytes())

    @classmethod
    def load(cls, path: str) -> Transducer:
        """Mapped into memory, not read."""
        with open(path, "rb") as f:
            head = f.readline()
        arrays, at = {}, len(head)
        for part in head.decode().split():
            name, kind, n = part.split(":")
            at += -at % 64
            arrays[name] = np.memmap(path, dtype=np.dtype(kind), mode="r", offset=at, shape=(int(n),)) if int(n) else np.zeros(0, dtype=np.dtype(kind))
            at += np.dtype(kind).itemsize * int(n)
        return cls(**arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where it is not held."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        return self.find_in(np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(size) - size, size)

    def find_in(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The same of words within a buffer; all step together."""
        n = len(start)
        out = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.keys):
            return out
        targets, numbers, final = map(np.asarray, (self.targets, self.numbers, self.final))
        live, state, total = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        at, left = start.copy(), size.copy()
        while len(live):
            ended = left == 0
            if ended.any():
                ok = ended & final[state]
                out[live[ok]] = total[ok]
                on = ~ended
                live, state, total, at, left = live[on], state[on], total[on], at[on], left[on]
                if not len(live):
                    break
            k = self._arcs(state << 8 | data[at])
            hit = k >= 0
            if hit.all():
                state, total = targets[k].astype(np.int64), total + numbers[k]
            else:
                live, k = live[hit], k[hit]
                state, total, at, left = targets[k].astype(np.int64), total[hit] + numbers[k], at[hit], left[hit]
            at, left = at + 1, left - 1
        return out

    def _arcs(self, key: np.ndarray) -> np.ndarray:
        """Number of the arc of each state and byte, -1 for none: out of a table of both, unless that were too large."""
        if self.table is None and len(self.final) <= TABLE_STATES:
            self.table = np.full(len(self.final) << 8, -1, dtype=np.int32)
            self.table[self.keys] = np.arange(len(self.keys))
        if self.table is not None:
            return self.table[key]
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, k, -1)


class Encoder:
    """Texts to ids by the transducer, with exact merging of the words it lacks."""

    def __init__(self, transducer: Transducer, merge_word: Callable[[bytes], list[int]]):
        self.transducer, self.merge_word, self.merged = transducer, merge_word, {}

    def _merge(self, word: bytes) -> list[int]:
        ids = self.merged.get(word)
        if ids is None:
            if len(self.merged) >= HELD_WORDS:
                self.merged.clear()
            ids = self.merged[word] = self.merge_word(word)
        return ids

    def batch(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts."""
        data, starts, sizes, counts = words_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        t = self.transducer
        number = t.find_in(data, starts, sizes)
        begin = t.starts[np.maximum(number, 0)]
        lengths = np.where(number >= 0, t.starts[number + 1] - begin, 0)
        extra, at, place = [], len(t.ids), {}
        missed, raw = np.flatnonzero(number < 0), data.tobytes()
        for i, a, b in zip(missed.tolist(), starts[missed].tolist(), (starts + sizes)[missed].tolist()):
            word = raw[a:b]
            where = place.get(word)
            if where is None:
                ids = self._merge(word)
                where = place[word] = (at, len(ids))
                extra += ids
                at += len(ids)
            begin[i], lengths[i] = where
        table = np.concatenate([t.ids, np.array(extra, dtype=np.int32)]) if extra else np.asarray(t.ids)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.repeat(begin - sums[:-1], lengths) + np.arange(sums[-1])
        return sums[np.concatenate([[0], np.cumsum(counts)])], table[flat]


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) over all texts, of words of up to ``LEXICON_BYTES`` bytes; different words of one hash within a batch (none is to be expected) count as one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            texts = batch.column("text")
            for start, stop in stretches(texts):
                data, at, size, _ = words_of(texts.slice(start, stop - start))
                short = size <= LEXICON_BYTES
                at, size = at[short], size[short]
                _, first, n = np.unique(word_hashes(data, at, size), return_index=True, return_counts=True)
                raw = data.tobytes()
                for a, b, k in zip(at[first].tolist(), (at + size)[first].tolist(), n.tolist()):
                    held[raw[a:b]] += k
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    return documents.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(documents: DataFrame, words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, at most ``words``: those that occur more often than a bound, which comes from a histogram of counts."""
    counts = stage(word_counts(documents).filter("n > 1"))
    step = F.floor(F.log2("n") * CUTS).cast("int")
    cut = None
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):  # at most 64 * CUTS rows
        words -= r["count"]
        if words < 0:
            break
        cut = r["s"]
    return [] if cut is None else [r["word"] for r in counts.filter(step >= cut).select("word").collect()]


def lexicon(documents: DataFrame, ranks: dict[bytes, int], words: int = LEXICON_WORDS) -> Transducer:
    """The transducer of the most frequent words of all texts; at most ``words`` of them reach the driver."""
    return Transducer.build([w.encode() for w in frequent_words(documents, words)], lambda w: merge(w, ranks))


def _shared(spark: SparkSession, transducer: Transducer) -> str:
    """Put the transducer's file into the shared folder and have Spark bring it to every machine; gives its name there."""
    with tempfile.TemporaryFile() as f:
        transducer.write(f)
        f.seek(0)
        content = f.read()
    path = shared_path(spark, "lexicon")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    for at in range(0, len(content), 1 << 20):
        out.write(content[at : at + (1 << 20)])
    out.close()
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encode(documents: DataFrame, vocabulary: str, words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids array<int>) of documents (doc_id, text); ``vocabulary`` is the path of a file of ranks, found on every machine.

    A doc_id counts once; of different texts under one id the one with the
    least hash counts. Rows without an id stay apart by text: each of their
    texts counts once.
    """
    documents = documents.select("doc_id", "text")
    if documents.groupBy("doc_id").count().filter("count > 1").take(1):  # never so in tables whose ids are unique
        apart = F.when(F.col("doc_id").isNull(), F.sha2("text", 256))
        first = Window.partitionBy("doc_id", apart).orderBy(F.xxhash64("text"))
        documents = documents.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    name = _shared(documents.sparkSession, lexicon(documents, load_ranks(vocabulary), words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .sizes import tokenizer

        encoder = Encoder(Transducer.load(SparkFiles.get(name)), tokenizer(vocabulary)._encode_single_piece)  # the public library's merging of one word
        for batch in batches:
            texts = batch.column("text")
            for start, stop in stretches(texts):
                offsets, ids = encoder.batch(texts.slice(start, stop - start))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, stop - start), lists], ["doc_id", "ids"])

    return documents.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, ids array<int>")
