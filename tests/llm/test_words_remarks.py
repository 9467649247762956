import itertools
import random

import pyarrow as pa
import pytest
import regex

from meshwright.llm import bpe, mixing, queries, sizes, splitting, vocabulary, words

PIECES = ["a", "b", "s", "t", "re", "ve", "ll", "d", "'", " ", "  ", "\n", "\r\n", "\t", "1", "23", ".", "!", "é", "中文", "。", "　", "𝕏", "́", "S", "\xa0", "\x1c", "\x85", "don't", "²"]


def test_words_are_the_patterns_matches():
    rnd, split = random.Random(5), regex.compile(words.PATTERN).findall
    texts = [None, "", "x"] + ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(12))) for _ in range(4000)]
    array = pa.array(texts, pa.string()).slice(1)
    data, starts, sizes_, counts = words.words_of(array)
    raw, k = data.tobytes(), 0
    for text, n in zip(array.to_pylist(), counts.tolist()):
        assert [raw[a : a + b].decode() for a, b in zip(starts[k : k + n], sizes_[k : k + n])] == split(text or "")
        k += n
    assert k == len(starts) and all(len(x) == 0 for x in words.words_of(pa.array(["", None], pa.string()))[:3])
    hashes = words.word_hashes(data, starts, sizes_)
    by_word = {}
    for h, a, b in zip(hashes.tolist(), starts, sizes_):
        assert by_word.setdefault(raw[a : a + b], h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_pieces_count_as_texts_of_their_own():
    rnd, encoding = random.Random(6), sizes.tokenizer(sizes.ranks_path("byte_bpe_50k"))
    texts = ["".join(rnd.choice(PIECES + ["words ", "supercalifragilistic"]) for _ in range(rnd.randrange(1, 40))) for _ in range(200)]
    for text, places in zip(texts, splitting.places_of(texts, encoding)):
        for _ in range(8):
            a, b = sorted(rnd.randrange(len(places.char)) for _ in range(2))
            assert places.count(a, b) == len(encoding.encode_ordinary(text[places.char[a] : places.char[b]]))


def test_no_piece_is_above_the_limit():
    encoding = sizes.tokenizer(sizes.ranks_path("byte_bpe_50k"))
    for limit in (1, 2):
        with pytest.raises(ValueError, match="more than the limit"):
            splitting.split("𝕏" * 6, encoding, limit, 0)
    assert [p[2] for p in splitting.split("𝕏" * 6, encoding, 4, 0)] and max(p[2] for p in splitting.split("𝕏" * 6, encoding, 4, 0)) <= 4


def test_frequent_words_stay_below_the_bound(spark):
    texts = [" ".join(f"w{i}" for i in range(k)) for k in range(1, 60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (5, 30, 10_000):
        found = bpe.frequent_words(df, most)
        assert len(found) <= most and len(set(found)) == len(found)
    counts = {r["word"]: r["n"] for r in bpe.word_counts(df).collect()}
    assert counts[" w"] == 59 * 58 // 2 and counts["w"] == 59


def test_remarks_come_from_the_values(spark):
    names = ["north mast", "south gate", "river pump", "main valve", "old tower"]
    terms = spark.createDataFrame([("f", n.replace(" ", "_"), [n]) for n in names], "field_name string, canonical_value string, names array<string>")
    rows = [("f", f"{n} bay {k}") for k, n in enumerate(names)] + [("f", f"spare {n}") for n in names] + [("f", "old tower ladder"), ("f", "spare nroth mast bay 12"), ("f", None)]
    df = spark.createDataFrame([(str(k), *r) for k, r in enumerate(rows)], "id string, field_name string, value string")
    found = {r["id"]: r["canonical_value"] for r in vocabulary.map_values(df, terms, known=((), ())).collect()}
    assert [found[str(k)] for k in range(12)] == [n.replace(" ", "_") for n in names * 2] + ["", "north_mast"] and "12" not in found


def test_any_order_of_many_words_and_very_long_values(spark):
    name = "copper to glass media converter unit"
    trie = vocabulary.Trie([("converter", [name]), ("a" * 500, [])])
    for order in itertools.islice(itertools.permutations(name.split()), 0, 720, 37):
        assert trie.match(" ".join(order))[2] == "converter"
        wrong = [*order]
        wrong[0], wrong[3] = wrong[0][1:] + "x", wrong[3] + "y"
        assert (trie.match(" ".join(wrong)) is None) == (sum(vocabulary.edits(x, y) for x, y in zip(wrong, order)) > 2)
    for size in (300, 399, 400, 401, 499, 500, 502, 503):
        assert (trie.match("a" * size) is not None) == (498 <= size <= 502)


def test_a_trade_keeps_the_mass_and_draws_repeat(spark):
    rounder = mixing.Rounder(3)
    out = [x for k in range(200) for x in rounder.add(("m", "s"), k, 5 + k % 7, 0, 0.3)] + list(rounder.rest())
    wanted, given = sum(0.3 * (5 + k % 7) for k in range(200)), sum(o[3] * (o[4] + (o[5] or 0)) for o in out)
    assert abs(wanted - given) < 1e-6 and len(out) == 200 and sum(o[5] is not None for o in out) <= 1


def test_p7_exact_is_registered():
    assert queries.QUERIES["p7_exact"] and queries.SQL["p7_exact"]
