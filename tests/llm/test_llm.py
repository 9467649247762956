import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.llm import bpe, components, mixing, sizes, splitting, vocabulary

PATH = sizes.ranks_path("byte_bpe_50k")


def _groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in list(parent)}


@pytest.mark.parametrize("cell", [200_000, 12])
def test_components_against_union_find(spark, cell):
    rnd = random.Random(cell)
    pairs = [(f"v{rnd.randrange(120)}", f"v{rnd.randrange(120)}") for _ in range(70)] + [("hub", f"h{i}") for i in range(60)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(80)] + [("solo", "solo"), (None, "x"), ("é", "ü"), ("hub", "h1")]
    df = spark.createDataFrame(pairs, "a string, b string")
    found = components.components(df, cell, hot_rows=20).collect()
    assert {r["v"]: r["group"] for r in found} == _groups(pairs) and len(found) == len({r["v"] for r in found})
    assert components.components(df.limit(0)).count() == 0


TERMS = [("f", "cctv_fixed", ["kamera diam"]), ("f", "pole", ["tiang"]), ("f", "lan", []), ("f", "ns:main_box", ["copper to glass unit"]), ("g", "switch", [])]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    rnd = random.Random(7)
    forms = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(2, 11))) for _ in range(80)})
    trie = vocabulary.Trie([(f, []) for f in forms])
    for _ in range(300):
        word = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 12)))
        want = sorted((_edits(word, f), len(f), f) for f in forms if _edits(word, f) <= vocabulary.allowed(len(f)))
        assert sorted(trie.within(word)) == want


@pytest.mark.parametrize("list_rows", [100_000, 2])
def test_map_values(spark, list_rows):
    values = [
        ("1", "f", " CCTV  Fixed "), ("2", "f", "fixed, cctv"), ("3", "f", "cctv fix3d"), ("4", "f", "tiang (lama)"), ("5", "f", "eks ple"), ("6", "f", "l4n"), ("7", "f", "ＬＡＮ"), ("8", "f", "ns/type: main box #3"), ("9", "f", "unit glass to copper"),
        ("10", "f", "toilet"), ("11", "f", "pole"), ("12", "f", "  "), ("13", "f", None), ("14", "g", "swtch"), ("15", "h", "anything"), ("1", "f", " CCTV  Fixed "), ("16", "f", "x" * 5000), (None, "f", "kamera​ diam"), ("17", "f", "???"),
    ]
    df = spark.createDataFrame(values, "id string, field_name string, value string")
    terms = spark.createDataFrame(TERMS, "field_name string, canonical_value string, names array<string>")
    found = [tuple(r) for r in vocabulary.map_values(df, terms, list_rows).collect()]
    want = {"1": "cctv_fixed", "2": "cctv_fixed", "3": "cctv_fixed", "4": "pole", "5": "pole", "6": "", "7": "lan", "8": "ns:main_box", "9": "ns:main_box", "10": "", "14": "switch", "15": "", "16": "", None: "cctv_fixed", "17": ""}
    assert {i: c for i, _, c in found} == want and len(found) == len(want)
    assert vocabulary.map_values(df.limit(0), terms).count() == 0
    assert {r["canonical_value"] for r in vocabulary.map_values(df, terms.limit(0)).collect()} == {""}


TEXTS = ["", None, "   \n\n  ", "it's 10 o'clock, don't", "abc " * 500, "x" * 3000, "日本語のテキスト。終わり!", "<|endoftext|> is text", "\x00\x07 ctrl  ", "tab\t\ttab \r\n\r\n end", "naïve café – “quotes” ½", "á‍👩‍👩‍👧", "9" * 900 + ".", " leading and trailing "]


def test_bpe_equals_the_public_tokenizer(spark):
    rnd = random.Random(11)
    texts = TEXTS + ["".join(chr(rnd.choice([32, 10, 65, 97, 98, 39, 0xE9, 0x3042, 0x1F600, rnd.randrange(32, 0xD7FF)])) for _ in range(rnd.randrange(200))) for _ in range(60)]
    truth = sizes.tokenizer(PATH)
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string")
    found = bpe.encode(df, PATH, words=40).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r["ids"] == truth.encode_ordinary(texts[r["doc_id"]] or ""), texts[r["doc_id"]]
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_transducer_is_minimal_and_exact(tmp_path):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257}
    words = [b"tap", b"taps", b"top", b"tops", b"abc", b""]
    t = bpe.Transducer.build([w for w in words if w], lambda w: bpe.merge(w, ranks))
    t.save(str(tmp_path / "lexicon"))
    t = bpe.Transducer.load(str(tmp_path / "lexicon"))
    assert isinstance(t.keys, np.memmap)
    number = t.find([b"abc", b"tap", b"taps", b"top", b"tops", b"ta", b"tapss", b"", b"zzz"])
    assert number.tolist() == [0, 1, 2, 3, 4, -1, -1, -1, -1]
    assert t.ids[t.starts[0] : t.starts[1]].tolist() == [257]
    assert len(t.final) == 7  # start; t; ta, to; tap, top; a; ab; and the end of taps, tops and abc
    assert base64.b64encode(b"ab") and bpe.merge(b"abab", ranks) == [256, 256]


def test_mixing_meets_shares_and_caps(spark):
    rnd = random.Random(2)
    docs = [(i, rnd.choice(["big", "big", "big", "mid", " mid ", "small", None]), rnd.choice([0, 5, 20, 80, 300])) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").repartition(40)
    targets = spark.createDataFrame([("m", "big", 1.0, 2), ("m", "mid", 1.0, 3), ("m", "small", 2.0, 4), ("m", "absent", 1.0, 4), ("m", "unwanted", 0.0, 1), ("n", "big", 1.0, 1)], "mix_id string, source string, weight double, max_repeats int")
    uses, wanted = mixing.mix(df, targets)
    rows = uses.collect()
    tokens = {}
    for m, s, n in (("m", "big", 2), ("m", "mid", 3), ("m", "small", 4), ("n", "big", 1)):
        own = [r for r in rows if (r["mix_id"], r["source"]) == (m, s)]
        assert len(own) == len({r["doc_id"] for r in own}) == sum((d[1] or "").strip() == s for d in docs)
        assert all(0 <= r["copies"] <= n and (r["copies"] == 0 or r["n_tokens"] > 0) for r in own)
        tokens[(m, s)] = sum(r["copies"] * r["n_tokens"] for r in own)
    for r in wanted.collect():
        if (r["mix_id"], r["source"]) in tokens:
            assert abs(tokens[(r["mix_id"], r["source"])] - r["wanted_tokens"]) <= 300.001
    shares = {(r["mix_id"], r["source"]): r for r in mixing.shares(uses, wanted).collect()}
    assert shares[("m", "absent")]["reached_share"] == 0.0 and abs(shares[("m", "small")]["reached_share"] - 0.5) < 0.01
    assert all(r["copies"] == 1 or r["n_tokens"] == 0 for r in rows if r["mix_id"] == "n")
    again = mixing.mix(df, targets.limit(0))
    assert again[0].count() == 0 and mixing.mix(df.limit(0), targets)[0].count() == 0


def test_trades_keep_mass_and_expectation():
    rnd = random.Random(5)
    for _ in range(500):
        p, q, s, t = rnd.random() * 0.98 + 0.01, rnd.random() * 0.98 + 0.01, rnd.randrange(1, 50), rnd.randrange(1, 50)
        draws = [mixing.trade(p, s, q, t, (k + 0.5) / 400) for k in range(400)]
        assert all(abs(a * s + b * t - p * s - q * t) < 1e-9 and min(abs(a), abs(1 - a), abs(b), abs(1 - b)) < 1e-9 and -1e-9 <= min(a, b) and max(a, b) <= 1 + 1e-9 for a, b in draws)
        assert abs(sum(a for a, _ in draws) / 400 - p) < 0.02


@pytest.mark.parametrize("limit,overlap", [(32, 4), (16, 0), (64, 16), (8, 7)])
def test_pieces_cover_fit_and_overlap(spark, limit, overlap):
    encoding = sizes.tokenizer(PATH)
    texts = [t for t in TEXTS if t] + ["One sentence here. Another, with a clause; and more! " * 30, "para one.\n\npara two is longer.\nline\n\n" * 20, "漢字" * 200, "word" * 400 + " " + "tail " * 50]
    for text in texts:
        found = splitting.split(text, encoding, limit, overlap)
        if len(encoding.encode_ordinary(text)) <= limit:
            assert not found
            continue
        assert "".join(text[core:b] for _, b, _, core in found) == text
        for k, (a, b, n, core) in enumerate(found):
            assert n == len(encoding.encode_ordinary(text[a:b])) <= limit and a <= core < b
            assert (k == 0) == (core == 0)
    good = splitting.split(texts[-4], encoding, 64, 0)
    assert all(texts[-4][a:b].rstrip().endswith(("!", ".")) for a, b, _, _ in good)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    limits = spark.createDataFrame([("l", "byte_bpe_50k", limit, overlap)], "limit_id string, tokenizer string, max_tokens int, overlap_tokens int")
    rows = splitting.pieces(df, limits).collect()
    assert {r["doc_id"] for r in rows} == {i for i, t in enumerate(TEXTS) if t and len(encoding.encode_ordinary(t)) > limit}
    assert splitting.pieces(df.limit(0), limits).count() == 0 and splitting.pieces(df, limits.limit(0)).count() == 0


def test_wrong_limits_are_errors(spark):
    limits = spark.createDataFrame([("l", "byte_bpe_50k", 8, 8)], "limit_id string, tokenizer string, max_tokens int, overlap_tokens int")
    with pytest.raises(ValueError):
        splitting.pieces(spark.createDataFrame([(1, "a")], "doc_id long, text string"), limits)


def test_sizes(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string").withColumn("n tokens", F.lit("kept"))
    assert {r["doc_id"]: (r["n_tokens"], r["n tokens"]) for r in sizes.with_sizes(df, PATH).collect()} == {1: (2, "kept"), 2: (0, "kept"), 3: (0, "kept")}
