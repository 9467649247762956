from meshwright.llm import bpe, sizes


def test_texts_without_an_id_are_all_encoded(spark):
    rows = [(None, "one"), (None, "two words"), (None, "two words"), (None, None), (1, "one"), (1, "other"), (2, "one")]
    found = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), sizes.ranks_path("byte_bpe_50k"), words=10).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "2", "None", "None", "None"]
    assert sorted(len(r["ids"]) for r in found if r["doc_id"] is None) == [0, 1, 2]
