import pytest

from meshwright.plans.lookups import lookup


@pytest.mark.parametrize("hot", [3, 1000])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_hot_and_null_keys(spark, how, hot):
    rows = [("hot", i) for i in range(10)] + [("cold", 10), ("gone", 11), (None, 12)] + [(None, i) for i in range(20, 30)] + [("lone", i) for i in range(30, 36)]
    one = [("hot", "H"), ("cold", "C"), (None, "N"), ("other", "O")]
    a, b = spark.createDataFrame(rows, "k string, v int"), spark.createDataFrame(one, "k string, w string")
    got = sorted(tuple(r) for r in lookup(a, b, ["k"], how, hot).select("v", *["w"] * (how != "left_semi")).collect())
    names = {k: w for k, w in one if k is not None}
    kept = [(k, v) for k, v in rows if how == "left" or k in names]
    assert got == sorted((v, *([names.get(k)] if how != "left_semi" else [])) for k, v in kept)
