import random

from tessera.operators import index


def test_suggestions_against_every_name(spark):
    rng = random.Random(6)
    names = sorted({"".join(rng.choice("aBéЖ1") for _ in range(rng.randrange(0, 7))) for _ in range(400)})
    terms = ["", "a", "b", "ab", "ABA", "éж", "zzz", "жжж1", "abéa", None, "a"] + ["".join(rng.choice("abéж1") for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    got = index.suggest(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(n, 0) for n in names + names], "name string, tier int"), 7)
    want = {(t, k + 1, n) for t in terms if t is not None for k, n in enumerate([n for n in names if t.lower() in n.lower()][:7])}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert index.suggest(spark.createDataFrame([], "term string"), spark.createDataFrame([("a",)], "name string")).collect() == []
