import random

from quillgraph.operators import skew as K


def test_a_hot_group_is_split_and_every_pair_comes_once(spark):
    rng = random.Random(3)
    rows = [("hot", i) for i in range(60)] + [(rng.choice("abc"), i) for i in range(40)]
    left = spark.createDataFrame([(g, x, "clash") for g, x in rows], "g string, a int, _salt string")
    right = spark.createDataFrame(rows, "g string, b int")
    got = [(r.g, r.a, r.b) for r in K.met_within(left, right, ["g"], per_salt=7).collect()]
    want = {(g, x, y) for g, x in rows for h, y in rows if g == h}
    assert len(got) == len(want) and set(got) == want


def test_global_rank(spark):
    values = [5, 3, 3, 9, 1]
    rows = K.global_rank(spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int"), ["v", "i"], "place").collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.place)] == sorted(values) and {r.place for r in rows} == set(range(5))
