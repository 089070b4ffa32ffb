import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import references as R

T = lambda day: dt.datetime(2024, 1, day)
EDGES = "edge_id bigint, source string, target string, relation string, extracted_at timestamp, ref_id string, salt int"
NODES = "node_id string, indexed_at timestamp, reach bigint"
GONE = "node_id string, removed_at timestamp, restored_at timestamp"


def find(spark, edges, nodes, externals=(), removals=()):
    e = spark.createDataFrame([(*x, "clash", 1) for x in edges], EDGES)
    n = spark.createDataFrame([(*x, 7) for x in nodes], NODES)
    x = spark.createDataFrame([(i,) for i in externals], "ext_id string")
    g = spark.createDataFrame(list(removals), GONE)
    orphans, refs = R.missing_endpoints(e, n, x, g)
    return sorted((r.edge_id, r.side) for r in orphans.select("edge_id", "side").distinct().collect()), orphans, refs


def test_existence_in_time(spark):
    nodes = [("a", T(5)), ("b", T(1)), ("never", None)]
    removals = [("b", T(10), T(12)), ("b", T(10), T(12)), ("b", T(11), T(15)), ("b", None, T(3)), ("a", T(20), None), ("a", T(9), T(8))]
    edges = [
        (1, "A", "ext!", "calls", T(4)),  # before it was indexed
        (2, " a ", "x", "calls", T(5)),  # at the moment it was
        (3, "b", "b", "calls", T(10)),  # removal includes its start
        (4, "b", "b", "calls", T(15)),  # and excludes its end
        (5, "b", "b", "calls", T(14)),  # overlapping removals
        (6, "a", None, "calls", T(25)),  # never restored
        (7, None, "  ", "calls", T(1)),
        (8, "never", "()", None, T(9)),
        (9, "b", "a", "calls", None),  # without a time: after all
        (3, "b", "b", "calls", T(10)),  # delivered twice
    ]
    got, orphans, refs = find(spark, edges, nodes, ["ext", "x"], removals)
    assert got == [(1, "source"), (3, "source"), (3, "target"), (5, "source"), (5, "target"), (6, "source"), (8, "source"), (8, "target"), (9, "target")]
    report = {(r.side, r.relation, r.month): (r.orphans, r.refs) for r in R.orphan_report(orphans, refs).collect()}
    assert report[("source", "calls", "2024-01")] == (4, 6)


def test_empty_tables(spark):
    assert find(spark, [], [])[0] == []
    assert find(spark, [(1, "a", "b", "r", T(1))], [])[0] == [(1, "source"), (1, "target")]


def test_hot_parent_is_salted(spark):
    random.seed(1)
    edges = [(i, "hub", f"n{i % 7}", "calls", T(1 + i % 28)) for i in range(400)]
    nodes = [("hub", T(10))] + [(f"n{i}", T(1)) for i in range(6)]
    refs = R.edge_references(spark.createDataFrame([(*x, "c", 1) for x in edges], EDGES))
    assert R.hot_codes(refs.select(F.xxhash64("ref_id").alias("code")), "code", 800)
    got, _, _ = find(spark, edges, nodes)
    expected = sorted([(i, "source") for i in range(400) if 1 + i % 28 < 10] + [(i, "target") for i in range(400) if i % 7 == 6])
    assert got == expected


@pytest.mark.parametrize("text", ["Straße", "ﬁX_ A", "ÀÉ", "__a--b__", "İx", "ΑΣ", "ǅ"])
def test_canonical_id_as_in_python(spark, text):
    import re
    import unicodedata

    from quillgraph.functions.ids import canonical_id

    want, before = text, None
    while want != before:
        before, want = want, unicodedata.normalize("NFKC", want.casefold())
    want = re.sub("_+", "_", re.sub(r"[^\w]+", "_", want)).strip("_")
    assert spark.createDataFrame([(text,)], "x string").select(canonical_id(F.col("x"))).head()[0] == want


@pytest.mark.parametrize("seed", range(3))
def test_runs_of_integer_keys(spark, seed):
    rng = random.Random(seed)
    keys = {rng.randrange(-50, 200) for _ in range(120)}
    asked = [rng.randrange(-80, 260) for _ in range(300)] + [5, 5, 2**62, -(2**63)]
    parents = spark.createDataFrame([(k, 0) for k in keys] + [(k, 1) for k in list(keys)[:9]] + [(None, 0)], "key bigint, run_end int")
    refs = spark.createDataFrame([(k, i) for i, k in enumerate(asked)] + [(None, -1)], "key bigint, row int")
    runs = R.key_runs(parents)
    covered = [k for r in runs.collect() for k in range(r.run_start, r.run_end + 1)]
    assert sorted(covered) == sorted(keys) and runs.count() < len(keys)
    assert sorted(r.row for r in R.beyond_runs(refs, runs).collect()) == [i for i, k in enumerate(asked) if k not in keys]
    assert R.beyond_runs(refs, runs.limit(0)).count() == len(asked) and R.key_runs(parents.limit(0)).count() == 0


def test_suspects_too_many_to_broadcast(spark):
    random.seed(2)
    edges = [(i, random.choice(["hub", "hub", f"n{i % 9}", "gone"]), f"x{i % 5}", "calls", T(1 + i % 28)) for i in range(300)]
    e = spark.createDataFrame([(*x, "c", 1) for x in edges], EDGES)
    n = spark.createDataFrame([("hub", T(9), 7), ("gone", T(1), 7)] + [(f"n{i}", T(1), 7) for i in range(6)], NODES)
    runs = R.existence_runs(n, spark.createDataFrame([("x1",)], "ext_id string"), spark.createDataFrame([("gone", T(5), None)], GONE))
    refs = R.edge_references(e)
    rows = lambda **kw: sorted((r.edge_id, r.side) for r in R.orphans_of(refs, runs, 600, **kw).collect())
    want = sorted((r.edge_id, r.side) for r in R.orphan_references(refs, runs, 600).collect())
    assert rows() == rows(most_broadcast=0) == want != []
