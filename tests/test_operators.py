"""Operators on small literal graphs, and against brute force on random ones."""

import datetime as dt
import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import predicates as P
from quillgraph.functions import similarity as Sim
from quillgraph.functions import text as T
from quillgraph.operators import analyze as A
from quillgraph.operators import build as B
from quillgraph.operators import communities as C
from quillgraph.operators import dedup as D
from quillgraph.operators import merge as M
from quillgraph.operators import resolve as R
from quillgraph.operators import search as S
from quillgraph.operators import skew
from quillgraph.operators import upkeep as U
from quillgraph.operators import walks as W


def frame(spark, rows, schema):
    return spark.createDataFrame(list(rows), schema)


def edges(spark, pairs):
    return frame(spark, pairs, "src string, dst string")


def ids(spark, names):
    return frame(spark, [(n,) for n in names], "id string")


def random_edges(seed, n=30, m=45):
    rng = random.Random(seed)
    return [f"n{i}" for i in range(n)], [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]


def neighbours(pairs):
    out = {}
    for a, b in pairs:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def bfs(start, near):
    dist, queue = {start: 0}, [start]
    for x in queue:
        for y in near.get(x, ()):
            if y not in dist:
                dist[y] = dist[x] + 1
                queue.append(y)
    return dist


@pytest.mark.parametrize("seed", range(3))
def test_components_and_reach(spark, seed):
    names, pairs = random_edges(seed)
    near = neighbours(pairs)
    want = {n: min(bfs(n, near)) for n in names}
    got = {r.id: r.component for r in W.components(ids(spark, names), edges(spark, pairs)).collect()}
    assert got == want
    seeds = frame(spark, [("n0", "n0"), ("n1", "n1")], "seed string, id string")
    reached = {(r.seed, r.id): r.depth for r in W.reach(W.both_ways(edges(spark, pairs)), seeds, 4).collect()}
    assert reached == {(s, k): d for s in ("n0", "n1") for k, d in bfs(s, near).items() if d <= 4}


def test_components_of_a_long_chain(spark):
    names = [f"c{i:03}" for i in range(100)]
    rng = random.Random(1)
    order = names[:]
    rng.shuffle(order)
    got = W.components(ids(spark, names), edges(spark, zip(order, order[1:])))
    assert {r.component for r in got.collect()} == {"c000"}


@pytest.mark.parametrize("most_links", [0, 1000])
@pytest.mark.parametrize("seed", range(2))
def test_betweenness_with_all_pivots_is_exact(spark, seed, most_links):
    names, pairs = random_edges(seed, 14, 22)
    near = neighbours(pairs)
    want = dict.fromkeys(names, 0.0)
    over = dict.fromkeys(((a, b) for a in near for b in near[a] if a < b), 0.0)
    for s, t in itertools.permutations(names, 2):
        dist = bfs(s, near)
        if t in dist:
            paths, stack = [], [[s]]
            while stack:
                p = stack.pop()
                if p[-1] == t:
                    paths.append(p)
                else:
                    stack += [[*p, y] for y in near[p[-1]] if dist.get(y) == len(p) and dist[y] <= dist[t]]
            for p in paths:
                for x in p[1:-1]:
                    want[x] += 1 / len(paths)
                for x, y in zip(p, p[1:]):
                    over[min(x, y), max(x, y)] += 1 / len(paths)
    n = len(names)
    got = {r.id: r.betweenness for r in W.betweenness(ids(spark, names), edges(spark, pairs), ids(spark, names), most_links).collect()}
    assert all(got[k] == pytest.approx(v / ((n - 1) * (n - 2))) for k, v in want.items())
    got = {(r.a, r.b): r.betweenness for r in W.edge_betweenness(ids(spark, names), edges(spark, pairs), ids(spark, names), most_links).collect()}
    assert got.keys() == over.keys() and all(got[k] == pytest.approx(v / (n * (n - 1))) for k, v in over.items())


def test_betweenness_of_millions_of_links_writes_no_levels(spark):
    """2.4 million links both ways: beyond two million, every pivot and link was once a row on disk."""
    n, k = 60_000, 20
    ring = spark.range(n * k).select((F.col("id") % n).alias("a"), (F.col("id") % n + F.floor(F.col("id") / n) + 1).alias("b"))
    pairs = ring.select(F.concat(F.lit("n"), F.col("a")).alias("src"), F.concat(F.lit("n"), F.col("b") % n).alias("dst"))
    shared = spark.conf.get("spark.checkpoint.dir")
    before = written(shared)
    names = spark.range(n).select(F.concat(F.lit("n"), F.col("id")).alias("id"))
    got = W.betweenness(names, pairs, names.limit(1)).agg(F.count("id"), F.sum("betweenness")).head()
    hops = 2 * sum((i + k - 1) // k for i in range(1, n // 2)) + (n // 2 + k - 1) // k
    assert got[0] == n and got[1] == pytest.approx((hops - (n - 1)) * n / ((n - 1) * (n - 2))) and written(shared) - before < 60_000_000


def test_betweenness_on_a_long_path_and_on_nothing(spark):
    n = 75
    names = [f"n{i:02}" for i in range(n)]
    got = {r.id: r.betweenness for r in W.betweenness(ids(spark, names), edges(spark, list(zip(names, names[1:]))), ids(spark, names)).collect()}
    assert all(got[x] == pytest.approx(2 * i * (n - 1 - i) / ((n - 1) * (n - 2))) for i, x in enumerate(names))
    assert {r.betweenness for r in W.betweenness(ids(spark, names[:3]), edges(spark, []), ids(spark, names[:3])).collect()} == {0.0}


def test_page_rank(spark):
    names, pairs = random_edges(7, 12, 16)
    near = neighbours(pairs)
    rank = dict.fromkeys(names, 1 / len(names))
    for _ in range(100):
        lost = sum(rank[x] for x in names if not near.get(x))
        rank = {x: 0.15 / len(names) + 0.85 * (lost / len(names) + sum(rank[y] / len(near[y]) for y in near.get(x, ()))) for x in names}
    got = {r.id: r.rank for r in W.page_rank(ids(spark, names), edges(spark, pairs), rounds=60, tolerance=1e-7).collect()}
    assert all(got[k] == pytest.approx(v, abs=1e-5) for k, v in rank.items())


def test_short_cycles(spark):
    names, pairs = random_edges(3, 9, 26)
    out = {}
    for a, b in pairs:
        if a != b:
            out.setdefault(a, set()).add(b)
    want = set()
    for k in range(2, 6):
        for c in itertools.permutations(names, k):
            if c[0] == min(c) and all(c[(i + 1) % k] in out.get(c[i], ()) for i in range(k)):
                want.add(c)
    assert {tuple(r.cycle) for r in A.short_cycles(edges(spark, pairs)).collect()} == want


def test_flows_and_shortest_paths(spark):
    e = frame(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("a", "c", "uses"), ("c", "d", "writes_to"), ("b", "a", "calls"), ("a", "d", "contains")], "src string, dst string, relation string")
    g = B.Graph(ids(spark, "abcd"), e)
    got = {"".join(r.path) for r in W.flows(g, ids(spark, "a"), ids(spark, "d"), 4).collect()}
    assert got == {"abcd", "acd"}
    paths = {r.id: "".join(r.path) for r in W.shortest_paths(e, frame(spark, [("a", "a")], "seed string, id string")).collect()}
    assert paths == {"a": "a", "b": "ab", "c": "ac", "d": "ad"}


def written(folder):
    """Bytes of tables under a folder."""
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder.removeprefix("file://")) for f in fs if f.endswith(".parquet"))


def test_flows_write_no_paths_in_between(spark):
    """Two ways on in each of 12 steps: 8,190 paths from three starts, none of which is written or shuffled on the way."""
    pairs = [(f"{x}{i:02}", f"{y}{i + 1:02}") for i in range(12) for x in "ab" for y in "ab"] + [(f"s{k}", f"{x}00") for k in range(3) for x in "ab"]
    e = edges(spark, pairs).withColumn("relation", F.lit("calls"))
    g = B.Graph(ids(spark, {x for p in pairs for x in p}), e)
    shared = spark.conf.get("spark.checkpoint.dir")
    before = written(shared)
    starts, sinks = ids(spark, ["s0", "s1", "s2", "nowhere"]), ids(spark, ["a12", "b06", "a12"])
    got = [tuple(r) for r in W.flows(g, starts, sinks, 13, sep=">").collect()]
    assert written(shared) - before < 20_000
    want = [(r.start, r.sink, r.length, ">".join(r.path)) for r in W.flows(g, starts, sinks, 13, most_links=0).collect()]
    assert sorted(got) == sorted(want) and len(got) == 3 * (2**12 + 2**6)


@pytest.mark.parametrize("seed", range(2))
def test_flows_are_the_same_by_tasks_and_by_joins(spark, seed):
    names, pairs = random_edges(seed, 20, 50)
    g = B.Graph(ids(spark, names), edges(spark, pairs).withColumn("relation", F.lit("calls")))
    both = [sorted((r.start, r.sink, r.length, tuple(r.path)) for r in W.flows(g, ids(spark, names[:6]), ids(spark, names[4:9]), 7, most_links=m).collect()) for m in (0, 10**6)]
    assert both[0] == both[1] and both[0]
    few = [sorted(map(str, W.flows(g, ids(spark, names[:6]), ids(spark, names[4:9]), 7, 3, most_links=m).collect())) for m in (0, 10**6)]
    assert few[0] == few[1]


def by_halves(pairs, starts, sinks, depth, groups, sep=">"):
    """((start, sink, length, path) of all tasks, bytes that they hand on)."""
    from quillgraph.operators import apart

    names = sorted({x for p in pairs for x in p})
    code = {x: i for i, x in enumerate(names)}
    begin, end = np.array(sorted({(code[a], code[b]) for a, b in pairs if a != b}), np.int32).T
    rows, sent = [], 0
    for me in range(groups):
        rest = {apart.GROUP: [(me, None)], apart.SEED: [(code[x], None) for x in starts], apart.SINK: [(code[x], None) for x in sinks]}
        for b in apart.simple_paths(depth, groups, sep)(apart.Links(begin, end, len(names), pa.array(names)), rest):
            sent += sum(b[k].nbytes for k in b)
            rows += [(h["start"], t["sink"], n, h["path"] + t["path"]) for heads, tails, n in zip(*(b[k].to_pylist() for k in ("heads", "tails", "length"))) for t in tails for h in heads]
    return rows, sent


@pytest.mark.parametrize("seed", range(3))
def test_flows_by_halves_of_several_tasks(seed):
    names, pairs = random_edges(seed, 18, 45)
    names = sorted({x for p in pairs for x in p})
    out, rows = {}, []
    for a, b in set(pairs):
        out.setdefault(a, []).append(b)
    starts, sinks = [*names[:5], names[0]], names[3:8]
    stack = [(x,) for x in starts]
    while stack:
        p = stack.pop()
        if len(p) > 1 and p[-1] in sinks:
            rows.append((p[0], p[-1], len(p) - 1, ">".join(p)))
        if len(p) <= 7:
            stack += [(*p, y) for y in out.get(p[-1], ()) if y not in p]
    for groups in (1, 3):
        assert sorted(by_halves(pairs, starts, sinks, 7, groups)[0]) == sorted(rows)
    lists = by_halves(pairs, starts, sinks, 7, 2, None)[0]
    assert sorted(">".join(r[3]) for r in lists) == sorted(r[3] for r in rows) and rows


def test_flows_hand_on_halves():
    """Two ways on in each of 12 steps: whole paths were handed on, 4,096 of them from each start."""
    step = lambda x, i: f"package_module_{x}{i:02}"
    pairs = [(step(x, i), step(y, i + 1)) for i in range(12) for x in "ab" for y in "ab"] + [(f"s{k}", step(x, 0)) for k in range(3) for x in "ab"]
    rows, sent = by_halves(pairs, ["s0", "s1", "s2"], [step("a", 12)], 13, 2)
    assert len(set(rows)) == len(rows) == 3 * 2**12 and sent < 0.25 * sum(len(r[3]) for r in rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_all_method_flows_write_no_more_than_the_graph(spark):
    from quillgraph.plans import walking

    shared = spark.conf.get("spark.checkpoint.dir")
    before = written(shared)
    few, between = walking.method_flows(spark, "/root/testdata/sf0.001"), written(shared)
    deep = walking.all_method_flows(spark, "/root/testdata/sf0.001")
    assert few.count() < deep.count() and written(shared) - between <= 1.1 * (between - before)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_all_method_flows_take_less_room(spark, tmp_path):
    """Path by path from one start after the other, a row took 82 bytes as Parquet."""
    from quillgraph.plans import walking

    walking.all_method_flows(spark, "/root/testdata/sf0.01").write.parquet(str(tmp_path / "out"))
    assert (rows := spark.read.parquet(str(tmp_path / "out")).count()) == 4_558_195 and written(str(tmp_path / "out")) < 65 * rows


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_all_method_flows_go_15_deep(spark):
    from quillgraph.functions import vocabulary as V
    from quillgraph.plans import walking
    from quillgraph.plans.graphs import code_graph

    g = code_graph(spark, "/root/testdata/sf0.001")
    kind = {r.id: r.node_kind for r in g.nodes.select("id", "node_kind").collect()}
    out = {}
    for r in g.edges.where(F.col("relation").isin(*V.FORWARD, "") & (F.col("src") != F.col("dst"))).select("src", "dst").distinct().collect():
        out.setdefault(r.src, []).append(r.dst)
    want, stack = set(), [(x,) for x in kind if kind[x] == "heading"]
    while stack:
        path = stack.pop()
        if len(path) > 1 and kind[path[-1]] == "resource":
            want.add(">".join(path))
        if len(path) <= 15:
            stack += [(*path, y) for y in out.get(path[-1], ()) if y not in path]
    rows = walking.all_method_flows(spark, "/root/testdata/sf0.001").collect()
    assert {r.path for r in rows} == want and len(rows) == len(want) and max(r.length for r in rows) == 15


@pytest.mark.parametrize("seed", range(2))
def test_shortest_paths_are_the_same_by_tasks_and_by_joins(spark, seed):
    names, pairs = random_edges(seed, 40, 90)
    asked = [("n1", "n1"), ("n2", "n2"), ("two", "n3"), ("two", "n7"), ("away", "nowhere")]
    seeds = frame(spark, asked, "seed string, id string")
    both = [sorted((r.seed, r.id, r.depth, r.path) for r in W.shortest_paths(edges(spark, pairs), seeds, 5, ">", m).collect()) for m in (0, 10**6)]
    assert both[0] == both[1] and max(r[2] for r in both[0]) == 5
    lists = {(r.seed, r.id): ">".join(r.path) for r in W.shortest_paths(edges(spark, pairs), seeds, 5).collect()}
    assert lists == {(r[0], r[1]): r[3] for r in both[0]}


def test_shortest_paths_write_no_paths_in_between(spark):
    names, pairs = random_edges(5, 300, 900)
    seeds = frame(spark, [(x, x) for x in names], "seed string, id string")
    shared = spark.conf.get("spark.checkpoint.dir")
    before = written(shared)
    rows = W.shortest_paths(edges(spark, pairs), seeds).count()
    assert rows > 40_000 and written(shared) - before < 40_000


def test_neighbourhoods_of_a_hub_write_no_levels(spark):
    """All of 300 seeds meet at a hub: 90,000 rows of a graph of 300 links."""
    names = [f"n{i:03}" for i in range(300)]
    e = W.both_ways(edges(spark, [("hub", x) for x in names] + [("n001", "n002"), ("n003", "end")]))
    seeds = frame(spark, [(x, x) for x in names] + [("two", "end"), ("two", "n002"), ("away", "nowhere")], "seed string, id string")
    shared = spark.conf.get("spark.checkpoint.dir")
    before = written(shared)
    got = sorted(map(tuple, W.reach(e, seeds, 2, most_links=10**6).collect()))
    assert written(shared) - before < 60_000
    assert got == sorted(map(tuple, W.reach(e, seeds, 2).collect())) and len(got) > 90_000


def test_neighbourhoods_of_a_hub_take_little_room(spark, tmp_path):
    """40 seeds and all of 30,000 nodes meet at a hub: seed by seed, each row had the text of its node anew."""
    e = W.both_ways(spark.range(30_000).select(F.lit("hub").alias("src"), F.sha1(F.col("id").cast("string")).alias("dst")))
    seeds = spark.range(40).select(F.sha1(F.col("id").cast("string")).alias("seed")).withColumn("id", F.col("seed"))
    W.reach(e, seeds, 2, most_links=10**6).write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).distinct().count()
    assert rows == 40 * 30_001 and written(str(tmp_path / "out")) < 12 * rows


@pytest.mark.parametrize("seed", range(3))
def test_neighbourhoods_in_small_blocks(monkeypatch, seed):
    from quillgraph.operators import apart

    for k, v in (("CELLS", 120), ("ALIKE", 7), ("ROWS", 10)):
        monkeypatch.setattr(apart, k, v)
    names, pairs = random_edges(seed, 40, 70)
    near, code = neighbours(pairs), {x: i for i, x in enumerate(sorted(names))}
    begin, end = np.array(sorted({(code[x], code[y]) for x in near for y in near[x]}), np.int32).T
    rows = sorted((x.encode(), code[x]) for x in names[::3])
    got = []
    for b in apart.nearest(3)(apart.Links(begin, end, len(names), pa.array(sorted(names))), {apart.SEED: [(c, x) for x, c in rows]}):
        blocks = [b[k].to_pylist() for k in ("ids", "seeds", "depth")]
        assert len(blocks[0]) == 1 or sum(len(i) + len(s) for i, s, _ in zip(*blocks)) < 100
        got += [(s, i, d) for ids_, seeds, d in zip(*blocks) for i in ids_ for s in seeds]
    want = {(s, k, d) for s in names[::3] for k, d in bfs(s, near).items() if 0 < d <= 3}
    assert set(got) == want and len(got) == len(want)


def test_implementations_of_every_type(spark):
    chain = [(f"t{i + 1}", f"t{i}") for i in range(40)]
    pairs = [*chain, *((f"x{i}", f"y{i}") for i in range(30)), ("l1", "l2"), ("l2", "l1"), ("self", "self")]
    e = frame(spark, [(a, b, "inherits") for a, b in pairs] + [("t0", "other", "calls")], "src string, dst string, relation string")
    below = {}
    for a, b in pairs:
        below.setdefault(b, set()).add(a)
    want = {(s, x, d) for s in below for x, d in bfs(s, below).items() if d}
    rows = [tuple(r) for r in W.implementations(e).select("seed", "id", "depth").collect()]
    assert set(rows) == want and len(rows) == len(want) and max(r[2] for r in rows) == 40


def test_pair_collapse_rules(spark):
    rows = [("a", "b", "calls"), ("b", "a", "calls"), ("a", "b", "uses"), ("c", "d", "uses"), ("c", "d", "mentions"), ("e", "e", "calls"), ("x", "y", "imports"), ("x", "y", "references"), ("y", "x", "contains")]
    got = {(r.a, r.b): (r.src, r.dst, r.relation) for r in B.collapse_pairs(frame(spark, rows, "src string, dst string, relation string")).collect()}
    assert got == {("a", "b"): ("a", "b", "calls"), ("c", "d"): ("c", "d", "uses"), ("e", "e"): ("e", "e", "calls"), ("x", "y"): ("y", "x", "contains")}


def test_communities_find_two_cliques(spark):
    left, right = [f"a{i}" for i in range(6)], [f"b{i}" for i in range(6)]
    pairs = list(itertools.combinations(left, 2)) + list(itertools.combinations(right, 2)) + [("a0", "b0")]
    for shuffled in (pairs, pairs[::-1]):
        got = {r.id: r.community for r in C.detect(ids(spark, [*left, *right, "alone"]), edges(spark, shuffled)).collect()}
        assert len({got[x] for x in left}) == len({got[x] for x in right}) == 1 and len(set(got.values())) == 3 and got["alone"] == 2
    old = frame(spark, [(x, 5) for x in left] + [(x, 9) for x in right], "id string, community int")
    kept = {r.id: r.community for r in C.kept_ids(old, frame(spark, [(k, v) for k, v in got.items()], "id string, community int")).collect()}
    assert kept["a1"] == 5 and kept["b1"] == 9 and kept["alone"] == 0


def test_kept_ids_match_from_the_largest_overlap_down(spark):
    rng = random.Random(4)
    old = {f"n{i:03}": rng.choice([0, 1, 2, 3, 5, 8, 40]) for i in range(120)}
    new = {f"n{i:03}": rng.randrange(12) for i in range(20, 140)}
    shared = {}
    for x in old.keys() & new.keys():
        shared[old[x], new[x]] = shared.get((old[x], new[x]), 0) + 1
    final = {}
    for (a, b), _ in sorted(shared.items(), key=lambda p: (-p[1], p[0])):
        if a not in final.values() and b not in final:
            final[b] = a
    members = {c: sorted(x for x in new if new[x] == c) for c in set(new.values())}
    free = iter(i for i in range(1000) if i not in set(final.values()))
    for c in sorted(members, key=lambda c: (-len(members[c]), members[c][0])):
        if c not in final:
            final[c] = next(free)
    got = C.kept_ids(frame(spark, list(old.items()), "id string, community int"), frame(spark, list(new.items()), "id string, community int"))
    assert {r.id: r.community for r in got.collect()} == {x: final[c] for x, c in new.items()}


def test_louvain_is_the_same_by_a_task_and_by_joins(spark):
    names, pairs = random_edges(6, 60, 150)
    pairs = [*pairs, *(("m0", f"m{i}") for i in range(9)), ("m8", "m7")]
    names = [*names, *(f"m{i}" for i in range(9)), "alone"]
    both = [sorted(map(tuple, C.louvain(ids(spark, names), edges(spark, pairs), most_links=m).collect())) for m in (0, 10**6)]
    assert both[0] == both[1] and 1 < len({c for _, c in both[0]}) < 30


def test_communities_take_few_jobs(spark):
    """Rounds of moves start no jobs of their own."""
    rng = random.Random(2)
    pairs = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(1500)]
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    before = jobs()
    C.louvain(ids(spark, [f"n{i}" for i in range(400)]), edges(spark, pairs)).collect()
    assert jobs() - before < 60


def test_louvain_runs_until_modularity_stands_still(spark):
    """A ring of 2,000 nodes takes more than three levels to come near its best modularity, that of some 45 equal arcs."""
    n = 2000
    names = [f"n{i:04}" for i in range(n)]
    pairs = [(names[i], names[(i + 1) % n]) for i in range(n)]
    got = {r.id: r.community for r in C.louvain(ids(spark, names), edges(spark, pairs)).collect()}
    size = {}
    for x in got:
        size[got[x]] = size.get(got[x], 0) + 1
    value = sum(got[a] == got[b] for a, b in pairs) / n - sum(k * k for k in size.values()) / n**2
    best = max(1 - k / n - 1 / k for k in range(2, n))
    assert value > best - 0.02, (value, best, len(size))


PAIRS = [("manager", "managr"), ("martha", "marhta"), ("dixon", "dicksonx"), ("", "a"), ("same", "same"), ("ca", "abc"), ("abcd", "badc")]


def test_similarities_as_in_duckdb(spark):
    import duckdb

    df = frame(spark, [*PAIRS, (None, "a")], "a string, b string")
    rows = df.select("a", "b", Sim.jaro(F.col("a"), F.col("b")).alias("j"), Sim.jaro_winkler(F.col("a"), F.col("b")).alias("w"), Sim.damerau_levenshtein(F.col("a"), F.col("b")).alias("d")).collect()
    for r in rows:
        if r.a is None:
            assert r.j is None and r.d is None
            continue
        j, w, d = duckdb.execute("SELECT jaro_similarity($1, $2), jaro_winkler_similarity($1, $2), damerau_levenshtein($1, $2)", [r.a, r.b]).fetchall()[0]
        assert (r.j, r.w, r.d) == (pytest.approx(j), pytest.approx(w), d)


NODES = "id string, label string, file_type string, source_file string, source_location string, node_kind string"


def test_entities_merge_and_guards(spark):
    rows = [
        ("d1", "Message Broker Design", "concept", "a.md", "L1", None), ("d2", "message-broker design", "concept", "b.md", "L1", None), ("d3", "Mesage Broker Design", "concept", "c.md", "L1", None),
        ("v1", "release notes 2023", "concept", "a.md", "L1", None), ("v2", "release notes 2024", "concept", "b.md", "L1", None),
        ("c1", "handle_message", "code", "a.py", "L1", None), ("c2", "handle message", "code", "b.py", "L1", None),
        ("w1", "retry queue worker", "concept", "a.md", "L1", None), ("w2", "retry cache worker", "concept", "b.md", "L1", None), ("d1_c2", "Message Broker Design", "concept", "a.md", None, None),
    ]
    g = B.Graph(frame(spark, rows, NODES), frame(spark, [("d2", "c1", "mentions"), ("d2", "d3", "mentions"), ("d1_c2", "c2", "mentions")], "src string, dst string, relation string"))
    merged = D.merged(g)
    assert {r.id for r in merged.nodes.collect()} == {"d1", "v1", "v2", "c1", "c2", "w1", "w2"}
    assert sorted(map(tuple, merged.edges.select("src", "dst").collect())) == [("d1", "c1"), ("d1", "c2")]


def test_incremental_merge_twice_is_the_same(spark):
    n = lambda rows: frame(spark, rows, "id string, label string, source_file string")
    e = lambda rows: frame(spark, rows, "src string, dst string, source_file string")
    old = B.Graph(n([("a", "A", "f1"), ("b", "B", "f2"), ("c", "C", "f3"), ("x", "X", None)]), e([("a", "b", "f1"), ("b", "c", "f2"), ("a", "x", "f1")]))
    new = B.Graph(n([("a", "A2", "f1")]), e([("a", "c", "f1")]))
    once = M.merge(old, new, frame(spark, [("f2",)], "source_file string"))
    twice = M.merge(once, new)
    for g in (once, twice):
        assert sorted((r.id, r.label) for r in g.nodes.collect()) == [("a", "A2"), ("c", "C"), ("x", "X")]
        assert [tuple(r) for r in g.edges.select("src", "dst").collect()] == [("a", "c")]


def test_manifest(spark):
    scan = frame(spark, [("same", "h", 10.0), ("touched", "h", 11.0), ("edited", "h2", 11.0), ("racy", "h2", 10.0), ("new", "h", 1.0), ("unhashed", "h", 1.0)], "path string, hash string, mtime double")
    man = [("same", "h", 10.0, 60.0, True), ("touched", "h", 10.0, 60.0, True), ("edited", "h", 10.0, 60.0, True), ("racy", "h", 10.0, 11.0, True), ("gone", "h", 1.0, 9.0, False), ("out", "h", 1.0, 9.0, True), ("unhashed", None, 1.0, 9.0, True)]
    got = {r.path: r.state for r in M.manifest_changes(scan, frame(spark, man, "path string, hash string, mtime double, stamped double, alive boolean")).collect()}
    assert got == {"same": "unchanged", "touched": "unchanged", "edited": "changed", "racy": "changed", "new": "new", "gone": "deleted", "out": "excluded", "unhashed": "changed"}


def test_calls_resolve_or_stay_open(spark):
    defs = frame(spark, [("m1", "run()", "code", "pkg/a/x.py", "L1", "function"), ("m2", "run()", "code", "pkg/b/y.py", "L1", "function"), ("m3", ".only()", "code", "z.py", "L1", "method"), ("g", "run()", "code", "z.go", "L1", "function"), ("t", "only()", "code", "tests/test_z.py", "L1", "function")], NODES)
    calls = frame(spark, [(1, "c1", "pkg/a/q.py", "run"), (2, "c2", "other/q.py", "run"), (3, "c3", "pkg/q.py", "Only"), (4, "m3", "z.py", "none"), (5, "c5", "main.go", "run"), (6, "c6", "other/q.py", "run")], "call_id int, caller string, file string, callee string")
    imports = frame(spark, [("other/q.py", "m2")], "file string, id string")
    got = {r.call_id: (r.target, r.confidence) for r in R.resolve_calls(calls, R.symbols(defs)).collect()}
    assert got == {1: ("m1", "INFERRED"), 3: ("m3", "INFERRED"), 5: ("g", "INFERRED")}
    got = {r.call_id: (r.target, r.confidence) for r in R.resolve_calls(calls, R.symbols(defs), imports).collect()}
    assert got[2] == ("m2", "EXTRACTED") and got[1] == ("m1", "INFERRED")


def test_member_calls_shared_types_and_links(spark):
    calls = frame(spark, [(1, "Store", "put"), (2, "Twice", "put"), (3, "Store", "get")], "call_id int, receiver_type string, callee string")
    types = frame(spark, [("Store", "s"), ("Twice", "t1"), ("Twice", "t2")], "name string, type_id string")
    members = frame(spark, [("s", "put", "s.put"), ("s", "get", "g1"), ("s", "get", "g2")], "type_id string, name string, id string")
    assert [tuple(r) for r in R.member_calls(calls, types, members).collect()] == [(1, "s.put")]
    infra = frame(spark, [("r", "release", "my-app", None), ("c", "chart", "my_app", None), ("k", "resource", "web", "my-app"), ("i", "image", "web", None), ("b2", "build", "web", None), ("b1", "build", "web", None)], "id string, type string, name string, directory string")
    assert sorted(map(tuple, R.infrastructure_links(infra).collect())) == [("c", "k", "defines"), ("i", "b1", "built_by"), ("r", "c", "deploys")]
    sec = frame(spark, [("secret", "A", True), ("secret", "A", False), ("secret", "B", False), ("env", "C", True)], "kind string, name string, defines boolean")
    assert {(r.name, r.state) for r in R.secret_references(sec).collect()} == {("A", "resolved"), ("B", "missing"), ("C", "unused")}


def test_hunks_and_spans(spark):
    text = ["diff --git a/x.py b/x.py", "+++ b/src/x.py", "@@ -1,2 +10,3 @@ def f", "+a", "@@ -9 +30 @@", "+++ /dev/null", "@@ -1,4 +0,0 @@"]
    lines = frame(spark, [("d", i, t) for i, t in enumerate(text)], "diff_id string, pos int, line string")
    hunks = U.parse_hunks(lines)
    assert [tuple(r)[1:] for r in hunks.orderBy("first").collect()] == [("src/x.py", 10, 12), ("src/x.py", 30, 30)]
    nodes = frame(spark, [("f", "f", "code", "repo/src/x.py", "L5", None), ("g", "g", "code", "repo/src/x.py", "L12", None), ("h", "h", "code", "repo/src/x.py", "L31", None), ("file", "x", "code", "repo/src/x.py", None, None), ("o", "o", "code", "y.py", "L1", None)], NODES)
    assert {r.id for r in U.touched(hunks, U.spans(nodes)).collect()} == {"f", "g", "file"}


def test_lessons(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("n", "useful", at), ("n", "useful", at - dt.timedelta(days=30)), ("m", "useful", at), ("m", "dead_end", at - dt.timedelta(days=30)), ("k", "corrected", None), ("z", "unmarked", at), (None, "useful", at)]
    got = {r.node: (r.verdict, r.score) for r in U.lessons(frame(spark, rows, "node string, outcome string, at timestamp"), F.lit("2024-01-01"), 30.0).collect()}
    assert got == {"n": ("preferred", 1.5), "m": ("contested: useful", 0.5), "k": ("dead end", -1.0)}


def test_drift_and_pins(spark):
    res = frame(spark, [("db", "orders-staging", "deploy/staging/a.tf"), ("db", "orders", "deploy/prod/a.tf"), ("db", "cache", "deploy/prod/b.tf"), ("db", "x", "src/a.tf")], "kind string, name string, source_file string")
    assert [(r.subject, r.detail) for r in U.environment_drift(res).collect()] == [("db::cache", "prod")]
    acts = frame(spark, [("checkout", "v4"), ("setup", "a" * 40), ("x", None)], "action string, pin string")
    assert {(r.subject, r.detail) for r in U.unpinned_actions(acts).collect()} == {("checkout", "v4"), ("x", "unversioned")}


@pytest.mark.parametrize("label,want", [("redis_cache", "cache"), ("GET /users", "route"), ("orders_table", "database"), ("main()", "cli"), ("UserService", "service"), ("plain", "function"), ("on_message", "consumer")])
def test_node_category(spark, label, want):
    df = frame(spark, [(label,)], "l string")
    assert df.select(P.node_category(F.col("l"), F.lit("id"), F.lit(None).cast("string"), F.lit("a.py"))).head()[0] == want


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).head()[0]
    assert one(T.subtokens(F.lit("HTTPServer2 get_userName --x"))) == ["HTTPServer2", "http", "server2", "get_userName", "get", "user", "name", "x"]
    assert one(T.terms(F.lit("The parseJSONFile of 42 items, x"))) == ["parse", "json", "file", "items"]
    assert one(T.windows(F.lit("abcab"), 3)) == ["abc", "bca", "cab"] and one(T.windows(F.lit("ab"), 3)) == ["ab"] and one(T.windows(F.lit(""), 3)) == []
    assert one(T.entropy(F.lit("aabb"))) == 1.0 and one(T.slug(F.lit("Ça va: où?/b_c"))) == "ca-va-ou-b-c" and one(T.slug(F.lit(""))) == "unnamed"
    assert one(T.plain_html(F.lit("<p>a <b>b</b><script>x</script></p>"))) == "a b"
    assert one(P.environment(F.lit("infra/eu-prod/x.tf"))) == "prod" and one(P.environment(F.lit("src/x.tf"))) is None
    assert one(P.url_type(F.lit("https://e.org/a.PDF?x=1"))) == "pdf" and one(P.url_type(F.lit("https://arxiv.org/abs/1"))) == "arxiv"
    assert one(P.pull_request_status(F.lit("main"), F.lit("PENDING"), F.lit("APPROVED"), F.lit(False), F.lit(20), "main")) == "STALE"
    assert one(P.path_category(F.lit("src/graph/x.py"))) == "graph" and one(P.is_sensitive(F.lit("a/.env.local")))
    assert one(R.shared_directories(F.lit("a/b/c/x.py"), F.lit("a/b/d/y.py"))) == 2


def test_search(spark):
    nodes = frame(spark, [("p", "Parser", "code", "src/parser.py", "L1", "class"), ("pf", "parse_file()", "code", "src/io.py", "L1", "function"), ("q", "Queue", "code", "src/parser_queue.py", "L1", "class")], NODES)
    scores = {r.id: r.score for r in S.label_scores(nodes, ["parser"]).collect()}
    assert max(scores, key=scores.get) == "p" and scores["q"] < 1 < scores["p"]
    assert [r.id for r in S.pick_seeds(S.label_scores(nodes, ["parser"]), nodes).collect()] == ["p"]
    assert {(r.id, r.tier) for r in S.find_nodes(nodes, "parse_file").collect()} == {("pf", 1)}
    docs = frame(spark, [("1", "a", "", "the parser parses"), ("2", "parser", "", "x"), ("3", "b", "", "nothing"), ("4", "c", "", "none"), ("5", "d", "", "zero")], "id string, title string, headings string, body string")
    ranked = [r.id for r in S.bm25(docs, ["parser"]).orderBy(F.desc("score")).collect()]
    assert ranked == ["2", "1"]
    assert S.query_terms("How does the parser work?", ["how", "does", "the", "work"]) == ["parser"] and S.query_terms("how", ["how"]) == ["how"]


def test_prefix_sums_of_a_hot_group(spark):
    rows = [("hot", i, i % 5 + 1) for i in range(500)] + [("cold", i, 2) for i in range(3)] + [(None, i, 1) for i in range(4)]
    got = skew.prefix_sums(frame(spark, rows, "g string, k int, v int"), ["g"], "k", "v", "before", 7).collect()
    for g in ("hot", "cold", None):
        mine = sorted((r.before, r.v) for r in got if r.g == g)
        at = 0
        for before, v in mine:
            assert before == at
            at += v


def test_global_rank(spark):
    rows = [(i * 7919 % 503, f"k{i}") for i in range(503)]
    got = {r.a: r.place for r in skew.global_rank(frame(spark, rows, "a int, b string").repartition(5), ["a"], "place").collect()}
    assert got == {i: i for i in range(503)}
