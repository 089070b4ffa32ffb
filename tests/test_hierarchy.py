import random

import pytest

from quillgraph.operators import hierarchy as H

LINKS = "child string, parent string, code bigint, root bigint"


def tree_of(spark, links, **kw):
    df = spark.createDataFrame([(*x, 1, 2) for x in links], LINKS)
    tree = H.hierarchy(df, **kw)
    return tree, {r.node_id: r for r in tree.collect()}


def brute(links):
    parent = {}
    for c, p in links:
        if c and p and c.strip() and p.strip():
            parent[c] = min(p, parent.get(c, p))
    out = {}
    for x in {*parent, *parent.values()}:
        path, y = [x], x
        while y in parent and parent[y] not in path:
            y = parent[y]
            path.append(y)
        out[x] = ("", -1, None) if y in parent else (y, len(path) - 1, path[::-1])
    return out


def shapes():
    rng = random.Random(5)
    yield "chain", [(f"n{i + 1}", f"n{i}") for i in range(60)]
    yield "star", [(f"n{i}", "hub") for i in range(200)]
    yield "loop and tails", [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("x", "x"), ("y", "x"), ("ok", "fine")]
    yield "random", [(f"n{i}", f"n{rng.randrange(max(1, i))}") for i in range(1, 300)] + [("l0", "l1"), ("l1", "l2"), ("l2", "l0"), ("t", "l1")]
    yield "dirty", [("a", None), (None, "b"), (" ", "b"), ("a", "b"), ("a", "b"), ("a", "0"), ("c", "a")]
    yield "empty", []


@pytest.mark.parametrize("sparse", [3, 32])
@pytest.mark.parametrize("name,links", list(shapes()))
def test_against_brute_force(spark, name, links, sparse):
    tree, rows = tree_of(spark, links, sparse=sparse)
    want = brute(links)
    assert {k: (r.root_id, r.depth) for k, r in rows.items()} == {k: v[:2] for k, v in want.items()}
    for k, r in rows.items():
        inside = [x for x, v in want.items() if v[2] and k in v[2]]
        if want[k][1] >= 0:
            assert r.exit - r.entry == len(inside)
            assert all(r.entry <= rows[x].entry < r.exit for x in inside)


def walk(links):
    """Places at which each acyclic node is left and entered in a depth-first walk, largest ids first, by plain recursion."""
    parent = {}
    for c, p in links:
        parent[c] = min(p, parent.get(c, p))
    kids = {}
    for c, p in parent.items():
        kids.setdefault(p, []).append(c)
    out = {}

    def go(x, top, left, steps):
        out[x] = [top, None, None, steps]
        mine = left[0]
        for k in sorted(kids.get(x, []), reverse=True):
            go(k, top, left, steps + 1)
        left[0] += 1
        out[x][1:3] = left[0], left[0] - mine

    for top in set(kids) - set(parent):
        left = [0]
        go(top, top, left, 0)
    sizes = {t: s for x, (t, _, s, d) in out.items() if d == 0}
    return {x: (t, sizes[t] - done, sizes[t] - done + size) for x, (t, done, size, _) in out.items()}


@pytest.mark.parametrize("shape", ["random", "chain"])
def test_every_acyclic_node_has_its_interval_from_the_tour(spark, shape):
    links = dict(shapes())[shape]
    df = spark.createDataFrame(links, "child string, parent string")
    pairs = H._coded(df)
    looped = {r.c for r in H._loops(pairs).collect()}
    forest = pairs.where(~pairs.c.isin(list(looped))) if looped else pairs
    arcs = H.euler_tours(forest, forest.count()).collect()
    inner = {r.p for r in forest.collect() if r.p is not None}
    assert {r.arc // 2 for r in arcs} == {r.c for r in forest.collect()}  # each node is in the list, leaves once and others twice
    assert len({r.arc for r in arcs}) == len(arcs) == forest.count() + len(inner & {r.c for r in forest.collect()})
    _, rows = tree_of(spark, links)
    want = walk(links)
    assert {k: (r.root_id, r.entry, r.exit) for k, r in rows.items() if not r.on_loop} == want


def test_a_hot_parent_is_chained_in_buckets(spark):
    df = spark.createDataFrame([(i, f"n{i:03}", 0 if i else None) for i in range(300)], "c bigint, id string, p bigint")
    after = {r.arc: r.next for r in H.euler_tours(df, 300, buckets=8).collect()}
    at, seen = after[0], []
    while at != 1:
        seen.append(at // 2)
        at = after[at]
    assert sorted(seen) == list(range(1, 300)) and after[1] is None and seen != sorted(seen, reverse=True)


def test_paths_and_descendants(spark):
    links = [(f"n{i}", f"n{(i - 1) // 3}") for i in range(1, 60)]
    tree, _ = tree_of(spark, links)
    want = brute(links)
    assert {r.node_id: r.path for r in H.paths(tree).collect()} == {k: "/".join(v[2]) for k, v in want.items()}
    pairs = {(r.node_id, r.descendant_id): r.distance for r in H.descendants(tree).collect()}
    assert pairs == {(a, k): len(v[2]) - 1 - v[2].index(a) for k, v in want.items() for a in v[2][:-1]}


def test_links_of_edges(spark):
    rows = [("A", "b", "contains"), ("c", "A", "Part-Of"), ("x", "y", "calls"), ("", "y", "contains"), (None, "y", "method"), ("A", "b", "contains")]
    df = spark.createDataFrame(rows, "source string, target string, relation string")
    assert sorted(map(tuple, H.containment_links(df).collect())) == [("b", "a"), ("c", "a")]


def test_descendants_of_a_whole_table(spark, tmp_path):
    from quillgraph.plans import integrity

    links = [(f"n{i}", f"n{(i - 1) // 3}") for i in range(1, 60)] + [(f"c{i + 1}", f"c{i}") for i in range(40)] + [("l0", "l1"), ("l1", "l0")]
    spark.createDataFrame([(p, c, "contains") for c, p in links], "source string, target string, relation string").write.parquet(f"{tmp_path}/edges.parquet")
    want = brute(links)
    pairs = {(a, k, len(v[2]) - 1 - v[2].index(a)) for k, v in want.items() if v[2] for a in v[2][:-1]}
    rows = [tuple(r) for r in integrity.QUERIES["p5_descendants"](spark, str(tmp_path)).select("node_id", "descendant_id", "distance").collect()]
    assert set(rows) == pairs and len(rows) == len(pairs)
    tree = integrity.p5_hierarchy(spark, str(tmp_path)).collect()
    assert all(r.exit - r.entry - 1 == r.descendants == sum(a == r.node_id for a, _, _ in pairs) for r in tree if not r.on_loop)
