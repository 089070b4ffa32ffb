"""Walks over a graph: reachability, paths, ranks, centrality, components. Each loop writes its state to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import predicates as P
from quillgraph.functions import vocabulary as V
from quillgraph.operators import apart
from quillgraph.operators.analyze import degrees, kinds, value_at_percentile
from quillgraph.operators.build import Graph
from quillgraph.session import cut, cut_counted, cut_watched


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) in both directions, without loops."""
    e = edges.where("src != dst").select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None, gated: DataFrame | None = None, most_links: int = 0) -> DataFrame:
    """(seed, id, depth): what is reached from ``seeds`` (seed, id) along (src, dst) in at most ``depth`` steps, at its least depth.

    Without a ``depth`` it walks until a level is empty; the levels are then put together every 16, so that the plan stays small.
    Nodes of ``gated`` (id) are reached but, unless they are seeds, not left; this is also what keeps hubs from
    multiplying the frontier. Each level meets the edges once and drops what was visited.

    With a ``depth`` and nothing gated, up to ``most_links`` links are walked in tasks, and no level is written or shuffled. This is
    for seeds that reach so much that the levels are as large as the result.
    """
    edges, count_links = cut_counted(edges.select("src", "dst").distinct(), "edges")
    if depth is not None and gated is None and 0 < count_links <= most_links:
        names, n, size = apart.named(edges)
        if size <= apart.MOST_BYTES:
            groups = apart.groups_of(edges.sparkSession)
            start = cut(seeds.select("seed", "id").distinct().withColumn("depth", F.lit(0)), "level")
            blocks = apart.walked(apart.coded(edges, names), names, n, apart.per_seed(start, names, groups), apart.nearest(depth), apart.BLOCKS, groups)
            return start.unionByName(blocks.select(F.explode("ids").alias("id"), "seeds", "depth").select(F.explode("seeds").alias("seed"), "id", "depth"))
    level = cut(seeds.select("seed", "id").distinct().withColumn("depth", F.lit(0)), "level")
    levels = [level]
    for d in count(1) if depth is None else range(1, depth + 1):
        frontier = level if gated is None or d == 1 else level.join(gated.select("id"), "id", "left_anti")
        visited = reduce(DataFrame.unionByName, levels).select("seed", "id")
        found = frontier.join(edges.withColumnRenamed("src", "id"), "id").select("seed", F.col("dst").alias("id")).distinct()
        level = cut(found.join(visited, ["seed", "id"], "left_anti").withColumn("depth", F.lit(d)), "level")
        if level.isEmpty():
            break
        levels.append(level)
        if depth is None and len(levels) >= 16:
            levels = [cut(reduce(DataFrame.unionByName, levels), "levels")]
    return reduce(DataFrame.unionByName, levels)


def implementations(edges: DataFrame) -> DataFrame:
    """(seed, id, depth >= 1): all subtypes of each node that has one directly, at their least distance, however deep."""
    back = cut(edges.where(F.col("relation").isin(*V.SUBTYPE)).select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), "subtypes")
    return reach(back, back.select(F.col("src").alias("seed"), F.col("src").alias("id")), None).where("depth > 0")


def hubs(nodes: DataFrame, edges: DataFrame, percentile: float = 99, least: int = 50) -> DataFrame:
    """(id): nodes whose degree is at least the one at index n * percentile / 100, and at least ``least``."""
    degree = degrees(nodes, edges)
    threshold = value_at_percentile(degree, "degree", percentile, offset=0)
    return degree.join(F.broadcast(threshold)).where((F.col("degree") >= F.col("threshold")) & (F.col("degree") >= least)).select("id")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def with_members(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``seeds`` (seed, id) and the members that they hold, as seeds of the same name."""
    members = edges.where(F.col("relation").isin(*V.MEMBER)).select(F.col("src").alias("id"), "dst")
    return seeds.select("seed", "id").unionByName(seeds.join(members, "id").select("seed", F.col("dst").alias("id"))).distinct()


def dependents(edges: DataFrame, seeds: DataFrame, relations: tuple[str, ...], depth: int | None) -> DataFrame:
    """(seed, id, depth >= 1): what depends on the seeds or their members along ``relations``, backwards."""
    back = edges.where(F.col("relation").isin(*relations)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, with_members(edges, seeds), depth).where("depth > 0")


def shortest_paths(edges: DataFrame, seeds: DataFrame, depth: int = 8, sep: str | None = None, most_links: int = apart.MOST_LINKS) -> DataFrame:
    """(seed, id, depth, path): for each reached node the least path, node by node, among the shortest; with ``sep`` as nodes with that between them.

    Up to ``most_links`` links, tasks walk from their shares of the seeds in memory; with more, levels are joined.
    """
    edges, count = cut_counted(edges.select("src", "dst").distinct().where("src is not null and dst is not null"), "edges")
    level = cut(seeds.select("seed", "id", F.lit(0).alias("depth"), F.array("id").alias("path")), "path")
    if 0 < count <= most_links:
        names, n, size = apart.named(edges)
        if size <= apart.MOST_BYTES:
            groups = apart.groups_of(edges.sparkSession)
            kind = "array<string>" if sep is None else "string"
            first = level if sep is None else level.withColumn("path", F.array_join("path", sep))
            own = apart.per_seed(level, names, groups)
            return first.unionByName(apart.walked(apart.coded(edges, names), names, n, own, apart.least_paths(depth, sep), f"seed string, id string, depth int, path {kind}", groups))
    levels = [level]
    for d in range(1, depth + 1):
        visited = reduce(DataFrame.unionByName, levels).select("seed", "id")
        step = level.join(edges.withColumnRenamed("src", "id"), "id").select("seed", F.col("dst").alias("id"), "path")
        step = step.join(visited, ["seed", "id"], "left_anti").groupBy("seed", "id").agg(F.min("path").alias("path"))
        level = cut(step.select("seed", "id", F.lit(d).alias("depth"), F.concat("path", F.array("id")).alias("path")), "path")
        if level.isEmpty():
            break
        levels.append(level)
    found = reduce(DataFrame.unionByName, levels)
    return found if sep is None else found.withColumn("path", F.array_join("path", sep))


def flows(graph: Graph, starts: DataFrame, sinks: DataFrame, depth: int = 15, per_start: int | None = None, sep: str | None = None, most_links: int = apart.MOST_LINKS) -> DataFrame:
    """(start, sink, length, path): simple paths along forward relations from ``starts`` (id) to ``sinks`` (id), at most ``depth`` steps.

    Only nodes that can still reach a sink in the steps left are walked to. ``per_start`` keeps the shortest, then least paths; with ``sep``
    a path is its nodes with that between them. Up to ``most_links`` links, tasks grow their shares of the paths in memory;
    with more, paths grow by joins, level by level.
    """
    forward = graph.edges.where((F.col("relation").isin(*V.FORWARD) | (F.col("relation") == "")) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()
    forward, count = cut_counted(forward, "forward")
    rows = _flows_apart(forward, starts, sinks, depth, sep) if 0 < count <= most_links else None
    if rows is None:
        rows = _flows_joined(forward, starts, sinks, depth)
        rows = rows if sep is None else rows.withColumn("path", F.array_join("path", sep))
    if per_start is not None:
        from pyspark.sql import Window

        rank = F.row_number().over(Window.partitionBy("start").orderBy("length", "path"))
        rows = rows.withColumn("_r", rank).where(F.col("_r") <= per_start).drop("_r")
    return rows


def _flows_apart(forward: DataFrame, starts: DataFrame, sinks: DataFrame, depth: int, sep: str | None) -> DataFrame | None:
    names, n, size = apart.named(forward)
    if size > apart.MOST_BYTES:
        return None
    groups = apart.groups_of(forward.sparkSession)
    row = lambda ids, kind: ids.join(names, "id").select(F.lit(None).cast("int").alias("g"), F.lit(kind).alias("kind"), F.col("code").alias("at"), F.lit(None).cast("binary").alias("a"))
    own = row(starts.select("id"), apart.SEED).unionByName(row(sinks.select("id").distinct(), apart.SINK))
    met = apart.walked(apart.coded(forward, names), names, n, own, apart.simple_paths(depth, groups, sep), apart.halves(sep), groups)
    met = met.select(F.explode("tails").alias("tail"), "heads", "length").select(F.explode("heads").alias("head"), "tail", "length")
    return met.select("head.start", "tail.sink", "length", F.concat("head.path", "tail.path").alias("path"))


def _flows_joined(forward: DataFrame, starts: DataFrame, sinks: DataFrame, depth: int) -> DataFrame:
    ends = cut(sinks.select("id").distinct(), "sinks")
    to_sink = reach(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ends.select(F.lit("").alias("seed"), "id"), depth)
    to_sink = cut(to_sink.select("id", F.col("depth").alias("left")), "to_sink")
    paths = cut(starts.select(F.col("id").alias("start"), F.col("id").alias("end"), F.array("id").alias("path")), "flow")
    found = []
    for d in range(1, depth + 1):
        step = paths.join(forward.select(F.col("src").alias("end"), F.col("dst").alias("next")), "end").where("not array_contains(path, next)")
        step = step.join(to_sink.where(F.col("left") <= depth - d).select(F.col("id").alias("next")), "next", "left_semi")
        paths = cut(step.select("start", F.col("next").alias("end"), F.concat("path", F.array("next")).alias("path")), "flow")
        found.append(paths.join(ends.withColumnRenamed("id", "end"), "end", "left_semi").select("start", F.col("end").alias("sink"), F.lit(d).alias("length"), "path"))
    return reduce(DataFrame.unionByName, found)


def page_rank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, alpha: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(id, rank): power iteration over distinct neighbours both ways, edge weights ignored.

    ``seeds`` (id, weight) personalises the restart and what dangling nodes give back. It stops after ``rounds``, or
    when the ranks move by less than ``tolerance`` in all. Contributions are summed before their shuffle; a round is one job.
    """
    links = both_ways(edges)
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    ids = nodes.select("id").distinct()
    if seeds is None:
        n = ids.count()
        start = ids.withColumn("p", F.lit(1.0 / max(n, 1)))
    else:
        total = seeds.agg(F.sum("weight")).head()[0]
        start = ids.join(seeds.select("id", (F.col("weight") / total).alias("p")), "id", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    links = cut(links, "links")
    lost = F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("rank"))), F.lit(0.0))
    first = start.join(out.withColumnRenamed("src", "id"), "id", "left").select("id", "p", F.coalesce("out", F.lit(0)).alias("out"), F.col("p").alias("rank"))
    state, seen = cut_watched(first, "rank", lost=lost)
    for _ in range(rounds):
        shares = state.where("out > 0").select(F.col("id").alias("src"), (F.col("rank") / F.col("out")).alias("share"))
        given = links.join(shares, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("given"))
        value = alpha * F.coalesce("given", F.lit(0.0)) + (alpha * seen["lost"] + (1 - alpha)) * F.col("p")
        new = state.join(given, "id", "left").select("id", "p", "out", value.alias("rank"), F.abs(value - F.col("rank")).alias("moved"))
        state, seen = cut_watched(new, "rank", lost=lost, moved=F.sum("moved"))
        if tolerance is not None and seen["moved"] < tolerance:
            break
    return state.select("id", "rank")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each connected component.

    Rounds of taking the least label among neighbours and then following labels to their own label, so chains of length
    n take about log n rounds. Only edges between different labels stay.
    """
    ids = nodes.select("id").distinct()
    links = cut(both_ways(edges), "links")
    label = cut(ids.select("id", F.col("id").alias("component")), "label")
    while True:
        seen = label.select(F.col("id").alias("src"), F.col("component").alias("c"))
        least = links.join(seen, "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("c"))
        hooked = label.join(least, "id", "left").select("id", F.least("component", F.coalesce("c", "component")).alias("to"), "component")
        hooked = cut(hooked, "hooked")
        # The label of a node takes over what any of its nodes found, and nodes follow labels.
        roots = hooked.groupBy(F.col("component").alias("to0")).agg(F.min("to").alias("root"))
        moved = hooked.join(roots.withColumnRenamed("to0", "component"), "component").select("id", "component", F.least("to", "root").alias("to"))
        jump = roots.select(F.col("to0").alias("to"), F.col("root").alias("next"))
        new = moved.join(jump, "to", "left").select("id", F.coalesce("next", "to").alias("new"), "component")
        new = cut(new, "label")
        changed = not new.where("new != component").isEmpty()
        label = new.select("id", F.col("new").alias("component"))
        if not changed:
            return label


def _shortest_counts(links: DataFrame, pivots: DataFrame) -> list[DataFrame]:
    """Levels of (pivot, id, sigma): how many shortest paths lead from each pivot to each node."""
    level, n = cut_counted(pivots.select(F.col("id").alias("pivot"), "id", F.lit(1.0).alias("sigma")), "sigma")
    levels: list[DataFrame] = []
    while n:
        levels.append(level)
        step = level.join(links.withColumnRenamed("src", "id"), "id").groupBy("pivot", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        # Links go both ways, so a step leads one level down, to the same level, or one level up.
        seen = reduce(DataFrame.unionByName, levels[-2:]).select("pivot", "id")
        level, n = cut_counted(step.join(seen, ["pivot", "id"], "left_anti"), "sigma")
    return levels


def _dependencies(links: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Brandes' accumulation, level by level backwards: (pivot, upper, lower, share) of the edges that shortest paths go down."""
    below, edges = None, []
    for k in range(len(levels) - 1, 0, -1):
        own = levels[k] if below is None else levels[k].join(below, ["pivot", "id"], "left")
        share = (F.lit(1.0) + (F.coalesce("delta", F.lit(0.0)) if below is not None else F.lit(0.0))) / F.col("sigma")
        up = own.select("pivot", F.col("id").alias("src"), share.alias("share")).join(links, "src").select("pivot", "src", F.col("dst").alias("id"), "share")
        back = up.join(levels[k - 1], ["pivot", "id"])
        back = cut(back.select("pivot", F.col("id").alias("upper"), F.col("src").alias("lower"), (F.col("sigma") * F.col("share")).alias("share")), "delta")
        edges.append(back)
        below = back.groupBy("pivot", F.col("upper").alias("id")).agg(F.sum("share").alias("delta"))
    empty = links.select(F.col("src").alias("pivot"), F.col("src").alias("upper"), F.col("dst").alias("lower"), F.lit(0.0).alias("share")).limit(0)
    return reduce(DataFrame.unionByName, edges, empty)


def brandes(links: apart.Links, pivots: np.ndarray, of_links: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(delta of each node, with ``of_links`` share of each link) summed over ``pivots``. A pivot's own delta is left out."""
    n = links.n
    nodes, shares, place = np.zeros(n), np.zeros(len(links.end)) if of_links else None, np.zeros(n, np.int32)
    for pivot in pivots:
        depth, sigma, delta = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n)
        depth[pivot], sigma[pivot] = 0, 1.0
        frontier, steps = np.array([pivot], np.int32), []
        while len(frontier):
            which, at = links.step(frontier)
            to = links.end[at]
            new = to[depth[to] < 0]
            new = new[links.firsts(new)]
            depth[new] = len(steps) + 1
            down = depth[to] == len(steps) + 1
            which, to, at = which[down], to[down], at[down] if of_links else None
            place[new] = np.arange(len(new), dtype=np.int32)
            sigma[new] = np.bincount(place[to], weights=sigma[frontier][which], minlength=len(new))
            steps.append((frontier, which, to, at))
            frontier = new
        for frontier, which, to, at in reversed(steps):
            share = sigma[frontier][which] / sigma[to] * (1 + delta[to])
            if of_links:
                shares[at] += share
            delta[frontier] = np.bincount(which, weights=share, minlength=len(frontier))
        delta[pivot] = 0.0
        nodes += delta
    return nodes, shares


def _brandes_task(of_links: bool) -> apart.Task:
    """Rows (s, t, share): of nodes, without a t, or of links."""

    def task(links: apart.Links, rest: dict) -> Iterator[dict]:
        nodes, shares = brandes(links, np.array([r[0] for r in rest[apart.SEED]], np.int32), of_links)
        found = shares if of_links else nodes
        some = np.flatnonzero(found)
        for i in range(0, len(some), 10 * apart.ROWS):
            at = some[i : i + 10 * apart.ROWS]
            s, t = (pa.array(links.begin[at]), pa.array(links.end[at])) if of_links else (pa.array(at.astype(np.int32)), pa.nulls(len(at), pa.int32()))
            yield {"s": s, "t": t, "share": pa.array(found[at])}

    return task


def _shares(links: DataFrame, pivots: DataFrame, most_links: int, of_links: bool) -> DataFrame:
    """(id, delta), or with ``of_links`` (a, b, share): the dependencies of all ``pivots`` (id), summed.

    Up to ``most_links`` links (src, dst) fit a task well, so each of a few groups of pivots gets them all and walks
    its pivots one after another; more are walked by joins, level by level for all pivots at once. Both give the same.
    """
    links, count = cut_counted(links, "links")
    if not 0 < count <= most_links:
        found = _dependencies(links, _shortest_counts(links, pivots))
        if of_links:
            return found.groupBy(F.least("upper", "lower").alias("a"), F.greatest("upper", "lower").alias("b")).agg(F.sum("share").alias("share"))
        return found.where("upper != pivot").groupBy(F.col("upper").alias("id")).agg(F.sum("share").alias("delta"))
    groups = apart.groups_of(links.sparkSession)
    names, n, _ = apart.named(links)
    code = lambda c, out: names.select(F.col("id").alias(c), F.col("code").alias(out))
    turn = (F.row_number().over(Window.orderBy("code")) % groups).alias("g")
    own = pivots.select("id").distinct().join(names, "id").select(turn, F.lit(apart.SEED).alias("kind"), F.col("code").alias("at"), F.lit(None).cast("binary").alias("a"))
    walked = cut(apart.walked(apart.coded(links, names), names, n, own, _brandes_task(of_links), "s int, t int, share double", groups, None), "shares")
    if not of_links:
        return walked.groupBy("s").agg(F.sum("share").alias("delta")).join(code("id", "s"), "s").select("id", "delta")
    edges = walked.join(code("x", "s"), "s").join(code("y", "t"), "t")
    return edges.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("share").alias("share"))


def betweenness(nodes: DataFrame, edges: DataFrame, pivots: DataFrame, most_links: int = apart.MOST_LINKS) -> DataFrame:
    """(id, betweenness): shortest paths of any length through each node from the ``pivots`` (id), scaled to all nodes, both ways, normalised.

    Shortest paths are counted from each pivot, then dependencies summed backwards; with all nodes as pivots the result
    is exact. For ``most_links`` see :func:`_shares`.
    """
    deltas = _shares(both_ways(edges), pivots, most_links, False)
    ids = nodes.select("id").distinct()
    n, k = ids.count(), pivots.count()
    scale = n / max(k, 1) / max((n - 1) * (n - 2), 1)
    return ids.join(deltas, "id", "left").select("id", (F.coalesce("delta", F.lit(0.0)) * scale).alias("betweenness"))


def edge_betweenness(nodes: DataFrame, edges: DataFrame, pivots: DataFrame, most_links: int = 2_000_000) -> DataFrame:
    """(a, b, betweenness): shortest paths over each undirected edge from the ``pivots``, scaled to all nodes, normalised by n * (n - 1)."""
    links = both_ways(edges)
    shares = _shares(links, pivots, most_links, True)
    pairs = links.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    n, k = nodes.select("id").distinct().count(), pivots.count()
    scale = n / max(k, 1) / max(n * (n - 1), 1)
    return pairs.join(shares, ["a", "b"], "left").select("a", "b", (F.coalesce("share", F.lit(0.0)) * scale).alias("betweenness"))


def impact(graph: Graph, targets: DataFrame, communities: DataFrame, ranks: DataFrame, depth: int = 10) -> DataFrame:
    """A row for each of ``targets`` (id): what depends on it, by kind, with a risk score and tier.

    The score adds up to 0.4 for the number of dependents (logarithmic, full at 49), 0.25 for well-connected ones among
    them, 0.2 for the communities (id, community) they lie in and 0.15 for the target's rank (id, rank) of the highest.
    """
    import math

    found = cut(dependents(graph.edges, targets.select(F.col("id").alias("seed"), "id"), V.IMPACT, depth), "impact")
    found = found.where("id != seed")
    degree = degrees(graph.nodes, graph.edges)
    n = kinds(graph, degree)
    real = n.where("not is_file and not is_concept and not is_noise").select("id", "degree")
    ranked = real.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    total = real.count()
    at = max(0, int(total * 0.05) - 1)
    from pyspark.sql import Window

    upto = ranked.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, 0)))
    threshold = upto.where(F.col("upto") > at).agg(F.max("degree").alias("t")).select(F.greatest(F.coalesce("t", F.lit(10)), F.lit(10)).alias("t"))
    gods = real.join(F.broadcast(threshold)).where("degree >= t").select("id", F.lit(True).alias("god"))
    label, path, kind = F.col("label"), F.col("source_file"), F.col("file_type")
    flags = graph.nodes.select("id", P.is_test(label, path).alias("test"), P.is_api(label, kind).alias("api"), P.is_infrastructure(path, kind).alias("infra"))
    rows = found.join(flags, "id").join(gods, "id", "left").join(communities.select("id", "community"), "id", "left")
    sums = rows.groupBy(F.col("seed").alias("id")).agg(
        F.count(F.lit(1)).alias("dependents"), F.count_if("test").alias("tests"), F.count_if("api").alias("apis"), F.count_if("infra").alias("infrastructure"),
        F.count_if("god").alias("gods"), F.count_distinct("community").alias("communities"),
    )
    top = ranks.agg(F.max("rank").alias("top"))
    out = targets.select("id").join(sums, "id", "left").join(ranks, "id", "left").join(F.broadcast(top))
    counts = ("dependents", "tests", "apis", "infrastructure", "gods", "communities")
    out = out.select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), (F.coalesce("rank", F.lit(0.0)) / F.col("top")).alias("ratio"))
    score = (
        F.least(F.lit(0.4), 0.4 * (F.log(F.col("dependents") + 1) / math.log(50))) + F.least(F.lit(0.25), F.col("gods") * 0.125)
        + F.least(F.lit(0.2), F.col("communities") * 0.05) + 0.15 * F.least(F.lit(1.0), F.col("ratio"))
    )
    out = out.withColumn("risk", F.round(score, 3)).drop("ratio")
    return out.withColumn("tier", F.when(F.col("risk") >= 0.7, "CRITICAL").when(F.col("risk") >= 0.45, "HIGH").when(F.col("risk") >= 0.2, "MEDIUM").otherwise("LOW"))
