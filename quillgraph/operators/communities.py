"""Communities: detection, splitting, and ids that last from one run to the next."""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import apart
from quillgraph.operators.analyze import cohesion, degrees, value_at_percentile
from quillgraph.operators.skew import global_rank
from quillgraph.operators.walks import both_ways
from quillgraph.session import cut, cut_counted


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community): in each round every node takes the commonest label of its neighbours, the least among equals.

    Labels are counted per (node, label) before the shuffle; a node without neighbours keeps its own.
    """
    links = cut(both_ways(edges), "links")
    label = nodes.select("id", F.col("id").alias("community")).distinct()
    for _ in range(rounds):
        votes = links.join(label.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("id").agg(F.min_by("community", F.struct((-F.col("n")).alias("n"), "community")).alias("new"))
        label = cut(label.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community")), "label")
    return label


def _level(links: DataFrame, resolution: float, least: float) -> tuple[DataFrame, float]:
    """One level of modularity moves over weighted links (src, dst, w), both ways, loops once: (id, community), and the modularity gained.

    All nodes choose at the same time, in halves told by a hash of node and round so that neighbours do not swap for
    ever; a node moves to the neighbouring community with the greatest gain, its own among equals, else the greatest. It ends when no node wants
    to move, or when two rounds running, so that most nodes had their turn, each add less than ``least`` to the greatest
    modularity so far; the labels that had the greatest are returned.
    """
    strength = cut(links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)).alias("loops")), "strength")
    total, loops = strength.agg(F.sum("k"), F.sum("loops")).head()
    total, loops = total or 1.0, loops or 0.0
    links = cut(links.where("src != dst"), "others")
    label = strength.select("id", "k", F.col("id").alias("community"))
    first, best, kept, idle = None, None, label, 0
    for r in count():
        mass = label.groupBy("community").agg(F.sum("k").alias("mass"))
        to = links.join(label.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("w").alias("w"))
        own = label.select("id", F.col("community").alias("own"), "k")
        options = to.unionByName(label.select("id", "community", F.lit(0.0).alias("w"))).groupBy("id", "community").agg(F.sum("w").alias("w")).join(own, "id").join(mass, "community")
        stays = F.col("community") == F.col("own")
        gain = F.round(F.col("w") - resolution * F.col("k") * (F.col("mass") - F.when(stays, F.col("k")).otherwise(0.0)) / total, 9)
        new = options.groupBy("id").agg(
            F.max_by("community", F.struct(gain.alias("g"), stays.alias("s"), "community")).alias("new"), F.first("own").alias("community"), F.first("k").alias("k"),
            F.max(F.when(stays, F.col("w"))).alias("inside"),
        )
        new = cut(new, "moves")
        sums = new.groupBy("community").agg(F.sum("k").alias("mass"), F.sum("inside").alias("inside"), F.count_if(F.col("new") != F.col("community")).alias("wish"))
        inside, squares, wish = sums.agg(F.sum("inside"), F.sum(F.col("mass") * F.col("mass")), F.sum("wish")).head()
        value = ((inside or 0.0) + loops) / total - resolution * (squares or 0.0) / total**2
        first = value if first is None else first
        idle = 0 if best is None or value >= best + least else idle + 1
        if best is None or value > best:
            best, kept = value, new.select("id", "community")
        if not wish or idle == 2:
            return kept, best - first
        turn = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0
        label = new.select("id", "k", F.when(turn, F.col("new")).otherwise(F.col("community")).alias("community"))


def _turns(hashes: np.ndarray, r: int) -> np.ndarray:
    """Whether xxhash64(id, r) is even, where ``hashes`` are xxhash64(id): Spark hashes the next column with the hash so far as its seed."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (hashes + p5 + np.uint64(4)) ^ (np.array([r], np.uint64) * p1)
    h = (h << np.uint64(23) | h >> np.uint64(41)) * p2 + p3
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return (h ^ h >> np.uint64(32)) & np.uint64(1) == 0


def _level_apart(s: np.ndarray, t: np.ndarray, w: np.ndarray, hashes: np.ndarray, resolution: float, least: float) -> tuple[np.ndarray, float]:
    """The same as :func:`_level`, in memory, on nodes 0 to n - 1 with their ``hashes``."""
    n = len(hashes)
    k, loop = np.bincount(s, w, n), s == t
    total, loops = k.sum() or 1.0, w[loop].sum()
    s, t, own = s[~loop], t[~loop], np.arange(n)
    base, w = np.concatenate([s, own]).astype(np.int64) * n, np.concatenate([w[~loop], np.zeros(n)])
    first, best, kept, idle = None, None, own, 0
    for r in count():
        mass = np.bincount(own, k, n)
        key = base + np.concatenate([own[t], own])
        order = np.argsort(key)
        key = key[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        into = np.add.reduceat(w[order], begins)
        node, to = np.divmod(key[begins], n)
        stays = to == own[node]
        gain = np.round(into - resolution * k[node] * (mass[to] - np.where(stays, k[node], 0.0)) / total, 9)
        top = np.maximum.reduceat(gain, np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])))
        new = own.copy()
        for good in ((good := gain == top[node]), good & stays):
            new[node[good]] = to[good]  # the last of a node, that is the greatest community, stands
        value = (into[stays].sum() + loops) / total - resolution * (mass * mass).sum() / total**2
        first = value if first is None else first
        idle = 0 if best is None or value >= best + least else idle + 1
        if best is None or value > best:
            best, kept = value, own
        if idle == 2 or (new == own).all():
            return kept, best - first
        own = np.where(_turns(hashes, r), new, own)


def _louvain_apart(resolution: float, levels: int, least: float) -> apart.Task:
    """Rows (s, t): each node and its community, a node as well."""

    def task(links: apart.Links, rest: dict) -> object:
        s, t, w = links.begin, links.end, np.ones(len(links.end))
        names, label = np.arange(links.n), np.arange(links.n)
        for _ in range(levels):
            up, gained = _level_apart(s, t, w, links.hashes[names], resolution, least)
            used, up = np.unique(up, return_inverse=True)
            names, label = names[used], up[label]
            if gained < least:
                break
            pairs, at = np.unique(up[s].astype(np.int64) * len(names) + up[t], return_inverse=True)
            s, t = np.divmod(pairs, len(names))
            w = np.bincount(at, w)
        for i in range(0, links.n, apart.ROWS):
            to = names[label[i : i + apart.ROWS]].astype(np.int32)
            yield {"s": pa.array(np.arange(i, i + len(to), dtype=np.int32)), "t": pa.array(to)}

    return task


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, levels: int = 10, least: float = 1e-4, most_links: int = apart.MOST_LINKS) -> DataFrame:
    """(id, community): modularity moves, then the same over the graph of communities. Isolated nodes are communities of their own.

    It ends with the level that adds less than ``least`` to the modularity, or after ``levels``. Up to ``most_links`` links
    (both ways) one task makes all moves in memory; with more, each round is a few joins. Both choose alike.
    """
    links, n = cut_counted(both_ways(edges).withColumn("w", F.lit(1.0)), "links")
    label = nodes.select("id", F.col("id").alias("community")).distinct()
    if 0 < n <= most_links:
        names, size, _ = apart.named(links)
        own = names.limit(0).select(F.col("code").alias("g"), F.lit(apart.SEED).alias("kind"), F.col("code").alias("at"), F.lit(None).cast("binary").alias("a"))
        found = cut(apart.walked(apart.coded(links, names), names, size, own, _louvain_apart(resolution, levels, least), "s int, t int", 1, "hash"), "moved")
        side = lambda key, name: names.select(F.col("code").alias(key), F.col("id").alias(name))
        found = found.join(side("s", "id"), "s").join(side("t", "up"), "t").select("id", "up")
        return cut(label.join(found, "id", "left").select("id", F.coalesce("up", "community").alias("community")), "label")
    for _ in range(levels):
        step, gained = _level(links, resolution, least)
        step = cut(step, "step")
        label = cut(label.join(step.select(F.col("id").alias("community"), F.col("community").alias("up")), "community", "left").select("id", F.coalesce("up", "community").alias("community")), "label")
        if gained < least:
            break
        side = lambda a, b: step.select(F.col("id").alias(a), F.col("community").alias(b))  # noqa: B023, E731
        links = cut(links.join(side("src", "s"), "src").join(side("dst", "d"), "dst").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("w")), "links")
    return label


def numbered(members: DataFrame) -> DataFrame:
    """(id, community): communities numbered from 0 by size, then by their least id."""
    sizes = members.groupBy("community").agg((-F.count(F.lit(1))).alias("n"), F.min("id").alias("first"))
    ranked = global_rank(sizes, ["n", "first"], "number").select("community", F.col("number").cast("int").alias("number"))
    return members.join(ranked, "community").select("id", F.col("number").alias("community"))


def detect(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, hub_percentile: float | None = None) -> DataFrame:
    """(id, community): Louvain communities, split where they are too large or too loose, numbered by size.

    Hubs above the percentile are left out at first and then join the community most of their neighbours are in.
    Communities of more than a quarter of the nodes (and ten), and those of at least 50 nodes with a cohesion below 0.05,
    are split once more by Louvain inside themselves.
    """
    core_edges, hub_ids = edges.select("src", "dst"), None
    if hub_percentile is not None:
        degree = degrees(nodes, edges)
        hub_ids = cut(degree.join(F.broadcast(value_at_percentile(degree, "degree", hub_percentile))).where("degree > threshold").select("id"), "hubs")
        core_edges = core_edges.join(hub_ids.withColumnRenamed("id", "src"), "src", "left_anti").join(hub_ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    found = louvain(nodes, core_edges, resolution)
    if hub_ids is not None:
        votes = both_ways(edges).join(hub_ids.withColumnRenamed("id", "src"), "src").join(found.withColumnRenamed("id", "dst"), "dst")
        votes = votes.join(hub_ids.withColumnRenamed("id", "dst"), "dst", "left_anti").groupBy(F.col("src").alias("id"), "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("id").agg(F.min_by("community", F.struct((-F.col("n")).alias("n"), "community")).alias("new"))
        found = found.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community"))
    found = cut(found, "found")
    pairs = both_ways(edges).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    most = max(10, int(nodes.select("id").distinct().count() * 0.25))
    shape = cohesion(found, pairs)
    loose = shape.where((F.col("size") > most) | ((F.col("size") >= 50) & (F.col("cohesion") < 0.05))).select("community")
    inside = cut(found.join(loose, "community", "left_semi"), "loose")
    if not inside.isEmpty():
        side = lambda key, name: inside.select(F.col("id").alias(key), F.col("community").alias(name))
        own = edges.select("src", "dst").join(side("src", "cs"), "src").join(side("dst", "cd"), "dst").where("cs = cd").select("src", "dst")
        again = louvain(inside, own, resolution).withColumnRenamed("community", "part")
        found = found.join(again, "id", "left").select("id", F.coalesce("part", "community").alias("community"))
    return numbered(cut(found, "found"))


def overlaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old, new, shared): how many members two assignments (id, community) share."""
    both = old.select("id", F.col("community").alias("old")).join(new.select("id", F.col("community").alias("new")), "id")
    return both.groupBy("old", "new").agg(F.count(F.lit(1)).alias("shared"))


def kept_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, community): ``new`` with the numbers of ``old`` where they overlap most, one to one; the others get free numbers by size.

    Pairs are taken from the largest overlap down, ties by the numbers: a round takes every pair that comes first for both
    of its communities, until no pair is left. The others take the free numbers in order of size, then of their least id.
    """
    order = F.struct((-F.col("shared")).alias("s"), "old", "new")
    left, n = cut_counted(overlaps(old, new), "overlaps")
    taken = [left.select("old", "new").limit(0)]
    while n:
        first = left.groupBy("old").agg(F.min(order).alias("x")).select("x.old", "x.new").intersect(left.groupBy("new").agg(F.min(order).alias("x")).select("x.old", "x.new"))
        first = cut(first, "taken")
        taken.append(first)
        left, n = cut_counted(left.join(first.select("old"), "old", "left_anti").join(first.select("new"), "new", "left_anti"), "overlaps")
    matched = cut(reduce(DataFrame.unionByName, taken), "matched")
    sizes = new.groupBy("community").agg((-F.count(F.lit(1))).alias("size"), F.min("id").alias("first"))
    rest = global_rank(sizes.join(matched.select(F.col("new").alias("community")), "community", "left_anti"), ["size", "first"], "k")
    used = global_rank(matched.where("old >= 0").select("old"), ["old"], "i").select((F.col("old") - F.col("i")).alias("at"), F.lit(0).alias("free"), F.lit(None).cast("int").alias("community"))
    # Behind as many taken numbers as lie before it, the k-th free number is its place among both.
    placed = global_rank(used.unionByName(rest.select(F.col("k").alias("at"), F.lit(1).alias("free"), "community")), ["at", "free"], "kept").where("free = 1")
    mapping = matched.select(F.col("new").alias("community"), F.col("old").cast("int").alias("kept")).unionByName(placed.select("community", F.col("kept").cast("int").alias("kept")))
    return new.join(mapping, "community").select("id", F.col("kept").alias("community"))
