"""Parent-child links of unknown depth to whole hierarchies: roots, depths, intervals, paths, descendants and loops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.ids import canonical_id, filled
from quillgraph.operators.skew import hot_codes, is_one_of
from quillgraph.session import cut, cut_counted, partitions

# Relations that say that one node lies inside another, by the end that is the parent.
PARENT_IS_SOURCE = ("contains", "method", "parent_of", "has_part")
PARENT_IS_TARGET = ("part_of",)

def containment_rows(edges: DataFrame) -> DataFrame:
    """(child, parent): canonical ids of each edge that places one node inside another, both endpoints non-blank."""
    relation = canonical_id(F.col("relation"))
    rows = edges.select("source", "target", relation.alias("relation")).where(
        F.col("relation").isin(*PARENT_IS_SOURCE, *PARENT_IS_TARGET) & filled(F.col("source")) & filled(F.col("target"))
    )
    up = F.col("relation").isin(*PARENT_IS_TARGET)
    rows = rows.select(F.when(up, F.col("source")).otherwise(F.col("target")).alias("c"), F.when(up, F.col("target")).otherwise(F.col("source")).alias("p"))
    links = rows.select(canonical_id(F.col("c")).alias("child"), canonical_id(F.col("p")).alias("parent"))
    return links.where("child != '' and parent != ''")


def containment_links(edges: DataFrame) -> DataFrame:
    """The distinct rows of :func:`containment_rows`."""
    return containment_rows(edges).distinct()


def _coded(links: DataFrame) -> DataFrame:
    """(c, id, p, parent) of all nodes, roots with null p and parent. Codes are numbers given once to the distinct ids, so they cannot collide.

    A parent that very many children name is spread over salts where they look its code up.
    """
    kids = cut(links.groupBy(F.col("child").alias("id")).agg(F.min("parent").alias("parent")), "kids")
    roots = kids.select(F.col("parent").alias("id")).distinct().join(kids.select("id"), "id", "left_anti")
    nodes = kids.unionByName(roots.withColumn("parent", F.lit(None).cast("string")))
    nodes, total = cut_counted(nodes.withColumn("c", F.monotonically_increasing_id()), "nodes")
    salts = max(2, partitions(links.sparkSession))
    named = nodes.where("parent is not null")
    hot = hot_codes(named.select(F.xxhash64("parent").alias("h")), "h", total)
    is_hot = lambda c: is_one_of(F.xxhash64(c), hot)
    asked = named.withColumn("salt", F.when(is_hot("parent"), F.pmod(F.col("c"), F.lit(salts)).cast("int")).otherwise(0))
    spread = F.explode(F.when(is_hot("id"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    codes = nodes.select(F.col("id").alias("parent"), F.col("c").alias("p"), spread.alias("salt"))
    found = asked.join(codes, ["parent", "salt"]).select("c", "id", "p", "parent")
    tops = nodes.where("parent is null").select("c", "id", F.lit(None).cast("bigint").alias("p"), "parent")
    return cut(found.unionByName(tops), "coded")


def _loops(pairs: DataFrame) -> DataFrame:
    """(c): the nodes on loops, from all (c, p): what is left when leaves are peeled until there is none.

    After each peel the rest points to its grandparents instead, so even a long chain is gone in about log2 of its
    length rounds; a loop stays a loop (or falls into shorter ones) and cannot be peeled.
    """
    live, before = pairs.select("c", "p"), -1
    while True:
        inner = live.where("p is not null").select(F.col("p").alias("c")).distinct()
        rest = live.join(inner, "c", "left_semi")
        jumped = rest.join(rest.select(F.col("c").alias("p"), F.col("p").alias("p2")), "p", "left").select("c", F.col("p2").alias("p"))
        live, n = cut_counted(jumped, "peeled")
        if n in (0, before):
            return live.select("c")
        before = n


def euler_tours(forest: DataFrame, total: int, buckets: int = 64) -> DataFrame:
    """The Euler tours of ``forest`` (c, id, p; roots have null p), ``total`` rows, as linked lists (arc, next, root, place, step).

    A node with children is entered by arc 2c and left by arc 2c + 1, a leaf is both at once in arc 2c. The last arc of
    a tour has null ``next`` and carries the code of its ``root``. ``place`` counts nodes that are left, ``step`` goes
    down and up. Siblings follow one another from the largest id to the smallest; those of a parent that holds a large
    part of all rows are chained in hash buckets first, and only the buckets' ends meet.
    """
    kids = forest.where("p is not null").select("c", "id", "p")
    hot = is_one_of(F.col("p"), hot_codes(kids, "p", total))
    kids = kids.withColumn("b", F.when(hot, F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).otherwise(0))
    by_id = Window.partitionBy("p", "b").orderBy(F.desc("id"))
    kids = kids.withColumn("sibling", F.lead("c").over(by_id)).withColumn("first", F.row_number().over(by_id) == 1)
    kids = cut(kids.select("c", "p", "b", "sibling", "first"), "siblings")
    starts = kids.where("first").select("p", "b", F.col("c").alias("start"))
    heads = starts.groupBy(F.col("p").alias("c")).agg(F.max_by("start", "b").alias("child"))
    chained = starts.where(hot).withColumn("following", F.lead("start").over(Window.partitionBy("p").orderBy(F.desc("b")))).select("p", "b", "following")
    ends = kids.where(F.col("sibling").isNull() & hot).join(F.broadcast(chained), ["p", "b"]).select("c", "p", F.col("following").alias("sibling"))
    linked = kids.where(F.col("sibling").isNotNull() | ~hot).select("c", "p", "sibling").unionByName(ends)
    none = F.lit(None).cast("bigint")
    linked = linked.unionByName(forest.where("p is null").select("c", "p", none.alias("sibling"))).join(heads, "c", "left")
    arc = lambda a, n, root, place, step: F.struct(a.alias("arc"), n.alias("next"), root.alias("root"), F.lit(place).cast("bigint").alias("place"), F.lit(step).cast("bigint").alias("step"))
    after = F.coalesce(2 * F.col("sibling"), 2 * F.col("p") + 1)
    root = F.when(F.col("p").isNull(), F.col("c"))
    enter, leave = 2 * F.col("c"), 2 * F.col("c") + 1
    arcs = F.when(F.col("child").isNull(), F.array(arc(enter, after, root, 1, 0))).otherwise(
        F.array(arc(enter, 2 * F.col("child"), none, 0, 1), arc(leave, after, root, 1, -1))
    )
    return linked.select(F.explode(arcs).alias("x")).select("x.*")


def list_ranks(tours: DataFrame, sparse: int = 32, level: int = 0) -> DataFrame:
    """(arc, root, place, step) of ``tours`` (arc, next, root, place, step): the sums from each arc to the end of its list, and the root there.

    One arc in ``sparse``, told by a hash, is a ruler. All arcs double their pointers until these reach a ruler or the
    end; arcs that have leave the rounds, so the work of a level is linear whatever the length of the lists. Then the
    rulers alone are ranked as lists of their own, and each arc adds the ranks of its ruler. Every list must end.
    """
    ruler = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(level)), F.lit(sparse)) == 0
    going = F.col("next").isNotNull() & ~ruler("next")
    state, left = cut_counted(tours, "arcs", going)
    finished: list[DataFrame] = []
    while left:
        finished.append(state.where(~going))
        reached = reduce(DataFrame.unionByName, [*finished, state.where(going)]).where(~ruler("arc"))
        reached = reached.select(F.col("arc").alias("next"), F.col("next").alias("n2"), F.col("root").alias("r2"), F.col("place").alias("p2"), F.col("step").alias("s2"))
        jumped = state.where(going).join(reached, "next").select(
            "arc", F.col("n2").alias("next"), F.col("r2").alias("root"), (F.col("place") + F.col("p2")).alias("place"), (F.col("step") + F.col("s2")).alias("step")
        )
        state, left = cut_counted(jumped, "arcs", going)
    rows = reduce(DataFrame.unionByName, [*finished, state])
    ended = rows.where("next is null").select("arc", "root", "place", "step")
    if rows.where("next is not null").isEmpty():
        return ended
    rulers = cut(list_ranks(rows.where(ruler("arc")), sparse, level + 1), "rulers")
    onward = rulers.select(F.col("arc").alias("next"), F.col("root").alias("r2"), F.col("place").alias("p2"), F.col("step").alias("s2"))
    others = rows.where(F.col("next").isNotNull() & ~ruler("arc")).join(onward, "next")
    others = others.select("arc", F.col("r2").alias("root"), (F.col("place") + F.col("p2")).alias("place"), (F.col("step") + F.col("s2")).alias("step"))
    return ended.where(~ruler("arc")).unionByName(others).unionByName(rulers)


def hierarchy(links: DataFrame, sparse: int = 32) -> DataFrame:
    """(node_id, parent_id, root_id, depth, entry, exit, on_loop) for each node of ``links`` (child, parent).

    Peeled leaves expose the loops. Loops are cut open, so that every node lies in a tree, and all trees become Euler
    tours that are ranked in parallel: how many nodes are left from the arc on gives the interval, the steps give the
    depth, the end of the tour the root. Nodes are numbered so that a parent comes before its children and smaller ids
    come first (but for parents that hold a large part of all rows). Within a root the descendants of a node are the nodes
    with ``entry`` in (entry, exit), so their number is exit - entry - 1. Nodes on or below a loop, that is in a tree whose
    root was on one, have root_id '', depth -1 and no interval; ``on_loop`` is true for both.

    Null or blank ids are no nodes and repeated rows count once; a child with several parents keeps the smallest one; a
    node that is its own parent is a loop. An empty table gives no rows, and other columns are not read.
    """
    pairs = _coded(links.select("child", "parent").where(filled(F.col("child")) & filled(F.col("parent"))))
    loops = _loops(pairs).withColumn("looped", F.lit(True))
    forest = pairs.join(loops, "c", "left").select("c", "id", F.when(F.col("looped").isNull(), F.col("p")).alias("p"), F.coalesce("looped", F.lit(False)).alias("looped"))
    forest, total = cut_counted(forest, "forest")
    ranked = list_ranks(euler_tours(forest, total), sparse)
    left = F.pmod(F.col("arc"), F.lit(2)) == 1
    placed = ranked.groupBy(F.expr("shiftright(arc, 1)").alias("c")).agg(
        F.max("root").alias("root"), F.max(F.when(~left, F.col("place"))).alias("from"), F.max(F.when(left, F.col("place"))).alias("to"), F.max(F.when(~left, -F.col("step"))).alias("depth")
    )
    tops = forest.where("p is null").select(F.col("c").alias("root"), F.col("id").alias("root_id"), "looped")
    rows = pairs.select("c", F.col("id").alias("node_id"), F.col("parent").alias("parent_id")).join(placed, "c").join(tops, "root")
    entry = F.coalesce("to", "from") - 1
    of_tree = lambda x: F.when(~F.col("looped"), x)
    return rows.select(
        "node_id", "parent_id", F.coalesce(of_tree(F.col("root_id")), F.lit("")).alias("root_id"), F.coalesce(of_tree(F.col("depth")), F.lit(-1)).cast("int").alias("depth"),
        of_tree(entry).alias("entry"), of_tree(entry + F.coalesce(F.col("from") - F.col("to"), F.lit(0)) + 1).alias("exit"), F.col("looped").alias("on_loop"),
    )


def ancestor_pairs(tree: DataFrame, salted_from: int = 12, salts: int = 16) -> DataFrame:
    """(node_id, ancestor_id, ancestor_depth) of all proper ancestors, from the intervals of :func:`hierarchy`.

    The inside of each interval is cut into aligned blocks of a power of two, each node looks its entry up once per block
    size, and the two meet by equality. Large blocks hold many nodes but few ancestors, so from size 2**``salted_from``
    on the nodes are spread over ``salts``.
    """
    tree = tree.where("not on_loop").select("node_id", "root_id", "depth", "entry", "exit")
    top = tree.agg(F.max("exit")).head()[0] or 1
    levels = range(max(1, int(top).bit_length()))
    outer = tree.where("exit - entry > 1").select("root_id", F.col("node_id").alias("ancestor_id"), F.col("depth").alias("ancestor_depth"), (F.col("entry") + 1).alias("lo"), F.col("exit").alias("hi"))
    blocks = []
    for k in levels:
        size = 1 << k
        up = F.expr(f"shiftright(lo + {size - 1}, {k})")
        down = F.expr(f"shiftright(hi, {k})")
        odd_left = (up < down) & (F.pmod(up, F.lit(2)) == 1)
        odd_right = (up < down) & (F.pmod(down, F.lit(2)) == 1) & ~((down == up + 1) & odd_left)
        for hit, block in ((odd_left, up), (odd_right, down - 1)):
            blocks.append(F.when(hit, F.struct(F.lit(k).alias("k"), block.cast("bigint").alias("block"))))
    cover = F.filter(F.array(*blocks), lambda x: x.isNotNull())
    spread = F.explode(F.when(F.col("k") >= salted_from, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    outer = outer.select("root_id", "ancestor_id", "ancestor_depth", F.explode(cover).alias("x")).select("root_id", "ancestor_id", "ancestor_depth", "x.k", "x.block").withColumn("salt", spread)
    look = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.expr(f"shiftright(entry, {k})").alias("block")) for k in levels)))
    inner = tree.select("node_id", "root_id", look.alias("x")).select(
        "node_id", "root_id", "x.k", "x.block", F.when(F.col("x.k") >= salted_from, F.pmod(F.xxhash64("node_id"), F.lit(salts)).cast("int")).otherwise(0).alias("salt")
    )
    return inner.join(outer, ["root_id", "k", "block", "salt"]).select("node_id", "ancestor_id", "ancestor_depth")


def paths(tree: DataFrame, separator: str = "/") -> DataFrame:
    """(node_id, path): the ids from the root to the node. Nodes on or below loops have none. A list is as long as its node is deep."""
    above = ancestor_pairs(tree).groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("ancestor_depth", "ancestor_id"))).alias("a"))
    rows = tree.where("not on_loop").select("node_id").join(above, "node_id", "left")
    steps = F.concat(F.coalesce(F.col("a.ancestor_id"), F.array().cast("array<string>")), F.array("node_id"))
    return rows.select("node_id", F.array_join(steps, separator).alias("path"))


def descendants(tree: DataFrame) -> DataFrame:
    """(node_id, descendant_id, distance): all pairs of a node and a node below it."""
    depth = tree.select("node_id", "depth")
    return ancestor_pairs(tree).join(depth, "node_id").select(F.col("ancestor_id").alias("node_id"), F.col("node_id").alias("descendant_id"), (F.col("depth") - F.col("ancestor_depth")).alias("distance"))
