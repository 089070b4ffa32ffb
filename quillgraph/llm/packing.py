"""Filling containers of fixed capacity: large items are matched, small ones fill the tightest gaps."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.skew import prefix_sums
from quillgraph.session import cut

RUN = "budget_id int, size bigint, rank_from bigint, rank_to bigint, each bigint, first_container bigint"


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pack items, given as how many there are of each size, into containers: (runs, number of containers).

    A run (size, rank_from, rank_to, each, first) puts the items of that size with these ranks, ``each`` to a container,
    into the containers from ``first`` on. Items above a third of the capacity are taken from the largest down, and each
    is matched with the largest such item that still fits; so a container holds at most two of them. The others go, from the largest
    down, into the tightest gap that holds them, as often as they fit, and open new containers only when no gap does.
    Equal sizes and equal gaps are handled at once, so the work depends on the capacity and not on the number of items.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    open_gaps: list[int] = []
    containers = 0

    def place(size: int, each: int, n: int, first: int) -> None:
        runs.append((size, used[size], used[size] + each * n, each, first))
        used[size] += each * n
        left[size] -= each * n

    def leave(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if not gaps[gap]:
                insort(open_gaps, gap)
            gaps[gap].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        k = bisect_right(large, capacity - a) - 1
        b = large[k] if k >= 0 else 0
        if b == a and left[a] == 1:
            b = large[k - 1] if k > 0 else 0
        n = left[a] // 2 if a == b else min(left[a], left[b]) if b else left[a]
        if a == b:
            place(a, 2, n, containers)
        else:
            place(a, 1, n, containers)
            if b:
                place(b, 1, n, containers)
        leave(capacity - a - b, containers, n)
        containers += n
        for s in {a, b} - {0}:
            if not left[s]:
                large.pop(bisect_left(large, s))

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect_left(open_gaps, size)
            if at == len(open_gaps):
                gap, (first, n) = capacity, (containers, -(-left[size] // (capacity // size)))
                containers += n
            else:
                gap = open_gaps[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(at)
            each = gap // size
            full = min(n, left[size] // each)
            if full:
                place(size, each, full, first)
                leave(gap - each * size, first, full)
            rest = left[size] if full < n else 0
            if rest:
                place(size, rest, 1, first + full)
                leave(gap - rest * size, first + full, 1)
            leave(gap, first + full + bool(rest), n - full - bool(rest))
    return runs, containers


def pack(items: DataFrame, budgets: DataFrame, buckets: int = 256) -> DataFrame:
    """(budget_id, container, doc_id, part, first_token, n_tokens): ``items`` (doc_id, tokens) in containers of each budget.

    Only an item larger than the capacity is cut, into full containers and a rest. The sizes are counted before a shuffle
    and planned as a histogram of at most ``capacity`` entries for each budget; the plan's runs, whose number depends on
    the capacities alone, are broadcast, and each item finds its place by its rank among items of its size. Ranks are
    counted in ``buckets`` parts, so a size that very many items share is no hot spot. Items without tokens are in no container
    (null); repeated rows are items of their own; budgets with a null or non-positive capacity are left out.
    """
    spark = items.sparkSession
    budgets = budgets.select(F.col("budget_id").cast("int").alias("budget_id"), F.col("capacity").cast("bigint").alias("capacity"))
    budgets = budgets.where("budget_id is not null and capacity > 0").groupBy("budget_id").agg(F.max("capacity").alias("capacity"))
    capacities = {r.budget_id: r.capacity for r in budgets.collect()}
    items = cut(items.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.monotonically_increasing_id().alias("item")), "items")
    each_budget = F.explode(F.array(*(F.struct(F.lit(b).alias("budget_id"), F.lit(c).cast("bigint").alias("capacity")) for b, c in sorted(capacities.items()))))
    if not capacities:
        return spark.createDataFrame([], "budget_id int, container bigint, doc_id bigint, part int, first_token bigint, n_tokens bigint")
    cut_up = items.select("*", each_budget.alias("b")).select("doc_id", "item", "tokens", "b.*")
    number = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity")).cast("int"))
    cut_up = cut_up.select("*", F.explode(F.sequence(F.lit(0), number - 1)).alias("part"))
    first = F.col("part") * F.col("capacity")
    pieces = cut_up.select("budget_id", "doc_id", "item", "part", first.alias("first_token"), F.least("capacity", F.col("tokens") - first).alias("size"))
    sized = pieces.where("size > 0")
    histograms: dict[int, dict[int, int]] = defaultdict(dict)
    for r in sized.groupBy("budget_id", "size").count().collect():
        histograms[r.budget_id][r["size"]] = r["count"]
    runs = [(b, *run) for b, h in histograms.items() for run in plan_containers(h, capacities[b])[0]]
    plan = spark.createDataFrame(runs, RUN).groupBy("budget_id", "size").agg(F.collect_list(F.struct("rank_from", "rank_to", "each", "first_container")).alias("runs"))
    ranked = prefix_sums(sized.withColumn("key", F.struct("item", "part")).withColumn("one", F.lit(1)), ["budget_id", "size"], "key", "one", "rank", buckets)
    mine = F.filter("runs", lambda r: (F.col("rank") >= r.rank_from) & (F.col("rank") < r.rank_to))
    placed = ranked.join(F.broadcast(plan), ["budget_id", "size"]).withColumn("run", F.get(mine, F.lit(0))).select("*", "run.*")
    container = F.col("first_container") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("each")).cast("bigint")
    empty = pieces.where("size <= 0").select("budget_id", F.lit(None).cast("bigint").alias("container"), "doc_id", "part", "first_token", F.lit(0).cast("bigint").alias("n_tokens"))
    return placed.select("budget_id", container.alias("container"), "doc_id", "part", "first_token", F.col("size").alias("n_tokens")).unionByName(empty)


def fill_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, capacity, containers, tokens, fewest, fill): ``fewest`` is what no packing can go below, ``fill`` the used share of all space."""
    budgets = budgets.select(F.col("budget_id").cast("int").alias("budget_id"), F.col("capacity").cast("bigint").alias("capacity"))
    used = packed.groupBy("budget_id").agg((F.max("container") + 1).alias("containers"), F.sum("n_tokens").alias("tokens"))
    return budgets.join(used, "budget_id").select(
        "budget_id", "capacity", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"),
        (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"),
    )
