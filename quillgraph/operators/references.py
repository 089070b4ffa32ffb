"""References to records that do not exist at the time of the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.ids import canonical_id, filled, micros
from quillgraph.operators.skew import hot_codes, is_one_of
from quillgraph.session import cut, cut_counted, partitions

FIRST, LAST = -(2**63), 2**63 - 1


def existence_runs(nodes: DataFrame, externals: DataFrame, removals: DataFrame) -> DataFrame:
    """(ref_id, run_start, run_end): for each parent id the microseconds at which it exists, as runs [start, end).

    The sorted integer keys at which a parent can be referred to are compressed into their contiguous runs. A node starts
    at its earliest ``indexed_at`` (never, if null) and has a gap for each removal; overlapping, touching and repeated
    removals are one gap, and a removal without ``removed_at`` or one that ends before it starts is none. Externals
    always exist.
    """
    born = (
        nodes.select(canonical_id(F.col("node_id")).alias("ref_id"), micros(F.col("indexed_at")).alias("born"))
        .where("ref_id is not null and born is not null")
        .groupBy("ref_id")
        .agg(F.min("born").alias("born"))
    )
    gone = (
        removals.select(
            canonical_id(F.col("node_id")).alias("ref_id"),
            micros(F.col("removed_at")).alias("s"),
            F.coalesce(micros(F.col("restored_at")), F.lit(LAST)).alias("e"),
        )
        .where("ref_id is not null and s < e")
        .distinct()
    )
    by_start = Window.partitionBy("ref_id").orderBy("s", "e")
    reach = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        gone.withColumn("new", F.when(reach >= F.col("s"), 0).otherwise(1))
        .withColumn("island", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("ref_id", "island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .select("ref_id", "s", "e")
    )
    edges_of_gaps = islands.unionByName(islands.select("ref_id", F.lit(FIRST).alias("s"), F.lit(FIRST).alias("e")).distinct())
    next_gap = F.lead("s").over(Window.partitionBy("ref_id").orderBy("s"))
    present = edges_of_gaps.select("ref_id", F.col("e").alias("from"), F.coalesce(next_gap, F.lit(LAST)).alias("to"))
    node_runs = (
        born.join(present, "ref_id", "left")
        .select(
            "ref_id",
            F.greatest("born", F.coalesce("from", F.lit(FIRST))).alias("run_start"),
            F.coalesce("to", F.lit(LAST)).alias("run_end"),
        )
        .where("run_start < run_end")
    )
    always = externals.select(
        canonical_id(F.col("ext_id")).alias("ref_id"), F.lit(FIRST).alias("run_start"), F.lit(LAST).alias("run_end")
    ).where("ref_id is not null")
    return node_runs.unionByName(always.distinct())


def edge_references(edges: DataFrame) -> DataFrame:
    """(edge_id, side, ref_id, at, relation, month): one row for each endpoint that is neither null nor blank."""
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("raw")) for s in ("source", "target"))))
    rows = edges.select("edge_id", "extracted_at", "relation", sides.alias("x")).where(filled(F.col("x.raw")))
    return rows.select(
        "edge_id",
        F.col("x.side").alias("side"),
        canonical_id(F.col("x.raw")).alias("ref_id"),
        F.coalesce(micros(F.col("extracted_at")), F.lit(LAST - 1)).alias("at"),
        canonical_id(F.col("relation")).alias("relation"),
        F.date_format("extracted_at", "yyyy-MM").alias("month"),
    )


def orphan_references(refs: DataFrame, runs: DataFrame, total: int) -> DataFrame:
    """The rows of ``refs`` whose ``ref_id`` does not exist at ``at``.

    Each reference is matched as-of to the preceding run starts of its id: it is an orphan if the furthest end of those
    runs does not lie beyond it. References without a time are judged after all runs have started. An id that holds a
    large part of the ``total`` references is spread over salts, and its few runs are repeated for each salt; the counts
    that tell such ids are combined before their shuffle.
    """
    hot = hot_codes(refs.select(F.xxhash64("ref_id").alias("code")), "code", total)
    salts = max(2, partitions(refs.sparkSession))
    is_hot = is_one_of(F.xxhash64("ref_id"), hot)
    payload = [c for c in refs.columns if c not in ("ref_id", "at")]
    asked = refs.select(
        "ref_id",
        F.when(is_hot, F.pmod(F.xxhash64("edge_id", "side"), F.lit(salts)).cast("int")).otherwise(0).alias("salt"),
        "at",
        F.lit(1).alias("asks"),
        F.lit(None).cast("bigint").alias("run_end"),
        *payload,
    )
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    known = runs.select(
        "ref_id",
        F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))).alias("salt"),
        F.col("run_start").alias("at"),
        F.lit(0).alias("asks"),
        "run_end",
    )
    as_of = Window.partitionBy("ref_id", "salt").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    matched = known.unionByName(asked, allowMissingColumns=True).withColumn("reach", F.max("run_end").over(as_of))
    return matched.where("asks = 1 and coalesce(reach <= at, true)").select("ref_id", "at", *payload)


def _ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` written in ranges of ``order``, with the number of their range as ``_p``."""
    spread = rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("_p", F.spark_partition_id())
    return cut(spread, "ranges")


def key_runs(keys: DataFrame) -> DataFrame:
    """(run_start, run_end): the distinct non-null integers of ``keys`` (key) as runs of consecutive ones, both ends included.

    Keys are sorted in ranges; where two ranges meet a run may be told in two parts.
    """
    spread = _ranges(keys.select(F.col("key").cast("bigint").alias("key")).where("key is not null").distinct(), ["key"])
    island = F.col("key") - F.row_number().over(Window.partitionBy("_p").orderBy("key"))
    return spread.withColumn("island", island).groupBy("_p", "island").agg(F.min("key").alias("run_start"), F.max("key").alias("run_end")).drop("_p", "island")


def beyond_runs(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of ``refs`` (key, ...) whose non-null key lies in none of ``runs`` (run_start, run_end).

    Each key is matched as-of to the run that starts last at or before it, and is reported if it lies beyond that run's
    end or before all runs. Runs and keys are sorted together in ranges; of each range only its last run is told to the next ones.
    """
    payload = [c for c in refs.columns if c != "key"]
    starts = runs.select(F.col("run_start").alias("key"), F.lit(0).alias("asks"), F.col("run_end"))
    asked = refs.where("key is not null").select(F.col("key").cast("bigint").alias("key"), F.lit(1).alias("asks"), F.lit(None).cast("bigint").alias("run_end"), *payload)
    spread = _ranges(starts.unionByName(asked, allowMissingColumns=True), ["key"])
    ends = spread.groupBy("_p").agg(F.max("run_end").alias("end"))
    told = ends.select("_p", F.max("end").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    as_of = Window.partitionBy("_p").orderBy("key", "asks").rowsBetween(Window.unboundedPreceding, 0)
    matched = spread.withColumn("end", F.max("run_end").over(as_of)).join(F.broadcast(told), "_p")
    return matched.where("asks = 1 and coalesce(key > greatest(end, earlier), true)").select("key", *payload)


def numbered(ids: DataFrame) -> DataFrame:
    """``ids`` (ref_id, ...), one row for each ref_id, with ``key``: a number for each, in the order of the ids and consecutive within each sorted range."""
    spread = _ranges(ids, ["ref_id"])
    place = F.row_number().over(Window.partitionBy("_p").orderBy("ref_id"))
    return cut(spread.withColumn("key", (F.col("_p").cast("bigint") * (1 << 40)) + place).drop("_p"), "numbered")


def orphans_of(refs: DataFrame, runs: DataFrame, total: int, most_broadcast: int = 200_000) -> DataFrame:
    """The rows of ``refs`` (edge_id, side, ref_id, at, ...) whose ``ref_id`` does not exist at ``at``.

    ``runs`` is of :func:`existence_runs`. References are first reduced to their distinct ids, each with its first and
    last time. These and the parents' ids get numbers in sorted order; the parents' numbers are compressed into runs, and
    ids whose number lies beyond the end of the run that starts before it never existed. Of the others those that exist from their
    first to their last reference need no more. Only the rows of the ids that remain are looked at one by one: up to
    ``most_broadcast`` such ids are broadcast to the rows, more are joined, with hot ids over salts.
    """
    asked = refs.groupBy("ref_id").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    parents = runs.select("ref_id").distinct()
    both = asked.withColumn("parent", F.lit(False)).unionByName(parents.withColumn("parent", F.lit(True)), allowMissingColumns=True)
    coded = numbered(both.groupBy("ref_id").agg(F.max("first").alias("first"), F.max("last").alias("last"), F.max("parent").alias("parent")))
    never = beyond_runs(coded.where("first is not null").select("key", "ref_id"), key_runs(coded.where("parent").select("key")))
    known = coded.where("parent and first is not null").select("ref_id", "first", "last")
    steady = known.join(runs, "ref_id").where("run_start <= first and run_end > last").select("ref_id")
    doubtful = known.select("ref_id").join(steady, "ref_id", "left_anti")
    suspects = never.select("ref_id", F.lit(True).alias("never")).unionByName(doubtful.select("ref_id", F.lit(False).alias("never")))
    suspects, n = cut_counted(suspects, "suspects")
    if n <= most_broadcast:
        rows = refs.join(F.broadcast(suspects), "ref_id")
    else:
        salts = max(2, partitions(refs.sparkSession))
        hot = is_one_of(F.xxhash64("ref_id"), hot_codes(refs.select(F.xxhash64("ref_id").alias("code")), "code", total))
        salted = refs.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("edge_id", "side"), F.lit(salts)).cast("int")).otherwise(0))
        rows = salted.join(suspects.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))), ["ref_id", "salt"]).drop("salt")
    rows = cut(rows, "suspected")
    unsure = suspects.where("not never").select("ref_id")
    late = orphan_references(rows.where("not never").drop("never"), runs.join(unsure, "ref_id", "left_semi"), total)
    return rows.where("never").drop("never").unionByName(late)


def orphan_report(orphans: DataFrame, refs: DataFrame, table: str = "edges") -> DataFrame:
    """(referring_table, side, relation, month, orphans, refs, share): distinct references by table, side, relation and month.

    ``month`` is null for references without a time. Edges delivered twice count once.
    """
    keys = ["side", "relation", "month"]
    count = lambda df, name: df.select(*keys, "edge_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    o, r = count(orphans, "orphans").alias("o"), count(refs, "refs").alias("r")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return o.join(r, same).select(
        F.lit(table).alias("referring_table"), *(f"o.{k}" for k in keys), "orphans", "refs", (F.col("orphans") / F.col("refs")).alias("share")
    )


def missing_endpoints(edges: DataFrame, nodes: DataFrame, externals: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orphans, refs) of an edge table. Any table may be empty; other columns of the tables are not read."""
    refs, total = cut_counted(edge_references(edges), "references")
    runs = cut(existence_runs(nodes, externals, removals), "runs")
    return orphans_of(refs, runs, total), refs
