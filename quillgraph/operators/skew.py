"""Helpers for groups that hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import cut, partitions


def hot_codes(rows: DataFrame, code: str, total: int, share: int = 4) -> list[int]:
    """Values of the bigint column ``code`` that hold more than 1 / (share * partitions) of ``total`` rows.

    Counts are combined before the shuffle, and at most share * partitions values can qualify, so the list is bounded.
    """
    most = share * partitions(rows.sparkSession)
    counts = rows.groupBy(code).count().where(F.col("count") * most > total)
    return [r[0] for r in counts.orderBy(F.desc("count"), code).limit(most).collect() if r[0] is not None]


def is_one_of(x: Column, codes: Sequence[int]) -> Column:
    return x.isin(*codes) if codes else F.lit(False)


def prefix_sums(rows: DataFrame, group: Sequence[str], key: str, value: str, out: str, buckets: int = 64) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come before this one.

    The order inside a group is (hash bucket of ``key``, ``key``); ``key`` must be unique in its group. A group is summed
    in ``buckets`` parts, and only the parts' totals meet, so no task sees a whole hot group.
    """
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(buckets)).cast("int"))
    by = [*group, "_b"]
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*by).agg(F.sum(value).alias("_s")).withColumn("_o", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    )
    inside = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_i", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in by]
    joined = summed.alias("r").join(offsets.alias("o"), same)
    return joined.select("r.*", "o._o").withColumn(out, F.col("_i") + F.col("_o")).drop("_b", "_i", "_o")


def met_within(left: DataFrame, right: DataFrame, by: Sequence[str], per_salt: int = 2000) -> DataFrame:
    """Rows of ``left`` (by, key) and ``right`` (by, other) that are in one group, as (by, key, other).

    Groups of more than ``per_salt`` rows of ``right`` are split: each left row goes to every part of its group, each
    right row to one, so no task sees a whole hot group.
    """
    parts = right.groupBy(*by).agg((1 + F.floor(F.count(F.lit(1)) / per_salt)).cast("int").alias("_parts"))
    parts = cut(parts, "parts")
    asked = left.join(parts, list(by)).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    told = right.join(parts, list(by))
    told = told.withColumn("_part", F.pmod(F.xxhash64(*(c for c in right.columns if c not in by)), F.col("_parts")).cast("int")).drop("_parts")
    return asked.join(told, [*by, "_part"]).drop("_part")


def global_rank(rows: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: the place of each row from 0 in the ascending order of ``order``, without sorting in one task.

    Rows are range-partitioned, written with the number of their partition, and ranked in it; only the partitions'
    sizes meet. Rows with equal keys are ranked in any order.
    """
    spread = rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("_p", F.spark_partition_id())
    spread = cut(spread, "ranges")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return spread.withColumn("_r", place).join(F.broadcast(offsets), "_p").withColumn(out, F.col("_o") + F.col("_r")).drop("_p", "_r", "_o")
