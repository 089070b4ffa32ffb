"""Records that are the same apart from formatting: one record each, with the number of its copies."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.bloom import filter_bits, may_repeat
from quillgraph.operators.skew import hot_codes, is_one_of
from quillgraph.session import cut, partitions

AT_ONCE = 4

WORD = r"[\p{L}\p{N}_-]+"
FIELD = rf"({WORD})\s*=\s*({WORD})"


def bare(x: Column) -> Column:
    """Lower-cased letters and digits, without all else."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")


def canonical_value(x: Column) -> Column:
    """What two spellings of a value share: its letters and digits; of listed ``name=value`` fields the sorted list beside the other text."""
    fields = F.regexp_extract_all(x, F.lit(FIELD), F.lit(0))
    pair = lambda f: F.concat(bare(F.substring_index(f, "=", 1)), F.lit("="), bare(F.substring_index(f, "=", -1)))
    listed = F.concat_ws(";", bare(F.regexp_replace(x, FIELD, "")), F.array_sort(F.transform(fields, pair)))
    return F.when(x.contains("="), F.when(F.size(fields) > 0, listed).otherwise(bare(x))).otherwise(bare(x))


def keyed(rows: DataFrame, tab: str, id_column: str, exact: Sequence[str] = (), loose: Sequence[str] = ()) -> DataFrame:
    """(tab, id, key): ``key`` is the array of compared values. Rows with a null or blank compared value have a null key."""
    filled = reduce(Column.__and__, (F.coalesce(F.col(c).rlike(r"[^\s\p{Z}]"), F.lit(False)) for c in (*exact, *loose)))
    key = F.array(*(F.col(c) for c in exact), *(canonical_value(F.col(c)) for c in loose))
    return rows.select(F.lit(tab).alias("tab"), F.col(id_column).cast("bigint").alias("id"), F.when(filled, key).alias("key"))


def _judged(rows: DataFrame, count: int, per_key: int, most_bits: int) -> DataFrame:
    """(tab, id, key, h, again) of the rows with a key: ``again`` is false for rows whose hash occurs once, and then ``key`` is null.

    The keyed rows are written once, split by hash into as many parts as it takes to keep each part's filter under
    ``most_bits``, without a shuffle. Each part builds its filter from its own rows and tests them against it, a few
    parts at a time; so each row is read twice and no more, whatever the number of parts.
    """
    n = max(1, -(-count * per_key // most_bits))
    bits = filter_bits(-(-count // n), per_key, most_bits)
    rows = rows.where("key is not null").withColumn("h", F.xxhash64("tab", "key"))
    rows = cut(rows.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(n)).cast("int")), "keyed", by="part")

    def judge(i: int) -> DataFrame:
        part = rows.where(F.col("part") == i).drop("part")
        with may_repeat(part.select("h"), bits) as test:
            again = part.withColumn("again", test(F.col("h")))
            return cut(again.withColumn("key", F.when(F.col("again"), F.col("key"))), "judged")

    with ThreadPoolExecutor(min(n, AT_ONCE)) as pool:
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(judge), range(n)))
    return reduce(DataFrame.unionByName, parts)


def _groups(repeats: DataFrame) -> DataFrame:
    return repeats.groupBy("tab", "key").agg(F.min("id").alias("kept_id"), F.count(F.lit(1)).alias("copies"))


def found_copies(rows: DataFrame, count: int, per_key: int = 16, most_bits: int = 1 << 28) -> DataFrame:
    """(tab, kept_id, copy_id): each record of a group but its smallest id, with that id.

    ``rows`` are of :func:`keyed`, ``count`` is their number. Only rows whose hash the merged Bloom filter of repeated
    hashes knows are shuffled and grouped by their exact keys; groups are counted before the shuffle. A group that holds
    a large part of the rows is spread over salts where its members meet its smallest id. Null keys are in no group,
    repeated (tab, id) rows with the same key give repeated copies except of the smallest id, an empty table gives no rows.
    """
    repeats = _judged(rows, count, per_key, most_bits).where("again")
    salts = max(2, partitions(rows.sparkSession))
    hot = is_one_of(F.col("h"), hot_codes(repeats.select("h"), "h", count))
    members = repeats.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).otherwise(0)).drop("h", "again")
    groups = _groups(repeats).where("copies > 1").withColumn("h", F.xxhash64("tab", "key"))
    groups = groups.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    joined = members.join(groups.drop("h"), ["tab", "key", "salt"])
    return joined.where("id > kept_id").select("tab", "kept_id", F.col("id").alias("copy_id"))


def collapsed(rows: DataFrame, count: int, per_key: int = 16, most_bits: int = 1 << 28) -> DataFrame:
    """(tab, kept_id, copies): one row for each record, with the number of rows it stands for. Rows with a null key stand for themselves.

    Rows that the filter tells to be singletons are not shuffled.
    """
    judged = _judged(rows, count, per_key, most_bits)
    single = rows.where("key is null").select("tab", "id").unionByName(judged.where("not again").select("tab", "id"))
    single = single.select("tab", F.col("id").alias("kept_id"), F.lit(1).cast("bigint").alias("copies"))
    return single.unionByName(_groups(judged.where("again")).select("tab", "kept_id", "copies"))
