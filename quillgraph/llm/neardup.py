"""Near-duplicate texts by an exact similarity join with adaptive multi-match prefixes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.bloom import FAN_IN
from quillgraph.operators.walks import components
from quillgraph.session import cut

CHUNK = 1 << 18
COUNTS = "part int, chunk int, counts binary"


def words(x: Column) -> Column:
    """The runs of a-z and 0-9 of the lower-cased text, with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def word_count(x: Column) -> Column:
    return F.when(x == "", 0).otherwise(F.size(F.split(x, " ")))


def shingles(w: Column, k: int) -> Column:
    """Distinct 64-bit hashes of the sequences of ``k`` words. ``w`` must be a column of a projection of its own: a lambda evaluates an expression for each element."""
    gram = lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k)))
    return F.when(F.size(w) >= k, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - k), gram))).otherwise(F.array().cast("array<bigint>"))


def _flat(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(s) for s in batch.s), np.int64, len(batch))
    return (np.concatenate(batch.s.to_numpy()).astype(np.int64) if len(batch) else np.zeros(0, np.int64)), sizes


def count_sketch(sets: DataFrame, buckets: int) -> np.ndarray:
    """How many sets have a shingle in each of ``buckets`` hash buckets, up to 65,535; over all sets, merged in a tree."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = np.zeros(buckets, np.uint32)
        for batch in batches:
            total += np.bincount(_flat(batch)[0] & (buckets - 1), minlength=buckets).astype(np.uint32)
        step = min(CHUNK, buckets)
        for k in range(buckets // step):
            part = np.minimum(total[k * step : (k + 1) * step], 65535).astype(np.uint16)
            if part.any():
                yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "chunk": [k], "counts": [zlib.compress(part.tobytes(), 1)]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(min(CHUNK, buckets), np.uint32)
        for c in group.counts:
            total += np.frombuffer(zlib.decompress(c), np.uint16)
        total = np.minimum(total, 65535).astype(np.uint16)
        return pd.DataFrame({"part": [group.part.iloc[0] // FAN_IN], "chunk": [group.chunk.iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    parts = sets.rdd.getNumPartitions()
    state = sets.select("s").mapInPandas(partial, COUNTS)
    while parts > 1:
        state = state.groupBy(F.col("chunk"), F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, COUNTS)
        parts = -(-parts // FAN_IN)
    out = np.zeros(buckets, np.uint16)
    for row in state.toLocalIterator():
        got = np.frombuffer(zlib.decompress(bytes(row.counts)), np.uint16)
        out[row.chunk * len(got) : (row.chunk + 1) * len(got)] = got
    return out


def _prefixes(sent, threshold: float, most_matches: int, verify_cost: float, per_salt: int):
    """Postings of each set's prefix: rare shingles first, as long as the estimated cost of its candidates asks for."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.frombuffer(zlib.decompress(sent.value), np.uint16)
        for batch in batches:
            batch = batch[batch.s.map(len) > 0]
            if not len(batch):
                continue
            h, n = _flat(batch)
            doc = np.repeat(np.arange(len(n)), n)
            count = sketch[h & (len(sketch) - 1)].astype(np.int64)
            order = np.lexsort((h, count, doc))
            h, count = h[order], count[order]
            start = np.concatenate(([0], np.cumsum(n)[:-1]))
            running = np.concatenate(([0], np.cumsum(count)))
            probe_base = n - np.ceil(threshold * n - 1e-9).astype(np.int64)
            best_cost, best = np.full(len(n), np.inf), np.ones(len(n), np.int64)
            for matches in range(1, most_matches + 1):
                entries = (running[start + np.minimum(probe_base + matches, n)] - running[start]).astype(float)
                cost = entries + verify_cost * entries / matches
                better = (cost < best_cost) & (matches <= n - probe_base)
                best_cost, best = np.where(better, cost, best_cost), np.where(better, matches, best)
            index_len = np.minimum(n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64) + best, n)
            probe_len = np.minimum(probe_base + best, n)
            take = np.arange(len(h)) - np.repeat(start, n)
            keep = (take < np.repeat(probe_len, n)) & (count > 1)
            d = doc[keep]
            yield pd.DataFrame(
                {
                    "token": h[keep],
                    "id": batch.id.to_numpy()[d],
                    "n": n[d].astype(np.int32),
                    "pos": take[keep].astype(np.int32),
                    "matches": best[d].astype(np.int32),
                    "indexed": take[keep] < index_len[d],
                    "salts": (1 + count[keep] // per_salt).astype(np.int32),
                }
            )

    return build


def similar_pairs(
    sets: DataFrame, count: int, threshold: float = 0.8, most_matches: int = 6, verify_cost: float = 4.0, per_salt: int = 2000, most_buckets: int = 1 << 24
) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of rows of ``sets`` (id, s) whose sets have a Jaccard similarity of at least ``threshold``.

    Tokens are ordered by how many sets hold their bucket of a count sketch over all sets (at most 2 * ``most_buckets``
    bytes are broadcast; the order decides the cost only). If two sets share enough tokens, the first ``m`` shared ones lie in the
    first size - least overlap + m tokens of both, so each set takes the ``m`` with the least estimated cost, up to
    ``most_matches``, and a pair needs the smaller ``m`` of its two to be verified. The smaller set looks up with the
    shorter prefix that a partner of at least its size allows. Tokens of many sets are salted by their sketched count.
    The result is exact. Empty sets match nothing; ids must be unique.
    """
    spark = sets.sparkSession
    buckets = 1 << 16
    while buckets < min(8 * count, most_buckets):
        buckets <<= 1
    sent = spark.sparkContext.broadcast(zlib.compress(count_sketch(sets, buckets).tobytes(), 1))
    postings = sets.select("id", "s").mapInPandas(
        _prefixes(sent, threshold, most_matches, verify_cost, per_salt),
        "token bigint, id bigint, n int, pos int, matches int, indexed boolean, salts int",
    )
    postings = cut(postings, "postings")
    probe = postings.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts", "indexed").alias("q")
    index = postings.where("indexed").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts", "indexed").alias("x")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("x.n") + F.col("q.n")) - 1e-9)
    reach = F.least(F.col("x.n") - F.col("x.pos"), F.col("q.n") - F.col("q.pos"))
    smaller = (F.col("x.n") < F.col("q.n")) | ((F.col("x.n") == F.col("q.n")) & (F.col("x.id") < F.col("q.id")))
    met = index.join(
        probe,
        (F.col("x.token") == F.col("q.token")) & (F.col("x.salt") == F.col("q.salt")) & smaller & (F.col("x.n") >= threshold * F.col("q.n") - 1e-9)
        & (reach + F.least(F.col("x.matches"), F.col("q.matches")) > need),
    )
    met = met.select(F.least("x.id", "q.id").alias("a"), F.greatest("x.id", "q.id").alias("b"), F.least("x.matches", "q.matches").alias("m"))
    candidates = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min("m").alias("m")).where("c >= m").select("a", "b")
    one, two = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    checked = candidates.join(one, "a").join(two, "b").select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("similarity"))
    return checked.where(F.col("similarity") >= threshold)


def text_classes(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(members, sets): rows (id, words) with the smallest id of the same word sequence as ``class_id``, and that row's shingle set (id, s).

    Words are worked out once and written; copies then meet as hashes, without their texts.
    """
    key = [F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words").alias("k2"), F.length("words").alias("k3")]
    rows = cut(rows.select("id", "words"), "words").where("id is not null and words is not null")
    keys = cut(rows.select("id", *key), "keys")
    groups = cut(keys.groupBy("k1", "k2", "k3").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("size")), "classes")
    several = groups.where("size > 1").select("k1", "k2", "k3", "class_id")
    copies = keys.join(several, ["k1", "k2", "k3"]).select("id", "class_id").distinct()
    members = cut(groups.where("size = 1").select(F.col("class_id").alias("id"), "class_id").unionByName(copies), "members")
    repeated = members.where("id != class_id").select("id")
    again = cut(keys.groupBy("id").count().where("count > 1").select("id"), "again")
    firsts = rows.join(repeated, "id", "left_anti")
    firsts = firsts.join(again, "id", "left_anti").unionByName(firsts.join(again, "id", "left_semi").dropDuplicates(["id"])).select("id", F.split("words", " ").alias("w"))
    return members, firsts.select("id", shingles(F.col("w"), k).alias("s"))


def near_duplicates(rows: DataFrame, k: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of ``rows`` (id, words): members (id, class_id) and the similar pairs (a, b, similarity) of class ids.

    Rows of the same word sequence form one class and are compared once. Rows with fewer than ``k`` words are only
    members of their class. Null ids or words are left out; rows repeated in full count once, an id has one text.
    """
    members, sets = text_classes(rows, k)
    return members, cut(similar_pairs(sets, members.count(), threshold), "pairs")


def all_pairs(members: DataFrame, pairs: DataFrame, per_salt: int = 2000) -> DataFrame:
    """(a, b), a < b: the pairs of rows behind the pairs of classes, and those inside a class.

    A class of more than ``per_salt`` members is spread over salts on one side and repeated for each of them on the other.
    """
    salts = members.groupBy("class_id").agg((1 + F.floor(F.count(F.lit(1)) / per_salt)).cast("int").alias("salts"))
    salts = cut(salts, "salts")
    spread = members.join(salts, "class_id").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")

    def expanded(rows: DataFrame, side: str, to: str) -> DataFrame:
        asked = rows.join(salts.withColumnRenamed("class_id", side), side).select(*rows.columns, every)
        return asked.join(spread.select(F.col("class_id").alias(side), F.col("id").alias(to), "salt"), [side, "salt"]).drop(side, "salt")

    across = expanded(expanded(pairs.select("a", "b"), "a", "i"), "b", "j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    several = members.join(cut(members.groupBy("class_id").count().where("count > 1").select("class_id"), "several"), "class_id")
    inside = expanded(several.select("class_id", F.col("id").alias("i")), "class_id", "j").where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"))
    return across.unionByName(inside)


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class_id, group_id, copies, links): a row for each document.

    ``copies`` is the size of its class, ``links`` the number of similar classes, ``group_id`` the least class that
    chains of similar classes lead to.
    """
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    linked = components(ends.select(F.col("class_id").alias("id")), pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rows = members.join(sizes, "class_id").join(ends, "class_id", "left").join(linked.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    return rows.select("id", "class_id", F.coalesce("component", "class_id").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
