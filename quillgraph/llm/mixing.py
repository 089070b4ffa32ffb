"""Mixing sources to target shares of all tokens, by proportionate-progress scheduling of blocks."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.ids import canonical_id
from quillgraph.operators.skew import prefix_sums
from quillgraph.session import cut


def canonical_source(x: Column) -> Column:
    """Case, blanks and separators do not tell sources apart."""
    return canonical_id(x)


def one_of_each_text(docs: DataFrame, text: str) -> DataFrame:
    """The row with the smallest doc_id of each text, white space aside; copies meet as 128-bit hashes, combined before the shuffle."""
    plain = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(F.xxhash64(plain).alias("k1"), F.xxhash64(F.lit(1), plain).alias("k2"), F.struct("doc_id", *(c for c in kept if c != "doc_id")).alias("row"))
    return rows.groupBy("k1", "k2").agg(F.min("row").alias("row")).select("row.*")


def whole_weights(shares: dict[str, float], resolution: int = 1_000_000) -> dict[str, int]:
    """Shares as small whole numbers in the same proportion; ones finer than 1 / ``resolution`` of the total are rounded to that, but never to 0."""
    exact = {s: Fraction(str(x)) for s, x in shares.items()}
    total = sum(exact.values())
    scaled = {s: x / total for s, x in exact.items()}
    common = math.lcm(1, *(x.denominator for x in scaled.values()))
    if common > resolution:
        return {s: max(1, round(x * resolution)) for s, x in scaled.items()}
    return {s: int(x * common) for s, x in scaled.items()}


def schedule(weights: dict[str, int]) -> list[str]:
    """Whose block fills each slot of a period of as many slots as all weights: earliest deadline first among released blocks.

    Block k of a source of weight w in a period P is released at slot floor(k * P / w) and due before slot
    ceil((k + 1) * P / w). Then each block is in time, and after any number of slots each source has less than one block more or less
    than its share. The period ends with every source at its share exactly, so the schedule repeats.
    """
    period = sum(weights.values())
    waiting = sorted((k * period // w, -(-(k + 1) * period // w), s) for s, w in weights.items() for k in range(w))
    ready: list[tuple[int, str]] = []
    out, at = [], 0
    for now in range(period):
        while at < len(waiting) and waiting[at][0] <= now:
            heapq.heappush(ready, waiting[at][1:])
            at += 1
        out.append(heapq.heappop(ready)[1])
    return out


def mix(docs: DataFrame, weights: DataFrame, block_tokens: int = 4096, resolution: int = 1_000_000, buckets: int = 256) -> tuple[DataFrame, DataFrame]:
    """(mixed, shares) of ``docs`` (doc_id, source, tokens), each text once, and ``weights`` (source, target_share, max_repeats).

    The mix is as large as the shares allow: the source that is used up first, at its ``max_repeats``, sets the total.
    Each source's documents follow one another in the order of a hash, over and over up to its quota, and this stream is
    cut into blocks of ``block_tokens``, inside documents where need be. The blocks are interleaved by a schedule of one period, whose
    length depends on the weights alone (at most about ``resolution`` slots); the place of a block follows from its number, so nothing is planned
    block by block, and after any number of whole blocks each source is less than one block away from its share.

    ``mixed`` has a row for each piece of a use of a document: its ``repeat``, where in the document it begins (``from_token``), its
    tokens, the ``slot`` of its block and the place of its first token in the mix. Only the document at a source's quota is not used up.
    ``shares`` has a row for each listed source: its target, its target among the sources that occur, what it has, its quota,
    what it got and its actual share.

    Sources that are not listed, null, or listed with a null or non-positive share or repeat have no target and are not
    drawn; listed ones that do not occur get nothing, and the others keep their proportions. Documents without tokens
    are not drawn. Sources listed twice have their shares added.
    """
    spark = docs.sparkSession
    listed = weights.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and source != ''")
    listed = listed.groupBy("source").agg(F.sum(F.when(F.col("target_share") > 0, F.col("target_share"))).alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = F.broadcast(listed.where("target_share > 0 and max_repeats > 0"))
    rows = docs.select("doc_id", canonical_source(F.col("source")).alias("source"), "tokens").where("tokens > 0").join(wanted.select("source"), "source", "left_semi")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "mixable")
    has = {r.source: r.tokens for r in rows.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    asked = {r.source: r for r in listed.collect()}
    shares_of = {s: asked[s].target_share for s in has}
    weight = whole_weights({s: round(x, 12) for s, x in shares_of.items()}, resolution)
    period = sum(weight.values())
    total = min((asked[s].max_repeats * has[s] * period // weight[s] for s in has), default=0)
    quota = {s: weight[s] * total // period for s in has}
    turn = schedule(weight)
    slots: dict[str, list[int]] = {s: [] for s in has}
    for at, s in enumerate(turn):
        slots[s].append(at)
    slot_of = lambda s, k: k // weight[s] * period + slots[s][k % weight[s]]
    blocks = {s: -(-quota[s] // block_tokens) for s in has if quota[s]}
    # Only each source's last block can be short, and only behind the last full slot can slots stay empty.
    short = sorted((slot_of(s, n - 1), s) for s, n in blocks.items())
    full = total // block_tokens
    used, gaps, seen = {}, [], full
    for at in range(full, short[-1][0] + 1 if short else full):
        s = turn[at % period]
        used[at] = seen
        k = at // period * weight[s] + bisect_left(slots[s], at % period)
        seen += s in blocks and k < blocks[s]
    missing = 0
    last_first = {}
    for at, s in short:
        last_first[s] = used.get(at, at) * block_tokens - missing
        gaps.append((at, blocks[s] * block_tokens - quota[s]))
        missing += gaps[-1][1]
    plan = [(s, int(quota[s]), int(has[s]), int(asked[s].max_repeats), weight[s], blocks[s] - 1, last_first[s]) for s in blocks] or [("", 0, 1, 0, 1, 0, 0)]
    plan = F.broadcast(spark.createDataFrame(plan, "source string, quota bigint, has bigint, most int, weight bigint, last bigint, last_first bigint"))
    pattern = spark.createDataFrame([(s, k, at) for s in slots for k, at in enumerate(slots[s])] or [("", 0, 0)], "source string, k bigint, at bigint")
    shuffled = rows.withColumn("key", F.struct(F.xxhash64("doc_id", "row").alias("h"), F.col("row").alias("row")))
    streams = prefix_sums(shuffled, ["source"], "key", "tokens", "before", buckets).join(plan, "source")
    rounds = F.least(F.col("most"), F.ceil(F.col("quota") / F.col("has")).cast("int"))
    uses = streams.select("source", "doc_id", "tokens", *plan.columns[1:], "before", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), rounds))).alias("repeat"))
    uses = uses.withColumn("start", (F.col("repeat") - 1) * F.col("has") + F.col("before")).where("start < quota")
    uses = uses.withColumn("end", F.least(F.col("start") + F.col("tokens"), F.col("quota")))
    inside = F.sequence(F.expr(f"start div {block_tokens}"), F.expr(f"(end - 1) div {block_tokens}"))
    pieces = uses.withColumn("block", F.explode(inside))
    lo, hi = F.greatest("start", F.col("block") * block_tokens), F.least("end", (F.col("block") + 1) * block_tokens)
    pieces = pieces.withColumn("lo", lo).withColumn("hi", hi).withColumn("k", F.col("block") % F.col("weight")).join(F.broadcast(pattern), ["source", "k"])
    pieces = pieces.withColumn("slot", F.expr(f"block div weight * {period} + at"))
    lack = reduce(Column.__add__, (F.when(F.col("slot") > at, n).otherwise(0) for at, n in gaps if n), F.lit(0)).cast("bigint")
    first = F.when(F.col("block") == F.col("last"), F.col("last_first")).otherwise(F.col("slot") * block_tokens - lack)
    mixed = pieces.select(
        "source", "doc_id", "repeat", (F.col("lo") - F.col("start")).alias("from_token"), (F.col("hi") - F.col("lo")).alias("tokens"), "slot",
        (first + F.col("lo") - F.col("block") * block_tokens).alias("first_token"),
    )
    got = {r.source: (r.tokens, r.uses, r.repeats) for r in uses.groupBy("source").agg(F.sum(F.col("end") - F.col("start")).alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("repeat").alias("repeats")).collect()}
    drawn, whole = sum(t for t, _, _ in got.values()) or 1, sum(shares_of.values())
    report = []
    for s, r in sorted(asked.items()):
        tokens, times, repeats = got.get(s, (0, 0, 0))
        report.append((s, r.target_share, shares_of[s] / whole if s in has else 0.0, int(has.get(s, 0)), int(quota.get(s, 0)), int(tokens), int(times), int(repeats), tokens / drawn))
    shares = spark.createDataFrame(report, "source string, target_share double, share_among_present double, has_tokens bigint, quota bigint, tokens bigint, uses bigint, repeats int, actual_share double")
    return mixed, shares
