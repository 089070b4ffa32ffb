"""Entities under several ids: exact and fuzzy label matches, guards against false merges, survivors, remapped edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import similarity as S
from quillgraph.functions import text as T
from quillgraph.operators.build import Graph, remap
from quillgraph.operators.walks import components
from quillgraph.operators.skew import met_within
from quillgraph.session import cut

BANDS, ROWS = 14, 9
ENTROPY, SCORE, BOOST = 2.5, 92.0, 5.0

# Words that may differ between two labels of one thing.
SMALL_WORDS = "a an the and or of for to in on at by with from as is are be this that its".split()


def entity_keys(nodes: DataFrame) -> DataFrame:
    """(id, key, ...) of nodes that may be merged by label: everything but code, with a label key that is not empty."""
    rows = nodes.withColumn("key", T.label_key(F.col("label")))
    return rows.where("key != '' and file_type != 'code'")


def signature(grams: Column, seed_count: int = BANDS * ROWS) -> Column:
    """MinHash of a column of three-character runs: for each seed the least hash."""
    return F.array(*(F.array_min(F.transform(grams, lambda g: F.xxhash64(g, F.lit(s)))) for s in range(seed_count)))  # noqa: B023


def candidate_pairs(keys: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b), a < b: distinct keys with the same numbers that share the hash of a band of their MinHash, each pair once.

    Keys that agree in the ``rows`` minima of a band are nearly all true matches, so what a bucket gives is close to
    what it must give; equal keys never meet here.
    """
    runs = keys.select("key").distinct().withColumn("grams", T.windows(F.col("key"), 3)).withColumn("sig", signature(F.col("grams"), bands * rows))
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.xxhash64(F.slice("sig", b * rows + 1, rows), numbers(F.col("key"))).alias("h")) for b in range(bands))))
    banded = cut(runs.select("key", each.alias("x")).select("key", "x.band", "x.h"), "bands")
    several = banded.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "h")
    inside = cut(banded.join(several, ["band", "h"]), "bands")
    pairs = met_within(inside.select("band", "h", F.col("key").alias("a")), inside.select("band", "h", F.col("key").alias("b")), ["band", "h"])
    return pairs.where("a < b").select("a", "b").distinct()


def numbers(key: Column) -> Column:
    """The sorted numbers in a key, without leading zeros."""
    return F.array_sort(F.transform(F.regexp_extract_all(key, F.lit(r"[0-9]+"), F.lit(0)), lambda t: F.regexp_replace(t, r"^0+(?=[0-9])", "")))


def variant_pair(a: Column, b: Column) -> Column:
    """Short keys that differ only in a number or letters at their end, such as versions."""
    pattern = r"^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$"
    stem, tail = (lambda x, i=i: F.regexp_extract(x, pattern, i) for i in (1, 2))
    return (a != b) & (F.greatest(F.length(a), F.length(b)) < 12) & (stem(a) != "") & (stem(a) == stem(b)) & (tail(a) != tail(b))


def swapped_word(a: Column, b: Column) -> Column:
    """As many words in both, and at some place two different ones that are neither small words nor spellings of one word."""
    small = F.array(*(F.lit(w) for w in SMALL_WORDS))
    near = lambda x, y: F.levenshtein(x, y) <= F.when(F.least(F.length(x), F.length(y)) >= 6, 2).otherwise(1)
    differs = lambda p: (p["x"] != p["y"]) & ~F.array_contains(small, p["x"]) & ~F.array_contains(small, p["y"]) & ~near(p["x"], p["y"])
    words_a, words_b = F.split(a, " "), F.split(b, " ")
    zipped = F.arrays_zip(words_a.alias("x"), words_b.alias("y"))
    return (F.size(words_a) == F.size(words_b)) & F.exists(zipped, differs)


def similar_labels(nodes: DataFrame, communities: DataFrame | None = None, score: float = SCORE) -> DataFrame:
    """(a, b, score), a < b: ids of entities in the same way of writing, or with labels so similar that they are one.

    Equal keys merge inside a file, and across files if their entropy is at least 2.5. Other pairs come from MinHash bands, score by
    Jaro-Winkler (Jaro from twelve characters on), get 5 more inside one community, and must pass the guards: no
    variants, the same numbers, no swapped word, none the beginning of the other, and short labels only with one edit.
    """
    rows = cut(entity_keys(nodes).select("id", "key", F.coalesce("source_file", F.lit("")).alias("file"), "file_type", T.entropy(F.col("key")).alias("bits")), "entities")
    by_file = rows.groupBy("key", "file").agg(F.min("id").alias("first"))
    same_file = rows.join(by_file, ["key", "file"]).where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    by_key = rows.where(F.col("bits") >= ENTROPY).where(~F.col("file_type").isin("rationale", "document")).groupBy("key").agg(F.min("id").alias("first"))
    same_key = rows.where(F.col("bits") >= ENTROPY).where(~F.col("file_type").isin("rationale", "document")).join(by_key, "key").where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    exact = same_file.unionByName(same_key).distinct().withColumn("score", F.lit(100.0))
    fuzzy_rows = rows.where(F.col("bits") >= ENTROPY)
    first = fuzzy_rows.groupBy("key").agg(F.min_by(F.struct("id", "file", "file_type"), "id").alias("x")).select("key", "x.*")
    if communities is not None:
        first = first.join(communities.select("id", "community"), "id", "left")
    else:
        first = first.withColumn("community", F.lit(None).cast("string"))
    side = lambda s: first.select(F.col("key").alias(s), F.col("id").alias(f"id_{s}"), F.col("file").alias(f"file_{s}"), F.col("file_type").alias(f"type_{s}"), F.col("community").alias(f"c_{s}"))
    pairs = candidate_pairs(first).join(side("a"), "a").join(side("b"), "b")
    a, b = F.col("a"), F.col("b")
    pairs = pairs.where((numbers(a) == numbers(b)) & ~variant_pair(a, b) & ~a.startswith(b) & ~b.startswith(a) & ~swapped_word(a, b))
    anchored = F.col("type_a").isin("rationale", "document") | F.col("type_b").isin("rationale", "document")
    pairs = pairs.where(~(anchored & (F.col("file_a") != F.col("file_b"))))
    longest = F.greatest(F.length("a"), F.length("b"))
    plain = (F.col("file_a") != F.col("file_b")) & (longest >= 12)
    base = F.when(plain, S.jaro(a, b)).otherwise(S.jaro_winkler(a, b)) * 100
    pairs = pairs.withColumn("base", base).withColumn("edits", S.damerau_levenshtein(a, b))
    short_ok = (longest >= 12) | ((F.col("base") >= 97) & (F.length("a") == F.length("b")) & (F.col("edits") <= 1))
    boost = F.when((F.col("c_a") == F.col("c_b")) & (longest >= 12), BOOST).otherwise(0.0)
    pairs = pairs.where(short_ok & (F.col("base") + boost >= score))
    fuzzy = pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), (F.col("base") + boost).alias("score"))
    return exact.unionByName(fuzzy)


def winners(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, winner): for each id in a group of merged ones the id that stays.

    Groups are connected components. No chunk ending, a file, a location, more filled columns, the shortest and then the least id win.
    """
    members = components(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    filled = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in nodes.columns if c != "id"), F.lit(0))
    has_file = F.coalesce("source_file", F.lit("")) != ""
    rank = F.struct(
        F.col("id").rlike(r"_c\d+$").alias("a"), (~has_file).alias("b"), (~has_file | F.col("source_location").isNull()).alias("c"), (-filled).alias("d"), F.length("id").alias("e"), F.col("id").alias("f")
    )
    ranked = members.join(nodes.select("id", rank.alias("rank")), "id")
    best = ranked.groupBy("component").agg(F.min_by("id", "rank").alias("winner"))
    return members.join(best, "component").select("id", "winner")


def merged(graph: Graph, communities: DataFrame | None = None) -> Graph:
    """The graph with duplicate entities merged: losers go, their edges lead to the winner, loops that this makes go."""
    pairs = cut(similar_labels(graph.nodes, communities), "similar")
    mapping = cut(winners(graph.nodes, pairs).where("id != winner"), "winners")
    nodes = graph.nodes.join(mapping.select("id"), "id", "left_anti")
    return Graph(nodes, remap(graph.edges, mapping, "id", "winner"))
