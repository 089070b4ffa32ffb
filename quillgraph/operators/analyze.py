"""Measures of a graph: degrees, statistics, surprises, cycles, communities' shapes, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import predicates as P
from quillgraph.functions import vocabulary as V
from quillgraph.operators.build import Graph
from quillgraph.session import cut


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every node; a loop counts twice. Ends are counted before the shuffle, so a hub is no hot spot."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").distinct().join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def value_at_percentile(rows: DataFrame, value: str, percent: float, offset: int = -1) -> DataFrame:
    """(threshold): the value at index max(0, int(n * percent / 100) + offset) of the sorted values, by their counts."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    total = counts.agg(F.sum("n").alias("total"))
    at = F.greatest(F.lit(0), F.floor(F.col("total") * percent / 100).cast("bigint") + offset)
    return upto.join(F.broadcast(total)).where(F.col("upto") > at).agg(F.min(value).alias("threshold"))


def kinds(graph: Graph, degree: DataFrame) -> DataFrame:
    """Nodes with their degree and whether they stand for a file, a concept, a JSON key or noise."""
    rows = graph.nodes.join(degree, "id")
    label, path = F.col("label"), F.col("source_file")
    return rows.select(
        "*",
        P.is_file_node(label, path, F.col("degree")).alias("is_file"),
        P.is_concept_node(path).alias("is_concept"),
        P.is_json_key(label, path).alias("is_json_key"),
        P.is_noise(label).alias("is_noise"),
    )


def god_nodes(graph: Graph, top: int = 10, hub_percentile: float | None = None) -> DataFrame:
    """(id, label, degree): the ``top`` nodes by degree, then id, that are code of their own; above the percentile none, if one is given."""
    degree = degrees(graph.nodes, graph.edges)
    rows = kinds(graph, degree).where("not is_file and not is_concept and not is_json_key and not is_noise")
    if hub_percentile is not None:
        rows = rows.join(F.broadcast(value_at_percentile(degree, "degree", hub_percentile))).where("degree <= threshold")
    return rows.select("id", "label", "degree").orderBy(F.desc("degree"), "id").limit(top)


def statistics(graph: Graph) -> DataFrame:
    """(nodes, edges, extracted, inferred, ambiguous, mean_score): counts, shares of confidence in percent, mean confidence score."""
    share = lambda level: (F.count_if(F.col("confidence") == level) * 100 / F.count(F.lit(1))).alias(level.lower())
    e = graph.edges.agg(F.count(F.lit(1)).alias("edges"), *(share(x) for x in V.CONFIDENCE_SCORES), F.avg("confidence_score").alias("mean_score"))
    return graph.nodes.agg(F.count_distinct("id").alias("nodes")).join(F.broadcast(e))


def edge_diagnostics(edges: DataFrame) -> DataFrame:
    """(measure, value): how edges coincide. ``edges`` (src, dst, relation, source_file, source_location, context), not yet distinct."""
    pair = [F.least("src", "dst"), F.greatest("src", "dst")]
    directed = edges.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("relation").alias("relations"), F.count_distinct("source_file").alias("files"),
        F.count_distinct("source_location").alias("locations"), F.count_distinct("context").alias("contexts"),
    )
    both = edges.groupBy(*(p.alias(f"p{i}") for i, p in enumerate(pair))).agg(F.count(F.lit(1)).alias("n"))
    exact = edges.groupBy("src", "dst", "relation").agg(F.count(F.lit(1)).alias("n"))
    d = directed.agg(
        F.sum(F.col("n") - 1).alias("directed_collapses"), F.count_if(F.col("relations") > 1).alias("relation_variants"), F.count_if(F.col("files") > 1).alias("file_variants"),
        F.count_if(F.col("locations") > 1).alias("location_variants"), F.count_if(F.col("contexts") > 1).alias("context_variants"),
        F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n"))), F.lit(0)).alias("self_loops"),
    )
    row = d.join(F.broadcast(both.agg(F.sum(F.col("n") - 1).alias("undirected_collapses")))).join(F.broadcast(exact.agg(F.sum(F.col("n") - 1).alias("exact_duplicates"))))
    return row.unpivot([], row.columns, "measure", "value")


def surprises(graph: Graph, communities: DataFrame | None = None) -> DataFrame:
    """(edge_id, src, dst, relation, confidence, score): edges between files by how little one expects them.

    ``communities`` (id, community). Structural edges and those of file and concept nodes are left out.
    """
    degree = degrees(graph.nodes, graph.edges)
    n = kinds(graph, degree).where("not is_file and not is_concept").select("id", "source_file", "degree")
    if communities is not None:
        n = n.join(communities.select("id", "community"), "id", "left")
    else:
        n = n.withColumn("community", F.lit(None).cast("string"))
    side = lambda s, key: n.select(F.col("id").alias(key), F.col("source_file").alias(f"file_{s}"), F.col("degree").alias(f"degree_{s}"), F.col("community").alias(f"community_{s}"))
    rows = graph.edges.where(~F.col("relation").isin(*V.STRUCTURAL)).join(side("u", "src"), "src").join(side("v", "dst"), "dst").where("file_u != file_v")
    cat_u, cat_v = P.file_category(F.col("file_u")), P.file_category(F.col("file_v"))
    fam_u, fam_v = P.surprise_family(F.col("file_u")), P.surprise_family(F.col("file_v"))
    cross_language = F.coalesce(fam_u != fam_v, F.lit(False))
    code_doc = F.array_sort(F.array(cat_u, cat_v)) == F.array(F.lit("code"), F.lit("doc"))
    quiet = (F.col("confidence") == "INFERRED") & F.col("relation").isin("calls", "uses") & (cross_language | code_doc)
    base = F.when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)
    loud = (
        base + F.when(cat_u != cat_v, 2).otherwise(0) + F.when(P.top_directory(F.col("file_u")) != P.top_directory(F.col("file_v")), 2).otherwise(0)
        + F.when(F.col("community_u") != F.col("community_v"), 1).otherwise(0)
    )
    score = F.when(quiet, 0).otherwise(loud)
    score = F.when(F.col("relation") == "semantically_similar_to", F.floor(score * 1.5).cast("int")).otherwise(score)
    edge_of_hub = (F.least("degree_u", "degree_v") <= 2) & (F.greatest("degree_u", "degree_v") >= 5)
    return rows.select("edge_id", "src", "dst", "relation", "confidence", (score + F.when(edge_of_hub, 1).otherwise(0)).alias("score"))


def import_graph(graph: Graph) -> DataFrame:
    """(src, dst): which file imports which, from edges that are not deferred."""
    files = graph.nodes.select("id", "source_file")
    side = lambda key, name: files.select(F.col("id").alias(key), F.col("source_file").alias(name))
    rows = graph.edges.where(F.col("relation").isin(*V.CYCLE) & ~F.col("deferred") & (F.col("source_file") != "")).join(side("src", "fu"), "src").join(side("dst", "fv"), "dst")
    mine = F.col("source_file")
    other = (
        F.when(F.col("fu") == mine, F.col("fv")).when(F.col("fv") == mine, F.col("fu"))
        .otherwise(F.when((P.text_of(F.col("fv")) != "") & (F.col("fv") != mine), F.col("fv")).otherwise(F.col("fu")))
    )
    return rows.select(mine.alias("src"), other.alias("dst")).where("dst is not null and dst != ''").distinct()


def short_cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """(cycle, length): the simple cycles of at most ``longest`` edges of (src, dst), each once, from its least node on.

    Each step joins paths that start at their least node; nodes that lie on no cycle that short drop out first, because
    each must be left and entered, so hubs without a way back cost nothing.
    """
    edges = cut(edges.where("src != dst").select("src", "dst").distinct(), "ring")
    loops = None
    for _ in range(2):
        sources, targets = edges.select("src").distinct(), edges.select(F.col("dst").alias("src")).distinct()
        both = sources.join(targets, "src", "left_semi")
        edges = cut(edges.join(both, "src", "left_semi").join(both.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"), "ring")
    paths = edges.where("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("end"), F.array("src", "dst").alias("path"))
    found = []
    for length in range(2, longest + 1):
        closed = paths.join(edges.select(F.col("src").alias("end"), F.col("dst").alias("start")), ["end", "start"], "left_semi")
        found.append(closed.select(F.col("path").alias("cycle"), F.lit(length).alias("length")))
        if length < longest:
            grown = paths.join(edges.select(F.col("src").alias("end"), F.col("dst").alias("next")), "end").where("next > start and not array_contains(path, next)")
            paths = cut(grown.select("start", F.col("next").alias("end"), F.concat("path", F.array("next")).alias("path")), "ring")
    for f in found:
        loops = f if loops is None else loops.unionByName(f)
    return loops


def difference(old: Graph, new: Graph, directed: bool = True) -> DataFrame:
    """(change, entity, src, dst, relation): nodes (id in src) and edges only one of two graphs has."""
    ends = (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    keys = lambda g: g.edges.select(ends[0].alias("src"), ends[1].alias("dst"), "relation").distinct()
    ids = lambda g: g.nodes.select("id").distinct()
    nodes = lambda a, b, change: ids(a).join(ids(b), "id", "left_anti").select(F.lit(change).alias("change"), F.lit("node").alias("entity"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("string").alias("relation"))
    edges = lambda a, b, change: keys(a).join(keys(b), ["src", "dst", "relation"], "left_anti").select(F.lit(change).alias("change"), F.lit("edge").alias("entity"), "src", "dst", "relation")
    return nodes(new, old, "added").unionByName(nodes(old, new, "removed")).unionByName(edges(new, old, "added")).unionByName(edges(old, new, "removed"))


def cohesion(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, size, cohesion): edges inside of all possible; a single node has 1. ``members`` (id, community), ``edges`` distinct pairs (a, b)."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    side = lambda key, name: members.select(F.col("id").alias(key), F.col("community").alias(name))
    intra = edges.where("a != b").join(side("a", "ca"), "a").join(side("b", "cb"), "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("inside"))
    possible = F.col("size") * (F.col("size") - 1) / 2
    return sizes.join(intra, "community", "left").select("community", "size", F.when(F.col("size") <= 1, 1.0).otherwise(F.coalesce("inside", F.lit(0)) / possible).alias("cohesion"))


def hub_labels(members: DataFrame, graph: Graph, degree: DataFrame) -> DataFrame:
    """(community, label): the label of the member of the highest degree, the first id among equals, without ``()``."""
    rows = members.join(graph.nodes.select("id", "label"), "id").join(degree, "id")
    best = rows.groupBy("community").agg(F.min_by("label", F.struct((-F.col("degree")).alias("d"), "id")).alias("label"))
    return best.select("community", F.regexp_replace(F.trim("label"), r"\(\)$", "").alias("label"))


def fingerprints(members: DataFrame) -> DataFrame:
    """(community, signature): 16 hex digits of a hash of the sorted member ids."""
    joined = F.concat(F.array_join(F.sort_array(F.collect_set("id")), "\0"), F.lit("\0"))
    return members.groupBy("community").agg(F.substring(F.sha2(joined, 256), 1, 16).alias("signature"))


def meta_graph(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, edges): how many of the pairs (a, b) join two communities."""
    side = lambda key, name: members.select(F.col("id").alias(key), F.col("community").alias(name))
    rows = edges.join(side("a", "ca"), "a").join(side("b", "cb"), "b").where("ca != cb")
    return rows.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count(F.lit(1)).alias("edges"))


def isolated(graph: Graph) -> DataFrame:
    """(id, label): nodes of degree 0 or 1 that are neither files, concepts nor rationales."""
    rows = kinds(graph, degrees(graph.nodes, graph.edges))
    return rows.where("degree <= 1 and not is_file and not is_concept and file_type != 'rationale'").select("id", "label")


def connections(graph: Graph, shown: int = 20) -> DataFrame:
    """(id, direction, file, shown, more): for each node and file how many of its neighbours are among its ``shown`` best connected, and how many more."""
    degree = degrees(graph.nodes, graph.edges)
    ends = graph.edges.select("src", "dst").distinct()
    sides = ends.select(F.col("src").alias("id"), F.lit("out").alias("direction"), F.col("dst").alias("other")).unionByName(ends.select(F.col("dst").alias("id"), F.lit("in").alias("direction"), F.col("src").alias("other")))
    rows = sides.join(degree.select(F.col("id").alias("other"), "degree"), "other").join(graph.nodes.select(F.col("id").alias("other"), F.coalesce("source_file", F.lit("")).alias("file")), "other")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("degree"), "other", "direction"))
    return rows.withColumn("rank", rank).groupBy("id", "direction", "file").agg(F.count_if(F.col("rank") <= shown).alias("shown"), F.count_if(F.col("rank") > shown).alias("more"))


def directory_tree(paths: DataFrame, path: str) -> DataFrame:
    """(directory, files, rows): for each directory how many distinct files and how many rows lie below it."""
    counts = paths.where(F.col(path).isNotNull()).groupBy(path).agg(F.count(F.lit(1)).alias("rows"))
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = counts.select("rows", F.explode(above).alias("directory"))
    return rows.groupBy("directory").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))
