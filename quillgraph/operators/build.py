"""From raw records to a graph: cleaning, repair, validation, pair collapse and hyperedges."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import predicates as P
from quillgraph.functions import vocabulary as V
from quillgraph.functions.ids import canonical_id, filled


class Graph(NamedTuple):
    """``nodes`` (id, label, file_type, source_file, source_location, node_kind, ...) and ``edges`` (src, dst, relation, ...), one row each."""

    nodes: DataFrame
    edges: DataFrame


def with_columns(df: DataFrame, **types: str) -> DataFrame:
    """Add the columns that are missing, as nulls."""
    have = set(df.columns)
    return df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in types.items() if c not in have))


def clean_nodes(records: DataFrame) -> DataFrame:
    """Node rows from records (id, label, file_type, source_file, source_location, ...): canonical ids, known types, one path spelling.

    Records whose id is null, blank or without a word character are left out; a missing label is the id.
    """
    rows = with_columns(records, node_kind="string", origin="string", content="string")
    key = canonical_id(F.col("id"))
    rows = rows.select(
        key.alias("id"),
        F.when(filled(F.col("label")), F.col("label")).otherwise(key).alias("label"),
        P.file_type(F.col("file_type")).alias("file_type"),
        F.regexp_replace(P.source_path(F.col("source_file")), r"^(\./+)+", "").alias("source_file"),
        "source_location",
        "node_kind",
        "origin",
        "content",
    )
    return rows.where(F.col("id") != "")


def clean_edges(records: DataFrame) -> DataFrame:
    """Edge rows from records (edge_id, source, target, relation, ...), each edge_id once: the delivery that was loaded first.

    Edges with a null or blank endpoint are left out.
    """
    first = F.row_number().over(Window.partitionBy("edge_id").orderBy("loaded_at"))
    rows = records.where(filled(F.col("source")) & filled(F.col("target"))).withColumn("_n", first).where("_n = 1")
    level = P.confidence(F.col("confidence"))
    return rows.select(
        "edge_id",
        canonical_id(F.col("source")).alias("src"),
        canonical_id(F.col("target")).alias("dst"),
        canonical_id(F.col("relation")).alias("relation"),
        level.alias("confidence"),
        P.confidence_score(F.col("confidence_score"), level).alias("confidence_score"),
        P.weight(F.col("weight")).alias("weight"),
        F.lower(F.trim("context")).alias("context"),
        F.regexp_replace(P.source_path(F.col("source_file")), r"^(\./+)+", "").alias("source_file"),
        "source_location",
        F.coalesce("deferred", F.lit(False)).alias("deferred"),
        F.col("extracted_at").alias("made_at"),
    )


def survivors(nodes: DataFrame) -> DataFrame:
    """One row for each id: the one of the best origin, with a location, in the shortest and first label; gaps are filled from the others.

    The rank is a total order, so any partitioning gives the same rows; candidates are combined before the shuffle.
    """
    rank = F.struct(
        (F.coalesce(F.col("origin"), F.lit("")) != "ast").alias("a"),
        F.col("source_location").isNull().alias("b"),
        F.length("label").alias("c"),
        F.col("label").alias("d"),
        F.coalesce("source_file", F.lit("")).alias("e"),
    )
    best = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c)
    return nodes.withColumn("_rank", rank).groupBy("id").agg(*(best(c) for c in nodes.columns if c != "id"))


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose both ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, endpoint, node_id, relation): ends that are no node."""
    ids = nodes.select(F.col("id").alias("node_id"))
    ends = edges.select("edge_id", "relation", F.explode(F.array(*(F.struct(F.lit(n).alias("endpoint"), F.col(c).alias("node_id")) for n, c in (("source", "src"), ("target", "dst"))))).alias("x"))
    return ends.select("edge_id", "x.endpoint", "x.node_id", "relation").join(ids, "node_id", "left_anti").select("edge_id", "endpoint", "node_id", "relation")


def repair_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends that are no id but the label or file name of exactly one node become that node's id."""
    ids = nodes.select("id").distinct()
    names = nodes.select("id", F.explode(F.array_distinct(F.array(canonical_id(F.col("label")), canonical_id(P.base_name(P.text_of(F.col("source_file"))))))).alias("alias"))
    names = names.where("alias != ''").join(ids.withColumnRenamed("id", "alias"), "alias", "left_anti")
    unique = names.groupBy("alias").agg(F.count_distinct("id").alias("n"), F.min("id").alias("to")).where("n = 1")
    for end in ("src", "dst"):
        known = unique.select(F.col("alias").alias(end), F.col("to").alias("_to"))
        edges = edges.join(known, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to").select(*edges.columns)
    return edges


def ghost_map(nodes: DataFrame) -> DataFrame:
    """(ghost, real): nodes that are not from the parser and have the file and label of exactly one that is."""
    parsed = F.coalesce(F.col("origin") == "ast", F.lit(False)) | F.coalesce(F.col("source_location").rlike(r"^L\d+"), F.lit(False))
    rows = nodes.where("source_file is not null and label is not null").select("id", "source_file", "label", parsed.alias("parsed"))
    real = rows.where("parsed").groupBy("source_file", "label").agg(F.count_distinct("id").alias("n"), F.min("id").alias("real")).where("n = 1")
    ghosts = rows.where("not parsed").select(F.col("id").alias("ghost"), "source_file", "label")
    return ghosts.join(real, ["source_file", "label"]).where("ghost != real").groupBy("ghost").agg(F.min("real").alias("real"))


def remap(edges: DataFrame, mapping: DataFrame, old: str, new: str, drop_loops: bool = True) -> DataFrame:
    """Replace node ids at both ends; loops that this makes are dropped."""
    was_loop = F.col("src") == F.col("dst")
    rows = edges.withColumn("_loop", was_loop)
    for end in ("src", "dst"):
        rows = rows.join(mapping.select(F.col(old).alias(end), F.col(new).alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    if drop_loops:
        rows = rows.where("_loop or src != dst")
    return rows.select(*edges.columns)


def with_source_files(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without a file take that of their source node, else of their target node."""
    files = nodes.select("id", F.col("source_file").alias("_f"))
    rows = edges.join(files.select(F.col("id").alias("src"), F.col("_f").alias("_fs")), "src", "left").join(files.select(F.col("id").alias("dst"), F.col("_f").alias("_ft")), "dst", "left")
    return rows.withColumn("source_file", F.coalesce("source_file", "_fs", "_ft")).select(*edges.columns)


def across_languages(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that only a mix-up of languages explains: inferred calls between different families, imports and references between known ones."""
    family = nodes.select("id", P.edge_family(F.col("source_file")).alias("_f"))
    rows = edges.join(family.select(F.col("id").alias("src"), F.col("_f").alias("_fs")), "src", "left").join(family.select(F.col("id").alias("dst"), F.col("_f").alias("_ft")), "dst", "left")
    differ = F.col("_fs").isNotNull() & F.col("_ft").isNotNull() & (F.col("_fs") != F.col("_ft"))
    guarded = F.col("relation").isin("imports", "imports_from", "references") | ((F.col("relation") == "calls") & (F.col("confidence") == "INFERRED"))
    return rows.where(differ & guarded).select(*edges.columns)


def import_loops(edges: DataFrame) -> DataFrame:
    return edges.where((F.col("src") == F.col("dst")) & F.col("relation").isin("imports", "imports_from", "re_exports"))


def collapse_pairs(edges: DataFrame) -> DataFrame:
    """One edge for each unordered pair of nodes: (a, b, src, dst, relation).

    The distinct edges of a pair are taken in the order (src, dst, relation); each replaces the one before, but the
    reverse of the same relation does not, and a generic relation does not replace a specific one. A pair has at most two
    edges for each relation, so its list is short.
    """
    generic = lambda e: e["relation"].isin(*V.GENERIC)

    def step(have: Column, e: Column) -> Column:
        reverse = (have["src"] == e["dst"]) & (have["dst"] == e["src"]) & (have["src"] != have["dst"]) & (have["relation"] == e["relation"])
        return F.when(reverse | (generic(e) & ~generic(have)), have).otherwise(e)

    distinct = edges.select("src", "dst", "relation").distinct()
    pair = distinct.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    lists = pair.agg(F.sort_array(F.collect_list(F.struct("src", "dst", "relation"))).alias("es"))
    kept = F.aggregate(F.slice("es", 2, 1_000_000), F.get(F.col("es"), F.lit(0)), step)
    return lists.select("a", "b", kept.alias("e")).select("a", "b", "e.src", "e.dst", "e.relation")


def validation_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity, key, rule): required fields that are missing and values that are not known."""
    n = lambda rule, test: nodes.where(test).select(F.lit("node").alias("entity"), F.col("rec_id").cast("string").alias("key"), F.lit(rule).alias("rule"))
    e = lambda rule, test: edges.where(test).select(F.lit("edge").alias("entity"), F.col("edge_id").cast("string").alias("key"), F.lit(rule).alias("rule"))
    missing = lambda c: ~filled(F.col(c))
    rows = [n(f"missing_{c}", missing(c)) for c in ("id", "label", "file_type", "source_file")]
    rows.append(n("unknown_file_type", filled(F.col("file_type")) & ~F.col("file_type").isin(*V.FILE_TYPES)))
    rows += [e(f"missing_{c}", missing(c)) for c in ("source", "target", "relation", "confidence", "source_file")]
    rows.append(e("unknown_confidence", filled(F.col("confidence")) & ~F.col("confidence").isin(*V.CONFIDENCE_SCORES)))
    return reduce(DataFrame.unionByName, rows)


def fragment_errors(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame, most_nodes: int = 10_000, most_edges: int = 100_000, most_hyperedges: int = 10_000, most_members: int = 256) -> DataFrame:
    """(rule, count): limits that an untrusted fragment breaks, and how many ids or rows break them."""
    id_ok = lambda c: F.coalesce(F.col(c).rlike(r"^[\w.:-]+\z") & (F.length(c) <= 256), F.lit(False))
    total = lambda df, rule, most: df.agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > most).select(F.lit(rule).alias("rule"), "count")
    broken = lambda df, rule, test: df.where(test).agg(F.count(F.lit(1)).alias("count")).where("count > 0").select(F.lit(rule).alias("rule"), "count")
    rows = [
        total(nodes, "too_many_nodes", most_nodes),
        total(edges, "too_many_edges", most_edges),
        total(hyperedges, "too_many_hyperedges", most_hyperedges),
        broken(nodes, "bad_node_id", ~id_ok("id")),
        broken(edges, "bad_endpoint", ~id_ok("source") | ~id_ok("target")),
        broken(hyperedges, "too_many_members", F.size("nodes") > most_members),
        broken(hyperedges, "too_few_members", F.coalesce(F.size(F.array_distinct("nodes")), F.lit(0)) < 2),
    ]
    return reduce(DataFrame.unionByName, rows)


def cleaned_fragment(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Nodes that are sentences rather than things become the ``rationale`` of what they are about; typed rationales and concepts go.

    ``nodes`` (id, label, file_type), ``edges`` (src, dst, relation). Edges that touch a removed node go, too.
    """
    sentence = ((F.length("label") >= 80) | (F.size(F.split("label", r"\s+")) >= 8)) & F.col("label").rlike(r"[.!?:]")
    about = edges.where("relation = 'rationale_for'").select(F.col("src").alias("id"), "dst")
    said = nodes.where(sentence).select("id", "label").join(about, "id").groupBy(F.col("dst").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("label")), " ").alias("rationale"))
    gone = nodes.where(sentence).select("id").join(about.select("id"), "id", "left_semi").unionByName(nodes.where(F.col("file_type").isin("rationale", "concept")).select("id")).distinct()
    kept = nodes.where(filled(F.col("id"))).join(gone, "id", "left_anti").join(said, "id", "left")
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return Graph(kept, left.select(*edges.columns))


def hyperedge_members(hyperedges: DataFrame, nodes: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Hyperedges with canonical, existing, distinct members in their order, remapped by (old, new); those with fewer than two go."""
    members = hyperedges.select("id", F.posexplode("nodes").alias("pos", "m")).select("id", "pos", canonical_id(F.col("m")).alias("m"))
    if mapping is not None:
        members = members.join(mapping.select(F.col("old").alias("m"), F.col("new").alias("_to")), "m", "left").withColumn("m", F.coalesce("_to", "m")).drop("_to")
    members = members.join(nodes.select(F.col("id").alias("m")).distinct(), "m", "left_semi").groupBy("id", "m").agg(F.min("pos").alias("pos"))
    lists = members.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("x")).select("id", F.col("x.m").alias("nodes")).where(F.size("nodes") >= 2)
    return hyperedges.drop("nodes").join(lists, "id")


def file_labels(nodes: DataFrame, deepest: int = 6) -> DataFrame:
    """(source_file, label): for files that share their name with others the shortest end of the path that is unique, up to ``deepest`` parts."""
    files = nodes.where("node_kind = 'file' and source_file is not null").select("source_file").distinct()
    parts = F.split("source_file", "/")
    tail = lambda k: F.array_join(F.slice(parts, F.greatest(F.size(parts) - k + 1, F.lit(1)), F.lit(deepest)), "/")
    rows = files.select("source_file", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), tail(k).alias("tail")) for k in range(1, deepest + 1)))).alias("x")).select("source_file", "x.k", "x.tail")
    alone = rows.groupBy("k", "tail").agg(F.count(F.lit(1)).alias("n"), F.min("source_file").alias("source_file")).where("n = 1")
    best = alone.groupBy("source_file").agg(F.min_by("tail", "k").alias("label"))
    return files.join(best, "source_file", "left").select("source_file", F.coalesce("label", "source_file").alias("label"))


def build(nodes: DataFrame, edges: DataFrame) -> Graph:
    """The graph of node and edge records: cleaned, one row for each id, ghosts merged, ends repaired, phantom edges between languages dropped."""
    n = survivors(clean_nodes(nodes))
    e = clean_edges(edges)
    ghosts = ghost_map(n)
    e = remap(e, ghosts, "ghost", "real")
    n = n.join(ghosts.select(F.col("ghost").alias("id")), "id", "left_anti")
    e = inside(repair_endpoints(e, n), n)
    e = with_source_files(e, n)
    e = e.join(across_languages(e, n).select("edge_id"), "edge_id", "left_anti").join(import_loops(e).select("edge_id"), "edge_id", "left_anti")
    return Graph(n, e)
