"""Combining graphs: incremental replacement, composition, prefixes, pruning, backlinks, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.build import Graph


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in a total order; ``dropDuplicates`` would take any. Candidates are combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_x"))
    return best.select(*keys, "_x.*").select(*rows.columns)


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_x"))
    return best.select(*keys, "_x.*").select(*rows.columns)


def union_fragments(fragments: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """All rows of several fragments, the first fragment first, one for each key."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (f.withColumn("_f", F.lit(i)) for i, f in enumerate(fragments)))
    return first_of(rows, keys, ["_f", *order]).drop("_f")


def replace_sources(old: DataFrame, new: DataFrame, tier: str | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """``old`` without the rows of the files (and tiers) that ``new`` brings again or that are ``deleted`` (source_file), and ``new``.

    Rows without a file stay. The files are distinct before they meet the old rows.
    """
    keys = ["source_file"] + ([tier] if tier else [])
    brought = new.where("source_file is not null").select(*keys).distinct()
    kept = old.join(brought, keys, "left_anti")
    if deleted is not None:
        kept = kept.join(deleted.select("source_file").distinct(), "source_file", "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def merge(old: Graph, new: Graph, deleted: DataFrame | None = None) -> Graph:
    """The graph after some files were extracted again: their nodes and edges replaced, edges without an end dropped, nodes that lost all edges and their file dropped."""
    nodes = last_of(replace_sources(old.nodes.withColumn("_new", F.lit(0)), new.nodes.withColumn("_new", F.lit(1)), deleted=deleted), ["id"], ["_new", "label"]).drop("_new")
    edges = replace_sources(old.edges, new.edges, deleted=deleted)
    ids = nodes.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*old.edges.columns)
    return Graph(nodes, edges)


def prefixed(graph: Graph, repo: str) -> Graph:
    """Ids of one repository made distinct: ``repo::id``; the old id stays as ``local_id``."""
    name = lambda c: F.concat(F.lit(repo + "::"), F.col(c))
    nodes = graph.nodes.withColumn("local_id", F.col("id")).withColumn("id", name("id")).withColumn("repo", F.lit(repo))
    return Graph(nodes, graph.edges.withColumn("src", name("src")).withColumn("dst", name("dst")))


def composed(graphs: list[Graph]) -> Graph:
    """Nodes and edges of several graphs; of a node that several have the last one's row."""
    nodes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (g.nodes.withColumn("_g", F.lit(i)) for i, g in enumerate(graphs)))
    edges = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (g.edges for g in graphs))
    return Graph(last_of(nodes, ["id"], ["_g"]).drop("_g"), edges)


def community_offsets(members: DataFrame) -> DataFrame:
    """(repo, offset): what to add to each repository's community numbers so that they do not meet, in the order of names."""
    sizes = members.groupBy("repo").agg((F.max("community") + 1).alias("n"))
    before = Window.orderBy("repo").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("repo", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def without_repo(graph: Graph, repo: str) -> Graph:
    nodes = graph.nodes.where(F.coalesce(F.col("repo") != repo, F.lit(True)))
    ids = nodes.select("id")
    return Graph(nodes, graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))


def backlinks(edges: DataFrame) -> DataFrame:
    """(src, dst, relation, forward): the reverse of each edge as ``backlink:relation``, unless it is there already."""
    have = edges.select("src", "dst", "relation").distinct()
    back = have.where(~F.col("relation").startswith("backlink:")).select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(F.lit("backlink:"), "relation").alias("relation"), F.col("relation").alias("forward")
    )
    return back.join(have, ["src", "dst", "relation"], "left_anti")


def manifest_changes(scan: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state): new, changed, unchanged, excluded or deleted.

    ``scan`` (path, hash, mtime), ``manifest`` (path, hash, mtime, stamped, alive): a file is unchanged if its time is the
    same and was not stamped within the tick in which a rewrite would not show (2 s for whole seconds, else 0.05 s), or its hash is
    the same. Files only the manifest has are excluded if they are still ``alive``, else deleted.
    """
    s, m = scan.alias("s"), manifest.alias("m")
    tick = F.when(F.col("m.mtime") == F.floor("m.mtime"), 2.0).otherwise(0.05)
    settled = (F.col("s.mtime") == F.col("m.mtime")) & (F.abs(F.col("m.stamped") - F.col("m.mtime")) > tick)
    state = (
        F.when(F.col("m.path").isNull(), "new").when(F.col("s.path").isNull(), F.when(F.col("m.alive"), "excluded").otherwise("deleted"))
        .when(F.col("m.hash").isNull(), "changed").when(F.coalesce(settled, F.lit(False)), "unchanged").when(F.col("s.hash") == F.col("m.hash"), "unchanged").otherwise("changed")
    )
    return s.join(m, F.col("s.path") == F.col("m.path"), "full_outer").select(F.coalesce("s.path", "m.path").alias("path"), state.alias("state"))


def uncached(scan: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content hash has no cached result."""
    return scan.join(cache.select("hash").distinct(), "hash", "left_anti")


def content_hash(path: str, body: str):
    """Hash of a text and its lower-cased path; the frontmatter of a document does not count."""
    text = F.when(F.lower(F.col(path)).endswith(".md"), F.regexp_replace(F.col(body), r"(?s)\A---\n.*?\n---\n", "")).otherwise(F.col(body))
    return F.sha2(F.concat(text, F.lit("\0"), F.lower(F.col(path))), 256)
