"""One object with the engine's tools over a graph of nodes and edges, and the commands of ``python -m quillgraph``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import code
from quillgraph.functions import vocabulary as V
from quillgraph.operators import analyze, briefing, build, communities, context, merge, search, upkeep, walks
from quillgraph.operators.build import Graph
from quillgraph.operators.index import Index, build_index, open_index
from quillgraph.session import build_session, cut
from quillgraph.sources import extract, files, formats


class Engine:
    """Tools over one graph. Names are resolved like a reader's: file, exact label or id, beginning, part."""

    def __init__(self, graph: Graph) -> None:
        self.graph = Graph(build.with_columns(graph.nodes, node_kind="string", content="string", source_location="string", file_type="string"), build.with_columns(graph.edges, edge_id="bigint", confidence="string", context="string", deferred="boolean", source_file="string"))

    @classmethod
    def from_tables(cls, spark: SparkSession, folder: str) -> Engine:
        return cls(Graph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")))

    @classmethod
    def from_directory(cls, spark: SparkSession, root: str) -> Engine:
        """Extract all files below ``root``, leave noise and credentials out, and resolve stubs to definitions."""
        from quillgraph.operators.resolve import stub_map

        found = files.scan_text(spark, root)
        found = found.join(files.noise(found).select("path"), "path", "left_anti")
        from quillgraph.functions.predicates import is_sensitive

        g = extract.extract(found.where(~is_sensitive(F.col("path"))))
        nodes = build.survivors(g.nodes.withColumn("content", F.lit(None).cast("string")))
        mapping = stub_map(nodes)
        nodes = nodes.join(mapping.select(F.col("stub").alias("id")), "id", "left_anti")
        return cls(Graph(nodes, build.inside(build.remap(g.edges, mapping, "stub", "real"), nodes)))

    def save(self, folder: str) -> None:
        self.graph.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
        self.graph.edges.write.mode("overwrite").parquet(f"{folder}/edges")

    def find(self, name: str) -> DataFrame:
        return briefing.scoped(self.graph.nodes, name).select("id", F.lit(0).alias("tier")) if "::" in name else search.find_nodes(self.graph.nodes, name)

    def _seeds(self, name: str) -> DataFrame:
        return cut(self.find(name).select(F.lit(name).alias("seed"), "id"), "seeds")

    def stats(self) -> DataFrame:
        return analyze.statistics(Graph(self.graph.nodes, build.with_columns(self.graph.edges, confidence_score="double")))

    def god_nodes(self, top: int = 10) -> DataFrame:
        return analyze.god_nodes(self.graph, top)

    def neighbours(self, name: str, relation: str | None = None) -> DataFrame:
        e = self.graph.edges if relation is None else self.graph.edges.where(F.col("relation") == relation)
        ids = self._seeds(name).select("id")
        out = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.lit("out").alias("direction"), "relation", F.col("dst").alias("id"))
        into = e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.lit("in").alias("direction"), "relation", F.col("src").alias("id"))
        return out.unionByName(into).distinct()

    def callers(self, name: str) -> DataFrame:
        return self.neighbours(name).where(F.col("relation").isin(*V.CALLS) & (F.col("direction") == "in"))

    def callees(self, name: str) -> DataFrame:
        return self.neighbours(name).where(F.col("relation").isin(*V.CALLS) & (F.col("direction") == "out"))

    def references(self, name: str) -> DataFrame:
        return self.neighbours(name).where(~F.col("relation").isin(*V.NOT_A_REFERENCE) & (F.col("direction") == "in"))

    def implementations(self, name: str) -> DataFrame:
        return walks.dependents(self.graph.edges.where(~F.col("relation").isin(*V.MEMBER)), self._seeds(name), V.SUBTYPE, None)

    def affected(self, name: str, depth: int = 2) -> DataFrame:
        return walks.dependents(self.graph.edges, self._seeds(name), V.AFFECTED, depth)

    def impact(self, name: str, depth: int = 10) -> DataFrame:
        g = Graph(cut(self.graph.nodes, "nodes"), cut(self.graph.edges, "edges"))
        return walks.impact(g, self._seeds(name).select("id"), communities.label_propagation(g.nodes, g.edges), walks.page_rank(g.nodes, g.edges), depth)

    def path(self, source: str, target: str, hops: int = 8) -> DataFrame:
        found = walks.shortest_paths(self.graph.edges, self._seeds(source), hops)
        return found.join(self._seeds(target).select("id"), "id", "left_semi").orderBy("depth", "path").limit(1)

    def flow(self, source: str, sink: str, depth: int = 15) -> DataFrame:
        return walks.flows(self.graph, self._seeds(source).select("id"), self._seeds(sink).select("id"), depth, 50)

    def query(self, question: str, top: int = 20) -> DataFrame:
        g = Graph(cut(self.graph.nodes, "nodes"), cut(self.graph.edges, "edges"))
        terms = search.query_terms(question, V.ENGLISH_STOPWORDS)
        return search.hybrid(g, search.bm25(search.fields(g.nodes), terms), walks.page_rank(g.nodes, g.edges), top=top)

    def brief(self, question: str, budget: int = 2000) -> DataFrame:
        return briefing.briefing(self.graph, search.bm25(search.fields(self.graph.nodes), search.query_terms(question, V.ENGLISH_STOPWORDS)), budget)

    def index(self, folder: str) -> Index:
        """The search index of the graph, written to ``folder``."""
        return build_index(search.fields(self.graph.nodes).join(self.graph.nodes.select("id", "label"), "id"), folder, "label")

    def refine(self, draft: str, folder: str, budget: int = 2000) -> DataFrame:
        """What a draft leans on, by the index in ``folder``."""
        return context.refine(self.graph, open_index(self.graph.nodes.sparkSession, folder), draft, budget)

    def diff_context(self, hunks: DataFrame) -> DataFrame:
        return context.diff_context(self.graph, hunks)

    def signature(self, name: str) -> DataFrame:
        """Signatures and outlines of what a name stands for."""
        n = self.graph.nodes.join(self._seeds(name).select("id").distinct(), "id", "left_semi")
        return n.select("id", code.signature(F.col("content")).alias("signature"), code.skeleton(F.col("content")).alias("outline"))

    def implementation(self, name: str) -> DataFrame:
        """The whole text of what a name stands for, with its place."""
        return self.graph.nodes.join(self._seeds(name).select("id").distinct(), "id", "left_semi").select("id", "label", "source_file", "source_location", "content")

    def explain(self, name: str) -> DataFrame:
        ids = self._seeds(name).select("id")
        return analyze.connections(self.graph).join(ids, "id", "left_semi")

    def communities(self, resolution: float = 1.0) -> DataFrame:
        return communities.detect(self.graph.nodes, self.graph.edges, resolution)

    def lint(self) -> DataFrame:
        return upkeep.lint(self.graph.edges, self.graph.nodes)

    def diff(self, newer: Engine) -> DataFrame:
        return analyze.difference(self.graph, newer.graph)

    def merged_with(self, newer: Engine) -> Engine:
        return Engine(merge.merge(self.graph, newer.graph))

    def cypher(self) -> DataFrame:
        return formats.cypher_lines(self.graph)


# Commands: how many names each takes.
COMMANDS = {
    "stats": 0, "god_nodes": 0, "communities": 0, "lint": 0, "cypher": 0, "find": 1, "neighbours": 1, "callers": 1, "callees": 1, "references": 1, "implementations": 1,
    "affected": 1, "impact": 1, "explain": 1, "signature": 1, "implementation": 1, "query": 1, "brief": 1, "path": 2, "flow": 2,
}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillgraph", description="Ask a code graph. 'extract DIR --graph FOLDER' makes one; other commands read it.")
    p.add_argument("command", choices=["extract", "diff", *COMMANDS])
    p.add_argument("names", nargs="*")
    p.add_argument("--graph", required=True, help="folder of the graph's tables")
    a = p.parse_args(argv)
    spark = build_session("quillgraph", spark__ui__enabled="false")
    if a.command == "extract":
        Engine.from_directory(spark, a.names[0]).save(a.graph)
        return 0
    engine = Engine.from_tables(spark, a.graph)
    wanted = 1 if a.command == "diff" else COMMANDS[a.command]
    if len(a.names) != wanted:
        p.error(f"{a.command} takes {wanted} name(s)")
    rows = engine.diff(Engine.from_tables(spark, a.names[0])) if a.command == "diff" else getattr(engine, a.command)(*a.names)
    for line in rows.toJSON().toLocalIterator():
        json.dump(json.loads(line), sys.stdout, ensure_ascii=False, sort_keys=True)
        print()
    return 0
