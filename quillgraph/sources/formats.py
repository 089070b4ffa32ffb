"""Readers and writers of formats: graph JSON, git output, memory notes, symbol indexes, server configurations, text exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators.build import Graph

GRAPH_JSON = """
directed boolean,
nodes array<struct<id: string, label: string, file_type: string, source_file: string, source_location: string, node_kind: string, community: int>>,
links array<struct<source: string, target: string, relation: string, confidence: string, weight: double, source_file: string>>,
edges array<struct<source: string, target: string, relation: string, confidence: string, weight: double, source_file: string>>
"""


def read_graph_json(spark: SparkSession, path: str) -> Graph:
    """Node-link JSON, its edges under ``links`` or ``edges``."""
    rows = spark.read.schema(GRAPH_JSON).json(path, multiLine=True)
    nodes = rows.select(F.explode("nodes").alias("n")).select("n.*")
    edges = rows.select(F.explode(F.coalesce("links", "edges")).alias("e")).select("e.*")
    return Graph(nodes, edges.withColumnsRenamed({"source": "src", "target": "dst"}))


def graph_json_lines(graph: Graph) -> DataFrame:
    """(part, json): one object for each node and edge, in canonical order within each part when sorted by both columns."""
    line = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*sorted(df.columns))).alias("json"))
    return line(graph.nodes, "nodes").unionByName(line(graph.edges.withColumnsRenamed({"src": "source", "dst": "target"}), "links"))


def cypher_lines(graph: Graph) -> DataFrame:
    """(statement): nodes and edges to be merged by a graph database."""
    name = lambda c: F.regexp_replace(F.upper(F.col(c)), "[^A-Z0-9_]", "_")
    quoted = lambda c: T.escaped_cypher(F.coalesce(F.col(c), F.lit("")))
    nodes = graph.nodes.select(F.format_string("MERGE (n:Node {id: '%s'}) SET n.label = '%s';", quoted("id"), quoted("label")).alias("statement"))
    edges = graph.edges.select(F.format_string("MATCH (a:Node {id: '%s'}), (b:Node {id: '%s'}) MERGE (a)-[:%s]->(b);", quoted("src"), quoted("dst"), name("relation")).alias("statement"))
    return nodes.unionByName(edges)


def graphml_lines(graph: Graph) -> DataFrame:
    """(element): GraphML nodes and edges; the frame around them is constant."""
    x = lambda c: T.escaped_xml(F.coalesce(F.col(c), F.lit("")))
    nodes = graph.nodes.select(F.format_string('<node id="%s"><data key="label">%s</data></node>', x("id"), x("label")).alias("element"))
    edges = graph.edges.select(F.format_string('<edge source="%s" target="%s"><data key="relation">%s</data></edge>', x("src"), x("dst"), x("relation")).alias("element"))
    return nodes.unionByName(edges)


def parse_git_log(lines: DataFrame) -> DataFrame:
    """(log_id, commit, file) of ``git log --name-only`` from its lines (log_id, pos, line)."""
    commit = F.when(F.col("line").rlike(r"^(commit )?[0-9a-f]{7,40}\b"), F.regexp_extract("line", r"([0-9a-f]{7,40})", 1))
    at = F.last(commit, True).over(Window.partitionBy("log_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("commit", at)
    other = F.col("line").rlike(r"^(commit |Author:|Date:|Merge:|\s|$)") | F.col("line").rlike(r"^[0-9a-f]{7,40}\b")
    return rows.where(~other & F.col("commit").isNotNull()).select("log_id", "commit", F.trim("line").alias("file"))


def parse_notes(notes: DataFrame) -> DataFrame:
    """(path, type, date, question, outcome, correction, nodes) of notes (path, text) with frontmatter."""
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---", 1)
    value = lambda k: F.regexp_replace(F.nullif(F.trim(F.regexp_extract(F.col("front"), rf"(?m)^{k}:\s*(.*)$", 1)), F.lit("")), r"^[\"']|[\"']$", "")
    nodes = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(value("source_nodes"), F.lit("")), r"[\[\]\"']", ""), ","), lambda n: F.trim(n)), lambda n: n != "")
    return notes.withColumn("front", front).select(
        "path", value("type").alias("type"), value("date").try_cast("timestamp").alias("date"), value("question").alias("question"), value("outcome").alias("outcome"),
        value("correction").alias("correction"), nodes.alias("nodes"),
    )


SCIP = "documents array<struct<relative_path: string, symbols: array<struct<symbol: string, kind: string, occurrences: array<struct<line: int, is_definition: boolean>>, relationships: array<struct<symbol: string, is_implementation: boolean, is_type_definition: boolean, is_reference: boolean>>>>>>"


def read_scip(spark: SparkSession, path: str) -> Graph:
    """Symbols of a code index in JSON and their relations; a target is looked up in its own document, then where only one has it, else a stub is made."""
    docs = spark.read.schema(SCIP).json(path, multiLine=True).select(F.explode("documents").alias("d"))
    rows = docs.select(F.col("d.relative_path").alias("file"), F.explode("d.symbols").alias("s")).select("file", "s.*")
    nodes = rows.select(F.concat_ws("#", "file", "symbol").alias("id"), F.col("symbol").alias("label"), F.col("file").alias("source_file"), F.col("kind").alias("node_kind"))
    rel = rows.select(F.concat_ws("#", "file", "symbol").alias("src"), "file", F.explode("relationships").alias("r"))
    kind = F.when(F.col("r.is_implementation"), "scip_impl").when(F.col("r.is_type_definition"), "scip_typed").otherwise("scip_ref")
    rel = rel.select("src", "file", F.col("r.symbol").alias("symbol"), kind.alias("relation"))
    own = rows.select("file", "symbol", F.concat_ws("#", "file", "symbol").alias("own")).distinct()
    one = rows.groupBy("symbol").agg(F.count_distinct("file").alias("n"), F.min(F.concat_ws("#", "file", "symbol")).alias("one")).where("n = 1").select("symbol", "one")
    linked = rel.join(own, ["file", "symbol"], "left").join(one, "symbol", "left").select("src", F.coalesce("own", "one", F.concat(F.lit("stub#"), "symbol")).alias("dst"), "relation", "symbol")
    stubs = linked.where(F.col("dst").startswith("stub#")).select(F.col("dst").alias("id"), F.col("symbol").alias("label"), F.lit(None).cast("string").alias("source_file"), F.lit("stub").alias("node_kind")).distinct()
    return Graph(nodes.unionByName(stubs), linked.select("src", "dst", "relation"))


def parse_server_configs(configs: DataFrame) -> Graph:
    """Servers, commands and environment variables of tool-server configurations (path, text)."""
    parsed = F.from_json("text", "mcpServers map<string, struct<command: string, args: array<string>, env: map<string, string>>>")
    servers = configs.select("path", F.explode(parsed["mcpServers"]).alias("name", "s")).withColumn("id", F.concat(F.lit("server:"), "name"))
    env = servers.select("id", F.explode(F.map_keys("s.env")).alias("name"))
    node = lambda df, i, label, kind: df.select(i.alias("id"), label.alias("label"), F.lit(kind).alias("node_kind"))
    command, variable = F.concat(F.lit("command:"), F.col("s.command")), F.concat(F.lit("env:"), F.col("name"))
    nodes = node(servers, F.col("id"), F.col("name"), "server").unionByName(node(servers.where("s.command is not null"), command, F.col("s.command"), "command")).unionByName(node(env, variable, F.col("name"), "env"))
    edges = servers.where("s.command is not null").select(F.col("id").alias("src"), command.alias("dst"), F.lit("references").alias("relation"))
    return Graph(nodes.distinct(), edges.unionByName(env.select(F.col("id").alias("src"), variable.alias("dst"), F.lit("requires_env").alias("relation"))).distinct())


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line) of texts."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))


def headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, level, title, parent_pos, body_lines): headings outside fenced blocks, each with the nearest earlier one of a smaller level."""
    rows = lines(docs, key, text)
    by_doc = Window.partitionBy(key).orderBy("pos")
    upto = by_doc.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.sum(F.col("line").rlike(r"^\s*(```|~~~)").cast("int")).over(upto)
    rows = rows.withColumn("fenced", fence % 2 == 1)
    is_heading = F.col("line").rlike(r"^#{1,6}\s+\S") & ~F.col("fenced")
    found = rows.withColumn("level", F.when(is_heading, F.length(F.regexp_extract("line", r"^(#{1,6})", 1))))
    found = found.withColumn("section", F.count("level").over(upto))
    sizes = found.where("section > 0").groupBy(key, "section").agg((F.count(F.lit(1)) - 1).alias("body_lines"))
    heads = found.where("level is not null").join(sizes, [key, "section"])
    last = lambda k: F.last(F.when(F.col("level") == k, F.col("pos")), True).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    parent = F.greatest(*(F.when(F.col("level") > k, last(k)) for k in range(1, 6)))
    return heads.select(key, "pos", "level", F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")).alias("title"), parent.alias("parent_pos"), "body_lines")


def links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, target, relation): the documents a text links to, each once; external links and other endings are left out."""
    raw = F.explode(F.concat(
        F.regexp_extract_all(F.col(text), F.lit(r"\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1)), F.regexp_extract_all(F.col(text), F.lit(r"\[\[([^\]|#]+)"), F.lit(1)),
        F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\[[^\]]+\]:\s*(\S+)"), F.lit(1)),
    ))
    rows = docs.where(F.col(text).isNotNull()).select(key, raw.alias("raw")).where(~F.col("raw").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"))
    clean = F.regexp_replace("raw", r"[#?].*$", "")
    target = F.when(clean.rlike(r"\.[A-Za-z0-9]+$"), clean).otherwise(F.concat(clean, F.lit(".md")))
    rows = rows.where(clean != "").select(key, target.alias("target"), F.when(F.instr("raw", "#") > 1, "references_heading").otherwise("references").alias("relation"))
    return rows.where(F.col("target").rlike(r"(?i)\.(md|mdx|qmd|rst|txt)$")).groupBy(key, "target").agg(F.max("relation").alias("relation"))


def linked_spans(text: Column) -> Column:
    """``text`` with code spans that name a document turned into links to it."""
    return F.regexp_replace(text, r"`([^`\s]+\.(?:md|mdx|qmd|rst|txt))`", "[$1]($1)")
