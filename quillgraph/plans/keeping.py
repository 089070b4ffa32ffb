"""Queries on merging, resolving, reviewing and streaming, and on the relational tables as graphs, with their SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import predicates as P
from quillgraph.functions import vocabulary as V
from quillgraph.functions.ids import canonical_id
from quillgraph.operators import analyze as A
from quillgraph.operators import build as B
from quillgraph.operators import dedup as D
from quillgraph.operators import merge as M
from quillgraph.operators import resolve as R
from quillgraph.operators import upkeep as U
from quillgraph.operators.walks import components
from quillgraph.plans.graphs import EDGES, GRAPH, NODES, canon, code_edges, code_graph, code_nodes, listed, sql_path
from quillgraph.sources import adapters, files, formats
from quillgraph.sources.extract import extract
from quillgraph.streaming import live
from quillgraph.session import cut, table

SPLIT_AT = "2025-01-01"
NOW = "2024-03-01"


def trade_degree(spark: SparkSession, folder: str) -> DataFrame:
    g = adapters.trade_graph(spark, folder)
    return A.degrees(g.nodes, g.edges)


def trade_hubs(spark: SparkSession, folder: str) -> DataFrame:
    g = adapters.trade_graph(spark, folder)
    return A.degrees(g.nodes, g.edges).join(g.nodes, "id").select("kind", "id", "degree").orderBy(F.desc("degree"), "id").limit(20)


def co_ordered_parts(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.co_ordered(spark, folder).where("weight > 1")


def co_ordered_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of parts that keep being ordered together."""
    edges = cut(adapters.co_ordered(spark, folder).where("weight > 1"), "together")
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return components(ids, edges)


def co_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as commits, parts as files: what changes with what."""
    commits = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"))
    return U.co_changes(commits, commits, least=0.02).select("target", "file", "together", F.round("share", 9).alias("share"))


def similar_labels(spark: SparkSession, folder: str) -> DataFrame:
    return D.similar_labels(code_nodes(spark, folder)).select("a", "b", F.round("score", 4).alias("score"))


def merged_entities(spark: SparkSession, folder: str) -> DataFrame:
    n = cut(code_nodes(spark, folder), "nodes")
    pairs = cut(D.similar_labels(n), "pairs")
    return D.winners(n, pairs)


def _by_file(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "extraction")
    return e.select("rec_id", canonical_id(F.col("id")).alias("id"), "label", F.regexp_replace(P.source_path(F.col("source_file")), r"^(\./+)+", "").alias("source_file"), "extracted_at")


def incremental_merge(spark: SparkSession, folder: str) -> DataFrame:
    """What was extracted before a day, its files replaced by what came later."""
    rows = _by_file(spark, folder)
    day = F.lit(SPLIT_AT).cast("timestamp")
    return M.replace_sources(rows.where(F.col("extracted_at") < day), rows.where(F.col("extracted_at") >= day)).select("rec_id", "id", "source_file")


def newest_records(spark: SparkSession, folder: str) -> DataFrame:
    return M.last_of(_by_file(spark, folder).where("id != ''"), ["id"], ["extracted_at", "rec_id"]).select("id", "rec_id")


def merged_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the parser first, then all others, one for each id."""
    rows = table(spark, folder, "extraction").select(canonical_id(F.col("id")).alias("id"), "rec_id", "origin").where("id != ''")
    parsed = F.coalesce(F.col("origin") == "ast", F.lit(False))
    return M.union_fragments([rows.where(parsed), rows.where(~parsed)], ["id"], ["rec_id"]).select("id", "rec_id")


def backlinks(spark: SparkSession, folder: str) -> DataFrame:
    return M.backlinks(code_graph(spark, folder).edges)


def composed_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed and inferred edges as graphs of two repositories, composed."""
    g = code_graph(spark, folder)
    sure = F.col("confidence") == "EXTRACTED"
    parts = [M.prefixed(B.Graph(g.nodes.select("id", "label"), g.edges.where(t).select("src", "dst", "relation")), name) for name, t in (("sure", sure), ("guess", ~sure))]
    both = M.composed(parts)
    return both.edges.groupBy("src", "dst", "relation").agg(F.count(F.lit(1)).alias("edges"))


def community_offsets(spark: SparkSession, folder: str) -> DataFrame:
    rows = code_nodes(spark, folder).where("source_file is not null")
    sizes = rows.groupBy(P.top_directory(F.col("source_file")).alias("repo")).agg((F.count_distinct("source_file") - 1).alias("community"))
    return M.community_offsets(sizes)


def manifest_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Files of all records against those of the records before a day."""
    rows = _by_file(spark, folder).where("source_file is not null")

    def state(df: DataFrame) -> DataFrame:
        return df.groupBy(F.col("source_file").alias("path")).agg(F.count(F.lit(1)).cast("string").alias("hash"), F.unix_seconds(F.max("extracted_at").cast("timestamp")).cast("double").alias("mtime"))

    old = state(rows.where(F.col("extracted_at") < F.lit(SPLIT_AT).cast("timestamp")))
    late = state(rows.where(F.col("extracted_at") >= F.lit("2024-06-01").cast("timestamp")))
    return M.manifest_changes(late, old.withColumn("stamped", F.col("mtime") + 60).withColumn("alive", F.col("path").endswith(".md")))


def resolved_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Call edges taken back to names and resolved again."""
    g = code_graph(spark, folder)
    calls = g.edges.where("relation = 'calls'").join(g.nodes.select(F.col("id").alias("dst"), F.regexp_replace(F.regexp_replace("label", r"\(\)$", ""), r"^\.", "").alias("callee")), "dst")
    return R.resolve_calls(calls.select(F.col("edge_id").alias("call_id"), F.col("src").alias("caller"), F.col("source_file").alias("file"), "callee"), R.symbols(g.nodes))


def stubs(spark: SparkSession, folder: str) -> DataFrame:
    """Callees as call sites know them, by label and without a file, and the nodes they stand for."""
    g = code_graph(spark, folder)
    callees = g.edges.where("relation = 'calls'").select(F.col("dst").alias("id")).distinct().join(g.nodes.select("id", "label"), "id")
    sites = callees.select(F.concat(F.lit("site:"), "id").alias("id"), "label", F.lit(None).cast("string").alias("source_file"))
    return R.stub_map(g.nodes.select("id", "label", "source_file").unionByName(sites))


def declarations(spark: SparkSession, folder: str) -> DataFrame:
    """C classes, with a header beside each file that declares its classes again."""
    n = code_nodes(spark, folder).select("id", "label", "node_kind", "source_file")
    again = n.where((F.col("node_kind") == "class") & F.col("source_file").rlike(r"\.(c|cpp|m)$"))
    again = again.select(F.concat("id", F.lit("_h")).alias("id"), "label", "node_kind", F.regexp_replace("source_file", r"\.\w+$", ".h").alias("source_file"))
    return R.declaration_map(n.unionByName(again))


def distinct_ids(spark: SparkSession, folder: str) -> DataFrame:
    return R.distinct_ids(B.clean_nodes(table(spark, folder, "extraction")))


def shared_types(spark: SparkSession, folder: str) -> DataFrame:
    n = code_nodes(spark, folder).where("node_kind = 'class' and source_file is not null")
    return R.shared_types(n.select("id", F.col("label").alias("name"), P.top_directory(F.col("source_file")).alias("repo")))


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    """What documents mention in code spans, their node's label as a closing span among it."""
    n = code_nodes(spark, folder)
    docs = table(spark, folder, "documents").select("doc_id", "text", "node_id").join(n.select(F.col("id").alias("node_id"), "label"), "node_id", "left")
    return R.mentions(docs.select("doc_id", F.concat_ws("", "text", F.concat(F.lit("\n`"), "label", F.lit("`"))).alias("text")), n)


def lint(spark: SparkSession, folder: str) -> DataFrame:
    return U.lint(code_edges(spark, folder), code_nodes(spark, folder))


def lessons(spark: SparkSession, folder: str) -> DataFrame:
    rows = U.lessons(adapters.event_signals(spark, folder), F.lit(NOW), 30.0, 2, "area")
    return rows.select("area", "node", "pos", "neg", (F.round("score", 5) + 0.0).alias("score"), "verdict")


def running_lessons(spark: SparkSession, folder: str) -> DataFrame:
    rows = live.running_score(adapters.event_signals(spark, folder), 30.0)
    return rows.groupBy("node").agg(F.round(F.sum("grown"), 4).alias("grown"))


def touched_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Each edge's line and the five after it as a change: the nodes that it touches."""
    line = P.line_number(F.col("source_location"))
    hunks = code_edges(spark, folder).where("source_file is not null").select(F.col("edge_id").alias("diff_id"), F.col("source_file").alias("file"), line.alias("first"), (line + 5).alias("last")).where("first is not null")
    return U.touched(hunks, U.spans(code_nodes(spark, folder)))


def change_impact(spark: SparkSession, folder: str) -> DataFrame:
    """Each day's records as a change: nodes and kinds of nodes it touches."""
    n = code_nodes(spark, folder)
    changes = _by_file(spark, folder).where("source_file is not null").select(F.date_format("extracted_at", "yyyy-MM-dd").alias("change"), F.col("source_file").alias("file"))
    return U.change_impact(changes, n, n.select("id", F.col("node_kind").alias("community")))


def budget_fit(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each repository that fit 4,000 estimated tokens, newest first."""
    docs = table(spark, folder, "documents").select("doc_id", "repo", "updated_at", F.floor(F.coalesce(F.length("text"), F.lit(0)) / 4).alias("cost"))
    return U.fit_budget(docs, "repo", "cost", [F.desc("updated_at"), F.col("doc_id")], 4000).select("doc_id", "repo", "upto")


def stale_sources(spark: SparkSession, folder: str) -> DataFrame:
    scanned = _by_file(spark, folder).where(F.col("extracted_at") >= F.lit(SPLIT_AT).cast("timestamp")).select(F.col("source_file").alias("path"))
    evidence = _by_file(spark, folder).select(F.col("source_file").alias("path"))
    return files.stale_sources(code_nodes(spark, folder), scanned, evidence)


def debounced(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's events in batches that a pause of a day ends."""
    e = table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"), F.col("event_type").alias("kind"), "user_id")
    rows = live.batches(e, "1 day", by="user_id")
    return rows.select("user_id", F.unix_micros("from").alias("from_us"), F.unix_micros("to").alias("to_us"), F.array_join("paths", ",").alias("paths"))


def document_headings(spark: SparkSession, folder: str) -> DataFrame:
    return formats.headings(table(spark, folder, "documents"))


def document_links(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that texts link to; code spans that name a document are links."""
    docs = table(spark, folder, "documents").select("doc_id", formats.linked_spans(F.col("text")).alias("text"))
    return formats.links(docs)


def file_classes(spark: SparkSession, folder: str) -> DataFrame:
    n = code_nodes(spark, folder).where("source_file is not null").select(F.col("source_file").alias("path")).distinct()
    rules = ["*.min.js", "dist/", "!dist/keep.js", "/gen/**", "**/node_modules/"]
    return n.select("path", files.file_class(F.col("path")).alias("class")).join(files.ignored(n, rules), "path")


def noise_files(spark: SparkSession, folder: str) -> DataFrame:
    n = code_nodes(spark, folder).where("source_file is not null").select(F.col("source_file").alias("path")).distinct()
    return files.noise(n)


def extracted_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """What the extractors find in the contents of the file nodes."""
    rows = code_nodes(spark, folder).where("node_kind = 'file' and source_file is not null").groupBy(F.col("source_file").alias("path")).agg(F.min("content").alias("text"))
    return extract(rows).nodes.groupBy("node_kind").agg(F.count(F.lit(1)).alias("nodes"))


def cypher_statements(spark: SparkSession, folder: str) -> DataFrame:
    return formats.cypher_lines(code_graph(spark, folder))


def graph_json(spark: SparkSession, folder: str) -> DataFrame:
    g = code_graph(spark, folder)
    return formats.graph_json_lines(B.Graph(g.nodes.select("id", "label", "file_type", "source_file"), g.edges.select("src", "dst", "relation", "confidence")))


QUERIES = {f.__name__: f for f in (
    trade_degree, trade_hubs, co_ordered_parts, co_ordered_groups, co_changes, similar_labels, merged_entities, incremental_merge, newest_records, merged_fragments, backlinks,
    composed_graph, community_offsets, manifest_delta, resolved_calls, stubs, declarations, distinct_ids, shared_types, mentions, lint, lessons, running_lessons, touched_nodes,
    change_impact, budget_fit, stale_sources, debounced, document_headings, document_links, file_classes, noise_files, extracted_fragments, cypher_statements, graph_json,
)}

# ---- the same in SQL

_TRADE = """
tn AS (SELECT 'region' AS kind, 'region:' || r_regionkey AS id FROM region UNION ALL SELECT 'nation', 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'customer', 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'supplier', 'supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'part', 'part:' || p_partkey FROM part),
te AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey FROM lineitem),
td AS (SELECT kind, tn.id, coalesce(d, 0) AS degree FROM tn LEFT JOIN (SELECT id, count(*) AS d FROM (SELECT src AS id FROM te UNION ALL SELECT dst FROM te) GROUP BY id) USING (id))"""

_TOGETHER = """co AS (SELECT 'part:' || a.l_partkey AS src, 'part:' || b.l_partkey AS dst, count(*) AS weight FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a
  JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL HAVING count(*) > 1)"""

_FILES = f"""f AS (SELECT rec_id, {canon("id")} AS id, label, {sql_path("source_file")} AS source_file, extracted_at FROM extraction)"""

_SAME = "(a = b OR ends_with(a, '/' || b) OR ends_with(b, '/' || a))"
_LINE = "TRY_CAST(regexp_extract(coalesce(source_location, ''), 'L?([0-9]+)', 1) AS INTEGER)"
_DECAY = f"power(0.5, greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400000000.0) / 30.0)"

ORACLES = {
    "trade_degree": f"WITH {_TRADE} SELECT id, degree FROM td",
    "trade_hubs": f"WITH {_TRADE} SELECT * FROM td ORDER BY degree DESC, id LIMIT 20",
    "co_ordered_parts": f"WITH {_TOGETHER} SELECT * FROM co",
    "co_ordered_groups": f"""WITH RECURSIVE {_TOGETHER}, b AS MATERIALIZED (SELECT src, dst FROM co UNION SELECT dst, src FROM co),
      r AS (SELECT src AS id, src AS other FROM b UNION SELECT r.id, b.dst FROM r JOIN b ON b.src = r.other) SELECT id, min(other) AS component FROM r GROUP BY id""",
    "co_changes": """WITH c AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), t AS (SELECT p, count(*) AS n FROM c GROUP BY p),
      x AS (SELECT a.p AS target, b.p AS file, count(*) AS together FROM c a JOIN c b ON a.o = b.o AND a.p <> b.p GROUP BY ALL),
      y AS (SELECT target, file, together, together / n AS share, row_number() OVER (PARTITION BY target ORDER BY together DESC, file) AS r FROM x JOIN t ON t.p = target WHERE together / n >= 0.02)
      SELECT target, file, together, round(share, 9) AS share FROM y WHERE r <= 4""",
    "incremental_merge": f"""WITH {_FILES}, new AS (SELECT * FROM f WHERE extracted_at >= TIMESTAMP '{SPLIT_AT}') SELECT rec_id, id, source_file FROM new
      UNION ALL SELECT rec_id, id, source_file FROM f WHERE extracted_at < TIMESTAMP '{SPLIT_AT}' AND (source_file IS NULL OR source_file NOT IN (SELECT source_file FROM new WHERE source_file IS NOT NULL))""",
    "newest_records": f"WITH {_FILES} SELECT id, rec_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY extracted_at DESC NULLS LAST, rec_id DESC) AS r FROM f WHERE id <> '') WHERE r = 1",
    "merged_fragments": f"""SELECT id, rec_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(origin, '') <> 'ast', rec_id) AS r FROM (SELECT {canon("id")} AS id, rec_id, origin FROM extraction) WHERE id <> '') WHERE r = 1""",
    "backlinks": f"""WITH {GRAPH}, h AS (SELECT DISTINCT src, dst, relation FROM e), b AS (SELECT dst AS src, src AS dst, 'backlink:' || relation AS relation, relation AS forward FROM h)
      SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.src = b.src AND h.dst = b.dst AND h.relation = b.relation)""",
    "composed_graph": f"""WITH {GRAPH}, p AS (SELECT CASE WHEN confidence = 'EXTRACTED' THEN 'sure::' ELSE 'guess::' END AS r, * FROM e) SELECT r || src AS src, r || dst AS dst, relation, count(*) AS edges FROM p GROUP BY ALL""",
    "community_offsets": f"""WITH {NODES}, s AS (SELECT split_part(source_file, '/', 1) AS repo, count(DISTINCT source_file) AS n FROM n WHERE source_file IS NOT NULL GROUP BY ALL)
      SELECT repo, CAST(coalesce(sum(n) OVER (ORDER BY repo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM s""",
    "manifest_delta": f"""WITH {_FILES}, g AS (SELECT source_file AS path, count(*) FILTER (extracted_at < TIMESTAMP '{SPLIT_AT}') AS oc, max(extracted_at) FILTER (extracted_at < TIMESTAMP '{SPLIT_AT}') AS om,
      count(*) FILTER (extracted_at >= TIMESTAMP '2024-06-01') AS nc, max(extracted_at) FILTER (extracted_at >= TIMESTAMP '2024-06-01') AS nm FROM f WHERE source_file IS NOT NULL GROUP BY ALL)
      SELECT path, CASE WHEN oc = 0 THEN 'new' WHEN nc = 0 THEN CASE WHEN ends_with(path, '.md') THEN 'excluded' ELSE 'deleted' END WHEN date_trunc('second', om) = date_trunc('second', nm) OR oc = nc THEN 'unchanged' ELSE 'changed' END AS state FROM g""",
    "stubs": f"""WITH {GRAPH}, r AS (SELECT id, label FROM n WHERE coalesce(source_file, '') <> ''),
      s AS (SELECT id AS stub, label FROM n WHERE coalesce(source_file, '') = '' UNION ALL SELECT DISTINCT 'site:' || id, label FROM n WHERE id IN (SELECT dst FROM e WHERE relation = 'calls')),
      x AS (SELECT label AS k, min(id) AS real FROM r GROUP BY label HAVING count(DISTINCT id) = 1), y AS (SELECT lower(label) AS k, min(id) AS real FROM r GROUP BY lower(label) HAVING count(DISTINCT id) = 1),
      a AS (SELECT stub, real FROM s JOIN x ON k = label) SELECT * FROM a UNION ALL SELECT stub, real FROM s JOIN y ON k = lower(label) WHERE stub NOT IN (SELECT stub FROM a)""",
    "declarations": rf"""WITH {NODES}, a AS (SELECT id, label, node_kind, source_file FROM n UNION ALL SELECT id || '_h', label, node_kind, regexp_replace(source_file, '\.\w+$', '.h') FROM n WHERE node_kind = 'class' AND regexp_matches(source_file, '\.(c|cpp|m)$')),
      c AS (SELECT id, label, regexp_replace(source_file, '\.(h|hh|hpp|hxx|c|cc|cpp|cxx|m|mm)$', '') AS stem FROM a WHERE node_kind = 'class' AND regexp_matches(source_file, '\.(h|hh|hpp|hxx|c|cc|cpp|cxx|m|mm)$'))
      SELECT id, survivor FROM (SELECT id, min(id) OVER (PARTITION BY stem, label) AS survivor FROM c) WHERE id <> survivor""",
    "distinct_ids": f"""WITH d AS (SELECT DISTINCT {canon("id")} AS id, coalesce({sql_path("source_file")}, '') AS source_file FROM extraction)
      SELECT id, source_file, CASE WHEN source_file = min(source_file) OVER (PARTITION BY id) THEN id ELSE id || '_' || substr(sha256(source_file), 1, 8) END AS new_id FROM d WHERE id <> ''""",
    "shared_types": f"""WITH {NODES}, c AS (SELECT id, label AS name, split_part(source_file, '/', 1) AS repo FROM n WHERE node_kind = 'class' AND source_file IS NOT NULL),
      b AS (SELECT name, arg_min(repo, id) AS r0, min(id) AS first FROM c GROUP BY name HAVING count(DISTINCT repo) > 1) SELECT first AS src, id AS dst FROM c JOIN b USING (name) WHERE repo <> r0""",
    "mentions": rf"""WITH {NODES}, t AS (SELECT doc_id, concat(text, chr(10) || '`' || label || '`') AS text FROM documents LEFT JOIN n ON n.id = node_id), s AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '`([^`\n]{{2,120}})`', 1)) AS mention FROM t), m AS (SELECT doc_id, mention, lower(regexp_replace(mention, '\(.*\)$', '')) AS key FROM s),
      k AS (SELECT id, unnest([id, lower(regexp_replace(label, '\(\)$', '')), lower(regexp_extract(coalesce(source_file, ''), '[^/]*$'))]) AS key FROM n),
      u AS (SELECT key, min(id) AS id FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT id) = 1) SELECT doc_id, id, mention FROM m JOIN u USING (key)""",
    "lint": rf"""WITH {NODES}, {EDGES}, c AS (SELECT *, regexp_replace(regexp_replace(label, '^[()]+|[()]+$', '', 'g'), '^\.+', '') AS name, lower(regexp_extract(coalesce(source_file, ''), '[^/]*$')) AS file, coalesce(source_file, '') AS sf FROM n)
      SELECT 'dangling_reference' AS rule, 'error' AS severity, src AS subject, 'source ' || relation AS detail FROM e0 WHERE src NOT IN (SELECT id FROM n)
      UNION ALL SELECT 'dangling_reference', 'error', dst, 'target ' || relation FROM e0 WHERE dst NOT IN (SELECT id FROM n)
      UNION ALL SELECT 'orphan_node', 'info', id, label FROM n WHERE id NOT IN (SELECT src FROM e0 UNION SELECT dst FROM e0)
      UNION ALL SELECT 'dead_code', 'warning', id, name FROM c WHERE file_type = 'code' AND node_kind IN ('function', 'method', 'class') AND name <> '' AND NOT (starts_with(name, '__') AND ends_with(name, '__'))
        AND name NOT IN {listed(V.ENTRY_NAMES)} AND NOT (starts_with(file, 'test_') OR ends_with(file, '_test.py') OR contains(sf, '/tests/') OR contains(sf, '/test/') OR starts_with(name, 'test_'))
        AND id NOT IN (SELECT dst FROM e0 WHERE src <> dst AND relation IN {listed(V.DEAD_CODE_INBOUND)})""",
    "lessons": f"""WITH s AS (SELECT strftime(ts, '%a') AS area, 'user:' || user_id AS node, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 END AS sign, {_DECAY} AS w FROM events),
      g AS (SELECT area, node, count(*) FILTER (sign > 0) AS pos, count(*) FILTER (sign < 0) AS neg, sum(sign * w) AS score FROM s WHERE sign IS NOT NULL GROUP BY GROUPING SETS ((area, node), (node)))
      SELECT area, node, pos, neg, round(score, 5) + 0.0 AS score, CASE WHEN pos > 0 AND neg > 0 THEN 'contested: ' || CASE WHEN round(score, 6) > 0 THEN 'useful' WHEN round(score, 6) < 0 THEN 'dead end' ELSE 'even' END
        WHEN pos >= 2 THEN 'preferred' WHEN pos > 0 THEN 'tentative' ELSE 'dead end' END AS verdict FROM g""",
    "running_lessons": """SELECT 'user:' || user_id AS node, round(sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END * power(2.0, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0 / 30.0)), 4) AS grown FROM events GROUP BY ALL""",
    "touched_nodes": f"""WITH {NODES}, {EDGES}, h AS (SELECT edge_id AS diff_id, source_file AS a, {_LINE} AS first FROM e0 WHERE source_file IS NOT NULL),
      l AS (SELECT id, source_file AS b, {_LINE} AS first FROM n WHERE source_file IS NOT NULL),
      s AS (SELECT id, b, first, CASE WHEN lead(first) OVER (PARTITION BY b ORDER BY first, id) IS NULL THEN 2147483647 ELSE greatest(lead(first) OVER (PARTITION BY b ORDER BY first, id) - 1, first) END AS last FROM l WHERE first IS NOT NULL UNION ALL SELECT id, b, NULL, NULL FROM l WHERE first IS NULL)
      SELECT DISTINCT diff_id, id FROM h JOIN s ON regexp_extract(a, '[^/]*$') = regexp_extract(b, '[^/]*$') AND {_SAME} AND (s.first IS NULL OR (s.first <= h.first + 5 AND s.last >= h.first)) WHERE h.first IS NOT NULL""",
    "change_impact": f"""WITH {NODES}, {_FILES}, c AS (SELECT DISTINCT strftime(extracted_at, '%Y-%m-%d') AS change, source_file AS a FROM f WHERE source_file IS NOT NULL), d AS (SELECT id, source_file AS b, node_kind FROM n WHERE source_file IS NOT NULL),
      h AS (SELECT DISTINCT change, id, node_kind FROM c JOIN d ON regexp_extract(a, '[^/]*$') = regexp_extract(b, '[^/]*$') AND {_SAME}) SELECT change, count(*) AS nodes, count(DISTINCT node_kind) AS communities FROM h GROUP BY change""",
    "budget_fit": """SELECT doc_id, repo, CAST(upto AS BIGINT) AS upto FROM (SELECT doc_id, repo, sum(length(coalesce(text, '')) // 4) OVER (PARTITION BY repo ORDER BY updated_at DESC NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM documents) WHERE upto <= 4000""",
    "stale_sources": f"""WITH {NODES}, {_FILES} SELECT DISTINCT source_file FROM n WHERE source_file IS NOT NULL AND source_file NOT IN (SELECT source_file FROM f WHERE source_file IS NOT NULL AND extracted_at >= TIMESTAMP '{SPLIT_AT}')
      AND source_file IN (SELECT source_file FROM f WHERE source_file IS NOT NULL)""",
    "debounced": """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
      SELECT user_id, epoch_us(min(ts)) AS from_us, epoch_us(max(ts) + INTERVAL 1 DAY) AS to_us, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM s GROUP BY user_id, session""",
}

_EXT = "lower(CASE WHEN contains(regexp_extract(path, '[^/]*$'), '.') THEN regexp_extract(path, '[^.]*$') ELSE '' END)"
_PATHS = "f AS (SELECT DISTINCT source_file AS path FROM n WHERE source_file IS NOT NULL)"
_FIELD = lambda c, name: f"""'"{name}":' || CAST(to_json({c}) AS VARCHAR)"""
_QUOTED = lambda c: rf"""replace(replace(regexp_replace(coalesce({c}, ''), '[\r\n]+', ' ', 'g'), '\', '\\'), '''', '\''')"""

_TESTED = lambda p: f"(contains(lower({p}), 'test_') OR contains(lower({p}), '_test') OR contains(lower({p}), 'tests/'))"
_FAMILY = lambda p: "CASE " + " ".join(f"WHEN {_EXT.replace('path', p)} IN {listed(v)} THEN '{k}'" for k, v in V.EDGE_FAMILIES.items()) + " END"
_DIRS = lambda p: f"string_split({p}, '/')[:-2]"

ORACLES |= {
    "resolved_calls": rf"""WITH {GRAPH}, c AS (SELECT e.edge_id AS call_id, src AS caller, coalesce(e.source_file, '') AS ff, lower(regexp_replace(regexp_replace(n.label, '\(\)$', ''), '^\.', '')) AS name, {_FAMILY("coalesce(e.source_file, '')")} AS fam
        FROM e JOIN n ON n.id = e.dst WHERE e.relation = 'calls'),
      d AS (SELECT lower(regexp_replace(regexp_replace(label, '\(\)$', ''), '^\.', '')) AS name, id, source_file AS df, {_FAMILY("source_file")} AS family FROM n WHERE node_kind IN ('function', 'method', 'class') AND source_file IS NOT NULL),
      x AS (SELECT *, list_transform(range(1, greatest(len({_DIRS("ff")}), len({_DIRS("df")})) + 1), lambda i: coalesce(({_DIRS("ff")})[i] = ({_DIRS("df")})[i], false)) AS same FROM c JOIN d USING (name)
        WHERE (fam IS NULL OR family IS NULL OR fam = family) AND id <> caller),
      y AS (SELECT *, rank() OVER (PARTITION BY call_id ORDER BY {_TESTED("ff")} = {_TESTED("df")} DESC, ff = df DESC, regexp_replace(ff, '/[^/]*$', '') = regexp_replace(df, '/[^/]*$', '') DESC,
        coalesce(list_position(same, false) - 1, len(same)) DESC) AS place FROM x)
      SELECT call_id, min(caller) AS caller, min(id) AS target, 'INFERRED' AS confidence, 0.85::DOUBLE AS score FROM y WHERE place = 1 GROUP BY call_id HAVING count(DISTINCT id) = 1""",
    "document_headings": r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
      f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS fenced FROM l),
      h AS (SELECT *, CASE WHEN NOT fenced AND regexp_matches(line, '^#{1,6}\s+\S') THEN length(regexp_extract(line, '^(#{1,6})', 1)) END AS level FROM f),
      s AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h),
      b AS (SELECT doc_id, section, count(*) - 1 AS body_lines FROM s WHERE section > 0 GROUP BY ALL),
      p AS (SELECT x.doc_id, x.pos, max(y.pos) AS parent_pos FROM s x JOIN s y ON y.doc_id = x.doc_id AND y.pos < x.pos AND y.level < x.level GROUP BY ALL)
      SELECT s.doc_id, CAST(s.pos AS INTEGER) AS pos, CAST(level AS INTEGER) AS level, trim(regexp_replace(line, '^#{1,6}\s+', '')) AS title, CAST(parent_pos AS INTEGER) AS parent_pos, body_lines
      FROM s JOIN b USING (doc_id, section) LEFT JOIN p ON p.doc_id = s.doc_id AND p.pos = s.pos WHERE level IS NOT NULL""",
    "document_links": r"""WITH t AS (SELECT doc_id, regexp_replace(text, '`([^`\s]+\.(?:md|mdx|qmd|rst|txt))`', '[\1](\1)', 'g') AS text FROM documents WHERE text IS NOT NULL),
      r AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '\[[^\]]*\]\(([^)\s]+)[^)]*\)', 1), regexp_extract_all(text, '\[\[([^\]|#]+)', 1), regexp_extract_all(text, '(?m)^\[[^\]]+\]:\s*(\S+)', 1))) AS raw FROM t),
      c AS (SELECT doc_id, raw, regexp_replace(raw, '[#?].*$', '') AS clean FROM r WHERE NOT regexp_matches(raw, '^[a-zA-Z][a-zA-Z0-9+.-]*:')),
      g AS (SELECT doc_id, CASE WHEN regexp_matches(clean, '\.[A-Za-z0-9]+$') THEN clean ELSE clean || '.md' END AS target, CASE WHEN instr(raw, '#') > 1 THEN 'references_heading' ELSE 'references' END AS relation FROM c WHERE clean <> '')
      SELECT doc_id, target, max(relation) AS relation FROM g WHERE regexp_matches(target, '(?i)\.(md|mdx|qmd|rst|txt)$') GROUP BY ALL""",
    "file_classes": rf"""WITH {NODES}, {_PATHS}, b AS (SELECT path, lower(regexp_extract(path, '[^/]*$')) AS name, {_EXT} AS x FROM f)
      SELECT path, CASE WHEN name IN ('package.json', 'pyproject.toml', 'cargo.toml', 'go.mod', 'pom.xml', 'requirements.txt', 'poetry.lock', 'apm.yml') THEN 'manifest'
          WHEN starts_with(name, 'dockerfile') OR regexp_matches(name, '^(docker-)?compose.*\.ya?ml$') OR name IN ('chart.yaml', 'jenkinsfile') OR contains(path, '/.github/workflows/') THEN 'infrastructure'
          WHEN x IN {listed(V.CODE_ENDINGS)} THEN 'code' WHEN x IN {listed([*V.DOCUMENT_ENDINGS, "pdf", "html", "yaml", "yml", "toml"])} THEN 'document' WHEN x IN {listed(V.IMAGE_ENDINGS)} THEN 'image' END AS class,
        regexp_matches(path, '(^|/)[^/]*\.min\.js(/.*)?$') OR (regexp_matches(path, '(^|/)dist/.') AND NOT regexp_matches(path, '^dist/keep\.js(/.*)?$'))
          OR regexp_matches(path, '^gen/.') OR regexp_matches(path, '^(.*/)?node_modules/.') AS ignored FROM b""",
    "noise_files": rf"""WITH {NODES}, {_PATHS}, b AS (SELECT path, {_EXT} AS x, regexp_extract(path, '^(.*?(?:^|/)(?:{"|".join(files.BUILD_DIRECTORIES)}))/', 1) AS build, list_transform(string_split(path, '/'), lambda p: lower(p)) AS parts FROM f)
      SELECT path FROM b WHERE len(list_filter(parts[:-2], lambda p: p IN {listed(files.NOISE_DIRECTORIES)})) > 0 OR (build <> '' AND build IN (SELECT build FROM b WHERE x IN {listed(files.BUILD_ENDINGS)}))""",
    "cypher_statements": rf"""WITH {GRAPH} SELECT 'MERGE (n:Node {{id: ''' || {_QUOTED("id")} || '''}}) SET n.label = ''' || {_QUOTED("label")} || ''';' AS statement FROM n
      UNION ALL SELECT 'MATCH (a:Node {{id: ''' || {_QUOTED("src")} || '''}}), (b:Node {{id: ''' || {_QUOTED("dst")} || '''}}) MERGE (a)-[:' || regexp_replace(upper(relation), '[^A-Z0-9_]', '_', 'g') || ']->(b);' FROM e""".replace("\\'\\'", "''").replace("''", "''"),
    "graph_json": f"""WITH {GRAPH} SELECT 'nodes' AS part, '{{' || concat_ws(',', {", ".join(_FIELD(c, c) for c in ("file_type", "id", "label", "source_file"))}) || '}}' AS json FROM n
      UNION ALL SELECT 'links', '{{' || concat_ws(',', {", ".join(_FIELD(c, n) for c, n in (("confidence", "confidence"), ("relation", "relation"), ("src", "source"), ("dst", "target")))}) || '}}' FROM e""",
}
