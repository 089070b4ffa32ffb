"""Queries that tell about the code graph, with their SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import code as K
from quillgraph.functions import predicates as P
from quillgraph.functions import vocabulary as V
from quillgraph.operators import briefing as B
from quillgraph.operators import build as G
from quillgraph.operators import resolve as R
from quillgraph.operators import search as S
from quillgraph.plans.graphs import GRAPH, NODES, canon, code_graph, code_nodes, listed
from quillgraph.session import cut, table


def _area(nodes: DataFrame) -> DataFrame:
    return nodes.where("source_file is not null").select("id", P.top_directory(F.col("source_file")).alias("community"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    g = code_graph(spark, folder)
    g = G.Graph(cut(g.nodes, "nodes"), cut(g.edges, "edges"))
    return B.questions(g, _area(g.nodes), top=20)


def community_links(spark: SparkSession, folder: str) -> DataFrame:
    g = code_graph(spark, folder)
    return B.community_links(_area(g.nodes), g.edges)


def edge_classes(spark: SparkSession, folder: str) -> DataFrame:
    g = code_graph(spark, folder)
    return B.classified_edges(_area(g.nodes), g.edges)


def area_top_labels(spark: SparkSession, folder: str) -> DataFrame:
    g = code_graph(spark, folder)
    return B.top_labels(_area(g.nodes), g)


def hyperedge_areas(spark: SparkSession, folder: str) -> DataFrame:
    n = code_nodes(spark, folder)
    kept = G.hyperedge_members(table(spark, folder, "hyperedges"), n)
    return B.hyperedge_communities(kept, _area(n)).select("id", F.array_join("communities", ",").alias("communities"))


def area_sections(spark: SparkSession, folder: str) -> DataFrame:
    g = code_graph(spark, folder)
    return B.sections(_area(g.nodes), g)


def diagram_edges(spark: SparkSession, folder: str) -> DataFrame:
    return B.diagram_edges(code_graph(spark, folder))


def entry_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return B.entry_nodes(code_graph(spark, folder))


def scoped_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The first class by id, looked up by its file and name."""
    n = code_nodes(spark, folder)
    first = n.where("node_kind = 'class' and source_file is not null").orderBy("id").select("source_file", "label").head()
    return B.scoped(n, f"{first.source_file}::{first.label}" if first else "none::none")


def token_savings(spark: SparkSession, folder: str) -> DataFrame:
    """What all node contents cost to read against those of files only."""
    return B.token_savings(code_nodes(spark, folder), F.col("content"), F.col("node_kind") == "file")


def briefing(spark: SparkSession, folder: str) -> DataFrame:
    g = code_graph(spark, folder)
    return B.briefing(g, S.bm25(S.fields(g.nodes), ["parser", "pipeline", "broken", "ledger"]))


def overview(spark: SparkSession, folder: str) -> DataFrame:
    g = code_graph(spark, folder)
    return B.overview(g, _area(g.nodes))


def indirect_calls(spark: SparkSession, folder: str) -> DataFrame:
    g = code_graph(spark, folder)
    return R.indirect_calls(g.edges.where("relation in ('references', 'uses')"), g.nodes, g.edges)


def document_twins(spark: SparkSession, folder: str) -> DataFrame:
    return R.twins(G.survivors(G.clean_nodes(table(spark, folder, "extraction"))))


def display_labels(spark: SparkSession, folder: str) -> DataFrame:
    return code_nodes(spark, folder).select("id", K.display_label(F.col("label"), F.col("node_kind")).alias("shown"))


def content_outlines(spark: SparkSession, folder: str) -> DataFrame:
    """Signatures and outlines of all node contents."""
    n = code_nodes(spark, folder).where("content is not null")
    return n.select("id", K.signature(F.col("content")).alias("signature"), F.length(K.skeleton(F.col("content"))).alias("outline_chars"))


def document_slices(spark: SparkSession, folder: str) -> DataFrame:
    return K.slices(table(spark, folder, "documents"), "doc_id", "text", 2000)


QUERIES = {f.__name__: f for f in (
    questions, community_links, edge_classes, area_top_labels, hyperedge_areas, area_sections, diagram_edges, entry_nodes, scoped_lookup, token_savings, briefing, overview,
    indirect_calls, document_twins, display_labels, content_outlines, document_slices,
)}

_AREA = "m AS (SELECT id, split_part(source_file, '/', 1) AS community FROM n WHERE source_file IS NOT NULL)"
_HITS = ", ".join(
    f"count(*) FILTER ({' OR '.join(f'''contains(t, '{w}')''' for w in words.split())}) AS {s}" for s, words in B.SECTIONS.items()
)

ORACLES = {
    "community_links": f"""WITH {GRAPH}, {_AREA}, x AS (SELECT u.community AS a, v.community AS b FROM e JOIN m u ON u.id = src JOIN m v ON v.id = dst WHERE u.community <> v.community)
      SELECT community, other, count(*) AS edges FROM (SELECT a AS community, b AS other FROM x UNION ALL SELECT b, a FROM x) GROUP BY ALL""",
    "edge_classes": f"""WITH {GRAPH}, {_AREA} SELECT CASE WHEN u.community IS NULL OR v.community IS NULL THEN 'orphan' WHEN u.community = v.community THEN 'intra' ELSE 'inter' END AS class, count(*) AS edges
      FROM e LEFT JOIN m u ON u.id = src LEFT JOIN m v ON v.id = dst GROUP BY 1""",
    "area_top_labels": f"""WITH {GRAPH}, {_AREA}, r AS (SELECT community, label, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS r FROM m JOIN deg USING (id) JOIN n USING (id))
      SELECT community, string_agg(label, ', ' ORDER BY r) AS labels FROM r WHERE r <= 5 GROUP BY community""",
    "hyperedge_areas": f"""WITH {NODES}, {_AREA}, u AS (SELECT id, {canon("x")} AS k FROM (SELECT id, unnest(nodes) AS x FROM hyperedges)), v AS (SELECT DISTINCT u.id, u.k, community FROM u JOIN n ON n.id = k LEFT JOIN m ON m.id = k),
      w AS (SELECT id FROM v GROUP BY id HAVING count(DISTINCT k) >= 2)
      SELECT id, string_agg(DISTINCT community, ',' ORDER BY community) AS communities FROM v WHERE id IN (SELECT id FROM w) GROUP BY id HAVING count(DISTINCT community) >= 2""",
    "area_sections": f"""WITH {NODES}, {_AREA}, c AS (SELECT community, {_HITS} FROM (SELECT community, lower(label || ' ' || coalesce(source_file, '')) AS t FROM m JOIN n USING (id)) GROUP BY community),
      g AS (SELECT *, greatest({", ".join(B.SECTIONS)}) AS hits FROM c)
      SELECT community, CASE WHEN hits < 2 THEN 'other' {" ".join(f"WHEN {s} = hits THEN '{s}'" for s in B.SECTIONS)} END AS section, hits FROM g""",
    "diagram_edges": f"""WITH {GRAPH} SELECT DISTINCT src, dst, relation, CAST(CASE WHEN confidence = 'EXTRACTED' THEN 2.0 ELSE 0.0 END + CASE WHEN relation IN ('calls', 'uses', 'method') THEN 1.0 WHEN relation IN ('imports', 'imports_from') THEN 0.6
      WHEN relation = 'contains' THEN -0.2 WHEN relation = 'rationale_for' THEN -0.6 ELSE 0.0 END AS DOUBLE) AS score FROM e ORDER BY score DESC, src, dst, relation LIMIT 40""",
    "entry_nodes": f"""WITH {GRAPH}, c AS (SELECT DISTINCT src, dst FROM e WHERE relation IN {listed(V.CALLS)} AND src <> dst), s AS (SELECT src AS id, 1 AS d FROM c UNION ALL SELECT dst, -1 FROM c)
      SELECT id, CAST(sum(d) AS BIGINT) AS surplus FROM s WHERE id IN (SELECT id FROM n WHERE file_type = 'code') GROUP BY id ORDER BY surplus DESC, id LIMIT 10""",
    "token_savings": f"""WITH {NODES}, t AS (SELECT CAST(sum(length(coalesce(content, '')) // 4) AS BIGINT) AS a, CAST(sum(CASE WHEN node_kind = 'file' THEN length(coalesce(content, '')) // 4 ELSE 0 END) AS BIGINT) AS b FROM n)
      SELECT a AS all_tokens, b AS shown_tokens, a / greatest(b, 1) AS ratio FROM t""",
    "indirect_calls": f"""WITH {GRAPH}, u AS (SELECT DISTINCT src, dst FROM e WHERE relation IN ('references', 'uses') AND src <> dst) SELECT src, dst, 'indirect_call' AS relation, CAST(0.85 AS DOUBLE) AS score FROM u
      WHERE dst IN (SELECT id FROM n WHERE node_kind IN ('function', 'method')) AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = u.src AND e.dst = u.dst AND relation IN ('calls', 'indirect_call'))""",
    "display_labels": f"""WITH {NODES}, p AS (SELECT *, CASE node_kind WHEN 'heading' THEN 'Heading:' WHEN 'tag' THEN 'Tag:' WHEN 'page' THEN 'Note:' ELSE '' END AS x FROM n)
      SELECT id, CASE WHEN starts_with(label, x) THEN label ELSE x || label END AS shown FROM p""",
}

ORACLES["scoped_lookup"] = rf"""WITH {NODES}, f AS (SELECT lower(trim(source_file)) AS file, lower(trim(label)) AS symbol FROM n WHERE node_kind = 'class' AND source_file IS NOT NULL ORDER BY id LIMIT 1),
  h AS (SELECT id, source_file FROM (SELECT n.*, lower(coalesce(source_file, '')) AS p FROM n) x, f WHERE lower(regexp_replace(regexp_replace(label, '[()]+$', ''), '^\.', '')) = symbol
    AND (p = file OR ends_with(p, '/' || file) OR ends_with(file, '/' || p)))
  SELECT id, source_file, (SELECT count(DISTINCT source_file) FROM h) = 1 AS certain FROM h"""
