"""The graphs that the queries run on, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import predicates as P
from quillgraph.functions import vocabulary as V
from quillgraph.operators.build import Graph, clean_edges, inside
from quillgraph.session import table


def code_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Indexed nodes and external symbols."""
    n = table(spark, folder, "node_metadata").select(
        F.col("node_id").alias("id"),
        F.coalesce("label", "node_id").alias("label"),
        P.file_type(F.col("file_type")).alias("file_type"),
        F.regexp_replace(P.source_path(F.col("source_path")), r"^(\./+)+", "").alias("source_file"),
        "source_location",
        "node_kind",
        "content",
    )
    x = table(spark, folder, "externals").select(
        F.col("ext_id").alias("id"), "label", F.lit("concept").alias("file_type"), F.lit(None).cast("string").alias("source_file"),
        F.lit(None).cast("string").alias("source_location"), F.lit("external").alias("node_kind"), F.lit(None).cast("string").alias("content"),
    )
    return n.unionByName(x)


def code_edges(spark: SparkSession, folder: str) -> DataFrame:
    return clean_edges(table(spark, folder, "edges"))


def code_graph(spark: SparkSession, folder: str) -> Graph:
    nodes = code_nodes(spark, folder)
    return Graph(nodes, inside(code_edges(spark, folder), nodes))


def canon(x: str) -> str:
    """The canonical id in SQL, for text that case folding beyond ``lower`` and NFKC leave as it is."""
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', '_', 'g'), '_')"


def listed(values: object) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def sql_path(x: str) -> str:
    return rf"regexp_replace(replace({x}, '\', '/'), '^(\./+)+', '')"


_SYNONYMS = " ".join(f"WHEN k = '{a}' THEN '{b}'" for a, b in V.FILE_TYPE_SYNONYMS.items())
_SCORES = " ".join(f"WHEN confidence = '{c}' THEN {s}" for c, s in V.CONFIDENCE_SCORES.items())

NODES = f"""
n AS (
  SELECT id, label, CASE WHEN k IN {listed(V.FILE_TYPES)} THEN k {_SYNONYMS} ELSE 'concept' END AS file_type, source_file, source_location, node_kind, content
  FROM (SELECT node_id AS id, coalesce(label, node_id) AS label, lower(trim(coalesce(file_type, ''))) AS k, {sql_path("source_path")} AS source_file,
               source_location, node_kind, content FROM node_metadata)
  UNION ALL SELECT ext_id, label, 'concept', NULL, NULL, 'external', NULL FROM externals)"""

EDGES = rf"""
e0 AS (
  SELECT edge_id, src, dst, relation, confidence,
         CASE WHEN confidence_score IS NULL OR isnan(confidence_score) OR confidence_score < 0 OR isinf(confidence_score) THEN CASE {_SCORES} END ELSE confidence_score END AS confidence_score,
         CASE WHEN weight IS NULL OR isnan(weight) OR weight < 0 OR isinf(weight) THEN 1.0 ELSE weight END AS weight,
         context, source_file, source_location, deferred, made_at
  FROM (SELECT edge_id, {canon("source")} AS src, {canon("target")} AS dst, {canon("relation")} AS relation,
               CASE WHEN upper(trim(confidence)) IN {listed(V.CONFIDENCE_SCORES)} THEN upper(trim(confidence)) ELSE 'EXTRACTED' END AS confidence,
               confidence_score, weight, lower(trim(context)) AS context, {sql_path("source_file")} AS source_file, source_location,
               coalesce(deferred, false) AS deferred, extracted_at AS made_at, row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at) AS rn
        FROM edges WHERE trim(source, E' \t\r\n') <> '' AND trim(target, E' \t\r\n') <> '')
  WHERE rn = 1)"""

GRAPH = f"""{NODES}, {EDGES},
e AS (SELECT * FROM e0 WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)),
deg AS (SELECT n.id, coalesce(d, 0) AS degree FROM (SELECT DISTINCT id FROM n) n
        LEFT JOIN (SELECT id, count(*) AS d FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) x USING (id))"""

_BASE = r"regexp_extract(source_file, '[^/]*$')"
KINDS = rf"""
k AS (
  SELECT n.*, degree,
    label <> '' AND (coalesce(label = {_BASE}, false) OR coalesce(contains(label, '/') AND (source_file = label OR ends_with(source_file, '/' || label)), false)
      OR (ends_with(label, '()') AND (starts_with(label, '.') OR degree <= 1))) AS is_file,
    coalesce(source_file, '') = '' OR NOT contains({_BASE}, '.') AS is_concept,
    ends_with(lower(coalesce(source_file, '')), '.json') AND lower(trim(label)) IN {listed(V.JSON_NOISE_LABELS)} AS is_json_key,
    label IN {listed(V.NOISE_LABELS)} AS is_noise
  FROM n JOIN deg USING (id))"""
