"""Queries on references between tables and on hierarchies, with their SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.hierarchy import containment_rows, descendants, hierarchy, paths
from quillgraph.operators.references import missing_endpoints, orphan_report
from quillgraph.session import cut, table


def _endpoints(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return missing_endpoints(*(table(spark, folder, n) for n in ("edges", "node_metadata", "externals", "removals")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _endpoints(spark, folder)[0].select("edge_id", "side").distinct()


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(*_endpoints(spark, folder))


def _tree(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(containment_rows(table(spark, folder, "edges")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _tree(spark, folder).select("node_id", "root_id", "depth")


def p5_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Path, parent, root, depth, interval and number of descendants of each node; loops have no path and no interval."""
    tree = cut(_tree(spark, folder), "tree")
    return tree.join(paths(tree), "node_id", "left").select(
        "node_id", "parent_id", "root_id", "depth", "entry", "exit", (F.col("exit") - F.col("entry") - 1).alias("descendants"), "path", "on_loop"
    )


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of a node and a node below it, with their distance."""
    return descendants(cut(_tree(spark, folder), "tree"))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p5_descendants": p5_descendants}


def canon(x: str) -> str:
    """The canonical id in SQL, for text that case folding beyond ``lower`` and NFKC leave as it is."""
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', '_', 'g'), '_')"


_REFS = rf"""
refs AS (
  SELECT DISTINCT edge_id, side, {canon("raw")} AS ref_id, extracted_at, {canon("relation")} AS relation
  FROM (SELECT edge_id, 'source' AS side, source AS raw, extracted_at, relation FROM edges
        UNION ALL SELECT edge_id, 'target', target, extracted_at, relation FROM edges)
  WHERE raw IS NOT NULL AND trim(raw, E' \t\r\n') <> ''),
orphans AS (
  SELECT r.* FROM refs r
  WHERE ref_id NOT IN (SELECT ext_id FROM externals)
    AND NOT EXISTS (SELECT 1 FROM node_metadata n WHERE n.node_id = r.ref_id AND n.indexed_at <= r.extracted_at)
  UNION
  SELECT r.* FROM refs r JOIN removals x ON x.node_id = r.ref_id
  WHERE r.extracted_at >= x.removed_at AND (x.restored_at IS NULL OR r.extracted_at < x.restored_at))"""

_LINKS = rf"""
links AS (
  SELECT child, min(parent) AS parent FROM (
    SELECT CASE WHEN r = 'part_of' THEN s ELSE t END AS child, CASE WHEN r = 'part_of' THEN t ELSE s END AS parent
    FROM (SELECT {canon("source")} AS s, {canon("target")} AS t, {canon("relation")} AS r FROM edges)
    WHERE r IN ('contains', 'method', 'parent_of', 'has_part', 'part_of') AND s <> '' AND t <> '') GROUP BY child),
up AS (
  SELECT child AS node, parent AS top, 1 AS k, [child] AS seen, child = parent AS looped FROM links
  UNION ALL
  SELECT u.node, l.parent, u.k + 1, list_append(u.seen, u.top), list_contains(list_append(u.seen, u.top), l.parent)
  FROM up u JOIN links l ON l.child = u.top WHERE NOT u.looped),
ends AS (
  SELECT node, top AS root_id, k AS depth FROM up WHERE NOT looped AND top NOT IN (SELECT child FROM links)),
tree AS (
  SELECT node AS node_id, root_id, depth FROM ends
  UNION ALL SELECT DISTINCT node, '', -1 FROM up WHERE looped
  UNION ALL SELECT DISTINCT parent, parent, 0 FROM links WHERE parent NOT IN (SELECT child FROM links))"""

ORACLES = {
    "p4_found": f"WITH {_REFS} SELECT DISTINCT edge_id, side FROM orphans",
    "p4_report": f"""WITH {_REFS},
      o AS (SELECT side, relation, strftime(extracted_at, '%Y-%m') AS month, count(DISTINCT edge_id) AS orphans FROM orphans GROUP BY ALL),
      r AS (SELECT side, relation, strftime(extracted_at, '%Y-%m') AS month, count(DISTINCT edge_id) AS refs FROM refs GROUP BY ALL)
      SELECT 'edges' AS referring_table, side, relation, month, orphans, refs, orphans / refs AS share FROM o JOIN r USING (side, relation, month)""",
    "p5_found": f"WITH RECURSIVE {_LINKS} SELECT node_id, root_id, CAST(depth AS INTEGER) AS depth FROM tree",
    "p5_hierarchy": f"""WITH RECURSIVE {_LINKS},
      way AS (SELECT node AS node_id, list_reverse(seen) AS way FROM (
                SELECT u.node, list_append(u.seen, u.top) AS seen FROM up u WHERE NOT u.looped AND u.top NOT IN (SELECT child FROM links))
              UNION ALL SELECT DISTINCT parent, [parent] FROM links WHERE parent NOT IN (SELECT child FROM links)),
      placed AS (SELECT node_id, way, row_number() OVER (PARTITION BY way[1] ORDER BY way) - 1 AS entry FROM way),
      sizes AS (SELECT a AS node_id, count(*) AS size FROM (SELECT unnest(way) AS a FROM way) GROUP BY a)
      SELECT t.node_id, l.parent AS parent_id, root_id, CAST(depth AS INTEGER) AS depth, entry, entry + size AS "exit", size - 1 AS descendants,
             array_to_string(way, '/') AS path, depth < 0 AS on_loop
      FROM tree t LEFT JOIN links l ON l.child = t.node_id LEFT JOIN placed p ON p.node_id = t.node_id LEFT JOIN sizes s ON s.node_id = t.node_id""",
    "p5_descendants": f"""WITH RECURSIVE {_LINKS}
      SELECT u.top AS node_id, u.node AS descendant_id, CAST(u.k AS INTEGER) AS distance FROM up u JOIN tree t ON t.node_id = u.node WHERE t.depth > 0""",
}
