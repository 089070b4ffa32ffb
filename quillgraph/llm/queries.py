"""The queries of this package by name, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import copies, handwritten, mixing, neardup, packing, tokens
from quillgraph.llm import subjects as subject_areas
from quillgraph.session import table


def _records(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    e, n = table(spark, folder, "extraction"), table(spark, folder, "node_metadata")
    rows = copies.keyed(e, "extraction", "rec_id", loose=("id", "label"))
    rows = rows.unionByName(copies.keyed(n, "node_metadata", "meta_id", exact=("source_path",), loose=("label",)))
    return rows, e.count() + n.count()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.found_copies(*_records(spark, folder))


def p1_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return copies.collapsed(*_records(spark, folder))


def p2_reasons(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "node_metadata").select("source_path", "content")
    paths = table(spark, folder, "extraction").select(F.col("source_file").alias("source_path"))
    return handwritten.machine_made(paths.unionByName(nodes.select("source_path")), nodes)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_reasons(spark, folder).select("source_path")


P3_WORDS, P3_SIMILARITY, P3_LEAST = 3, 0.6, 20


def _p3(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, folder, "node_metadata").select("meta_id", neardup.words(F.coalesce("label", F.lit(""))).alias("head"), neardup.words(F.col("content")).alias("body"))
    both = F.trim(F.concat("head", F.lit(" "), "body"))
    rows = nodes.select(F.col("meta_id").alias("id"), F.when(neardup.word_count(F.col("body")) >= P3_LEAST, both).alias("words"))
    return neardup.near_duplicates(rows, P3_WORDS, P3_SIMILARITY)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.all_pairs(*_p3(spark, folder)).select(F.col("a").alias("meta_a"), F.col("b").alias("meta_b"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(*_p3(spark, folder)).withColumnRenamed("id", "meta_id")


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    items = tokens.with_tokens(table(spark, folder, "documents").select("doc_id", "text"), "text").drop("text")
    budgets = table(spark, folder, "token_budgets")
    return packing.pack(items, budgets), budgets


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)[0]


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(*_packed(spark, folder))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = tokens.with_tokens(table(spark, folder, "documents").select("doc_id", "text", "source"), "text")
    weights = table(spark, folder, "source_weights")
    listed = mixing.canonical_source(F.col("source"))
    docs = docs.where(listed.isin(*(r[0] for r in weights.select(listed).collect())))
    return mixing.mix(mixing.one_of_each_text(docs, "text"), weights)


def p7_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    return subject_areas.subjects(*(table(spark, folder, n) for n in ("documents", "subject_areas", "doc_labels")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).select("doc_id", "subject")


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by subject, and the documents' worth of statements that deal with it."""
    return _subjects(spark, folder).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("share").alias("weight"))


QUERIES = {
    "p1_found": p1_found,
    "p1_collapsed": p1_collapsed,
    "p2_found": p2_found,
    "p2_reasons": p2_reasons,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p7_mixed": p7_mixed,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
}

_FIELD = r"([\p{L}\p{N}_-]+)\s*=\s*([\p{L}\p{N}_-]+)"
_BARE = r"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def _key(x: str) -> str:
    bare = lambda v: _BARE.format(x=v)
    fields = f"list_sort(list_transform(regexp_extract_all({x}, '{_FIELD}'), lambda f: {bare("split_part(f, '=', 1)")} || '=' || {bare("split_part(f, '=', -1)")}))"
    return f"({bare(f"regexp_replace({x}, '{_FIELD}', '', 'g')")} || ';' || coalesce(array_to_string({fields}, ';'), ''))"


_KEYED = f"""keyed AS (
  SELECT 'extraction' AS tab, rec_id AS id, '' AS exact, {_key("id")} AS a, {_key("label")} AS b FROM extraction
  WHERE trim(id, E' \\t\\r\\n') <> '' AND trim(label, E' \\t\\r\\n') <> ''
  UNION ALL SELECT 'node_metadata', meta_id, source_path, '', {_key("label")} FROM node_metadata
  WHERE trim(source_path, E' \\t\\r\\n') <> '' AND trim(label, E' \\t\\r\\n') <> '')"""

ORACLES = {
    "p1_found": f"""WITH {_KEYED}, g AS (SELECT *, min(id) OVER (PARTITION BY tab, exact, a, b) AS kept_id FROM keyed)
      SELECT tab, kept_id, id AS copy_id FROM g WHERE id > kept_id""",
    "p1_collapsed": f"""WITH {_KEYED} SELECT tab, min(id) AS kept_id, count(*) AS copies FROM keyed GROUP BY tab, exact, a, b
      UNION ALL SELECT 'extraction', rec_id, 1 FROM extraction WHERE rec_id NOT IN (SELECT id FROM keyed WHERE tab = 'extraction')
      UNION ALL SELECT 'node_metadata', meta_id, 1 FROM node_metadata WHERE meta_id NOT IN (SELECT id FROM keyed WHERE tab = 'node_metadata')""",
    "p3_found": f"""WITH w AS (SELECT meta_id, regexp_extract_all(lower(coalesce(label, '') || chr(10) || content), '[a-z0-9]+') AS w FROM node_metadata
        WHERE len(regexp_extract_all(lower(content), '[a-z0-9]+')) >= {P3_LEAST}),
      s AS MATERIALIZED (SELECT meta_id, unnest(list_distinct(list_transform(range(1, len(w) - {P3_WORDS} + 2), lambda i: array_to_string(w[i:i + {P3_WORDS} - 1], ' ')))) AS g FROM w),
      n AS (SELECT meta_id, count(*) AS c FROM s GROUP BY meta_id), b AS (SELECT x.meta_id AS a, y.meta_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.meta_id < y.meta_id GROUP BY ALL)
      SELECT a AS meta_a, b AS meta_b FROM b JOIN n p ON p.meta_id = a JOIN n q ON q.meta_id = b WHERE i / (p.c + q.c - i) >= {P3_SIMILARITY}""",
}

_P3_PAIRS = f"""w AS (SELECT meta_id, regexp_extract_all(lower(coalesce(label, '') || chr(10) || content), '[a-z0-9]+') AS w FROM node_metadata
        WHERE len(regexp_extract_all(lower(content), '[a-z0-9]+')) >= {P3_LEAST}),
      c AS (SELECT meta_id, w, min(meta_id) OVER (PARTITION BY array_to_string(w, ' ')) AS class_id FROM w),
      s AS MATERIALIZED (SELECT meta_id, unnest(list_distinct(list_transform(range(1, len(w) - {P3_WORDS} + 2), lambda i: array_to_string(w[i:i + {P3_WORDS} - 1], ' ')))) AS g FROM c WHERE meta_id = class_id),
      n AS (SELECT meta_id, count(*) AS c FROM s GROUP BY meta_id), b AS (SELECT x.meta_id AS a, y.meta_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.meta_id < y.meta_id GROUP BY ALL),
      pairs AS MATERIALIZED (SELECT a, b FROM b JOIN n p ON p.meta_id = a JOIN n q ON q.meta_id = b WHERE i / (p.c + q.c - i) >= {P3_SIMILARITY}),
      sides AS MATERIALIZED (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs)"""

ORACLES |= {
    "p3_groups": f"""WITH RECURSIVE {_P3_PAIRS}, near AS (SELECT DISTINCT class_id AS x, class_id AS y FROM c UNION SELECT near.x, sides.y FROM near JOIN sides ON sides.x = near.y),
      least_of AS (SELECT x, min(y) AS group_id FROM near GROUP BY x), linked AS (SELECT x, count(*) AS links FROM sides GROUP BY x), sizes AS (SELECT class_id, count(*) AS copies FROM c GROUP BY class_id)
      SELECT meta_id, class_id, group_id, copies, coalesce(links, 0) AS links FROM c JOIN sizes USING (class_id) JOIN least_of ON least_of.x = class_id LEFT JOIN linked ON linked.x = class_id""",
}
