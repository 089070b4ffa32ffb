"""Queries on building graphs and on their structure, with their SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import predicates as P
from quillgraph.functions import vocabulary as V
from quillgraph.operators import analyze as A
from quillgraph.operators import build as B
from quillgraph.plans import rules_sql as Q
from quillgraph.plans.graphs import EDGES, GRAPH, KINDS, NODES, canon, code_edges, code_graph, code_nodes, listed, sql_path
from quillgraph.session import table

SPLIT_AT = "2025-01-01"


def _pairs(g: B.Graph) -> DataFrame:
    return g.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _by_area(g: B.Graph) -> DataFrame:
    """Nodes with a file, grouped by the first directory of its path."""
    return g.nodes.where("source_file is not null").select("id", P.top_directory(F.col("source_file")).alias("community"))


def clean_node_records(spark: SparkSession, folder: str) -> DataFrame:
    return B.survivors(B.clean_nodes(table(spark, folder, "extraction"))).select("id", "label", "file_type", "source_file", "source_location", "origin")


def clean_edge_records(spark: SparkSession, folder: str) -> DataFrame:
    return code_edges(spark, folder).select("edge_id", "src", "dst", "relation", "confidence", "confidence_score", "weight", "source_file", "deferred")


def built_graph(spark: SparkSession, folder: str) -> DataFrame:
    g = B.build(table(spark, folder, "extraction"), table(spark, folder, "edges"))
    return g.edges.select("edge_id", "src", "dst", "relation", "source_file")


def dangling_edges(spark: SparkSession, folder: str) -> DataFrame:
    return B.dangling(code_edges(spark, folder), code_nodes(spark, folder))


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return code_graph(spark, folder).edges.select("edge_id", "src", "dst", "relation")


def ghosts(spark: SparkSession, folder: str) -> DataFrame:
    return B.ghost_map(B.survivors(B.clean_nodes(table(spark, folder, "extraction"))))


def cross_language_edges(spark: SparkSession, folder: str) -> DataFrame:
    g = code_graph(spark, folder)
    return B.across_languages(g.edges, g.nodes).select("edge_id", "src", "dst", "relation")


def edge_files(spark: SparkSession, folder: str) -> DataFrame:
    g = code_graph(spark, folder)
    return B.with_source_files(g.edges, g.nodes).select("edge_id", "source_file")


def pair_collapse(spark: SparkSession, folder: str) -> DataFrame:
    return B.collapse_pairs(code_graph(spark, folder).edges)


def record_errors(spark: SparkSession, folder: str) -> DataFrame:
    return B.validation_errors(table(spark, folder, "extraction"), table(spark, folder, "edges")).groupBy("entity", "rule").agg(F.count(F.lit(1)).alias("errors"))


def fragment_limits(spark: SparkSession, folder: str) -> DataFrame:
    return B.fragment_errors(*(table(spark, folder, t) for t in ("extraction", "edges", "hyperedges")), most_nodes=1000, most_edges=5000, most_hyperedges=50)


def hyperedge_members(spark: SparkSession, folder: str) -> DataFrame:
    kept = B.hyperedge_members(table(spark, folder, "hyperedges"), code_nodes(spark, folder))
    return kept.select("id", F.array_join("nodes", ",").alias("members"), F.size("nodes").alias("size"))


def file_labels(spark: SparkSession, folder: str) -> DataFrame:
    return B.file_labels(code_nodes(spark, folder))


def graph_degree(spark: SparkSession, folder: str) -> DataFrame:
    g = code_graph(spark, folder)
    return A.degrees(g.nodes, g.edges)


def god_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return A.god_nodes(code_graph(spark, folder))


def god_nodes_without_hubs(spark: SparkSession, folder: str) -> DataFrame:
    return A.god_nodes(code_graph(spark, folder), hub_percentile=95)


def graph_stats(spark: SparkSession, folder: str) -> DataFrame:
    return A.statistics(code_graph(spark, folder))


def edge_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    return A.edge_diagnostics(code_edges(spark, folder))


def surprise_scores(spark: SparkSession, folder: str) -> DataFrame:
    g = code_graph(spark, folder)
    return A.surprises(g, _by_area(g))


def import_cycles(spark: SparkSession, folder: str) -> DataFrame:
    found = A.short_cycles(A.import_graph(code_graph(spark, folder)))
    return found.select(F.array_join("cycle", ">").alias("cycle"), "length")


def import_cycles_top(spark: SparkSession, folder: str) -> DataFrame:
    return import_cycles(spark, folder).orderBy("length", "cycle").limit(20)


def relation_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Short cycles of packages: which first directories call each other in a ring of three at most."""
    g = code_graph(spark, folder)
    area = _by_area(g)
    calls = g.edges.where(F.col("relation").isin(*V.CALLS)).join(area.select(F.col("id").alias("src"), F.col("community").alias("u")), "src").join(area.select(F.col("id").alias("dst"), F.col("community").alias("v")), "dst")
    found = A.short_cycles(calls.select(F.col("u").alias("src"), F.col("v").alias("dst")).distinct(), 3)
    return found.select(F.array_join("cycle", ">").alias("cycle"), "length")


def _snapshots(spark: SparkSession, folder: str) -> tuple[B.Graph, B.Graph]:
    g = code_graph(spark, folder)
    meta = table(spark, folder, "node_metadata").select(F.col("node_id").alias("id"), "indexed_at")
    old = meta.where(F.col("indexed_at") < F.lit(SPLIT_AT).cast("timestamp")).select("id")
    removed = table(spark, folder, "removals").where("restored_at is null").select(F.col("node_id").alias("id"))
    before = B.Graph(g.nodes.join(old, "id", "left_semi"), g.edges.where(F.col("made_at") < F.lit(SPLIT_AT).cast("timestamp")))
    nodes = g.nodes.join(removed, "id", "left_anti")
    return before, B.Graph(nodes, B.inside(g.edges, nodes))


def graph_diff(spark: SparkSession, folder: str) -> DataFrame:
    return A.difference(*_snapshots(spark, folder))


def area_cohesion(spark: SparkSession, folder: str) -> DataFrame:
    g = code_graph(spark, folder)
    return A.cohesion(_by_area(g), _pairs(g))


def area_hubs(spark: SparkSession, folder: str) -> DataFrame:
    g = code_graph(spark, folder)
    return A.hub_labels(_by_area(g), g, A.degrees(g.nodes, g.edges))


def area_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return A.fingerprints(_by_area(code_graph(spark, folder)))


def area_meta_graph(spark: SparkSession, folder: str) -> DataFrame:
    g = code_graph(spark, folder)
    return A.meta_graph(_by_area(g), _pairs(g))


def isolated_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return A.isolated(code_graph(spark, folder))


def node_connections(spark: SparkSession, folder: str) -> DataFrame:
    return A.connections(code_graph(spark, folder))


def directory_tree(spark: SparkSession, folder: str) -> DataFrame:
    return A.directory_tree(code_nodes(spark, folder), "source_file")


def node_categories(spark: SparkSession, folder: str) -> DataFrame:
    n = code_nodes(spark, folder)
    return n.select("id", P.node_category(F.col("label"), F.col("id"), F.col("node_kind"), F.col("source_file")).alias("category"))


def architecture(spark: SparkSession, folder: str) -> DataFrame:
    n = code_nodes(spark, folder).select(P.architecture_role(F.col("label"), F.col("node_kind"), F.col("source_file")).alias("role"), P.path_category(F.col("source_file")).alias("area"))
    return n.select(P.architecture_stage(F.col("role")).alias("stage"), "role", "area").groupBy("stage", "role", "area").agg(F.count(F.lit(1)).alias("nodes"))


def stage_flows(spark: SparkSession, folder: str) -> DataFrame:
    """How many edges lead from one stage of the architecture to another."""
    g = code_graph(spark, folder)
    stage = g.nodes.select("id", P.architecture_stage(P.architecture_role(F.col("label"), F.col("node_kind"), F.col("source_file"))).alias("stage"))
    side = lambda key, name: stage.select(F.col("id").alias(key), F.col("stage").alias(name))
    rows = g.edges.join(side("src", "from_stage"), "src").join(side("dst", "to_stage"), "dst").where("from_stage != to_stage")
    return rows.groupBy("from_stage", "to_stage").agg(F.count(F.lit(1)).alias("edges"))


def file_properties(spark: SparkSession, folder: str) -> DataFrame:
    files = code_nodes(spark, folder).where("source_file is not null").select("source_file").distinct()
    p = F.col("source_file")
    return files.select("source_file", P.file_category(p).alias("category"), P.top_directory(p).alias("top"), P.edge_family(p).alias("family"), P.environment(p).alias("environment"), P.is_sensitive(p).alias("sensitive"), P.path_category(p).alias("area"))


def test_share(spark: SparkSession, folder: str) -> DataFrame:
    n = code_nodes(spark, folder)
    kind = F.col("node_kind")
    flags = n.select(
        "file_type", P.is_test(F.col("label"), F.col("source_file")).alias("test"), P.is_api(F.col("label"), kind).alias("api"), P.is_infrastructure(F.col("source_file"), kind).alias("infra")
    )
    return flags.groupBy("file_type").agg(F.count_if("test").alias("tests"), F.count_if("api").alias("apis"), F.count_if("infra").alias("infrastructure"), F.count(F.lit(1)).alias("nodes"))


def context_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges by context, other names of a context folded."""
    e = code_graph(spark, folder).edges
    key = F.col("context")
    folded = V.lookup(key, {c: tuple(names.split()) for c, names in V.CONTEXT_ALIASES.items()})
    return e.groupBy(F.coalesce(folded, key, F.lit("")).alias("context"), "relation").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))


QUERIES = {f.__name__: f for f in (
    clean_node_records, clean_edge_records, built_graph, dangling_edges, graph_edges, ghosts, cross_language_edges, edge_files, pair_collapse, record_errors, fragment_limits,
    hyperedge_members, file_labels, graph_degree, god_nodes, god_nodes_without_hubs, graph_stats, edge_diagnostics, surprise_scores, import_cycles, import_cycles_top,
    relation_cycles, graph_diff, area_cohesion, area_hubs, area_fingerprints, area_meta_graph, isolated_nodes, node_connections, directory_tree, node_categories, architecture,
    stage_flows, file_properties, test_share, context_edges,
)}

# ---- the same in SQL

_RECORDS = rf"""
r0 AS (
  SELECT {canon("id")} AS id, CASE WHEN trim(coalesce(label, ''), E' \t\r\n') <> '' THEN label ELSE {canon("id")} END AS label, lower(trim(coalesce(file_type, ''))) AS k,
         {sql_path("source_file")} AS source_file, source_location, origin FROM extraction),
r1 AS (SELECT id, label, CASE WHEN k IN {listed(V.FILE_TYPES)} THEN k {" ".join(f"WHEN k = '{a}' THEN '{b}'" for a, b in V.FILE_TYPE_SYNONYMS.items())} ELSE 'concept' END AS file_type,
         source_file, source_location, origin, {{'a': coalesce(origin, '') <> 'ast', 'b': source_location IS NULL, 'c': length(label), 'd': encode(label), 'e': coalesce(source_file, '')}} AS rk
       FROM r0 WHERE id <> ''),
r AS (SELECT id, arg_min(label, rk) AS label, arg_min(file_type, rk) AS file_type, arg_min(source_file, rk) FILTER (source_file IS NOT NULL) AS source_file,
        arg_min(source_location, rk) FILTER (source_location IS NOT NULL) AS source_location, arg_min(origin, rk) FILTER (origin IS NOT NULL) AS origin FROM r1 GROUP BY id)"""

_GHOSTS = r"""
gp AS (SELECT id, source_file, label, coalesce(origin = 'ast', false) OR coalesce(regexp_matches(source_location, '^L\d+'), false) AS parsed FROM r WHERE source_file IS NOT NULL),
gr AS (SELECT source_file, label, min(id) AS real FROM gp WHERE parsed GROUP BY ALL HAVING count(DISTINCT id) = 1),
gm AS (SELECT gp.id AS ghost, min(real) AS real FROM gp JOIN gr USING (source_file, label) WHERE NOT parsed AND gp.id <> real GROUP BY gp.id)"""

_EXT = "lower(CASE WHEN contains(regexp_extract({p}, '[^/]*$'), '.') THEN regexp_extract({p}, '[^.]*$') ELSE '' END)"


def _family(p: str, groups: dict) -> str:
    x = _EXT.format(p=p)
    return "CASE " + " ".join(f"WHEN {x} IN {listed(v)} THEN '{k}'" for k, v in groups.items()) + " END"


_PAIRS = "p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e)"
_AREA = "m AS (SELECT id, split_part(source_file, '/', 1) AS community FROM n WHERE source_file IS NOT NULL)"
_WITH = f"WITH {GRAPH}"

_FOLD = f"""SELECT a, b, x.src AS src, x.dst AS dst, x.relation AS relation FROM (
  SELECT a, b, list_reduce(list({{'src': src, 'dst': dst, 'relation': relation}} ORDER BY src, dst, relation),
    lambda h, y: CASE WHEN (h.src = y.dst AND h.dst = y.src AND h.src <> h.dst AND h.relation = y.relation)
      OR (y.relation IN {listed(V.GENERIC)} AND h.relation NOT IN {listed(V.GENERIC)}) THEN h ELSE y END) AS x
  FROM (SELECT DISTINCT src, dst, relation, least(src, dst) AS a, greatest(src, dst) AS b FROM e) GROUP BY a, b)"""

_CATEGORY = f"CASE WHEN NOT contains(f, '.') THEN 'doc' WHEN lower(regexp_extract(f, '[^.]*$')) IN {listed(V.CODE_ENDINGS)} THEN 'code' WHEN lower(regexp_extract(f, '[^.]*$')) = 'pdf' THEN 'paper' WHEN lower(regexp_extract(f, '[^.]*$')) IN {listed(V.IMAGE_ENDINGS)} THEN 'image' ELSE 'doc' END"

_SURPRISE = f"""
side AS (SELECT k.id, k.source_file AS f, degree, community, {_CATEGORY.replace("f,", "k.source_file,").replace("(f", "(k.source_file")} AS cat,
           split_part(k.source_file, '/', 1) AS top, {_family("k.source_file", V.SURPRISE_FAMILIES)} AS fam
         FROM k LEFT JOIN m ON m.id = k.id WHERE NOT is_file AND NOT is_concept),
sc AS (SELECT edge_id, src, dst, relation, confidence, u.degree AS du, v.degree AS dv,
         CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + CASE WHEN u.cat <> v.cat THEN 2 ELSE 0 END + CASE WHEN u.top <> v.top THEN 2 ELSE 0 END
           + CASE WHEN u.community <> v.community THEN 1 ELSE 0 END AS loud,
         confidence = 'INFERRED' AND relation IN ('calls', 'uses') AND (coalesce(u.fam <> v.fam, false) OR list_sort([u.cat, v.cat]) = ['code', 'doc']) AS quiet
       FROM e JOIN side u ON u.id = src JOIN side v ON v.id = dst WHERE relation NOT IN {listed(V.STRUCTURAL)} AND u.f <> v.f)"""

_IMPORTS = f"""
ig AS (SELECT DISTINCT e.source_file AS src,
         CASE WHEN u.source_file = e.source_file THEN v.source_file WHEN v.source_file = e.source_file THEN u.source_file
              WHEN coalesce(v.source_file, '') <> '' AND v.source_file <> e.source_file THEN v.source_file ELSE u.source_file END AS dst
       FROM e JOIN n u ON u.id = e.src JOIN n v ON v.id = e.dst WHERE relation IN {listed(V.CYCLE)} AND NOT deferred AND e.source_file <> ''),
ge AS (SELECT * FROM ig WHERE dst <> '' AND dst <> src)"""


def _cycles(edges: str, longest: int) -> str:
    return f"""
cy AS (
  SELECT src AS start, dst AS stop, [src, dst] AS path FROM {edges} WHERE src < dst
  UNION ALL SELECT start, g.dst, list_append(path, g.dst) FROM cy JOIN {edges} g ON g.src = stop
  WHERE g.dst > start AND NOT list_contains(path, g.dst) AND len(path) < {longest}),
found AS (SELECT array_to_string(path, '>') AS cycle, CAST(len(path) AS INTEGER) AS length FROM cy JOIN {edges} g ON g.src = stop AND g.dst = start)"""


_DIFF = f"""
old_n AS (SELECT n.id FROM n JOIN node_metadata m ON m.node_id = n.id WHERE m.indexed_at < TIMESTAMP '{SPLIT_AT}'),
new_n AS (SELECT id FROM n WHERE id NOT IN (SELECT node_id FROM removals WHERE restored_at IS NULL)),
old_e AS (SELECT DISTINCT src, dst, relation FROM e WHERE made_at < TIMESTAMP '{SPLIT_AT}'),
new_e AS (SELECT DISTINCT src, dst, relation FROM e WHERE src IN (SELECT id FROM new_n) AND dst IN (SELECT id FROM new_n))"""

ORACLES = {
    "clean_node_records": f"WITH {_RECORDS} SELECT * FROM r",
    "clean_edge_records": f"WITH {EDGES} SELECT edge_id, src, dst, relation, confidence, confidence_score, weight, source_file, deferred FROM e0",
    "dangling_edges": f"""WITH {NODES}, {EDGES} SELECT edge_id, 'source' AS endpoint, src AS node_id, relation FROM e0 WHERE src NOT IN (SELECT id FROM n)
      UNION ALL SELECT edge_id, 'target', dst, relation FROM e0 WHERE dst NOT IN (SELECT id FROM n)""",
    "graph_edges": f"{_WITH} SELECT edge_id, src, dst, relation FROM e",
    "built_graph": f"""WITH {_RECORDS}, {_GHOSTS}, {EDGES},
      g1 AS (SELECT e0.*, coalesce(x.real, src) AS s1, coalesce(y.real, dst) AS d1 FROM e0 LEFT JOIN gm x ON x.ghost = src LEFT JOIN gm y ON y.ghost = dst),
      g2 AS (SELECT * FROM g1 WHERE src = dst OR s1 <> d1),
      bn AS (SELECT * FROM r WHERE id NOT IN (SELECT ghost FROM gm)),
      al AS (SELECT DISTINCT id, unnest([{canon("label")}, {canon("regexp_extract(coalesce(source_file, ''), '[^/]*$')")}]) AS alias FROM bn),
      un AS (SELECT alias, min(id) AS own FROM al WHERE alias <> '' AND alias NOT IN (SELECT id FROM bn) GROUP BY alias HAVING count(DISTINCT id) = 1),
      g3 AS (SELECT g2.* REPLACE (coalesce(x.own, s1) AS src, coalesce(y.own, d1) AS dst) FROM g2 LEFT JOIN un x ON x.alias = s1 LEFT JOIN un y ON y.alias = d1),
      fm AS (SELECT id, source_file, {_family("source_file", V.EDGE_FAMILIES)} AS fam FROM bn)
      SELECT edge_id, src, dst, relation, coalesce(g3.source_file, u.source_file, v.source_file) AS source_file FROM g3 JOIN fm u ON u.id = src JOIN fm v ON v.id = dst
      WHERE NOT coalesce(u.fam <> v.fam AND (relation IN ('imports', 'imports_from', 'references') OR (relation = 'calls' AND confidence = 'INFERRED')), false)
        AND NOT (src = dst AND relation IN ('imports', 'imports_from', 're_exports'))""",
    "ghosts": f"WITH {_RECORDS}, {_GHOSTS} SELECT * FROM gm",
    "cross_language_edges": f"""{_WITH}, f AS (SELECT id, {_family("source_file", V.EDGE_FAMILIES)} AS fam FROM n)
      SELECT edge_id, src, dst, relation FROM e JOIN f u ON u.id = src JOIN f v ON v.id = dst
      WHERE u.fam <> v.fam AND (relation IN ('imports', 'imports_from', 'references') OR (relation = 'calls' AND confidence = 'INFERRED'))""",
    "edge_files": f"{_WITH} SELECT edge_id, coalesce(e.source_file, u.source_file, v.source_file) AS source_file FROM e JOIN n u ON u.id = src JOIN n v ON v.id = dst",
    "pair_collapse": f"{_WITH} {_FOLD}",
    "record_errors": "SELECT entity, rule, count(*) AS errors FROM (" + " UNION ALL ".join(
        [rf"SELECT 'node' AS entity, 'missing_{c}' AS rule FROM extraction WHERE coalesce(trim({c}, E' \t\r\n'), '') = ''" for c in ("id", "label", "file_type", "source_file")]
        + [f"SELECT 'node', 'unknown_file_type' FROM extraction WHERE coalesce(trim(file_type), '') <> '' AND file_type NOT IN {listed(V.FILE_TYPES)}"]
        + [rf"SELECT 'edge', 'missing_{c}' FROM edges WHERE coalesce(trim({c}, E' \t\r\n'), '') = ''" for c in ("source", "target", "relation", "confidence", "source_file")]
        + [f"SELECT 'edge', 'unknown_confidence' FROM edges WHERE coalesce(trim(confidence), '') <> '' AND confidence NOT IN {listed(V.CONFIDENCE_SCORES)}"]
    ) + ") GROUP BY ALL",
    "fragment_limits": r"""SELECT * FROM (
      SELECT 'too_many_nodes' AS rule, count(*) AS count FROM extraction HAVING count(*) > 1000
      UNION ALL SELECT 'too_many_edges', count(*) FROM edges HAVING count(*) > 5000
      UNION ALL SELECT 'too_many_hyperedges', count(*) FROM hyperedges HAVING count(*) > 50
      UNION ALL SELECT 'bad_node_id', count(*) FROM extraction WHERE NOT coalesce(regexp_full_match(id, '[A-Za-z0-9_.:-]+') AND length(id) <= 256, false) HAVING count(*) > 0
      UNION ALL SELECT 'bad_endpoint', count(*) FROM edges WHERE NOT coalesce(regexp_full_match(source, '[A-Za-z0-9_.:-]+'), false) OR NOT coalesce(regexp_full_match(target, '[A-Za-z0-9_.:-]+'), false) HAVING count(*) > 0
      UNION ALL SELECT 'too_many_members', count(*) FROM hyperedges WHERE len(nodes) > 256 HAVING count(*) > 0
      UNION ALL SELECT 'too_few_members', count(*) FROM hyperedges WHERE coalesce(len(list_distinct(nodes)), 0) < 2 HAVING count(*) > 0)""",
    "hyperedge_members": f"""WITH {NODES}, u AS (SELECT id, unnest(nodes) AS m, generate_subscripts(nodes, 1) AS pos FROM hyperedges),
      d AS (SELECT id, {canon("m")} AS m, min(pos) AS pos FROM u GROUP BY ALL HAVING m IN (SELECT id FROM n))
      SELECT id, string_agg(m, ',' ORDER BY pos) AS members, CAST(count(*) AS INTEGER) AS size FROM d GROUP BY id HAVING count(*) >= 2""",
    "file_labels": f"""WITH {NODES}, f AS (SELECT DISTINCT source_file FROM n WHERE node_kind = 'file' AND source_file IS NOT NULL),
      t AS (SELECT source_file, k, array_to_string(list_slice(string_split(source_file, '/'), greatest(len(string_split(source_file, '/')) - k + 1, 1), len(string_split(source_file, '/'))), '/') AS tail FROM f, range(1, 7) r(k)),
      a AS (SELECT k, tail, min(source_file) AS source_file FROM t GROUP BY ALL HAVING count(*) = 1)
      SELECT f.source_file, coalesce(l, f.source_file) AS label FROM f LEFT JOIN (SELECT source_file, arg_min(tail, k) AS l FROM a GROUP BY ALL) USING (source_file)""",
    "graph_degree": f"{_WITH} SELECT * FROM deg",
    "god_nodes": f"{_WITH}, {KINDS} SELECT id, label, degree FROM k WHERE NOT is_file AND NOT is_concept AND NOT is_json_key AND NOT is_noise ORDER BY degree DESC, id LIMIT 10",
    "god_nodes_without_hubs": f"""{_WITH}, {KINDS}, h AS (SELECT list_sort(list(degree))[greatest(0, CAST(floor(count(*) * 95.0 / 100) AS BIGINT) - 1) + 1] AS t FROM deg)
      SELECT id, label, degree FROM k, h WHERE degree <= t AND NOT is_file AND NOT is_concept AND NOT is_json_key AND NOT is_noise ORDER BY degree DESC, id LIMIT 10""",
    "graph_stats": f"""{_WITH} SELECT (SELECT count(DISTINCT id) FROM n) AS nodes, count(*) AS edges, count(*) FILTER (confidence = 'EXTRACTED') * 100 / count(*) AS extracted,
      count(*) FILTER (confidence = 'INFERRED') * 100 / count(*) AS inferred, count(*) FILTER (confidence = 'AMBIGUOUS') * 100 / count(*) AS ambiguous, avg(confidence_score) AS mean_score FROM e""",
    "edge_diagnostics": f"""WITH {EDGES}, d AS (SELECT src, dst, count(*) AS c, count(DISTINCT relation) AS r, count(DISTINCT source_file) AS f, count(DISTINCT source_location) AS l, count(DISTINCT context) AS x FROM e0 GROUP BY ALL),
      b AS (SELECT count(*) AS c FROM e0 GROUP BY least(src, dst), greatest(src, dst)), q AS (SELECT count(*) AS c FROM e0 GROUP BY src, dst, relation)
      SELECT 'directed_collapses' AS measure, CAST(sum(c - 1) AS BIGINT) AS value FROM d UNION ALL SELECT 'relation_variants', count(*) FROM d WHERE r > 1 UNION ALL SELECT 'file_variants', count(*) FROM d WHERE f > 1
      UNION ALL SELECT 'location_variants', count(*) FROM d WHERE l > 1 UNION ALL SELECT 'context_variants', count(*) FROM d WHERE x > 1 UNION ALL SELECT 'self_loops', coalesce(CAST(sum(c) AS BIGINT), 0) FROM d WHERE src = dst
      UNION ALL SELECT 'undirected_collapses', CAST(sum(c - 1) AS BIGINT) FROM b UNION ALL SELECT 'exact_duplicates', CAST(sum(c - 1) AS BIGINT) FROM q""",
    "surprise_scores": f"""{_WITH}, {KINDS}, {_AREA}, {_SURPRISE} SELECT edge_id, src, dst, relation, confidence,
      CAST((CASE WHEN quiet THEN 0 WHEN relation = 'semantically_similar_to' THEN floor(loud * 1.5) ELSE loud END) + CASE WHEN least(du, dv) <= 2 AND greatest(du, dv) >= 5 THEN 1 ELSE 0 END AS INTEGER) AS score FROM sc""",
    "import_cycles": f"WITH RECURSIVE {GRAPH}, {_IMPORTS}, {_cycles('ge', 5)} SELECT * FROM found",
    "import_cycles_top": f"WITH RECURSIVE {GRAPH}, {_IMPORTS}, {_cycles('ge', 5)} SELECT * FROM found ORDER BY length, cycle LIMIT 20",
    "relation_cycles": f"""WITH RECURSIVE {GRAPH}, {_AREA}, ge AS (SELECT DISTINCT u.community AS src, v.community AS dst FROM e JOIN m u ON u.id = src JOIN m v ON v.id = dst
      WHERE relation IN {listed(V.CALLS)} AND u.community <> v.community), {_cycles('ge', 3)} SELECT * FROM found""",
    "graph_diff": f"""{_WITH}, {_DIFF} SELECT 'added' AS change, 'node' AS entity, id AS src, NULL AS dst, NULL AS relation FROM (SELECT id FROM new_n EXCEPT SELECT id FROM old_n)
      UNION ALL SELECT 'removed', 'node', id, NULL, NULL FROM (SELECT id FROM old_n EXCEPT SELECT id FROM new_n)
      UNION ALL SELECT 'added', 'edge', * FROM (SELECT * FROM new_e EXCEPT SELECT * FROM old_e) UNION ALL SELECT 'removed', 'edge', * FROM (SELECT * FROM old_e EXCEPT SELECT * FROM new_e)""",
    "area_cohesion": f"""{_WITH}, {_PAIRS}, {_AREA}, s AS (SELECT community, count(*) AS size FROM m GROUP BY ALL),
      i AS (SELECT u.community, count(*) AS c FROM p JOIN m u ON u.id = a JOIN m v ON v.id = b WHERE a <> b AND u.community = v.community GROUP BY ALL)
      SELECT community, size, CASE WHEN size <= 1 THEN 1.0 ELSE coalesce(c, 0) / (size * (size - 1) / 2) END AS cohesion FROM s LEFT JOIN i USING (community)""",
    "area_hubs": f"""{_WITH}, {_AREA} SELECT community, regexp_replace(trim(arg_min(label, {{'d': -degree, 'i': id}})), '\\(\\)$', '') AS label FROM m JOIN n USING (id) JOIN deg USING (id) GROUP BY community""",
    "area_fingerprints": f"""{_WITH}, {_AREA} SELECT community, substr(sha256(string_agg(id, chr(0) ORDER BY id) || chr(0)), 1, 16) AS signature FROM m GROUP BY community""",
    "area_meta_graph": f"""{_WITH}, {_PAIRS}, {_AREA} SELECT least(u.community, v.community) AS a, greatest(u.community, v.community) AS b, count(*) AS edges
      FROM p JOIN m u ON u.id = p.a JOIN m v ON v.id = p.b WHERE u.community <> v.community GROUP BY 1, 2""",
    "isolated_nodes": f"{_WITH}, {KINDS} SELECT id, label FROM k WHERE degree <= 1 AND NOT is_file AND NOT is_concept AND file_type <> 'rationale'",
    "node_connections": f"""{_WITH}, q AS (SELECT DISTINCT src, dst FROM e), s AS (SELECT src AS id, 'out' AS direction, dst AS other FROM q UNION ALL SELECT dst, 'in', src FROM q),
      z AS (SELECT s.id, direction, coalesce(n.source_file, '') AS file, row_number() OVER (PARTITION BY s.id ORDER BY degree DESC, other, direction) AS rk FROM s JOIN deg ON deg.id = other JOIN n ON n.id = other)
      SELECT id, direction, file, count(*) FILTER (rk <= 20) AS shown, count(*) FILTER (rk > 20) AS more FROM z GROUP BY ALL""",
    "directory_tree": f"""WITH {NODES}, c AS (SELECT source_file, count(*) AS r FROM n WHERE source_file IS NOT NULL GROUP BY ALL),
      u AS (SELECT r, array_to_string(list_slice(string_split(source_file, '/'), 1, i), '/') AS directory FROM c, range(1, 100) x(i) WHERE i <= greatest(len(string_split(source_file, '/')) - 1, 1))
      SELECT directory, count(*) AS files, CAST(sum(r) AS BIGINT) AS rows FROM u GROUP BY directory""",
    "context_edges": f"""{_WITH} SELECT coalesce(CASE {" ".join(f"WHEN context IN {listed(names.split())} THEN '{c}'" for c, names in reversed(V.CONTEXT_ALIASES.items()))} END, context, '') AS context,
      relation, count(*) AS edges, sum(weight) AS weight FROM e GROUP BY ALL""",
}

_FILE_CATEGORY = _CATEGORY.replace("f,", "source_file,").replace("(f", "(source_file")
ORACLES |= {
    "node_categories": f"WITH {NODES}, {Q.RULED} SELECT id, {Q.CATEGORY} AS category FROM w",
    "architecture": f"WITH {NODES}, {Q.RULED}, r AS (SELECT {Q.ROLE} AS role, {Q.AREA} AS area FROM w) SELECT {Q.STAGE} AS stage, role, area, count(*) AS nodes FROM r GROUP BY ALL",
    "stage_flows": f"""WITH {GRAPH}, {Q.RULED}, r AS (SELECT id, {Q.ROLE} AS role FROM w), t AS (SELECT id, {Q.STAGE} AS stage FROM r)
      SELECT u.stage AS from_stage, v.stage AS to_stage, count(*) AS edges FROM e JOIN t u ON u.id = src JOIN t v ON v.id = dst WHERE u.stage <> v.stage GROUP BY ALL""",
    "file_properties": f"""WITH {NODES}, {Q.RULED} SELECT DISTINCT source_file, {_FILE_CATEGORY} AS category, split_part(source_file, '/', 1) AS top, {_family("source_file", V.EDGE_FAMILIES)} AS family,
      {Q.environment("source_file")} AS environment, {Q.SENSITIVE} AS sensitive, {Q.AREA} AS area FROM w WHERE source_file IS NOT NULL""",
    "test_share": f"""WITH {NODES}, {Q.RULED} SELECT file_type, count(*) FILTER ({Q.TEST}) AS tests, count(*) FILTER ({Q.API}) AS apis, count(*) FILTER ({Q.INFRA}) AS infrastructure, count(*) AS nodes FROM w GROUP BY file_type""",
}
