"""Queries that walk, rank and search the code graph, with their SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import predicates as P
from quillgraph.functions import vocabulary as V
from quillgraph.operators import analyze as A
from quillgraph.operators import communities as C
from quillgraph.operators import context as X
from quillgraph.operators import index as I
from quillgraph.operators import search as S
from quillgraph.operators import walks as W
from quillgraph.operators.build import Graph
from quillgraph.plans import rules_sql as Q
from quillgraph.plans.graphs import GRAPH, KINDS, NODES, code_graph, code_nodes, listed
from quillgraph.session import cut, table

NEEDLES = ["parse", "queue", "reading", "zzz"]
TERMS = ["parser", "pipeline", "broken", "ledger"]


def _graph(spark: SparkSession, folder: str) -> Graph:
    g = code_graph(spark, folder)
    return Graph(cut(g.nodes, "nodes"), cut(g.edges, "edges"))


def _gods(g: Graph, top: int = 3) -> DataFrame:
    return cut(A.god_nodes(g, top).select("id"), "gods")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """The query set, as seeds: every node whose meta_id is divisible by 50."""
    ids = table(spark, folder, "node_metadata").where("meta_id % 50 = 0").select(F.col("node_id").alias("id"))
    return cut(ids.select(F.col("id").alias("seed"), "id"), "asked")


def _area(g: Graph) -> DataFrame:
    return g.nodes.where("source_file is not null").select("id", P.top_directory(F.col("source_file")).alias("community"))


def callers(spark: SparkSession, folder: str) -> DataFrame:
    """Who calls what: per callee the callers and how many of them lie in other files."""
    g = code_graph(spark, folder)
    files = g.nodes.select("id", "source_file")
    rows = g.edges.where(F.col("relation").isin(*V.CALLS)).select("src", "dst").distinct()
    rows = rows.join(files.select(F.col("id").alias("src"), F.col("source_file").alias("fs")), "src").join(files.select(F.col("id").alias("dst"), F.col("source_file").alias("fd")), "dst")
    return rows.groupBy(F.col("dst").alias("callee")).agg(F.count(F.lit(1)).alias("callers"), F.count_if(~F.col("fs").eqNullSafe(F.col("fd"))).alias("from_other_files"))


def references_elsewhere(spark: SparkSession, folder: str) -> DataFrame:
    """References to each symbol from other files, structural relations left out."""
    g = code_graph(spark, folder)
    files = g.nodes.select("id", "source_file")
    rows = g.edges.where(~F.col("relation").isin(*V.NOT_A_REFERENCE)).select("src", "dst", "relation").distinct()
    rows = rows.join(files.select(F.col("id").alias("src"), F.col("source_file").alias("fs")), "src").join(files.select(F.col("id").alias("dst"), F.col("source_file").alias("fd")), "dst")
    return rows.where("fs != fd").groupBy(F.col("dst").alias("id"), "relation").agg(F.count(F.lit(1)).alias("refs"))


def neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    g = _graph(spark, folder)
    return W.reach(W.both_ways(g.edges), _asked(spark, folder), 2, most_links=W.apart.MOST_LINKS)


def neighbourhood_gated(spark: SparkSession, folder: str) -> DataFrame:
    g = _graph(spark, folder)
    return W.reach(W.both_ways(g.edges), _asked(spark, folder), 3, W.hubs(g.nodes, g.edges))


def neighbourhood_edges(spark: SparkSession, folder: str) -> DataFrame:
    """All edges among the nodes beside those of the query set."""
    g = _graph(spark, folder)
    near = W.reach(W.both_ways(g.edges), _asked(spark, folder), 1)
    return W.induced(g.edges, near).select("edge_id", "src", "dst", "relation")


def affected(spark: SparkSession, folder: str) -> DataFrame:
    g = _graph(spark, folder)
    return W.dependents(g.edges, _asked(spark, folder), V.AFFECTED, 2)


def impact_closure(spark: SparkSession, folder: str) -> DataFrame:
    g = _graph(spark, folder)
    return W.dependents(g.edges, _asked(spark, folder), V.IMPACT, 10)


def impact_scores(spark: SparkSession, folder: str) -> DataFrame:
    g = _graph(spark, folder)
    return W.impact(g, _asked(spark, folder).select("id"), _area(g), W.page_rank(g.nodes, g.edges))


def shortest_paths(spark: SparkSession, folder: str) -> DataFrame:
    g = _graph(spark, folder)
    return W.shortest_paths(g.edges, _asked(spark, folder), sep=">")


def implementations(spark: SparkSession, folder: str) -> DataFrame:
    """Subtypes of the nodes of the query set, by least distance up to 8; ``all_implementations`` takes every type and goes on to the end."""
    g = _graph(spark, folder)
    back = g.edges.where(F.col("relation").isin(*V.SUBTYPE)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return W.reach(back, _asked(spark, folder), 8).where("depth > 0")


def all_implementations(spark: SparkSession, folder: str) -> DataFrame:
    """All subtypes of each type that has one directly, by least distance."""
    return W.implementations(_graph(spark, folder).edges)


def _execution_flows(spark: SparkSession, folder: str, depth: int) -> DataFrame:
    g = _graph(spark, folder)
    kind = g.nodes.select("id", P.node_category(F.col("label"), F.col("id"), F.col("node_kind"), F.col("source_file")).alias("category"))
    starts, sinks = (kind.where(F.col("category").isin(*c)).select("id") for c in (P.ENTRY_CATEGORIES, P.SINK_CATEGORIES))
    return W.flows(g, starts, sinks, depth, sep=">").select("start", "sink", "length", "path")


def _method_flows(spark: SparkSession, folder: str, depth: int) -> DataFrame:
    g = _graph(spark, folder)
    starts, sinks = (g.nodes.where(F.col("node_kind") == k).select("id") for k in ("heading", "resource"))
    return W.flows(g, starts, sinks, depth, sep=">").select("start", "sink", "length", "path")


def execution_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Simple forward paths of at most three steps from entries to sinks, as its SQL has them; ``all_execution_flows`` goes 15 deep."""
    return _execution_flows(spark, folder, 3)


def all_execution_flows(spark: SparkSession, folder: str) -> DataFrame:
    """All simple forward paths of at most 15 steps from entries to sinks. Their number grows about 2.6 times with each step."""
    return _execution_flows(spark, folder, 15)


def method_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Simple forward paths of at most three steps from headings to packages' resources, as its SQL has them; ``all_method_flows`` goes 15 deep."""
    return _method_flows(spark, folder, 3)


def all_method_flows(spark: SparkSession, folder: str) -> DataFrame:
    """All simple forward paths of at most 15 steps from headings to packages' resources."""
    return _method_flows(spark, folder, 15)


def page_rank(spark: SparkSession, folder: str) -> DataFrame:
    g = _graph(spark, folder)
    return W.page_rank(g.nodes, g.edges).select("id", F.round("rank", 8).alias("rank"))


def personal_rank(spark: SparkSession, folder: str) -> DataFrame:
    g = _graph(spark, folder)
    return W.page_rank(g.nodes, g.edges, _gods(g).withColumn("weight", F.lit(1.0))).select("id", F.round("rank", 8).alias("rank"))


def components(spark: SparkSession, folder: str) -> DataFrame:
    g = _graph(spark, folder)
    sure = g.edges.where((F.col("confidence") == "EXTRACTED") & F.col("relation").isin("contains", "method", "part_of", "has_part", "parent_of"))
    return W.components(g.nodes, sure)


def central_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Betweenness from up to 100 pivots chosen by a hash of the id, as large graphs are measured."""
    g = _graph(spark, folder)
    n = g.nodes.count()
    k = n if n <= 1000 else min(100, max(20, int(n * 0.02)))
    pivots = cut(g.nodes.select("id").orderBy(F.md5("id"), "id").limit(k), "pivots")
    return W.betweenness(g.nodes, g.edges, pivots).select("id", F.round("betweenness", 9).alias("betweenness"))


def central_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The edges that most shortest paths from up to 50 hashed pivots cross."""
    g = _graph(spark, folder)
    n = g.nodes.count()
    k = n if n <= 500 else min(50, max(20, int(n * 0.01)))
    pivots = cut(g.nodes.select("id").orderBy(F.md5("id"), "id").limit(k), "pivots")
    return W.edge_betweenness(g.nodes, g.edges, pivots).select("a", "b", F.round("betweenness", 9).alias("betweenness"))


def label_communities(spark: SparkSession, folder: str) -> DataFrame:
    g = _graph(spark, folder)
    return C.label_propagation(g.nodes, g.edges)


def communities(spark: SparkSession, folder: str) -> DataFrame:
    g = _graph(spark, folder)
    return C.detect(g.nodes, g.edges, hub_percentile=99)


def community_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    g = code_graph(spark, folder)
    by_kind = g.nodes.select("id", F.coalesce("node_kind", F.lit("")).alias("community"))
    return C.overlaps(_area(g), by_kind)


def keywords(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "text")
    return S.keywords(rows, "doc_id", F.col("text")).select("doc_id", "term", "tf", "rank")


def node_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return S.keywords(code_nodes(spark, folder), "id", F.concat_ws(" ", "label", "content"), 3).select("id", "term", "tf", "rank")


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return S.vocabulary(code_nodes(spark, folder), F.concat_ws("\n", "label", "content"))


def label_subtokens(spark: SparkSession, folder: str) -> DataFrame:
    from quillgraph.functions.text import subtokens

    return code_nodes(spark, folder).select("id", F.array_join(subtokens(F.col("label")), " ").alias("parts"))


def label_entropy(spark: SparkSession, folder: str) -> DataFrame:
    from quillgraph.functions.text import entropy, label_key

    rows = code_nodes(spark, folder).select("id", label_key(F.col("label")).alias("key"))
    return rows.select("id", "key", F.round(entropy(F.col("key")), 6).alias("entropy"))


def term_idf(spark: SparkSession, folder: str) -> DataFrame:
    return S.substring_idf(code_nodes(spark, folder), F.col("label"), TERMS).select("term", "df", F.round("idf", 9).alias("idf"))


def bm25(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.lit("").alias("headings"), F.coalesce("text", F.lit("")).alias("body"))
    return S.bm25(docs, TERMS).select("id", F.round("score", 6).alias("score"))


def bm25_top(spark: SparkSession, folder: str) -> DataFrame:
    return bm25(spark, folder).orderBy(F.desc("score"), "id").limit(20)


def substring_search(spark: SparkSession, folder: str) -> DataFrame:
    return S.contained(code_nodes(spark, folder), "id", "label", NEEDLES)


def _index(spark: SparkSession, folder: str) -> I.Index:
    nodes = code_nodes(spark, folder)
    return I.build_index(S.fields(nodes).join(nodes.select("id", "label"), "id"), I.scratch_folder(spark, "index"), "label")


def indexed_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """The same as ``substring_search``, by the trigrams of an index on disk."""
    return I.substrings(_index(spark, folder), code_nodes(spark, folder).select("id", F.col("label").alias("text")), NEEDLES)


def index_search(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by the stems of a few words, of an index on disk; a misspelt word is replaced by its neighbours."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "title", F.col("text").alias("body"), F.col("source").alias("tags"))
    index = I.build_index(docs, I.scratch_folder(spark, "index"))
    return I.search_index(index, ["renamed", "describing", "patients", "compilr"]).select("id", F.round("score", 6).alias("score"))


def refined_context(spark: SparkSession, folder: str) -> DataFrame:
    """What a short draft leans on in the graph."""
    draft = "def load(panel):\n    socket = build_symbol(panel)\n    return parse_ledger(socket).compile(retry=3)\n"
    return X.refine(code_graph(spark, folder), _index(spark, folder), draft)


def diff_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Each day's edges as a change of their lines and the five after: what it changes, who calls that, tests it and routes to it."""
    g = _graph(spark, folder)
    line = P.line_number(F.col("source_location"))
    hunks = g.edges.where("source_file is not null").select(F.date_format("made_at", "yyyy-MM-dd").alias("diff_id"), F.col("source_file").alias("file"), line.alias("first"), (line + 5).alias("last"))
    return X.diff_context(g, hunks.where("first is not null and diff_id is not null").distinct())


def fuzzy_terms(spark: SparkSession, folder: str) -> DataFrame:
    vocab = S.vocabulary(code_nodes(spark, folder), F.col("label"))
    return S.fuzzy_terms(vocab, ["lede", "brokr", "vehcle", "mnaifest", "ledger", "ax"])


def label_scores(spark: SparkSession, folder: str) -> DataFrame:
    return S.label_scores(code_nodes(spark, folder), ["build", "symbol"]).select("id", F.round("score", 6).alias("score"), "matched")


def search_seeds(spark: SparkSession, folder: str) -> DataFrame:
    n = code_nodes(spark, folder)
    return S.pick_seeds(S.label_scores(n, ["build", "symbol"]), n).select("id", F.round("score", 6).alias("score"))


def node_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return S.find_nodes(code_nodes(spark, folder), "build_symbol")


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    g = _graph(spark, folder)
    scores = S.bm25(S.fields(g.nodes), TERMS)
    return S.hybrid(g, scores, W.page_rank(g.nodes, g.edges))


QUERIES = {f.__name__: f for f in (
    callers, references_elsewhere, neighbourhood, neighbourhood_gated, neighbourhood_edges, affected, impact_closure, impact_scores, shortest_paths, implementations, all_implementations,
    execution_flows, all_execution_flows, method_flows, all_method_flows, page_rank, personal_rank, components, central_nodes, central_edges, label_communities, communities, community_overlaps, keywords, node_keywords,
    vocabulary, label_subtokens, label_entropy, term_idf, bm25, bm25_top, substring_search, indexed_substrings, index_search, refined_context, diff_contexts, fuzzy_terms, label_scores, search_seeds, node_lookup, hybrid_search,
)}

# ---- the same in SQL

_BOTH = "l AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst)"


def _gods_sql(top: int) -> str:
    return f"{KINDS}, g AS MATERIALIZED (SELECT id FROM k WHERE NOT is_file AND NOT is_concept AND NOT is_json_key AND NOT is_noise ORDER BY degree DESC, id LIMIT {top})"


_ASKED = "g AS MATERIALIZED (SELECT node_id AS id FROM node_metadata WHERE meta_id % 50 = 0)"


def _reach(edges: str, seeds: str, depth: int, gate: str = "") -> str:
    return f"""
walk AS (SELECT seed, id, 0 AS depth FROM ({seeds}) UNION SELECT seed, x.dst, depth + 1 FROM walk JOIN {edges} x ON x.src = walk.id WHERE depth < {depth} {gate}),
reached AS (SELECT seed, id, min(depth) AS depth FROM walk GROUP BY ALL)"""


def _back(relations: tuple[str, ...]) -> str:
    return f"b AS MATERIALIZED (SELECT DISTINCT dst AS src, src AS dst FROM e WHERE relation IN {listed(relations)})"


_MEMBERS = f"SELECT id AS seed, id FROM g UNION SELECT g.id, e.dst FROM g JOIN e ON e.src = g.id WHERE relation IN {listed(V.MEMBER)}"
_SEEDS = "SELECT id AS seed, id FROM g"


def _ranks(rounds: int, start: str) -> str:
    steps = [f"{_BOTH}, o AS MATERIALIZED (SELECT src, count(*) AS c FROM l GROUP BY src), ids AS MATERIALIZED ({start}), k0 AS MATERIALIZED (SELECT id, p AS rank FROM ids)"]
    for i in range(1, rounds + 1):
        steps.append(f"""k{i} AS MATERIALIZED (SELECT ids.id, 0.85 * coalesce(given, 0) + (0.85 * lost + (1 - 0.85)) * p AS rank FROM ids
          LEFT JOIN (SELECT l.dst AS id, sum(rank / c) AS given FROM l JOIN k{i - 1} r ON r.id = l.src JOIN o ON o.src = l.src GROUP BY l.dst) USING (id),
          (SELECT coalesce(sum(rank), 0) AS lost FROM k{i - 1} WHERE id NOT IN (SELECT src FROM o)))""")
    moved = " UNION ALL ".join(f"SELECT {i} AS i, sum(abs(a.rank - b.rank)) AS moved FROM k{i} a JOIN k{i - 1} b USING (id)" for i in range(1, rounds + 1))
    every = " UNION ALL ".join(f"SELECT {i} AS i, * FROM k{i}" for i in range(1, rounds + 1))
    return ", ".join([*steps, f"moved AS ({moved})", f"ranked AS (SELECT id, round(rank, 8) AS rank FROM ({every}) WHERE i = (SELECT min(i) FROM moved WHERE moved < 1e-6))"])


def _between(pivots: str, rest: str, levels: int = 20) -> str:
    """Brandes' algorithm from ``pivots``, unrolled to ``levels`` levels: nd (id, delta) and ed (a, b, share)."""
    steps = [f"{_BOTH}, size AS (SELECT count(DISTINCT id) AS n FROM n), p AS MATERIALIZED ({pivots}), v0 AS MATERIALIZED (SELECT id AS root, id, 1.0::DOUBLE AS sigma, 0 AS depth FROM p)"]
    for d in range(1, levels + 1):
        steps.append(f"""v{d} AS MATERIALIZED (SELECT * FROM v{d - 1} UNION ALL SELECT root, l.dst, sum(sigma), {d} FROM v{d - 1} v JOIN l ON l.src = v.id WHERE depth = {d - 1}
          AND (root, l.dst) NOT IN (SELECT (root, id) FROM v{d - 1}) GROUP BY root, l.dst)""")
    for d in range(levels, 0, -1):
        delta = "0" if d == levels else "coalesce(x.delta, 0)"
        below = "" if d == levels else f"LEFT JOIN (SELECT root, a AS id, sum(share) AS delta FROM b{d + 1} GROUP BY ALL) x ON x.root = w.root AND x.id = w.id"
        steps.append(f"""b{d} AS MATERIALIZED (SELECT u.root, u.id AS a, w.id AS b, u.sigma / w.sigma * (1 + {delta}) AS share
          FROM v{levels} w JOIN l ON l.src = w.id JOIN v{levels} u ON u.root = w.root AND u.id = l.dst AND u.depth = {d - 1} {below} WHERE w.depth = {d})""")
    every = " UNION ALL ".join(f"SELECT * FROM b{d}" for d in range(1, levels + 1))
    return ", ".join([*steps, f"every AS MATERIALIZED ({every})"]) + rest


_UNIFORM = "SELECT DISTINCT id, 1.0 / (SELECT count(DISTINCT id) FROM n) AS p FROM n"
_PERSONAL = "SELECT DISTINCT n.id, CASE WHEN g.id IS NULL THEN 0.0 ELSE 1.0 / (SELECT count(*) FROM g) END AS p FROM n LEFT JOIN g ON g.id = n.id"

_TERM = rf"""list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace({{x}}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[a-z0-9]+'),
  lambda t: length(t) > 1 AND NOT regexp_full_match(t, '[0-9]+') AND NOT list_contains([{", ".join("'" + w + "'" for w in sorted({*V.ENGLISH_STOPWORDS, *V.PROGRAM_STOPWORDS}))}], t))"""


def _keywords(rows: str, key: str, text: str, top: int) -> str:
    return f"""WITH {NODES}, d AS ({rows}), t AS (SELECT {key}, unnest({_TERM.format(x=text)}) AS term FROM d), f AS (SELECT {key}, term, count(*) AS tf FROM t GROUP BY ALL),
      q AS (SELECT term, count(*) AS df FROM f GROUP BY ALL),
      s AS (SELECT {key}, term, tf, round(tf * (ln(((SELECT count(*) FROM d) + 1) / (df + 1)) + 1), 9) AS score FROM f JOIN q USING (term))
      SELECT {key}, term, tf, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, tf DESC, term) AS rank FROM s) WHERE rank <= {top}"""


_SUB = r"""list_distinct(flatten(list_transform(list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z0-9_\-]+'), lambda t: regexp_replace(t, '^[-_]+|[-_]+$', '', 'g')), lambda t: t <> ''),
  lambda t: list_concat([t], list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(t, '[_\-]+', ' ', 'g'), '([A-Z]+)([A-Z][a-z0-9])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z0-9])', '\1 \2', 'g'), '[A-Z]?[a-z0-9]+|[A-Z]+'), lambda p: lower(p))))))"""


_SUB_ALL = _SUB.removeprefix("list_distinct(").removesuffix(")")


_LINE_OF = "TRY_CAST(regexp_extract(coalesce(source_location, ''), 'L?([0-9]+)', 1) AS INTEGER)"


def _stem_search(stems: list[str]) -> str:
    """BM25 over title, tags and body of documents, each stem given as the words that have it."""
    words = lambda c: f"regexp_extract_all(lower(strip_accents(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+')"
    tf = ", ".join("5.0 * len(list_filter(a, lambda w: regexp_full_match(w, '{0}'))) + 4.0 * len(list_filter(g, lambda w: regexp_full_match(w, '{0}'))) + 1.0 * len(list_filter(c, lambda w: regexp_full_match(w, '{0}'))) AS f{1}".format(x, i) for i, x in enumerate(stems))
    idf = lambda i: f"greatest(ln(((SELECT n FROM z) - (SELECT n{i} FROM z) + 0.5) / ((SELECT n{i} FROM z) + 0.5)), 1e-6)"
    score = " + ".join(f"{idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / (SELECT a FROM z)))" for i in range(len(stems)))
    return f"""t AS (SELECT doc_id AS id, {words("title")} AS a, {words("source")} AS g, {words("text")} AS c FROM documents),
      x AS MATERIALIZED (SELECT id, len(a) + len(g) + len(c) AS size, {tf} FROM t),
      z AS (SELECT count(*) AS n, avg(size) AS a, {", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(stems)))} FROM x)
      SELECT id, round({score}, 6) AS score FROM x WHERE {" OR ".join(f"f{i} > 0" for i in range(len(stems)))}"""


def _bm25(order: str = "") -> str:
    words = r"regexp_extract_all(lower(strip_accents(coalesce({x}, ''))), '[\p{{L}}\p{{N}}]+')"
    tf = ", ".join(f"5.0 * len(list_filter(a, lambda w: w = '{t}')) + 1.0 * len(list_filter(c, lambda w: w = '{t}')) AS f{i}" for i, t in enumerate(TERMS))
    idf = lambda i: f"greatest(ln(((SELECT n FROM z) - (SELECT n{i} FROM z) + 0.5) / ((SELECT n{i} FROM z) + 0.5)), 1e-6)"
    score = " + ".join(f"{idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / (SELECT a FROM z)))" for i in range(len(TERMS)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(TERMS)))
    return f"""WITH w AS (SELECT doc_id AS id, {words.format(x="title")} AS a, {words.format(x="text")} AS c FROM documents),
      f AS MATERIALIZED (SELECT id, len(a) + len(c) AS size, {tf} FROM w), z AS (SELECT count(*) AS n, avg(size) AS a, {", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(TERMS)))} FROM f)
      SELECT id, round({score}, 6) AS score FROM f WHERE {some} {order}"""


_SIMPLE = f"fw AS MATERIALIZED (SELECT DISTINCT src, dst FROM e WHERE (relation IN {listed(V.FORWARD)} OR relation = '') AND src <> dst)"

ORACLES = {
    "callers": f"""WITH {GRAPH}, c AS (SELECT DISTINCT src, dst FROM e WHERE relation IN {listed(V.CALLS)}) SELECT dst AS callee, count(*) AS callers,
      count(*) FILTER (u.source_file IS DISTINCT FROM v.source_file) AS from_other_files FROM c JOIN n u ON u.id = src JOIN n v ON v.id = dst GROUP BY dst""",
    "references_elsewhere": f"""WITH {GRAPH}, c AS (SELECT DISTINCT src, dst, relation FROM e WHERE relation NOT IN {listed(V.NOT_A_REFERENCE)}) SELECT dst AS id, relation, count(*) AS refs
      FROM c JOIN n u ON u.id = src JOIN n v ON v.id = dst WHERE u.source_file <> v.source_file GROUP BY ALL""",
    "neighbourhood": f"WITH RECURSIVE {GRAPH}, {_ASKED}, {_BOTH}, {_reach('l', _SEEDS, 2)} SELECT seed, id, CAST(depth AS INTEGER) AS depth FROM reached",
    "neighbourhood_gated": f"""WITH RECURSIVE {GRAPH}, {_ASKED}, {_BOTH}, h AS MATERIALIZED (SELECT id FROM deg WHERE degree >= 50 AND degree >= (SELECT list_sort(list(degree))[CAST(floor(count(*) * 0.99) AS BIGINT) + 1] FROM deg)),
      {_reach('l', _SEEDS, 3, "AND (depth = 0 OR walk.id NOT IN (SELECT id FROM h))")} SELECT seed, id, CAST(depth AS INTEGER) AS depth FROM reached""",
    "neighbourhood_edges": f"""WITH RECURSIVE {GRAPH}, {_ASKED}, {_BOTH}, {_reach('l', _SEEDS, 1)}
      SELECT edge_id, src, dst, relation FROM e WHERE src IN (SELECT id FROM reached) AND dst IN (SELECT id FROM reached)""",
    "affected": f"WITH RECURSIVE {GRAPH}, {_ASKED}, {_back(V.AFFECTED)}, {_reach('b', _MEMBERS, 2)} SELECT seed, id, CAST(depth AS INTEGER) AS depth FROM reached WHERE depth > 0",
    "impact_closure": f"WITH RECURSIVE {GRAPH}, {_ASKED}, {_back(V.IMPACT)}, {_reach('b', _MEMBERS, 10)} SELECT seed, id, CAST(depth AS INTEGER) AS depth FROM reached WHERE depth > 0",
    "impact_scores": f"""WITH RECURSIVE {GRAPH}, {KINDS}, {Q.RULED}, {_ASKED}, {_back(V.IMPACT)}, {_reach('b', _MEMBERS, 10)}, {_ranks(40, _UNIFORM)},
      fd AS (SELECT DISTINCT seed, id FROM reached WHERE depth > 0 AND id <> seed), real AS (SELECT id, degree FROM k WHERE NOT is_file AND NOT is_concept AND NOT is_noise),
      thr AS (SELECT greatest(coalesce((SELECT degree FROM real ORDER BY degree DESC LIMIT 1 OFFSET (SELECT greatest(0, CAST(floor(count(*) * 0.05) AS BIGINT) - 1) FROM real)), 10), 10) AS t),
      fl AS (SELECT id, {Q.TEST} AS test, {Q.API} AS api, {Q.INFRA} AS infra, CASE WHEN source_file IS NOT NULL THEN split_part(source_file, '/', 1) END AS community FROM (SELECT w.* REPLACE (lower(coalesce(file_type, '')) AS k) FROM w)),
      sm AS (SELECT seed AS id, count(*) AS dependents, count(*) FILTER (test) AS tests, count(*) FILTER (api) AS apis, count(*) FILTER (infra) AS infrastructure,
        count(*) FILTER (fd.id IN (SELECT id FROM real, thr WHERE degree >= t)) AS gods, count(DISTINCT community) AS communities FROM fd JOIN fl ON fl.id = fd.id GROUP BY seed),
      sc AS (SELECT g.id, coalesce(dependents, 0) AS dependents, coalesce(tests, 0) AS tests, coalesce(apis, 0) AS apis, coalesce(infrastructure, 0) AS infrastructure, coalesce(gods, 0) AS gods, coalesce(communities, 0) AS communities,
        round(least(0.4, 0.4 * (ln(coalesce(dependents, 0) + 1) / ln(50))) + least(0.25, coalesce(gods, 0) * 0.125) + least(0.2, coalesce(communities, 0) * 0.05)
          + 0.15 * least(1.0, coalesce(rank, 0) / (SELECT max(rank) FROM ranked)), 3) AS risk FROM g LEFT JOIN sm ON sm.id = g.id LEFT JOIN ranked ON ranked.id = g.id)
      SELECT *, CASE WHEN risk >= 0.7 THEN 'CRITICAL' WHEN risk >= 0.45 THEN 'HIGH' WHEN risk >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM sc""",
    "implementations": f"WITH RECURSIVE {GRAPH}, {_ASKED}, {_back(V.SUBTYPE)}, {_reach('b', _SEEDS, 8)} SELECT seed, id, CAST(depth AS INTEGER) AS depth FROM reached WHERE depth > 0",
    "method_flows": f"""WITH RECURSIVE {GRAPH}, {_SIMPLE}, p AS (SELECT id AS start, id AS stop, [id] AS path FROM n WHERE node_kind = 'heading'
      UNION ALL SELECT start, fw.dst, list_append(path, fw.dst) FROM p JOIN fw ON fw.src = stop WHERE NOT list_contains(path, fw.dst) AND len(path) <= 3)
      SELECT start, stop AS sink, CAST(len(path) - 1 AS INTEGER) AS length, array_to_string(path, '>') AS path FROM p JOIN n ON n.id = stop WHERE node_kind = 'resource' AND len(path) > 1""",
    "page_rank": f"WITH {GRAPH}, {_ranks(40, _UNIFORM)} SELECT id, rank FROM ranked",
    "personal_rank": f"WITH {GRAPH}, {_gods_sql(3)}, {_ranks(40, _PERSONAL)} SELECT id, rank FROM ranked",
    "central_nodes": "WITH " + GRAPH + ", " + _between(
        "SELECT DISTINCT id FROM n ORDER BY md5(id), id LIMIT (SELECT CASE WHEN count(DISTINCT id) <= 1000 THEN count(DISTINCT id) ELSE least(100, greatest(20, count(DISTINCT id) * 2 // 100)) END FROM n)",
        """ SELECT id, round(coalesce(delta, 0) * (n / (SELECT count(*) FROM p)) / ((n - 1) * (n - 2)), 9) AS betweenness FROM (SELECT DISTINCT id FROM n) LEFT JOIN
        (SELECT a AS id, sum(share) AS delta FROM every WHERE a <> root GROUP BY a) USING (id), size"""),
    "central_edges": "WITH " + GRAPH + ", " + _between(
        "SELECT DISTINCT id FROM n ORDER BY md5(id), id LIMIT (SELECT CASE WHEN count(DISTINCT id) <= 500 THEN count(DISTINCT id) ELSE least(50, greatest(20, count(DISTINCT id) // 100)) END FROM n)",
        """ SELECT a, b, round(coalesce(share, 0) * (n / (SELECT count(*) FROM p)) / (n * (n - 1)), 9) AS betweenness FROM (SELECT src AS a, dst AS b FROM l WHERE src < dst) LEFT JOIN
        (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(share) AS share FROM every GROUP BY ALL) USING (a, b), size"""),
    "components": f"""WITH RECURSIVE {GRAPH}, s AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, dst, relation, confidence FROM e UNION ALL SELECT dst, src, relation, confidence FROM e)
      WHERE confidence = 'EXTRACTED' AND relation IN ('contains', 'method', 'part_of', 'has_part', 'parent_of')),
      c AS (SELECT DISTINCT id, id AS at FROM n UNION SELECT c.id, s.dst FROM c JOIN s ON s.src = c.at) SELECT id, min(at) AS component FROM c GROUP BY id""".replace(" AS at", " AS other").replace("c.at", "c.other").replace("min(at)", "min(other)"),
    "label_communities": "WITH " + GRAPH + ", " + _BOTH + ", c0 AS MATERIALIZED (SELECT DISTINCT id, id AS community FROM n), " + ", ".join(
        f"""c{i} AS MATERIALIZED (SELECT c.id, coalesce(x, community) AS community FROM c{i - 1} c LEFT JOIN (SELECT id, arg_min(community, {{'n': -n, 'c': community}}) AS x
        FROM (SELECT l.dst AS id, community, count(*) AS n FROM l JOIN c{i - 1} v ON v.id = l.src GROUP BY ALL) GROUP BY id) USING (id))""" for i in range(1, 6)) + " SELECT * FROM c5",
    "community_overlaps": f"""WITH {NODES} SELECT split_part(source_file, '/', 1) AS old, coalesce(node_kind, '') AS new, count(*) AS shared FROM n WHERE source_file IS NOT NULL GROUP BY ALL""",
    "keywords": _keywords("SELECT doc_id, text FROM documents", "doc_id", "coalesce(text, '')", 5),
    "node_keywords": _keywords("SELECT id, concat_ws(' ', label, content) AS text FROM n", "id", "text", 3),
    "vocabulary": f"""WITH {NODES}, t AS (SELECT id, list_distinct(list_filter(list_transform({_SUB.format(x="concat_ws(chr(10), label, content)")}, lambda t: lower(t)), lambda t: length(t) >= 2)) AS ts FROM n),
      u AS (SELECT unnest(ts) AS term FROM t) SELECT term, count(*) AS doc_count FROM u GROUP BY term""",
    "label_subtokens": f"""WITH {NODES}, t AS (SELECT id, {_SUB_ALL.format(x="label")} AS ts FROM n)
      SELECT id, coalesce(array_to_string(list_filter(ts, lambda t, i: list_position(ts, t) = i), ' '), '') AS parts FROM t""",
    "label_entropy": rf"""WITH {NODES}, q AS (SELECT id, trim(regexp_replace(lower(label), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS key FROM n), c AS (SELECT id, unnest(string_split(key, '')) AS ch FROM q WHERE key <> ''),
      f AS (SELECT id, ch, count(*) AS c FROM c GROUP BY ALL), h AS (SELECT id, sum(c) AS s FROM f GROUP BY id), x AS (SELECT id, -sum(c / s * log2(c / s)) AS entropy FROM f JOIN h USING (id) GROUP BY id)
      SELECT id, key, round(coalesce(entropy, 0), 6) AS entropy FROM q LEFT JOIN x USING (id)""",
    "term_idf": f"""WITH {NODES}, t AS (SELECT unnest({TERMS}) AS term), d AS (SELECT term, count(*) FILTER (contains(lower(strip_accents(label)), term)) AS df FROM t, n GROUP BY term)
      SELECT term, df, round(ln(1 + (SELECT count(*) FROM n) / (1 + df)), 9) AS idf FROM d""",
    "bm25": _bm25(),
    "bm25_top": _bm25("ORDER BY score DESC, id LIMIT 20"),
    "substring_search": f"WITH {NODES}, t AS (SELECT unnest({NEEDLES}) AS needle) SELECT needle, id FROM n, t WHERE contains(lower(label), needle)",
    "indexed_substrings": f"WITH {NODES}, t AS (SELECT unnest({NEEDLES}) AS needle) SELECT needle, id FROM n, t WHERE contains(lower(label), needle)",
    "index_search": "WITH " + _stem_search(["renam(e|es|ed|ing)", "describ(e|es|ed|ing)", "patient(s|ly)?", "compil(e|es|ed|er|ers|ing)"]),
    "diff_contexts": f"""WITH {GRAPH}, ln AS (SELECT DISTINCT strftime(made_at, '%Y-%m-%d') AS diff_id, source_file AS a, {_LINE_OF} AS first FROM e WHERE source_file IS NOT NULL AND made_at IS NOT NULL),
      l AS (SELECT id, source_file AS b, {_LINE_OF} AS first FROM n WHERE source_file IS NOT NULL),
      s AS (SELECT id, b, first, CASE WHEN lead(first) OVER (PARTITION BY b ORDER BY first, id) IS NULL THEN 2147483647 ELSE greatest(lead(first) OVER (PARTITION BY b ORDER BY first, id) - 1, first) END AS last FROM l WHERE first IS NOT NULL UNION ALL SELECT id, b, NULL, NULL FROM l WHERE first IS NULL),
      c AS MATERIALIZED (SELECT DISTINCT diff_id, id FROM ln JOIN s ON regexp_extract(a, '[^/]*$') = regexp_extract(b, '[^/]*$') AND (a = b OR ends_with(a, '/' || b) OR ends_with(b, '/' || a))
        AND (s.first IS NULL OR (s.first <= ln.first + 5 AND s.last >= ln.first)) WHERE ln.first IS NOT NULL),
      nb AS (SELECT src AS id, dst AS other, relation FROM e UNION SELECT dst, src, relation FROM e),
      near AS (SELECT c.diff_id, other, relation, lower(coalesce(source_file, '')) AS f FROM c JOIN nb USING (id) JOIN n ON n.id = other WHERE other <> c.id)
      SELECT diff_id, 'changed' AS role, id FROM c UNION ALL SELECT DISTINCT c.diff_id, 'caller', src FROM c JOIN e ON dst = c.id AND relation IN {listed(V.CALLS)} WHERE (c.diff_id, src) NOT IN (SELECT (diff_id, id) FROM c)
      UNION ALL SELECT DISTINCT diff_id, 'test', other FROM near WHERE contains(lower(other), 'test') OR contains(f, 'test')
      UNION ALL SELECT DISTINCT diff_id, 'endpoint', other FROM near WHERE relation IN ('route', 'endpoint', 'api') OR contains(lower(other), 'route')""",
    "fuzzy_terms": f"""WITH {NODES}, t AS (SELECT id, list_distinct(list_filter(list_transform({_SUB.format(x="label")}, lambda t: lower(t)), lambda t: length(t) >= 2)) AS ts FROM n),
      v AS (SELECT DISTINCT unnest(ts) AS m FROM t), a AS (SELECT unnest(['lede', 'brokr', 'vehcle', 'mnaifest', 'ledger', 'ax']) AS term),
      d AS (SELECT term, m, levenshtein(m, term) AS distance FROM v, a WHERE levenshtein(m, term) <= CASE WHEN length(term) >= 5 THEN 2 WHEN length(term) = 4 THEN 1 ELSE 0 END AND (m = term OR length(m) >= 4)),
      r AS (SELECT *, min(distance) OVER (PARTITION BY term) AS least FROM d), x AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY m) AS rk FROM r WHERE distance = least)
      SELECT term, m AS match, CAST(distance AS INTEGER) AS distance FROM x WHERE rk <= 3""",
}


def _levels(depth: int) -> str:
    """Shortest paths level by level, each node's least path."""
    steps = ["d AS MATERIALIZED (SELECT DISTINCT src, dst FROM e), v0 AS MATERIALIZED (SELECT id AS seed, id, [id] AS path FROM g)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT seed, id FROM v{j}" for j in range(k))
        steps.append(f"""v{k} AS MATERIALIZED (SELECT seed, dst AS id, list_append(min(path), dst) AS path FROM v{k - 1} v JOIN d ON d.src = v.id
          WHERE (seed, dst) NOT IN ({seen}) GROUP BY seed, dst)""")
    return ", ".join(steps)


_LABEL = "lower(strip_accents(label))"
_WORDS = r"array_to_string(regexp_extract_all(lower(strip_accents({x})), '[\p{{L}}\p{{N}}]+'), ' ')"


def _label_scores(terms: list[str]) -> str:
    q = " ".join(terms)
    idf = {t: f"(SELECT ln(1 + count(*) / (1 + count(*) FILTER (contains({_LABEL}, '{t}')))) FROM n)" for t in terms}
    exact, begins = "(lb = '{t}' OR bare = '{t}')", "(starts_with(lb, '{t}') OR starts_with(bare, '{t}'))"
    tier = " + ".join(f"CASE WHEN {exact.format(t=t)} THEN 1000.0 * i{k} WHEN {begins.format(t=t)} THEN 100.0 * i{k} ELSE 0 END" for k, t in enumerate(terms))
    inside = " + ".join(f"CASE WHEN {exact.format(t=t)} OR {begins.format(t=t)} THEN 0 WHEN contains(lb, '{t}') THEN i{k} ELSE 0 END + CASE WHEN contains(f, '{t}') THEN 0.5 * i{k} ELSE 0 END" for k, t in enumerate(terms))
    matched = " + ".join(f"CASE WHEN contains(lb, '{t}') THEN 1 ELSE 0 END" for t in terms)
    top = "greatest(" + ", ".join(f"i{k}" for k in range(len(terms))) + ")"
    return f"""x AS (SELECT id, label, {_LABEL} AS lb, regexp_replace({_LABEL}, '[()]+$', '') AS bare, lower(coalesce(source_file, '')) AS f, {_WORDS.format(x="label")} AS w FROM n),
      y AS (SELECT {", ".join(f"{idf[t]} AS i{k}" for k, t in enumerate(terms))}),
      ls AS (SELECT id, label, CASE WHEN '{q}' IN (lb, bare, w, lower(id)) THEN 10000.0 * {top} WHEN starts_with(lb, '{q}') OR starts_with(bare, '{q}') OR starts_with(w, '{q}') THEN 1000.0 * {top} ELSE 0 END
        + {inside} + ({tier}) * power(({matched}) / {float(len(terms))}, 2) AS score, CAST({matched} AS INTEGER) AS matched FROM x, y)"""


ORACLES |= {
    "shortest_paths": f"WITH {GRAPH}, {_ASKED}, {_levels(8)} " + " UNION ALL ".join(f"SELECT seed, id, CAST({k} AS INTEGER) AS depth, array_to_string(path, '>') AS path FROM v{k}" for k in range(9)),
    "execution_flows": f"""WITH RECURSIVE {GRAPH}, {Q.RULED}, c AS MATERIALIZED (SELECT id, {Q.CATEGORY} AS category FROM w), {_SIMPLE},
      p AS (SELECT id AS start, id AS stop, [id] AS path FROM c WHERE category IN {listed(P.ENTRY_CATEGORIES)}
        UNION ALL SELECT start, fw.dst, list_append(path, fw.dst) FROM p JOIN fw ON fw.src = stop WHERE NOT list_contains(path, fw.dst) AND len(path) <= 3)
      SELECT start, stop AS sink, CAST(len(path) - 1 AS INTEGER) AS length, array_to_string(path, '>') AS path FROM p JOIN c ON c.id = stop WHERE category IN {listed(P.SINK_CATEGORIES)} AND len(path) > 1""",
    "label_scores": f"WITH {NODES}, {_label_scores(['build', 'symbol'])} SELECT id, round(score, 6) AS score, matched FROM ls WHERE score > 0",
    "search_seeds": f"""WITH {NODES}, {_label_scores(['build', 'symbol'])}, o AS (SELECT id, score, row_number() OVER (PARTITION BY lower(label) ORDER BY score DESC, id DESC) AS r FROM ls WHERE score > 0)
      SELECT id, round(score, 6) AS score FROM o WHERE r = 1 AND score >= 0.2 * (SELECT max(score) FROM o) ORDER BY o.score DESC, id LIMIT 3""",
    "node_lookup": f"""WITH {NODES}, x AS (SELECT id, {_LABEL} AS lb, regexp_replace({_LABEL}, '[()]+$', '') AS bare, {_WORDS.format(x="label")} AS w, {_WORDS.format(x="coalesce(source_file, '')")} AS f, lower(id) AS k FROM n),
      t AS (SELECT id, CASE WHEN f = 'build symbol' THEN 0 WHEN 'build symbol' IN (lb, bare, w, k) OR 'build_symbol' IN (lb, bare, k) THEN 1
        WHEN {" OR ".join(f"starts_with({c}, '{q}')" for c in ("lb", "bare", "w", "k") for q in ("build symbol", "build_symbol"))} THEN 2 WHEN contains(lb, 'build symbol') OR contains(w, 'build symbol') OR contains(lb, 'build_symbol') THEN 3 END AS tier FROM x)
      SELECT id, CAST(tier AS INTEGER) AS tier FROM t WHERE tier = (SELECT min(tier) FROM t)""",
}
