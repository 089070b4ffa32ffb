"""What a reader or an agent is told about a graph: questions, explanations, sections, diagrams, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import predicates as P
from quillgraph.functions import text as T
from quillgraph.functions import vocabulary as V
from quillgraph.operators.analyze import cohesion, degrees, god_nodes, isolated, kinds
from quillgraph.operators.build import Graph
from quillgraph.operators.walks import both_ways


def questions(graph: Graph, members: DataFrame, bridges: DataFrame | None = None, top: int = 7) -> DataFrame:
    """(rank, type, subject, detail): what a graph cannot answer by itself.

    Ambiguous edges first, then ``bridges`` (id, betweenness) between communities ``members`` (id, community), well-connected
    nodes with two inferred edges or more, isolated nodes, and communities of five or more with a cohesion below 0.15.
    """
    label = graph.nodes.select("id", "label")
    name = lambda key, out: label.select(F.col("id").alias(key), F.col("label").alias(out))
    row = lambda df, order, kind, subject, detail, by: df.select(F.lit(order).alias("o"), by.alias("by"), F.lit(kind).alias("type"), subject.alias("subject"), detail.alias("detail"))
    vague = graph.edges.where("confidence = 'AMBIGUOUS'").join(name("src", "ls"), "src").join(name("dst", "ld"), "dst")
    rows = [row(vague, 1, "ambiguous_edge", F.concat_ws(" - ", "ls", "ld"), F.col("relation"), F.lit(0.0))]
    n = kinds(graph, degrees(graph.nodes, graph.edges))
    if bridges is not None:
        near = both_ways(graph.edges).join(members.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src").join(members.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst")
        crossing = near.where("cs != cd").groupBy(F.col("src").alias("id")).agg(F.count_distinct("cd").alias("others"))
        best = n.where("not is_file and not is_concept").join(bridges, "id").join(crossing, "id").where("betweenness > 0").orderBy(F.desc("betweenness"), "id").limit(3)
        rows.append(row(best, 2, "bridge_node", F.col("label"), F.concat(F.col("others").cast("string"), F.lit(" other communities")), -F.col("betweenness")))
    ends = graph.edges.where("confidence = 'INFERRED'").select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("inferred"))
    busy = n.where("not is_file").orderBy(F.desc("degree"), "id").limit(5).join(ends, "id").where("inferred >= 2")
    rows.append(row(busy, 3, "verify_inferred", F.col("label"), F.concat(F.col("inferred").cast("string"), F.lit(" inferred edges")), -F.col("degree").cast("double")))
    alone = isolated(graph).agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first")).where("n > 0")
    rows.append(row(alone, 4, "isolated_nodes", F.col("first"), F.concat(F.col("n").cast("string"), F.lit(" weakly connected nodes")), F.lit(0.0)))
    pairs = both_ways(graph.edges).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    loose = cohesion(members, pairs).where("size >= 5 and cohesion < 0.15")
    rows.append(row(loose, 5, "low_cohesion", F.col("community").cast("string"), F.round("cohesion", 4).cast("string"), -F.col("size").cast("double")))
    every = reduce(DataFrame.unionByName, rows).orderBy("o", "by", "subject", "detail").limit(top)
    rank = F.row_number().over(Window.orderBy("o", "by", "subject", "detail"))
    return every.select(rank.alias("rank"), "type", "subject", "detail")


def community_links(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, other, edges): how many edges lead from each community to each other one, both ways."""
    side = lambda key, name: members.select(F.col("id").alias(key), F.col("community").alias(name))
    rows = edges.join(side("src", "cs"), "src").join(side("dst", "cd"), "dst").where("cs != cd")
    both = rows.select(F.explode(F.array(F.struct(F.col("cs").alias("community"), F.col("cd").alias("other")), F.struct(F.col("cd").alias("community"), F.col("cs").alias("other")))).alias("x"))
    return both.groupBy("x.community", "x.other").agg(F.count(F.lit(1)).alias("edges"))


def classified_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(class, edges): inside a section, between two, or with an end in none."""
    side = lambda key, name: members.select(F.col("id").alias(key), F.col("community").alias(name))
    rows = edges.join(side("src", "cs"), "src", "left").join(side("dst", "cd"), "dst", "left")
    kind = F.when(F.col("cs").isNull() | F.col("cd").isNull(), "orphan").when(F.col("cs") == F.col("cd"), "intra").otherwise("inter")
    return rows.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("edges"))


def top_labels(members: DataFrame, graph: Graph, top: int = 5) -> DataFrame:
    """(community, labels): the labels of the best connected members of each community.

    Each community's candidates are cut to ``top`` by a rank, so its list stays short.
    """
    rows = members.join(degrees(graph.nodes, graph.edges), "id").join(graph.nodes.select("id", "label"), "id")
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id"))
    best = rows.withColumn("r", rank).where(F.col("r") <= top)
    return best.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("r", "label"))).alias("x")).select("community", F.array_join(F.col("x.label"), ", ").alias("labels"))


def hyperedge_communities(hyperedges: DataFrame, members: DataFrame) -> DataFrame:
    """(id, communities): hyperedges that join at least two communities."""
    rows = hyperedges.select("id", F.explode("nodes").alias("m")).join(members.select(F.col("id").alias("m"), "community"), "m")
    return rows.groupBy("id").agg(F.array_sort(F.collect_set("community")).alias("communities")).where(F.size("communities") >= 2)


# Words that show what a section is about.
SECTIONS = {
    "interface": "route endpoint api controller handler view page component",
    "data": "table model schema repository store database query migration",
    "messaging": "queue topic event message broker stream publish subscribe",
    "security": "auth login token permission session guard secret",
    "infrastructure": "docker deploy helm terraform config pipeline build release",
    "testing": "test mock fixture assert spec",
    "documentation": "readme guide note docs tutorial heading",
}


def sections(members: DataFrame, graph: Graph, least: int = 2) -> DataFrame:
    """(community, section, hits): what each community is about by the words in its members' labels and files; ``other`` below ``least`` hits."""
    text = F.lower(F.concat_ws(" ", "label", F.coalesce("source_file", F.lit(""))))
    rows = members.join(graph.nodes.select("id", text.alias("t")), "id")
    counts = rows.groupBy("community").agg(*(F.count_if(reduce(Column.__or__, (F.col("t").contains(w) for w in words.split()))).alias(s) for s, words in SECTIONS.items()))
    best = F.greatest(*SECTIONS)
    name = F.lit("other")
    for s in reversed(SECTIONS):
        name = F.when(F.col(s) == best, s).otherwise(name)
    return counts.select("community", F.when(best >= least, name).otherwise("other").alias("section"), best.alias("hits"))


def diagram_edges(graph: Graph, top: int = 40) -> DataFrame:
    """(src, dst, relation, score): the edges to draw first: sure ones, calls and uses before imports, containment last."""
    relation = F.col("relation")
    score = (
        F.when(F.col("confidence") == "EXTRACTED", 2.0).otherwise(0.0) + F.when(relation.isin("calls", "uses", "method"), 1.0).when(relation.isin("imports", "imports_from"), 0.6)
        .when(relation == "contains", -0.2).when(relation == "rationale_for", -0.6).otherwise(0.0)
    )
    return graph.edges.select("src", "dst", "relation", score.alias("score")).distinct().orderBy(F.desc("score"), "src", "dst", "relation").limit(top)


def entry_nodes(graph: Graph, top: int = 10) -> DataFrame:
    """(id, surplus): code that calls more than it is called, the likely ways in."""
    calls = graph.edges.where(F.col("relation").isin(*V.CALLS) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()
    sides = calls.select(F.col("src").alias("id"), F.lit(1).alias("d")).unionByName(calls.select(F.col("dst").alias("id"), F.lit(-1).alias("d")))
    code = graph.nodes.where("file_type = 'code'").select("id")
    return sides.groupBy("id").agg(F.sum("d").alias("surplus")).join(code, "id", "left_semi").orderBy(F.desc("surplus"), "id").limit(top)


def scoped(nodes: DataFrame, name: str) -> DataFrame:
    """(id, source_file, certain): nodes of ``path::symbol``; certain if they all lie in one file."""
    path, _, symbol = name.partition("::")
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.col("label"), r"[()]+$", ""), r"^\.", ""))
    hit = nodes.where((bare == symbol.strip().lower()) & P.same_path(F.lower(P.text_of(F.col("source_file"))), F.lit(path.strip().lower())))
    files = hit.agg(F.count_distinct("source_file").alias("files"))
    return hit.join(F.broadcast(files)).select("id", "source_file", (F.col("files") == 1).alias("certain"))


def token_savings(rows: DataFrame, text: Column, shown: Column) -> DataFrame:
    """(all_tokens, shown_tokens, ratio): what reading everything costs against what is shown, at four characters a token."""
    sums = rows.agg(F.sum(T.token_estimate(F.coalesce(text, F.lit("")))).alias("all_tokens"), F.sum(F.when(shown, T.token_estimate(F.coalesce(text, F.lit("")))).otherwise(0)).alias("shown_tokens"))
    return sums.withColumn("ratio", F.col("all_tokens") / F.greatest(F.col("shown_tokens"), F.lit(1)))


def briefing(graph: Graph, scores: DataFrame, budget: int = 2000) -> DataFrame:
    """(rank, tier, id, label, tokens): what fits a budget of tokens: the best matches in full, the next as signatures, the rest as names.

    ``scores`` (id, score). A tenth of the ranked nodes are told in full and a third as signatures, and the running sum
    of their costs decides what still fits.
    """
    rows = scores.join(graph.nodes.select("id", "label", F.coalesce("content", F.lit("")).alias("content")), "id")
    rows = rows.orderBy(F.desc("score"), "id").limit(max(20, budget // 10))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    rows = rows.withColumn("rank", rank)
    tier = F.when(F.col("rank") <= max(2, budget // 200), 1).when(F.col("rank") <= max(5, budget // 60), 2).otherwise(3)
    cost = F.when(F.col("tier") == 1, T.token_estimate(F.col("content")) + 8).when(F.col("tier") == 2, T.token_estimate(F.substring_index("content", "\n", 1)) + 8).otherwise(T.token_estimate(F.col("label")) + 4)
    rows = rows.withColumn("tier", tier).withColumn("tokens", cost)
    upto = F.sum("tokens").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", upto).where(F.col("upto") <= budget).select("rank", "tier", "id", "label", "tokens")


def overview(graph: Graph, members: DataFrame) -> DataFrame:
    """(topic, subject, value): the lines of a report: counts, best connected nodes, largest communities."""
    counts = graph.nodes.agg(F.count(F.lit(1)).alias("v")).select(F.lit("nodes").alias("topic"), F.lit("").alias("subject"), "v")
    counts = counts.unionByName(graph.edges.agg(F.count(F.lit(1)).alias("v")).select(F.lit("edges").alias("topic"), F.lit("").alias("subject"), "v"))
    gods = god_nodes(graph).select(F.lit("god_node").alias("topic"), F.col("label").alias("subject"), F.col("degree").alias("v"))
    size = members.groupBy("community").agg(F.count(F.lit(1)).alias("v")).orderBy(F.desc("v"), "community").limit(3)
    return counts.unionByName(gods).unionByName(size.select(F.lit("community").alias("topic"), F.col("community").cast("string").alias("subject"), "v")).withColumnRenamed("v", "value")
