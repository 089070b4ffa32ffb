"""Lint rules, lessons from past questions, reviews of changes, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import predicates as P
from quillgraph.functions import vocabulary as V
from quillgraph.operators.skew import met_within
from quillgraph.session import cut

FINDING = ("rule", "severity", "subject", "detail")


def _finding(rows: DataFrame, rule: str, severity: str, subject: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.alias("subject"), detail.alias("detail"))


def dangling_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    from quillgraph.operators.build import dangling

    return _finding(dangling(edges, nodes), "dangling_reference", "error", F.col("node_id"), F.concat_ws(" ", "endpoint", "relation"))


def orphan_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return _finding(nodes.join(ends, "id", "left_anti"), "orphan_node", "info", F.col("id"), F.col("label"))


def dead_code(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Functions, methods and classes that nothing refers to; tests, entry points and dunder names are left out."""
    used = edges.where(F.col("relation").isin(*V.DEAD_CODE_INBOUND) & (F.col("src") != F.col("dst"))).select(F.col("dst").alias("id")).distinct()
    name = F.regexp_replace(F.regexp_replace(F.col("label"), r"^[()]+|[()]+$", ""), r"^\.+", "")
    rows = nodes.where((F.col("file_type") == "code") & F.col("node_kind").isin("function", "method", "class")).withColumn("name", name)
    file = F.lower(P.base_name(P.text_of(F.col("source_file"))))
    path = P.text_of(F.col("source_file"))
    test = file.startswith("test_") | file.endswith("_test.py") | path.contains("/tests/") | path.contains("/test/") | F.col("name").startswith("test_")
    plain = (F.col("name") != "") & ~(F.col("name").startswith("__") & F.col("name").endswith("__")) & ~F.col("name").isin(*V.ENTRY_NAMES)
    return _finding(rows.where(plain & ~test).join(used, "id", "left_anti"), "dead_code", "warning", F.col("id"), F.col("name"))


def environment_drift(resources: DataFrame, first: str = "staging", second: str = "prod") -> DataFrame:
    """Resources (kind, name, source_file) that only one of two environments has; the environment's name is no part of the resource's."""
    env = P.environment(F.col("source_file"))
    rows = resources.withColumn("env", env).where(F.col("env").isin(first, second))
    name = F.lower(F.regexp_replace("name", r"(?i)[-_](staging|prod|dev|qa|uat|test|stage|development|production)|(staging|prod|dev|qa|uat|test|stage|development|production)[-_]", ""))
    rows = rows.select(F.concat_ws("::", F.coalesce("kind", F.lit("resource")), name).alias("resource"), "env").groupBy("resource").agg(F.collect_set("env").alias("envs"))
    only = rows.where(F.size("envs") == 1)
    return _finding(only, "environment_drift", "warning", F.col("resource"), F.get(F.col("envs"), F.lit(0)))


def unpinned_actions(actions: DataFrame) -> DataFrame:
    """Actions (action, pin) that are not pinned to a full commit hash."""
    rows = actions.select("action", F.coalesce("pin", F.lit("")).alias("pin")).distinct().where(~F.col("pin").rlike("^[0-9a-fA-F]{40}$"))
    return _finding(rows, "unpinned_github_action", "warning", F.col("action"), F.when(F.col("pin") == "", "unversioned").otherwise(F.col("pin")))


def lint(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All findings on a graph whose edges may dangle: (rule, severity, subject, detail). The edges are read once for all rules."""
    edges = cut(edges.select("edge_id", "src", "dst", "relation"), "lint")
    return reduce(DataFrame.unionByName, (f(edges, nodes) for f in (dangling_references, orphan_nodes, dead_code)))


def lessons(signals: DataFrame, now: Column, half_life_days: float = 30.0, least: int = 2, area: str | None = None) -> DataFrame:
    """(area, node, pos, neg, score, last, verdict): what past answers say of nodes, newer ones weighing more.

    ``signals`` (node, outcome, at): useful counts for a node, dead_end and corrected against it. With signals of both kinds
    the node is contested; with ``least`` good ones it is preferred, else tentative. With ``area``, a column, there is
    a row for each area and one over all (null area) from the same pass. Scores are not rounded; verdicts take those below
    half a millionth as even.
    """
    sign = F.when(F.col("outcome") == "useful", 1).when(F.col("outcome").isin("dead_end", "corrected"), -1)
    rows = signals.withColumn("sign", sign).where("sign is not null and node is not null")
    rows = rows.withColumn("weighed", F.col("sign") * P.decay(F.col("at"), now, half_life_days))
    if area is None:
        rows, keys, sets = rows.withColumn("area", F.lit(None).cast("string")), ["area", "node"], None
    else:
        rows, keys, sets = rows.withColumn("area", F.col(area)), ["area", "node"], [["area", "node"], ["node"]]
    grouped = rows.groupBy(*keys) if sets is None else rows.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in keys))
    sums = grouped.agg(F.count_if(F.col("sign") > 0).alias("pos"), F.count_if(F.col("sign") < 0).alias("neg"), F.sum("weighed").alias("score"), F.max("at").alias("last"))
    near = F.round("score", 6)
    both = F.when(near > 0, "contested: useful").when(near < 0, "contested: dead end").otherwise("contested: even")
    verdict = F.when((F.col("pos") > 0) & (F.col("neg") > 0), both).when(F.col("pos") >= least, "preferred").when(F.col("pos") > 0, "tentative").otherwise("dead end")
    return sums.withColumn("verdict", verdict)


def parse_hunks(lines: DataFrame) -> DataFrame:
    """(diff_id, file, first, last): changed line ranges of unified diffs without context, from their lines (diff_id, pos, line)."""
    name = F.when(F.col("line").startswith("+++ "), F.regexp_replace("line", r"^\+\+\+ (b/)?", ""))
    file = F.last(name, True).over(Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    rows = lines.withColumn("file", file).where(F.col("line").rlike(hunk) & (F.col("file") != "/dev/null"))
    start, count = F.regexp_extract("line", hunk, 1).cast("int"), F.regexp_extract("line", hunk, 2)
    return rows.select("diff_id", "file", start.alias("first"), (start + F.greatest(F.when(count == "", 1).otherwise(count.try_cast("int")), F.lit(1)) - 1).alias("last"))


def spans(nodes: DataFrame) -> DataFrame:
    """(id, file, first, last): the lines of each node, up to the next node of its file; without a line, all of the file."""
    line = P.line_number(F.col("source_location"))
    rows = nodes.where("source_file is not null").select("id", F.col("source_file").alias("file"), line.alias("first"))
    following = F.lead("first").over(Window.partitionBy("file").orderBy("first", "id"))
    lined = rows.where("first is not null").withColumn("last", F.when(following.isNull(), 2**31 - 1).otherwise(F.greatest(following - 1, F.col("first"))))
    return lined.unionByName(rows.where("first is null").withColumn("last", F.lit(None).cast("int")))


def same_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): distinct paths of ``left`` (file) and ``right`` (file) that are equal or of which one ends with the other.

    Each path meets the other side's by the ends of its path, so a file name that very many directories have is no hot spot.
    """
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.size(F.split(c, "/"))), "/"))
    a, b = left.select(F.col("file").alias("a")).where("a is not null").distinct(), right.select(F.col("file").alias("b")).where("b is not null").distinct()
    longer = a.select("a", F.explode(ends("a")).alias("b")).join(b, "b")
    return longer.unionByName(b.select("b", F.explode(ends("b")).alias("a")).join(a, "a")).select("a", "b").distinct()


def touched(hunks: DataFrame, node_spans: DataFrame) -> DataFrame:
    """(diff_id, id): nodes that changed ranges overlap. Paths are equal or one ends with the other."""
    pairs = same_files(hunks, node_spans)
    h = hunks.withColumnRenamed("file", "a").alias("h").join(pairs, "a").select("diff_id", "b", F.col("h.first").alias("f"), F.col("h.last").alias("l"))
    overlap = F.col("s.first").isNull() | ((F.col("s.first") <= F.col("l")) & (F.col("s.last") >= F.col("f")))
    s = node_spans.withColumnRenamed("file", "b").alias("s")
    return h.join(s, "b").where(overlap).select("diff_id", "id").distinct()


def change_impact(files: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(change, nodes, communities): how many nodes and communities each change touches; ``files`` (change, file), ``members`` (id, community)."""
    n = nodes.where("source_file is not null").select("id", F.col("source_file").alias("b"))
    pairs = same_files(files, n.withColumnRenamed("b", "file"))
    hit = files.select("change", F.col("file").alias("a")).distinct().join(pairs, "a").join(n, "b").select("change", "id").distinct()
    return hit.join(members, "id", "left").groupBy("change").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("community").alias("communities"))


def co_changes(commits: DataFrame, targets: DataFrame, top: int = 4, least: float = 0.2) -> DataFrame:
    """(target, file, together, share): files changed in the same commits (commit, file) as each target (file), the ``top`` most frequent of at least ``least``."""
    wanted = targets.select(F.col("file").alias("target")).distinct()
    of = commits.select("commit", F.col("file").alias("target")).distinct().join(wanted, "target", "left_semi")
    total = of.groupBy("target").agg(F.count(F.lit(1)).alias("commits"))
    both = met_within(of, commits.select("commit", "file").distinct(), ["commit"]).where("file != target").groupBy("target", "file").agg(F.count(F.lit(1)).alias("together"))
    rows = both.join(total, "target").withColumn("share", F.col("together") / F.col("commits")).where(F.col("share") >= least)
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("together"), "file"))
    return rows.withColumn("r", rank).where(F.col("r") <= top).select("target", "file", "together", "share")


def fit_budget(rows: DataFrame, group: str, cost: str, order: list[Column], budget: int) -> DataFrame:
    """The rows of each group that fit ``budget`` one after another in the order; the first that does not ends it."""
    upto = F.sum(cost).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", upto).where(F.col("upto") <= budget)


def learning_overlay(verdicts: DataFrame, nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """(id, status, stale): verdicts (node, status, hash) on nodes, by id, else by a label of only one node; stale if the file changed or is gone.

    The first status wins in the order preferred, tentative, contested.
    """
    by_label = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("by_label")).where("n = 1").select(F.col("label").alias("node"), "by_label")
    rows = verdicts.join(nodes.select(F.col("id").alias("node"), F.lit(True).alias("is_id")), "node", "left").join(by_label, "node", "left")
    rows = rows.select(F.when(F.col("is_id"), F.col("node")).otherwise(F.col("by_label")).alias("id"), "status", "hash").where("id is not null")
    rank = F.when(F.col("status") == "preferred", 0).when(F.col("status") == "tentative", 1).otherwise(2)
    best = rows.groupBy("id").agg(F.min_by(F.struct("status", "hash"), F.struct(rank.alias("r"), "status", "hash")).alias("x")).select("id", "x.status", "x.hash")
    joined = best.join(nodes.select("id", F.col("source_file").alias("file")), "id").join(hashes.select(F.col("path").alias("file"), F.col("hash").alias("now")), "file", "left")
    stale = F.col("file").isNotNull() & (F.col("hash").isNull() | F.col("now").isNull() | (F.col("hash") != F.col("now")))
    return joined.select("id", "status", stale.alias("stale"))
