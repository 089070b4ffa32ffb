"""Resolving names to definitions: calls, stubs, members, shared types, documents that mention code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import predicates as P


def symbols(nodes: DataFrame) -> DataFrame:
    """(name, id, file, family): definitions by their bare, lower-cased name."""
    name = F.lower(F.regexp_replace(F.regexp_replace(F.col("label"), r"\(\)$", ""), r"^\.", ""))
    kinds = F.col("node_kind").isin("function", "method", "class")
    return nodes.where(kinds & F.col("source_file").isNotNull()).select(name.alias("name"), "id", F.col("source_file").alias("file"), P.edge_family(F.col("source_file")).alias("family"))


def shared_directories(a: Column, b: Column) -> Column:
    """How many leading directories two paths share."""
    left, right = F.slice(F.split(a, "/"), 1, F.size(F.split(a, "/")) - 1), F.slice(F.split(b, "/"), 1, F.size(F.split(b, "/")) - 1)
    same = F.zip_with(left, right, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_off = F.array_position(same, False)
    return F.when(first_off == 0, F.size(same)).otherwise(first_off - 1).cast("int")


def resolve_calls(calls: DataFrame, defs: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(call_id, caller, target, confidence, score): calls by name that have one best definition.

    ``calls`` (call_id, caller, file, callee), ``defs`` of :func:`symbols`, ``imports`` (file, id) as evidence. A candidate
    is of the caller's language family, or one is unknown. Evidence of an import decides first, then tests for tests and
    code for code, the same file, the same directory, the longest shared directory; if the best are several, there is no
    edge. With evidence the edge is EXTRACTED, else INFERRED with 0.85.
    """
    rows = calls.select("call_id", "caller", F.col("file").alias("from"), F.lower("callee").alias("name"), P.edge_family(F.col("file")).alias("fam"))
    cand = rows.join(defs, "name").where("fam is null or family is null or fam = family").where("id != caller")
    if imports is not None:
        cand = cand.join(imports.select(F.col("file").alias("from"), "id", F.lit(True).alias("imported")).distinct(), ["from", "id"], "left")
    else:
        cand = cand.withColumn("imported", F.lit(None).cast("boolean"))
    directory = lambda c: F.regexp_replace(F.col(c), r"/[^/]*$", "")
    is_test = lambda c: P.is_test(F.lit(""), F.col(c))
    rank = F.struct(
        F.coalesce("imported", F.lit(False)).alias("a"), (is_test("from") == is_test("file")).alias("b"), (F.col("from") == F.col("file")).alias("c"),
        (directory("from") == directory("file")).alias("d"), shared_directories(F.col("from"), F.col("file")).alias("e"),
    )
    cand = cand.withColumn("rank", rank)
    best = cand.groupBy("call_id").agg(F.max("rank").alias("rank"))
    top = cand.join(best, ["call_id", "rank"]).groupBy("call_id").agg(F.count_distinct("id").alias("n"), F.min("id").alias("target"), F.min("caller").alias("caller"), F.bool_or("imported").alias("imported"))
    sure = F.coalesce("imported", F.lit(False))
    return top.where("n = 1").select("call_id", "caller", "target", F.when(sure, "EXTRACTED").otherwise("INFERRED").alias("confidence"), F.when(sure, 1.0).otherwise(0.85).alias("score"))


def stub_map(nodes: DataFrame) -> DataFrame:
    """(stub, real): nodes without a file whose label exactly one node with a file has, by the exact label, else in any case."""
    has_file = F.coalesce("source_file", F.lit("")) != ""
    real = nodes.where(has_file).select("id", "label")
    stubs = nodes.where(~has_file).select(F.col("id").alias("stub"), "label")
    one = lambda key: real.groupBy(key.alias("k")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("real")).where("n = 1").select("k", "real")
    exact = stubs.join(one(F.col("label")), F.col("label") == F.col("k")).select("stub", "real")
    rest = stubs.join(exact.select("stub"), "stub", "left_anti")
    folded = rest.join(one(F.lower("label")), F.lower("label") == F.col("k")).select("stub", "real")
    return exact.unionByName(folded)


def declaration_map(nodes: DataFrame) -> DataFrame:
    """(id, survivor): classes declared in a header and defined beside it, under one name: the least id stays."""
    stem = F.regexp_replace(F.col("source_file"), r"\.(h|hh|hpp|hxx|c|cc|cpp|cxx|m|mm)$", "")
    rows = nodes.where((F.col("node_kind") == "class") & F.col("source_file").rlike(r"\.(h|hh|hpp|hxx|c|cc|cpp|cxx|m|mm)$")).select("id", "label", stem.alias("stem"))
    first = rows.groupBy("stem", "label").agg(F.min("id").alias("survivor"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(first, ["stem", "label"]).where("id != survivor").select("id", "survivor")


def distinct_ids(nodes: DataFrame) -> DataFrame:
    """(id, source_file, new_id): ids that several files use get the file's hash, unless it is the least of them."""
    files = nodes.select("id", F.coalesce("source_file", F.lit("")).alias("source_file")).distinct()
    first = F.min("source_file").over(Window.partitionBy("id"))
    salted = F.concat("id", F.lit("_"), F.substring(F.sha2("source_file", 256), 1, 8))
    return files.withColumn("first", first).select("id", "source_file", F.when(F.col("source_file") == F.col("first"), F.col("id")).otherwise(salted).alias("new_id"))


def member_calls(calls: DataFrame, types: DataFrame, members: DataFrame) -> DataFrame:
    """(call_id, target): calls of a method on a type that is unique, of a name that is unique in it.

    ``calls`` (call_id, receiver_type, callee), ``types`` (name, type_id), ``members`` (type_id, name, id).
    """
    one_type = types.groupBy("name").agg(F.count_distinct("type_id").alias("n"), F.min("type_id").alias("type_id")).where("n = 1")
    one_member = members.groupBy("type_id", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("target")).where("n = 1").select("type_id", F.col("name").alias("callee"), "target")
    return calls.join(one_type.select(F.col("name").alias("receiver_type"), "type_id"), "receiver_type").join(one_member, ["type_id", "callee"]).select("call_id", "target")


def shared_types(nodes: DataFrame) -> DataFrame:
    """(src, dst): types of the same name in two repositories, each with the least id of that name in another repository.

    ``nodes`` (id, name, repo). Members chain to the least, so a name that very many repositories share is not multiplied out.
    """
    best = nodes.groupBy("name").agg(F.min(F.struct("id", "repo")).alias("x"), F.count_distinct("repo").alias("repos")).where("repos > 1")
    rows = nodes.join(best.select("name", F.col("x.id").alias("first"), F.col("x.repo").alias("first_repo")), "name")
    return rows.where("repo != first_repo").select(F.col("first").alias("src"), F.col("id").alias("dst"))


def mentions(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, id, mention): code spans in documents that name one node by id, label or file.

    ``docs`` (doc_id, text). Spans and names are distinct before they meet; ambiguous names are left out.
    """
    span = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"`([^`\n]{2,120})`"), F.lit(1))))
    spans = docs.select("doc_id", span.alias("mention")).withColumn("key", F.lower(F.regexp_replace("mention", r"\(.*\)$", "")))
    names = F.array(F.col("id"), F.lower(F.regexp_replace("label", r"\(\)$", "")), F.lower(P.base_name(P.text_of(F.col("source_file")))))
    keys = nodes.select("id", F.explode(F.array_distinct(names)).alias("key")).where("key != ''")
    unique = keys.groupBy("key").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1")
    return spans.join(unique, "key").select("doc_id", "id", "mention")


def infrastructure_links(nodes: DataFrame) -> DataFrame:
    """(src, dst, relation): links between formats, by equal names.

    ``nodes`` (id, type, name, directory): releases deploy charts, images are built by the build of their name, a chart
    defines the resources in its directory, resources of one name in two tools are shared.
    """
    t = lambda kind, alias: nodes.where(F.col("type") == kind).alias(alias)
    plain = lambda c: F.lower(F.regexp_replace(F.col(c), "-", "_"))
    link = lambda a, b, on, rel: a.join(b, on).where("a.id != b.id").select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.lit(rel).alias("relation"))
    same = plain("a.name") == plain("b.name")
    built = t("image", "a").join(t("build", "b"), same).groupBy(F.col("a.id").alias("src")).agg(F.min("b.id").alias("dst")).select("src", "dst", F.lit("built_by").alias("relation"))
    return (
        link(t("release", "a"), t("chart", "b"), same, "deploys").unionByName(built)
        .unionByName(link(t("chart", "a"), t("resource", "b"), plain("a.name") == plain("b.directory"), "defines"))
        .unionByName(link(t("terraform", "a"), t("cloudformation", "b"), same, "shares_resource")).distinct()
    )


def secret_references(nodes: DataFrame) -> DataFrame:
    """(kind, name, state): secrets and environment variables that are defined, referenced or missing; ``nodes`` (kind, name, defines boolean)."""
    sides = nodes.where("name is not null").groupBy("kind", "name").agg(F.bool_or("defines").alias("defined"), F.bool_or(~F.col("defines")).alias("used"))
    state = F.when(F.col("defined") & F.col("used"), "resolved").when(F.col("defined"), "unused").otherwise("missing")
    return sides.select("kind", "name", state.alias("state"))


def indirect_calls(uses: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, relation, score): references to functions (src, dst) that no call joins yet, as indirect calls."""
    callable_ = nodes.where(F.col("node_kind").isin("function", "method")).select(F.col("id").alias("dst"))
    called = edges.where(F.col("relation").isin("calls", "indirect_call")).select("src", "dst").distinct()
    rows = uses.select("src", "dst").distinct().where("src != dst").join(callable_, "dst", "left_semi").join(called, ["src", "dst"], "left_anti")
    return rows.select("src", "dst", F.lit("indirect_call").alias("relation"), F.lit(0.85).alias("score"))


def follow_aliases(aliases: DataFrame, hops: int = 5) -> DataFrame:
    """(alias, target): where chains of re-exports (alias, target) end, after at most 2 ** ``hops`` steps; rings end nowhere."""
    from quillgraph.session import cut

    one = cut(aliases.groupBy("alias").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).where("n = 1 and alias != target").select("alias", "target"), "alias")
    at = one
    for _ in range(hops):
        step = at.select(F.col("alias").alias("target"), F.col("target").alias("next"))
        at = cut(at.join(step, "target", "left").select("alias", F.coalesce("next", "target").alias("target")), "alias")
    return at.join(one.select(F.col("alias").alias("target")), "target", "left_anti").select("alias", "target")


def cross_repo_calls(parked: DataFrame, types: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, relation, score): calls on types of another repository, if type and member are unique there.

    ``parked`` (caller, repo, receiver_type, callee), ``types`` (name, type_id, repo), ``members`` (type_id, name, id, relation): a
    ``defines`` member counts where there is no ``method`` of that name.
    """
    rank = F.when(F.col("relation") == "method", 0).otherwise(1)
    best = members.withColumn("r", rank).withColumn("m", F.min("r").over(Window.partitionBy("type_id", "name"))).where("r = m")
    one = best.groupBy("type_id", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("dst")).where("n = 1").select("type_id", F.col("name").alias("callee"), "dst")
    hits = parked.join(types.select(F.col("name").alias("receiver_type"), "type_id", F.col("repo").alias("home")), "receiver_type").where("repo != home")
    single = hits.groupBy("caller", "receiver_type", "callee").agg(F.count_distinct("type_id").alias("n"), F.min("type_id").alias("type_id")).where("n = 1")
    return single.join(one, ["type_id", "callee"]).select(F.col("caller").alias("src"), "dst", F.lit("calls").alias("relation"), F.lit(0.8).alias("score")).distinct()


def twins(nodes: DataFrame) -> DataFrame:
    """(twin, kept): document nodes of a quick scan that a closer reading of the same file gave again under another id."""
    docs = nodes.where((F.col("file_type") == "document") & F.col("source_file").isNotNull()).select("id", "source_file", F.lower("label").alias("l"), F.coalesce("origin", F.lit("")).alias("origin"))
    kept = docs.where("origin = 'semantic'").groupBy("source_file", "l").agg(F.count_distinct("id").alias("n"), F.min("id").alias("kept")).where("n = 1").select("source_file", "l", "kept")
    return docs.where("origin != 'semantic'").join(kept, ["source_file", "l"]).where("id != kept").select(F.col("id").alias("twin"), "kept")
