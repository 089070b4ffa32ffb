"""Search over nodes: weighted terms, BM25 over fields, trigrams, misspelt words, scored labels, ranks that use the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators.build import Graph
from quillgraph.operators.walks import both_ways, page_rank, reach
from quillgraph.session import cut


def keywords(rows: DataFrame, key: str, text: Column, top: int = 5) -> DataFrame:
    """(key, term, tf, score, rank): the ``top`` terms of each row by tf * idf, with idf = ln((n + 1) / (df + 1)) + 1 over all rows."""
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))
    found = rows.select(key, F.explode(T.terms(F.coalesce(text, F.lit("")))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    found = cut(found, "terms")
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = found.join(df, "term").join(total).withColumn("score", F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), F.desc("tf"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select(key, "term", "tf", "score", "rank")


def vocabulary(rows: DataFrame, text: Column) -> DataFrame:
    """(term, doc_count): in how many rows each subtoken occurs."""
    return rows.select(F.explode(T.vocabulary_terms(F.coalesce(text, F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("doc_count"))


def substring_idf(rows: DataFrame, label: Column, terms: list[str]) -> DataFrame:
    """(term, df, idf): idf = ln(1 + n / (1 + df)), df the rows whose lower-cased label contains the term. One pass over the rows."""
    plain = F.lower(T.without_diacritics(label))
    counts = rows.select(plain.alias("l")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("l").contains(t)).alias(f"t{i}") for i, t in enumerate(terms)))
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("df")) for i, t in enumerate(terms))))
    return counts.select("n", each.alias("x")).select("x.term", "x.df", F.log(1 + F.col("n") / (1 + F.col("x.df"))).alias("idf"))


def fields(nodes: DataFrame) -> DataFrame:
    """(id, title, headings, body): what is searched of a node; the label's parts belong to title and body."""
    parts = F.array_join(T.subtokens(F.col("label")), " ")
    body = F.when(F.coalesce(F.trim("content"), F.lit("")) == "", F.col("label")).otherwise(F.col("content"))
    return nodes.select("id", parts.alias("title"), F.when(F.col("node_kind") == "heading", parts).otherwise("").alias("headings"), F.concat(body, F.lit("\n"), parts).alias("body"))


WEIGHTS = {"title": 5.0, "headings": 3.0, "body": 1.0}


def bm25(docs: DataFrame, terms: list[str], weights: dict[str, float] = WEIGHTS, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): BM25 of rows with any of ``terms``, term frequencies weighted by field, lengths in words over all fields.

    Documents are tokenised where they are read and shrink to their term counts; only totals are shuffled.
    """
    counted = docs.select("id", *(T.search_tokens(F.coalesce(f, F.lit(""))).alias(f) for f in weights))
    tf = lambda t: reduce(Column.__add__, (F.size(F.filter(F.col(f), lambda w: w == t)) * F.lit(w) for f, w in weights.items()))
    size = reduce(Column.__add__, (F.size(f) for f in weights))
    counted = cut(counted.select("id", size.alias("len"), *(tf(t).alias(f"f{i}") for i, t in enumerate(terms))), "bm25")
    totals = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))))
    rows = counted.join(F.broadcast(totals))
    idf = lambda i: F.greatest(F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(1e-6))
    part = lambda i: idf(i) * F.col(f"f{i}") * (k1 + 1) / (F.col(f"f{i}") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    score = reduce(Column.__add__, (part(i) for i in range(len(terms))))
    some = reduce(Column.__or__, (F.col(f"f{i}") > 0 for i in range(len(terms))))
    return rows.where(some).select("id", score.alias("score"))


def trigram_postings(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(trigram, key): the index; lower-cased texts of fewer than three characters are their own trigram."""
    return rows.select(key, F.explode(T.windows(F.lower(F.coalesce(text, F.lit(""))), 3)).alias("trigram"))


def contained(rows: DataFrame, key: str, text: str, needles: list[str]) -> DataFrame:
    """(needle, key): rows whose lower-cased text contains a needle, in one pass without a shuffle."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    if not needles:
        return rows.select(F.lit("").alias("needle"), key).limit(0)
    hit = [F.when(lower.contains(n), F.lit(n)) for n in dict.fromkeys(needles)]
    return rows.select(F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull())).alias("needle"), key)


def fuzzy_terms(vocab: DataFrame, terms: list[str], limit: int = 3) -> DataFrame:
    """(term, match, distance): the words of ``vocab`` (term) nearest to each of a few query terms.

    Edit distance of at most 2 from five letters on, 1 for four letters, else equality; words of fewer than four letters
    match only themselves; only the least distance counts, the ``limit`` first of it.
    """
    spark = vocab.sparkSession
    asked = spark.createDataFrame([(t.strip().lower(), 2 if len(t.strip()) >= 5 else 1 if len(t.strip()) == 4 else 0) for t in terms], "asked string, most int").distinct()
    near = vocab.select(F.col("term").alias("match")).distinct().join(F.broadcast(asked), F.abs(F.length("match") - F.length("asked")) <= F.col("most"))
    near = near.withColumn("distance", F.levenshtein("match", "asked", 2)).where((F.col("distance") >= 0) & (F.col("distance") <= F.col("most")))
    near = near.where((F.col("distance") == 0) | (F.length("match") >= 4))
    w = Window.partitionBy("asked")
    best = near.withColumn("least", F.min("distance").over(w)).where("distance = least").withColumn("rank", F.row_number().over(w.orderBy("match"))).where(F.col("rank") <= limit)
    return best.select(F.col("asked").alias("term"), "match", "distance")


def query_terms(question: str, stop_words: object = ()) -> list[str]:
    """Searchable words of a question without stop words; if nothing else is left, with them."""
    import re

    words = list(dict.fromkeys(re.findall(r"[^\W_]+", question.lower())))
    return [w for w in words if w not in set(stop_words)] or words


def label_scores(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(id, score, matched): nodes by how well label and file match the terms.

    The whole query as the label counts 10,000 and as its beginning 1,000, a term 1,000 or 100, inside the label 1, in
    the file name 0.5, each times its idf; tiers of single terms are scaled by the square of the share of terms matched.
    """
    idf = {r.term: r.idf for r in substring_idf(nodes, F.col("label"), terms).collect()}
    joined = " ".join(terms)
    top = max(idf.values(), default=1.0)
    label = F.lower(T.without_diacritics(F.col("label")))
    rows = nodes.select("id", label.alias("l"), F.lower(F.coalesce("source_file", F.lit(""))).alias("f"), F.array_join(T.search_tokens(F.col("label")), " ").alias("w"))
    rows = rows.withColumn("bare", F.regexp_replace("l", r"[()]+$", ""))
    whole = (
        F.when(F.lit(joined).isin(F.col("l"), F.col("bare"), F.col("w"), F.lower("id")), 10_000.0 * top)
        .when(F.col("l").startswith(joined) | F.col("bare").startswith(joined) | F.col("w").startswith(joined), 1_000.0 * top).otherwise(0.0)
    )
    exact = lambda t: (F.col("l") == t) | (F.col("bare") == t)
    begins = lambda t: F.col("l").startswith(t) | F.col("bare").startswith(t)
    tier = reduce(Column.__add__, (F.when(exact(t), 1_000.0 * idf[t]).when(begins(t), 100.0 * idf[t]).otherwise(0.0) for t in terms))
    inside = reduce(Column.__add__, (F.when(exact(t) | begins(t), 0.0).when(F.col("l").contains(t), idf[t]).otherwise(0.0) + F.when(F.col("f").contains(t), 0.5 * idf[t]).otherwise(0.0) for t in terms))
    matched = reduce(Column.__add__, (F.when(F.col("l").contains(t), 1).otherwise(0) for t in terms))
    score = whole + inside + tier * F.pow(matched / F.lit(float(len(terms))), 2)
    return rows.select("id", score.alias("score"), matched.alias("matched")).where("score > 0")


def pick_seeds(scores: DataFrame, nodes: DataFrame, most: int = 3, gap: float = 0.2) -> DataFrame:
    """(id, score): the best nodes with different labels, none below ``gap`` of the best."""
    rows = scores.join(nodes.select("id", F.lower("label").alias("l")), "id")
    one = rows.groupBy("l").agg(F.max_by(F.struct("id", "score"), F.struct("score", (-F.length("l")).alias("n"), F.col("id"))).alias("x")).select("x.*")
    best = one.agg(F.max("score").alias("best"))
    return one.join(F.broadcast(best)).where(F.col("score") >= gap * F.col("best")).select("id", "score").orderBy(F.desc("score"), "id").limit(most)


def find_nodes(nodes: DataFrame, name: str) -> DataFrame:
    """(id, tier): nodes by name; the file's path, the exact label or id, a beginning, a part, and only the best of these tiers."""
    term = " ".join(query_terms(name))
    label = F.lower(T.without_diacritics(F.col("label")))
    words, file_words = F.array_join(T.search_tokens(F.col("label")), " "), F.array_join(T.search_tokens(F.coalesce("source_file", F.lit(""))), " ")
    bare, key, raw = F.regexp_replace(label, r"[()]+$", ""), F.lower("id"), name.strip().lower()
    begins = reduce(Column.__or__, (x.startswith(t) for x in (label, bare, words, key) for t in (term, raw)))
    tier = (
        F.when(file_words == term, 0).when(F.lit(term).isin(label, bare, words, key) | F.lit(raw).isin(label, bare, key), 1)
        .when(begins, 2).when(label.contains(term) | words.contains(term) | label.contains(raw), 3)
    )
    rows = nodes.select("id", tier.alias("tier")).where("tier is not null")
    return rows.join(F.broadcast(rows.agg(F.min("tier").alias("best")))).where("tier = best").select("id", "tier")


def hybrid(graph: Graph, scores: DataFrame, ranks: DataFrame, seeds: int = 20, top: int = 20, rounds: int = 100) -> DataFrame:
    """(id, hops, score): nodes near the best matches, ranked by words and graph together.

    The ``seeds`` best of ``scores`` (id, score), scaled to at most 10, are walked from for two steps; a node's score is its own
    match, plus its best seed's match times 1, 0.4 or 0.15 by distance, plus 10 times its personalised rank in what was
    reached, plus 5 times its ``ranks`` (id, rank).
    """
    first = scores.orderBy(F.desc("score"), "id").limit(seeds)
    scaled = first.join(F.broadcast(first.agg(F.max("score").alias("m")))).select("id", (F.col("score") / F.col("m") * 10).alias("match"))
    scaled = cut(scaled, "seeds")
    near = cut(reach(both_ways(graph.edges), scaled.select(F.col("id").alias("seed"), "id"), 2), "near")
    pull = F.when(F.col("depth") == 0, 1.0).when(F.col("depth") == 1, 0.4).otherwise(0.15)
    best = near.join(scaled.select(F.col("id").alias("seed"), "match"), "seed").groupBy("id").agg(F.max(pull * F.col("match")).alias("pull"), F.min("depth").alias("hops"))
    ids = best.select("id")
    within = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    restart = ids.join(scaled, "id", "left").select("id", F.coalesce("match", F.lit(0.1)).alias("weight"))
    personal = page_rank(ids, within, restart, rounds=rounds).withColumnRenamed("rank", "own")
    rows = best.join(personal, "id").join(ranks, "id").join(scaled, "id", "left")
    score = F.coalesce("match", F.lit(0.0)) + F.col("pull") + 10 * F.col("own") + 5 * F.col("rank")
    return rows.select("id", "hops", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "id").limit(top)
