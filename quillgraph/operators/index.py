"""A search index on disk: postings of stems and of trigrams, sorted so that a query reads only the parts that it needs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.stems import porter, stemmed
from quillgraph.operators.search import contained, fuzzy_terms, trigram_postings
from quillgraph.session import cut, partitions, shared_dir

# How much a word counts by the field that has it.
FIELD_WEIGHTS = {"title": 5.0, "headings": 3.0, "tags": 4.0, "body": 1.0}


class Index(NamedTuple):
    """``postings`` (stem, id, tf, len, df), ``trigrams`` (trigram, id, df), ``words`` (word, stem), ``totals`` (n, avg), one row."""

    postings: DataFrame
    trigrams: DataFrame
    words: DataFrame
    totals: DataFrame


def _sorted(rows: DataFrame, path: str, *order: str) -> DataFrame:
    """``rows`` written in ranges of ``order`` and sorted in them; a hot first key is spread over ranges by the others."""
    rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def build_index(docs: DataFrame, folder: str, label: str = "title") -> Index:
    """The index of ``docs`` (id, title, headings, tags, body; any of the fields may be missing), written to ``folder``.

    Words are counted by field where they are read. Stems are worked out once for each distinct word. ``tf`` is weighted by
    field, ``len`` counts the words of all fields; trigrams are those of the lower-cased ``label``. Null fields are empty,
    rows with the same id are one document, an empty table gives an empty index.
    """
    spark = docs.sparkSession
    have = [f for f in FIELD_WEIGHTS if f in docs.columns]
    weighed = lambda f: F.transform(T.search_tokens(F.coalesce(F.col(f), F.lit(""))), lambda w: F.struct(w.alias("word"), F.lit(FIELD_WEIGHTS[f]).alias("weight")))
    each = [weighed(f) for f in have]
    found = docs.where("id is not null").select("id", F.explode_outer(F.concat(*each)).alias("x"))
    counted = cut(found.groupBy("id", F.col("x.word").alias("word")).agg(F.sum("x.weight").alias("tf"), F.count("x.word").alias("times")), "counted")
    words = _sorted(stemmed(counted.select("word")), f"{folder}/words", "word")
    sizes = cut(counted.groupBy("id").agg(F.sum("times").alias("len")), "sizes")
    totals = sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg"))
    totals.coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals")
    by_stem = cut(counted.join(words, "word").groupBy("stem", "id").agg(F.sum("tf").alias("tf")), "stems")
    df = by_stem.groupBy("stem").agg(F.count(F.lit(1)).alias("df"))
    postings = _sorted(by_stem.join(sizes, "id").join(df, "stem").select("stem", "id", "tf", "len", "df"), f"{folder}/postings", "stem", "id")
    runs = cut(trigram_postings(docs.where("id is not null"), "id", F.col(label)).distinct(), "trigrams")
    grams = runs.groupBy("trigram").agg(F.count(F.lit(1)).alias("df"))
    trigrams = _sorted(runs.join(grams, "trigram").select("trigram", "id", "df"), f"{folder}/trigrams", "trigram", "id")
    return Index(postings, trigrams, words, spark.read.parquet(f"{folder}/totals"))


def open_index(spark: SparkSession, folder: str) -> Index:
    return Index(*(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "trigrams", "words", "totals")))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder for an index that is built for one query."""
    import uuid

    return f"{shared_dir(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"


def search_index(index: Index, terms: list[str], fuzzy: bool = True, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): BM25 of documents with any of ``terms``, compared by stem. Only the postings of those stems are read.

    With ``fuzzy`` a term whose stem no word has is replaced by the words nearest to it.
    """
    asked = {t: porter(t) for t in dict.fromkeys(terms)}
    if fuzzy and asked:
        known = {r.stem for r in index.words.where(F.col("stem").isin(*asked.values())).select("stem").distinct().collect()}
        lost = [t for t, s in asked.items() if s not in known]
        if lost:
            near = fuzzy_terms(index.words.select(F.col("word").alias("term")), lost).collect()
            asked = {t: s for t, s in asked.items() if s in known} | {r.match: porter(r.match) for r in near}
    wanted = sorted(set(asked.values()))
    hits = index.postings.where(F.col("stem").isin(*wanted) if wanted else F.lit(False)).join(F.broadcast(index.totals))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return hits.groupBy("id").agg(F.sum(part).alias("score"))


def substrings(index: Index, texts: DataFrame, needles: list[str], common: float = 0.1) -> DataFrame:
    """(needle, id): documents whose label contains a needle, of ``texts`` (id, text).

    Candidates have all trigrams of the needle that at most ``common`` of the documents have (the rarest one, if all are
    more common), and are then compared in full. Needles of fewer than three characters are looked for in all texts.
    """
    spark = texts.sparkSession
    lower = [n.lower() for n in dict.fromkeys(needles)]
    long = [n for n in lower if len(n) >= 3]
    text = F.lower(F.coalesce("text", F.lit("")))
    short = contained(texts, "id", "text", [n for n in lower if len(n) < 3])
    if not long:
        return short
    pieces = sorted({n[i : i + 3] for n in long for i in range(len(n) - 2)})
    df = {r.trigram: r.df for r in index.trigrams.where(F.col("trigram").isin(*pieces)).select("trigram", "df").distinct().collect()}
    n = index.totals.head().n
    wanted = []
    for needle in long:
        mine = sorted({needle[i : i + 3] for i in range(len(needle) - 2)}, key=lambda t: (df.get(t, 0), t))
        wanted += [(needle, t) for t in mine[:1] + [t for t in mine[1:] if df.get(t, 0) <= common * n]]
    asked = spark.createDataFrame(wanted, "needle string, trigram string")
    need = asked.groupBy("needle").agg(F.count(F.lit(1)).alias("need"))
    used = index.trigrams.where(F.col("trigram").isin(*sorted({t for _, t in wanted})))
    hits = used.join(F.broadcast(asked), "trigram").groupBy("needle", "id").agg(F.count(F.lit(1)).alias("have")).join(F.broadcast(need), "needle").where("have = need")
    return hits.join(texts, "id").where(text.contains(F.col("needle"))).select("needle", "id").unionByName(short)
