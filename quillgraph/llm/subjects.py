"""Subject areas of documents, from weak votes on their statements that a latent model weighs by learned accuracies."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.ids import canonical_id
from quillgraph.session import cut, cut_counted

ABSTAIN = 0
VOTERS = ("lexicon", "address", "section", "about", "source")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
CAMEL = re.compile(r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")
ADDRESS = re.compile(r"`[^`\n]*`|\S*[\w)]/\S+|\b\w+_\w+\b|\b[a-zà-ÿ]+[A-ZÀ-Þ]\w*\b")
LEAD = re.compile(r"^\s*(?:\"\"\"|'''|/\*+|//+|--+|#+(?=\s)|>+|[-*+](?=\s)|\d+[.)](?=\s))*\s*")
VERSION = re.compile(r"^v?\d+(?:\.\d+)+:?\s+")
INITIAL = re.compile(r"\s[^\W\d_]\.$")
END = re.compile(r"(?<=[.!])[\"'`)]*\s+(?=[\"'`(¿¡]*[^\W\d_a-zà-ÿ]|`|\d)")


def stem(word: str) -> str:
    return word.rstrip("s") if len(word) > 3 else word


def plain_words(text: str) -> list[str]:
    return [stem(w.lower()) for w in WORD.findall(CAMEL.sub(" ", text))]


def statements(text: str | None, title: str | None = None) -> list[tuple[int, str]]:
    """(section, statement) of a text: sentences without comment and list marks, a question with its answer as one.

    Blank lines and headings begin sections. Headings, the title and lines without the end of a sentence are no
    statements. A full stop after a single letter does not end a sentence.
    """
    out: list[tuple[int, str]] = []
    section, named = 0, (title or "").strip().lower()
    for line in (text or "").split("\n"):
        heading = line.lstrip().startswith("#") and line.lstrip().lstrip("#").startswith(" ")
        body = VERSION.sub("", LEAD.sub("", line)).strip().strip("\"'").strip()
        if not body or body in "*/-->":
            section += 1
            continue
        if body.lower() == named or (heading and body[-1] not in ".!"):
            section += 1
            continue
        for part in END.split(body):
            if part and part[-1] in ".!?:)`" and WORD.search(part):
                if out and out[-1][0] == section and INITIAL.search(out[-1][1]):
                    out[-1] = (section, out[-1][1] + " " + part)
                else:
                    out.append((section, part))
    return out


def word_code(word: str) -> int:
    """A signed 64-bit hash of a word's stem."""
    return int(np.uint64(xxhash.xxh64_intdigest(stem(word.lower()))).astype(np.int64))


PARSED = "row bigint, doc_id bigint, source string, sections array<int>, sizes array<int>, words array<bigint>, named array<int>, names array<bigint>, about array<bigint>"


def parsed(docs: DataFrame) -> DataFrame:
    """PARSED rows of ``docs`` (row, doc_id, text, title, source, about): the one pass over the texts.

    For each statement of a text its section and the codes of its distinct words, those in prose (``words``, ``sizes`` of
    each statement) apart from those in identifiers, paths and code spans (``names``, ``named``); ``about`` has the words of the title,
    the repository and the node's address.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}

        def codes(text: str) -> set[int]:
            out = set()
            for w in WORD.findall(CAMEL.sub(" ", text)):
                c = known.get(w)
                if c is None:
                    if len(known) > 300_000:
                        known.clear()
                    c = known[w] = word_code(w)
                out.add(c)
            return out

        for batch in batches:
            sections, sizes, words, named, names, about = (array(t) for t in "iiqiqq")
            ends: list[list[int]] = [[0], [0], [0], [0]]
            for text, title, spot in zip(*(batch.column(c).to_pylist() for c in ("text", "title", "about"))):
                for section, s in statements(text, title):
                    address = ADDRESS.findall(s) if "`" in s or "/" in s or "_" in s or CAMEL.search(s) else ()
                    prose = codes(ADDRESS.sub(" ", s) if address else s)
                    spans = codes(" ".join(address)) if address else ()
                    sections.append(section)
                    sizes.append(len(prose))
                    words.extend(prose)
                    named.append(len(spans))
                    names.extend(spans)
                if spot:
                    about.extend(codes(spot.replace("_", " ")))
                for end, values in zip(ends, (sizes, words, names, about)):
                    end.append(len(values))
            lists = [pa.ListArray.from_arrays(pa.array(ends[k], pa.int32()), pa.array(np.frombuffer(v, v.typecode) if len(v) else [], t)) for k, v, t in (
                (0, sections, pa.int32()), (0, sizes, pa.int32()), (1, words, pa.int64()), (0, named, pa.int32()), (2, names, pa.int64()), (3, about, pa.int64())
            )]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "source")), *lists], ["row", "doc_id", "source", "sections", "sizes", "words", "named", "names", "about"])

    return docs.select("row", "doc_id", "text", "title", "source", "about").mapInArrow(parse, PARSED)


class Lexicon(NamedTuple):
    """Words with a weight for each subject: the table (word, weights), and its arrays if these are small enough to broadcast."""

    table: DataFrame
    sent: Broadcast | None


def lexicon_of(rows: DataFrame, n: int, most_bytes: int) -> Lexicon:
    """``rows`` (word, weights) written down; they are broadcast only if they take at most ``most_bytes``."""
    table, count = cut_counted(rows, "lexicon")
    if count * (8 + 4 * n) > most_bytes:
        return Lexicon(table, None)
    got = table.orderBy("word").collect()
    arrays = np.array([r.word for r in got], np.int64), np.array([r.weights for r in got], np.float32).reshape(len(got), n)
    return Lexicon(table, table.sparkSession.sparkContext.broadcast(arrays))


def _equipped(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` (PARSED), each with the part of the lexicon that its words need (keys, values), where the lexicon is not broadcast."""
    if lexicon.sent is not None:
        return docs
    asked = docs.select("row", F.explode(F.array_distinct(F.concat("words", "names", "about"))).alias("word"))
    own = asked.join(lexicon.table, "word").groupBy("row").agg(F.collect_list(F.struct("word", "weights")).alias("own"))
    own = own.select("row", F.col("own.word").alias("keys"), F.flatten(F.col("own.weights")).alias("values"))
    return docs.join(own, "row", "left")


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists one after another, and the number of each list."""
    column = batch.column(name)
    return column.flatten().to_numpy(), pc.fill_null(pc.list_value_length(column), 0).to_numpy()


def _arrays(batch: pa.RecordBatch, sent: Broadcast | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted words and the weights that the batch's documents look up in."""
    if sent is not None:
        return sent.value
    keys, at = np.unique(_flat(batch, "keys")[0], return_index=True)
    return keys, _flat(batch, "values")[0].reshape(-1, n)[at]


def _scores(words: np.ndarray, group: np.ndarray, groups: int, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each of ``groups`` the sums of the weights of its words, by subject."""
    keys, weights = lexicon
    if not len(keys):
        return np.zeros((groups, weights.shape[1]))
    at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    hit = keys[at] == words
    group, found = group[hit], weights[at[hit]].astype(float)
    return np.stack([np.bincount(group, weights=found[:, j], minlength=groups) for j in range(weights.shape[1])], axis=1)


def _best(scores: np.ndarray, least: float, lead: float) -> np.ndarray:
    """The subjects from 1 that score ``least`` and lead the next by ``lead``, else ABSTAIN."""
    if not len(scores):
        return np.zeros(0, np.int64)
    ranked = np.sort(scores, axis=1)
    second = ranked[:, -2] if scores.shape[1] > 1 else 0.0
    return np.where((ranked[:, -1] >= least) & (ranked[:, -1] - second >= lead), scores.argmax(1) + 1, ABSTAIN)


def _statements_of(batch: pa.RecordBatch, words: str, sizes: str) -> tuple[np.ndarray, np.ndarray]:
    """The words of a batch's statements and the statement of each."""
    found, each = _flat(batch, words)[0], _flat(batch, sizes)[0]
    return found, np.repeat(np.arange(len(each)), each)


def _sum(columns: list[Column]) -> Column:
    return reduce(Column.__add__, columns)


def _weights(counts: list[Column], prior: list[float], pseudo: float, share: float, lift: float) -> tuple[Column, Column]:
    """(weights, whether any is above 0) of a word that goes ``counts`` times with each subject: its log lift times its share, where both stand out.

    A subject that holds most of a corpus is taken to hold half of it, so that its words can stand out.
    """
    n, total, prior = len(counts), _sum(counts), [min(p, 0.5) for p in prior]
    shares = [(counts[i] + pseudo * prior[i]) / (total + pseudo) for i in range(n)]
    stands = [(shares[i] >= share) & (shares[i] >= lift * prior[i]) for i in range(n)]
    weights = [F.when(stands[i], F.least(F.log(shares[i] / prior[i]), F.lit(3.0)) * shares[i]).otherwise(0.0).cast("float") for i in range(n)]
    return F.array(*weights), reduce(Column.__or__, stands)


def _seeds(docs: DataFrame, labels: DataFrame | None, names: list[str], descriptions: list[str], most_labels: int, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(word, weights) to begin with: words of documents that people gave a subject, and of the subjects' descriptions; and (word, common).

    At most ``most_labels`` labelled documents, taken by a hash of doc_id, are read. A word of theirs stays if it stands out for a
    subject in ``least_docs`` of them at least. A word of one description only stays unless the labelled documents tell it is common.
    ``common`` tells for each subject whether several labelled documents have the word and it does not stand out there.
    """
    spark, n = docs.sparkSession, len(names)
    told = spark.createDataFrame([], "doc_id bigint, s int, share double")
    if labels is not None:
        code = F.create_map(*(F.lit(x) for i, s in enumerate(names) for x in (s.lower(), i)))
        given = labels.select("doc_id", code[F.lower(F.trim("subject"))].alias("s")).where("s is not null and doc_id is not null")
        per_doc = given.groupBy("doc_id").agg(*(F.count_if(F.col("s") == i).alias(f"t{i}") for i in range(n)))
        per_doc = cut(per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels), "labels")
        whole = _sum([F.col(f"t{i}") for i in range(n)])
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("s"), (F.col(f"t{i}") / whole).alias("share")) for i in range(n))))
        told = per_doc.select("doc_id", each.alias("x")).select("doc_id", "x.s", "x.share").where("share > 0")
    labelled = docs.join(F.broadcast(told), "doc_id")
    mine = lambda i: F.sum(F.when(F.col("s") == i, F.col("share")).otherwise(0.0))
    base = labelled.agg(*(mine(i).alias(f"n{i}") for i in range(n))).head()
    prior = [(float(base[i] or 0.0) + 1) / (sum(float(x or 0.0) for x in base) + n) for i in range(n)]
    counts = labelled.select("s", "share", F.explode(F.array_distinct(F.concat("words", "names"))).alias("word"))
    counts = cut(counts.groupBy("word").agg(*(mine(i).alias(f"n{i}") for i in range(n))), "labelled")
    columns = [F.col(f"n{i}") for i in range(n)]
    weights, stands = _weights(columns, prior, 1.0, 0.4, 1.6)
    learnt = counts.where(stands & (F.greatest(*columns, F.lit(0.0)) >= least_docs)).select("word", weights.alias("weights"))
    of: dict[int, set[int]] = {}
    for i, text in enumerate(descriptions):
        for w in WORD.findall(CAMEL.sub(" ", f"{names[i]} {text}")):
            if len(w) > 3:
                of.setdefault(word_code(w), set()).add(i)
    own = spark.createDataFrame([(w, min(s), [2.0 * (j in s) for j in range(n)]) for w, s in of.items() if len(s) == 1], "word bigint, s int, given array<float>")
    plain = [columns[i] < 1.6 * prior[i] * _sum(columns) for i in range(n)]
    refuted = reduce(Column.__or__, ((F.col("s") == i) & plain[i] for i in range(n)))
    own = own.join(counts, "word", "left").where(~F.coalesce(refuted, F.lit(False))).select("word", F.col("given").alias("weights"))
    common = counts.where(_sum(columns) >= least_docs + 1).select("word", F.array(*plain).alias("common"))
    return learnt.unionByName(own.join(learnt.select("word"), "word", "left_anti")), common


def _learn(docs: DataFrame, lexicon: Lexicon, common: DataFrame, n: int, least_count: int) -> tuple[DataFrame, DataFrame]:
    """(word, weights) of all words that stand out for a subject among the statements the lexicon so far tells it of, and the subject each source leans to.

    Words are counted with the subjects of their statements in each task and combined before the shuffle. Where labelled
    documents tell that a word is ``common``, it gets no weight for that subject.
    """
    sent = lexicon.sent

    names = [f"n{i}" for i in range(n + 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prose, spans = _statements_of(batch, "words", "sizes"), _statements_of(batch, "names", "named")
            words, statement = (np.concatenate(x) for x in zip(prose, spans))
            per_doc = _flat(batch, "sizes")[1]
            votes = _best(_scores(words, statement, int(per_doc.sum()), _arrays(batch, sent, n)), 0.6, 0.5)
            keys, at = np.unique(words, return_inverse=True)
            by_word = np.bincount(at * (n + 1) + votes[statement], minlength=len(keys) * (n + 1)).reshape(-1, n + 1)
            coded = pc.fill_null(batch.column("source"), "").dictionary_encode()
            source = np.repeat(coded.indices.to_numpy(), per_doc)
            by_source = np.bincount(source * (n + 1) + votes, minlength=len(coded.dictionary) * (n + 1)).reshape(-1, n + 1)
            counts = np.concatenate([by_word, by_source])
            first = [pa.array(np.concatenate([keys, np.zeros(len(by_source), np.int64)])), pa.concat_arrays([pa.nulls(len(keys), pa.string()), coded.dictionary.cast(pa.string())])]
            yield pa.RecordBatch.from_arrays([*first, *(pa.array(counts[:, i].astype(np.int64)) for i in range(n + 1))], ["word", "source", *names])

    columns = names
    rows = _equipped(docs, lexicon).mapInArrow(count, "word bigint, source string, " + ", ".join(f"{c} bigint" for c in columns))
    sums = cut(rows.groupBy("source", "word").agg(*(F.sum(c).alias(c) for c in columns)), "counts")
    leaning = sums.where("source is not null")
    base = leaning.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns)).head()
    prior = [(base[i + 1] + 1) / (sum(base[1:]) + n) for i in range(n)]
    told = [F.col(c) for c in columns[1:]]
    voted, total = _sum(told), _sum([F.col(c) for c in columns])
    # A word stays if most of its statements have a subject, and the subjects it goes with hold well over their base share.
    weights, stands = _weights(told, prior, 2.0, 0.25, 1.6)
    kept = sums.where("source is null").where((voted >= least_count) & (voted >= 0.4 * total) & stands).select("word", weights.alias("weights"))
    kept = kept.join(common, "word", "left").withColumn("common", F.coalesce("common", F.array(*[F.lit(False)] * n)))
    kept = kept.select("word", F.zip_with("weights", "common", lambda w, c: F.when(c, F.lit(0.0).cast("float")).otherwise(w)).alias("weights")).where(F.array_max("weights") > 0)
    shares = [(told[i] + 20 * prior[i]) / (voted + 20) / prior[i] for i in range(n)]
    lift = F.greatest(*shares, F.lit(0.0))
    leaning = leaning.where((total >= 20) & (lift >= 1.3)).select("source", (F.array_position(F.array(*shares), lift)).alias("s"))
    return kept, leaning


def _votes(docs: DataFrame, lexicon: Lexicon, n: int) -> DataFrame:
    """(row, pattern, statements): how many statements of each document got which votes; the pattern has a digit for each voter. ``docs`` has ``lean``, the vote of its source."""
    sent = lexicon.sent

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = _arrays(batch, sent, n)
            sections, per_doc = _flat(batch, "sections")
            prose = _scores(*_statements_of(batch, "words", "sizes"), len(sections), arrays)
            names = _scores(*_statements_of(batch, "names", "named"), len(sections), arrays)
            about = _best(_scores(*_statements_of(batch, "about", "about_size"), batch.num_rows, arrays), 0.8, 0.25)
            doc = np.repeat(np.arange(batch.num_rows), per_doc)
            begins = np.concatenate([[True], (doc[1:] != doc[:-1]) | (sections[1:] != sections[:-1])])[: len(doc)]
            part, own = np.cumsum(begins) - 1, prose + names
            around = np.stack([np.bincount(part, weights=own[:, j])[part] if len(part) else own[:, j] for j in range(n)], axis=1) - own
            digits = (_best(prose, 0.8, 0.25), _best(names, 0.8, 0.25), _best(around, 0.8, 0.25), about[doc], batch.column("lean").to_numpy()[doc])
            pattern = np.zeros(len(doc), np.int64)
            for d in digits:
                pattern = pattern * (n + 1) + d
            order = np.lexsort((pattern, doc))
            doc, pattern = doc[order], pattern[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pattern[1:] != pattern[:-1])])[: len(doc)])
            size = np.diff(np.append(first, len(doc))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(doc[first])), pa.array(pattern[first]), pa.array(size)], ["row", "pattern", "statements"])

    ready = _equipped(docs, lexicon).withColumn("about_size", F.array(F.size("about")))
    return ready.select(*(c for c in ready.columns if c not in ("doc_id", "source"))).mapInArrow(vote, "row bigint, pattern bigint, statements int")


def label_model(patterns: np.ndarray, counts: np.ndarray, n: int, rounds: int = 50) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior of (no subject, subject 1..n) for each vote pattern, and the learned accuracies, by expectation-maximisation.

    ``patterns`` is (patterns x voters) with 0 for abstaining, ``counts`` how often each occurs. A voter abstains,
    agrees with the latent subject or names another one with rates of its own, and has a rate of voting where there is none.
    """
    p, v = patterns.shape
    agree = np.array([0.8, 0.35, 0.5, 0.1, 0.1][:v] + [0.3] * max(0, v - 5))
    silent = np.array([0.15, 0.62, 0.3, 0.7, 0.7][:v] + [0.6] * max(0, v - 5))
    false = np.array([0.02, 0.02, 0.6, 0.3, 0.3][:v] + [0.2] * max(0, v - 5))
    prior = np.full(n + 1, 0.7 / n)
    prior[0] = 0.3
    hit = patterns[:, :, None] == np.arange(1, n + 1)[None, None, :]
    none = patterns == ABSTAIN
    weight = counts / max(1.0, counts.sum())
    for _ in range(rounds):
        wrong = np.maximum(1 - agree - silent, 1e-6) / max(1, n - 1)
        like = np.where(none[:, :, None], silent[None, :, None], np.where(hit, agree[None, :, None], wrong[None, :, None]))
        empty = np.where(none, 1 - false, false / n)
        log = np.concatenate([np.log(empty).sum(1)[:, None], np.log(like).sum(1)], axis=1) + np.log(prior)
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        mass = post * weight[:, None]
        some = max(mass[:, 1:].sum(), 1e-9)
        prior = np.maximum(mass.sum(0), 1e-6)
        prior /= prior.sum()
        agree = np.clip((mass[:, None, 1:] * hit).sum((0, 2)) / some, 1e-3, 0.99)
        silent = np.clip((mass[:, 1:].sum(1)[:, None] * none).sum(0) / some, 1e-3, 0.999 - agree)
        false = np.clip((mass[:, :1] * ~none).sum(0) / max(mass[:, 0].sum(), 1e-9), 1e-3, 0.99)
    return post, {"agree": agree, "silent": silent, "false": false, "prior": prior}


def subjects(
    docs: DataFrame, areas: DataFrame, labels: DataFrame | None = None, share: float = 1 / 6, learn_rounds: int = 2, least_count: int = 3,
    least_docs: int = 2, most_labels: int = 50_000, most_bytes: int = 1 << 26,
) -> DataFrame:
    """(doc_id, subject, share): the subjects that at least ``share`` of a document's statements deal with.

    ``docs`` has (doc_id, text, title, source, repo, node_id), ``areas`` (subject, description), ``labels`` (doc_id, subject).
    Texts are parsed once, into codes of the words of each statement. A first lexicon comes from the descriptions and from
    at most ``most_labels`` labelled documents; it grows over all documents in ``learn_rounds`` passes and has no bound on its
    words: up to ``most_bytes`` it is broadcast, beyond that each document is joined with the part that it needs. Then five voters name a
    subject for each statement: the words of its prose, the names in it (identifiers, paths, code), the rest of its
    section, what the document is about by its title, repository and node address, and the leaning of its source. A latent model learns the
    voters' accuracies from how often each pattern of votes occurs, and a document's share of a subject is the mean
    posterior over its statements. The patterns, at most (subjects + 1) ** 5, are broadcast.

    Null and empty texts, and texts without statements, have no row. Rows with the same doc_id are separate documents.
    Labels of unknown subjects are left out. Without areas there is no row.
    """
    spark = docs.sparkSession
    listed = sorted({(r.subject, r.description or "") for r in areas.collect() if r.subject})
    names, n = [s for s, _ in listed], len(listed)
    empty = spark.createDataFrame([], "doc_id bigint, subject string, share double")
    if not n:
        return empty
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("title").cast("string").alias("title"),
        canonical_id(F.col("source")).alias("source"), F.concat_ws(" ", "title", "repo", "node_id").alias("about"),
    ).where(F.col("text").rlike(r"\S"))
    rows = cut(parsed(texts), "parsed")
    seeds, common = _seeds(rows, labels, names, [d for _, d in listed], most_labels, least_docs)
    lexicon = lexicon_of(seeds, n, most_bytes)
    leaning = spark.createDataFrame([], "source string, s bigint")
    for _ in range(learn_rounds):
        learnt, leaning = _learn(rows, lexicon, common, n, least_count)
        lexicon = lexicon_of(learnt, n, most_bytes)
    leaning = leaning.select("source", F.col("s").cast("int").alias("lean"))
    leaned = rows.withColumn("source", F.coalesce("source", F.lit(""))).join(leaning, "source", "left").withColumn("lean", F.coalesce("lean", F.lit(ABSTAIN)))
    votes = cut(_votes(leaned, lexicon, n), "votes")
    seen = votes.groupBy("pattern").agg(F.sum("statements").alias("c")).collect()
    if not seen:
        return empty
    codes = np.array([r.pattern for r in seen])
    digits = np.stack([codes // (n + 1) ** k % (n + 1) for k in range(len(VOTERS) - 1, -1, -1)], axis=1)
    post, _ = label_model(digits, np.array([float(r.c) for r in seen]), n)
    table = F.broadcast(spark.createDataFrame([(int(c), [float(x) for x in q]) for c, q in zip(codes, post[:, 1:])], "pattern bigint, q array<double>"))
    joined = votes.join(table, "pattern").groupBy("row").agg(
        F.sum("statements").alias("all"), *(F.sum(F.col("statements") * F.col("q")[i]).alias(f"q{i}") for i in range(n))
    )
    each = F.explode(F.array(*(F.struct(F.lit(names[i]).alias("subject"), (F.col(f"q{i}") / F.col("all")).alias("share")) for i in range(n))))
    found = joined.select("row", each.alias("x")).select("row", "x.subject", "x.share").where(F.col("share") >= share - 1e-6)
    return found.join(rows.select("row", "doc_id"), "row").select("doc_id", "subject", "share")
