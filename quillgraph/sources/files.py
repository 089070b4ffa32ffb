"""Scans of directories: what files there are, what they are, and which to leave out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import predicates as P
from quillgraph.functions import vocabulary as V

# Directories of caches, environments and build output.
NOISE_DIRECTORIES = (
    ".git .hg .svn .venv venv .tox .nox .mypy_cache .pytest_cache .ruff_cache __pycache__ node_modules .next .nuxt .gradle .idea .vscode .cache "
    ".terraform .eggs htmlcov .ipynb_checkpoints"
).split()
BUILD_DIRECTORIES = ("build", "dist", "out", "target", "bin", "obj")
BUILD_ENDINGS = ("o", "obj", "class", "pyc", "so", "dll", "exe", "jar", "whl", "map")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified, content) of all files below ``root``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"), "content")


def scan_text(spark: SparkSession, root: str) -> DataFrame:
    """(path, text): the files below ``root`` as text."""
    rows = scan(spark, root)
    return rows.select("path", F.decode("content", "UTF-8").alias("text"))


def file_class(path: Column, head: Column | None = None) -> Column:
    """code, document, manifest, infrastructure, image, or null; by name first, then ending, then the first line."""
    name, last = F.lower(P.base_name(P.source_path(path))), P.ending(path)
    # File names that decide.
    manifests = ("package.json", "pyproject.toml", "cargo.toml", "go.mod", "pom.xml", "requirements.txt", "poetry.lock", "apm.yml")
    infra = name.startswith("dockerfile") | name.rlike(r"^(docker-)?compose.*\.ya?ml$") | name.isin("chart.yaml", "jenkinsfile") | P.text_of(path).contains("/.github/workflows/")
    out = (
        F.when(name.isin(*manifests), "manifest").when(infra, "infrastructure").when(last.isin(*V.CODE_ENDINGS), "code")
        .when(last.isin(*V.DOCUMENT_ENDINGS, "pdf", "html", "yaml", "yml", "toml"), "document").when(last.isin(*V.IMAGE_ENDINGS), "image")
    )
    if head is not None:
        out = out.when(head.rlike(r"^#!.*\b(python|bash|sh|zsh|node|ruby|perl|php|lua|Rscript)"), "code")
    return out


def noise(files: DataFrame, path: str = "path") -> DataFrame:
    """Files in directories of caches, environments or, where compiled files show it, build output."""
    parts = F.split(P.source_path(F.col(path)), "/")
    known = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.lower(p).isin(*NOISE_DIRECTORIES))
    build = F.regexp_extract(P.source_path(F.col(path)), rf"^(.*?(?:^|/)(?:{'|'.join(BUILD_DIRECTORIES)}))/", 1)
    rows = files.withColumn("_known", known).withColumn("_build", build)
    shown = rows.where((F.col("_build") != "") & P.ending(F.col(path)).isin(*BUILD_ENDINGS)).select("_build").distinct().withColumn("_shown", F.lit(True))
    return rows.join(shown, "_build", "left").where(F.col("_known") | F.coalesce("_shown", F.lit(False))).select(*files.columns)


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """The regular expression of one line of an ignore file, for paths from its directory, and whether it re-includes; None for blanks and comments."""
    rule = line.rstrip("\n")
    rule = re.sub(r"(?<!\\)\s+$", "", rule)
    if not rule or rule.startswith("#"):
        return None
    keep = rule.startswith("!")
    rule = rule[1:] if keep else rule
    directory = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    rule = rule.lstrip("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("/**", i) and i + 3 == len(rule):
            out, i = out + "/.+", i + 3
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and "]" in rule[i + 1 :]:
            end = rule.index("]", i + 1)
            out, i = out + "[" + rule[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.+$" if directory else "(?:/.*)?$"), keep


def ignored(paths: DataFrame, lines: list[str], path: str = "path") -> DataFrame:
    """(path, ignored): the last rule that matches decides."""
    verdict = F.lit(False)
    for rule in filter(None, map(ignore_pattern, lines)):
        verdict = F.when(F.col(path).rlike(rule[0]), F.lit(not rule[1])).otherwise(verdict)
    return paths.select(path, verdict.alias("ignored"))


def corpus_size(files: DataFrame, words: str = "words") -> DataFrame:
    """(files, words, warning): too little for a graph, or costly."""
    sums = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(words), F.lit(0)).alias("words"))
    return sums.withColumn("warning", F.when((F.col("words") > 500_000) | (F.col("files") > 500), "large").when(F.col("words") < 50_000, "small"))


def stale_sources(nodes: DataFrame, scanned: DataFrame, evidence: DataFrame) -> DataFrame:
    """(source_file): files that a graph refers to, a scan no longer has, and that are proven to be gone or excluded (path)."""
    known = nodes.where("source_file is not null").select("source_file").distinct()
    gone = known.join(scanned.select(F.col("path").alias("source_file")).distinct(), "source_file", "left_anti")
    return gone.join(evidence.select(F.col("path").alias("source_file")).distinct(), "source_file", "left_semi")
