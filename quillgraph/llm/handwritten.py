"""Source files nobody wrote by hand: machine output, minified scripts, third-party copies, data stored as code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASONS = ("generated", "minified", "third_party", "data")

# Whole path segments and file names that tools and package managers leave.
PATHS = {
    "generated": (
        r"(^|/)(gen|generated|generated-sources|__generated__|autogen)/",
        r"(_pb2(_grpc)?\.pyi?|\.pb\.(go|cc|h)|\.g\.dart|\.freezed\.dart|\.g\.cs|\.designer\.(cs|vb)|\.generated\.\w+|\.gen\.\w+)$",
        r"(_gen\.go|_autogen\.\w+|_generated\.\w+)$",
        r"(^|/)(zz_generated[._-][^/]*|moc_[^/]*\.(cpp|cc|cxx)|ui_[^/]*\.h|qrc_[^/]*\.cpp)$",
    ),
    "minified": (r"[.-]min\.(js|mjs|cjs|css)$", r"\.(chunk|bundle)\.(js|mjs|css)$", r"[._-]packed\.(js|mjs)$"),
    "third_party": (
        r"(^|/)(_?vendor|third[_-]?party|node_modules|bower_components|jspm_packages|pods|carthage|site-packages|dist-packages|extern|deps)/.",
        r"(^|/)[a-z][\w.-]*-\d+(\.\d+)+/",
    ),
    "data": (r"\.xxd\.[ch]$", r"_base64\.\w+$", r"(^|/)embedded_[^/]*\.h$", r"\.data\.js$", r"_lut\.(inc|h|c)$", r"_blob\.\w+$"),
}

# What the comment lines of such files begin with.
COMMENT = r"(?im)^[ \t]*(?://+!?|#+|--+|/\*+!?|\*+|;+|%+|<!--|\"\"\"|''')[ \t]*"
MARKS = {
    "generated": (
        r"@(?:auto)?generated\b",
        r"(?:this )?(?:code |file )?(?:(?:is|was) )?(?:auto(?:matically)?[ -]?)?(?:generated|created|produced) (?:by|from|with|using)\b",
        r"this file (?:is|was) (?:auto(?:matically)?[ -]?)?(?:generated|created|produced)\b",
        r"</?auto-?generated\b|auto-?generated\b",
        r"automatically (?:generated|created|produced)\b",
        r"do not (?:edit|modify)\b",
        r"diese datei wurde automatisch\b|este archivo (?:fue|ha sido) generado\b|ce fichier a été généré\b",
        r"source: \S+\.(?:idl|proto|thrift|fbs)\b",
    ),
    "third_party": (
        r"copyright\b.{0,120}\b(?:contributors|authors)\b.{0,40}\blicen[sc]ed under\b",
        r"\S+ v?\d+(?:\.\d+)+ \| \(c\) ",
        r"upstream: ?\S+@\d",
        r"(?:copied|vendored|imported) (?:unmodified |verbatim )?from \S+ (?:release |version )?v?\d",
        r"\S+ v?\d+(?:\.\d+)+ - bundled copy\b",
    ),
}

# File name endings by language and the thresholds of its layout; "" is any other ending. Lines are dense from
# ``line`` (longest) or ``mean`` characters on with at most ``space`` white space; texts are data from ``numbers`` of their
# characters in numbers, or with an encoded run that long, on. Measured by language with :func:`language_profile`: white space
# in written texts stays above 0.098 (md) to 0.135 (sql) and lines mean at most 74 characters, minified ones stay below 0.051
# and mean at least 197; numbers fill at most 0.08 of written texts and from 0.6 on of data; no written text has an encoded run.
LANGUAGES = {
    "javascript": (("js", "mjs", "cjs", "jsx"), {"line": 250, "mean": 130, "space": 0.08, "numbers": 0.25, "run": 100}),
    "typescript": (("ts", "tsx", "mts", "cts"), {"line": 250, "mean": 130, "space": 0.08, "numbers": 0.25, "run": 100}),
    "css": (("css", "scss", "less"), {"line": 250, "mean": 130, "space": 0.08, "numbers": 0.3, "run": 100}),
    "python": (("py", "pyi", "pyw"), {"line": 250, "mean": 120, "space": 0.08, "numbers": 0.25, "run": 100}),
    "go": (("go",), {"line": 300, "mean": 140, "space": 0.07, "numbers": 0.25, "run": 100}),
    "jvm": (("java", "kt", "kts", "scala", "groovy"), {"line": 300, "mean": 140, "space": 0.08, "numbers": 0.25, "run": 100}),
    "c": (("c", "h", "cc", "cpp", "cxx", "hpp", "hh", "m", "mm", "inc"), {"line": 250, "mean": 130, "space": 0.08, "numbers": 0.25, "run": 100}),
    "csharp": (("cs", "vb", "fs"), {"line": 300, "mean": 140, "space": 0.08, "numbers": 0.25, "run": 100}),
    "rust": (("rs",), {"line": 250, "mean": 130, "space": 0.08, "numbers": 0.25, "run": 100}),
    "ruby": (("rb", "php", "pl", "lua"), {"line": 250, "mean": 130, "space": 0.09, "numbers": 0.25, "run": 100}),
    "sql": (("sql",), {"line": 400, "mean": 180, "space": 0.09, "numbers": 0.35, "run": 120}),
    "json": (("json", "yaml", "yml", "toml"), {"line": 500, "mean": 200, "space": 0.07, "numbers": 0.4, "run": 120}),
    "markup": (("md", "rst", "txt", "html", "xml"), {"line": 500, "mean": 300, "space": 0.07, "numbers": 0.35, "run": 200}),
    "": ((), {"line": 250, "mean": 140, "space": 0.07, "numbers": 0.25, "run": 100}),
}
DATA = {"least": 80, "letters": 0.6, "filled": 0.3}

NUMBER = r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?!\w)"


def file_of(path: Column) -> Column:
    """One spelling of a path: ``/`` for ``\\``, no leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./+)+", "")


def path_reasons(path: Column) -> dict[str, Column]:
    """For each reason whether the path alone shows it. Whole segments and name endings count, resemblance does not."""
    return {r: reduce(Column.__or__, (path.rlike("(?i)" + p) for p in PATHS[r])) for r in REASONS}


def layout(content: Column) -> dict[str, Column]:
    """Statistics over a whole text: lengths, line lengths, shares of white space, letters and digits, numbers, and the longest encoded run."""
    chars = F.greatest(F.length(content), F.lit(1))
    lengths = F.transform(F.split(content, "\n"), F.length)
    without = lambda pattern: F.length(F.regexp_replace(content, pattern, ""))
    runs = F.transform(F.regexp_extract_all(content, F.lit(r"[A-Za-z0-9+/]{40,}={0,2}"), F.lit(0)), F.length)
    return {
        "chars": F.length(content),
        "longest_line": F.array_max(lengths),
        "mean_line": F.length(content) / F.size(lengths),
        "space": (chars - without(r"\s+")) / chars,
        "alnum": (chars - without(r"[A-Za-z0-9]+")) / chars,
        "numbers": (chars - without(NUMBER)) / chars,
        "run": F.coalesce(F.array_max(runs), F.lit(0)),
    }


def _by_ending(path: Column, values: dict[str, Column]) -> Column:
    """What ``values`` has for the language of a path, looked up in a constant map of endings."""
    known = F.create_map(*(x for lang, (endings, _) in LANGUAGES.items() for e in endings for x in (F.lit(e), values[lang])))
    return F.coalesce(F.try_element_at(known, F.lower(F.element_at(F.split(path, r"\."), -1))), values[""])


def language(path: Column) -> Column:
    """The name of a path's row in LANGUAGES, "" for endings that it does not list."""
    return _by_ending(path, {x: F.lit(x) for x in LANGUAGES})


def thresholds(path: Column) -> Column:
    """The thresholds of the path's language."""
    return _by_ending(path, {x: F.struct(*(F.lit(float(v)).alias(k) for k, v in t.items())) for x, (_, t) in LANGUAGES.items()})


def language_profile(nodes: DataFrame, quantiles: tuple[float, ...] = (0.001, 0.5, 0.999)) -> DataFrame:
    """(language, texts, and quantiles of each layout statistic): what thresholds are tuned by. ``nodes`` has (source_path, content)."""
    rows = nodes.select(language(file_of(F.col("source_path"))).alias("language"), "content").where(F.length("content") >= DATA["least"])
    rows = rows.select("language", *(v.alias(k) for k, v in layout(F.col("content")).items()))
    wanted = [c for c in rows.columns if c != "language"]
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("texts"), *(F.percentile_approx(c, list(quantiles), 10_000).alias(c) for c in wanted))


def layout_reasons(stats: Column, at: Column) -> dict[str, Column]:
    """For each reason that layout can tell whether one text shows it, by its statistics and the thresholds of its language."""
    coded = (stats.run >= at.run) & (stats.alnum >= DATA["letters"]) & (stats.run >= DATA["filled"] * stats.chars)
    data = (stats.chars >= DATA["least"]) & ((stats.numbers >= at.numbers) | coded)
    dense = ((stats.longest_line >= at.line) | (stats.mean_line >= at.mean)) & (stats.space <= at.space)
    return {"minified": ~data & dense, "data": data}


def mark_reasons(content: Column) -> dict[str, Column]:
    """For each reason that a note can tell whether a comment of one text begins with it."""
    return {reason: content.rlike(COMMENT + "(?:" + "|".join(marks) + ")") for reason, marks in MARKS.items()}


def machine_made(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_path, generated, minified, third_party, data, by_layout, by_mark, by_path): the spellings in ``paths`` of files not written by hand.

    ``paths`` has (source_path), repeated or not; ``nodes`` has (source_path, content), any number of texts for a file.
    Layout decides what is minified or data. Generated files and third-party copies are often laid out as written ones
    are, so comments that say so and paths decide these; a path also decides for a file without texts. ``by_...`` tell
    which of the three found the file. A file is a case by its path or by any of its texts, and then all its spellings are. Null and blank paths are left
    out; null and empty texts show nothing. Texts are judged where they are read, and only the names of the files found
    meet the distinct paths, so a file with very many rows moves once.
    """
    spelt = paths.select("source_path").where(F.col("source_path").rlike(r"\S")).distinct()
    spelt = spelt.withColumn("file", file_of(F.col("source_path")))
    texts = nodes.select("source_path", "content").where(F.col("source_path").rlike(r"\S") & (F.length("content") > 0))
    texts = texts.select(file_of(F.col("source_path")).alias("file"), "content")
    texts = texts.withColumns({"stats": F.struct(*(v.alias(k) for k, v in layout(F.col("content")).items())), "at": thresholds(F.col("file"))})
    laid, marked = layout_reasons(F.col("stats"), F.col("at")), mark_reasons(F.col("content"))
    texts = texts.select("file", *(F.coalesce(v, F.lit(False)).alias("l_" + k) for k, v in laid.items()), *(F.coalesce(v, F.lit(False)).alias("m_" + k) for k, v in marked.items()))
    shown = [c for c in texts.columns if c != "file"]
    some = reduce(Column.__or__, (F.col(c) for c in shown))
    files = texts.where(some).groupBy("file").agg(*(F.max(c).alias(c) for c in shown))
    joined = spelt.join(files, "file", "left").withColumns({"p_" + r: c for r, c in path_reasons(F.col("file")).items()})
    found = lambda kind, names: reduce(Column.__or__, (F.coalesce(F.col(f"{kind}_{r}"), F.lit(False)) for r in names))
    ways = {"l": laid, "m": marked, "p": REASONS}
    rows = joined.select(
        "source_path", *(reduce(Column.__or__, (found(k, [r]) for k, names in ways.items() if r in names)).alias(r) for r in REASONS),
        found("l", laid).alias("by_layout"), found("m", marked).alias("by_mark"), found("p", REASONS).alias("by_path"),
    )
    return rows.where("by_layout or by_mark or by_path")
