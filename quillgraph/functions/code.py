"""Views of source text: outlines without bodies, signatures, secrets blanked, slices of bounded length."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def skeleton_of(text: str | None) -> str | None:
    """Python source with the bodies of its functions elided, docstrings kept; other text as it is."""
    if not text:
        return text
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return text
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            doc = n.body[:1] if ast.get_docstring(n) else []
            n.body = [*doc, ast.Expr(ast.Constant(...))]
    return ast.unparse(tree)


def skeleton(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(skeleton_of)

    return run(text)


def signature(text: Column) -> Column:
    """The first line that declares something, without what follows its colon or brace."""
    line = F.regexp_extract(text, r"(?m)^\s*((?:export\s+|public\s+|private\s+|async\s+|static\s+)*(?:def|class|func|fn|function|interface|struct|type)\b[^\n{]*)", 1)
    return F.trim(F.regexp_replace(line, r":\s*$", ""))


SECRET = r"(?i)(password|passwd|secret|token|api_?key|private_?key|credential)"


def redacted(key: Column, value: Column) -> Column:
    return F.when(key.rlike(SECRET), F.lit("[redacted]")).otherwise(value)


# Where a document is best cut, strongest first.
CUTS = (r"\n(?=#{1,3} )", r"\n(?=#{4,6} )", r"\n\n", r"\n", r"(?<=[.!?]) ", r" ")


def slices_of(text: str, most: int) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most ``most`` characters: each ends at the last strongest cut in its second half, else where it must."""
    out, at = [], 0
    while len(text) - at > most:
        half = at + most // 2
        end = next((hits[-1] for c in CUTS if (hits := [m.end() for m in re.compile(c).finditer(text, half, at + most)])), at + most)
        out.append((at, end))
        at = end
    if at < len(text):
        out.append((at, len(text)))
    return out


def slices(docs: DataFrame, key: str, text: str, most: int = 8000) -> DataFrame:
    """(key, part, start, end) of whole texts."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, s, e) for k, t in zip(b[key], b[text]) if t for i, (s, e) in enumerate(slices_of(t, most))]
            yield pd.DataFrame(rows, columns=[key, "part", "start", "end"])

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, part int, start int, end int")


def display_label(label: Column, kind: Column) -> Column:
    """The label with the namespace of its kind: notes, headings and tags are told apart from code."""
    prefix = F.when(kind == "heading", "Heading:").when(kind == "tag", "Tag:").when(kind == "page", "Note:").otherwise("")
    return F.when(label.startswith(prefix), label).otherwise(F.concat(prefix, label))
