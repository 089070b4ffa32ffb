"""Canonical identifiers as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII = r"^[\x00-\x7f]*$"


def _fold(x: Column) -> Column:
    """Unicode case folding, then NFKC, by the ICU classes that ship with Spark."""
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))


def folded(x: Column) -> Column:
    """Case fold and NFKC until nothing changes (three rounds suffice); plain ``lower`` for ASCII."""
    text = F.coalesce(x, F.lit(""))
    return F.when(x.isNull(), F.lit(None).cast("string")).when(text.rlike(ASCII), F.lower(text)).otherwise(_fold(_fold(_fold(text))))


def canonical_id(x: Column) -> Column:
    """Fold case and compatibility forms, turn each run of non-word characters and ``_`` into one ``_``, strip the outer ones."""
    return F.regexp_replace(F.regexp_replace(folded(x), r"[^\p{L}\p{N}]+", "_"), r"^_|_$", "")


def filled(x: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(x.rlike(r"[^\s\p{Z}]"), F.lit(False))


def micros(x: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without a time zone."""
    return F.unix_micros(x.cast("timestamp"))
