"""Text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.ids import folded
from quillgraph.functions.vocabulary import ENGLISH_STOPWORDS, PROGRAM_STOPWORDS

CAMEL_PART = r"[A-Z]+(?=[A-Z][a-z0-9]|\b)|[A-Z]?[a-z0-9]+|[A-Z]+"


def subtokens(x: Column) -> Column:
    """Identifiers of a text and their lower-cased parts at ``_``, ``-`` and camel humps, in order, each once."""
    whole = F.transform(F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9_\-]+"), F.lit(0)), lambda t: F.regexp_replace(t, r"^[-_]+|[-_]+$", ""))
    parts = lambda t: F.transform(F.regexp_extract_all(F.regexp_replace(t, r"[_\-]+", " "), F.lit(CAMEL_PART), F.lit(0)), F.lower)
    every = F.flatten(F.transform(F.filter(whole, lambda t: t != ""), lambda t: F.concat(F.array(t), parts(t))))
    return F.array_distinct(F.coalesce(every, F.array().cast("array<string>")))


def vocabulary_terms(x: Column) -> Column:
    """Lower-cased subtokens of at least two characters, each once."""
    return F.array_distinct(F.filter(F.transform(subtokens(x), F.lower), lambda t: F.length(t) >= 2))


def terms(x: Column) -> Column:
    """Terms for weighting: camel humps apart, lower case, runs of letters and digits, without single characters, numbers and stop words."""
    apart = F.regexp_replace(F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    every = F.regexp_extract_all(F.lower(apart), F.lit(r"[a-z0-9]+"), F.lit(0))
    stop = F.array(*(F.lit(w) for w in sorted({*ENGLISH_STOPWORDS, *PROGRAM_STOPWORDS})))
    keep = lambda t: (F.length(t) > 1) & ~t.rlike("^[0-9]+$") & ~F.array_contains(stop, t)
    return F.filter(every, keep)


def without_diacritics(x: Column) -> Column:
    """Letters without their marks: canonical decomposition by ICU, combining marks dropped; ASCII passes as it is."""
    text = F.coalesce(x, F.lit(""))
    taken_apart = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True))
    return F.when(x.isNull(), F.lit(None).cast("string")).when(text.rlike(r"^[\x00-\x7f]*$"), text).otherwise(F.regexp_replace(taken_apart, r"\p{M}+", ""))


def search_tokens(x: Column) -> Column:
    """Runs of letters and digits of the lower-cased text without diacritics."""
    return F.regexp_extract_all(F.lower(without_diacritics(x)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def label_key(x: Column) -> Column:
    """The form in which labels are compared for merging: folded, runs of other characters as one blank."""
    return F.trim(F.regexp_replace(folded(x), r"[^\p{L}\p{N}]+", " "))


def windows(x: Column, size: int) -> Column:
    """All distinct runs of ``size`` characters; a shorter non-empty text is its own."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (size - 1), F.lit(1))), lambda i: F.substring(x, i, F.lit(size)))
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def entropy(x: Column) -> Column:
    """Shannon entropy in bits per character."""
    chars = F.split(x, "")
    share = lambda c: F.size(F.filter(chars, lambda d: d == c)) / F.length(x)
    return F.when(x == "", 0.0).otherwise(-F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + share(c) * F.log2(share(c))))


def token_estimate(x: Column, per: int = 4) -> Column:
    return F.floor(F.length(x) / per)


def slug(x: Column) -> Column:
    """Lower-case ASCII words joined by ``-``; ``unnamed`` if nothing is left."""
    joined = F.regexp_replace(without_diacritics(x), r"[:/\\._\s]+", "-")
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, "[^a-zA-Z0-9-]+", ""), "-+", "-"), "^-|-$", ""))
    return F.when(F.coalesce(plain, F.lit("")) == "", "unnamed").otherwise(plain)


def plain_html(x: Column) -> Column:
    """The text of a page: scripts, styles and tags out, white space collapsed."""
    out = F.regexp_replace(F.regexp_replace(x, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), r"\s+", " "))


def escaped_cypher(x: Column) -> Column:
    plain = F.regexp_replace(x, r"[\r\n]+", " ")
    return F.replace(F.replace(plain, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def escaped_xml(x: Column) -> Column:
    legal = F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        legal = F.replace(legal, F.lit(raw), F.lit(safe))
    return legal


def clean_label(x: Column, most: int = 256) -> Column:
    """Control characters out, at most ``most`` characters."""
    return F.substring(F.regexp_replace(x, r"[\x00-\x1f\x7f]", ""), 1, most)
