"""What a reader needs beside a draft or a change: the definitions a draft leans on, and what a diff touches."""

from __future__ import annotations

import builtins
import keyword
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import predicates as P
from quillgraph.functions import vocabulary as V
from quillgraph.operators.briefing import briefing
from quillgraph.operators.build import Graph
from quillgraph.operators.index import Index, search_index
from quillgraph.operators.upkeep import spans, touched

# Words of other languages that are never a dependency.
OTHER_KEYWORDS = (
    "any await boolean case catch console const default else enum export extends false final func function go implements interface let log namespace new null number package private "
    "protected public return static string struct super switch this throw true try typeof undefined var void"
).split()
RESERVED = {w.lower() for w in (*keyword.kwlist, *dir(builtins), *OTHER_KEYWORDS)} | {"self", "cls"}
# How a draft defines a name.
DEFINED = re.compile(r"\b(?:def|class|function|interface|type|struct|func|fn)\s+([A-Za-z_]\w*)|\b(?:const|let|var)\s+([A-Za-z_]\w*)\s*=")
HUMP = re.compile(r"[A-Z]+(?=[A-Z][a-z]|\b)|[A-Z]?[a-z0-9]+|[A-Z]+")


def unresolved_names(draft: str) -> tuple[list[str], set[str]]:
    """(names a draft uses and does not define, names it defines); words of three letters on, without keywords and built-ins."""
    own = {name for pair in DEFINED.findall(draft) for name in pair if name}
    used = re.findall(r"\b[A-Za-z_][A-Za-z0-9_]{2,}\b", draft)
    return [w for w in dict.fromkeys(used) if w not in own and w.lower() not in RESERVED], own


def refine(graph: Graph, index: Index, draft: str, budget: int = 2000, top: int = 10, most_names: int = 20) -> DataFrame:
    """(rank, tier, id, label, tokens): definitions that a draft's first ``most_names`` unresolved names point to, within a budget of tokens.

    Nodes that the draft defines itself are left out. A draft without unresolved names gives no rows.
    """
    names, own = unresolved_names(draft)
    terms = list(dict.fromkeys(t.lower() for n in names[:most_names] for t in (*HUMP.findall(n), n) if len(t) > 1))
    known = graph.nodes.select("id", F.regexp_replace(F.regexp_replace("label", r"\(\)$", ""), r"^\.", "").alias("name"))
    scores = search_index(index, terms).join(known, "id").where(~F.col("name").isin(*own) & ~F.col("id").isin(*own) if own else F.lit(True))
    return briefing(graph, scores.orderBy(F.desc("score"), "id").limit(top).select("id", "score"), budget)


def diff_context(graph: Graph, hunks: DataFrame) -> DataFrame:
    """(diff_id, role, id): what each diff's ``hunks`` (diff_id, file, first, last) change, and who calls it, tests it or routes to it.

    Roles are changed, caller (not changed itself), test (a neighbour whose id or file says test) and endpoint (a
    neighbour by a route, endpoint or api relation, or whose id says route).
    """
    changed = touched(hunks, spans(graph.nodes)).select("diff_id", "id")
    e = graph.edges.select("src", "dst", "relation").distinct()
    calls = e.where(F.col("relation").isin(*V.CALLS)).select(F.col("dst").alias("id"), F.col("src").alias("other"))
    callers = changed.join(calls, "id").select("diff_id", F.col("other").alias("id")).distinct().join(changed, ["diff_id", "id"], "left_anti")
    both = e.select(F.col("src").alias("id"), F.col("dst").alias("other"), "relation").unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("other"), "relation"))
    near = changed.join(both.where("id != other"), "id").select("diff_id", F.col("other").alias("id"), "relation")
    near = near.join(graph.nodes.select("id", F.lower(P.text_of(F.col("source_file"))).alias("file")), "id")
    role = lambda rows, name: rows.select("diff_id", F.lit(name).alias("role"), "id").distinct()
    tests = near.where(F.lower("id").contains("test") | F.col("file").contains("test"))
    routes = near.where(F.col("relation").isin("route", "endpoint", "api") | F.lower("id").contains("route"))
    return role(changed, "changed").unionByName(role(callers, "caller")).unionByName(role(tests, "test")).unionByName(role(routes, "endpoint"))
