import pytest
from pyspark.sql import functions as F

from quillgraph.functions.stems import porter, stemmed
from quillgraph.operators import context as X
from quillgraph.operators import index as I
from quillgraph.operators import upkeep as U
from quillgraph.operators.build import Graph

# Examples of the published algorithm.
STEMS = (
    "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl hopping hop falling fall filing file "
    "happy happi sky sky relational relat rational ration digitizer digit vietnamization vietnam operator oper hopefulness hope sensitiviti sensit triplicate triplic electrical electr "
    "revival reviv replacement replac adoption adopt homologous homolog bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll parsing pars queues queue"
).split()


@pytest.mark.parametrize("word,want", list(zip(STEMS[::2], STEMS[1::2])))
def test_porter(word, want):
    assert porter(word) == want


def test_other_words_are_their_own_stem(spark):
    df = spark.createDataFrame([("is",), ("größe",), ("a1b2",), ("",), (None,), ("Parsing",), ("is",)], "word string")
    assert {r.word: r.stem for r in stemmed(df).collect()} == {"is": "is", "größe": "größe", "a1b2": "a1b2", "": "", "Parsing": "Parsing"}


DOCS = "id string, title string, headings string, tags string, body string, label string, stem string"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(f"n{i}", f"node {i}", None, None, "plain words " * 5, f"NodeLabel{i}", "clash") for i in range(40)]
    rows += [("p", "Parser", "", "", "It parses a queue.", "parse_queue()", "c"), ("q", "queue", None, "parsing", "", "readQueue", "c"), ("e", None, None, None, None, None, "c"), (None, "parser", None, None, "x", "y", "c"), ("p", "again", None, None, "parsed", "parse_queue()", "c")]
    folder = str(tmp_path_factory.mktemp("index"))
    I.build_index(spark.createDataFrame(rows, DOCS), folder, "label")
    return I.open_index(spark, folder)


def test_search_by_stem_and_spelling(index):
    found = {r.id: r.score for r in I.search_index(index, ["parse"]).collect()}
    assert set(found) == {"p", "q"}
    assert {r.id for r in I.search_index(index, ["queeue"]).collect()} == {"p", "q"} and I.search_index(index, ["queeue"], fuzzy=False).count() == 0
    assert I.search_index(index, []).count() == 0 and index.totals.head().n == 43
    plan = I.search_index(index, ["parse"], fuzzy=False)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "stem" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_substrings(spark, index):
    texts = spark.createDataFrame([(f"n{i}", f"NodeLabel{i}") for i in range(40)] + [("p", "parse_queue()"), ("q", "readQueue"), ("e", None)], "id string, text string")
    got = {(r.needle, r.id) for r in I.substrings(index, texts, ["Queue", "label3", "e", "zzz", "nodelabel"]).collect()}
    plain = [(f"n{i}", f"nodelabel{i}") for i in range(40)] + [("p", "parse_queue()"), ("q", "readqueue")]
    assert got == {(n, i) for n in ("queue", "label3", "e", "zzz", "nodelabel") for i, t in plain if n in t}


def test_empty_index(spark, tmp_path):
    index = I.build_index(spark.createDataFrame([], DOCS), str(tmp_path), "label")
    assert I.search_index(index, ["parse"]).count() == 0 and I.substrings(index, spark.createDataFrame([], "id string, text string"), ["abc"]).count() == 0


def graph(spark):
    nodes = spark.createDataFrame(
        [("a", "load()", "src/a.py", "L1", "def load(): pass"), ("b", "save()", "src/a.py", "L20", "def save(): pass"), ("t", "test_load", "tests/test_a.py", "L1", None), ("r", "route_a", "src/r.py", None, None), ("c", "caller", "lib/c.py", "L5", None)],
        "id string, label string, source_file string, source_location string, content string",
    )
    edges = spark.createDataFrame([("t", "a", "calls"), ("c", "a", "calls"), ("c", "b", "calls"), ("r", "b", "endpoint"), ("a", "b", "calls")], "src string, dst string, relation string")
    return Graph(nodes, edges)


def test_diff_context(spark):
    hunks = spark.createDataFrame([("d", "a.py", 2, 3), ("e", "proj/src/a.py", 25, 25), ("f", "other.py", 1, 9), ("g", None, 1, 9)], "diff_id string, file string, first int, last int")
    got = {(r.diff_id, r.role, r.id) for r in X.diff_context(graph(spark), hunks).collect()}
    assert got == {
        ("d", "changed", "a"), ("d", "caller", "t"), ("d", "caller", "c"), ("d", "test", "t"),
        ("e", "changed", "b"), ("e", "caller", "a"), ("e", "caller", "c"), ("e", "endpoint", "r"),
    }


def test_refine(spark, tmp_path):
    g = graph(spark)
    index = I.build_index(g.nodes.select("id", F.col("label").alias("title"), F.col("content").alias("body"), "label"), str(tmp_path), "label")
    draft = "def caller(x):\n    y = load(x)\n    return str(y)\n"
    assert X.unresolved_names(draft) == (["load"], {"caller"})
    assert {r.id for r in X.refine(g, index, draft).collect()} == {"a", "t"} and X.refine(g, index, "x = 1").count() == 0


def test_paths_that_end_alike(spark):
    left, right = ["src/a/x.py", "x.py", "b/x.py", None], ["a/x.py", "x.py", "c/b/x.py", "ax.py"]
    got = {tuple(r) for r in U.same_files(spark.createDataFrame([(x,) for x in left], "file string"), spark.createDataFrame([(x,) for x in right], "file string")).collect()}
    assert got == {(a, b) for a in left if a for b in right if a == b or a.endswith("/" + b) or b.endswith("/" + a)}
