"""From a directory to answers, and the outline and slicing functions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillgraph import engine as E
from quillgraph.functions import code as K
from quillgraph.operators import briefing as B
from quillgraph.operators import resolve as R
from quillgraph.operators.build import Graph


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "core.py").write_text('class Store:\n    """Keeps things."""\n    def put(self, x):\n        return check(x)\n\ndef check(x):\n    return x\n')
    (root / "app.py").write_text("from core import Store\n\nclass Fast(Store):\n    pass\n\ndef main():\n    return helper()\n\ndef helper():\n    return 1\n")
    (root / "README.md").write_text("# Store\n\nUse `check()`.\n")
    (root / ".env").write_text("KEY=1\n")
    return E.Engine.from_directory(spark, str(root))


def ids(df):
    return {r.id.rsplit("_py_", 1)[-1] for r in df.collect()}


def test_answers(project):
    assert ids(project.callers("check")) >= {"store_put"}
    assert ids(project.callees("main")) == {"helper"}
    assert ids(project.implementations("Store")) >= {"fast"}
    assert "app_py" in {r.id[-6:] for r in project.affected("helper", 3).collect()} or ids(project.affected("helper", 3)) >= {"main"}
    row = project.path("main", "helper").head()
    assert row.depth == 1
    assert project.stats().head().nodes > 5 and project.god_nodes().count() >= 0
    assert not [r for r in project.graph.nodes.collect() if r.source_file and r.source_file.endswith(".env")]


def test_saved_graph_and_commands(spark, project, tmp_path, capsys):
    project.save(str(tmp_path / "g"))
    assert E.main(["callees", "main", "--graph", str(tmp_path / "g")]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert any(x["id"].endswith("helper") for x in lines)
    again = E.Engine.from_tables(spark, str(tmp_path / "g"))
    assert project.diff(again).count() == 0
    assert again.merged_with(again).graph.nodes.count() == project.graph.nodes.count()
    assert again.lint().where("rule = 'dangling_reference'").count() == 0


def test_questions_and_sections(spark, project):
    members = project.graph.nodes.select("id", F.lit("all").alias("community"))
    edges = project.graph.edges.withColumn("confidence", F.when(F.col("relation") == "calls", "AMBIGUOUS").otherwise("EXTRACTED"))
    rows = B.questions(Graph(project.graph.nodes, edges), members).collect()
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and rows[0].type == "ambiguous_edge"
    assert B.sections(members, project.graph).head().section in {*B.SECTIONS, "other"}


def test_aliases_and_cross_repo_calls(spark):
    chain = [(f"a{i}", f"a{i + 1}") for i in range(9)] + [("x", "y"), ("y", "x"), ("two", "a"), ("two", "b")]
    got = {r.alias: r.target for r in R.follow_aliases(spark.createDataFrame(chain, "alias string, target string")).collect()}
    assert got == {f"a{i}": "a9" for i in range(9)}
    parked = spark.createDataFrame([("c", "r1", "T", "go"), ("d", "r2", "T", "go")], "caller string, repo string, receiver_type string, callee string")
    types = spark.createDataFrame([("T", "t", "r2")], "name string, type_id string, repo string")
    members = spark.createDataFrame([("t", "go", "t.go", "method"), ("t", "go", "t.def", "defines")], "type_id string, name string, id string, relation string")
    assert [(r.src, r.dst) for r in R.cross_repo_calls(parked, types, members).collect()] == [("c", "t.go")]


def test_outlines_and_slices(spark):
    assert K.skeleton_of('def f(x):\n    """Doc."""\n    return x\n') == 'def f(x):\n    """Doc."""\n    ...'
    assert K.skeleton_of("not python {") == "not python {" and K.skeleton_of(None) is None
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "end. ", "\n", "\n\n", "\n# Head\n", "x" * 30]) for _ in range(500))
    for most in (10, 100, 5000):
        parts = K.slices_of(text, most)
        assert "".join(text[a:b] for a, b in parts) == text and all(0 < b - a <= most for a, b in parts)
    df = spark.createDataFrame([("public class A {", "password", "x"), ("x = 1\ndef go(a, b):\n", "user", "y")], "t string, k string, v string")
    rows = df.select(K.signature(F.col("t")).alias("s"), K.redacted(F.col("k"), F.col("v")).alias("r")).collect()
    assert [tuple(r) for r in rows] == [("public class A", "[redacted]"), ("def go(a, b)", "y")]
