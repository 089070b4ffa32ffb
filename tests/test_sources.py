"""Readers, extractors and streams."""

import datetime as dt
import json
import re

import pytest

from quillgraph.operators.build import Graph
from quillgraph.sources import extract as X
from quillgraph.sources import files as Fi
from quillgraph.sources import formats as Fo
from quillgraph.sources.yaml_lite import documents
from quillgraph.streaming import live


def edges_of(fragment):
    return {(r[1], r[3], r[4]) for r in fragment.rows if r[0] == "edge"}


def labels_of(fragment):
    return {(r[2], r[3]) for r in fragment.rows if r[0] == "node"}


def test_python():
    f = X.extract_python("a/m.py", 'import os\nfrom .x import y\n\n@deco(1)\nclass A(Base):\n    """What it is."""\n    def run(self):\n        return helper()\n\ndef helper():\n    return A().run()\n')
    assert {("A", "class"), (".run()", "method"), ("helper()", "function")} <= labels_of(f)
    assert {("a_m_py_a_run", "calls", "a_m_py_helper"), ("a_m_py_helper", "calls", "a_m_py_a_run"), ("a_m_py_a", "inherits", "base"), ("a_m_py", "imports", "os"), ("a_m_py", "imports_from", "x_y"), ("a_m_py_a", "references", "deco")} <= edges_of(f)
    assert X.extract_python("b.py", "def (").rows[0][3] == "file"


def test_sql():
    f = X.extract_sql("s.sql", "CREATE TABLE a (id int, b_id int REFERENCES b(id));\nCREATE VIEW v AS WITH c AS (SELECT * FROM a) SELECT * FROM c JOIN d ON 1=1;\nCREATE INDEX i ON a(id);\n-- CREATE TABLE no (x int);\nALTER TABLE d ADD CONSTRAINT k FOREIGN KEY (x) REFERENCES a(id);")
    assert {("a", "references", "b"), ("v", "reads_from", "a"), ("v", "reads_from", "d"), ("i", "indexes", "a"), ("d", "references", "a")} <= edges_of(f)
    assert ("v", "reads_from", "c") not in edges_of(f) and not any(label == "no" for label, _ in labels_of(f))


def test_markdown_json_docker_and_others():
    f = X.extract_markdown("d.md", "---\ntags: [Big, small]\n---\n# One\n## Two\nsee `scan()` and [x](other#part) #tag #fff\n```\n# no\n```\n# One\n")
    assert {("d_md", "contains", "d_md_one"), ("d_md_one", "contains", "d_md_two"), ("d_md_two", "references", "scan"), ("d_md", "references_heading", "other_md"), ("d_md", "tagged_as", "tag_big"), ("d_md", "tagged_as", "tag_tag")} <= edges_of(f)
    assert sum(k == "heading" for _, k in labels_of(f)) >= 2 and not any(label == "no" for label, _ in labels_of(f))
    f = X.extract_json("package.json", json.dumps({"dependencies": {"left": "1"}, "scripts": {"go": "x"}}))
    assert ("package_json_dependencies", "imports", "left") in edges_of(f)
    f = X.extract_dockerfile("Dockerfile", "FROM base:1 AS build\nENV A=1\nFROM build\nCOPY --from=build /a /b\n")
    assert {("dockerfile_stage_build", "from_image", "image_base_1"), ("dockerfile_stage_stage1", "from_image", "dockerfile_stage_build"), ("dockerfile_stage_stage1", "depends_on", "dockerfile_stage_build")} <= edges_of(f)
    f = X.extract_protobuf("a.proto", "message Q {}\nmessage R {}\nservice S {\n  rpc Get (Q) returns (stream R);\n}\n")
    assert {("s", "defines_rpc", "s_get"), ("s_get", "accepts", "q"), ("s_get", "returns", "r")} <= edges_of(f)
    f = X.extract_terraform("m.tf", 'resource "a" "b" {\n x = var.n\n}\nvariable "n" {}\n')
    assert ("m_tf_a_b", "depends_on", "m_tf_var_n") in edges_of(f)
    f = X.extract_manifest("pyproject.toml", '[project]\nname = "me"\ndependencies = ["you>=1", "they"]\n')
    assert {("package_me", "depends_on", "you"), ("package_me", "depends_on", "they")} <= edges_of(f)
    f = X.extract_lines("a.ts", "import { x } from './b'\nexport class A extends B {}\nexport function go() {}\n")
    assert {("a_ts_a", "inherits", "b"), ("a_ts", "imports_from", "b")} <= edges_of(f) and ("go()", "function") in labels_of(f)
    f = X.extract_shell("a.sh", "go() {\n  echo\n}\nrun() {\n  go\n}\n. ./lib.sh\n")
    assert {("a_sh_run", "calls", "a_sh_go"), ("a_sh", "imports_from", "lib_sh")} <= edges_of(f)
    assert ("name", "field") in labels_of(X.extract_avro("x.avsc", '{"type": "record", "name": "R", "fields": [{"name": "name", "type": "string"}]}'))
    assert ("x_json_a", "references_schema", "x_json_b") in edges_of(X.extract_json_schema("x.json", '{"$defs": {"a": {"$ref": "#/$defs/b"}, "b": {}}}'))


def test_yaml():
    text = """# c
name: x  # note
on: {push: {}, pull_request: [a, b]}
list:
- a
- k: v
  n:
    - 1
    - "two: 2"
text: |
  one: 1
    two
empty:
flow: [1, {a: b}]
---
- 7
"""
    assert documents(text) == [{"name": "x", "on": {"push": {}, "pull_request": ["a", "b"]}, "list": ["a", {"k": "v", "n": [1, "two: 2"]}], "text": "one: 1\ntwo", "empty": None, "flow": [1, {"a": "b"}]}, [7]]
    assert documents("") == [] and documents("a: [1,\n 2]") == [{"a": [1, 2]}]


def test_configuration_formats():
    f = X.extract_yaml(".github/workflows/ci.yml", "on: [push]\njobs:\n  a:\n    steps:\n      - uses: actions/checkout@v4\n      - run: echo ${{ secrets.KEY }}\n  b:\n    needs: a\n")
    got = edges_of(f)
    assert ("github_workflows_ci_yml_job_b", "depends_on", "github_workflows_ci_yml_job_a") in got and ("github_workflows_ci_yml_a_step_0", "uses_action", "action_actions_checkout_v4") in got
    assert ("github_workflows_ci_yml", "references_secret", "secret_key") in got
    f = X.extract_yaml("docker-compose.yml", "services:\n  web:\n    image: app:1\n    depends_on: [db]\n    volumes:\n      - data:/x\n  db:\n    build: ./db\n")
    assert {("service_web", "uses_image", "image_app_1"), ("service_web", "depends_on", "service_db"), ("service_web", "mounts", "volume_data"), ("service_db", "builds_with", "build_db")} <= edges_of(f)
    f = X.extract_yaml("k.yaml", "apiVersion: v1\nkind: Deployment\nmetadata:\n  name: web\nspec:\n  template:\n    metadata:\n      labels:\n        app: web\n    spec:\n      containers:\n        - image: app:1\n          env:\n            - name: K\n              valueFrom:\n                secretKeyRef:\n                  name: s\n---\napiVersion: v1\nkind: Service\nmetadata: {name: front}\nspec:\n  selector:\n    app: web\n")
    assert {("k8s_deployment_web", "uses_image", "image_app_1"), ("k8s_deployment_web", "references_secret", "k8s_secret_s"), ("k8s_service_front", "selects", "label_app_web"), ("label_app_web", "owns", "k8s_deployment_web")} <= edges_of(f)
    f = X.extract_bazel("pkg/BUILD", 'load("//r:d.bzl", "x")\nx(name = "a", srcs = ["a.c"], deps = [":b", "//o:c"])\n')
    assert {("pkg_a", "depends_on", "pkg_b"), ("pkg_a", "depends_on", "o_c"), ("pkg_a", "contains_source", "pkg_a_c")} <= edges_of(f)
    f = X.extract_project("a.csproj", '<ProjectReference Include="..\\b\\B.csproj" /><PackageReference Include="Json" Version="1" />')
    assert {("a_csproj", "imports", "b"), ("a_csproj", "references", "json")} <= edges_of(f)
    f = X.extract_properties("c.properties", "bootstrap.servers=k:9092\ntopics=a,b\n")
    assert {("c_properties", "connects_to", "broker_k_9092"), ("c_properties", "references_topic", "topic_a")} <= edges_of(f)
    assert X.extractor_for("a/BUILD", "") is X.extract_bazel and X.extractor_for("x.blade.php", "") is X.extract_markup and X.extractor_for("none", "text") is None


def test_extract_runs_over_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.py").write_text("def f():\n    pass\n")
    (tmp_path / "p" / "b.md").write_text("# T\n")
    (tmp_path / "p" / "c.bin").write_bytes(b"\x00\x01")
    g = X.extract(Fi.scan_text(spark, str(tmp_path)))
    kinds = {r.node_kind for r in g.nodes.collect()}
    assert {"file", "function", "heading"} <= kinds and g.edges.count() == 2
    assert X.extract(spark.createDataFrame([(None, "x"), ("a.py", None)], "path string, text string")).nodes.count() == 1


@pytest.mark.parametrize(
    "rules,path,out",
    [(["*.log"], "a/b.log", True), (["/x"], "x/y", True), (["/x"], "a/x", False), (["a/"], "a/b", True), (["a/"], "a", False), (["*.log", "!keep.log"], "keep.log", False), (["a/**/z"], "a/b/c/z", True), (["# c", ""], "a", False), (["**/t"], "t/u", True), (["f[!a].py"], "fb.py", True)],
)
def test_ignore_rules(rules, path, out):
    verdict = False
    for rule in filter(None, map(Fi.ignore_pattern, rules)):
        if re.search(rule[0], path):
            verdict = not rule[1]
    assert verdict == out


def test_noise_and_sizes(spark):
    df = spark.createDataFrame([("a/build/x.o", 1), ("a/build/y.py", 1), ("b/build/z.py", 1), ("c/node_modules/q.js", 1), ("src/a.py", 600_000)], "path string, words int")
    assert {r.path for r in Fi.noise(df).collect()} == {"a/build/x.o", "a/build/y.py", "c/node_modules/q.js"}
    assert Fi.corpus_size(df).head().warning == "large"


def test_graph_json_round_trip(spark, tmp_path):
    data = {"directed": True, "nodes": [{"id": "a", "label": "A"}, {"id": "b", "label": "B's"}], "links": [{"source": "a", "target": "b", "relation": "calls"}]}
    (tmp_path / "g.json").write_text(json.dumps(data))
    g = Fo.read_graph_json(spark, str(tmp_path / "g.json"))
    assert [(r.src, r.dst) for r in g.edges.collect()] == [("a", "b")]
    lines = {(r.part, json.loads(r.json).get("id") or json.loads(r.json)["source"]) for r in Fo.graph_json_lines(g).collect()}
    assert lines == {("nodes", "a"), ("nodes", "b"), ("links", "a")}
    statements = [r.statement for r in Fo.cypher_lines(g).collect()]
    assert any(r"B\'s" in s for s in statements) and any("[:CALLS]" in s for s in statements)
    assert any("&lt;" in r.element for r in Fo.graphml_lines(Graph(spark.createDataFrame([("a", "<x>")], "id string, label string"), g.edges)).collect())


def test_git_notes_and_configs(spark):
    log = ["commit abcdef1234", "Author: x", "", "src/a.py", "src/b.py", "commit 1234567890", "src/a.py"]
    rows = spark.createDataFrame([("l", i, t) for i, t in enumerate(log)], "log_id string, pos int, line string")
    assert sorted((r.commit, r.file) for r in Fo.parse_git_log(rows).collect()) == [("1234567890", "src/a.py"), ("abcdef1234", "src/a.py"), ("abcdef1234", "src/b.py")]
    note = spark.createDataFrame([("n", '---\ntype: query\ndate: 2024-01-02\nquestion: "Why?"\noutcome: useful\nsource_nodes: [a, "b"]\n---\nbody')], "path string, text string")
    r = Fo.parse_notes(note).head()
    assert (r.outcome, r.question, r.nodes, r.date) == ("useful", "Why?", ["a", "b"], dt.datetime(2024, 1, 2))
    g = Fo.parse_server_configs(spark.createDataFrame([("c", '{"mcpServers": {"s": {"command": "run", "env": {"KEY": "x"}}}}')], "path string, text string"))
    assert {(r.dst, r.relation) for r in g.edges.collect()} == {("command:run", "references"), ("env:KEY", "requires_env")}


def test_headings_and_links(spark):
    docs = spark.createDataFrame([(1, "# A\ntext\n## B\n```\n# no\n```\n### C\n## D\n[x](y.md#z) [w](http://e.org) [[p]] [v](y.md)"), (2, None), (3, "")], "doc_id int, text string")
    got = [(r.title, r.level, r.parent_pos) for r in Fo.headings(docs).orderBy("pos").collect()]
    assert got == [("A", 1, None), ("B", 2, 0), ("C", 3, 2), ("D", 2, 0)]
    assert {(r.target, r.relation) for r in Fo.links(docs).collect()} == {("y.md", "references_heading"), ("p.md", "references")}


def test_scip(spark, tmp_path):
    doc = {"documents": [{"relative_path": "a", "symbols": [{"symbol": "X", "kind": "class", "relationships": [{"symbol": "Y", "is_implementation": True}, {"symbol": "Z", "is_reference": True}]}]}, {"relative_path": "b", "symbols": [{"symbol": "Y", "kind": "class"}]}]}
    (tmp_path / "i.json").write_text(json.dumps(doc))
    g = Fo.read_scip(spark, str(tmp_path / "i.json"))
    assert {(r.src, r.dst, r.relation) for r in g.edges.collect()} == {("a#X", "b#Y", "scip_impl"), ("a#X", "stub#Z", "scip_ref")}
    assert {r.id for r in g.nodes.collect()} == {"a#X", "b#Y", "stub#Z"}


def test_stream_follows_files(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "graph"
    schema = "path string, text string, ts timestamp"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    write([("a.py", "def f():\n    pass\n", dt.datetime(2024, 1, 1)), ("b.py", "def g():\n    pass\n", dt.datetime(2024, 1, 1))])
    for step in range(2):
        live.follow_files(spark.readStream.schema(schema).parquet(str(source)), str(store), str(tmp_path / "check")).awaitTermination()
        if not step:
            write([("a.py", "def h():\n    pass\n", dt.datetime(2024, 1, 2))])
    assert {r.label for r in live.current(spark, str(store), "nodes").collect()} == {"a.py", "b.py", "h()", "g()"}


def test_stream_batches_as_on_a_table(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [(at(0), "a.py", "modified"), (at(2), "b.md", "modified"), (at(10), "c.md", "deleted"), (at(11), ".git/x", "modified"), (at(12), "d.md", "opened"), (at(40), "z.py", "modified")]
    df = spark.createDataFrame(rows, "ts timestamp, path string, kind string")
    df.write.parquet(str(tmp_path / "e"))
    want = {tuple(r.paths): r.rebuild for r in live.needs_rebuild(live.batches(live.watched(df))).collect()}
    assert want == {("a.py", "b.md"): True, ("c.md",): True, ("z.py",): True}
    stream = live.needs_rebuild(live.batches(live.watched(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")))))
    q = stream.writeStream.format("memory").queryName("batched").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r.paths) for r in spark.table("batched").collect()} <= set(want) and spark.table("batched").count() == 2
