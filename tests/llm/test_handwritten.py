import random

import pytest

from quillgraph.llm import handwritten as H

CODE = "def scan(a, b):\n    # hand-edited since the generator was retired\n    for x in range(10):\n        yield a + b[x]\n"
MINIFIED = ";".join(f"var a{i}=b[{i}]||c;function d{i}(e,f){{return e?f:g}}" for i in range(20))
CASES = {
    "src/a.py": (CODE, None), "src/vendor_portal/a.py": (CODE, None), "src/generators/codegen_main.py": (CODE, None), "app/min_distance_a.ts": (CODE, None), "a/dist_metric.go": (CODE, None),
    "x/vendor/lib/a.go": (CODE, "third_party"), "lib/pack-2.10/a.py": (CODE, "third_party"), "env/lib/python3.11/site-packages/p/a.py": (CODE, "third_party"), "ThirdParty/p/a.c": (CODE, "third_party"),
    "api/a.pb.go": (CODE, "generated"), "src/a_pb2.py": (CODE, "generated"), "gen/a_gen.go": (CODE, "generated"), "static/a.min.js": (CODE, "minified"), "static/a-min.js": (CODE, "minified"),
    "src/b.py": ("# Code generated by tool v1.2. DO NOT EDIT.\n" + CODE, "generated"), "src/c.java": ("// <auto-generated> tool </auto-generated>\n" + CODE, "generated"),
    "src/d.py": ("# writes the DO NOT EDIT line at the top of each stub\n" + CODE, None), "src/e.py": ("x = 'Code generated by hand'\n" + CODE, None),
    "src/f.ts": ("/*! pack v4.9.0 | (c) the pack authors | MIT licence */\n" + CODE, "third_party"), "src/g.go": (MINIFIED, "minified"), "doc/h.md": ("Plain words in one long line. " * 40, None),
    "src/i.py": ("T = [" + ",".join(str(i * 7919 % 10007) for i in range(200)) + "]", "data"), "src/j.rs": ("B = '" + "aGVsbG8gd29ybGQ9" * 20 + "'", "data"), "src/k.py": ("x = 12", None),
    "src/l.py": ("", None), "src/m.py": (None, None),
}


def made(spark, nodes, paths=None):
    n = spark.createDataFrame(nodes, "source_path string, content string, file string, stats int")
    p = spark.createDataFrame([(x,) for x in (paths if paths is not None else [r[0] for r in nodes])], "source_path string")
    return {r.source_path: {k for k in H.REASONS if r[k]} for r in H.machine_made(p, n).collect()}


def test_cases(spark):
    got = made(spark, [(p, c, "clash", 1) for p, (c, _) in CASES.items()])
    for path, (_, reason) in CASES.items():
        assert (reason in got.get(path, ())) if reason else path not in got, path


def test_spellings_and_any_node(spark):
    nodes = [("src/a.py", CODE, "f", 1), (".\\src\\a.py", MINIFIED, "f", 1), (None, MINIFIED, "f", 1), (" ", MINIFIED, "f", 1)]
    got = made(spark, nodes, ["./src/a.py", "src\\a.py", "src/a.py", "src/b.py", None, "", "src/a.py"])
    assert set(got) == {"./src/a.py", "src\\a.py", "src/a.py"}


def test_empty_and_very_long(spark):
    assert made(spark, [], []) == {}
    assert made(spark, [("a.py", CODE * 5000, "f", 1), ("b.py", MINIFIED * 300, "f", 1)]) == {"b.py": {"minified"}}


@pytest.mark.parametrize("seed", range(3))
def test_statistics_as_in_python(spark, seed):
    import re

    from pyspark.sql import functions as F

    rng = random.Random(seed)
    text = "".join(rng.choice("ab1 ._\n0x") for _ in range(300))
    df = spark.createDataFrame([(text,)], "content string")
    row = df.select(*(v.alias(k) for k, v in H.layout(F.col("content")).items())).head()
    assert row.longest_line == max(map(len, text.split("\n")))
    assert row.space == pytest.approx(sum(c.isspace() for c in text) / len(text))
    assert row.numbers == pytest.approx(sum(map(len, re.findall(H.NUMBER, text))) / len(text))


def test_layout_alone_tells_minified_and_data_in_each_language(spark):
    numbers, blob = "T = [" + ",".join(str(i * 7919 % 10007) for i in range(400)) + "]", "B = '" + "aGVsbG8gd29ybGQ9" * 40 + "'"
    prose = "A plain line of words that somebody wrote, with blanks between them.\n" * 8
    nodes = []
    for name, (endings, _) in H.LANGUAGES.items():
        end = endings[0] if endings else "xyz"
        nodes += [(f"a/{name}_min_text.{end}", MINIFIED), (f"a/{name}_numbers.{end}", numbers), (f"a/{name}_coded.{end}", blob), (f"a/{name}_code.{end}", CODE * 3), (f"a/{name}_prose.{end}", prose)]
    n = spark.createDataFrame(nodes, "source_path string, content string")
    got = {r.source_path: r for r in H.machine_made(n.select("source_path"), n).collect()}
    assert all(r.by_layout and not r.by_mark and not r.by_path for r in got.values())
    assert {p: ("minified" if r.minified else "data") for p, r in got.items()} == {p: ("minified" if "min_text" in p else "data") for p, _ in nodes if "_code." not in p and "prose" not in p}


def test_profile_by_language(spark):
    n = spark.createDataFrame([("a.py", CODE * 2), ("b.py", CODE * 3), ("c.js", MINIFIED), (None, CODE), ("d.go", None)], "source_path string, content string")
    got = {r.language: r for r in H.language_profile(n).collect()}
    assert got["python"].texts == 2 and got["javascript"].mean_line[1] > 500 > got["python"].mean_line[1]
