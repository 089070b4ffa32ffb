import time

import pytest

from quillgraph.sources import extract as X
from quillgraph.sources.braces import extract_braces

# For each sample the types, members and functions it has, and the edges between them, by label.
SAMPLES = {
    "a.ts": (
        "import { x } from './lib';\nexport class A<T> extends B<T> implements C, D {\n  constructor(private q: Q) { super(); }\n  async run(n: number): Promise<void> {\n    if (n) { this.go(n); helper(n); }\n  }\n"
        "  private go(n) { return 'x {'; }\n}\nexport function helper(y) { return mk(y); }\nconst mk = (z) => { return new A(z); };\n",
        {("A", "inherits", "B"), ("A", "implements", "C"), ("A", "implements", "D"), ("A", "method", ".run()"), ("A", "method", ".go()"), (".run()", "calls", ".go()"), (".run()", "calls", "helper()"), ("helper()", "calls", "mk()"), ("mk()", "calls", "A"), ("a.ts", "imports_from", "./lib")},
    ),
    "A.java": (
        "package p;\nimport java.util.List;\npublic class A extends B<String> implements C {\n  public A(int x) { this.f = x; }\n  public List<String> run(Map<K, V> m) throws IOException {\n    for (int i = 0; i < 3; i++) { go(i); }\n    return null;\n  }\n"
        "  void go(int i) { /* } */ System.out.println(\"}\"); }\n  interface I { void x(); }\n}\n",
        {("A", "inherits", "B"), ("A", "implements", "C"), ("A", "method", ".run()"), ("A", "method", ".go()"), (".run()", "calls", ".go()"), ("A", "contains", "I"), ("A.java", "imports_from", "java.util.List")},
    ),
    "a.go": (
        'package p\nimport (\n  "fmt"\n)\ntype S struct {\n  a int\n}\nfunc (s *S) Run(x int) error {\n  go helper(x)\n  return s.other()\n}\nfunc (s S) other() error { return nil }\nfunc helper(x int) { fmt.Println(x) }\n',
        {("S", "method", ".Run()"), ("S", "method", ".other()"), (".Run()", "calls", "helper()"), (".Run()", "calls", ".other()"), ("a.go", "imports_from", "fmt"), ("a.go", "contains", "helper()")},
    ),
    "A.cs": (
        "using System.IO;\nnamespace N {\n  public class A : B, IC {\n    public int X { get; set; }\n    public A(int x) : base(x) { Go(); }\n    public void Go() { if (true) { Run(1); } }\n    static int Run(int i) => i + 1;\n  }\n}\n",
        {("N", "contains", "A"), ("A", "inherits", "B"), ("A", "inherits", "IC"), ("A", "method", ".Go()"), (".A()", "calls", ".Go()"), (".Go()", "calls", ".Run()"), ("A.cs", "imports_from", "System.IO")},
    ),
    "a.rs": (
        "use std::io;\npub struct S { a: i32 }\nimpl<'a> Show for S {\n  fn show(&self) -> String { make(self) }\n}\nfn make(s: &S) -> String { String::new() }\n",
        {("S", "implements", "Show"), ("S", "method", ".show()"), (".show()", "calls", "make()"), ("a.rs", "imports_from", "std::io")},
    ),
    "a.cpp": (
        "#include <x.h>\nclass A : public B {\npublic:\n  int f(int x) const { return g(x); }\n  void h();\n};\nvoid A::h() { f(1); }\nint g(int x) { return x; }\n",
        {("A", "inherits", "B"), ("A", "method", ".f()"), ("A", "method", ".h()"), (".f()", "calls", "g()"), (".h()", "calls", ".f()"), ("a.cpp", "imports_from", "x.h")},
    ),
    "a.php": (
        "<?php\nuse App\\Base;\nclass A extends Base implements I {\n  public function run($x) { # {\n    return $this->go($x);\n  }\n  private function go($x) { return helper($x); }\n}\nfunction helper($x) { return '}'; }\n",
        {("A", "inherits", "Base"), ("A", "implements", "I"), ("A", "method", ".run()"), (".run()", "calls", ".go()"), (".go()", "calls", "helper()")},
    ),
    "a.swift": ("import Foundation\nclass A: B {\n  func run() { go() }\n  func go() {}\n}\nfunc top(x: Int) -> Int { return x }\n", {("A", "inherits", "B"), ("A", "method", ".run()"), (".run()", "calls", ".go()"), ("a.swift", "contains", "top()")}),
    "a.kt": ("import a.b.C\nclass A : B(), I {\n  fun run(x: Int): Int { return go(x) }\n  fun go(x: Int) = x\n}\n", {("A", "inherits", "B"), ("A", "inherits", "I"), ("A", "method", ".run()"), (".run()", "calls", ".go()")}),
}


def edges_by_label(fragment):
    label = {r[1]: r[2] for r in fragment.rows if r[0] == "node"}
    return {(label[r[1]], r[3], label.get(r[4], r[4])) for r in fragment.rows if r[0] == "edge"}


@pytest.mark.parametrize("path", SAMPLES)
def test_samples(path):
    text, want = SAMPLES[path]
    got = edges_by_label(X.extractor_for(path, text)(path, text))
    assert want <= got
    assert {e for e in got if e[1] == "calls"} == {e for e in want if e[1] == "calls"}


def test_broken_empty_and_long_texts():
    for text in ("", "}}}} {{{{ class", "class A { void f( {", "function (", "'" * 999, "f(" * 2000, "a<" * 3000):
        assert extract_braces("a.java", text).rows
    began = time.time()
    extract_braces("a.js", "".join(f"function f{i}(a,b){{return g{i}(a,[{','.join(map(str, range(40)))}])?b:c}};" for i in range(3000)))
    assert time.time() - began < 20


def test_cloudformation_and_argocd():
    yaml = "AWSTemplateFormatVersion: '2010-09-09'\nParameters:\n  Env:\n    Type: String\nResources:\n  Queue:\n    Type: AWS::SQS::Queue\n  Fn:\n    Type: AWS::Lambda::Function\n    DependsOn: Queue\n    Properties:\n      Name: !Sub 'x-${Env}'\n      Target: !GetAtt Queue.Arn\n"
    got = edges_by_label(X.extractor_for("s.yaml", yaml)("s.yaml", yaml))
    assert {("AWS::Lambda::Function:Fn", "depends_on", "AWS::SQS::Queue:Queue"), ("AWS::Lambda::Function:Fn", "references", "AWS::SQS::Queue:Queue"), ("s.yaml", "contains", "String:Env")} <= got
    text = '{"Resources": {"A": {"Type": "AWS::S3::Bucket"}, "B": {"Type": "AWS::X::Y", "Properties": {"P": {"Ref": "A"}, "Q": {"Fn::GetAtt": ["A", "Arn"]}}}}}'
    assert ("AWS::X::Y:B", "references", "AWS::S3::Bucket:A") in edges_by_label(X.extractor_for("s.json", text)("s.json", text))
    argo = "apiVersion: argoproj.io/v1alpha1\nkind: Application\nmetadata:\n  name: shop\nspec:\n  project: web\n  source:\n    repoURL: https://x/y.git\n    path: deploy\n  destination:\n    server: https://k\n    namespace: prod\n"
    assert {r[1:] for r in edges_by_label(X.extractor_for("a.yaml", argo)("a.yaml", argo)) if r[0] == "Application:shop"} >= {("deploys_from", "Repo:https://x/y.git"), ("deploys_to", "Cluster:https://k/prod"), ("belongs_to", "argo AppProject web")}
