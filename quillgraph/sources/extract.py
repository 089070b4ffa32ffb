"""Extractors: from the text of a file to node and edge rows. Each is a function of (path, text); one pass over the files runs them all."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quillgraph.operators.build import Graph
from quillgraph.sources.braces import ENDINGS, extract_braces
from quillgraph.sources.fragment import Fragment
from quillgraph.sources.fragment import key_of as _key
from quillgraph.sources.yaml_lite import documents

Row = tuple[str, str, str, str, str, str, str]
FRAGMENT = "part string, id string, label string, kind string, target string, location string, source_file string"


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def extract_python(path: str, text: str) -> Fragment:
    """Functions, classes, methods, imports, bases, decorators and calls of Python source."""
    out = Fragment(path)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return out
    names: dict[str, str] = {}

    def visit(body: list, owner: str, prefix: str, inside: bool) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(n, ast.ClassDef)
                key = _key(prefix, n.name)
                label = n.name if is_class else f".{n.name}()" if inside else f"{n.name}()"
                out.node(key, label, "class" if is_class else "method" if inside else "function", n.lineno)
                out.edge(owner, key, "method" if inside and not is_class else "contains", n.lineno)
                names.setdefault(n.name, key)
                for d in n.decorator_list:
                    out.edge(key, out.stub(ast.unparse(d).split("(")[0]), "references", n.lineno)
                if is_class:
                    for b in n.bases:
                        out.edge(key, out.stub(ast.unparse(b).split("[")[0]), "inherits", n.lineno)
                doc = ast.get_docstring(n)
                if doc:
                    out.edge(out.node(key + "_rationale", doc.split("\n")[0], "rationale", n.lineno), key, "rationale_for", n.lineno)
                visit(n.body, key, f"{prefix}_{n.name}", is_class)

    visit(tree.body, out.file, path, False)
    owners = [(n, k) for n, k in ((n, names.get(n.name)) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))) if k]
    for n, key in owners:
        for c in ast.walk(n):
            if isinstance(c, ast.Call):
                f = c.func
                called = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if called in names:
                    out.edge(key, names[called], "calls", c.lineno)
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                out.edge(out.file, out.stub(a.name, "module"), "imports", n.lineno)
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                out.edge(out.file, out.stub(f"{'.' * n.level}{n.module or ''}.{a.name}", "module"), "imports_from", n.lineno)
    return out


_NAME = r"[\"`\[]?([A-Za-z_][\w$]*(?:[\"`\]]?\.[\"`\[]?[A-Za-z_][\w$]*)?)[\"`\]]?"


def extract_sql(path: str, text: str) -> Fragment:
    """Tables, views, routines, triggers and indexes of SQL; foreign keys, and what views and routines read, their own CTEs left out."""
    out = Fragment(path)
    plain = re.sub(r"--[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    clean = lambda n: re.sub(r"[\"`\[\]]", "", n)
    for m in re.finditer(rf"\bcreate\s+(?:or\s+replace\s+)?(?:global\s+|temp(?:orary)?\s+|unique\s+|materialized\s+)*(table|view|function|procedure|trigger|index)\s+(?:if\s+not\s+exists\s+)?{_NAME}(.*?)(?=;|\bcreate\s+(?:or\s+replace\s+)?(?:table|view|function|procedure|trigger)\b|\Z)", plain, re.I | re.S):
        kind, name, body, line = m[1].lower(), clean(m[2]), m[3], _line(plain, m.start())
        key = out.node(_key(name), name, kind, line)
        out.edge(out.file, key, "contains", line)
        if kind == "table":
            for r in re.finditer(rf"\breferences\s+{_NAME}", body, re.I):
                out.edge(key, out.stub(clean(r[1]), "table"), "references", line)
        elif kind in ("view", "function", "procedure"):
            ctes = {c.lower() for c in re.findall(r"(?:\bwith\s+(?:recursive\s+)?|,\s*)([A-Za-z_]\w*)\s+as\s*(?:materialized\s*)?\(", body, re.I)}
            for r in re.finditer(rf"\b(?:from|join)\s+{_NAME}", body, re.I):
                if clean(r[1]).lower() not in ctes | {"select", "lateral", "unnest"}:
                    out.edge(key, out.stub(clean(r[1]), "table"), "reads_from", line)
        else:
            on = re.search(rf"\bon\s+{_NAME}", body, re.I)
            if on:
                out.edge(key, out.stub(clean(on[1]), "table"), "triggers" if kind == "trigger" else "indexes", line)
    for m in re.finditer(rf"\balter\s+table\s+(?:only\s+)?{_NAME}[^;]*?\breferences\s+{_NAME}", plain, re.I | re.S):
        out.edge(out.stub(clean(m[1]), "table"), out.stub(clean(m[2]), "table"), "references", _line(plain, m.start()))
    return out


def extract_markdown(path: str, text: str) -> Fragment:
    """Headings in their hierarchy, links to other documents, tags and code spans."""
    out = Fragment(path)
    body = text
    front = re.match(r"\A---\n(.*?)\n---\n", text, re.S)
    if front:
        body = text[front.end() :]
        for m in re.finditer(r"(?m)^tags?:\s*(.+)$", front[1]):
            for tag in re.findall(r"[\w/-]*[A-Za-z][\w/-]*", m[1]):
                out.edge(out.file, out.stub("Tag:" + tag.lower(), "tag"), "tagged_as")
    shift = text.count("\n", 0, len(text) - len(body))
    stack: list[tuple[int, str]] = [(0, out.file)]
    fenced = False
    for i, line in enumerate(body.split("\n"), shift + 1):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
        m = None if fenced else re.match(r"(#{1,6})\s+(.+)", line)
        if m:
            level, title = len(m[1]), m[2].strip()
            while stack[-1][0] >= level:
                stack.pop()
            key = _key(path, title)
            key = f"{key}_{i}" if ("n", key) in out.seen else key
            out.node(key, title, "heading", i)
            out.edge(stack[-1][1], key, "contains", i)
            stack.append((level, key))
        elif not fenced:
            for span in re.findall(r"`([A-Za-z_][\w.]*(?:\(\))?)`", line):
                out.edge(stack[-1][1], out.stub(span), "references", i)
            for target in re.findall(r"\[[^\]]*\]\(([^)\s]+)", line) + re.findall(r"\[\[([^\]|]+)", line):
                name = re.sub(r"[#?].*$", "", target)
                if name and not re.match(r"[a-zA-Z][\w+.-]*:", target):
                    name = name if re.search(r"\.\w+$", name) else name + ".md"
                    if re.search(r"\.(md|mdx|qmd|rst|txt)$", name, re.I):
                        out.edge(out.file, out.stub(name, "file"), "references_heading" if target.find("#") > 0 else "references", i)
            for tag in re.findall(r"(?:^|\s)#([A-Za-z][\w/-]*)", line):
                if not re.fullmatch(r"[0-9a-fA-F]{3}|[0-9a-fA-F]{6}", tag):
                    out.edge(out.file, out.stub("Tag:" + tag.lower(), "tag"), "tagged_as", i)
    return out


def extract_json(path: str, text: str) -> Fragment:
    """Keys of a configuration in their hierarchy; dependencies and what it extends. Data in JSON is left out."""
    out = Fragment(path)
    try:
        data = json.loads(text)
    except (ValueError, RecursionError):
        return out
    name = path.rsplit("/", 1)[-1].lower()
    known = name in ("package.json", "tsconfig.json", "composer.json") or re.search(r"config|rc\.json$|settings", name)
    if not isinstance(data, dict) or not (known or {"dependencies", "scripts", "compilerOptions", "extends", "plugins"} & set(data)):
        return out

    def walk(value: object, owner: str, prefix: str) -> None:
        for k, v in value.items() if isinstance(value, dict) else ():
            key = out.node(_key(path, prefix, k), k, "key")
            out.edge(owner, key, "contains")
            if k == "extends":
                for target in v if isinstance(v, list) else [v]:
                    out.edge(out.file, out.stub(str(target)), "extends")
            elif k.lower().endswith("dependencies") and isinstance(v, dict):
                for package in v:
                    out.edge(key, out.stub(package, "package"), "imports")
            else:
                walk(v, key, f"{prefix}_{k}")

    walk(data, out.file, "")
    return out


def extract_avro(path: str, text: str) -> Fragment:
    """Records and fields of an Avro schema."""
    out = Fragment(path)
    try:
        data = json.loads(text)
    except ValueError:
        return out

    def record(s: object, owner: str) -> None:
        if isinstance(s, list):
            for x in s:
                record(x, owner)
        elif isinstance(s, dict) and s.get("type") in ("record", "enum") and s.get("name"):
            key = out.node(_key(s.get("namespace", ""), s["name"]), s["name"], s["type"])
            out.edge(owner, key, "contains")
            for f in s.get("fields", []):
                field = out.node(_key(s["name"], f.get("name", "")), f.get("name", ""), "field")
                out.edge(key, field, "contains")
                record(f.get("type"), field)
        elif isinstance(s, dict):
            record(s.get("items") or s.get("values") or s.get("type") if not isinstance(s.get("type"), str) or s.get("type") in ("array", "map") else None, owner)

    record(data, out.file)
    return out


def extract_json_schema(path: str, text: str) -> Fragment:
    """Definitions and properties of a JSON schema, and its references."""
    out = Fragment(path)
    try:
        data = json.loads(text)
    except ValueError:
        return out

    def walk(s: object, owner: str, prefix: str) -> None:
        if not isinstance(s, dict):
            return
        if isinstance(s.get("$ref"), str):
            target = s["$ref"]
            out.edge(owner, _key(path, target.rsplit("/", 1)[-1]) if target.startswith("#") else out.stub(target), "references_schema")
        for group in ("definitions", "$defs", "properties"):
            for k, v in (s.get(group) or {}).items() if isinstance(s.get(group), dict) else ():
                key = out.node(_key(path, k) if group != "properties" else _key(path, prefix, k), k, "property" if group == "properties" else "schema")
                out.edge(owner, key, "contains" if group == "properties" else "defines_schema")
                walk(v, key, f"{prefix}_{k}")
        for k in ("items", "additionalProperties"):
            walk(s.get(k), owner, prefix)
        for k in ("allOf", "anyOf", "oneOf"):
            for v in s.get(k) or ():
                walk(v, owner, prefix)

    walk(data, out.file, "")
    return out


def extract_dockerfile(path: str, text: str) -> Fragment:
    """Stages, base images, copies between stages and variables of a container build."""
    out = Fragment(path)
    stage, stages = out.file, {}
    for i, line in enumerate(re.sub(r"\\\n", " ", text).split("\n"), 1):
        m = re.match(r"\s*(FROM|COPY|ENV|ARG)\s+(.*)", line, re.I)
        if not m:
            continue
        word, rest = m[1].upper(), m[2].strip()
        if word == "FROM":
            parts = re.match(r"(?:--\S+\s+)*(\S+)(?:\s+AS\s+(\S+))?", rest, re.I)
            name = parts[2] or f"stage{len(stages)}"
            stage = out.node(_key(path, "stage", name), name, "stage", i)
            out.edge(out.file, stage, "has_stage", i)
            out.edge(stage, stages.get(parts[1].lower()) or out.stub("Image:" + parts[1], "image"), "from_image", i)
            stages[name.lower()] = stage
        elif word == "COPY" and (f := re.search(r"--from=(\S+)", rest)):
            out.edge(stage, stages.get(f[1].lower()) or out.stub("Image:" + f[1], "image"), "depends_on", i)
        elif word in ("ENV", "ARG"):
            for name in re.findall(r"([A-Za-z_]\w*)=", rest) or rest.split()[:1]:
                out.edge(stage, out.node(_key(path, "env", name), name, "env", i), "contains", i)
    return out


def extract_html(path: str, text: str) -> Fragment:
    """Links of a page, once each."""
    out = Fragment(path)
    for m in re.finditer(r"<a\b[^>]*\bhref\s*=\s*[\"']([^\"'#]+)", text, re.I):
        out.edge(out.file, out.stub(m[1], "url"), "references", _line(text, m.start()))
    return out


def extract_manifest(path: str, text: str) -> Fragment:
    """The package of a manifest and what it depends on: pyproject, Cargo, go.mod, package.json, pom.xml, requirements, lock files."""
    import tomllib

    out = Fragment(path)
    name = path.rsplit("/", 1)[-1].lower()
    package, deps = None, []
    try:
        if name in ("pyproject.toml", "cargo.toml", "poetry.lock"):
            data = tomllib.loads(text)
            project = data.get("project") or data.get("package") or data.get("tool", {}).get("poetry", {})
            if isinstance(project, dict):
                package = project.get("name")
                deps += [re.split(r"[\s<>=!~;\[(]", d)[0] for d in project.get("dependencies", []) if isinstance(d, str)] if isinstance(project.get("dependencies"), list) else []
            for table in (data.get("dependencies"), data.get("dev-dependencies"), data.get("tool", {}).get("poetry", {}).get("dependencies")):
                deps += list(table or {})
            if name == "poetry.lock":
                deps += [p["name"] for p in data.get("package", []) if "name" in p]
        elif name == "package.json":
            data = json.loads(text)
            package = data.get("name")
            deps = [d for k in ("dependencies", "devDependencies", "peerDependencies") for d in data.get(k) or {}]
        elif name == "go.mod":
            package = (re.search(r"(?m)^module\s+(\S+)", text) or [None, None])[1]
            deps = re.findall(r"(?m)^(?:require\s+|\t|\s{2,})([\w./-]+\.[\w./-]+)\s+v", text)
        elif name == "pom.xml":
            bare = re.sub(r"<dependenc(?:y|ies)>.*</dependenc(?:y|ies)>", "", text, flags=re.S)
            package = (re.search(r"<artifactId>([^<]+)", bare) or [None, None])[1]
            deps = re.findall(r"<dependency>.*?<artifactId>([^<]+)", text, re.S)
        elif name.startswith("requirements"):
            deps = [m for m in re.findall(r"(?m)^\s*([A-Za-z0-9][\w.-]*)", text)]
    except (ValueError, TypeError, AttributeError):
        return out
    owner = out.node(_key("package", package), package, "package") if package else out.file
    if package:
        out.edge(out.file, owner, "defines")
    for d in deps:
        if d and d != "python":
            out.edge(owner, out.stub(d, "package"), "depends_on")
    return out


def extract_protobuf(path: str, text: str) -> Fragment:
    """Messages, enums, services and their calls of an interface definition."""
    out = Fragment(path)
    plain = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    for m in re.finditer(r"\b(message|enum|service)\s+(\w+)", plain):
        out.edge(out.file, out.node(_key(m[2]), m[2], m[1], _line(plain, m.start())), "contains", _line(plain, m.start()))
    for s in re.finditer(r"\bservice\s+(\w+)\s*\{(.*?)\n\}", plain, re.S):
        for r in re.finditer(r"\brpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)", s[2]):
            rpc = out.node(_key(s[1], r[1]), f"rpc:{r[1]}", "rpc", _line(plain, s.start(2) + r.start()))
            out.edge(_key(s[1]), rpc, "defines_rpc")
            out.edge(rpc, out.stub(r[2].rsplit(".", 1)[-1], "message"), "accepts")
            out.edge(rpc, out.stub(r[3].rsplit(".", 1)[-1], "message"), "returns")
    return out


def extract_terraform(path: str, text: str) -> Fragment:
    """Blocks of infrastructure code and what they refer to."""
    out = Fragment(path)
    blocks = list(re.finditer(r'(?m)^\s*(resource|data|module|variable|output|provider|locals)\s*((?:"[^"]+"\s*)*)\{', text))
    known = {}
    for b in blocks:
        names = re.findall(r'"([^"]+)"', b[2])
        address = ".".join(names if b[1] == "resource" else [{"variable": "var"}.get(b[1], b[1]), *names])
        known[address] = out.node(_key(path, address), address, b[1], _line(text, b.start()))
        out.edge(out.file, known[address], "contains", _line(text, b.start()))
    for b, after in zip(blocks, [*blocks[1:], None]):
        names = re.findall(r'"([^"]+)"', b[2])
        own = ".".join(names if b[1] == "resource" else [{"variable": "var"}.get(b[1], b[1]), *names])
        body = text[b.end() : after.start() if after else len(text)]
        for address, key in known.items():
            if address != own and re.search(rf"(?<![\w.]){re.escape(address)}(?![\w-])", body):
                out.edge(known[own], key, "depends_on")
    return out


def extract_shell(path: str, text: str) -> Fragment:
    """Functions, sourced files and calls of shell scripts."""
    out = Fragment(path)
    functions = {m[1]: _line(text, m.start()) for m in re.finditer(r"(?m)^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{", text)}
    for name, line in functions.items():
        out.edge(out.file, out.node(_key(path, name), f"{name}()", "function", line), "contains", line)
    for m in re.finditer(r"(?m)^\s*(?:source|\.)\s+[\"']?([^\s\"';]+)", text):
        out.edge(out.file, out.stub(m[1], "file"), "imports_from", _line(text, m.start()))
    starts = sorted((line, name) for name, line in functions.items())
    for i, line in enumerate(text.split("\n"), 1):
        word = re.match(r"\s*([A-Za-z_][\w-]*)(?!\s*\(\))\b", line)
        owner = next((n for s, n in reversed(starts) if s < i), None)
        if word and word[1] in functions and owner != word[1]:
            out.edge(_key(path, owner) if owner else out.file, _key(path, word[1]), "calls", i)
    return out


def _dict(x: object) -> dict:
    return x if isinstance(x, dict) else {}


def _list(x: object) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def extract_compose(path: str, text: str) -> Fragment:
    """Services of a container composition: images, builds, dependencies, networks, volumes, secrets."""
    out = Fragment(path)
    for doc in documents(text):
        for name, s in _dict(_dict(doc).get("services")).items():
            s = _dict(s)
            key = out.node(_key("service", name), name, "service")
            out.edge(out.file, key, "defines")
            if s.get("image"):
                out.edge(key, out.stub(f"Image:{s['image']}", "image"), "uses_image")
            if s.get("build"):
                out.edge(key, out.stub(f"Build:{s['build'] if isinstance(s['build'], str) else _dict(s['build']).get('context', '.')}", "build"), "builds_with")
            for relation, kind, names in (("depends_on", "service", s.get("depends_on")), ("connects_to", "network", s.get("networks")), ("references_secret", "secret", s.get("secrets"))):
                for n in names if isinstance(names, dict) else _list(names):
                    out.edge(key, out.stub(f"{kind} {n if isinstance(n, str) else _dict(n).get('source', '')}", kind), relation)
            for v in _list(s.get("volumes")):
                out.edge(key, out.stub(f"volume {str(v if isinstance(v, str) else _dict(v).get('source', '')).split(':')[0]}", "volume"), "mounts")
    return out


def extract_workflow(path: str, text: str) -> Fragment:
    """Jobs and steps of a build workflow: triggers, needs, actions with their pins, secrets."""
    out = Fragment(path)
    for doc in documents(text):
        doc = _dict(doc)
        flow = out.node(_key(path, "workflow"), str(doc.get("name") or path.rsplit("/", 1)[-1]), "workflow")
        out.edge(out.file, flow, "defines")
        on = doc.get("on", doc.get("True"))
        for t in on if isinstance(on, dict) else _list(on):
            out.edge(flow, out.stub(f"Trigger:{t}", "trigger"), "triggered_by")
        for name, job in _dict(doc.get("jobs")).items():
            job = _dict(job)
            key = out.node(_key(path, "job", name), name, "job")
            out.edge(flow, key, "defines")
            for need in _list(job.get("needs")):
                out.edge(key, _key(path, "job", str(need)), "depends_on")
            if isinstance(job.get("uses"), str):
                out.edge(key, out.stub(f"Workflow:{job['uses']}", "workflow"), "calls_workflow")
            for i, step in enumerate(_list(job.get("steps"))):
                step = _dict(step)
                s = out.node(_key(path, name, "step", str(i)), str(step.get("name") or step.get("uses") or f"step {i}"), "step")
                out.edge(key, s, "has_step")
                if isinstance(step.get("uses"), str):
                    out.edge(s, out.stub(f"Action:{step['uses']}", "action"), "uses_action")
    for secret in set(re.findall(r"secrets\.([A-Za-z_]\w*)", text)):
        out.edge(out.file, out.stub(f"secret {secret}", "secret"), "references_secret")
    return out


def extract_kubernetes(path: str, text: str) -> Fragment:
    """Resources: what they select, the images they run, the configuration and secrets they mount, where routes lead."""
    out = Fragment(path)
    for doc in documents(text):
        doc = _dict(doc)
        kind, meta = doc.get("kind"), _dict(doc.get("metadata"))
        if not kind or not meta.get("name"):
            continue
        key = out.node(_key("k8s", str(kind), str(meta["name"])), f"K8s:{kind}:{meta['name']}", "resource")
        out.edge(out.file, key, "contains")

        def walk(x: object) -> None:
            if isinstance(x, list):
                for y in x:
                    walk(y)
            elif isinstance(x, dict):
                for k, v in x.items():
                    if k == "image" and isinstance(v, str):
                        out.edge(key, out.stub(f"Image:{v}", "image"), "uses_image")  # noqa: B023
                    elif k in ("secretName", "configMapName") and isinstance(v, str):
                        out.edge(key, out.stub(f"k8s {'Secret' if k == 'secretName' else 'ConfigMap'} {v}", "resource"), "mounts")  # noqa: B023
                    elif k in ("secretKeyRef", "configMapKeyRef", "secretRef", "configMapRef") and _dict(v).get("name"):
                        out.edge(key, out.stub(f"k8s {'Secret' if k.startswith('secret') else 'ConfigMap'} {v['name']}", "resource"), "references_secret" if k.startswith("secret") else "references_env")  # noqa: B023
                    elif k == "service" and _dict(v).get("name"):
                        out.edge(key, out.stub(f"k8s Service {v['name']}", "resource"), "routes_to")  # noqa: B023
                    walk(v)

        spec = _dict(doc.get("spec"))
        walk(spec)
        if kind == "Service":
            for k, v in _dict(spec.get("selector")).items():
                out.edge(key, out.stub(f"label {k}={v}", "label"), "selects")
        if kind == "Application":
            for source in _list(spec.get("source")) + _list(spec.get("sources")):
                out.edge(key, out.stub(f"Source:{_dict(source).get('repoURL', '')}/{_dict(source).get('path', '')}", "source"), "syncs_from")
            out.edge(key, out.stub(f"Namespace:{_dict(spec.get('destination')).get('namespace', '')}", "namespace"), "deploys_to")
        for k, v in _dict(_dict(_dict(spec.get("template")).get("metadata")).get("labels")).items():
            out.edge(out.stub(f"label {k}={v}", "label"), key, "owns")
    return out


def extract_chart(path: str, text: str) -> Fragment:
    """A chart and what it depends on."""
    out = Fragment(path)
    for doc in documents(text):
        doc = _dict(doc)
        if doc.get("name"):
            key = out.node(_key("chart", str(doc["name"])), f"Helm:Chart:{doc['name']}", "chart")
            out.edge(out.file, key, "defines")
            for d in _list(doc.get("dependencies")):
                out.edge(key, out.stub(f"chart {_dict(d).get('name', '')}", "chart"), "depends_on")
    return out


def extract_cloudformation(path: str, text: str) -> Fragment:
    """Resources and parameters of a stack template, and what each resource depends on or refers to."""
    out = Fragment(path)
    try:
        docs = [json.loads(text)] if text.lstrip().startswith("{") else list(documents(text))
    except ValueError:
        return out
    for doc in map(_dict, docs):
        known = {}
        for section, kind in (("Parameters", "parameter"), ("Resources", "resource")):
            for name, body in _dict(doc.get(section)).items():
                label = f"{_dict(body).get('Type', 'Parameter')}:{name}"
                known[str(name)] = out.node(_key(path, str(name)), label, kind)
                out.edge(out.file, known[str(name)], "contains")

        def refer(key: str, x: object, relation: str) -> None:
            if isinstance(x, dict):
                for k, v in x.items():
                    refer(key, f"!Ref {v}" if k == "Ref" else f"!GetAtt {v[0] if isinstance(v, list) and v else v}" if k == "Fn::GetAtt" else v, relation)
            elif isinstance(x, list):
                for y in x:
                    refer(key, y, relation)
            elif isinstance(x, str):
                # Tags may be gone once the file is read; a value that is just the name of a resource refers to it.
                for name in re.findall(r"^(?:!(?:Ref|GetAtt)\s+)?([\w-]+)(?:\.\w+)*$|\$\{([\w-]+)", x):
                    target = known.get(name[0] or name[1])  # noqa: B023
                    if target and target != key:
                        out.edge(key, target, relation)

        for name, body in _dict(doc.get("Resources")).items():
            body = _dict(body)
            after = body.get("DependsOn")
            for target in after if isinstance(after, list) else [after]:
                if str(target) in known:
                    out.edge(known[str(name)], known[str(target)], "depends_on")
            refer(known[str(name)], body.get("Properties"), "references")
    return out


def extract_argocd(path: str, text: str) -> Fragment:
    """Applications, sets and projects: the repositories and paths they deploy from, where to, and their project."""
    out = Fragment(path)
    for doc in map(_dict, documents(text)):
        meta, spec = _dict(doc.get("metadata")), _dict(doc.get("spec"))
        if not str(doc.get("apiVersion", "")).startswith("argoproj.io/") or not meta.get("name"):
            continue
        key = out.node(_key("argo", str(doc.get("kind")), str(meta["name"])), f"{doc.get('kind')}:{meta['name']}", "resource")
        out.edge(out.file, key, "contains")
        spec = _dict(_dict(spec.get("template")).get("spec")) or spec
        sources = spec.get("sources") if isinstance(spec.get("sources"), list) else [spec.get("source")]
        for source in map(_dict, sources):
            if source.get("repoURL"):
                out.edge(key, out.stub(f"Repo:{source['repoURL']}", "repository"), "deploys_from")
            if source.get("path"):
                out.edge(key, out.stub(str(source["path"])), "references")
        to = _dict(spec.get("destination"))
        if to.get("namespace") or to.get("server") or to.get("name"):
            out.edge(key, out.stub(f"Cluster:{to.get('server') or to.get('name') or ''}/{to.get('namespace') or ''}", "cluster"), "deploys_to")
        if spec.get("project"):
            out.edge(key, out.stub(f"argo AppProject {spec['project']}", "resource"), "belongs_to")
    return out


def extract_yaml(path: str, text: str) -> Fragment:
    """By what the file is: workflow, composition, chart, resources; other YAML gives its file only."""
    name = path.rsplit("/", 1)[-1].lower()
    if "/.github/workflows/" in "/" + path:
        return extract_workflow(path, text)
    if re.search(r"(^|-)compose", name) or re.search(r"(?m)^services:\s*$", text):
        return extract_compose(path, text)
    if name == "chart.yaml":
        return extract_chart(path, text)
    if re.search(r"(?m)^AWSTemplateFormatVersion:|^\s+Type:\s*[\"']?AWS::", text):
        return extract_cloudformation(path, text)
    if re.search(r"(?m)^apiVersion:\s*argoproj\.io/.*$", text):
        return extract_argocd(path, text)
    if re.search(r"(?m)^apiVersion:", text) and re.search(r"(?m)^kind:", text):
        return extract_kubernetes(path, text)
    return Fragment(path)


def extract_bazel(path: str, text: str) -> Fragment:
    """Targets of a build file, their dependencies and sources, and what it loads."""
    out = Fragment(path)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return out
    package = path.rsplit("/", 1)[0] if "/" in path else ""
    for n in tree.body:
        call = n.value if isinstance(n, ast.Expr) and isinstance(n.value, ast.Call) and isinstance(n.value.func, ast.Name) else None
        if call is None:
            continue
        strings = lambda x: [e.value for e in ast.walk(x) if isinstance(e, ast.Constant) and isinstance(e.value, str)]
        args = {k.arg: k.value for k in call.keywords if k.arg}
        if call.func.id == "load" and call.args:
            out.edge(out.file, out.stub(strings(call.args[0])[0] if strings(call.args[0]) else "load"), "loads", n.lineno)
        elif "name" in args and strings(args["name"]):
            name = strings(args["name"])[0]
            key = out.node(_key(package, name), name, call.func.id, n.lineno)
            out.edge(out.file, key, "declares_external_repo" if call.func.id.endswith(("repository", "http_archive", "bazel_dep")) else "defines_target", n.lineno)
            for d in strings(args["deps"]) if "deps" in args else ():
                out.edge(key, _key(package, d[1:]) if d.startswith(":") else out.stub(d, "target"), "depends_on", n.lineno)
            for s in strings(args["srcs"]) if "srcs" in args else ():
                out.edge(key, out.stub(f"{package}/{s}".lstrip("/"), "file"), "contains_source", n.lineno)
    return out


def extract_project(path: str, text: str) -> Fragment:
    """Projects of a solution, and package and project references of a project file."""
    out = Fragment(path)
    for m in re.finditer(r'^Project\("[^"]*"\)\s*=\s*"([^"]+)",\s*"([^"]+)"', text, re.M):
        out.edge(out.file, out.node(_key("project", m[1]), m[1], "project", _line(text, m.start())), "contains")
    for m in re.finditer(r'<(ProjectReference|PackageReference|Reference|Project)\s+(?:Path|Include)="([^"]+)"', text):
        name = re.split(r"[\\/]", m[2])[-1].removesuffix(".csproj").removesuffix(".fsproj").removesuffix(".vbproj") if m[1].startswith("Project") else m[2].split(",")[0]
        out.edge(out.file, out.stub(name, "package" if m[1] != "Project" else "project"), "contains" if m[1] == "Project" else "imports" if m[1] == "ProjectReference" else "references", _line(text, m.start()))
    return out


def extract_markup(path: str, text: str) -> Fragment:
    """Classes, named elements, components and bindings of view files (XAML, Razor, Blade, single-file components)."""
    out = Fragment(path)
    for pattern, kind, relation in (
        (r'x:Class="([^"]+)"', "class", "defines"), (r'x:Name="([^"]+)"', "element", "contains"), (r"\{Binding\s+(?:Path=)?([\w.]+)", "property", "references"),
        (r"@(?:model|inherits|inject)\s+([\w.<>]+)", "class", "references"), (r"@using\s+([\w.]+)", "module", "imports"),
        (r"@(?:include|extends|component)\(\s*['\"]([^'\"]+)", "view", "includes"), (r"<x-([\w.-]+)", "component", "uses_component"), (r"wire:\w+=\"(\w+)", "method", "binds_method"),
        (r"\bfrom\s+['\"]([^'\"]+)['\"]", "module", "imports_from"), (r"<([A-Z]\w+)", "component", "references"),
    ):
        for m in re.finditer(pattern, text):
            out.edge(out.file, out.stub(m[1], kind), relation, _line(text, m.start()))
    return out


def extract_properties(path: str, text: str) -> Fragment:
    """Topics, brokers and registries of a message client's or connector's properties."""
    out = Fragment(path)
    for m in re.finditer(r"(?m)^\s*([\w.-]+)\s*[=:]\s*(.+?)\s*$", text):
        key, line = m[1].lower(), _line(text, m.start())
        for value in m[2].split(","):
            if key.endswith("bootstrap.servers"):
                out.edge(out.file, out.stub(f"Broker:{value.strip()}", "broker"), "connects_to", line)
            elif key.endswith("schema.registry.url"):
                out.edge(out.file, out.stub(f"Registry:{value.strip()}", "registry"), "configures_registry", line)
            elif re.search(r"(^|\.)topics?(\.name)?$", key):
                out.edge(out.file, out.stub(f"Topic:{value.strip()}", "topic"), "references_topic", line)
    return out


# Declarations and imports of languages whose grammar is not at hand: what a line shows. Calls are left to name resolution.
LINE_RULES = {
    "js": (("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts"), r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)|^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", r"\bfrom\s+[\"']([^\"']+)[\"']|\brequire\(\s*[\"']([^\"']+)|^\s*import\s+[\"']([^\"']+)", r"\bextends\s+([\w.]+)"),
    "go": (("go",), r"^type\s+(\w+)\s+(?:struct|interface)\b", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]", r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$", None),
    "rust": (("rs",), r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)", r"^\s*(?:pub\s+)?use\s+([\w:]+)", r"^\s*impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\b"),
    "java": (("java", "kt", "kts", "scala", "groovy", "cs"), r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|data|partial|case)\s+)*(?:class|interface|enum|record|object|trait|struct)\s+(\w+)", r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|override|async|suspend|virtual|open)\s+)+(?:fun\s+|def\s+)?(?:[\w<>\[\],.?]+\s+)?(\w+)\s*\([^;]*$|^\s*(?:fun|def)\s+(\w+)", r"^\s*(?:import|using)\s+(?:static\s+)?([\w.*]+)", r"\b(?:extends|implements)\s+([\w.]+)|\bclass\s+\w+\s*:\s*([\w.]+)"),
    "c": (("c", "h", "cc", "cpp", "cxx", "hpp", "m", "mm", "cu"), r"^\s*(?:typedef\s+)?(?:class|struct|enum|union)\s+(\w+)\s*[:{]|^@(?:interface|implementation|protocol)\s+(\w+)", r"^(?:[\w*&<>:,]+\s+)+\*?(\w+)\s*\([^;]*\)\s*(?:const\s*)?\{?\s*$", r"^\s*#\s*(?:include|import)\s+[<\"]([^>\"]+)", r"\bclass\s+\w+\s*:\s*(?:public|private|protected)?\s*([\w:]+)"),
    "ruby": (("rb", "rake"), r"^\s*(?:class|module)\s+([\w:]+)", r"^\s*def\s+(?:self\.)?([\w?!]+)", r"^\s*require(?:_relative)?\s+[\"']([^\"']+)", r"^\s*class\s+[\w:]+\s*<\s*([\w:]+)"),
    "php": (("php",), r"^\s*(?:abstract\s+|final\s+)*(?:class|interface|trait)\s+(\w+)", r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(\w+)", r"^\s*use\s+([\w\\]+)|\b(?:require|include)(?:_once)?\s*\(?\s*[\"']([^\"']+)", r"\b(?:extends|implements)\s+([\w\\]+)"),
    "swift": (("swift",), r"^\s*(?:(?:public|private|internal|open|final)\s+)*(?:class|struct|enum|protocol|actor)\s+(\w+)", r"^\s*(?:(?:public|private|internal|open|static|override|mutating)\s+)*func\s+(\w+)", r"^\s*import\s+(\w+)", r"\b(?:class|struct)\s+\w+\s*:\s*(\w+)"),
    "other": (("lua", "luau", "jl", "ex", "exs", "dart", "zig", "ps1", "psm1", "pas", "f90", "ml", "r"), r"^\s*(?:abstract\s+|mutable\s+)?(?:class|struct|defmodule|module|type)\s+([\w.]+)", r"^\s*(?:pub\s+|local\s+|export\s+)?(?:function|fn|def|defp|let\s+rec|let|subroutine|procedure)\s+([\w.:-]+)", r"^\s*(?:import|using|use|alias|open|Import-Module|require)\b\s*\(?[\"']?([\w./:-]+)", r"\bextends\s+(\w+)"),
}


def extract_lines(path: str, text: str) -> Fragment:
    """Types, functions, imports and supertypes of a source file by what its lines begin with."""
    out = Fragment(path)
    last = path.rsplit(".", 1)[-1].lower()
    rule = next((r for r in LINE_RULES.values() if last in r[0]), None)
    if rule is None:
        return out
    _, types, functions, imports, supers = rule
    for i, line in enumerate(text.split("\n"), 1):
        first = lambda pattern: next((g for g in m.groups() if g), None) if pattern and (m := re.search(pattern, line)) else None  # noqa: B023, E731
        if name := first(types):
            key = out.node(_key(path, name), name, "class", i)
            out.edge(out.file, key, "contains", i)
            if base := first(supers):
                out.edge(key, out.stub(base), "inherits", i)
        elif name := first(functions):
            if name not in ("if", "for", "while", "switch", "return", "catch", "else"):
                out.edge(out.file, out.node(_key(path, name), f"{name}()", "function", i), "contains", i)
        if target := first(imports):
            out.edge(out.file, out.stub(target, "module"), "imports_from", i)
    return out


Extractor = Callable[[str, str], Fragment]
BY_NAME: dict[str, Extractor] = {n: extract_manifest for n in ("pyproject.toml", "cargo.toml", "go.mod", "pom.xml", "package.json", "requirements.txt", "poetry.lock")}
BY_ENDING: dict[str, Extractor] = {
    "py": extract_python, "pyi": extract_python, "sql": extract_sql, "md": extract_markdown, "mdx": extract_markdown, "qmd": extract_markdown, "rst": extract_markdown,
    "json": extract_json, "avsc": extract_avro, "html": extract_html, "htm": extract_html, "proto": extract_protobuf, "tf": extract_terraform, "hcl": extract_terraform,
    "yaml": extract_yaml, "yml": extract_yaml, "bzl": extract_bazel, "bazel": extract_bazel, "sln": extract_project, "slnx": extract_project, "csproj": extract_project,
    "fsproj": extract_project, "vbproj": extract_project, "xaml": extract_markup, "razor": extract_markup, "cshtml": extract_markup, "vue": extract_markup, "svelte": extract_markup,
    "astro": extract_markup, "properties": extract_properties, "sh": extract_shell, "bash": extract_shell, **{e: extract_lines for r in LINE_RULES.values() for e in r[0]}, **{e: extract_braces for e in ENDINGS},
}


def extractor_for(path: str, text: str) -> Extractor | None:
    """By name, then content, then ending, then the first line."""
    name = path.rsplit("/", 1)[-1].lower()
    if name in BY_NAME:
        return BY_NAME[name]
    if name.startswith("dockerfile") or name.endswith(".dockerfile"):
        return extract_dockerfile
    last = name.rsplit(".", 1)[-1] if "." in name else ""
    if name in ("build", "workspace") or name.startswith("module.bazel"):
        return extract_bazel
    if name.endswith(".blade.php"):
        return extract_markup
    if last in ("json", "template") and ('"AWSTemplateFormatVersion"' in text or re.search(r'"Type"\s*:\s*"AWS::', text)):
        return extract_cloudformation
    if last == "json" and ('"$schema"' in text or '"openapi"' in text) and ('"properties"' in text or '"definitions"' in text or '"$defs"' in text):
        return extract_json_schema
    if last in BY_ENDING:
        return BY_ENDING[last]
    shebang = re.match(r"#!.*\b(python|bash|sh|zsh)", text)
    return {"python": extract_python}.get(shebang[1], extract_shell) if shebang else None


def extract(files: DataFrame, path: str = "path", text: str = "text") -> Graph:
    """Node and edge rows of files (path, text), each file parsed whole in one pass. Files without an extractor give nothing.

    Nodes are (id, label, file_type, node_kind, source_file, source_location, origin), edges (src, dst, relation,
    confidence, source_file, source_location).
    """
    from pyspark.sql import functions as F

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FRAGMENT.split(", ")]
        for batch in batches:
            rows: list[Row] = []
            for p, t in zip(batch[path], batch[text]):
                found = extractor_for(p, t or "") if p else None
                if found:
                    rows += found(p, t or "").rows
            yield pd.DataFrame(rows, columns=columns)

    rows = files.select(path, text).mapInPandas(run, FRAGMENT)
    kind = F.col("kind")
    file_type = F.when(kind == "rationale", "rationale").when(kind.isin("heading", "tag", "url"), "document").when(kind.isin("package", "image", "stub", "module"), "concept").otherwise("code")
    nodes = rows.where("part = 'node'").select("id", "label", file_type.alias("file_type"), kind.alias("node_kind"), "source_file", F.col("location").alias("source_location"), F.lit("ast").alias("origin"))
    edges = rows.where("part = 'edge'").select(F.col("id").alias("src"), F.col("target").alias("dst"), kind.alias("relation"), F.lit("EXTRACTED").alias("confidence"), "source_file", F.col("location").alias("source_location"))
    return Graph(nodes, edges)
