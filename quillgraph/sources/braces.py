"""Types, members, functions and calls of languages that nest in braces, read by their tokens rather than line by line."""

from __future__ import annotations

import re

from quillgraph.sources.fragment import Fragment, key_of

# Words that stand before a parenthesis and are no call or definition.
NOT_A_NAME = set(
    "if for foreach while switch catch return else elif do try finally using lock fixed sizeof typeof nameof await yield throw new delete in of instanceof is as when match guard defer select "
    "case function func fn fun def super this base self synchronized assert with unless until loop where".split()
)

NAME = r"[A-Za-z_$][\w$]*"
ARGS = r"\((?:[^(){};]++|\((?:[^(){};]++|\([^(){};]*+\))*+\))*+\)"
TYPES = rf"\b(?:class|interface|enum|record|struct|trait|protocol|actor|object|extension|union|namespace)\s+(?P<type>{NAME})(?P<supers>[^{{}};=()]*(?:\([^(){{}};]*\)[^{{}};=()]*)?)(?=\{{)"
GO_TYPES = rf"\btype\s+(?P<type>{NAME})(?:\[[^\]]*\])?\s+(?:struct|interface)\s*(?P<supers>)(?=\{{)"
IMPL = rf"\bimpl\b(?:<[^>{{]*>)?\s*(?:(?P<trait>[\w:]+)(?:<[^{{]*?>)?\s+for\s+)?(?P<impl>{NAME})[^{{;]*(?=\{{)"
BODY_NEXT = r"\s*(?:(?:const|noexcept|override|final|mutating|async|throws|rethrows)\b\s*[\w.,\s]*|(?:->|:)\s*[^{};=()]+(?:\([^(){};]*\)[^{};=()]*)*|where\s[^{};]+)*(?=\{|=>|=\s)"
KEYWORD_FUNCTION = rf"\b(?:function\s*\*?|func|fn|fun|def)\s+(?:\(\s*(?:\w+\s+)?\*?(?P<receiver>\w+)[^)]*\)\s*)?(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<function>{NAME})\s*(?:<[^<>()]*>|\[[^\]]*\])?\s*(?=\()"
ARROW = rf"\b(?:const|let|var)\s+(?P<arrow>{NAME})\s*(?::[^=;{{}}]+)?=\s*(?:async\s*)?(?:function\b|{ARGS}\s*(?::[^={{}};]+)?=>|{NAME}\s*=>)"
PLAIN_FUNCTION = rf"(?:\b(?P<owner>{NAME})::)?(?P<plain>~?\b{NAME})\s*(?:<[^<>(){{}};]*>)?\s*{ARGS}{BODY_NEXT}"
CALL = rf"\b(?P<call>{NAME})\s*(?:<[\w\s,.<>\[\]]*>)?\("
SKIP = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`"

# Language: endings, its definitions, whether name(...) { defines a function outside of types, and how it imports.
LANGUAGES = {
    "script": (("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts"), (TYPES, KEYWORD_FUNCTION, ARROW, PLAIN_FUNCTION), False, r"\bfrom\s+[\"']([^\"']+)[\"']|\brequire\(\s*[\"']([^\"']+)|^\s*import\s+[\"']([^\"']+)"),
    "java": (("java", "groovy", "dart"), (TYPES, PLAIN_FUNCTION), True, r"^\s*import\s+(?:static\s+)?[\"']?([\w.*:/]+)"),
    "csharp": (("cs",), (TYPES, PLAIN_FUNCTION), True, r"^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;"),
    "kotlin": (("kt", "kts", "scala"), (TYPES, KEYWORD_FUNCTION), False, r"^\s*import\s+([\w.*{}]+)"),
    "go": (("go",), (GO_TYPES, KEYWORD_FUNCTION), False, r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$"),
    "rust": (("rs",), (TYPES, IMPL, KEYWORD_FUNCTION), False, r"^\s*(?:pub\s+)?use\s+([\w:]+)"),
    "c": (("c", "h", "cc", "cpp", "cxx", "hpp", "cu"), (TYPES, PLAIN_FUNCTION), True, r"^\s*#\s*(?:include|import)\s+[<\"]([^>\"]+)"),
    "php": (("php",), (TYPES, KEYWORD_FUNCTION), False, r"^\s*use\s+([\w\\]+)|\b(?:require|include)(?:_once)?\s*\(?\s*[\"']([^\"']+)"),
    "swift": (("swift",), (TYPES, KEYWORD_FUNCTION), False, r"^\s*import\s+(\w+)"),
}
ENDINGS = {e: name for name, (endings, *_) in LANGUAGES.items() for e in endings}
SCANNERS = {name: re.compile("|".join(["(?P<open>\\{)", "(?P<close>\\})", "(?P<end>;)", *rules, CALL])) for name, (_, rules, _, _) in LANGUAGES.items()}


def without_strings(text: str, language: str) -> str:
    """The text with comments and the insides of strings blanked; offsets and lines stay."""
    quote = r"|'(?:\\.|[^'\\\n])'" if language in ("rust", "kotlin", "java", "csharp", "go", "c", "swift") else r"|'(?:\\.|[^'\\\n])*'"
    hashes = r"|\#[^\n]*" if language == "php" else ""
    return re.sub(SKIP + quote + hashes, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def extract_braces(path: str, text: str) -> Fragment:
    """Types with their supertypes and members, functions, the calls among them, and imports.

    Calls are those from a function to a name that the file defines. Receivers of Go methods, owners in C++ and ``impl`` blocks in
    Rust count as the type that has the member.
    """
    out = Fragment(path)
    language = ENDINGS.get(path.rsplit(".", 1)[-1].lower())
    if language is None:
        return out
    _, _, plain_outside, imports = LANGUAGES[language]
    code = without_strings(text, language)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    types: dict[str, str] = {}
    names: dict[str, str] = {}
    calls: list[tuple[str, str, int]] = []
    scopes: list[tuple[int, str, str]] = []  # depth at which it opened, key, kind
    pending: tuple[str, str] | None = None
    depth, line = 0, 0

    def innermost(*kinds: str) -> str | None:
        return next((key for _, key, kind in reversed(scopes) if kind in kinds), None)

    def type_of(name: str, at: int) -> str:
        if name not in types:
            types[name] = names[name] = out.node(key_of(path, name), name, "class", at)
            out.edge(innermost("class") or out.file, types[name], "contains", at)
        return types[name]

    for m in SCANNERS[language].finditer(code):
        while line < len(starts) and starts[line] <= m.start():
            line += 1
        kind = m.lastgroup if m.lastgroup in ("open", "close", "end", "call") else None
        g = m.groupdict()
        if kind == "open":
            depth += 1
            if pending:
                scopes.append((depth, *pending))
                pending = None
        elif kind == "close":
            if scopes and scopes[-1][0] == depth:
                scopes.pop()
            depth = max(0, depth - 1)
        elif kind == "end":
            pending = None
        elif g.get("type"):
            key = type_of(g["type"], line)
            interfaces = False
            for word in re.findall(rf"[\w.\\:$]+(?=\s*(?:<|\(|,|$|\s))|,", re.sub(r"<[^<>]*>", "", g["supers"] or "")):
                if word in ("extends", ":", "with", "public", "private", "protected", "virtual", ",", "open", "permits"):
                    interfaces = interfaces and word not in ("extends", ":")
                elif word == "implements":
                    interfaces = True
                elif word == "where":
                    break
                else:
                    out.edge(key, out.stub(word.strip(":.")), "implements" if interfaces else "inherits", line)
            pending = (key, "class")
        elif g.get("impl"):
            key = type_of(g["impl"], line)
            if g["trait"]:
                out.edge(key, out.stub(g["trait"]), "implements", line)
            pending = (key, "class")
        elif g.get("call"):
            owner = innermost("function")
            if owner and g["call"] not in NOT_A_NAME:
                calls.append((owner, g["call"], line))
        else:
            name = g.get("function") or g.get("arrow") or g.get("plain")
            plain = bool(g.get("plain"))
            in_class = bool(scopes) and scopes[-1][2] == "class"
            known = g.get("receiver") or g.get("owner")
            if name is None or name in NOT_A_NAME or (plain and not in_class and not (plain_outside and innermost("function") is None)):
                owner = innermost("function")
                if owner and name and name not in NOT_A_NAME:
                    calls.append((owner, name, line))
                continue
            owner = type_of(known, line) if known else scopes[-1][1] if in_class else None
            if owner:
                key = out.node(key_of(path, next((t for t, k in types.items() if k == owner), ""), name), f".{name}()", "method", line)
                out.edge(owner, key, "method", line)
            else:
                key = out.node(key_of(path, name), f"{name}()", "function", line)
                out.edge(innermost("function") or out.file, key, "contains", line)
            names.setdefault(name, key)
            pending = (key, "function")
    for owner, name, at in calls:
        if name in names and names[name] != owner:
            out.edge(owner, names[name], "calls", at)
    for i, source in enumerate(text.split("\n"), 1):
        for m in re.finditer(imports, source):
            out.edge(out.file, out.stub(next(x for x in m.groups() if x), "module"), "imports_from", i)
    return out
