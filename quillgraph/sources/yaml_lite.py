"""The part of YAML that configuration files use: block and flow collections, quoted and block scalars, comments, several documents."""

from __future__ import annotations

import re

_KEY = re.compile(r"""^(?:"([^"]*)"|'([^']*)'|([^\s"'#\[\]{},&*!|>%@`][^#]*?))\s*:(?:\s+|$)""")


def scalar(text: str):
    text = text.strip()
    text = re.sub(r"^[&!]\S+\s+", "", text)
    if not text or text in ("~", "null"):
        return None
    if text[0] in "\"'" and text[-1] == text[0] and len(text) > 1:
        return text[1:-1]
    if text[0] in "[{":
        return _flow(text)
    if text in ("true", "false"):
        return text == "true"
    return int(text) if re.fullmatch(r"-?\d{1,15}", text) else text


def _flow(text: str):
    inner, parts, depth, quote, start = text[1:-1] if text[-1] in "]}" else text[1:], [], 0, "", 0
    for i, c in enumerate(inner):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            parts.append(inner[start:i])
            start = i + 1
    parts = [p for p in (*parts, inner[start:]) if p.strip()]
    if text[0] == "[":
        return [scalar(p) for p in parts]
    pairs = [p.partition(":") for p in parts]
    return {str(scalar(k)): scalar(v) for k, _, v in pairs}


def _clean(line: str) -> str:
    return re.sub(r"(^|\s)#.*$", "", line) if "#" in line and not re.search(r"[\"'][^\"']*#", line) else line


def documents(text: str) -> list:
    """The documents of ``text``; what is not understood becomes a string or is left out, nothing is raised."""
    return [d for part in re.split(r"(?m)^---.*$", text) if (d := _parse(part)) is not None]


def _parse(text: str):
    lines = [(len(x) - len(x.lstrip()), x.strip(), n) for n, x in enumerate(map(_clean, text.expandtabs(2).split("\n"))) if x.strip() and not x.lstrip().startswith("%")]
    raw = text.expandtabs(2).split("\n")
    at = 0

    def block(indent: int):
        """A block scalar: all raw lines that are indented deeper, or blank."""
        nonlocal at
        first = lines[at - 1][2] + 1
        out = []
        for n in range(first, len(raw)):
            if raw[n].strip() and len(raw[n]) - len(raw[n].lstrip()) <= indent:
                break
            out.append(raw[n].strip())
        while at < len(lines) and lines[at][2] < first + len(out):
            at += 1
        return "\n".join(out).strip()

    def value(rest: str, indent: int):
        nonlocal at
        rest = re.sub(r"^[&!]\S+\s*", "", rest.strip())
        if re.fullmatch(r"[|>][+-]?\d*", rest):
            return block(indent)
        if rest:
            while rest[0] in "[{" and rest.count("[") + rest.count("{") > rest.count("]") + rest.count("}") and at < len(lines):
                rest += " " + lines[at][1]
                at += 1
            return scalar(rest)
        if at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- "))):
            return node(lines[at][0])
        return None

    def node(indent: int):
        nonlocal at
        if lines[at][1].startswith("-") and (lines[at][1] == "-" or lines[at][1][1] == " "):
            items = []
            while at < len(lines) and lines[at][0] == indent and (lines[at][1] == "-" or lines[at][1].startswith("- ")):
                rest = lines[at][1][1:].lstrip()
                inner = indent + len(lines[at][1]) - len(rest)
                if _KEY.match(rest):
                    lines[at] = (inner, rest, lines[at][2])
                    items.append(node(inner))
                else:
                    at += 1
                    items.append(value(rest, indent))
            return items
        if _KEY.match(lines[at][1]):
            out = {}
            while at < len(lines) and lines[at][0] == indent and (m := _KEY.match(lines[at][1])):
                rest = lines[at][1][m.end() :]
                at += 1
                out[next(g for g in m.groups() if g is not None).strip()] = value(rest, indent)
            while at < len(lines) and lines[at][0] > indent:  # a line that fits nowhere
                at += 1
            return out
        at += 1
        return scalar(lines[at - 1][1])

    return node(lines[0][0]) if lines else None
