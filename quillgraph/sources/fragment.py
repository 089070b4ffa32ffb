"""Rows of one extracted file."""

from __future__ import annotations

import re


def key_of(*parts: str) -> str:
    return re.sub(r"[^\w]+|_+", "_", "_".join(parts)).strip("_").lower()


class Fragment:
    """Rows of one file: nodes with a label and kind, edges with a relation (in ``kind``) and a target."""

    def __init__(self, path: str) -> None:
        self.path, self.rows, self.seen = path, [], set()
        self.file = self.node(key_of(path), path.rsplit("/", 1)[-1], "file", 1)

    def node(self, key: str, label: str, kind: str, line: int = 1) -> str:
        if ("n", key) not in self.seen:
            self.seen.add(("n", key))
            self.rows.append(("node", key, label, kind, None, f"L{line}", self.path))
        return key

    def edge(self, source: str, target: str, relation: str, line: int = 1) -> None:
        if source and target and ("e", source, target, relation) not in self.seen:
            self.seen.add(("e", source, target, relation))
            self.rows.append(("edge", source, None, relation, target, f"L{line}", self.path))

    def stub(self, name: str, kind: str = "stub") -> str:
        key = key_of(name)
        if ("n", key) not in self.seen:
            self.seen.add(("n", key))
            self.rows.append(("node", key, name, kind, None, None, None))
        return key
