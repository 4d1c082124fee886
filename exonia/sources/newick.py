"""Newick trees: read to edge tables, written from them, re-rooted."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from typing import NoReturn

from pyspark.sql import DataFrame, SparkSession

#: Characters for which a name is put in quotes.
SPECIAL = "'[]{}(),:;#\""
_END = r"[\s(),:;]|\Z"


def _token(relaxed: bool) -> re.Pattern:
    """Tokens. A quote is doubled within a quoted name; relaxed, a single one is part of it too unless the name can end there."""
    stray = lambda q: f"|{q}(?!{q}|{_END})" if relaxed else ""
    quoted = "|".join(f"{q}(?:{q}{q}|[^{q}]{stray(q)})*{q}" for q in ("'", '"'))
    return re.compile(rf"\s+|\[[^\]]*\]|#[^\n]*\n?|(?P<quoted>{quoted})|(?P<mark>[(),:;])|(?P<word>[^\s()\[\]'\",:;#]+)|(?P<bad>.)", re.S)


_TOKENS = {relaxed: _token(relaxed) for relaxed in (True, False)}
_NUMBER = re.compile(r"NaN|[+-]?Inf|[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
SCHEMA = "tree int, postorder int, node_name string, parent_name string, branch_length double, parent_order int"


@dataclass
class Node:
    name: str | None = None
    length: float | None = None
    children: list[Node] = field(default_factory=list)


def tokens(text: str, relaxed: bool = True) -> list[tuple[str, str, int]]:
    out = []
    for m in _TOKENS[relaxed].finditer(text):
        kind = m.lastgroup
        if kind == "bad":
            what = "a comment or quote is not closed" if m.group() in ("[", "'", '"') else "unexpected character"
            raise ValueError(f"{what} at {m.start()}")
        if kind:
            out.append((kind, m.group(), m.start()))
    return out


def trees(text: str, relaxed: bool = True) -> list[Node]:
    """The trees of a text, each ended by a semicolon. Comments are in brackets or from # to the end of the line; in bare
    names _ stands for a blank; names with marks are in single or double quotes. A node may be named before and after its
    children; then both names are joined. Not relaxed: two names are an error, and so is a quote that isn't doubled."""
    items, at, out = tokens(text, relaxed), 0, []
    while at < len(items):
        node, at = _node(items, at, relaxed)
        if at >= len(items) or items[at][1] != ";":
            _fail(items, at, "; expected")
        at += 1
        out.append(node)
    return out


def _fail(items, at: int, what: str) -> NoReturn:
    raise ValueError(f"{what} at {items[at][2]}" if at < len(items) else f"{what} at the end")


def _name(items, at: int) -> tuple[str | None, int]:
    if at < len(items) and items[at][0] == "quoted":
        q = items[at][1][0]
        return items[at][1][1:-1].replace(q + q, q), at + 1
    if at < len(items) and items[at][0] == "word":
        return items[at][1].replace("_", " "), at + 1
    return None, at


def _node(items, at: int, relaxed: bool) -> tuple[Node, int]:
    """node := name? ("(" node ("," node)* ")" name?)? (":" number)?"""
    node = Node()
    before, at = _name(items, at)
    after = None
    if at < len(items) and items[at][1] == "(":
        while True:
            child, at = _node(items, at + 1, relaxed)
            node.children.append(child)
            if at >= len(items) or items[at][1] not in ",)":
                _fail(items, at, ", or ) expected")
            if items[at][1] == ")":
                break
        after, at = _name(items, at + 1)
        if after is not None and before is not None and not relaxed:
            _fail(items, at - 1, "a second name")
    node.name = " && ".join(x for x in (before, after) if x is not None) if before is not None or after is not None else None
    if at < len(items) and items[at][1] == ":":
        at += 1
        if at >= len(items) or not _NUMBER.fullmatch(items[at][1]):
            _fail(items, at, "a number expected")
        node.length = float(items[at][1])
        at += 1
    return node, at


def edges(root: Node) -> list[tuple[int, str | None, str | None, float | None, int | None]]:
    """(postorder, name, parent's name, length, parent's postorder)."""
    rows: list[list] = []

    def visit(node: Node) -> int:
        own = [visit(c) for c in node.children]
        rows.append([len(rows), node.name, None, node.length, None])
        for k in own:
            rows[k][2], rows[k][4] = node.name, rows[-1][0]
        return rows[-1][0]

    visit(root)
    return [tuple(r) for r in rows]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The edges of all trees of a file; trees are small and are read by the driver."""
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    rows = [(k, *e) for k, root in enumerate(trees(text)) for e in edges(root)]
    return spark.createDataFrame(rows, SCHEMA)


def quoted(name: str | None, always: bool = False) -> str:
    if name is None:
        return "''" if always else ""
    if always or any(c in SPECIAL or c.isspace() or c == "_" for c in name):
        return "'" + name.replace("'", "''") + "'"
    return name


def number(x: float) -> str:
    """A branch length in at most 5 decimals or 2 significant digits; those below 1e-7 as 9.9e-9."""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "Inf" if x > 0 else "-Inf"
    if x == 0:
        return "0"
    if 0 < x < 1e-7:
        return "9.9e-9"
    return f"{round(x, 5):g}" if abs(x) >= 1e-4 and abs(x) < 1e6 else f"{x:.2g}" if abs(x) < 1e-4 else repr(x)


def text(node: Node, lengths: bool = True) -> str:
    """The tree in Newick form, without the semicolon."""
    inner = f"({','.join(text(c, lengths) for c in node.children)})" if node.children else ""
    return inner + quoted(node.name) + (f":{number(node.length)}" if lengths and node.length is not None else "")


def from_edges(rows: list[tuple[str, str | None, float | None]]) -> Node:
    """The tree of (name, parent, length) rows in post-order."""
    nodes = {name: Node(name, length) for name, _, length in rows}
    root = None
    for name, parent, _ in rows:
        if parent is None:
            root = nodes[name]
        else:
            nodes[parent].children.append(nodes[name])
    if root is None:
        raise ValueError("no root")
    return root


def rerooted(root: Node, name: str) -> Node:
    """The tree with the node of the given name as root; branches on the way keep their lengths."""

    def path(node: Node) -> list[Node] | None:
        if node.name == name:
            return [node]
        return next(([node, *p] for c in node.children if (p := path(c))), None)

    way = path(root)
    if way is None:
        raise ValueError(f"no node {name}")
    lengths = [n.length for n in way[1:]]
    for above, below, length in zip(way[:-1], way[1:], lengths, strict=True):
        above.children = [c for c in above.children if c is not below]
        below.children.append(above)
        above.length = length
    way[-1].length = None
    return way[-1]
