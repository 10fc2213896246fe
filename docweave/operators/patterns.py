"""Declarative tree patterns.

A pattern is data: node patterns (``tag``, ``any_tag``, with class and text conditions, alternatives, labels, children)
and sequence patterns (concatenation, alternatives, ``maybe``).  ``matches`` evaluates one on a node by backtracking and
yields every derivation; ``match_nodes`` runs it over documents; ``lower_path`` turns label-free and labelled paths of
simple steps into joins on a table of nodes, which Spark can plan by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_tree import COMMENT, Node, parse_html, parse_xml, per_document


@dataclass(frozen=True)
class Match:
    node: Node | None
    label: str | None = None
    children: tuple[Match, ...] = ()


@dataclass
class Labelled:
    """The labels of a match as a tree."""

    label: str
    node: Node | None
    children: list[Labelled]

    def __getitem__(self, key):
        if isinstance(key, int):
            return self.children[key]
        found = next((c for c in self.children if c.label == key), None)
        if found is None:
            raise KeyError(key)
        return found

    def __contains__(self, label) -> bool:
        return any(c.label == label for c in self.children)

    def rows(self) -> list[tuple[int, int, str, Node | None]]:
        """(idx, parent_idx, label, node), flattened in document order."""
        out: list = []

        def visit(t, parent):
            me = len(out)
            out.append((me, parent, t.label, t.node))
            for c in t.children:
                visit(c, me)

        visit(self, -1)
        return out


def label_tree(match: Match) -> Labelled:
    def visible(m: Match) -> list[Labelled]:
        below = [x for c in m.children for x in visible(c)]
        return below if m.label is None else [Labelled(m.label, m.node, below)]

    top = visible(match)
    return top[0] if len(top) == 1 else Labelled("root", match.node, top)


class Pattern:
    def __add__(self, other: Pattern) -> Sequence:
        return Sequence(_parts(self) + _parts(other))


def _parts(p: Pattern) -> tuple[Pattern, ...]:
    return p.parts if isinstance(p, Sequence) else (p,)


class SeqPattern(Pattern):
    def __or__(self, other: Pattern) -> SeqChoice:
        own = self.options if isinstance(self, SeqChoice) else (self,)
        return SeqChoice(own + (other.options if isinstance(other, SeqChoice) else (other,)))


@dataclass(frozen=True)
class Sequence(SeqPattern):
    parts: tuple[Pattern, ...] = ()


@dataclass(frozen=True)
class SeqChoice(SeqPattern):
    options: tuple[Pattern, ...]


@dataclass(frozen=True)
class NodePattern(Pattern):
    """One element: alternatives, then conditions, label and children around them."""

    kind: str  # tag, any, choice, labelled, class, text, children
    name: str = ""
    inner: tuple[NodePattern, ...] = ()
    names: frozenset[str] = frozenset()
    below: Pattern | None = None

    def __or__(self, other: Pattern):
        if not isinstance(other, NodePattern):
            raise TypeError("an element and a sequence can't be alternatives; use seq() on both")
        own = self.inner if self.kind == "choice" else (self,)
        return NodePattern("choice", inner=own + (other.inner if other.kind == "choice" else (other,)))

    def __pow__(self, label: str) -> NodePattern:
        return NodePattern("labelled", label, (self,))

    def __truediv__(self, other: Pattern) -> NodePattern:
        if self.kind == "children":
            if not isinstance(self.below, NodePattern):
                raise TypeError("a path can't go on after a sequence")
            return replace(self, below=self.below / other)
        return NodePattern("children", inner=(self,), below=other)

    def with_class(self, *names: str) -> NodePattern:
        return NodePattern("class", inner=(self,), names=frozenset(names))

    def with_text(self, regex: str) -> NodePattern:
        re.compile(regex)
        return NodePattern("text", regex, (self,))


any_tag = NodePattern("any")
empty_seq = Sequence()


def tag(name: str) -> NodePattern:
    return NodePattern("tag", name)


def seq(*patterns: Pattern) -> Sequence:
    return Sequence(tuple(x for p in patterns for x in _parts(p)))


def maybe(pattern: Pattern) -> SeqChoice:
    return SeqChoice((pattern, empty_seq))


def elements(node: Node) -> list[Node]:
    return [c for c in node.children if c.tag != COMMENT]


def matches(p: NodePattern, node: Node) -> Iterator[Match]:
    match p.kind:
        case "tag":
            if node.tag == p.name:
                yield Match(node)
        case "any":
            yield Match(node)
        case "choice":
            for option in p.inner:
                yield from matches(option, node)
        case "class":
            if not p.names.isdisjoint(node.classes):
                yield from matches(p.inner[0], node)
        case "text":
            # anchored at the start only, on the element's own first text
            if re.match(p.name, node.text):
                yield from matches(p.inner[0], node)
        case "labelled":
            for m in matches(p.inner[0], node):
                yield Match(None, p.name, (m,)) if m.label is not None else replace(m, label=p.name)
        case "children":
            for m in matches(p.inner[0], node):
                if m.children:
                    raise ValueError("this element has been given children already")
                kids = elements(node)
                if isinstance(p.below, NodePattern):
                    for kid in kids:
                        for found in matches(p.below, kid):
                            yield replace(m, children=(found,))
                else:
                    for found, rest in sequences(p.below, kids, 0):
                        if rest == len(kids):
                            yield replace(m, children=found)


def sequences(p: Pattern, nodes: list[Node], at: int) -> Iterator[tuple[tuple[Match, ...], int]]:
    """(matches, place after them) of each way p can begin at a place."""
    if isinstance(p, NodePattern):
        if at < len(nodes):
            for m in matches(p, nodes[at]):
                yield (m,), at + 1
    elif isinstance(p, SeqChoice):
        for option in p.options:
            yield from sequences(option, nodes, at)
    elif not p.parts:
        yield (), at
    else:
        for first, middle in sequences(p.parts[0], nodes, at):
            for rest, end in sequences(Sequence(p.parts[1:]), nodes, middle):
                yield first + rest, end


MATCHES = "root_path string, match_no int, labels array<struct<idx:int,parent_idx:int,label:string,path:string,text:string>>"
_LABELS = pa.list_(pa.struct([("idx", pa.int32()), ("parent_idx", pa.int32()), ("label", pa.string()), ("path", pa.string()), ("text", pa.string())]))


def match_nodes(docs: DataFrame, pattern: NodePattern, root_tag: str | None = None, *, id_col: str = "page_id", markup_col: str = "html", xml: bool = False) -> DataFrame:
    """(id, root_path, match_no, labels): a row for each derivation at each element (with root_tag: at those only)."""
    parse = parse_xml if xml else parse_html

    def rows(markup):
        root = parse(markup)
        paths = root.paths()
        for node in root.walk():
            if node.tag != COMMENT and (root_tag is None or node.tag == root_tag):
                for k, m in enumerate(matches(pattern, node)):
                    labels = [{"idx": i, "parent_idx": p, "label": name, "path": paths[id(n)] if n else None, "text": n.text if n else None} for i, p, name, n in label_tree(m).rows()]
                    yield paths[id(node)], k, labels

    return per_document(docs, id_col, markup_col, rows, [pa.string(), pa.int32(), _LABELS], MATCHES)


def lower_path(nodes: DataFrame, pattern: NodePattern, id_col: str = "doc_id") -> DataFrame:
    """A path ``a / b / c`` or ``a / seq(b, c)`` of steps with tag, class and text conditions and labels, as joins on nodes.

    (id, root node_id, one column of node ids a label).  Joins have the document as a key; rows are never made distinct.
    """
    counter = iter(range(10**6))

    def condition(p: NodePattern, c):
        match p.kind:
            case "tag":
                return c["tag"] == p.name
            case "any":
                return F.lit(True)
            case "choice":
                out = F.lit(False)
                for option in p.inner:
                    out = out | condition(option, c)
                return out
            case "class":
                return F.arrays_overlap(c["classes"], F.array(*[F.lit(n) for n in sorted(p.names)])) & condition(p.inner[0], c)
            case "text":
                return F.coalesce(c["text"], F.lit("")).rlike(f"^(?:{p.name})") & condition(p.inner[0], c)
        raise ValueError(f"{p.kind} can't be lowered here")

    def step(p: NodePattern) -> tuple[DataFrame, str, list[str]]:
        """(table with the columns id, key, parent, pos, labels), prefix, labels."""
        labels: list[str] = []
        if p.kind == "labelled":
            table, k, labels = step(p.inner[0])
            return table.withColumn(p.name, F.col(f"{k}id")), k, [*labels, p.name]
        if p.kind == "children":
            table, k, labels = step(p.inner[0])
            parts = (p.below,) if isinstance(p.below, NodePattern) else p.below.parts
            for place, part in enumerate(parts):
                if not isinstance(part, NodePattern):
                    raise ValueError("only fixed sequences can be lowered")
                child, ck, cl = step(part)
                if not isinstance(p.below, NodePattern):
                    child = child.where(F.col(f"{ck}pos") == place)
                table = table.join(child.withColumnRenamed("doc", f"{ck}doc"), (F.col("doc") == F.col(f"{ck}doc")) & (F.col(f"{k}id") == F.col(f"{ck}parent"))).drop(f"{ck}doc")
                labels = labels + cl
            if not isinstance(p.below, NodePattern):
                more = nodes.where(F.col("child_pos") >= len(parts)).select(F.col(id_col).alias("doc"), F.col("parent_id").alias(f"{k}id"))
                table = table.join(more, ["doc", f"{k}id"], "left_anti")
            return table, k, labels
        k = f"n{next(counter)}_"
        table = nodes.where(condition(p, nodes)).select(F.col(id_col).alias("doc"), F.col("node_id").alias(f"{k}id"), F.col("parent_id").alias(f"{k}parent"), F.col("child_pos").alias(f"{k}pos"))
        return table, k, labels

    table, k, labels = step(pattern)
    return table.select(F.col("doc").alias(id_col), F.col(f"{k}id").alias("root"), *labels)
