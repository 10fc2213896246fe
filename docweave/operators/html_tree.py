"""Markup to trees, one document at a time inside an Arrow operator, and trees to a table of nodes.

HTML recovery: void elements never nest; a new p, li, td, tr, option, dt or dd closes an open one of its kind in the same
container; script and style are raw text; comments are nodes with tag ``#comment`` whose text isn't linearised; unknown
end tags are ignored; html and body are added where they are missing; a named character reference ends with a semicolon, or
it is text (so ``&amp`` before a tag stays), a numeric one needs none.  Well-formed XML is parsed strictly.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections import Counter
from html import escape, unescape
from html.entities import html5
from html.parser import HTMLParser
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without content, elements that close an open one of their kind, headers
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
CONTAINERS = frozenset("ul ol table div body html article section nav td th tr dl select blockquote".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
HEADERS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD_ONLY = frozenset("title meta link style base".split())
COMMENT = "#comment"
#: of a batch that leaves Python: its rows at most, and the characters of markup after which it goes
OUT_ROWS, OUT_CHARS = 4096, 1 << 18
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|([a-zA-Z][a-zA-Z0-9]*);)")


def _step(tag: str) -> str:
    return "comment()" if tag == COMMENT else tag


class Node:
    __slots__ = ("tag", "attrs", "text", "tail", "children", "parent", "at")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.text, self.tail, self.children, self.parent, self.at = tag, attrs or {}, "", "", [], parent, -1
        if parent is not None:
            parent.children.append(self)

    def add_text(self, s: str) -> None:
        if self.children:
            self.children[-1].tail += s
        else:
            self.text += s

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self):
        """This node and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def ancestors(self):
        node = self
        while node is not None:
            yield node
            node = node.parent

    def insert(self, at: int, node: Node) -> None:
        node.parent = self
        self.children.insert(at, node)

    def paths(self) -> dict[int, str]:
        """Paths of this node and all below it by identity, in one pass; a number only where siblings share the tag."""
        out = {id(self): f"/{_step(self.tag)}"}
        for node in self.walk():
            total = Counter(c.tag for c in node.children)
            count: Counter[str] = Counter()
            for c in node.children:
                count[c.tag] += 1
                out[id(c)] = f"{out[id(node)]}/{_step(c.tag)}" + (f"[{count[c.tag]}]" if total[c.tag] > 1 else "")
        return out

    def path(self) -> str:
        """Absolute path of one node; for many of them see ``paths``."""
        steps = []
        for node in self.ancestors():
            same = [c for c in node.parent.children if c.tag == node.tag] if node.parent is not None else [node]
            number = f"[{next(i for i, c in enumerate(same, 1) if c is node)}]" if len(same) > 1 else ""
            steps.append(f"/{_step(node.tag)}{number}")
        return "".join(reversed(steps))

    def find(self, path: str) -> Node | None:
        """The node at an absolute path of this root."""
        node = None
        for k, step in enumerate(path.strip("/").split("/")):
            tag, _, number = step.partition("[")
            tag = COMMENT if tag == "comment()" else tag
            pool = [self] if k == 0 else node.children
            same = [c for c in pool if c.tag == tag]
            number = int(number[:-1]) if number else 1
            if len(same) < number:
                return None
            node = same[number - 1]
        return node


def _stand_in(markup: str) -> str:
    """A character that isn't in the markup."""
    return next(c for c in map(chr, chain(range(0xFDD0, 0xFDF0), range(0xF0000, 0xFFFFE))) if c not in markup)


class _Builder(HTMLParser):
    """Feeds markup whose ampersands are a character of no meaning, as HTMLParser reads names without semicolons too."""

    def __init__(self, ampersand: str, references: frozenset[str] | None = None):
        super().__init__(convert_charrefs=True)
        self.ampersand, self.references = ampersand, references
        self.root = Node("html")
        self.open = [self.root]
        self.seen_html = False

    def _plain(self, s: str) -> str:
        return s.replace(self.ampersand, "&")

    def _read(self, s: str) -> str:
        """The text with its character references read."""
        return _REFERENCE.sub(self._reference, self._plain(s)) if self.ampersand in s else s

    def _reference(self, m: re.Match) -> str:
        if self.references is not None and (m[0][-1] != ";" or m[0][1:-1] not in self.references):
            return m[0]
        return html5.get(f"{m[1]};", m[0]) if m[1] else unescape(m[0])

    def _body(self) -> None:
        """Content outside of html and body gets a body."""
        if len(self.open) == 1:
            body = next((c for c in self.root.children if c.tag == "body"), None) or Node("body", None, self.root)
            self.open.append(body)

    def handle_starttag(self, tag, attrs):
        tag = self._plain(tag)
        attrs = {self._plain(k): self._read(v) if v is not None else "" for k, v in attrs}
        if tag == "html":
            self.root.attrs.update({k: v for k, v in attrs.items() if k not in self.root.attrs})
            return
        if tag in ("head", "body"):
            known = next((c for c in self.root.children if c.tag == tag), None)
            if known is None:
                del self.open[1:]
                self.open.append(Node(tag, attrs, self.root))
            return
        if len(self.open) == 1 and tag in HEAD_ONLY and not self.root.children:
            self.open.append(Node("head", None, self.root))
        elif self.open[-1].tag == "head" and tag not in HEAD_ONLY | {"script"}:
            self.open.pop()
        self._body()
        closing = CLOSES.get(tag, {"p"} if tag in BLOCKS else set())
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in closing:
                del self.open[k:]
                break
            if self.open[k].tag in CONTAINERS and self.open[k].tag not in closing:
                break
        node = Node(tag, attrs, self.open[-1])
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == self._plain(tag):
            self.open.pop()

    def handle_endtag(self, tag):
        tag = self._plain(tag)
        if tag in ("html", "body"):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        data = self._plain(data) if self.cdata_elem else self._read(data)
        if len(self.open) == 1 or self.open[-1].tag == "head":
            if not data.strip():
                return
            del self.open[1:]
            self._body()
        self.open[-1].add_text(data)

    def handle_comment(self, data):
        Node(COMMENT, None, self.open[-1]).text = self._plain(data)


def parse_html(markup: str | None, references: frozenset[str] | None = None) -> Node:
    """The tree of a page.  Where references are given (``amp``, ``#x27``), only these are read, with their semicolons; others stay as they are written."""
    markup = markup or ""
    builder = _Builder(_stand_in(markup), references)
    builder.feed(markup.replace("&", builder.ampersand))
    builder.close()
    return builder.root


def parse_xml(markup: str) -> Node:
    def build(e, parent):
        node = Node(re.sub(r"^\{.*\}", "", e.tag), dict(e.attrib), parent)
        node.text, node.tail = e.text or "", (e.tail or "") if parent is not None else ""
        for child in e:
            build(child, node)
        return node

    return build(ET.fromstring(markup), None)


def serialize(node: Node) -> str:
    """Markup of a tree; elements without content are self-closing."""
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.tag == COMMENT:
            out.append(f"<!--{x.text}-->")
        else:
            raw = x.tag in ("script", "style")
            head = x.tag + "".join(f' {k}="{escape(v)}"' for k, v in x.attrs.items())
            if not x.text and not x.children:
                out.append(f"<{head}/>")
            else:
                out.append(f"<{head}>" + (x.text if raw else escape(x.text, quote=False)))
                todo.append(escape(x.tail, quote=False) if x is not node else "")
                todo.append(f"</{x.tag}>")
                todo.extend(reversed(x.children))
                continue
        if x is not node:
            out.append(escape(x.tail, quote=False))
    return "".join(out)


NODES = "node_id int, parent_id int, child_pos int, subtree_end int, tag string, attrs map<string,string>, classes array<string>, text string, tail string, xpath string, in_header boolean"
_NODE_TYPES = [pa.int32()] * 4 + [pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.bool_()]


def node_rows(root: Node):
    order = list(root.walk())
    for i, n in enumerate(order):
        n.at = i
    last = list(range(len(order)))
    for i in range(len(order) - 1, 0, -1):
        p = order[i].parent.at
        last[p] = max(last[p], last[i])
    paths, header, place = root.paths(), {0: root.tag in HEADERS}, {0: 0}
    for i, n in enumerate(order):
        for pos, c in enumerate(n.children):
            header[c.at], place[c.at] = header[i] or c.tag in HEADERS, pos
        yield i, n.parent.at if n.parent else None, place[i], last[i], n.tag, list(n.attrs.items()), n.classes, n.text or None, n.tail or None, paths[id(n)], header[i]


def per_document(docs: DataFrame, id_col: str, markup_col: str, rows_of, types: list[pa.DataType], schema: str) -> DataFrame:
    """(id, *columns) for each row that rows_of(markup) yields; documents stay where they are, so nothing is shuffled."""
    names = [part.strip().split(" ")[0] for part in _top_level(schema)]

    def run(batches):
        for batch in batches:
            ids, columns, read = [], [[] for _ in names], 0
            for i, markup in zip(batch.column(0).to_pylist(), batch.column(1)):
                read += len(markup.as_py() or "")
                for row in rows_of(markup.as_py()):
                    ids.append(i)
                    for column, value in zip(columns, row):
                        column.append(value)
                    if len(ids) == OUT_ROWS:
                        yield _batch(batch, ids, columns)
                        ids, columns = [], [[] for _ in names]
                if read > OUT_CHARS:
                    yield _batch(batch, ids, columns)
                    ids, columns, read = [], [[] for _ in names], 0
            yield _batch(batch, ids, columns)

    def _batch(batch, ids, columns):
        return pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns, types))], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(markup_col)).mapInArrow(run, f"{id_col} {kind}, {schema}")


def _top_level(schema: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += c
    return [*parts, current]


def nodes(docs: DataFrame, *, id_col: str = "page_id", markup_col: str = "html", xml: bool = False, references: frozenset[str] | None = None) -> DataFrame:
    """(id, node_id, parent_id, child_pos, subtree_end, tag, attrs, classes, text, tail, xpath, in_header).

    node_id counts in document order, so the nodes below a are those with a.node_id < node_id <= a.subtree_end.
    A null markup is an empty page.  For ``references`` see ``parse_html``.
    """
    parse = parse_xml if xml else lambda m: parse_html(m, references)
    return per_document(docs, id_col, markup_col, lambda m: node_rows(parse(m)), _NODE_TYPES, NODES)
