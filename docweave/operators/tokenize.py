"""Sentences and words: of plain columns inside the JVM, of markup with knowledge of the elements around."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import text as T
from .html_tree import HEADERS, Node, parse_html, per_document
from .linearize import DEFAULT_RULES, Flat, Piece, Rules


def word_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word_no, word) of plain texts."""
    return docs.select(id_col, F.posexplode(T.words(F.col(text_col))).alias("word_no", "word"))


def sentence_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sent_no, sentence) of plain texts."""
    return docs.select(id_col, F.posexplode(T.sentences(F.col(text_col))).alias("sent_no", "sentence"))


def is_reference(node: Node) -> bool:
    return not {"ltx_ref", "ltx_cite"}.isdisjoint(node.classes)


def is_display(node: Node) -> bool:
    return "ltx_equation" in node.classes


def in_header(node: Node) -> bool:
    return any(n.tag in HEADERS for n in node.ancestors())


#: what may end a sentence; of a full stop, not before a small letter and not between digits
_end = re.compile(r"[.!?](?![\xa0,.:;])")
_word = re.compile(r"[.,:;!?)(\[\]{}\-”“]|[^\s.,:;!?)(\[\]{}\-”“]+")


def ends_sentence(flat: Flat, p: Piece, i: int) -> bool:
    s, c = p.string, p.string[i]
    after = s[i + 1 : i + 2]
    if not _end.match(s, i):
        return False
    if c == "." and (after.islower() or (i > 0 and s[i - 1].isdigit() and after.isdigit())):
        return False
    return not (after.isspace() and i + 2 < len(s) and is_reference(flat.node(p.refs[i + 2])))


def split_sentences(flat: Flat, p: Piece) -> list[Piece]:
    """Cuts after sentence ends, before and after headers, and after display formulas that white space follows.

    What follows the last cut isn't a sentence.  Only characters that may end one are looked at, and the tokens' starts.
    """
    header: dict[int, bool] = {}

    def under_header(node: Node) -> bool:
        chain = []
        while node is not None and id(node) not in header:
            chain.append(node)
            node = node.parent
        known = node is not None and header[id(node)]
        for n in reversed(chain):
            known = header[id(n)] = known or n.tag in HEADERS
        return known

    # by place: sentence ends, then changes of header, then ends of display formulas, the last of them counts
    cuts = {m.start(): m.end() for m in _end.finditer(p.string) if ends_sentence(flat, p, m.start())}
    inside, display, at = False, False, 0
    for t in flat.tokens:
        k = bisect_left(p.refs, t.start, at)
        at = k
        if k == len(p.refs):
            break
        if p.refs[k] >= t.start + len(t.content):
            continue
        node = t.surrounding
        if display and not is_display(node) and k + 1 < len(p) and p.string[k].isspace():
            cuts[k - 1] = k
        if under_header(node) != inside:
            inside = not inside
            cuts[k] = k
        display = is_display(node)
    out, begin = [], 0
    for _, cut in sorted(cuts.items()):
        piece = p[begin:cut].strip().normalize_spaces()
        if len(piece):
            out.append(piece)
        begin = cut
    return out


def split_words(p: Piece) -> list[Piece]:
    return [p[m.start() : m.end()] for m in _word.finditer(p.string)]


_SPAN = [pa.int32(), pa.string(), pa.list_(pa.int32())]


def markup_sentences(docs: DataFrame, *, id_col: str = "page_id", markup_col: str = "html", rules: Rules = DEFAULT_RULES, references: frozenset[str] | None = None) -> DataFrame:
    """(id, sent_no, string, refs) of marked-up documents.  For ``references`` see ``parse_html``."""

    def rows(markup):
        flat = Flat(parse_html(markup, references), rules)
        return ((k, s.string, s.refs) for k, s in enumerate(split_sentences(flat, Piece.whole(flat))))

    return per_document(docs, id_col, markup_col, rows, _SPAN, "sent_no int, string string, refs array<int>")


def markup_words(docs: DataFrame, *, id_col: str = "page_id", markup_col: str = "html", rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(id, sent_no, word_no, string, refs) of marked-up documents."""

    def rows(markup):
        flat = Flat(parse_html(markup), rules)
        for k, s in enumerate(split_sentences(flat, Piece.whole(flat))):
            for j, w in enumerate(split_words(s)):
                yield k, j, w.string, w.refs

    return per_document(docs, id_col, markup_col, rows, [pa.int32(), *_SPAN], "sent_no int, word_no int, string string, refs array<int>")


def rule_tags(words: Column) -> Column:
    """A stand-in for a trained tagger, inside the JVM: marks, numbers, capitals and a few endings."""

    def tag(w: Column) -> Column:
        low = F.lower(w)
        return (
            F.when(~F.rlike(w, F.lit(r"[\p{L}\p{N}]")), "PUNCT").when(F.rlike(w, F.lit(r"^\p{Nd}")), "NUM")
            .when(F.endswith(low, F.lit("ly")), "ADV").when(F.endswith(low, F.lit("ing")) | F.endswith(low, F.lit("ed")), "VERB")
            .when(F.rlike(w, F.lit(r"^\p{Lu}")), "PROPN").otherwise("NOUN")
        )

    return F.transform(words, tag)


def tag_words(c: Column, tagger: Callable[[list[str]], list[str]] | None = None) -> Column:
    """Tags of a column of word lists, by any function from words to tags, or by rules."""
    if tagger is None:
        return rule_tags(c)

    @arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        return pa.array((tagger(words.as_py()) if words.is_valid else None for words in lists), pa.list_(pa.string()))

    return run(c)
