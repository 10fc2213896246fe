"""Removal of repeated byte strings by the interval tree of sparse enhanced suffix arrays.

A string of ``LENGTH`` bytes that occurs twice is found through an anchor: of all its ``GRAM``-byte grams the one with the
smallest hash (leftmost of equals).  The choice depends on the string alone, so all its occurrences have the same anchor
at the same offset, and about one byte in 70 is an anchor.  What can decide about windows around an anchor is its context:
the ``REACH`` = LENGTH - GRAM bytes before it and the LENGTH bytes from it on.

1. One scan of the texts writes all anchors with the hashes of gram and context; those whose gram occurs once go.
   Equal contexts are one class, so copies cost one row from here on; every window of a context that occurs twice is
   repeated.
2. Where a gram has several classes, some of them single, the contexts of its classes are read and sorted by what follows
   the gram: a suffix array of the occurrences, with common-prefix lengths.  A stack scan yields its common-prefix
   intervals; each one's left extensions are sorted and scanned alike.  A group of occurrences that differ in the next
   byte on both sides is a maximal repeat, with all of its occurrences, not just neighbours in the array.
3. A gram with more than ``GROUP`` classes is split until each part fits a task.  The windows whose anchor it is (REACH + 1
   at most) are dealt to ranges of ``STEP``.  All windows of a range hold the same inner bytes and lie in the same outer bytes, so
   only classes of equal inner bytes can share one, and classes of equal outer bytes share all: those are done, and one of
   them stands for them.  Parts of equal inner bytes are scanned as in 2; where one still is too large, its ranges are cut
   to single windows, and classes of an equal window are the group.  Rows are at most 12 a class of such a gram, and 12
   more for each range that is cut; no pairs are made.
4. Spans are gathered per document and cut out of the text; strings are judged on the input.

Occurrences in other documents and in the same document count alike, matches never cross documents, and nothing is
capped.  Memory: a group of GROUP contexts of 336 bytes, a piece of a megabyte of a long text, or one whole text.
Grams, contexts and inner and outer bytes are compared by 64-bit hashes, always within the same gram.

Defined results: null texts are empty; texts shorter than LENGTH lose nothing; rows of equal id and text are occurrences
of their own and so remove each other; null ids are kept as null; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, RangeHash, chunks, groups_of, mix, text_buffer
from .runtime import release, stored

LENGTH = 200
GRAM = 64
REACH = LENGTH - GRAM
GROUP = 4096
STEP = 12
PIECE = 1 << 20
POSITION = U64(PIECE - 1)


def window_anchors(size: int, ranges: RangeHash) -> np.ndarray:
    """Position of the anchor of each window of a buffer of at most PIECE bytes."""
    windows = size - LENGTH + 1
    low = (ranges.grams(GRAM)[: size - GRAM + 1] & ~POSITION) | np.arange(size - GRAM + 1, dtype=np.uint64)
    span, width = LENGTH - GRAM + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return (np.minimum(low[:windows], low[span - width : span - width + windows]) & POSITION).astype(np.int64)


def anchors(size: int, offs: np.ndarray, ranges: RangeHash) -> np.ndarray:
    """Positions of all anchors of the texts in a buffer of at most PIECE bytes."""
    windows = size - LENGTH + 1
    if windows <= 0:
        return np.zeros(0, np.int64)
    inside = np.zeros(size + 1, np.int32)
    long = np.diff(offs) >= LENGTH
    np.add.at(inside, offs[:-1][long], 1)
    np.add.at(inside, offs[1:][long] - LENGTH + 1, -1)
    return np.unique(window_anchors(size, ranges)[np.cumsum(inside)[:windows] > 0])


def _hashes(at: np.ndarray, start: np.ndarray, end: np.ndarray, ranges: RangeHash) -> tuple[np.ndarray, np.ndarray]:
    return ranges.of(at, at + GRAM), mix(ranges.of(start, end) ^ mix((at - start).astype(U64) * U64(1009) + (end - at).astype(U64)))


def scan(buf: np.ndarray, offs: np.ndarray):
    """(text number, place in the text, gram hash, context hash) of all anchors; a long text goes in pieces."""
    n = len(buf)
    if n <= PIECE:
        ranges = RangeHash(buf)
        at = anchors(n, offs, ranges)
        doc = np.searchsorted(offs, at, "right") - 1
        return doc, at - offs[doc], *_hashes(at, np.maximum(offs[doc], at - REACH), np.minimum(offs[doc + 1], at + LENGTH), ranges)
    parts = []
    for a in range(0, n - LENGTH + 1, PIECE - LENGTH + 1):
        size = min(n, a + PIECE) - a
        at = a + anchors(size, np.array([0, size]), RangeHash(buf[a : a + size]))
        x, y = max(0, a - REACH), min(n, a + size + LENGTH)
        start, end = np.maximum(0, at - REACH), np.minimum(n, at + LENGTH)
        parts.append((at, *_hashes(at - x, start - x, end - x, RangeHash(buf[x:y]))))
    at, gram, context = (np.concatenate(p) for p in zip(*parts))
    at, once = np.unique(at, return_index=True)
    return np.zeros(len(at), np.int64), at, gram[once], context[once]


def _scan_rows(batches):
    for batch in batches:
        k, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, _, buf, offs in chunks(*text_buffer(batch.column(2)), limit=PIECE):
            doc, place, gram, context = scan(buf, offs)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(k[a + doc]), pa.array(t[a + doc]), pa.array(place.astype(np.int32))], names=["g", "c", "k", "t", "p"])


ROWS = 20000
CLASS = {"g": pa.int64(), "c": pa.int64(), "n": pa.int64(), "k": pa.int64(), "t": pa.int64(), "p": pa.int32()}
CONTEXT = CLASS | {"size": pa.int64(), "lhs": pa.binary(), "rhs": pa.binary()}
FOUND = CLASS | {"r": pa.int64(), "lhs": pa.int32(), "rhs": pa.int32()}
RANGE = CLASS | {"a": pa.int32(), "left": pa.int32(), "right": pa.int32(), "inner": pa.int64(), "outer": pa.int64()}


def _ddl(columns: dict) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{name} {kinds[t]}" for name, t in columns.items())


def _batch(rows: list[tuple], columns: dict) -> pa.RecordBatch:
    c = list(zip(*rows)) if rows else [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, columns.values())], names=list(columns))


def _contexts(batches):
    """The context of each wanted class; rows come sorted by id and text, and repeated ones give theirs once."""
    rows, last = [], None
    for batch in batches:
        for k, t, text, wanted in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), batch.column("text"), batch.column("wanted")):
            if (k, t) == last:
                continue
            last = k, t
            raw = text.as_py().encode("utf-8", "surrogatepass")
            for w in wanted.as_py():
                p = w["p"]
                rows.append((w["g"], w["c"], w["n"], k, t, p, w["size"], raw[max(0, p - REACH) : p], raw[p : p + LENGTH]))
            if len(rows) > ROWS:
                yield _batch(rows, CONTEXT)
                rows = []
    yield _batch(rows, CONTEXT)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int]):
    """(depth, first, last) of the common-prefix intervals of a suffix array, inner ones first; lcp[i] is that of i and i + 1."""
    stack: list[list[int]] = []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append([depth, first])


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int = LENGTH):
    """(bytes before the gram, bytes from it on, members) of the maximal repeats of at least ``length`` bytes.

    lefts are reversed.  Members are all occurrences of the repeat; they differ in what comes next on either side.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [common_prefix(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    place = {m: i for i, m in enumerate(order)}
    for depth, first, last in intervals(lcp):
        members = sorted(order[first : last + 1], key=lefts.__getitem__)
        shared = [common_prefix(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        if max(shared) < length - depth:
            continue
        for left, a, b in intervals(shared):
            if left < length - depth:
                continue
            group = members[a : b + 1]
            at = [place[m] for m in group]
            # what the outermost of them share, all do; if that is more, the group belongs to an inner interval
            if common_prefix(rights[order[min(at)]], rights[order[max(at)]]) == depth:
                yield left, depth, group


def repeats(lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> list[tuple[int, int]]:
    """How far each occurrence of a gram is repeated: (bytes before it, bytes from it on), (0, 0) for those that aren't."""
    if len(rights) == 2:
        left, right = common_prefix(*lefts), common_prefix(*rights)
        return [(left, right) if left + right >= length else (0, 0)] * 2
    out = [(0, 0)] * len(rights)
    for left, right, group in maximal_repeats(lefts, rights, length):
        for m in group:
            out[m] = max(out[m][0], left), max(out[m][1], right)
    return out


def _classes_of(batches, keys: list[str]):
    """The classes of each group, one row each."""
    for group in groups_of(batches, keys):
        rows = {r[1]: r for r in zip(*(group.column(x).to_pylist() for x in (*CLASS, "lhs", "rhs")))}
        yield list(rows.values())


def _interval_rows(keys: list[str], every: bool):
    """Spans of the single classes of each group, one each; with ``every`` all classes of each maximal repeat."""

    def run(batches):
        done = []
        for rows in _classes_of(batches, keys):
            lefts, rights = [r[-2][::-1] for r in rows], [r[-1] for r in rows]
            if every:
                copied = [(len(lefts[m]), len(rights[m]), [m]) for m, r in enumerate(rows) if r[2] > 1]
                for left, right, group in itertools.chain(copied, maximal_repeats(lefts, rights)):
                    ranges = RangeHash(np.frombuffer(lefts[group[0]][:left][::-1] + rights[group[0]][:right], np.uint8))
                    # a string none of whose windows has its anchor here may occur where this gram is no anchor
                    if (window_anchors(left + right, ranges) == left).any():
                        name = int(ranges.of(np.array([0]), np.array([left + right])).view(np.int64)[0])
                        done += [(*rows[m][:-2], name, left, right) for m in group]
            elif len(rows) > 1:
                done += [(*r[:-2], 0, left, right) for r, (left, right) in zip(rows, repeats(lefts, rights)) if right and r[2] == 1]
            if len(done) > ROWS:
                yield _batch(done, FOUND)
                done = []
        yield _batch(done, FOUND)

    return run


def _window_ranges(step: int, whole: int = REACH + 1):
    """A row for each range of ``step`` windows that a context has some of: their outer extent, the hashes of inner and outer bytes.

    Windows begin a to a + step - 1 bytes before the gram; ranges cover ``whole`` of them from the row's column a on
    (from 0 where it has none).  Only windows count whose anchor the gram is, others have theirs; they lie side by side.
    A range that a context has a window of it has the inner bytes of.
    """

    def run(batches):
        for batch in batches:
            parts = []
            begin = batch.column("a").to_pylist() if "a" in batch.schema.names else [0] * batch.num_rows
            for i, (b, lhs, rhs) in enumerate(zip(begin, batch.column("lhs").to_pylist(), batch.column("rhs").to_pylist())):
                p, ranges = len(lhs), RangeHash(np.frombuffer(lhs + rhs, np.uint8))
                own = p - np.flatnonzero(window_anchors(p + len(rhs), ranges) == p)
                a = np.arange(b, min(b + whole, REACH + 1), step)
                last = np.minimum(a + step - 1, REACH)
                near, far = np.maximum(a, own.min()), np.minimum(last, own.max())
                a, last, near, far = (x[near <= far] for x in (a, last, near, far))
                if len(a):
                    outer = mix(ranges.of(p - far, p + LENGTH - near) ^ mix((near * 1009 + far).astype(U64)))
                    parts.append((np.full(len(a), i), a, far, LENGTH - near, ranges.of(p - a, p + LENGTH - last).view(np.int64), outer.view(np.int64)))
            if parts:
                at, *found = (np.concatenate(x) for x in zip(*parts))
                kept = [batch.column(x).take(pa.array(at)) for x in CLASS]
                kinds = list(RANGE.values())[len(CLASS) :]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, t) for x, t in zip(found, kinds))], names=list(RANGE))

    return run


def _equal_outer(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of parts whose outer bytes another has, rows of parts with ``same``, how many have their outer bytes, for the first of each)."""
    key = ["g", "a", "outer"]
    same = parts.groupBy(*key).agg(F.count(F.lit(1)).alias("same"), F.min("c").alias("head"))
    return parts.join(same.where("same > 1").select(key), key, "left_semi"), parts.join(same, key).where("c = head").drop("head")


def _split_rows(contexts: DataFrame, every: bool) -> DataFrame:
    """What ``_interval_rows`` gives, for grams of too many classes."""
    found = [F.col(x) for x in CLASS], [F.xxhash64("g", "outer").alias("r"), F.col("left").alias("lhs"), F.col("right").alias("rhs")]
    wanted = F.lit(True) if every else F.col("n") == 1
    key = ["g", "a", "inner"]
    parts = stored(contexts.mapInArrow(_window_ranges(STEP), _ddl(RANGE)), "ranges")
    shared, heads = _equal_outer(parts)
    if every:  # a class that stands for others would hide them
        heads = parts.withColumn("same", F.lit(1))
    sizes = heads.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    bytes_ = contexts.select("g", "c", "lhs", "rhs")
    open_ = stored(heads.withColumn("n", F.when(F.col("same") > 1, F.lit(2)).otherwise(F.col("n"))).join(sizes, key).select(*CLASS, "a", "inner", "size").join(bytes_, ["g", "c"]), "range-bytes")
    small = open_.where(F.col("size") <= GROUP).select(*CLASS, "a", "inner", "lhs", "rhs")
    small = small.repartition(*key).sortWithinPartitions(*key).mapInArrow(_interval_rows(key, every), _ddl(FOUND))
    windows = stored(open_.where(F.col("size") > GROUP).mapInArrow(_window_ranges(1, STEP), _ddl(RANGE)), "windows")
    out = small
    for rows in (shared, _equal_outer(windows)[0]):
        out = out.unionByName(rows.where(wanted).select(*found[0], *found[1]))
    return out


def _occurrences(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, c, k, t, p) of the anchors whose gram occurs again, and their classes (g, c, n and k, t, p of one of them)."""
    found = stored(docs.mapInArrow(_scan_rows, "g long, c long, k long, t long, p int"), "anchors")
    # written first, so that a frequent gram's rows can be split over tasks in the join
    twice = stored(found.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("g"), "repeated-grams")
    near = stored(found.join(twice, "g", "left_semi"), "near-anchors")
    release(found, twice)
    first = [F.first(x).alias(x) for x in ("k", "t", "p")]
    return near, stored(near.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), *first), "classes")


def _found(docs: DataFrame, classes: DataFrame, every: bool) -> DataFrame:
    """Rows FOUND: how far classes are repeated elsewhere."""
    grams = classes.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("n") == 1).alias("singles"))
    grams = stored(grams.select("g", "size") if every else grams.where("size > 1 and singles > 0").select("g", "size"), "open-grams")
    open_ = stored(classes.join(grams, "g"), "open-classes")
    wanted = open_.groupBy("k", "t").agg(F.collect_list(F.struct("g", "c", "n", "p", "size")).alias("wanted"))
    contexts = docs.join(wanted, ["k", "t"]).sortWithinPartitions("k", "t").mapInArrow(_contexts, _ddl(CONTEXT))
    contexts = stored(contexts, "context-bytes")
    small = contexts.where(F.col("size") <= GROUP).select(*CLASS, "lhs", "rhs")
    out = small.repartition("g").sortWithinPartitions("g").mapInArrow(_interval_rows(["g"], every), _ddl(FOUND))
    if not open_.where(F.col("size") > GROUP).isEmpty():
        out = out.unionByName(_split_rows(contexts.where(F.col("size") > GROUP).drop("size"), every))
    out = stored(out, "found")
    release(grams, open_, contexts)
    return out


LOWEST = -(2**63)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("k"), F.xxhash64(text).alias("t"), text.alias("text"))


def _spans(docs: DataFrame) -> DataFrame:
    """(k, t, spans): repeated byte ranges (lo, hi) of each text that has any, by id key and text hash."""
    near, classes = _occurrences(docs)
    single = _found(docs, classes, False).select("k", "t", (F.col("p") - F.col("lhs")).alias("lo"), (F.col("p") + F.col("rhs")).alias("hi"))
    copies = near.join(classes.where("n > 1").select("g", "c"), ["g", "c"], "left_semi")
    copies = copies.select("k", "t", F.greatest(F.col("p") - REACH, F.lit(0)).alias("lo"), (F.col("p") + LENGTH).alias("hi"))
    out = stored(single.union(copies).groupBy("k", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    release(near, classes)
    return out


CUT = "k long, n_bytes long, kept binary, removed array<struct<start:int,end:int>>"
_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _cut(batches):
    for batch in batches:
        rows = []
        for k, text, spans in zip(batch.column("k").to_pylist(), batch.column("text"), batch.column("spans")):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            kept, runs, at = [], [], 0
            if spans.is_valid:
                flat = spans.values
                lo, hi = flat.field("lo").to_numpy(), np.minimum(flat.field("hi").to_numpy(), len(raw))
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
                for a, b in zip(lo[new].tolist(), hi[np.append(new[1:] - 1, len(hi) - 1)].tolist()):
                    kept.append(raw[at:a])
                    runs.append({"start": a, "end": b})
                    at = b
            kept.append(raw[at:])
            rows.append((k, len(raw), b"".join(kept), runs))
        yield _batch(rows, {"k": pa.int64(), "n_bytes": pa.int64(), "kept": pa.binary(), "removed": _RUNS})


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, kept, removed) for each row of docs: the bytes left of its text, and the maximal removed runs (start, end) in order.

    kept may cut characters in two, so it is binary.
    """
    rows = _keyed(docs, id_col, text_col)
    out = rows.join(_spans(rows), ["k", "t"], "left").select("k", "text", "spans").mapInArrow(_cut, CUT)
    return out.select(F.nullif("k", F.lit(LOWEST)).alias(id_col), "n_bytes", "kept", "removed")


def repeat_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(repeat, n_bytes, id, start): all occurrences of each maximal repeat, cut off at the contexts of its anchors.

    repeat is a hash of the repeat's bytes.  Of grams of more than GROUP classes, repeats are given by the outer bytes of
    ranges of windows.
    """
    rows = _keyed(docs, id_col, text_col)
    near, classes = _occurrences(rows)
    found = _found(rows, classes, True).select("g", "c", "r", "lhs", "rhs").distinct()
    out = found.join(near, ["g", "c"]).select(F.col("r").alias("repeat"), (F.col("lhs") + F.col("rhs")).alias("n_bytes"), F.nullif("k", F.lit(LOWEST)).alias(id_col), (F.col("p") - F.col("lhs")).alias("start"), "t")
    # an occurrence may have several anchors
    return out.distinct().drop("t")
