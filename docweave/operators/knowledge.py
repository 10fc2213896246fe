"""Units and quantities: notations, dimensions and the tables to look them up in.

The knowledge base is small (thousands of rows), so its parsers run as Python functions; everything that meets the
corpus is a join.
"""

from __future__ import annotations

import functools
import json
import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DIMENSIONS, PLAIN_DIGITS, SUPERSCRIPTS
from ..session import release, stored

LIST_MARK = "❙"
# Certainties, origins of an entry (flags), kinds of notations and their number of children
CERTAINTY = {"CERTAINLY_NOT": 0, "PROBABLY_NOT": 1, "UNKNOWN": 2, "PROBABLY": 3, "LIKELY": 4, "CERTAINLY_YES": 5}
ORIGIN = {"MANUAL": 1, "WIKIDATA": 2, "COMBINED": 4, "GUESS": 8, "CONFIRMED": 16, "UNKNOWN": 32}
ARITY = {"i": 0, "sup": 2, "sub": 2, "subsup": 3, "seq": None}
_from_superscript = str.maketrans(SUPERSCRIPTS, PLAIN_DIGITS)
_to_superscript = str.maketrans(PLAIN_DIGITS, SUPERSCRIPTS)


# ---- notations: nested [kind, attributes, children], identified by their JSON


def notation(kind: str, attrs: dict | None = None, children: list | None = None) -> list:
    children = children or []
    if kind not in ARITY or ARITY[kind] not in (None, len(children)):
        raise ValueError(f"{kind} with {len(children)} children")
    return [kind, dict(sorted((attrs or {}).items())), children]


def notation_json(n: list) -> str:
    return json.dumps(n, sort_keys=False)


def notation_from_json(s: str) -> list:
    kind, attrs, children = json.loads(s)
    return notation(kind, attrs, [notation_from_json(json.dumps(c)) for c in children])


def unit_json(parts: list[tuple[list, int]]) -> str:
    """Identity of a product of notations with exponents, in the given order."""
    return json.dumps([[n, e] for n, e in parts])


_UNIT = re.compile(rf"(?P<power>[{SUPERSCRIPTS}]+)|(?P<over>/)|(?P<gap>\s+)|(?P<text>[^\s/{SUPERSCRIPTS}]+)")


def _opened(name: str, text: str) -> str:
    """A name and more text, without the closing brackets that nothing in it opens."""
    whole = name + text
    at = whole.find("(")
    return whole.replace(")", "") if at < 0 else whole[:at].replace(")", "") + whole[at:]


def parse_unit(s: str) -> list[tuple[list, int]]:
    """Parts of a unit written like m/s², kg m s⁻² or A/(m s).

    Lexemes are folded into rows (name, superscripts, sign), the last of them still open.  All behind the first stroke is
    below it, where brackets mean nothing.
    """
    rows = [["", "", 1]]
    for m in _UNIT.finditer(re.sub(r"(?<!\s)\s\(", "(", s)):
        name, power, sign = rows[-1]
        match m.lastgroup:
            case "power":
                rows[-1][1] += m[0].translate(_from_superscript)
            case "over":
                rows.append(["", "", -1])
            case "gap":
                rows.append(["", "", sign])
            case "text":
                text = m[0] if sign > 0 else m[0].replace("(", "")
                if power:
                    kept, text = (")", text[1:]) if text[:1] == ")" and "(" in name else ("", text.lstrip(")"))
                    if kept or text:
                        rows.append([kept + _opened("", text), "", sign])
                else:
                    rows[-1][0] = _opened(name, text)
    return [(notation("i", {"val": name}), sign * int(power or 1)) for name, power, sign in rows if name or power]


# ---- dimensions


def dimension_key(exponents: dict[str, int]) -> str:
    unknown = set(exponents) - set(DIMENSIONS)
    if unknown:
        raise ValueError(f"unknown dimensions {sorted(unknown)}")
    return "".join(d + str(exponents[d]).translate(_to_superscript) for d in DIMENSIONS if exponents.get(d)) or "1"


def dimension_from_mathml(markup: str) -> str:
    """Key of a dimension written as MathML: each child of an mstyle is a symbol, a power, or 1."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    texts = lambda e, kind: [x.text or "" for x in e.iter() if local(x) == kind]
    out: dict[str, int] = {}
    for style in (e for e in ET.fromstring(markup).iter() if local(e) == "mstyle"):
        for child in style:
            match local(child):
                case "mn":
                    if (child.text or "").strip() != "1":
                        raise ValueError(child.text)
                    continue
                case "mi":
                    symbol, power = (child.text or "").strip(), 1
                case "mrow":
                    symbol, power = texts(child, "mi")[0].strip(), 1
                case "msup":
                    symbol = texts(child, "mi")[0].strip()
                    power = int(texts(child, "mn")[0]) * (-1 if texts(child, "mo") else 1)
                case other:
                    raise ValueError(f"unexpected {other}")
            if symbol in out:
                raise ValueError(f"{symbol} twice")
            out[symbol] = power
    return dimension_key(out)


# ---- staging of raw tables


def last_segment(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def list_items(c: Column) -> Column:
    return F.coalesce(F.filter(F.split(c, LIST_MARK), lambda x: x != ""), F.array().cast("array<string>"))


def quantity_table(raw: DataFrame) -> DataFrame:
    """(id, label, dimension, parents, latex) from rows (quantity, quantityLabel, dimension, super_quantities, symbols_ltx)."""
    parse = F.udf(lambda m: dimension_from_mathml(m) if m else None)
    base = raw.select(last_segment(F.col("quantity")).alias("id"), F.col("quantityLabel").alias("label"), parse("dimension").alias("dimension"), F.transform(list_items(F.col("super_quantities")), last_segment).alias("p"), list_items(F.col("symbols_ltx")).alias("latex"))
    known = base.select(F.col("id").alias("parent"))
    parents = base.select("id", F.posexplode("p").alias("pos", "parent")).join(known, "parent", "left_semi").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "parent"))), lambda x: x["parent"]).alias("parents"))
    seen = F.count(F.lit(1)).over(Window.partitionBy("id"))
    base = base.withColumn("id", F.when(seen > 1, F.raise_error(F.concat(F.lit("quantity twice: "), "id")).cast("string")).otherwise(F.col("id")))
    return base.join(parents, "id", "left").select("id", "label", "dimension", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"), "latex")


def inherit_dimensions(rows: list[tuple[str, str | None, list[str]]]) -> dict[str, str | None]:
    """A quantity without dimension takes that of its first parent that has one; in table order, until nothing changes."""
    dims = {i: d for i, d, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, _, parents in rows:
            if dims[i] is None and parents and dims.get(parents[0]) is not None:
                dims[i] = dims[parents[0]]
                changed = True
    return dims


def inherited(quantities: DataFrame, id_col: str = "id") -> DataFrame:
    """The same as joins: each round a quantity without dimension looks at its first parent, until nothing changes.

    One whose parent has none either looks at the parent's parent next, so rounds grow with the logarithm of the depth.
    """
    known = stored(quantities.select(id_col, "dimension", F.try_element_at("parents", F.lit(1)).alias("p")), "dimensions")
    while True:
        above = known.select(F.col(id_col).alias("p"), F.col("dimension").alias("d"), F.col("p").alias("pp"))
        new = known.join(above, "p", "left").select(id_col, F.coalesce("dimension", "d").alias("dimension"), F.when(F.col("d").isNull(), F.col("pp")).otherwise(F.col("p")).alias("p"))
        new = stored(new, "dimensions")
        release(known)
        known = new
        given = known.where("dimension is not null").select(F.col(id_col).alias("p"))
        if known.where("dimension is null").join(given, "p", "left_semi").isEmpty():
            return known.select(id_col, "dimension")


def unit_table(raw: DataFrame, quantities: DataFrame) -> DataFrame:
    """(unit_id, id, label, alt_labels, notations, quantities, dimension, factor, si_unit) from raw unit rows.

    unit_id counts from 0 in order of the source id.  The dimension is that of the last listed quantity that has one.
    """
    base = raw.select(last_segment(F.col("unit")).alias("id"), F.col("unitLabel").alias("label"), list_items(F.col("altLabels")).alias("alt_labels"), F.array_sort(F.array_distinct(list_items(F.col("notations")))).alias("notations"), F.transform(list_items(F.col("quantities")), last_segment).alias("q"), F.try_element_at(list_items(F.col("SIamounts")), F.lit(1)).try_cast("double").alias("factor"), last_segment(F.col("SIunit")).alias("si_unit"))
    dims = quantities.select(F.col("id").alias("quantity"), "dimension")
    listed = base.select("id", F.posexplode("q").alias("pos", "quantity")).join(dims, "quantity").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "quantity"))), lambda x: x["quantity"]).alias("quantities"), F.max_by("dimension", F.when(F.col("dimension").isNotNull(), F.col("pos"))).alias("dimension"))
    numbered = base.withColumn("unit_id", F.row_number().over(Window.orderBy("id")) - 1)
    return numbered.join(listed, "id", "left").select("unit_id", "id", "label", "alt_labels", "notations", F.coalesce("quantities", F.array().cast("array<string>")).alias("quantities"), "dimension", "factor", "si_unit")


def link_si(units: DataFrame) -> DataFrame:
    """units with the label of their SI unit; a named SI unit that is missing is an error."""
    si = units.select(F.col("id").alias("si_unit"), F.col("label").alias("si_label"))
    joined = units.join(si, "si_unit", "left")
    return joined.withColumn("si_label", F.when(F.col("si_unit").isNotNull() & F.col("si_label").isNull(), F.raise_error(F.concat(F.lit("no such unit: "), "si_unit")).cast("string")).otherwise(F.col("si_label")))


def label_index(units: DataFrame) -> DataFrame:
    """(label, unit ids): the label always, other labels of more than four characters."""
    every = units.select("label", "id").union(units.select(F.explode("alt_labels"), "id").toDF("label", "id").where(F.length("label") > 4))
    return every.groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def find_units(labels: DataFrame, index: DataFrame) -> DataFrame:
    """(label, ids) for each row of labels; an unknown label has no ids."""
    return labels.join(index, "label", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


def notation_index(units: DataFrame) -> DataFrame:
    """(notation, unit_id, unit_ids): parsed notations with all units that have them, the first of these apart."""
    parse = F.udf(lambda s: unit_json(parse_unit(s)))
    every = units.select("unit_id", F.explode("notations").alias("n")).select("unit_id", parse("n").alias("notation"))
    return every.groupBy("notation").agg(F.min("unit_id").alias("unit_id"), F.array_sort(F.collect_set("unit_id")).alias("unit_ids"))


def knowledge_base(raw_units: DataFrame, raw_quantities: DataFrame) -> dict[str, DataFrame]:
    """The whole knowledge base from the raw tables: units, quantities, names, notations, and unit_quantities.

    Every entry says where it is from (flags of ORIGIN); a unit's dimension is certain, and notations are partly guessed
    as they are parsed from text.
    """
    origin = lambda *names: F.lit(sum(ORIGIN[n] for n in names)).alias("creation")
    found = quantity_table(raw_quantities)
    quantities = found.drop("dimension").join(inherited(found), "id", "left")
    numbered = quantities.withColumn("quantity_id", F.row_number().over(Window.orderBy("id")) - 1)
    units = link_si(unit_table(raw_units, quantities))
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", F.explode(F.array_distinct(F.concat(F.array("label"), "alt_labels"))).alias("name"), origin("WIKIDATA"))
    return {
        "units": units.select("unit_id", "id", "label", "dimension", F.when(F.col("dimension").isNotNull(), CERTAINTY["CERTAINLY_YES"]).alias("dimension_certainty"), "factor", "si_unit", "si_label", origin("WIKIDATA")),
        "quantities": numbered.select("quantity_id", "id", "label", "dimension", "parents", "latex", origin("WIKIDATA")),
        "names": named(units, "unit").union(named(quantities.withColumn("alt_labels", F.array().cast("array<string>")), "quantity")),
        "notations": notation_index(units).select("notation", F.explode("unit_ids").alias("unit_id"), origin("WIKIDATA", "GUESS")),
        "unit_quantities": units.select("unit_id", F.explode("quantities").alias("quantity"), origin("WIKIDATA")),
    }


def resolve(finds: DataFrame, index: DataFrame) -> DataFrame:
    """Finds with the unit of their notation; those without one are left out (see unresolved)."""
    return finds.join(index.select("notation", "unit_id"), F.col("unit_notation") == F.col("notation")).drop("notation")


def unresolved(finds: DataFrame, index: DataFrame) -> DataFrame:
    return finds.join(index, finds["unit_notation"] == index["notation"], "left_anti")


# ---- graph queries on (subj, pred, obj) triples


def with_triples(triples: DataFrame, more: DataFrame) -> DataFrame:
    """A graph holds each triple once."""
    return triples.select("subj", "pred", "obj").union(more.select("subj", "pred", "obj")).distinct()


def mark_present(triples: DataFrame, kind: str) -> DataFrame:
    """triples with a mark that those of a kind are complete."""
    return with_triples(triples, triples.sparkSession.createDataFrame([("base", "has-metadata", kind)], "subj string, pred string, obj string"))


def is_present(triples: DataFrame, kind: str) -> bool:
    return not objects(triples, "base", "has-metadata").where(F.col("obj") == kind).isEmpty()


def subjects(triples: DataFrame, pred: str, obj: str) -> DataFrame:
    return triples.where((F.col("pred") == pred) & (F.col("obj") == obj)).select("subj")


def objects(triples: DataFrame, subj: str, pred: str) -> DataFrame:
    return triples.where((F.col("subj") == subj) & (F.col("pred") == pred)).select("obj")


def subclasses(triples: DataFrame, root: str, pred: str = "subclass") -> DataFrame:
    """(id,) of all below root, itself included.  One round a level; cycles end where nothing new is found."""
    edges = triples.where(F.col("pred") == pred).select(F.col("subj").alias("id"), F.col("obj").alias("up"))
    front = triples.sparkSession.createDataFrame([(root,)], "id string")
    levels = [front]
    while True:
        found = functools.reduce(DataFrame.union, levels)
        front = stored(edges.join(front.withColumnRenamed("id", "up"), "up", "left_semi").select("id").distinct().join(found, "id", "left_anti"), "subclasses")
        if front.isEmpty():
            return found
        levels.append(front)


def grouped_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values of each key, sorted, in one string."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), LIST_MARK).alias("values"))
