"""Column functions on text, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as Python's str.isspace knows it, punctuation that is a word of its own, superscripts
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PUNCTUATION = r".,:;!?)(\[\]{}\-”“"
SUPERSCRIPTS = "⁻⁰¹²³⁴⁵⁶⁷⁸⁹"
PLAIN_DIGITS = "-0123456789"
DIMENSIONS = ("T", "L", "M", "I", "Θ", "N", "J")

# The same as intersections of negated parts.  Java tests a union of ranges by predicates of two interfaces in turn, for which
# all threads of a JVM write to one field of the class (JDK-8180450): six are then slower than one.  These scale.
_NO_WS = r"[^\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0]&&[^\u1680]&&[^\u2000-\u200a]&&[^\u2028-\u2029]&&[^\u202f]&&[^\u205f]&&[^\u3000]"
_NO_MARK = r"[^.,:;!?)(\[\]{}\-]&&[^\u201c-\u201d]"
SPACE = rf"[^[{_NO_WS}]]"
# Characters of words below 256, listed one by one: Java looks them up in a table, while the rest asks each part in turn
_LATIN = "".join(f"\\x{c:02x}" for c in range(256) if chr(c) not in " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0.,:;!?)([]{}-")
WORD = rf"[{_LATIN}]++[{_NO_WS}&&{_NO_MARK}]*+|[{_NO_WS}&&{_NO_MARK}]++|[^[{_NO_MARK}]]"
#: zero-width ends of sentences: a full stop unless a small letter, a digit between digits, a no-break space or , . : ; follows
SENTENCE_END = r"(?<=\.)(?![\p{IsLowercase}\xa0,.:;])(?!(?<=\p{Nd}\.)\p{Nd})|(?<=[!?])(?![\xa0,.:;])"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def normalize_spaces(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+", " ")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def sentences(c: Column) -> Column:
    """Stripped, space-normalised, non-empty sentences; what follows the last end isn't one."""
    parts = F.split(c, SENTENCE_END, -1)
    done = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.filter(F.transform(done, lambda s: normalize_spaces(strip(s))), lambda s: s != "")


def class_list(c: Column) -> Column:
    return F.coalesce(F.filter(F.split(c, rf"{SPACE}+"), lambda x: x != ""), F.array().cast("array<string>"))


def normal_id(c: Column) -> Column:
    """One trailing .html and all slashes go."""
    return F.translate(F.regexp_replace(c, r"\.html$", ""), "/", "")


def year_month(c: Column) -> Column:
    """The first four digits of the first run of digits, null where that is shorter (a bad id)."""
    return F.nullif(F.regexp_extract(c, r"^[^0-9]*([0-9]{4})", 1), F.lit(""))


def superscript(c: Column) -> Column:
    return F.translate(c.cast("string"), PLAIN_DIGITS, SUPERSCRIPTS)


def from_superscript(c: Column) -> Column:
    return F.translate(c, SUPERSCRIPTS, PLAIN_DIGITS)


def dimension_string(exponents: Column) -> Column:
    """Canonical form of a map symbol -> exponent: fixed order, exponents that aren't 0, '1' if none."""
    parts = [F.when(F.coalesce(F.try_element_at(exponents, F.lit(d)), F.lit(0)) != 0, F.concat(F.lit(d), superscript(F.try_element_at(exponents, F.lit(d))))) for d in DIMENSIONS]
    return F.coalesce(F.nullif(F.concat_ws("", *parts), F.lit("")), F.lit("1"))


def format_seconds(c: Column) -> Column:
    """Duration for people: ms, s, m or h, one decimal for small numbers of a unit, truncated for larger ones."""

    def whole(x):
        return x.cast("long").cast("string")

    def tenth(x):
        return F.format_string("%.1f", x)

    steps = [(2, whole(c * 1000), "ms"), (10, tenth(c), "s"), (120, whole(c), "s"), (600, tenth(c / 60), "m"), (7200, whole(c / 60), "m"), (36000, tenth(c / 3600), "h")]
    out = F.when(F.lit(False), F.lit(""))
    for limit, value, unit in steps:
        out = out.when(c < limit, F.concat(value, F.lit(f" {unit}")))
    return out.otherwise(F.concat(whole(c / 3600), F.lit(" h")))


def progress_bar(fraction: Column, width: int) -> Column:
    """[ and ] around full blocks, one block in eighths, and blanks."""
    full = F.floor(fraction * width).cast("int")
    eighths = F.floor(8 * (fraction * width - full)).cast("int")
    part = F.when(eighths > 0, F.substring(F.lit("▏▎▍▌▋▊▉"), eighths, F.lit(1))).otherwise(" ")
    return F.concat(F.lit("["), F.lpad(F.lit(""), full, F.lit("█")), part, F.lpad(F.lit(""), F.greatest(F.lit(width - 1) - full, F.lit(0)), F.lit(" ")), F.lit("]"))


def numeral(c: Column) -> Column:
    """Value of a number's text: digits and points count, all else is left out; null where that is no number."""
    return F.regexp_replace(c, r"[^\p{N}.]", "").try_cast("double")


def leading_number(c: Column) -> Column:
    """The number at the start (struct value, is_int, length), null where there is none or it has two points."""
    run = F.regexp_extract(c, r"^[0-9][0-9.]*", 0)
    points = F.length(run) - F.length(F.replace(run, F.lit("."), F.lit("")))
    return F.when((run != "") & (points <= 1), F.struct(F.regexp_replace(run, r"\.$", "").try_cast("double").alias("value"), (points == 0).alias("is_int"), F.length(run).alias("length")))
