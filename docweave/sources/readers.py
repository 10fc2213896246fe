"""Sources: documents in folders and zips, severities, categories, metadata, tables of the knowledge base, occurrences."""

from __future__ import annotations

import io
import gzip
import itertools
import re
import urllib.error
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import normal_id, year_month

OCCURRENCES = "arxivid string, certainty int, dnm_range string, unit_id int, unit_notation string, unit_notation_properties int, amount_notation int, amount_val double, re_amount_val double, re_unit_id int, re_unit_notation string, amount_center_val double, quantity array<int>, quantity_strings array<array<string>>, quantity_notation string, logs string"


class MissingData(ValueError):
    pass


class BadDocumentId(ValueError):
    pass


def zipped_lines(files: DataFrame, suffix: str = "", single: bool = False) -> DataFrame:
    """(path, member, line_no, value) of the text members of zip files in rows (path, content).

    A member is read as a stream, so its size isn't bounded by that of a value.  With ``single`` a zip must have exactly one.
    """

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    names = [n for n in z.namelist() if n.endswith(suffix) and not n.endswith("/")]
                    if single and len(names) != 1:
                        raise MissingData(f"a zip of one member is needed: {path}")
                    for name in names:
                        with z.open(name) as f:
                            lines = (line.rstrip(b"\n").decode("utf-8", "replace") for line in f)
                            at = 0
                            while some := list(itertools.islice(lines, 4096)):
                                yield pa.RecordBatch.from_pydict({"path": [path] * len(some), "member": [name] * len(some), "line_no": range(at, at + len(some)), "value": some})
                                at += len(some)

    return files.select("path", "content").mapInArrow(run, "path string, member string, line_no long, value string")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of text files read in parallel; line_no is a struct that orders lines as the files do."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(place.alias("line_no"), "value")


def require(spark: SparkSession, base: str, name: str) -> str:
    """The full path of a file that must be there."""
    path = f"{base.rstrip('/')}/{name}"
    if not _exists(spark, path):
        raise MissingData(f"{path} is missing")
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, folder: str | None, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of that name in a folder of finished results, built and written on first use; without a folder just built.

    A result counts as finished when its success mark is there, so a run that broke off is repeated.
    """
    if folder is None:
        return build()
    path = f"{folder.rstrip('/')}/{name}.parquet"
    if not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _files(spark: SparkSession, base: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(base).select("path", "content")


def _entries(spark: SparkSession, folder: str) -> dict[str, str]:
    """Full paths of a folder's entries by name; none where it isn't there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f.getPath().getName(): f.getPath().toString() for f in fs.listStatus(p)} if fs.exists(p) else {}


def _opened(path: str):
    """A file for random access, in a task; any file system that Arrow knows by its scheme."""
    fs, place = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.open_input_file(place)


def zip_members(zips: DataFrame) -> DataFrame:
    """(path, member) of zip files in rows (path); only their directories are read."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with zipfile.ZipFile(_opened(path)) as z:
                    names = [n for n in z.namelist() if not n.endswith("/")]
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(names), pa.string()), "member": pa.array(names, pa.string())})

    return zips.select("path").mapInArrow(run, "path string, member string")


def _html_places(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, yymm, path, member, prio) of every place a document is in, by names alone.

    prio orders the places of one document: the folder, data, yymm, data/yymm, the zips of both.  A yymm folder or zip
    serves ids of that yymm only.
    """
    found = spark.createDataFrame([], "path string, member string, prio int, folder string")
    zips = []
    for at, folder in enumerate((base.rstrip("/"), f"{base.rstrip('/')}/data")):
        entries = _entries(spark, folder)
        flat = [(path, None, at + 1, None) for name, path in entries.items() if name.endswith(".html")]
        months = [path for name, path in entries.items() if re.fullmatch("[0-9]{4}", name)]
        zips += [(path, at + 5) for name, path in entries.items() if re.fullmatch(r"[0-9]{4}\.zip", name)]
        if flat:
            found = found.union(spark.createDataFrame(flat, found.schema))
        if months:
            names = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(months).select("path")
            found = found.union(names.select("path", F.lit(None).cast("string"), F.lit(at + 3), F.regexp_extract("path", "([^/]*)/[^/]*$", 1)))
    if zips:
        packed = spark.createDataFrame(zips, "path string, prio int").repartition(len(zips), "path")
        inside = zip_members(packed).join(packed, "path").where(F.col("member").rlike(r"^[0-9]{4}/[^/]*\.html$"))
        month = F.regexp_extract("path", r"([0-9]{4})\.zip$", 1)
        found = found.union(inside.where(F.col("member").startswith(month)).select("path", "member", "prio", month))
    named = found.withColumn("doc_id", F.regexp_extract(F.coalesce("member", "path"), r"([^/]*)\.html$", 1))
    named = named.withColumn("yymm", year_month(F.col("doc_id")))
    return named.where((F.col("prio") <= 2) | (F.col("folder") == F.col("yymm"))).select("doc_id", "yymm", "path", "member", "prio")


def _read(places: DataFrame) -> DataFrame:
    """places with the markup in column html; only the named files and members are read."""

    def run(batches):
        path, opened = None, None
        for batch in batches:
            out = []
            for p, member in zip(batch.column("path").to_pylist(), batch.column("member").to_pylist()):
                if p != path or member is None:
                    path, opened = p, None
                if member is None:
                    with _opened(p) as f:
                        raw = f.read()
                else:
                    opened = opened or zipfile.ZipFile(_opened(p))
                    raw = opened.read(member)
                out.append(raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "html"])

    # a month's zip is read by several tasks at once, each at its own members
    dealt = places.repartition("path", F.pmod(F.xxhash64("member"), F.lit(16))).sortWithinPartitions("path", "member")
    return dealt.mapInArrow(run, StructType([*places.schema.fields, StructField("html", StringType())]))


def documents(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, yymm, html), each document from its first place.  Places are chosen by names, then read."""
    places = _html_places(spark, base)
    first = places.groupBy("doc_id", "yymm").agg(F.min_by(F.struct("path", "member"), "prio").alias("f"))
    return _read(first.select("doc_id", "yymm", "f.path", "f.member")).select("doc_id", "yymm", "html")


def open_document(spark: SparkSession, base: str, doc_id: str) -> str:
    """The markup of one document, from the first of its six places; no other file is read.

    Where the first zip of its month exists and lacks it, the second isn't tried.
    """
    row = spark.range(1).select(normal_id(F.lit(doc_id)).alias("i")).select("i", year_month(F.col("i")).alias("m")).first()
    if row["m"] is None:
        raise BadDocumentId(doc_id)
    root, name = base.rstrip("/"), f"{row['i']}.html"
    tried = [(f"{root}/{at}{name}", None) for at in ("", "data/", f"{row['m']}/", f"data/{row['m']}/")]
    tried += [(f"{root}/{at}{row['m']}.zip", f"{row['m']}/{name}") for at in ("", "data/")]
    place = next(((path, member) for path, member in tried if _exists(spark, path)), None)
    if place is not None:
        files = _entries(spark, place[0].rpartition("/")[0])
        place = files[place[0].rpartition("/")[2]], place[1]
        if place[1] is not None and zip_members(spark.createDataFrame([place[:1]], "path string")).where(F.col("member") == place[1]).isEmpty():
            place = None
    if place is None:
        raise MissingData(f"{doc_id} is at none of {[p if m is None else f'{p}:{m}' for p, m in tried]}")
    return _read(spark.createDataFrame([place], "path string, member string")).first()["html"]


def document_ids(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id,) of documents in month folders and zips, by names alone.

    Of several places for one month the first counts, and files outside of months don't.  Without a data folder this is
    an error.
    """
    require(spark, base, "data")
    places = _html_places(spark, base).where("prio > 2")
    # the folder of a place comes before its zip, all of the base before data
    rank = F.element_at(F.array(*[F.lit(x) for x in (1, 3, 2, 4)]), F.col("prio") - 2)
    ranked = places.withColumn("rank", rank)
    first = ranked.groupBy("yymm").agg(F.min("rank").alias("rank"))
    return ranked.join(first, ["yymm", "rank"], "left_semi").select("doc_id").distinct()


def severities(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, level) from meta/grouped_by_severity.zip."""
    lines = zipped_lines(_files(spark, f"{base.rstrip('/')}/meta", "grouped_by_severity.zip"), "-tasks.txt")
    lines = lines.select(F.regexp_extract("member", r"([^/]*)-tasks\.txt$", 1).alias("level"), F.trim(F.rtrim(F.col("value"), F.lit("\r"))).alias("line")).where("line <> ''")
    name = F.when(F.col("line").endswith(".html"), F.regexp_replace("line", r"\.html$", "")).otherwise(F.raise_error(F.concat(F.lit("no .html: "), "line")).cast("string"))
    return lines.select(name.alias("doc_id"), "level")


def categories(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pos, cat) from lines ``id: cat, cat``."""
    parts = F.split(F.col("value"), ":")
    checked = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("bad line: "), "value")).cast("array<string>"))
    return spark.read.text(path).where("value <> ''").select(checked.alias("p")).select(F.col("p")[0].alias("doc_id"), F.posexplode(F.split(F.trim(F.col("p")[1]), ", ")).alias("pos", "cat"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, cats) from JSON lines, plain or as the one member of a zip; of repeated ids the last line counts."""
    if path.endswith(".zip"):
        members = zipped_lines(spark.read.format("binaryFile").load(path), single=True)
        lines = members.select(F.struct("path", "line_no").alias("line_no"), "value")
    else:
        lines = ordered_lines(spark, path)
    rows = lines.where("trim(value) <> ''").select("line_no", F.from_json("value", "id string, categories string").alias("j"))
    last = rows.groupBy(F.col("j.id").alias("doc_id")).agg(F.max_by("j.categories", "line_no").alias("c"))
    return last.select("doc_id", F.filter(F.split(F.trim("c"), r"\s+"), lambda x: x != "").alias("cats"))


def fetched_csv(endpoint: str, query: str, folder: str, name: str, timeout: float = 300) -> str:
    """Path of the gzipped CSV answer of a query service; asked only where the file isn't there yet.

    An answer without success is an error, and a broken download leaves no file.
    """
    target = Path(folder, f"{name}.csv.gz")
    if not target.exists():
        request = urllib.request.Request(f"{endpoint}?{urllib.parse.urlencode({'query': query})}", headers={"Accept": "text/csv"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                body = answer.read()
        except urllib.error.HTTPError as e:
            raise MissingData(f"{endpoint} answered {e.code}") from e
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_suffix(".part")
        part.write_bytes(gzip.compress(body, 3))
        part.rename(target)
    return str(target)


def checked_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV (or .csv.gz) whose first columns must have these names."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    if df.columns[: len(columns)] != columns:
        raise MissingData(f"{path} has columns {df.columns}")
    return df.select(*columns)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("doc_id")).where("doc_id <> ''")


def relevance_list(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, nxref, ntext, ninter, nmrow, line_no) of a CSV without header."""
    lines = ordered_lines(spark, path).withColumnRenamed("value", "v").where("trim(v) <> ''")
    p = F.split("v", ",")
    return lines.select(p[0].alias("doc_id"), *[F.trim(p[k]).cast("int").alias(n) for k, n in enumerate(("nxref", "ntext", "ninter", "nmrow"), 1)], "line_no")


def occurrence_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OCCURRENCES).json(path)
