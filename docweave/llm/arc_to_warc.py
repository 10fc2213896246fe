"""Legacy archives to WARC, and back to rows.

``write_arc`` puts pages into ARC files (version 1 or 2, one gzip member a record), ``arc_records`` parses them by the
field names of each file's own version block and by the declared lengths, ``convert`` writes WARC files from them and
``read_warc`` reads those.  Identifiers are UUIDs of archive and offset, dates and types follow from the ARC fields, digests are SHA-1 of block and payload.  Of records with equal payloads of at least ``revisit_from`` bytes
the one with the largest page id (then path and place) is the response; the others become revisits that name it.

Payloads never go through a shuffle: the decision is made on digests, and decisions are brought to the ARC file they
belong to.  Archives are rolled at ``ROLL`` bytes, and a task holds one of them.  Each task writes under a name of its
own attempt; only manifests of finished tasks are read, so a lost executor or a second attempt leaves no double rows.
Files go to the folder of ``spark.checkpoint.dir`` through pyarrow's file systems.

Defined results: a null html is an empty payload; a null address becomes ``unknown:``, white space in addresses is
percent-encoded; a null page id is kept as null and is the smallest; repeated rows are records of their own, and of
equal largest page ids the last in path and place is the response; an empty table gives no archives and no rows; extra
columns are ignored, whatever their names.  Payloads of any length are whole; a task holds one archive and one payload.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import partitions, scratch, stored

ROLL = 8 << 20
# The field lists of the two ARC versions
FIELDS_1 = "URL IP-address Archive-date Content-type Archive-length"
FIELDS_2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes):
    """(offset, content) of each gzip member."""
    at, view, step = 0, memoryview(data), 1 << 14
    while at < len(data):
        z = zlib.decompressobj(31)
        parts, end = [], at
        while not z.eof:
            if end >= len(data):
                raise ValueError(f"cut gzip member at {at}")
            parts.append(z.decompress(view[end : end + step]))
            end = min(len(data), end + step)
        yield at, b"".join(parts)
        at = end - len(z.unused_data)


class Rolling:
    """Writes gzip members to files of bounded size under names of this task attempt."""

    def __init__(self, folder: str, kind: str, head):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        self.stem = f"{kind}-{context.partitionId():06d}-{context.taskAttemptId()}"
        self.kind, self.head, self.number, self.parts, self.size = kind, head, 0, [], 0

    @property
    def path(self) -> str:
        return f"{self.folder}/{self.stem}-{self.number:05d}.{self.kind}.gz"

    def add(self, record: bytes) -> int:
        if not self.parts:
            self._put(self.head(self.path))
        at = self.size
        self._put(record)
        return at

    def _put(self, record: bytes) -> None:
        member = gzip_member(record)
        self.parts.append(member)
        self.size += len(member)

    def full(self) -> bool:
        return self.size >= ROLL

    def close(self) -> str | None:
        if not self.parts:
            return None
        path = self.path
        with self.fs.open_output_stream(path) as f:
            for p in self.parts:
                f.write(p)
        self.number, self.parts, self.size = self.number + 1, [], 0
        return path


def by_file(rows: DataFrame) -> DataFrame:
    """Rows with the files they name spread over tasks; rows are tiny, so their number of tasks is fixed here and not by size."""
    return rows.repartition(2 * partitions(rows.sparkSession), "path")


def read_file(folder: str, path: str) -> bytes:
    fs, _ = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(path) as f:
        return f.read()


# ---- ARC


def version_block(path: str, version: int, date: str) -> bytes:
    fields = {1: FIELDS_1, 2: FIELDS_2}[version]
    body = f"{version} 0 docweave\n{fields}\n\n".encode()
    name = path.rsplit("/", 1)[-1]
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(values[f] for f in fields.split()).encode() + b"\n" + body + b"\n"


def arc_record(url: str, page_id: int | None, payload: bytes, version: int, date: str, name: str, offset: int) -> bytes:
    ident = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{ident}\r\n".encode() + payload
    values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    fields = {1: FIELDS_1, 2: FIELDS_2}[version]
    return " ".join(values[f] for f in fields.split()).encode() + b"\n" + block + b"\n"


def address(url: str | None) -> str:
    if not url:
        return "unknown:"
    return "".join(c if ord(c) > 32 and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def parse_arc(data: bytes):
    """(offset, fields, block) of each record after the version block; lengths rule, not content."""
    names: list[str] = []
    for at, member in members(data):
        line, _, rest = member.partition(b"\n")
        values = line.decode("utf-8", "replace").split(" ")
        length = int(values[-1])
        block = rest[:length]
        if len(block) != length:
            raise ValueError(f"record at {at} is shorter than declared")
        if values[0].startswith("filedesc://"):
            version, names_line = block.split(b"\n")[:2]
            names = names_line.decode().split()
            if version.split()[0] not in (b"1", b"2"):
                raise ValueError(f"unknown version {version!r}")
            continue
        # fields are counted from the right: only an address could hold more blanks
        tail = values[len(values) - len(names) + 1 :]
        yield at, dict(zip(names, [" ".join(values[: len(values) - len(names) + 1]), *tail])), block


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """(head with its blank line, fields, payload)."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return b"", {}, block
    fields = dict(line.partition(": ")[::2] for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return head + mark, fields, payload


def write_arc(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", version: int = 1, date: str = "20200101000000") -> DataFrame:
    """Manifest (path, records) of the ARC files written."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))

    def run(batches):
        out, n = Rolling(folder, "arc", lambda path: version_block(path, version, date)), 0
        for batch in batches:
            for i, url, payload in zip(*(batch.column(k) for k in range(3))):
                name = out.path.rsplit("/", 1)[-1]
                out.add(arc_record(address(url.as_py()), i.as_py(), payload.as_py().encode("utf-8", "surrogatepass"), version, date, name, out.size))
                n += 1
                if out.full():
                    yield pa.RecordBatch.from_pydict({"path": [out.close()], "records": [n]})
                    n = 0
        if n:
            yield pa.RecordBatch.from_pydict({"path": [out.close()], "records": [n]})

    return stored(rows.mapInArrow(run, "path string, records long"), "arc-manifest")


def arc_records(manifest: DataFrame, folder: str) -> DataFrame:
    """(path, at, page_id, payload_bytes, payload_sha1) of each record; one task reads a file."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for at, _, block in parse_arc(read_file(folder, path)):
                    _, fields, payload = http_parts(block)
                    rows.append((path, at, int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None, len(payload), hashlib.sha1(payload).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["path", "at", "page_id", "payload_bytes", "payload_sha1"])

    return by_file(manifest.select("path")).mapInArrow(run, "path string, at long, page_id long, payload_bytes long, payload_sha1 string")


# ---- WARC


def record_id(path: str, at: int) -> str:
    """The identifier of the record at a place of an archive; whoever refers to the place can compute it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path.rsplit('/', 1)[-1]}@{at}')}>"


def sha1_name(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("WARC-Block-Digest", sha1_name(block)), ("Content-Length", str(len(block)))])
    return f"WARC/1.0\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _warcinfo(path: str) -> bytes:
    name = path.rsplit("/", 1)[-1]
    return warc_record("warcinfo", [("WARC-Record-ID", record_id(name, 0)), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: docweave\r\nformat: WARC File Format 1.0\r\n")


def iso(date: str) -> str:
    return datetime.datetime.strptime(date[:14].ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def convert(manifest: DataFrame, folder: str, *, revisit_from: int = 1000) -> DataFrame:
    """Manifest (path, records) of the WARC files written from the ARC files of manifest."""
    records = stored(arc_records(manifest, folder), "arc-index")
    place = F.struct("page_id", "path", "at")
    first = records.where(F.col("payload_bytes") >= revisit_from).groupBy("payload_sha1", "payload_bytes").agg(F.max(place).alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first = stored(first, "responses")  # written first, so that a frequent payload's records can be split in the join
    plan = records.select("path", "at", "page_id", "payload_sha1", "payload_bytes").join(first, ["payload_sha1", "payload_bytes"]).where(place != F.col("response"))
    plan = plan.select("path", "at", F.col("response.path").alias("to_path"), F.col("response.at").alias("to_at"), F.col("response.page_id").alias("to_id"))
    none = F.lit(None)
    plan = plan.unionByName(manifest.select("path", F.lit(-1).cast("long").alias("at"), none.cast("string").alias("to_path"), none.cast("long").alias("to_at"), none.cast("long").alias("to_id")))

    def run(batches):
        out, n, revisits, current = Rolling(folder, "warc", _warcinfo), 0, {}, None

        def file_done():
            nonlocal n
            for at, fields, block in parse_arc(read_file(folder, current)):
                head, http, payload = http_parts(block)
                url, date = fields["URL"], fields["Archive-date"]
                common = [("WARC-Record-ID", record_id(current, at)), ("WARC-Date", iso(date)), ("WARC-Target-URI", url), ("WARC-IP-Address", fields["IP-address"])]
                digest = ("WARC-Payload-Digest", sha1_name(payload))
                kind = "response" if head else "resource"
                typed = ("Content-Type", "application/http; msgtype=response" if head else fields["Content-type"])
                if at in revisits:
                    to_path, to_at, to_id = revisits[at]
                    more = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(to_path, to_at))]
                    if to_id is not None:
                        more.append(("WARC-Refers-To-Page", str(to_id)))
                    out.add(warc_record("revisit", [*common, digest, *more, typed], head))
                else:
                    out.add(warc_record(kind, [*common, digest, typed], block))
                n += 1
                if out.full():
                    yield pa.RecordBatch.from_pydict({"path": [out.close()], "records": [n]})
                    n = 0

        for batch in batches:
            for path, at, to_path, to_at, to_id in zip(*(c.to_pylist() for c in batch.columns)):
                if path != current:
                    if current is not None:
                        yield from file_done()
                    current, revisits = path, {}
                if at >= 0:
                    revisits[at] = (to_path, to_at, to_id)
        if current is not None:
            yield from file_done()
        if n:
            yield pa.RecordBatch.from_pydict({"path": [out.close()], "records": [n]})

    return stored(by_file(plan).sortWithinPartitions("path", "at").mapInArrow(run, "path string, records long"), "warc-manifest")


def parse_warc(data: bytes):
    """(fields, block) of each record."""
    for at, member in members(data):
        head, _, rest = member.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if lines[0] != "WARC/1.0":
            raise ValueError(f"no WARC record at {at}")
        fields = dict(line.partition(": ")[::2] for line in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, record_id, url, date, record_type, payload_bytes, payload_digest, refers_to) of each record but warcinfo.

    Digests of blocks and of responses' payloads are checked against the content.
    """

    def run(batches):
        names = ["page_id", "record_id", "url", "date", "record_type", "payload_bytes", "payload_digest", "refers_to"]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for fields, block in parse_warc(read_file(folder, path)):
                    kind = fields["WARC-Type"]
                    if sha1_name(block) != fields["WARC-Block-Digest"]:
                        raise ValueError(f"{path}: digest of {fields['WARC-Record-ID']} doesn't hold")
                    if kind == "warcinfo":
                        continue
                    _, http, payload = http_parts(block)
                    if kind != "revisit" and sha1_name(payload) != fields["WARC-Payload-Digest"]:
                        raise ValueError(f"{path}: payload digest of {fields['WARC-Record-ID']} doesn't hold")
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    page, to = http.get("X-Page-Id"), fields.get("WARC-Refers-To-Page")
                    rows.append((page and int(page), fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"], kind, int(http["Content-Length"]) if "Content-Length" in http else len(payload), digest, to and int(to)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return by_file(manifest.select("path")).mapInArrow(run, "page_id long, record_id string, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long")


def archive_round_trip(pages: DataFrame, *, version: int = 1, revisit_from: int = 1000, **columns) -> DataFrame:
    """pages through ARC files into WARC files and back to rows."""
    folder = scratch(pages.sparkSession, "archives")
    fs, place = pafs.FileSystem.from_uri(folder)
    fs.create_dir(place)
    return read_warc(convert(write_arc(pages, folder, version=version, **columns), folder, revisit_from=revisit_from), folder)
