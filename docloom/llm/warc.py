"""WARC archives as a PySpark Python data source.

Reading: files are planned into partitions by bytes. The predicates on record type, ids, address, digest and lengths that a query
has are pushed down (``read_archives`` with ``where``). Of each record the headers are parsed first; where a predicate says no, or no column asks for the payload,
the payload is skipped: a compressed member by the length in its ``sl`` extra field, a plain record by its Content-Length, without decoding
either. Compressed files without that field are read through and thrown away in pieces. A payload is decoded only when the schema
that was asked for has ``payload`` and the headers have passed.

Writing: a task writes files of its own under a folder beside the archives that readers do not see, and the driver moves the files of the tasks that were
committed; what lost or repeated tasks wrote goes with the folder. Each record is a gzip member of its own with the ``sl`` field.
The folder is opened through ``pyarrow.fs``: any file system that pyarrow reaches and all executors share.

``archived`` decides what is written: of records with equal payloads (by SHA-256) that with the smallest id is a response, the others are
revisits without a payload, which carry the digest and, in the HTTP header, the length of the whole.

Defined cases: null html is an empty payload; among equal payloads null ids come last and never name a response that another id
could, and where all ids are null each is a response; rows that repeat the smallest id are all responses; a null address has no
header; control characters in an address are percent-encoded; extra columns are not written; no rows give no archives,
which read as no records; a broken record is an error that names its file and place.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from docloom.llm.common import discard, materialise
from docloom.sources.scratch import new_path

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
HEADERS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint"
RECORDS = f"{HEADERS}, payload binary"
#: Bytes of archives to a partition when reading, of a file when writing, of a batch of records, of one read.
SPLIT_BYTES, FILE_BYTES, BATCH_BYTES, CHUNK = 64 << 20, 256 << 20, 8 << 20, 1 << 16
#: A header block longer than this is not one.
HEADER_MOST = 1 << 20
#: Repeated payloads up to this many are broadcast as (digest, id); more meet the pages by a shuffle.
BROADCAST_ROWS = 200_000
SUFFIXES = (".warc", ".warc.gz")
URN = "urn:docloom:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


# ---- reading


class Inflow:
    """The bytes of an archive, decompressed as they are asked for."""

    def __init__(self, file, name: str):
        self.file, self.name = file, name
        self.raw, self.ready = b"", bytearray()
        self.inflater, self.member_end = None, None
        self.packed = self._more(2) and self.raw.startswith(b"\x1f\x8b")

    def _more(self, least: int) -> bool:
        """At least ``least`` raw bytes, if there are so many."""
        while len(self.raw) < least:
            data = self.file.read(max(CHUNK, least - len(self.raw)))
            if not data:
                return False
            self.raw += data
        return True

    def _open_member(self) -> None:
        self.member_end = None
        self._more(22)
        if len(self.raw) >= 22 and self.raw[3] & 4:
            size, key, length, packed = struct.unpack("<H2sHI", self.raw[10:20])
            if size >= 12 and key == b"sl" and length == 8:
                self.member_end = self.file.tell() - len(self.raw) + packed
        self.inflater = zlib.decompressobj(31)

    def fill(self) -> bool:
        """More decompressed bytes; false at the end."""
        if not self.raw and not self._more(1) and self.inflater is None:
            return False
        if not self.packed:
            self.ready += self.raw
            self.raw = b""
            return True
        if self.inflater is None:
            self._open_member()
        try:
            made = self.inflater.decompress(self.raw, CHUNK)
        except zlib.error as error:
            raise ValueError(f"{self.name}: {error} before byte {self.file.tell()}") from error
        if not made and not self.raw and not self.inflater.eof:
            return False
        self.ready += made
        self.raw = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
        if self.inflater.eof:
            self.inflater = None
        return True

    def head(self, most: int = HEADER_MOST) -> bytes | None:
        """The bytes up to the next empty line; none where the archive ends."""
        seen = 0
        while (at := self.ready.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(self.ready) - 3)
            if len(self.ready) > most or not self.fill():
                if self.ready.strip():
                    raise ValueError(f"{self.name}: no end of a header before byte {self.file.tell()}")
                return None
        found = bytes(self.ready[:at])
        del self.ready[: at + 4]
        return found

    def next_head(self) -> bytes | None:
        """The next record's header, after the empty lines that end the record before."""
        while len(self.ready) < 4 and self.fill():
            pass
        while self.ready[:2] == b"\r\n":
            del self.ready[:2]
            while len(self.ready) < 4 and self.fill():
                pass
        return self.head()

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.fill():
                raise ValueError(f"{self.name}: ends inside a record")
        found = bytes(self.ready[:n])
        del self.ready[:n]
        return found

    def skip(self, n: int) -> None:
        """Leave out ``n`` bytes: past the member or the record where its length is known, else in pieces."""
        if self.packed and self.member_end is not None:
            self.file.seek(self.member_end)
            self.raw, self.inflater, self.member_end = b"", None, None
            self.ready.clear()
            return
        while n > 0:
            if not self.packed and n > len(self.ready) + len(self.raw):
                self.file.seek(n - len(self.ready) - len(self.raw), 1)
                self.raw = b""
                self.ready.clear()
                return
            cut = min(n, len(self.ready))
            del self.ready[:cut]
            n -= cut
            if n and not self.fill():
                raise ValueError(f"{self.name}: ends inside a record")


def parsed(head: bytes) -> dict[str, str]:
    """Header names in lower case with their values; a line that begins with a blank goes on with the one before."""
    found: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += f" {line.strip()}"
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found.setdefault(name, value.strip())
    return found


def bare(value: str | None) -> str | None:
    """An id without its brackets."""
    return value[1:-1] if value and value.startswith("<") and value.endswith(">") else value


def holds(filter: Filter, row: dict) -> bool | None:
    """Whether ``row`` passes; null where SQL would say so."""
    if isinstance(filter, Not):
        inner = holds(filter.child, row)
        return None if inner is None else not inner
    value = row.get(filter.attribute[0])
    if isinstance(filter, IsNull):
        return value is None
    if isinstance(filter, IsNotNull):
        return value is not None
    if isinstance(filter, EqualNullSafe):
        return value == filter.value
    wanted = filter.value
    if value is None or wanted is None:
        return None
    return COMPARED[type(filter)](value, wanted)


COMPARED = {
    EqualTo: lambda v, w: v == w,
    In: lambda v, w: True if v in w else None if None in w else False,
    GreaterThan: lambda v, w: v > w,
    GreaterThanOrEqual: lambda v, w: v >= w,
    LessThan: lambda v, w: v < w,
    LessThanOrEqual: lambda v, w: v <= w,
    StringStartsWith: lambda v, w: v.startswith(w),
    StringEndsWith: lambda v, w: v.endswith(w),
    StringContains: lambda v, w: w in v,
}
#: Strings are compared by order only in bytes, which Python's order of code points equals.
PUSHED = (*COMPARED, EqualNullSafe, IsNull, IsNotNull)
#: Known from the WARC header alone, and with the HTTP header behind it.
WARC_COLUMNS = frozenset(["record_id", "record_type", "target_uri", "refers_to", "payload_digest"])
HTTP_COLUMNS = WARC_COLUMNS | {"payload_bytes"}


def names_of(filter: Filter) -> frozenset[str] | None:
    """The columns of a filter that can be decided here, else none."""
    if isinstance(filter, Not):
        return names_of(filter.child)
    if not isinstance(filter, PUSHED) or len(filter.attribute) != 1 or filter.attribute[0] not in HTTP_COLUMNS:
        return None
    return frozenset(filter.attribute)


def records(file, name: str, columns: Iterable[str], filters: list[Filter]) -> Iterator[dict]:
    """The records of an archive that pass, with the ``columns``."""
    flow = Inflow(file, name)
    first = [f for f in filters if names_of(f) <= WARC_COLUMNS]
    second = [f for f in filters if f not in first]
    lengths, body = "payload_bytes" in columns or bool(second), "payload" in columns
    while (head := flow.next_head()) is not None:
        if not head.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC record before byte {file.tell()}")
        said = parsed(head)
        rest = int(said.get("content-length", 0))
        digest = said.get("warc-payload-digest")
        row = {"record_id": bare(said.get("warc-record-id")), "record_type": said.get("warc-type"), "target_uri": said.get("warc-target-uri"), "refers_to": bare(said.get("warc-refers-to"))}
        row["payload_digest"] = digest.partition(":")[2] if digest and digest.lower().startswith("sha1:") else digest
        passed = all(holds(f, row) for f in first)
        if passed and (lengths or body):
            if said.get("content-type", "").lower().startswith("application/http") and rest:
                http = flow.head(rest)
                rest -= len(http or b"") + 4
                length = parsed(http or b"").get("content-length")
                row["payload_bytes"] = int(length) if length is not None else rest
            else:
                row["payload_bytes"] = rest
            passed = all(holds(f, row) for f in second)
        if passed and body:
            row["payload"] = flow.take(rest) if row["record_type"] != "revisit" else None
            rest = rest if row["payload"] is None else 0
        flow.skip(rest + 4)
        if passed:
            yield row


@dataclass
class Archives(InputPartition):
    """Some files of an archive folder, read by one task."""

    names: list[str]

    def __init__(self, names: list[str]):
        self.names = names


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.columns = [f.name for f in schema.fields]
        self.pushdown = options.get("pushdown", "false") == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.pushdown or names_of(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.path)
        found = system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(SUFFIXES) and not hidden(f.path[len(root) :]))
        planned, size = [], self.split
        for name, n in files:
            if size + n > self.split and size:
                planned.append(Archives([]))
                size = 0
            planned[-1].names.append(name)
            size += n
        return planned or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        kinds = pa.schema([(c, pa.binary() if c == "payload" else pa.int64() if c == "payload_bytes" else pa.string()) for c in self.columns])
        rows, size = [], 0
        for name in partition.names:
            with system.open_input_file(name) as file:
                for row in records(file, name, self.columns, self.filters):
                    rows.append(row)
                    size += 200 + len(row.get("payload") or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)


def hidden(path: str) -> bool:
    return any(part.startswith(("_", ".")) for part in path.split("/"))


# ---- writing


def record(row: dict, date: str) -> bytes:
    """One record with its headers."""
    kind, payload = row["record_type"], row.get("payload") or b""
    size = row.get("payload_bytes")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {date}"]
    if row.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {address(row['target_uri'])}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{row['refers_to']}>"]
    digest = row.get("payload_digest") or base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def address(uri: str) -> str:
    """``uri`` on one line: control characters, and blanks at its ends, percent-encoded."""
    inner = uri.strip(" ")
    lead, trail = (len(uri) - len(uri.lstrip(" ")), len(uri) - len(uri.rstrip(" "))) if inner else (len(uri), 0)
    kept = "".join(quote(c) if ord(c) < 32 or ord(c) == 127 else c for c in inner)
    return "%20" * lead + kept + "%20" * trail


def member(data: bytes, level: int) -> bytes:
    """``data`` as a gzip member that says in its header how long it is."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    if total >= 1 << 32 or len(data) >= 1 << 32:  # lengths that the field cannot say
        head = b"\x1f\x8b\x08\x00" + bytes(5) + b"\xff"
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]

    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.most, self.level = int(options.get("file_bytes", FILE_BYTES)), int(options.get("level", 6))
        self.date, self.plain = options.get("date", "1970-01-01T00:00:00Z"), options.get("compression", "gzip") == "none"

    def _folder(self, root: str) -> str:
        return f"{root}/_writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for k in range(batch.num_rows):
                data = record(batch.slice(k, 1).to_pylist()[0], self.date)
                data = data if self.plain else member(data, self.level)
                if out is None or size + len(data) > self.most > 0 and size:
                    if out is not None:
                        out.close()
                    system.create_dir(self._folder(root), recursive=True)
                    names.append(f"part-{uuid.uuid4().hex}{SUFFIXES[not self.plain]}")
                    out, size = system.open_output_stream(f"{self._folder(root)}/{names[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(pafs.FileSelector(root)):
                if f.type == pafs.FileType.File and f.path.endswith(SUFFIXES):
                    system.delete_file(f.path)
        for name in [n for m in messages if m is not None for n in m.names]:
            system.move(f"{self._folder(root)}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        if system.get_file_info(self._folder(root)).type != pafs.FileType.NotFound:
            system.delete_dir(self._folder(root))


class WarcSource(DataSource):
    """``spark.read.format("warc")``, after ``register``; a schema of some of the columns of ``RECORDS`` decides what is decoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> WarcReader:
        unknown = {f.name for f in schema.fields} - HTTP_COLUMNS - {"payload"}
        if unknown:
            raise ValueError(f"WARC records have no {', '.join(sorted(unknown))}")
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        missing = {"record_id", "record_type", "payload"} - {f.name for f in schema.fields}
        if missing:
            raise ValueError(f"WARC records need {', '.join(sorted(missing))}")
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to ``spark`` and let it push predicates down."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WarcSource)


def read_archives(spark: SparkSession, path: str, columns: str = RECORDS, where: str | None = None) -> DataFrame:
    """The records under ``path``; those that ``where`` holds for, which is pushed down.

    Spark keeps what was pushed down with the relation it was pushed into, so a relation serves one condition: each call has a
    relation of its own, and what a query asks further of the result belongs into ``where`` too. Without ``where`` nothing is pushed down,
    and the result may be filtered in any ways.
    """
    register(spark)
    relation = spark.read.format("warc").schema(columns).option("pushdown", str(where is not None).lower()).load(path)
    return relation if where is None else relation.where(where)


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base32 of the SHA-1 of ``data``."""
    digest = F.sha1(data)
    letters = []
    for part in range(8):
        bits = F.conv(F.substring(digest, 1 + 5 * part, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def archived(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The records (as ``RECORDS``) of ``pages``: repeats of a payload of ``least_bytes`` or more are revisits.

    Only payloads that occur more than once meet the pages again.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("target_uri"), payload.alias("payload"))
    keyed = rows.withColumn("same", F.sha2("payload", 256))
    groups = keyed.where(F.octet_length("payload") >= least_bytes).groupBy("same").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeats = materialise(groups.where((F.col("n") > 1) & F.col("first").isNotNull()).select("same", "first"), "repeated-payloads")
    few = repeats.limit(broadcast_rows + 1).count() <= broadcast_rows
    joined = keyed.join(F.broadcast(repeats) if few else repeats, "same", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = [F.concat(F.lit(URN), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("id", "first")]
    return joined.select(
        urn[0].alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(again, urn[1]).alias("refers_to"),
        base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archives(rows: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Write records, as ``archived`` gives them, to the folder ``path``."""
    register(rows.sparkSession)
    rows.write.format("warc").options(**options).mode(mode).save(path)


def op12_warc(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archives written.

    Length and digest of a response are those of the payload read; those of a revisit, whose payloads are skipped, are its headers'.
    """
    spark, path = pages.sparkSession, new_path(pages.sparkSession, "warc")
    write_archives(archived(pages), path)
    whole = read_archives(spark, path, "record_id string, record_type string, payload binary", "record_type = 'response'")
    heads = read_archives(spark, path, HEADERS, "record_type = 'revisit'")
    kind = pages.schema["page_id"].dataType

    def page(name: str) -> Column:
        return F.nullif(F.substring(name, len(URN) + 1, 1 << 20), F.lit("")).cast(kind)

    responses = whole.select(page("record_id").alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    return responses.unionByName(heads.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")))


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT *, sha1(html) AS d, first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM p),
b AS (SELECT *, list_transform(range(32), lambda k: ((('0x' || substr(d, (5 * (k // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT) & 31) + 1) AS letters FROM h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(letters, lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', i::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM b
"""
