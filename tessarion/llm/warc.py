"""WARC archives as a Python data source, written and read.

``spark.read.format("warc").load(folder)`` plans one partition for each file, or for each ``split_bytes`` range of a large one.
Records are separate gzip members whose extra field ``sl`` holds the member's compressed and uncompressed sizes, so a reader
inflates a record only as far as its headers and, if a pushed-down predicate refuses it or the payload isn't asked for (option
``payload``), jumps to the next member without inflating the rest. Equality, IN and prefix predicates on the header columns are
pushed down. Archives of other writers (members without ``sl``) are read too, by inflating through them.

``df.write.format("warc").mode("append").save(folder)`` takes the columns of ``FIELDS``; every task writes files under its own
hidden name, and the commit renames those of the tasks that succeeded, so retried or lost tasks leave no records behind.

``archive`` writes pages: equal payloads of at least ``least`` bytes are stored once, by the smallest page id, and revisited by
the others. Defined results: a null payload is an empty one; rows with the smallest page id of their payload are all responses; a
null page id has a record of its own kind of id and, having no order, is a response; an empty table gives archives without records.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from tessarion.llm.common import scratch_path, stash

FIELDS = "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_length long, content_type string, payload binary"
_NAMES = [x.split()[0] for x in FIELDS.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in FIELDS.split(", ")]
#: Header lines of a record, by column (fixed names of the format; the length of a payload that isn't stored is an extension).
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
    "content_type": "Content-Type",
}
_COLUMN = {v.lower(): k for k, v in HEADERS.items()}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08\x04"
_END = b"\r\n\r\n"


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), os.path.abspath(path)
    return pafs.FileSystem.from_uri(path)


def _clean(value: str) -> str:
    return "".join(c if " " <= c != "\x7f" else "%{:02X}".format(ord(c)) for c in value)


def encode(record: dict) -> bytes:
    """One gzip member holding the record."""
    payload = record["payload"] or b""
    head = ["WARC/1.1"]
    for column, name in HEADERS.items():
        value = record[column]
        if column == "content_type":
            value = "application/http;msgtype=response"
        if value is not None:
            head.append(f"{name}: {_clean(str(value))}")
    if record["record_type"] == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
        block = b"HTTP/1.1 200 OK\r\n\r\n"
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: {_clean(record['content_type'] or 'application/octet-stream')}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(head).encode() + _END + block + _END
    press = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = press.compress(raw) + press.flush()
    extra = b"sl\x08\x00" + (10 + 2 + 12 + len(body) + 8).to_bytes(4, "little") + len(raw).to_bytes(4, "little")
    return _MAGIC + b"\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra + body + zlib.crc32(raw).to_bytes(4, "little") + (len(raw) & 0xFFFFFFFF).to_bytes(4, "little")


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _row(heads: dict[str, str]) -> dict:
    row = {c: heads.get(n.lower()) for c, n in HEADERS.items()}
    row["payload_length"] = int(row["payload_length"]) if (row["payload_length"] or "").isdigit() else None
    return row


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


@dataclass
class WarcReader(DataSourceReader):
    path: str
    with_payload: bool
    split_bytes: int
    tests: list[tuple[str, str, tuple]] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADERS and name != "payload_length" and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name in HEADERS and name != "payload_length" and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((name, "prefix", (f.value,)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _place(self.path)
        infos = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        files = sorted((i.path, i.size) for i in infos if i.type == pafs.FileType.File and not os.path.basename(i.path).startswith((".", "_")) and ".warc" in os.path.basename(i.path))
        return [Range(p, a, min(a + self.split_bytes, n)) for p, n in files for a in range(0, n, self.split_bytes)] or [Range("", 0, 0)]

    def _wanted(self, row: dict) -> bool:
        return all(row[c] is not None and (row[c] in v if how == "in" else row[c].startswith(v[0])) for c, how, v in self.tests)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _place(self.path)
        rows: list[dict] = []
        held = 0
        with fs.open_input_file(partition.path) as file:
            for row in self._records(file, partition.start, partition.end):
                rows.append(row)
                held += 500 + len(row["payload"] or b"")
                if held > 1 << 23:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(_NAMES, _TYPES)], _NAMES)

    def _first(self, file, start: int, end: int) -> int | None:
        """The first member that begins at or after ``start``: its magic, and a WARC line once inflated."""
        if start == 0:
            return 0
        size = file.size()
        at, step = start, 1 << 16
        while at < end:
            window = file.read_at(min(step + 3, size - at), at)
            k = window.find(b"\x1f\x8b\x08")
            while k >= 0 and at + k < end:
                try:
                    if zlib.decompressobj(zlib.MAX_WBITS | 16).decompress(file.read_at(min(4096, size - at - k), at + k), 5) == b"WARC/":
                        return at + k
                except zlib.error:
                    pass
                k = window.find(b"\x1f\x8b\x08", k + 1)
            at += step
        return None

    def _records(self, file, start: int, end: int) -> Iterator[dict]:
        at, size = self._first(file, start, end), file.size()
        while at is not None and at < min(end, size):
            # Headers first: inflate no further than their end.
            inflate = zlib.decompressobj(zlib.MAX_WBITS | 16)
            piece = file.read_at(min(2048, size - at), at)
            known = int.from_bytes(piece[16:20], "little") if piece[:4] == _MAGIC and piece[12:16] == b"sl\x08\x00" else None
            raw, upto, todo = b"", at + len(piece), piece
            while _END not in raw and not inflate.eof:
                raw += inflate.decompress(todo, 1024)
                todo = inflate.unconsumed_tail
                if not todo and not inflate.eof and _END not in raw:
                    todo = file.read_at(min(1 << 16, size - upto), upto)
                    if not todo:
                        raise ValueError(f"a record at {at} has no end")
                    upto += len(todo)
            head, _, rest = raw.partition(_END)
            heads = _headers(head)
            row = _row(heads)
            wanted = self._wanted(row)
            need = int(heads.get("content-length", 0)) if wanted and self.with_payload and row["record_type"] != "revisit" else None
            block = [rest]
            if need is not None or known is None:
                while not inflate.eof:
                    if not todo:
                        todo = file.read_at(min(1 << 16, size - upto), upto)
                        if not todo:
                            raise ValueError(f"a record at {at} has no end")
                        upto += len(todo)
                    more = inflate.decompress(todo)
                    if need is not None:
                        block.append(more)
                    todo = inflate.unconsumed_tail
            if wanted:
                row["payload"] = None
                if need is not None:
                    body = b"".join(block)[:need]
                    row["payload"] = body.partition(_END)[2] if heads.get("content-type", "").startswith("application/http") else body
                    row["content_type"] = next((v.strip() for k, _, v in (x.partition(":") for x in body[:2048].partition(_END)[0].decode("latin-1").split("\r\n")) if k.lower() == "content-type"), row["content_type"])
                yield row
            at = at + known if known is not None else upto - len(inflate.unused_data)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int) -> None:
        self.path, self.file_bytes = path, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _place(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for record in (r for k in range(0, batch.num_rows, 64) for r in batch.slice(k, 64).to_pylist()):
                    if out is None:
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{root}/.{names[-1]}", compression=None), 0
                    member = encode(record)
                    out.write(member)
                    size += len(member)
                    if size >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _place(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{root}/.{name}", f"{root}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _place(self.path)
        for m in messages:
            for name in m.names if m else ():
                if fs.get_file_info(f"{root}/.{name}").type == pafs.FileType.File:
                    fs.delete_file(f"{root}/.{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> WarcReader:  # noqa: ANN001
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true", int(self.options.get("split_bytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:  # noqa: ANN001
        if schema.names != _NAMES:
            raise ValueError(f"the columns must be {_NAMES}")
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", 1 << 30)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(pages: DataFrame, path: str, least: int = 100, date: str = "2000-01-01T00:00:00Z", broadcast_bytes: int = 32 << 20) -> None:
    """Write ``pages(page_id, url, html)`` as WARC records into the folder ``path``.

    The pages that repeat a payload are found from ids and digests alone. Their list is broadcast where it is at most ``broadcast_bytes``, so that
    no payload is dealt out; where it is larger, pages are joined with it by id and digest, payloads and all.
    """
    register(pages.sparkSession)
    whole = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    whole = whole.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    small = whole.where((F.col("bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last").drop("last")
    again = stash(small.distinct().join(first, "digest").where("page_id <> first"), "warc-again")
    fits = again.count() * 112 <= broadcast_bytes  # a digest of 64 characters, two ids and a row's own bytes
    full = whole.join(F.broadcast(again) if fits else again.hint("merge"), ["page_id", "digest"], "left")
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("first").isNotNull()
    records = full.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        ident(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.when(revisit, ident(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.col("bytes").alias("payload_length"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode("append").save(path)


def _page(column: str):
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record: a response's figures come from its payload,
    a revisit's from its headers alone."""
    register(spark)
    full = spark.read.format("warc").load(path).where(F.col("record_type") == "response")
    thin = spark.read.format("warc").option("payload", "false").load(path).where(F.col("record_type") == "revisit")
    a = full.select(_page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    b = thin.select(_page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", _page("refers_to").alias("refers_to"))
    return a.union(b)


def round_trip(pages: DataFrame) -> DataFrame:
    path = scratch_path(pages.sparkSession, "warc")
    archive(pages, path)
    return read_pages(pages.sparkSession, path)


def digest_of(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()
