"""WARC archives: a writer with payload deduplication, and a reader that salvages what follows damage.

The reader checks every record (gzip member with its checksum, version line, required headers, length, block and payload
digests; only a plain record's header values have no checksum). After a failed check it searches for the next gzip member or version line at which a whole record
checks out, goes on from there, and reports the bytes passed over as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import blocks, new_path, scope, stored

#: Bytes after which a task begins a new archive file.
ROLL_BYTES = 256 << 20
#: Revisits up to which their table is broadcast: some 40 MB of rows.
BROADCAST_REVISITS = 500_000
_GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_PIECE = 1 << 16


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    payload: bytes


@dataclass
class Gap:
    """Bytes [offset, offset + length) that hold no whole record, and the check that failed at their begin."""

    offset: int
    length: int
    reason: str


class Damaged(ValueError):
    pass


def _sha1(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()  # noqa: S324 - WARC's usual payload digest, not a safeguard


def build(headers: dict[str, str], block: bytes, compress: bool = True) -> bytes:
    """A record's bytes; length and block digest are added to ``headers``."""
    lines = headers | {"WARC-Block-Digest": f"sha1:{_sha1(block)}", "Content-Length": str(len(block))}
    clean = (f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in lines.items())
    data = ("WARC/1.1\r\n" + "\r\n".join(clean) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    if not compress:
        return data
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def http_block(payload: bytes, with_payload: bool = True) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + (payload if with_payload else b"")


def _parse(data: bytes, start: int) -> tuple[int, dict[str, str], bytes]:
    """End, headers and payload of the record at ``start`` of plain bytes; Damaged if a check fails."""
    if not (m := _VERSION.match(data, start)):
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", m.end() - 2)
    if head_end < 0:
        raise Damaged("unfinished header")
    headers = {}
    for line in data[m.end() : head_end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line and not colon:
            raise Damaged("bad header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit() or not headers.get("warc-type") or not headers.get("warc-record-id"):
        raise Damaged("required header missing")
    begin, size = head_end + 4, int(headers["content-length"])
    block, end = data[begin : begin + size], begin + size + 4
    if len(block) < size or data[begin + size : end] != b"\r\n\r\n":
        raise Damaged("length does not fit")
    if (d := headers.get("warc-block-digest", "")).startswith("sha1:") and d[5:] != _sha1(block):
        raise Damaged("block digest differs")
    payload = block
    if block.startswith(b"HTTP/"):
        head, _, payload = block.partition(b"\r\n\r\n")
        headers["http-head"] = head.decode("latin-1")
    d = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and d.startswith("sha1:") and d[5:] != _sha1(payload):
        raise Damaged("payload digest differs")
    return end, headers, payload


def _member(data: mmap.mmap | bytes, start: int) -> tuple[int, bytes]:
    """End and content of the gzip member at ``start``; Damaged if it is cut or its checksum fails."""
    z, out, at = zlib.decompressobj(31), [], start
    try:
        while not z.eof:
            piece = data[at : at + _PIECE]
            if not piece:
                raise Damaged("cut gzip member")
            out.append(z.decompress(piece))
            at += len(piece)
    except zlib.error:
        raise Damaged("bad gzip member") from None
    return at - len(z.unused_data), b"".join(out)


def _record(data: mmap.mmap | bytes, start: int) -> tuple[int, dict[str, str], bytes]:
    if data[start : start + 3] == _GZIP:
        end, plain = _member(data, start)
        stop, headers, payload = _parse(plain, 0)
        if stop != len(plain):
            raise Damaged("bytes after the record")
        return end, headers, payload
    if data[start : start + 7] == b"WARC/1.":
        return _parse(data, start)
    raise Damaged("neither gzip member nor version line")


def salvage(data: mmap.mmap | bytes) -> Iterator[Record | Gap]:
    """Every whole record and every gap of an archive, in order; together they cover all its bytes."""
    at, size = 0, len(data)
    while at < size:
        try:
            end, headers, payload = _record(data, at)
        except Damaged as e:
            begin, reason = at, str(e)
        else:
            yield Record(at, end - at, headers, payload)
            at = end
            continue
        found, member, line = None, begin, begin
        while found is None:
            member = data.find(_GZIP, max(member, at + 1)) if member >= 0 else -1
            line = data.find(b"WARC/1.", max(line, at + 1)) if line >= 0 else -1
            near = [x for x in (member, line) if x >= 0]
            if not near:
                break
            at = min(near)
            try:
                found = _record(data, at)
            except Damaged:
                continue
        at = at if found else size
        yield Gap(begin, at - begin, reason)


def open_archive(path: str) -> mmap.mmap | bytes:
    if not os.path.getsize(path):
        return b""
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def local_path(uri: str) -> str:
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise ValueError(f"archives are memory-mapped, so their folder must be a mounted path, not {uri}")
    return at.path or uri


_FILES = pa.schema([("file", pa.string()), ("records", pa.int64())])


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        out, name, records, files = None, "", 0, []
        for batch in batches:
            for i, j in blocks([len(x.as_buffer()) for x in batch.column(2)]):
                for page, url, html, keeper in zip(*(c.slice(i, j - i).to_pylist() for c in batch.columns), strict=True):
                    if out is None or out.tell() > ROLL_BYTES:
                        if out:
                            out.close()
                            files.append({"file": name, "records": records})
                        # A name for each attempt: a task that runs twice never writes into a file that is in use.
                        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out, records = open(f"{folder}/{name}", "wb"), 0  # noqa: SIM115
                    headers = {
                        "WARC-Type": "response" if keeper is None else "revisit",
                        "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>", "WARC-Date": "1970-01-01T00:00:00Z",
                        "WARC-Target-URI": url or "urn:none", "Content-Type": "application/http; msgtype=response",
                        "WARC-Payload-Digest": f"sha1:{_sha1(html)}",
                    }
                    if keeper is not None:
                        headers |= {
                            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                            "WARC-Refers-To": f"<urn:page:{keeper}>",
                        }
                    out.write(build(headers, http_block(html, keeper is None)))
                    records += 1
        if out:
            out.close()
            files.append({"file": name, "records": records})
            yield pa.RecordBatch.from_pylist(files, _FILES)

    return run


def write_archives(
    pages: DataFrame, folder: str, *, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write a record per row of ``pages`` and return the files' names (``file, records``), stored.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest id is a response, the others
    revisit it. A null payload is an empty one; rows with a null id are always responses; rows that repeat the largest id
    are responses each. Each row is judged by its own payload, also where an id comes with several. A record is
    held whole in its task, so a payload may have what a Spark row may (2 GB). Other columns are ignored.
    """
    src = pages.select(
        pages[id_col].cast("long").alias("page"), pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary").alias("html"),
    ).withColumns({"key": F.unhex(F.sha2("html", 256)), "size": F.length("html").cast("long")})
    with scope():
        # The key is narrow, so payloads stay where they are.
        keys = stored(src.filter(F.col("page").isNotNull() & (F.col("size") >= least)).select("page", "key", "size"), "page-keys")
        groups = keys.groupBy("key", "size").agg(F.max("page").alias("keeper"), F.count("*").alias("n")).filter("n > 1")
        revisits = keys.join(groups.hint("merge"), ["key", "size"]).filter("page != keeper").select("page", "key", "size", "keeper").distinct()
        revisits = stored(revisits, "revisits")
        small = revisits.count() <= BROADCAST_REVISITS
        joined = src.join(F.broadcast(revisits) if small else revisits.hint("merge"), ["page", "key", "size"], "left")
        made = joined.select("page", "url", "html", "keeper").mapInArrow(_write(local_path(folder)), "file string, records long")
        files = stored(made, "archive-files", keep=True)
    return files


def read_archives(files: DataFrame, folder: str, *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(records, gaps)`` of the archives named in ``files(file)`` under ``folder``.

    Records: file, offset, length, warc_type, record_id, target_uri, payload_digest (as the header has it), refers_to,
    payload_bytes (of the full payload), payload. Gaps: file, offset, length, reason. ``strict`` makes a gap, or a number of records
    other than ``files(records)``, an error. An empty archive has neither records nor gaps. Archives are mapped, one record at a time
    is held whole.
    """
    base = local_path(folder)
    n = max(1, min(files.count(), 4096))
    spread = files.select("file", *(["records"] if strict else [])).repartition(n, "file")
    schema = (
        "file string, offset long, length long, warc_type string, record_id string, target_uri string, payload_digest string, "
        "refers_to string, payload_bytes long, payload binary, reason string"
    )

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held, whole = [], 0, 0
                for x in salvage(open_archive(f"{base}/{name}")):
                    row = {"file": name, "offset": x.offset, "length": x.length}
                    whole += isinstance(x, Record)
                    if isinstance(x, Gap):
                        if strict:
                            raise Damaged(f"{name}: {x.reason} at {x.offset}, {x.length} bytes")
                        row |= {"reason": x.reason}
                    else:
                        h, size = x.headers, len(x.payload)
                        if h.get("warc-type") == "revisit" and (m := _HTTP_LENGTH.search(h.get("http-head", ""))):
                            size = int(m[1])
                        row |= {
                            "warc_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"),
                            "payload_digest": h.get("warc-payload-digest"), "refers_to": h.get("warc-refers-to"),
                            "payload_bytes": size, "payload": x.payload,
                        }
                    rows.append(row)
                    held += x.length
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                if strict and [whole] != expected:
                    raise Damaged(f"{name}: {whole} records where {expected[0]} were written")

    both = spread.mapInArrow(run, schema)
    return both.filter("reason is null").drop("reason"), both.filter("reason is not null").select("file", "offset", "length", "reason")


_HTTP_LENGTH = re.compile(r"Content-Length: (\d+)")


def salvage_archives(files: DataFrame, folder: str, gap_log: str) -> DataFrame:
    """The records of ``read_archives``; the quarantined gaps are appended to the Parquet table ``gap_log``."""
    records, gaps = read_archives(files, folder)
    gaps.write.mode("append").parquet(gap_log)
    return records


def archived_pages(pages: DataFrame, *, least: int = 1000, **names: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every row of ``pages``, from archives read back.

    Each row is judged by its own payload, also where an id is null or comes with several; a null payload is an empty one, and one record is held
    whole in a task. Other columns are ignored; an empty table gives no archive and no row. Archives that do not give back every record that
    was written, without a gap, are an error, so no page is lost unnoticed.
    """
    folder = new_path(pages.sparkSession, "warc")
    records, _ = read_archives(write_archives(pages, folder, least=least, **names), folder, strict=True)

    def number(c: str):
        return F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1)

    return records.select(
        F.when(number("record_id") != "", number("record_id")).cast("long").alias("page_id"), "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), F.col("warc_type").alias("record_type"),
        F.when(number("refers_to") != "", number("refers_to")).cast("long").alias("refers_to"),
    )
