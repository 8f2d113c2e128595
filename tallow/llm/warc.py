"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

A task writes archives of bounded size to shared storage through pyarrow's
file systems and hands on their paths only; a repeated task writes under new
names, so what a lost executor left behind is never read.  The reader inflates
a member in pieces of bounded size, frames the block by its Content-Length and
hashes the payload as it passes; it holds a payload only if that is wanted.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm import scratch

#: A new archive begins beyond so many bytes.
ARCHIVE_BYTES = 32 << 20
#: Bytes read, and inflated, at once.
PIECE = 1 << 18
#: A header of more bytes is taken for damage.
MOST_HEADER = 1 << 28
#: Payloads below are not worth a reference.
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _record(page, url, payload: bytes, digest: str, refers) -> bytes:
    """One record as a gzip member; a revisit has the HTTP header only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers is None else head
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers is not None:
        lines += [f"WARC-Refers-To: {name(refers)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _write_rows(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        out, name, records, size, done = None, "", 0, 0, []
        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, records, size = fs.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                data = _record(page.as_py(), url.as_py(), (html.as_py() or "").encode(), digest.as_py(), refers.as_py())
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
        cols = list(zip(*done)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["path", "records", "size"])

    return run


def write_archives(pages: DataFrame) -> DataFrame:
    """(path, records, size) of the archives that hold pages (page_id, url, html).

    A null html is an empty payload.  Of records with equal payloads of
    LEAST_REVISIT bytes or more, those with the least page_id are responses
    and the others revisit it; so repeated rows of one page are responses, and
    a null page_id, which nothing can refer to, names none (its own record
    revisits the others).  An empty table gives no archive.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    seen = rows.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    # Only payloads that repeat; written, so that its real size decides how it is joined.
    seen = scratch.table(seen.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "payloads")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to")
    rows = rows.join(seen, "digest", "left").select("page_id", "url", "html", "digest", refers)
    made = rows.mapInArrow(_write_rows(scratch.folder(spark, "warc")), "path string, records long, size long")
    return scratch.table(made, "archives")


class _Member:
    """One gzip member of a stream, inflated on demand: never more than PIECE bytes beyond what is asked for."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.rest, self.held = stream, rest, b""
        self.unpack = zlib.decompressobj(31)

    def _more(self) -> bytes:
        """The next inflated bytes, at most PIECE; none at the member's end, whose unread input is then in rest."""
        while not self.unpack.eof:
            out = self.unpack.decompress(self.rest, PIECE)
            self.rest = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if out:
                return out
            if not self.unpack.eof and not self.rest:
                self.rest = self.stream.read(PIECE)
                if not self.rest:
                    raise ValueError("the archive ends inside a record")
        return b""

    def take(self, most: int) -> bytes:
        """Up to so many of the next bytes; none at the end."""
        data = self.held or self._more()
        self.held = data[most:]
        return data[:most]

    def head(self) -> bytes:
        """The bytes before the next empty line, which is passed over."""
        data = self.held
        while (at := data.find(b"\r\n\r\n")) < 0:
            if not (more := self._more()) or len(data) > MOST_HEADER:
                raise ValueError("a record's header does not end")
            data += more
        self.held = data[at + 4 :]
        return data[:at]


def records(stream, keep: bool = True) -> Iterator[tuple[dict[str, str], dict[str, str], bytes | None, str, int]]:
    """(header, HTTP header, payload, its SHA-256, its length) of each gzip member of a binary stream.

    The block is framed by Content-Length and hashed while it is inflated;
    only with keep does a payload stand in memory.
    """
    rest = b""
    while rest or (rest := stream.read(PIECE)):
        member = _Member(stream, rest)
        header = _fields(member.head())
        size = int(header["content-length"])
        http = member.head()
        digest, parts, left = hashlib.sha256(), [], size - len(http) - 4
        length = left
        while left > 0 and (part := member.take(left)):
            digest.update(part)
            left -= len(part)
            if keep:
                parts.append(part)
        end = member.take(5) + member.take(5) + member.take(5) + member.take(5)
        if left or end != b"\r\n\r\n" or member.take(1):
            raise ValueError(f"{header.get('warc-record-id')}: the block is not of the length that its header gives")
        rest = member.rest
        yield header, _fields(http), b"".join(parts) if keep else None, digest.hexdigest(), length


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _page(name: str | None) -> int | None:
    inner = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def _read_rows(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for header, http, payload, digest, length in records(stream, with_payload):
                        kind = header["warc-type"]
                        said = header["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response":
                            if digest != said or length != int(http["content-length"]):
                                raise ValueError(f"{header['warc-record-id']} in {uri}: the payload's digest or length is wrong")
                        else:
                            digest, length = said, int(http["content-length"])
                        text = payload.decode("utf-8", "replace") if with_payload and kind == "response" else None
                        rows.append((_page(header["warc-record-id"]), header.get("warc-target-uri"), length, digest, kind, _page(header.get("warc-refers-to")), text))
                        size += len(text or "") + 200
                        if size > 8 << 20:
                            yield _rows(rows)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows)

    return run


_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _KINDS)], _NAMES)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record of archives (path, ...).

    payload is a response's text, null for a revisit, or always without
    with_payload.  A damaged record raises.  A revisit holds no payload: its
    digest and length are what its header says, which ``unresolved`` compares
    with the response that it refers to.
    """
    paths = archives.select("path")
    n = max(1, paths.count())
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
    return paths.repartition(n, "path").mapInArrow(_read_rows(with_payload), schema)


def unresolved(rows: DataFrame) -> DataFrame:
    """The revisits among rows, as read_archives gives them, that refer to no response of their digest and length."""
    met = rows.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").hint("merge")
    return rows.where("record_type = 'revisit'").join(met, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")
