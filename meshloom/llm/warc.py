"""WARC 1.1 archives: a writer that marks revisits, and a sequential reader.

Each record is one gzip member. Writers run in parallel, one archive after another in each task, into the shared
folder, each beginning with a warcinfo record; a table lists the archives that finished tasks wrote, so files of lost or repeated attempts are never read. The
reader inflates piece by piece, frames a record by its Content-Length, and checks its block and payload digests;
nothing but one piece of an archive is held. A payload is an HTTP response body; a revisit repeats the HTTP header
only, whose Content-Length gives the length of the payload it stands for.

Defined cases: a null payload is empty; payloads under ``least`` bytes are never revisits; of rows with equal payloads
the smallest key is the response (every row with that key), and null keys count as largest; a null URL gives no
WARC-Target-URI; repeated rows come back as often as they came; very long payloads are written at once and read in
pieces; extra columns may have any name; empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_row, sifted, text_or_empty

#: Payloads shorter than this are written again rather than referred to.
LEAST = 100
#: Compressed bytes after which a task begins its next archive.
ROLL = 64 << 20
PIECE = 1 << 16
#: Tasks that read archives at most; each reads its share one after another.
READERS = 1 << 15


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def one_line(value: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in value)


#: All records are of one moment, so that runs agree.
DATE = "1970-01-01T00:00:00Z"


def name_of(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}:{digest}')}>"


def info_record(archive: str) -> bytes:
    headers = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, archive)}>"), ("WARC-Date", DATE), ("WARC-Filename", archive), ("Content-Type", "application/warc-fields")]
    return record("warcinfo", headers, b"software: meshloom\r\nformat: WARC File Format 1.1\r\n")


def page_record(key: int | None, url: str | None, payload: bytes, original: int | None, original_url: str | None, is_revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = hashlib.sha256(payload).hexdigest()
    headers = [("WARC-Record-ID", name_of(key, digest)), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url:
        headers.append(("WARC-Target-URI", one_line(url)))
    if key is not None:
        headers.append(("Page-Key", str(key)))
    if not is_revisit:
        return record("response", headers, http + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name_of(original, digest)), ("WARC-Refers-To-Date", DATE)]
    if original_url:
        headers.append(("WARC-Refers-To-Target-URI", one_line(original_url)))
    headers.append(("Refers-To-Page-Key", str(original)))
    return record("revisit", headers, http)


def read_records(stream, on_block=None):
    """Yields (headers, facts) of each record of a gzipped archive but the warcinfo ones, in order.

    facts: bytes of the payload, its sha256 and whether both digests hold. on_block(headers, piece) gets the block as
    it comes. Raises ValueError on a member that isn't framed as its Content-Length says.
    """
    left = b""
    while True:
        left = left or stream.read(PIECE)
        if not left:
            return
        inflate = zlib.decompressobj(31)
        head, headers, got, body = b"", None, 0, None
        block_sha, payload_sha, http, payload_n, tail = hashlib.sha1(), hashlib.sha256(), b"", 0, b""
        while not inflate.eof:
            left = left or stream.read(PIECE)
            piece = inflate.decompress(left, PIECE)  # with no input left, what zlib still holds
            if not left and not piece and not inflate.eof:
                raise ValueError("the archive ends within a member")
            left = inflate.unconsumed_tail or inflate.unused_data
            if headers is None:
                head += piece
                at = head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                lines = head[:at].decode().split("\r\n")
                if not lines[0].startswith("WARC/1."):
                    raise ValueError("no WARC record")
                headers = dict(x.split(": ", 1) for x in lines[1:])
                body, piece = int(headers["Content-Length"]), head[at + 4 :]
            block, tail = piece[: body - got], tail + piece[body - got :] if len(piece) > body - got else tail
            got += len(block)
            block_sha.update(block)
            if on_block is not None and block:
                on_block(headers, block)
            if headers["WARC-Type"] == "warcinfo":
                continue
            if http is not None:
                http += block
                at = http.find(b"\r\n\r\n")
                if at < 0:
                    continue
                fields, block, http = http[:at], http[at + 4 :], None
                length = next(int(x[16:]) for x in fields.split(b"\r\n") if x.lower().startswith(b"content-length: "))
            payload_sha.update(block)
            payload_n += len(block)
        if headers is None or got != body or tail != b"\r\n\r\n":
            raise ValueError("a record is not framed as its Content-Length says")
        if headers["WARC-Type"] == "warcinfo":
            continue
        revisit = headers["WARC-Type"] == "revisit"
        named = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        ok = headers["WARC-Block-Digest"] == f"sha1:{base64.b32encode(block_sha.digest()).decode()}" and (revisit or (named == payload_sha.hexdigest() and length == payload_n))
        yield headers, {"payload_bytes": length, "payload_digest": named, "ok": ok}


def mark_revisits(pages: DataFrame, scratch: Scratch, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """(row, first): row holds all columns, first the smallest key of an equal payload that this row should refer to
    (struct of key and url), or null. Payloads that nobody repeats are never shuffled."""
    html = F.encode(text_or_empty(payload), "UTF-8")
    rows = pages.select(as_row(pages), F.sha2(html, 256).alias("digest"))
    of = F.struct(F.col(key).cast("long").isNull().alias("none"), F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"))
    found = pages.where(F.octet_length(html) >= least).select(F.sha2(html, 256).alias("digest"), of.alias("of"))
    firsts = scratch.write("firsts", found.groupBy("digest").agg(F.min("of").alias("of"), F.count("*").alias("n")).where("n > 1 AND NOT of.none").select("digest", "of"))
    own = F.col("row")[key].cast("long")
    later = F.col("of").isNotNull() & (own.isNull() | (own > F.col("of.key")))
    maybe = sifted(scratch, rows, firsts, "firsts", ("digest",)).join(firsts, "digest", "left").select("row", F.when(later, F.struct("of.key", "of.url")).alias("first"))
    lone = sifted(scratch, rows, firsts, "firsts", ("digest",), inside=False).select("row", F.lit(None).cast("struct<key:long,url:string>").alias("first"))
    return maybe.unionByName(lone)


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, roll: int = ROLL) -> DataFrame:
    """Writes every row as a record of a .warc.gz in ``folder``; returns (archive, records, bytes), one row an archive."""
    pages = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), text_or_empty(payload).alias(payload))
    marked = mark_revisits(pages, scratch, key, url, payload, least)
    rows = marked.select(F.col("row")[key].alias("key"), F.col("row")[url].alias("url"), F.col("row")[payload].alias("payload"), F.col("first.key").alias("original"), F.col("first.url").alias("original_url"))

    def run(batches):
        fs, top = store(folder)
        fs.create_dir(top, recursive=True)
        out, path, n, size = None, None, 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

        for batch in batches:
            for page, at, body, original, there in zip(*batch.columns):
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0  # attempts never share a file
                    out = fs.open_output_stream(f"{top}/{os.path.basename(path)}", compression=None)
                    size = out.write(info_record(os.path.basename(path)))
                original = original.as_py()
                member = page_record(page.as_py(), at.as_py(), body.as_py().encode(), original, there.as_py(), original is not None)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= roll:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return scratch.write("archives", rows.mapInArrow(run, "archive string, records long, bytes long"))


def read_archives(archives: DataFrame, size: int = 4096) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, ok) of each record of the listed archives."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "ok"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    number = lambda x: None if x is None else int(x)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        rows = []
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                fs, path = store(archive)
                with fs.open_input_stream(path, compression=None) as stream:
                    for head, facts in read_records(stream):
                        rows.append((number(head.get("Page-Key")), head.get("WARC-Target-URI"), facts["payload_bytes"], facts["payload_digest"], head["WARC-Type"], number(head.get("Refers-To-Page-Key")), facts["ok"]))
                        if len(rows) >= size:
                            yield batch_of(rows)
                            rows = []
        if rows:
            yield batch_of(rows)

    # a task for each archive up to as many as may run: a stated number, which adaptive execution leaves alone
    tasks = max(1, min(archives.count(), READERS))
    return archives.select("archive").repartition(tasks).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, ok boolean")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back; fails on a digest that doesn't hold."""
    scratch = Scratch(pages.sparkSession, "warc")
    archives = write_archives(pages, scratch.path("files"), scratch)
    rows = read_archives(archives)
    held = F.when(F.col("ok"), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("digest of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("string"))
    return rows.select("page_id", "payload_bytes", "payload_digest", held.alias("record_type"), "refers_to")
