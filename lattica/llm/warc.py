"""WARC archives: one gzip member per record, written in parts and read back sequentially.

The reader inflates one member at a time with an incremental zlib object, frames the block by
Content-Length and checks the digests, so it holds one record and one piece of the archive; a member that
inflates past its length is refused there and then. Archives are files in the shared folder (any file system
that pyarrow reaches by URI). A part is named by task and attempt and is never renamed; the table of parts that
the tasks which counted have written is kept beside them, and only those parts are read, each to its number of
records. What a lost or repeated attempt leaves behind is not read. Foreign archives are read from their folder
by Spark's binaryFile source.

Nulls: null html is an empty payload, a null url an empty target; a null page_id is written as an
empty record id and read back as null. Empty tables give no records. Repeated rows with the same
page_id: each row gets its record; of equal payloads every row with the largest page_id is a response, and a
null page_id is always one. Columns of any other name may come with the pages.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Stage, join_heavy, new_path

#: Payloads shorter than this are never written as revisits.
REVISIT_BYTES = 1000
#: A new archive part begins after so many compressed bytes; also what one reader task is handed at a time.
PART_BYTES = 16 << 20
PIECE_BYTES = 1 << 18
#: A record's headers are no longer than this.
HEAD_BYTES = 1 << 20

ARCHIVED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


class DigestError(ValueError):
    pass


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def warc_record(page_id, url, payload: bytes | None, digest: bytes, size: int, refers_to) -> bytes:
    """One gzip member. payload None: a revisit of the record of page refers_to."""
    block = payload or b""
    kind = "response" if payload is not None else "revisit"
    name = lambda x: "" if x is None else f"<urn:page:{x}>"
    target = "".join(c for c in url or "" if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{_b32(digest)}",
        f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).digest())}",
        f"X-Payload-Length: {size}",
    ]
    if payload is None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(block)}", "", ""]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode()) + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def read_records(pieces):
    """(headers, block) of each record of an archive that comes as an iterable of byte pieces."""
    pieces = iter(pieces)
    raw = b""
    while True:
        while not raw:
            raw = next(pieces, None)
            if raw is None:
                return
        inflate = zlib.decompressobj(31)
        got = bytearray()
        headers, need = None, None
        while not inflate.eof:
            if not raw:
                raw = next(pieces, None)
                if raw is None:
                    raise EOFError("the archive ends within a record")
            got += inflate.decompress(raw, PIECE_BYTES)
            raw = inflate.unconsumed_tail or inflate.unused_data
            if headers is None and (at := got.find(b"\r\n\r\n")) >= 0:
                lines = got[:at].decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
                headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
                del got[: at + 4]
                need = int(headers["Content-Length"])
            if len(got) > (HEAD_BYTES if headers is None else need + 4):
                raise ValueError("a record inflates past its headers or its Content-Length")
        raw = inflate.unused_data
        if headers is None or len(got) != need + 4 or got[need:] != b"\r\n\r\n":
            raise ValueError("a record's block is not framed by its Content-Length")
        yield headers, bytes(got[:need])


def verify(headers: dict, block: bytes) -> None:
    found = f"sha1:{_b32(hashlib.sha1(block).digest())}"
    if headers["WARC-Block-Digest"] != found:
        raise DigestError(f"block digest of {headers['WARC-Record-ID']}: {found}")
    if headers["WARC-Type"] == "response" and (headers["WARC-Payload-Digest"] != found or int(headers["X-Payload-Length"]) != len(block)):
        raise DigestError(f"payload digest of {headers['WARC-Record-ID']}")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def write_archives(records: DataFrame, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Writes (page_id, url, html, digest, refers_to) rows as part files under path; gives (part, records, bytes).

    Each evaluation writes parts of its own: keep the table, it says which parts there are.
    """

    def write(batches):
        from pyspark import TaskContext

        store, root = _store(path)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        task = f"{context.partitionId():06d}-{context.taskAttemptId()}"  # no other attempt has this name
        part, out, count, size = 0, None, 0, 0

        def close():
            out.close()
            return pa.RecordBatch.from_pydict({"part": [f"part-{task}-{part:04d}.warc.gz"], "records": [count], "bytes": [size]})

        for batch in batches:
            for row in range(batch.num_rows):
                page, url, html, digest, refers = (batch.column(k)[row].as_py() for k in range(5))
                if out is None:
                    out, count, size = store.open_output_stream(f"{root}/part-{task}-{part:04d}.warc.gz", compression=None), 0, 0
                body = (html or "").encode()
                record = warc_record(page, url, body if refers is None else None, digest, len(body), refers)
                out.write(record)
                count, size = count + 1, size + len(record)
                if size >= part_bytes:
                    yield close()
                    out, part = None, part + 1
        if out is not None:
            yield close()

    rows = records.select("page_id", "url", "html", "digest", "refers_to")
    return rows.mapInArrow(write, "part string, records long, bytes long")


def _page(name: str | None) -> int | None:
    return int(name[len("<urn:page:") : -1]) if name else None


def _rows(pieces):
    """Batches of ARCHIVED for the records of one archive, of at most about a thousand rows."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    rows = []
    for headers, block in read_records(pieces):
        verify(headers, block)
        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        rows.append((_page(headers["WARC-Record-ID"]), int(headers["X-Payload-Length"]), digest, headers["WARC-Type"], _page(headers.get("WARC-Refers-To")), headers["WARC-Target-URI"]))
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)


def read_parts(parts: DataFrame, path: str) -> DataFrame:
    """A row per record of the parts under path that the table write_archives() gave names.

    A digest that fails, a part that is not there or another number of records fails the job.
    """

    def read(batches):
        store, root = _store(path)
        for batch in batches:
            for part, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = 0
                with store.open_input_stream(f"{root}/{part}", compression=None) as raw:
                    for rows in _rows(iter(lambda: raw.read(PIECE_BYTES), b"")):
                        found += rows.num_rows
                        yield rows
                if found != records:
                    raise EOFError(f"{part} holds {found} records of {records}")

    n = max(1, parts.count())
    return parts.select("part", "records").repartition(n).mapInArrow(read, ARCHIVED)


def read_archives(spark, path: str) -> DataFrame:
    """A row per record of all .warc.gz files under path, of whatever origin; a failed digest fails the job."""

    def read(batches):
        for batch in batches:
            for blob in batch.column(0):
                view = memoryview(blob.as_buffer())
                yield from _rows(view[k : k + PIECE_BYTES] for k in range(0, len(view), PIECE_BYTES))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select("content").mapInArrow(read, ARCHIVED)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes every page to archives under path and reads them back (columns ARCHIVED).

    Of pages with equal payloads of REVISIT_BYTES or more the largest page_id is the response.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.unhex(F.sha1(body)).alias("digest"), F.octet_length(body).alias("size"), F.unhex(F.sha2(body, 256)).alias("sha"))
    groups = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("sha").agg(F.max("page_id").alias("response"), F.min("page_id").alias("least"), F.count("*").alias("pages"))
    groups = Stage(groups.where("least < response").select("sha", "response", "pages"), "payloads")
    # the payload's copies learn their response by digest alone, so the pages themselves are not shuffled by it
    light = Stage(rows.where(F.col("size") >= REVISIT_BYTES).select("page_id", "sha"), "copies")
    revisits = join_heavy(light.df, groups.df, "sha", "pages", light.df.count(), "inner").where("page_id < response").select("page_id", "sha", F.col("response").alias("refers_to")).distinct()
    revisits = Stage(revisits, "revisits")
    joined = rows.join(revisits.df, ["page_id", "sha"], "left")
    written = Stage(write_archives(joined, path), "warc-parts")
    for stage in (groups, light, revisits):
        stage.drop()
    return read_parts(written.df, path)
