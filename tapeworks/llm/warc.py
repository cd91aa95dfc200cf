"""WARC archives through a chunked record table.

Payloads move as rows of (record, chunk number, bytes): an oversized payload is cut into
chunks before it reaches a writer, and a reader gives out chunk rows with the digest of
the payload so far, so neither holds a whole record.  Records with equal payloads are
written once: the one with the smallest page_id is a response, the others are revisit
records that refer to it.

Archives are gzip files, a member for each record, in the shared folder.  A task writes
under a name of its own and renames when done, so an attempt that dies leaves nothing
that is read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, batch_of, bounded_batches, cut_lineage, shared_dir, size_checked

CHUNK = 256 * 1024
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64())])


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file:" + uri.removeprefix("file:"))


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Chunk rows of one record for each row of ``pages`` (page_id, url, html).

    page_id, url, sha1, n_bytes, refers_to, chunk_no, n_chunks, chunk.  Payloads are the html
    in UTF-8 (null: empty).  Of equal payloads of ``least_bytes`` at least, the smallest
    page_id is the response; refers_to names it in the others, whose chunk is empty.
    A record's chunk rows follow each other in order.  What says which rows are revisits
    is broadcast if it is small, so payloads move only where it is not.
    """
    bounded_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.select("page_id", "url", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"), "payload")
    keys = rows.where(F.col("n_bytes") >= least_bytes).select("page_id", "sha1", "n_bytes")
    firsts = keys.groupBy("sha1", "n_bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    later = keys.join(firsts, ["sha1", "n_bytes"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    later = size_checked(cut_lineage(later.select(F.col("page_id").alias("r_id"), F.col("sha1").alias("r_sha1"), F.col("first").alias("refers_to"))))
    rows = rows.join(later, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("sha1") == F.col("r_sha1")), "left")
    stored = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    rows = rows.select("page_id", "url", "sha1", "n_bytes", "refers_to", stored.alias("stored"))
    return rows.mapInArrow(_cut_payloads, "page_id long, url string, sha1 string, n_bytes long, refers_to long, chunk_no int, n_chunks int, chunk binary")


def _cut_payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows of each payload, no more than a few chunks at a time."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("sha1", pa.string()), ("n_bytes", pa.int64()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("n_chunks", pa.int32()), ("chunk", pa.binary())])
    for batch in batches:
        rows, held = [[] for _ in schema], 0
        for *fields, stored in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "sha1", "n_bytes", "refers_to")), (x.as_buffer() for x in batch.column("stored")), strict=True):
            view = memoryview(stored)
            last = max(1, -(-len(view) // CHUNK))
            for number in range(last):
                chunk = bytes(view[number * CHUNK : (number + 1) * CHUNK])
                for column, x in zip(rows, (*fields, number, last, chunk), strict=True):
                    column.append(x)
                held += len(chunk)
                if held >= SLICE_BYTES:
                    yield batch_of(schema, *rows)
                    rows, held = [[] for _ in schema], 0
        yield batch_of(schema, *rows)


def _header(page_id, url, digest: str, n_bytes: int, refers_to) -> bytes:
    url = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>")]
    fields += [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", n_bytes)]
    fields += [(k, v) for k, v in (("WARC-Target-URI", url), ("X-Page-Id", page_id)) if v not in ("", None)]
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {digest}')}>"), ("X-Refers-To-Page-Id", refers_to)]
    fields += [("Content-Type", "text/html"), ("Content-Length", n_bytes if refers_to is None else 0)]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write chunk rows of :func:`records` as WARC files; path and n_records of each file.

    A file for each partition that has rows.
    """
    bounded_batches(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, own, count, zipped = None, "", "", 0, None
        for batch in batches:
            for page_id, url, sha1, n_bytes, refers_to, number, last, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    task = TaskContext.get()
                    fs, base = _filesystem(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"part-{task.partitionId():06d}.warc.gz"
                    own = f"{base}/.{name}.{task.taskAttemptId()}"
                    out = fs.open_output_stream(own, compression=None)
                if number == 0:
                    zipped = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(zipped.compress(_header(page_id, url, base32(sha1), n_bytes, refers_to)))
                    count += 1
                out.write(zipped.compress(chunk))
                if number == last - 1:
                    out.write(zipped.compress(b"\r\n\r\n") + zipped.flush())
        if out is not None:
            out.close()
            fs.move(own, f"{base}/{name}")
            yield batch_of(_MANIFEST, [f"{folder}/{name}"], [count])

    return chunks.mapInArrow(run, "path string, n_records long")


def _members(file, block: int) -> Iterator[Iterator[bytes]]:
    """The records of a gzip file, each as an iterator of plain blocks."""
    rest = b""
    while True:
        rest = rest or file.read(block)
        if not rest:
            return
        opened = zlib.decompressobj(31)

        def blocks() -> Iterator[bytes]:
            nonlocal rest
            while not opened.eof:
                rest = rest or file.read(block)
                if not rest:
                    raise EOFError("the archive ends within a record")
                plain = opened.decompress(rest, block)
                rest = opened.unused_data if opened.eof else opened.unconsumed_tail
                if plain:
                    yield plain

        member = blocks()
        yield member
        for _ in member:  # what the reader left
            pass


def _record(member: Iterator[bytes]) -> tuple[dict[str, str], Iterator[bytes]]:
    """Header fields and payload blocks of a record."""
    head = b""
    while b"\r\n\r\n" not in head:
        head += next(member)
    head, _, rest = head.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])

    def payload(left: int, piece: bytes) -> Iterator[bytes]:
        while True:
            if piece[:left]:
                yield piece[:left]
            left -= min(left, len(piece))
            if not left:
                return
            piece = next(member)

    return fields, payload(int(fields["Content-Length"]), rest)


_CHUNKS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("header_digest", pa.string()), ("payload_bytes", pa.int64()), ("chunk_no", pa.int32()), ("is_last", pa.bool_()), ("digest_so_far", pa.string()), ("chunk", pa.binary())])


def read_archives(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """Chunk rows of the archives at ``path``: record fields, chunk_no, is_last,
    digest_so_far (SHA-1 in base32 of the payload up to this chunk) and chunk.

    A record without payload has one empty chunk.  Without ``with_data`` chunk is null.
    payload_bytes are the bytes read so far of a response, the length that the header gives of
    a revisit.  Raises ValueError where length or digest of a response are not what its header says.
    """
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            fs, place = _filesystem(path)
            rows: list[list] = [[] for _ in _CHUNKS]
            held = 0

            def add(fields, number, last, digest, size, chunk, rows=rows, path=path):
                page, ref = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                header, length, so_far = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"]), base64.b32encode(digest.digest()).decode()
                if fields["WARC-Type"] == "revisit":
                    size = length
                elif last and (size, so_far) != (length, header):
                    raise ValueError(f"{fields['WARC-Record-ID']} in {path}: {size} bytes of digest {so_far} were read, the header says {length} of {header}")
                row = (page and int(page), fields.get("WARC-Target-URI"), fields["WARC-Record-ID"], fields["WARC-Type"], ref and int(ref), header, size, number, last, so_far, chunk if with_data else None)
                for column, value in zip(rows, row, strict=True):
                    column.append(value)

            with fs.open_input_stream(place, compression=None) as file:
                for member in _members(file, CHUNK):
                    fields, blocks = _record(member)
                    digest, number, size, before = hashlib.sha1(), 0, 0, b""
                    for block in blocks:
                        if number or before:
                            add(fields, number, False, digest, size, before)
                            held += len(before)
                            number += 1
                        digest.update(block)
                        size += len(block)
                        before = block
                    add(fields, number, True, digest, size, before)
                    held += len(before)
                    if held > 1 << 22 or len(rows[0]) >= 2000:
                        yield batch_of(_CHUNKS, *rows)
                        held = 0
                        for column in rows:
                            column.clear()
            yield batch_of(_CHUNKS, *rows)

    return manifest.select("path").repartition(n).mapInArrow(run, "page_id long, url string, record_id string, record_type string, refers_to long, header_digest string, payload_bytes long, chunk_no int, is_last boolean, digest_so_far string, chunk binary")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as WARC files now; their manifest (path, n_records).

    Without ``folder``, a new one within the cluster's shared folder.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return cut_lineage(write_archives(records(pages), folder))


def digests(manifest: DataFrame) -> DataFrame:
    """A row for each record read back: page_id, payload_bytes, payload_digest,
    record_type, refers_to.

    A response's digest is worked out from the stored bytes, a revisit's is the one it names.
    Null html is an empty payload; repeated rows of a page are responses alike; null
    page_ids are kept, and are never the response that others refer to; an empty table
    gives no record.
    """
    rows = read_archives(manifest, with_data=False).where("is_last")
    digest = F.when(F.col("record_type") == "response", F.col("digest_so_far")).otherwise(F.col("header_digest"))
    return rows.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
