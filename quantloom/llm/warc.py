"""WARC archives, index first.

Writing. Each task writes its rows as one archive of gzipped records (one gzip
member a record) to the shared folder and returns an index row per record: file,
offset, length, URL, digest. The index is written as a Parquet table; Spark's
commit protocol keeps the rows of one attempt of each task, and every attempt
writes a file of its own name, so index and archives agree whatever executors are
lost. Payloads that occur before get revisit records without a body.

Reading. Selected index rows are sorted by file and offset; ranges that touch or
lie within ``gap`` bytes are read in one call, up to ``span`` bytes, and cut into
records there. Files are cut into groups of ranges, so no task holds an archive.

Paths go through pyarrow's file systems (local files, HDFS, S3, GCS by URI).

Which record is the response: of equal payloads of at least ``min_bytes`` bytes
(equal SHA-1 and length) the row with the largest id; all others revisit it.
Smaller payloads are all responses. Null payloads are empty. Rows with equal ids
and payloads are both the response; rows of one id with different payloads are
judged each by its own. A null URL is written as an empty one; rows without id are
written with an empty record id, read back as null, and always responses. Other
columns are ignored.

Archives of task attempts that failed are in no index; ``sweep`` removes them once
the index is written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.scratch import Scratch


CRLF = b"\r\n"
INDEX = "file string, offset long, length long, id {id}, url string, payload_digest string, payload_bytes long, record_type string, refers_to {id}"


def open_path(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def record(rid: str, url: str, payload: bytes, digest: str, size: int, refers_to: str | None, level: int = 1) -> bytes:
    """One gzipped WARC/1.1 record; a revisit has no body. The date is fixed: archives are reproducible."""
    kind = "revisit" if refers_to is not None else "response"
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: <urn:page:" + rid.encode() + b">",
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + "".join(url.splitlines()).encode(),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"X-Payload-Length: " + str(size).encode(),
        b"Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:" + refers_to.encode() + b">"]
    head.append(b"Content-Length: " + str(len(payload)).encode())
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(CRLF.join(head) + CRLF * 2 + payload + CRLF * 2) + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one gzipped record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(CRLF * 2)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != CRLF * 2:
        raise ValueError("a record's length does not agree with its header")
    return fields, rest[:size]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _write(batches, folder: str):
    fs, base = open_path(folder)
    name = f"part-{uuid.uuid4().hex}.warc.gz"  # of this attempt alone
    out, offset = None, 0
    for batch in batches:
        index = {c: [] for c in ("offset", "length", "digest", "size", "kind")}
        for rid, url, payload, refers in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers_to"))):
            if out is None:
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            body = (payload.as_py() or "").encode()
            other = str(refers.as_py()) if refers.is_valid else None
            digest = base32_sha1(body)
            data = record(str(rid.as_py()) if rid.is_valid else "", url.as_py() or "", b"" if other is not None else body, digest, len(body), other)
            out.write(data)
            for c, v in zip(index, (offset, len(data), digest, len(body), "response" if other is None else "revisit")):
                index[c].append(v)
            offset += len(data)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{name}"] * n, pa.string()), pa.array(index["offset"], pa.int64()), pa.array(index["length"], pa.int64()), batch.column("id"), batch.column("url"), pa.array(index["digest"], pa.string()), pa.array(index["size"], pa.int64()), pa.array(index["kind"], pa.string()), batch.column("refers_to")],
            ["file", "offset", "length", "id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to"],
        )
    if out is not None:
        out.close()


def revisits(pages: DataFrame, scratch: Scratch, min_bytes: int) -> DataFrame:
    """(id, digest, size, refers_to) of the rows whose payload another row's response holds."""
    known = scratch.table(pages.select("id", *_payload_key()).where(F.col("size") >= min_bytes), "digests")
    groups = known.groupBy("digest", "size").agg(F.max("id").alias("refers_to"), F.min("id").alias("least")).where("least < refers_to").drop("least")
    found = known.join(scratch.table(groups, "groups"), ["digest", "size"]).where("id < refers_to").select("id", "digest", "size", "refers_to").distinct()
    found = scratch.table(found, "revisits")
    scratch.drop(known)
    return found


def _payload_key():
    payload = F.coalesce("payload", F.lit(""))
    return F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")


def sweep(index: DataFrame, folder: str) -> int:
    """Remove the archives of ``folder`` that the index does not name; returns how many. One name per task comes to the driver."""
    fs, base = open_path(folder)
    known = {open_path(r["file"])[1] for r in index.select("file").distinct().collect()}
    lost = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(base)) if f.path.endswith(".warc.gz") and f.path not in known]
    for path in lost:
        fs.delete_file(path)
    return len(lost)


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write every row as a record; the index table (see INDEX) is returned from where it was written."""
    scratch = Scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    kind = rows.schema["id"].dataType.simpleString()
    folder = folder or scratch.path("archives")
    fs, base = open_path(folder)
    fs.create_dir(base, recursive=True)
    others = revisits(rows, scratch, min_bytes)
    marked = rows.select("*", *_payload_key()).join(others.hint("merge"), ["id", "digest", "size"], "left")
    return scratch.table(marked.select("id", "url", "payload", "refers_to").mapInArrow(lambda b: _write(b, folder), INDEX.format(id=kind)), "index")


def ranges(offsets: list[int], lengths: list[int], gap: int, span: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after the last, first byte, byte after the last) of reads that cover sorted records."""
    i = 0
    while i < len(offsets):
        j, end = i + 1, offsets[i] + lengths[i]
        while j < len(offsets) and offsets[j] - end <= gap and max(end, offsets[j] + lengths[j]) - offsets[i] <= span:
            end = max(end, offsets[j] + lengths[j])
            j += 1
        yield i, j, offsets[i], end
        i = j


def _read(batches, gap: int, span: int, with_payload: bool):
    """Records of index rows in their order; a batch goes out when its payloads reach ``span`` bytes."""
    kinds = {c: pa.int64() if c == "payload_bytes" else pa.string() for c in ("id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
    made = lambda out: pa.RecordBatch.from_arrays([pa.array(v, kinds[c]) for c, v in out.items()], list(out))
    urn = lambda v: v[len("<urn:page:") : -1] or None if v else None
    name, handle = None, None
    for batch in batches:
        out, held = {c: [] for c in kinds}, 0
        files = batch.column("file").to_pylist()
        offsets, lengths = batch.column("offset").to_pylist(), batch.column("length").to_pylist()
        lo = 0
        while lo < len(files):
            hi = lo
            while hi < len(files) and files[hi] == files[lo]:
                hi += 1
            if files[lo] != name:
                if handle is not None:
                    handle.close()
                name = files[lo]
                fs, path = open_path(name)
                handle = fs.open_input_file(path)
            for i, j, first, end in ranges(offsets[lo:hi], lengths[lo:hi], gap, span):
                data = handle.read_at(end - first, first)
                for r in range(lo + i, lo + j):
                    at = offsets[r] - first
                    fields, body = parse(data[at : at + lengths[r]])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (base32_sha1(body) != digest or len(body) != int(fields["X-Payload-Length"])):
                        raise ValueError(f"damaged record at {offsets[r]} of {name}")
                    row = (urn(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], urn(fields.get("WARC-Refers-To")), body.decode() if with_payload else None)
                    for c, v in zip(out, row):
                        out[c].append(v)
                    held += len(body) if with_payload else 0
                    if held > span:
                        yield made(out)
                        out, held = {c: [] for c in kinds}, 0
            lo = hi
        yield made(out)
    if handle is not None:
        handle.close()


def read_archives(index: DataFrame, gap: int = 64 << 10, span: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """Read the records of the given index rows; filter the index to select records.

    Rows are ranged by file and stretch of 4 spans, and sorted by offset inside
    each, so that one task reads neighbouring bytes in order.
    """
    kind = index.schema["id"].dataType.simpleString()
    stretch = F.floor(F.col("offset") / F.lit(4 * span))
    # Counted by archive bytes: sized by its own few bytes a record, the index would be dealt to too few tasks.
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (16 * span)))
    rows = index.select("file", "offset", "length").repartition(tasks, "file", stretch).sortWithinPartitions("file", "offset")
    schema = "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload string"
    got = rows.mapInArrow(lambda b: _read(b, gap, span, with_payload), schema)
    return got.withColumns({c: F.col(c).cast(kind) for c in ("id", "refers_to")})


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all rows, read all records back: id, payload_bytes, payload_digest, record_type, refers_to."""
    index = write_archives(pages, None, min_bytes, id_col, url_col, payload_col)
    got = read_archives(index, with_payload=False)
    return got.select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
