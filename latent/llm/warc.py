"""WARC archives compressed record by record with a Zstandard dictionary.

An archive is a skippable frame that holds the dictionary, then one frame for each record.
The reader loads the dictionary from that frame, decodes frame by frame in a stream, and
validates each record: version, mandatory fields, lengths of block and payload, the digest of
the payload, the end of the record, and that the frame holds nothing else.

Archives are files under a folder that all executors share, written under a temporary name
and then renamed, so a task that runs again leaves the same files.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latent.session import Workspace

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

RECORD = "page_id long, url string, record_type string, payload_bytes long, " \
         "payload_digest string, refers_to long"


# -- one record -----------------------------------------------------------------------

def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    if not (uri.startswith("<urn:page:") and uri.endswith(">")):
        raise ValueError(f"unknown record id {uri}")
    return None if uri[10:-1] == "none" else int(uri[10:-1])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str,
           first: int | None, revisit: bool, date: str) -> bytes:
    """A response record, or a revisit record of the one of page ``first``."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _id(page_id),
            "WARC-Date": date, "Content-Type": "application/http;msgtype=response",
            "WARC-Payload-Digest": f"sha1:{digest}", "Content-Length": len(block)}
    if url is not None:  # a header is one line: control characters are escaped
        head["WARC-Target-URI"] = "".join(
            c if ord(c) > 31 and ord(c) != 127 else f"%{ord(c):02X}" for c in url)
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _id(first)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"malformed header line {line!r}")
        out[name.lower()] = value.strip()
    return out


def parse(data: bytes) -> dict:
    """The record in a decoded frame; ValueError says what is wrong with a bad one."""
    head, end, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION or not end:
        raise ValueError(f"not a {VERSION.decode()} record: {data[:20]!r}")
    fields = _fields(lines)
    for name in NEEDED:
        if name.lower() not in fields:
            raise ValueError(f"no {name}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, Content-Length {length}")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        raise ValueError(f"unexpected record type {kind}")
    http, end, payload = rest[:length].partition(b"\r\n\r\n")
    status, *lines = http.split(b"\r\n")
    if not end or not status.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    size = int(_fields(lines)["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != size:
            raise ValueError(f"payload of {len(payload)} bytes, Content-Length {size}")
        if base32(hashlib.sha1(payload).digest()) != digest:
            raise ValueError("payload and digest differ")
    elif payload or "warc-refers-to" not in fields:
        raise ValueError("a revisit holds no payload and names its response")
    return {"page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"),
            "record_type": kind, "payload_bytes": size, "payload_digest": digest,
            "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None,
            "payload": payload if kind == "response" else None}


# -- one archive ----------------------------------------------------------------------

def train_dictionary(samples: list[bytes], size: int = 1 << 16) -> bytes:
    """Dictionary from sample records; few samples are the dictionary themselves."""
    import zstandard as zstd
    if sum(map(len, samples)) > 8 * size and len(samples) > 16:
        try:
            return zstd.train_dictionary(size, samples).as_bytes()
        except zstd.ZstdError:  # nothing in common to train on
            pass
    return b"".join(samples)[:size] or record(0, "", b"", base32(b""), None, False, "")


def header_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def read_archive(source: io.RawIOBase, chunk: int = 1 << 18) -> Iterator[dict]:
    """Records of an archive in a stream; at most a record and a chunk are in memory."""
    import zstandard as zstd
    head = source.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    dictionary = source.read(size)
    if len(dictionary) != size:
        raise ValueError("the dictionary frame is cut short")
    decoder = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(dictionary))
    data = source.read(chunk)
    while data:
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            if not data and not (data := source.read(chunk)):
                raise ValueError("the last frame is cut short")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
        yield parse(b"".join(parts))
        data = data or source.read(chunk)


# -- Spark jobs -----------------------------------------------------------------------

def _rows(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"), html.alias("payload"),
                        F.sha1(html).alias("digest"))


def responses(ws: Workspace, rows: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, digest, first) of the rows that revisit the response of page ``first``."""
    ids = ws.cut(rows.where(F.length("payload") >= min_bytes).select("page_id", "digest"), "ids")
    first = (ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("digest", "first"))
    return ws.cut(ids.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
                  .select("page_id", "digest", "first").distinct(), "revisits")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = 1 << 24,
                   samples: int = 400, sample_bytes: int = 1 << 16,
                   date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); (path, records) of the
    archives, each closed after ``archive_bytes`` of payload.

    Of rows with equal payloads of ``min_bytes`` or more, that of the smallest ``page_id`` is
    the response and the others revisit it; rows that repeat its id as well are responses
    too. A null html is an empty payload, a null id counts as the largest. The dictionary is
    trained on at most ``samples`` payloads of at most ``sample_bytes``.
    """
    import pyarrow.fs as fs
    spark = pages.sparkSession
    ws, rows = Workspace(spark), _rows(pages)
    # Digests of the least hashes are chosen first, so that only payloads of the sample move.
    fit = rows.where(F.length("payload").between(1, sample_bytes))
    least = [r[0] for r in fit.select("digest").distinct().orderBy(F.xxhash64("digest"), "digest")
             .limit(samples).collect()]
    taken = (fit.where(F.col("digest").isin(least)).groupBy("digest").agg(
        F.min(F.struct("page_id", "url")).alias("at"), F.first("payload").alias("payload"))
        .orderBy("digest").collect())
    dictionary = train_dictionary([record(
        r["at"].page_id, r["at"].url, bytes(r.payload), base32(bytes.fromhex(r.digest)), None, False,
        date) for r in taken])
    revisits = responses(ws, rows, min_bytes).withColumnsRenamed(
        {"page_id": "_id", "digest": "_digest"}).withColumn("revisit", F.lit(True))
    joined = rows.join(revisits, rows.page_id.eqNullSafe(F.col("_id"))
                       & (rows.digest == F.col("_digest")), "left").select(
        "page_id", "url", "payload", "digest", "first", F.coalesce("revisit", F.lit(False)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        coder = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(dictionary))
        task, serial, out = TaskContext.get().partitionId(), 0, None
        attempt = uuid.uuid4().hex[:12]
        done: dict[str, list] = {"path": [], "records": []}

        def close():
            nonlocal out, serial
            out.close()
            # An attempt has names of its own, and only the winner's are listed.
            name = f"part-{task:06d}-{serial:04d}-{attempt}.warc.zst"
            store.move(temporary, f"{root}/{name}")
            done["path"].append(f"{folder}/{name}")
            done["records"].append(held)
            out, serial = None, serial + 1

        for batch in batches:
            for page, url, payload, digest, first, revisit in zip(
                    *(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    temporary, size, held = f"{root}/.{uuid.uuid4().hex}", 0, 0
                    out = store.open_output_stream(temporary, compression=None)
                    out.write(header_frame(dictionary))
                out.write(coder.compress(record(page, url, payload, base32(bytes.fromhex(digest)),
                                                first, revisit, date)))
                size, held = size + len(payload), held + 1
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict(done, pa.schema([("path", pa.string()),
                                                          ("records", pa.int64())]))

    return ws.cut(joined.mapInArrow(write, "path string, records long"), "archives")


def read_archives(archives: DataFrame, payload: bool = False, batch: int = 2000) -> DataFrame:
    """The records of the archives listed in ``path``, in no particular order."""
    shape = RECORD + (", payload binary" if payload else "")
    names = [part.split()[0] for part in shape.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        from pyspark.sql.pandas.types import to_arrow_schema
        schema = to_arrow_schema(struct_type)
        for paths in batches:
            for path in paths.column(0).to_pylist():
                store, file = fs.FileSystem.from_uri(path)
                held, size = [], 0
                with store.open_input_stream(file, compression=None) as source:
                    for one in read_archive(source):
                        held.append({n: one[n] for n in names})
                        size += one["payload_bytes"] if payload else 0
                        if len(held) >= batch or size > 1 << 24:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    struct_type = archives.sparkSession.createDataFrame([], shape).schema
    # A given number of partitions stays as it is, so archives are read by as many tasks.
    n = max(1, archives.count())
    return archives.select("path").repartition(n, "path").mapInArrow(read, shape)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    ws = Workspace(pages.sparkSession)
    folder = ws.path if "://" in ws.path else f"file://{ws.path}"
    return read_archives(write_archives(pages, f"{folder}/warc", min_bytes))
