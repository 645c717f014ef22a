"""WARC archives in which every record is a Zstandard frame of its own, compressed with the archive's dictionary.

Every task writes whole archives to a shared folder. It trains a dictionary on a bounded sample of the archive's own
records, puts it into a leading skippable frame, and compresses each record separately, so that a record can be read
given its offset and the head of the file. Of equal payloads one record is a response, the others revisit it.

Defined cases: a null html is an empty payload; an archive whose records give no dictionary (too few, or all alike) has
no dictionary frame; a record larger than an archive's target size has an archive of its own; rows that agree in page
and payload are written as often as they occur, all alike; a null page is larger than every other and is written
without a number; an empty table gives no archives; other columns are ignored.
"""

import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from .store import kept, narrow, shared_folder, utf8

#: Payloads below this length are never revisits; magic numbers of the dictionary and of a data frame.
REVISIT_FROM = 100
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes per archive; bounds of a dictionary and of the sample it is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, SAMPLE_RECORDS = 24 << 20, 32 << 10, 4 << 20, 1000
DATE = "1970-01-01T00:00:00Z"


def record_roles(pages, id_col="page_id", payload_col="html"):
    """Per page: payload length, digest, record type and the response it refers to."""
    rows = kept(narrow(pages, page_id=id_col, html=payload_col).select(
        "page_id", F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("payload_bytes"),
        F.sha2(utf8(F.col("html")), 256).alias("payload_digest"),
    ), "payloads")
    groups = rows.where(F.col("payload_bytes") >= REVISIT_FROM).groupBy("payload_digest").agg(
        F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))
    several = kept(groups.where("n > 1").select(F.col("payload_digest").alias("of"), "first_page"), "repeats")
    revisits = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return rows.join(several, F.col("payload_digest") == F.col("of"), "left").select(
        "page_id", "payload_bytes", "payload_digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first_page")).alias("refers_to"),
    )


def _name(page_id, digest):
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id, url, payload, digest, record_type, refers_to):
    """One WARC record; a revisit keeps the length and digest of the payload it leaves out."""
    body = payload if record_type == "response" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_name(page_id, digest)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + " ".join((url or "").split()), f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}",
    ]
    if record_type == "revisit":
        lines += [f"WARC-Refers-To: {_name(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def dictionary(records):
    """Trained on records spread over the archive, or None where they hold nothing in common to learn."""
    step = max(1, len(records) // SAMPLE_RECORDS)
    share = SAMPLE_BYTES // max(1, len(records[::step]))
    sample = [r[:max(share, 256)] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8) if len(sample) >= 8 else None
    except zstandard.ZstdError:
        return None


def archive(records):
    """The bytes of an archive."""
    trained = dictionary(records)
    head, options = b"", {}
    if trained is not None:
        packed = zstandard.compress(trained.as_bytes())
        head, options = struct.pack("<II", SKIPPABLE, len(packed)) + packed, {"dict_data": trained}
    compressor = zstandard.ZstdCompressor(level=3, write_content_size=True, **options)
    return head + b"".join(map(compressor.compress, records))


def frames(data):
    """The records of an archive."""
    view, at, options = memoryview(data), 0, {}
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", view, 4)[0]
        raw = bytes(view[8:8 + size])
        at, options = 8 + size, {"dict_data": zstandard.ZstdCompressionDict(zstandard.decompress(raw) if raw[:4] == FRAME else raw)}
    decompressor = zstandard.ZstdDecompressor(**options)
    while at < len(view):
        frame, parts, step = decompressor.decompressobj(), [], 8192
        while not frame.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            piece = view[at:at + step]
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
            step = min(step * 2, 1 << 20)
        yield b"".join(parts)


def parsed(data):
    """Fields of a record: page, url, payload, length and digest of the full payload, type and response."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    page = lambda name: int(p) if (p := fields[name].split(":")[2]) else None
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"] == "revisit"
    length = int(http.rpartition(b"Content-Length: ")[2])
    if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"a damaged record of page {page('WARC-Record-ID')}")
    return {
        "page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload": None if revisit else payload,
        "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": page("WARC-Refers-To") if revisit else None,
    }


def _writer(folder):
    def write(batches):
        part = TaskContext.get().partitionId()
        fs, path = _file_system(folder)
        fs.create_dir(path, recursive=True)
        records, size, done = [], 0, 0

        def put():
            # A repeated task writes the same bytes under the same name; readers never see half of a file.
            name, own = f"part-{part:06d}-{done:05d}.warc.zst", f"{path}/_{uuid.uuid4().hex}"
            data = archive(records)
            with fs.open_output_stream(own, compression=None) as out:
                out.write(data)
            fs.move(own, f"{path}/{name}")
            return pa.record_batch({"archive": pa.array([name]), "records": pa.array([len(records)]), "bytes": pa.array([len(data)])})

        for batch in batches:
            for row in batch.to_pylist():
                if records and size + len(row["payload"]) > ARCHIVE_BYTES:
                    yield put()
                    records, size, done = [], 0, done + 1
                records.append(record(**row))
                size += len(row["payload"])
        if records:
            yield put()

    return write


def _file_system(folder):
    if folder.startswith("file:") or folder.startswith("/"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def write_archives(pages, folder, id_col="page_id", payload_col="html", url_col="url"):
    """Write a record per row and return the list of archives. Rows are sorted within a task, so that a task which runs
    again (or twice at once) gives the same files."""
    roles = record_roles(pages, id_col, payload_col).distinct()
    rows = narrow(pages, page_id=id_col, url=url_col, html=payload_col).select(
        "page_id", "url", utf8(F.col("html")).alias("payload"), F.sha2(utf8(F.col("html")), 256).alias("digest"))
    roles = roles.select(F.col("page_id").alias("of"), "payload_digest", "record_type", "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("payload_digest"))
    ready = rows.join(roles, same).select("page_id", "url", "payload", "digest", "record_type", "refers_to")
    ready = ready.sortWithinPartitions("page_id", "digest", "url")
    return kept(ready.mapInArrow(_writer(folder), "archive string, records long, bytes long"), "archives")


FIELDS = {"page_id": "long", "url": "string", "payload": "binary", "payload_bytes": "long", "payload_digest": "string",
          "record_type": "string", "refers_to": "long"}
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def read_archives(spark, folder, columns=tuple(FIELDS)):
    """One row per record; payloads are held against their digests. A revisit has no payload of its own."""
    def read(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for r in map(parsed, frames(data.as_buffer())):
                    rows.append([r[c] for c in columns])
                    if len(rows) == 500:
                        yield out(rows)
                        rows = []
                yield out(rows)

    def out(rows):
        columns_of = list(zip(*rows)) or [[]] * len(columns)
        return pa.record_batch({c: pa.array(v, _ARROW[FIELDS[c]]) for c, v in zip(columns, columns_of)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder).select("content")
    return files.mapInArrow(read, ", ".join(f"{c} {FIELDS[c]}" for c in columns))


def archived_pages(pages, **columns):
    """Write all pages, read the archives back."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    if write_archives(pages, folder, **columns).isEmpty():
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in FIELDS.items())).drop("url", "payload")
    return read_archives(spark, folder, ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


SQL = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_page FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM firsts
"""
