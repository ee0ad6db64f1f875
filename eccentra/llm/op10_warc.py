"""WARC archives in Zstandard: one frame per record, dictionary in a leading skippable frame.

Writing: each task trains a dictionary on its first records, starts an archive
with the skippable frame that holds it, and compresses every record as a frame
of its own. A task names its files after itself and its attempt and returns one
manifest row per archive; only archives in the written manifest count, so the
files of lost or repeated tasks are ignored. Reading: an archive is read
frame by frame as a stream, so memory holds one record; version line, header
fields, lengths, digests and frame ends are validated, and a fault raises
``ValueError`` with archive and position.

Pages with equal payloads: the one with the largest page_id becomes the
response, the others revisit it (if the payload has ``least`` bytes at least).
Copies are counted per digest before they meet, and the join back leaves a hot
digest to adaptive splitting. Null html is an empty payload. Rows with null
page_id never are the response of others; alone they are responses. Rows with
equal page_id and payload are each a response if that id is the largest.
A null url leaves its header out; line ends in urls are percent-encoded. An
empty table gives no archives and no records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from eccentra.llm.common import by_value, fresh, table

by_value(__name__)

#: Fixed values of the formats: skippable frame with dictionary, Zstandard frame and dictionary.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"
DATE = "2020-01-01T00:00:00Z"


def filesystem(uri: str):
    """(file system, path) of a URI of the shared folder, seen from a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# ---- records

def http_head(n: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n


def record(page_id, url, payload: bytes, refers_to, digest: str) -> bytes:
    """The bytes of a response record, or of a revisit if ``refers_to`` is given."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c < " " else c for c in url)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    block = http_head(len(payload))
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    head += [("WARC-Block-Digest", "sha1:" + b32(hashlib.sha1(block).digest())), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, where: str) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one whole record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"{where}: no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"{where}: bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{where}: {name} is missing")
    if not fields["content-length"].isdigit():
        raise ValueError(f"{where}: bad content-length")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"{where}: record has {len(rest) - 4} bytes of content, content-length is {n}")
    block = rest[:n]
    if (want := fields.get("warc-block-digest")) and want != "sha1:" + b32(hashlib.sha1(block).digest()):
        raise ValueError(f"{where}: block digest differs")
    return fields, block


def payload_of(fields: dict[str, str], block: bytes, where: str) -> bytes:
    """The HTTP payload of a response record, checked against its digest."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        raise ValueError(f"{where}: no HTTP header")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length" and fields["warc-type"] == "response" and int(value) != len(payload):
            raise ValueError(f"{where}: HTTP content-length differs")
    if fields["warc-type"] == "response" and (want := fields.get("warc-payload-digest")) and want != "sha1:" + b32(hashlib.sha1(payload).digest()):
        raise ValueError(f"{where}: payload digest differs")
    return payload


# ---- archives

def train(samples: list[bytes], size: int = 16384) -> bytes:
    """A dictionary of ``size`` bytes at most; empty if the samples are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def compressor(dictionary: bytes, level: int = 3):
    import zstandard

    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True, write_checksum=True)


def skippable(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""


def read_archive(stream, where: str, step: int = 1 << 20):
    """(offset, record bytes) for every frame of an open archive."""
    import zstandard

    buffer, at = b"", 0

    def more(n: int) -> bool:
        nonlocal buffer
        while len(buffer) < n:
            part = stream.read(max(step, n - len(buffer)))
            if not part:
                return False
            buffer += part
        return True

    own = None
    if not more(4):
        if buffer:
            raise ValueError(f"{where}: cut short")
        return
    if struct.unpack("<I", buffer[:4])[0] == SKIPPABLE:
        if not more(8) or not more(8 + struct.unpack("<I", buffer[4:8])[0]):
            raise ValueError(f"{where}: dictionary frame cut short")
        size = struct.unpack("<I", buffer[4:8])[0]
        data = buffer[8: 8 + size]
        if data[:4] == struct.pack("<I", FRAME):  # the dictionary itself may be a frame
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        if data[:4] != struct.pack("<I", DICTIONARY):
            raise ValueError(f"{where}: no dictionary in the leading frame")
        own = zstandard.ZstdCompressionDict(data)
        buffer, at = buffer[8 + size:], 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=own) if own else zstandard.ZstdDecompressor()
    while more(1):
        begin, frame, out, used = at, reader.decompressobj(), [], 0
        while not frame.eof:
            if used == len(buffer):
                buffer, used = b"", 0
                if not more(1):
                    raise ValueError(f"{where}+{begin}: frame cut short")
            try:
                out.append(frame.decompress(buffer[used:] if used else buffer))
            except zstandard.ZstdError as e:
                raise ValueError(f"{where}+{begin}: {e}") from None
            at += len(buffer) - used - len(frame.unused_data)
            used = len(buffer) - len(frame.unused_data)
        buffer = buffer[used:]
        yield begin, b"".join(out)


def write_archives(pages: DataFrame, path: str, archive_bytes: int = 64 << 20, sample_bytes: int = 1 << 20) -> DataFrame:
    """Write pages (page_id, url, payload, digest, refers_to) as archives under ``path``; the manifest (archive, records, bytes)."""
    def run(batches):
        fs, base = filesystem(path)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        name, part = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}", 0
        out, press, written, count, waiting, held = None, None, 0, 0, [], 0

        def flush():
            nonlocal out, press, written, part, waiting, held
            if out is None and waiting:
                dictionary = train(waiting)
                press = compressor(dictionary)
                out = fs.open_output_stream(f"{name}-{part}.warc.zst", buffer_size=1 << 20)
                head = skippable(dictionary)
                out.write(head)
                written = len(head)
            for r in waiting:
                frame = press.compress(r)
                out.write(frame)
                written += len(frame)
            waiting, held = [], 0

        def close():
            nonlocal out, part, count
            flush()
            if out is not None:
                out.close()
                row = (f"{path}/{name.rsplit('/', 1)[1]}-{part}.warc.zst", count, written)
                out, part, count = None, part + 1, 0
                return [row]
            return []

        rows = []
        for batch in batches:
            for i in range(batch.num_rows):
                key, url, body, digest, refers = (batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "digest", "refers_to"))
                r = record(key, url, (body or "").encode(), refers, b32(digest))
                waiting.append(r)
                held, count = held + len(r), count + 1
                if out is not None or held >= sample_bytes:
                    flush()
                if written >= archive_bytes and out is not None:
                    rows += close()
                    written = 0
        rows += close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["archive", "records", "bytes"])

    manifest = f"{path}-manifest"
    pages.mapInArrow(run, "archive string, records long, bytes long").write.parquet(manifest)
    return pages.sparkSession.read.schema("archive string, records long, bytes long").parquet(manifest)


RECORDS = "archive string, position long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload binary, payload_bytes long"


def read_records(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives named in column ``archive``; ``records`` there, if any, must agree."""
    counted = "records" in archives.columns

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                where, rows = batch.column("archive")[i].as_py(), []
                fs, at = filesystem(where)
                n = 0
                with fs.open_input_stream(at) as stream:
                    for position, data in read_archive(stream, where):
                        fields, block = parse(data, f"{where}+{position}")
                        payload = payload_of(fields, block, f"{where}+{position}")
                        kind = fields["warc-type"]
                        rows.append((where, position, kind, fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-refers-to"),
                                     fields.get("warc-payload-digest", "").removeprefix("sha1:"), payload if with_payload and kind == "response" else None, len(payload) if kind == "response" else None))
                        n += 1
                        if len(rows) == 256:
                            yield to_batch(rows)
                            rows = []
                if counted and n != batch.column("records")[i].as_py():
                    raise ValueError(f"{where}: {n} records, the manifest has {batch.column('records')[i].as_py()}")
                if rows:
                    yield to_batch(rows)

    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()]

    def to_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    spread = archives.select("archive", *["records"] * counted).repartition(archives.sparkSession.sparkContext.defaultParallelism * 2, "archive")
    return spread.mapInArrow(run, RECORDS)


def assign(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses."""
    body = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", "url", body.alias("payload"), F.unhex(F.sha1(body.cast("binary"))).alias("digest"))
    best = own.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("last"))
    same = F.col("last").isNull() | F.col("page_id").eqNullSafe(F.col("last"))
    return own.join(best, "digest", "left").select("page_id", "url", "payload", "digest", F.when(~same, F.col("last")).alias("refers_to"))


def query(spark, sf_dir: str) -> DataFrame:
    """Write all pages, read the archives back, resolve revisits by the responses read."""
    manifest = write_archives(assign(table(spark, sf_dir, "pages")), fresh(spark, "warc"))
    records = read_records(manifest, with_payload=False)
    number = F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1)
    rows = records.select(F.when(number != "", number.cast("long")).alias("page_id"), "payload_digest", "record_type", "payload_bytes",
                          F.regexp_extract("refers_to", r"^<urn:page:(-?\d+)>$", 1).cast("long").alias("refers_to"))
    sizes = rows.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("n"))
    return rows.join(sizes, "payload_digest").select("page_id", F.coalesce("payload_bytes", "n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex FROM p),
m AS (SELECT hex, max(page_id) AS last FROM d GROUP BY 1),
g AS (SELECT hex, last, list_transform(range(8), lambda i: ('0x' || substr(hex, i * 5 + 1, 5))::BIGINT) AS parts FROM m),
t AS (SELECT hex, last, array_to_string(list_transform(parts, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31)::INTEGER + 1, 1)), '')), '') AS digest FROM g)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM d JOIN t USING (hex)
"""
