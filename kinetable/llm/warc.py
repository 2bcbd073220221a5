"""WARC archives compressed with Zstandard, one frame for each record, written and read by Spark tasks.

An archive begins with a skippable frame that holds a dictionary, trained on its own first records (``SAMPLE`` bytes
of them at most), unless these are too few for one.  The reader loads that dictionary, decodes a frame at a time and
validates it: the version line, the mandatory headers, the length of the block, the end of the record, the length of
the payload and its digest.  A frame that fails gives a row with ``error``; what follows it is still read if the
frame's end is known.

Equal payloads are stored once: the row with the smallest page_id is a response, the others are revisits that refer
to it; payloads shorter than ``least_bytes`` are always responses.  A null html is an empty payload; a null url has no
target header; rows with a null page_id come after all others and, if all of a payload's are null, are responses.
Repeated rows of a page_id are alike.  Empty tables give no archives and no rows.

A task writes each archive under a name of its own and reports it in its output, which Spark commits once; what lost
attempts leave behind is in no manifest and is never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import fresh_path, salted_join, stored

#: Fixed values of the formats: the frame that carries a dictionary, other skippable frames, a dictionary, a frame.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE, SKIPPABLE_MASK = 0x184D2A50, 0xFFFFFFF0
DICTIONARY_MAGIC, FRAME_MAGIC = 0xEC30A437, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Bytes of records that a dictionary is trained on, bytes of a dictionary, and of records in an archive.
SAMPLE, DICTIONARY, ARCHIVE = 2_000_000, 64_000, 64_000_000
#: Bytes that are read at once, and that are handed to the decoder at once.
CHUNK, PIECE = 1 << 20, 1 << 14
#: Payloads of several pages that are broadcast, at about a hundred bytes each; more are joined by shuffle.
SHARED = 500_000
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: object, url: str | None, payload: bytes, refers_to: object = None) -> bytes:
    """A response, or a revisit if it refers to another page; a revisit keeps the payload's length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url),
        "WARC-Page-ID": page_id,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "WARC-Profile": None if refers_to is None else PROFILE,
        "WARC-Refers-To": None if refers_to is None else record_id(refers_to),
        "WARC-Refers-To-Page-ID": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n"


def trained(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    sample, size = [], 0
    for r in records:
        sample.append(r[:100_000])
        size += len(sample[-1])
        if size > SAMPLE:
            break
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, size // 20)), sample)
    except zstandard.ZstdError:  # too few or too uniform
        return None


def archive(records: list[bytes]) -> bytes:
    """The bytes of an archive: the dictionary's frame, if one can be trained, and a frame for each record."""
    own = trained(records)
    packer = zstandard.ZstdCompressor(level=6, dict_data=own, write_content_size=True, write_checksum=True)
    out = []
    if own is not None:
        packed = zstandard.ZstdCompressor(level=6).compress(own.as_bytes())
        out.append(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
    return b"".join([*out, *(packer.compress(r) for r in records)])


def frames(source) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, record, error) of each frame of a file, which is read a chunk at a time."""
    held, used, at, ended = b"", 0, 0, False  # of what is held so much is used up

    def fill(n: int) -> int:
        """The bytes that are left, n of them unless the file ends before."""
        nonlocal held, used, ended
        while len(held) - used < n and not ended:
            more = source.read(max(CHUNK, n - len(held) + used))
            ended, held, used = not more, held[used:] + more, 0
        return len(held) - used

    def skip(n: int) -> None:
        nonlocal used, at
        used, at = used + n, at + n

    unpacker = zstandard.ZstdDecompressor()
    first = True
    while True:
        left = fill(8)
        if not left:
            return
        if left < 8:
            yield at, None, "truncated frame"
            return
        magic, size = struct.unpack_from("<II", held, used)
        if magic & SKIPPABLE_MASK == SKIPPABLE:
            start = at
            if fill(8 + size) < 8 + size:
                yield start, None, "truncated skippable frame"
                return
            body = held[used + 8 : used + 8 + size]
            skip(8 + size)
            if first and magic == DICTIONARY_FRAME:
                try:
                    if body[:4] == struct.pack("<I", FRAME_MAGIC):
                        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                    if body[:4] != struct.pack("<I", DICTIONARY_MAGIC):
                        raise zstandard.ZstdError("no dictionary in the leading frame")
                    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
                except zstandard.ZstdError as e:
                    yield start, None, f"dictionary: {e}"
                    return
            first = False
            continue
        first, start, out = False, at, []
        if magic != FRAME_MAGIC:
            yield start, None, "not a Zstandard frame"
            return
        one = unpacker.decompressobj()
        try:
            while not one.eof:
                if not fill(1):
                    yield start, None, "truncated frame"
                    return
                piece = held[used : used + PIECE]
                out.append(one.decompress(piece))
                skip(len(piece) - (len(one.unused_data) if one.eof else 0))
        except zstandard.ZstdError as e:  # its end is unknown
            yield start, None, f"frame: {e}"
            return
        yield start, b"".join(out), None


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"malformed header {name[:40]!r}")
        out[name.lower()] = value.strip()
    return out


def parsed(raw: bytes) -> dict:
    """The fields of a record; ValueError if it isn't valid."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC version line or no end of headers")
    own = _headers(lines)
    for name in MANDATORY:
        if name not in own:
            raise ValueError(f"no {name}")
    if not own["content-length"].isdecimal():
        raise ValueError("content-length is not a number")
    length = int(own["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("content-length differs from the block")
    block = rest[:length]
    if own.get("warc-block-digest", "").startswith("sha1:") and own["warc-block-digest"][5:] != digest(block):
        raise ValueError("block digest differs")
    out = {"type": own["warc-type"], "id": own["warc-record-id"], "url": own.get("warc-target-uri"), "page": own.get("warc-page-id"), "refers_to": own.get("warc-refers-to-page-id"), "digest": own.get("warc-payload-digest", "").removeprefix("sha1:"), "payload": None, "bytes": None}
    if out["type"] not in ("response", "revisit"):
        return out
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP headers in the block")
    http = _headers(head.split(b"\r\n")[1:])
    out["bytes"] = int(http.get("content-length", len(payload)))
    if out["type"] == "response":
        if out["bytes"] != len(payload):
            raise ValueError("payload length differs")
        if out["digest"] and out["digest"] != digest(payload):
            raise ValueError("payload digest differs")
        out["payload"] = payload
    elif own.get("warc-profile") != PROFILE or "warc-refers-to" not in own or payload:
        raise ValueError("revisit without profile or reference, or with a payload")
    return out


def write(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Archives of (page_id, url, html); a manifest (archive, records, bytes) of those that were committed."""
    folder = folder or fresh_path(pages.sparkSession, "archives")
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload")).withColumn("sha1", F.sha1("payload"))
    shared = rows.filter(F.length("payload") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1")
    shared = stored(shared, "shared")
    # Payloads stay where they are while the shared ones are few enough to be broadcast.
    few = shared.limit(SHARED + 1).count() <= SHARED
    own = shared.select("sha1", "original")
    rows = rows.join(F.broadcast(own), "sha1", "left") if few else salted_join(rows, own, "sha1", "left", shared.select("sha1", "n"))
    revisit = F.col("original").isNotNull() & (F.length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("original"))
    rows = rows.select("page_id", "url", "payload", F.when(revisit, F.col("original")).alias("refers_to"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def put(records: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = archive(records)
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(records)], pa.int64()), pa.array([len(data)], pa.int64())], names=["archive", "records", "bytes"])

        records, size = [], 0
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                page, url, payload, original = (c[i].as_py() for c in columns)
                records.append(record(page, url, payload, original))
                size += len(records[-1])
                if size >= ARCHIVE:
                    yield put(records)
                    records, size = [], 0
        if records:
            yield put(records)

    return stored(rows.mapInArrow(save, "archive string, records bigint, bytes bigint"), "manifest")


RECORD = "archive string, offset bigint, record_type string, record_id string, url string, page string, refers_to string, payload_digest string, payload_bytes bigint, payload binary, error string"


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives of a manifest, with ``error`` set where a frame or a record is not valid."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), *((n, pa.string()) for n in ("record_type", "record_id", "url", "page", "refers_to", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(name) as source:
                    for offset, raw, error in frames(source):
                        own: dict = {}
                        if raw is not None:
                            try:
                                own = parsed(raw)
                            except ValueError as e:
                                error = str(e)
                        payload = own.get("payload") if payloads else None
                        rows.append((path, offset, own.get("type"), own.get("id"), own.get("url"), own.get("page"), own.get("refers_to"), own.get("digest"), own.get("bytes"), payload, error))
                        size += len(payload or b"") + 200
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    spread = manifest.select("archive").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), F.col("archive"))
    return spread.mapInArrow(load, RECORD)


def summary(records: DataFrame, page_type: str = "bigint") -> DataFrame:
    """One row per page; a record that isn't valid ends the query."""
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("invalid record: "), "error")).cast("string")).otherwise(F.col("record_type"))
    return records.select(F.col("page").cast(page_type).alias("page_id"), "payload_bytes", "payload_digest", sound.alias("record_type"), F.col("refers_to").cast(page_type).alias("refers_to"))
