"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Archives are written and read through Spark's own file sources, so any store that Spark reaches will do.
Spark's text writer ends each value with a separator; an empty skippable frame serves as that separator,
which every reader of the format passes over.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlast.llm.words import column, text_slices

# Fixed values of the two formats.
SKIPPABLE, SKIPPABLE_KINDS = 0x184D2A50, 16
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

EMPTY_FRAME = struct.pack("<II", SKIPPABLE, 0).decode("ascii")  # all its bytes are below 0x80
DATE = "2024-01-01T00:00:00Z"
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 16 << 10
RECORDS = ("path string, page_id bigint, url string, record_type string, payload_bytes bigint, "
           "payload_digest string, refers_to bigint")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    text = (name or "<urn:page:none>")[len("<urn:page:"):-1]
    return None if text == "none" else int(text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that keeps only the HTTP header."""
    digest = digest_of(payload)
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            ).encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page_id)),
              ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a record and its payload; ValueError if its header, lengths or digests are wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"no field: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in fields:
            raise ValueError(f"no {needed}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{fields['warc-record-id']}: {len(rest) - 4} bytes instead of {length}")
    block = rest[:length]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest_of(block)}":
        raise ValueError(f"{fields['warc-record-id']}: wrong block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [v for k, _, v in (h.partition(b":") for h in http.split(b"\r\n")) if k.lower() == b"content-length"]
    size = int(sizes[0]) if sizes else len(payload)
    if fields["warc-type"] == "response":
        if size != len(payload):
            raise ValueError(f"{fields['warc-record-id']}: payload of {len(payload)} bytes instead of {size}")
        if fields.get("warc-payload-digest") != f"sha1:{digest_of(payload)}":
            raise ValueError(f"{fields['warc-record-id']}: wrong payload digest")
    return {"fields": fields, "payload": payload, "payload_bytes": size}


def dictionary_frame(samples: list[bytes]) -> tuple[bytes, object]:
    """The leading frame and the compressor of an archive; without a dictionary if none can be trained."""
    import zstandard

    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few or too small samples
        return b"", zstandard.ZstdCompressor(level=3)
    packed = zstandard.ZstdCompressor(level=9).compress(trained.as_bytes())
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed, zstandard.ZstdCompressor(level=3, dict_data=trained)


def _frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, by its block headers."""
    import zstandard

    some = data[at:at + 32]
    end = at + zstandard.frame_header_size(some)
    while True:
        if end + 3 > len(data):
            raise ValueError("truncated frame")
        header = int.from_bytes(data[end:end + 3], "little")
        last, kind, size = header & 1, header >> 1 & 3, header >> 3
        end += 3 + (1 if kind == 1 else size)
        if last:
            break
    end += 4 if zstandard.get_frame_parameters(some).has_checksum else 0
    if end > len(data):
        raise ValueError("truncated frame")
    return end


def archive_records(content: bytes) -> Iterator[dict]:
    """The records of an archive, one frame at a time; ValueError if a frame is not one whole record."""
    import zstandard

    data, at, first = memoryview(content), 0, True
    reader = zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("truncated frame")
        magic, size = struct.unpack_from("<II", data, at)
        if SKIPPABLE <= magic < SKIPPABLE + SKIPPABLE_KINDS:
            if at + 8 + size > len(data):
                raise ValueError("truncated frame")
            if magic == DICTIONARY_FRAME and first:
                raw = bytes(data[at + 8:at + 8 + size])
                if raw[:4] == struct.pack("<I", ZSTD_FRAME):
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
        elif magic == ZSTD_FRAME:
            end = _frame_end(data, at)
            yield parse_record(reader.decompressobj().decompress(data[at:end]))
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")
        first = False


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """digest, page_id, refers_to of the pages whose payload of ``least`` bytes or more a smaller page_id holds."""
    own = pages.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select(
        "page_id", F.sha2("payload", 256).alias("digest"))
    firsts = (own.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("other"))
              .where("refers_to <> other").drop("other"))
    return own.join(firsts, "digest").where("page_id <> refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Write a record per row of ``pages`` (page_id, url, html), one archive per partition.

    Payload: html in UTF-8, null as empty. Of equal payloads of ``least`` bytes or more the smallest
    page_id is the response and the others revisit it. Rows that repeat a page_id with equal payload are
    all what that page_id is; a null page_id is always a response and never referred to. A null url is
    left out. Other columns are not read. An empty table gives archives without records.
    """
    whole = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    marked = (whole.withColumn("digest", F.sha2("payload", 256))
              .join(revisits(whole, least), ["digest", "page_id"], "left").select("page_id", "url", "payload", "refers_to"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = None
        for batch in text_slices(batches, "payload"):
            rows = zip(*(column(batch, c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")))
            records = [record_bytes(*row) for row in rows]
            frames = []
            if compressor is None:
                samples, size = [], 0
                for r in records:
                    samples.append(r[:32 << 10])
                    size += len(samples[-1])
                    if size > SAMPLE_BYTES:
                        break
                lead, compressor = dictionary_frame(samples)
                frames += [lead] if lead else []
            frames += [compressor.compress(r) for r in records]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    frames = marked.mapInArrow(compress, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(folder)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives of a folder, validated; a broken archive fails the read.

    path, page_id, url, record_type, payload_bytes and payload_digest of the full payload, refers_to;
    ``with_payload`` adds the stored payload (null for revisits).
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
        names += ["payload"] * with_payload
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                path, rows = column(batch, "path")[i].as_py(), []
                size = 0
                for record in archive_records(column(batch, "content")[i].as_buffer()):
                    f = record["fields"]
                    kind = f["warc-type"]
                    row = [path, _page(f["warc-record-id"]), f.get("warc-target-uri"), kind, record["payload_bytes"],
                           f.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                           _page(f.get("warc-refers-to"))]
                    if with_payload:
                        row.append(record["payload"] if kind == "response" else None)
                        size += len(record["payload"])
                    rows.append(row)
                    if len(rows) >= 5000 or size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(decode, RECORDS + ", payload binary" * with_payload)
