"""WARC archives of records compressed one by one with a dictionary that leads the file."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import growing, materialize, new_folder

# Fixed values of the formats: the dictionary frame of .warc.zst, the revisit profile.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def _clean(value: str) -> str:
    """A header value on one line: control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), *(f"{k}: {v}".encode() for k, v in fields), f"Content-Length: {len(block)}".encode()]
    return CRLF.join(head) + CRLF * 2 + block + CRLF * 2


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def page_record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response with the payload, or a revisit with the response's HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return _record("response", fields, http + html)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Refers-To-Page-ID", str(refers_to))]
    return _record("revisit", fields, http)


def dictionary(records: list[bytes], size: int, sample_bytes: int) -> zstandard.ZstdCompressionDict:
    """Trained on evenly spaced records of at most ``sample_bytes`` in all; their raw text if they are too few to train on."""
    step = max(1, sum(map(len, records)) // max(sample_bytes, 1))
    sample = records[::step]
    try:
        return zstandard.train_dictionary(size, [r[: 1 << 16] for r in sample], k=256, d=8, steps=1, level=3)
    except zstandard.ZstdError:
        raw = b"".join(r[:4096] for r in sample)[-size:] or b"WARC/1.1\r\n"
        return zstandard.ZstdCompressionDict(raw.ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes], dictionary_size: int = 32 << 10, sample_bytes: int = 1 << 20, level: int = 3) -> Iterator[bytes]:
    """The parts of an archive: the dictionary in a skippable frame, then a frame for each record."""
    words = dictionary(records, dictionary_size, sample_bytes)
    raw = words.as_bytes()
    yield struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw
    packer = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=True)
    for record in records:
        yield packer.compress(record)


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record; the whole file is read through, however long."""
    data = stream.read()
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("an archive starts with its dictionary")
    raw = data[8 : 8 + size]
    trained = raw[:4] == struct.pack("<I", 0xEC30A437)
    words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    opener = zstandard.ZstdDecompressor(dict_data=words)
    with opener.stream_reader(io.BytesIO(memoryview(data)[8 + size :]), read_across_frames=True) as lines:
        text = io.BufferedReader(lines, 1 << 16)
        while version := text.readline():
            if not version.startswith(b"WARC/"):
                raise ValueError("a record starts with its version")
            fields: dict[str, str] = {}
            while (line := text.readline()) not in (CRLF, b""):
                name, _, value = line.rstrip(b"\r\n").decode().partition(": ")
                fields[name] = value
            block = text.read(int(fields["Content-Length"]))
            if text.read(4) != CRLF * 2:
                raise ValueError("a record ends with two line ends")
            yield fields, block


def write_archives(
    pages: DataFrame, folder: str | None = None, least_bytes: int = 0, archive_size: int = 16 << 20, date: str = "1970-01-01T00:00:00Z",
    page_id: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """Write every row as a record and return the manifest: path, records, bytes.

    A null html is an empty payload, a null url has no target field, a null page_id no
    id field.  Of equal payloads of at least ``least_bytes`` the smallest page_id is the
    response and other ids revisit it; rows that repeat that id are responses too, and
    if all ids are null all are responses.  Payloads meet their group by a join that
    adaptive execution splits, so a payload that most pages share is written by many
    tasks.  A task closes an archive at ``archive_size`` payload bytes (one longer
    payload has its own), and names files by a fresh id, so a task that runs again
    writes other files; only files in the manifest count.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "archives")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("html")
    ).withColumns({"sha": F.unhex(F.sha1("html")), "n": F.length("html")})
    first = rows.filter(F.col("n") >= least_bytes).groupBy("sha", "n").agg(F.min("page_id").alias("first"))
    firsts = materialize(first.filter("first is not null"), "responses")
    placed = rows.join(growing(firsts), ["sha", "n"], "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = fs.FileSystem.from_uri(folder)
        target.create_dir(base, recursive=True)
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"{base}/{uuid.uuid4().hex}.warc.zst"
            total = 0
            info = _record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            with target.open_output_stream(name, compression=None) as out:
                for part in archive_bytes([info, *held]):
                    out.write(part)
                    total += len(part)
            return pa.RecordBatch.from_pylist([{"path": name, "records": len(held), "bytes": total}])

        for batch in batches:
            for number, link, payload, sha, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "sha", "first")), strict=True):
                body, own, to = payload.as_py(), number.as_py(), refers.as_py()
                digest = base64.b32encode(sha.as_py()).decode()
                held.append(page_record(own, link.as_py(), body, digest, None if to is None or to == own else to, date))
                size += len(body)
                if size >= archive_size:
                    yield close()
                    held.clear()
                    size = 0
        if held:
            yield close()

    manifest = placed.select("page_id", "url", "html", "sha", "first").mapInArrow(work, "path string, records long, bytes long")
    return materialize(manifest.withColumn("folder", F.lit(folder)), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each page record in the archives of ``manifest``.

    page_id, record_type, url, refers_to, payload_bytes, payload_digest (bare base32).
    A response's digest and length are taken from its payload and must equal its header;
    a revisit's come from its header and its HTTP head.
    """
    kinds = "page_id long, record_type string, url string, refers_to long, payload_bytes long, payload_digest string"
    names = [k.split()[0] for k in kinds.split(", ")]

    def one(fields: dict[str, str], block: bytes) -> tuple:
        head, _, payload = block.partition(CRLF * 2)
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        size = next(int(line.split(b":")[1]) for line in head.split(CRLF) if line.lower().startswith(b"content-length:"))
        if fields["WARC-Type"] == "response" and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
            raise ValueError("a payload differs from its digest")
        whole = lambda k: int(fields[k]) if k in fields else None
        return whole("Page-ID"), fields["WARC-Type"], fields.get("WARC-Target-URI"), whole("Refers-To-Page-ID"), size, digest

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source, _ = fs.FileSystem.from_uri(folder)
                with source.open_input_stream(path, compression=None) as stream:
                    rows = [one(f, b) for f, b in read_archive(stream) if f["WARC-Type"] != "warcinfo"]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return manifest.select("path", "folder").repartition(F.col("path")).mapInArrow(work, kinds)
