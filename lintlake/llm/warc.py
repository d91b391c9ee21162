"""WARC archives with one Zstandard frame a record and a shared dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary.  Each
task writes archives of its own rows and reports their names, so an archive of a lost or
repeated task is never read.  The reader takes the dictionary from the archive, decodes one frame at a
time and checks version, headers, lengths and digests of each record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import small
from .frames import fresh_path, written

MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 1 << 16
SAMPLES, SAMPLE_CHARS = 1000, 8192  # the dictionary is fitted on at most this much
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
_CHUNK = 1 << 15
_DATE = "1970-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def fit_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for payloads like the samples; too few or too even samples serve as they are."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record: headers, an HTTP message, two line ends.  A revisit has no payload, only its length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_name(refers_to)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(name: str) -> int | None:
    if not (name.startswith("<urn:page:") and name.endswith(">")):
        raise ValueError(f"bad record name {name!r}")
    return None if name == _name(None) else int(name[10:-1])


def decode_record(record: bytes) -> dict:
    """The fields of one record; ValueError says what is wrong with it."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1" or not gap:
        raise ValueError(f"no WARC/1.1 record: {version[:40]!r}")
    fields: dict[str, str] = {}
    for line in lines:
        key, colon, value = line.partition(":")
        if not colon or key.lower() in fields:
            raise ValueError(f"bad or repeated header {line[:80]!r}")
        fields[key.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - fields.keys():
        raise ValueError(f"headers missing: {sorted(missing)}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, Content-Length {length}")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    declared = [int(x.partition(b":")[2]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not http.startswith(b"HTTP/1.1 ") or not gap or len(declared) != 1:
        raise ValueError("no HTTP message with one Content-Length")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != declared[0] or digest_of(payload) != digest:
            raise ValueError("payload does not match its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise ValueError(f"not a response or a whole revisit: {kind!r}")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": declared[0],
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(dictionary)) + dictionary


def read_archive(stream) -> Iterator[dict]:
    """Records of one archive, from an open binary stream."""
    head = stream.read(8)
    dictionary = None
    if len(head) == 8 and (parts := struct.unpack("<II", head))[0] == MAGIC:
        raw = stream.read(parts[1])
        if len(raw) != parts[1]:
            raise ValueError("dictionary cut short")
        dictionary, head = zstandard.ZstdCompressionDict(raw), b""
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    rest = head
    while True:
        if not rest and not (rest := stream.read(_CHUNK)):
            return
        frame, record = decoder.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := stream.read(_CHUNK)):
                raise ValueError("frame cut short")
            record.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield decode_record(b"".join(record))


def _writer(folder: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        where.create_dir(root, recursive=True)
        packed = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=packed) if packed else zstandard.ZstdCompressor(level=LEVEL)
        name, out, size, count = "", None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "payload_digest", "record_type", "refers_to")), strict=True):
                page_id, url, html, digest, kind, refers_to = (x.as_py() for x in row)
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = where.open_output_stream(f"{root}/{name}")
                    if dictionary:
                        out.write(dictionary_frame(dictionary))
                data = coder.compress(encode_record(page_id, url, (html or "").encode(), digest, kind, refers_to))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [name], "n_records": [count]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "n_records": [count]})

    return run


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        kind = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
        )
        for batch in batches:
            for name, expected in zip(batch.column("archive").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                found, held, bytes_held = 0, [], 0
                with where.open_input_stream(f"{root}/{name}") as stream:
                    for record in read_archive(stream):
                        found += 1
                        held.append(record)
                        bytes_held += len(record["payload"] or b"")
                        if bytes_held >= 8 << 20 or len(held) >= 2000:
                            yield pa.RecordBatch.from_pylist(held, schema=kind)
                            held, bytes_held = [], 0
                if found != expected:
                    raise ValueError(f"{name}: {found} records, {expected} were written")
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=kind)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [digest_of((x.as_py() or "").encode()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, "payload_digest"])


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_digest, record_type and refers_to.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest
    page_id is the response, and the others revisit it; null html is an empty payload.  Rows
    that share the largest page_id are all responses; a null page_id is the smallest.
    """
    with_digest = pages.select("page_id", "url", "html").mapInArrow(_digests, "page_id long, url string, html string, payload_digest string")
    n_bytes = F.octet_length(F.coalesce("html", F.lit("")))
    slim = written(with_digest.select("page_id", "payload_digest", n_bytes.alias("n")), "digests")
    shared = slim.filter(F.col("n") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("rows"))
    shared = shared.filter("rows > 1 AND holder IS NOT NULL").drop("rows")
    joined = with_digest.join(small(shared, F.lit(64)), "payload_digest", "left")
    revisit = F.coalesce((n_bytes >= min_bytes) & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder")), F.lit(False))
    return joined.select(
        "page_id", "url", "html", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("holder")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes archives of ``pages`` below ``folder``, which all executors reach; (archive, n_records) of each."""
    sample = pages.select(F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_CHARS).alias("x")).limit(SAMPLES).collect()
    dictionary = fit_dictionary([r["x"].encode() for r in sample])
    made = plan_records(pages, min_bytes).mapInArrow(_writer(folder, dictionary), "archive string, n_records long")
    return written(made, "archives")


def read_archives(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record; one archive a task."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    dealt = archives.repartition(max(archives.count(), 1), F.rand(7))
    return dealt.mapInArrow(_reader(folder), schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as archives to the shared folder and reads them back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(pages.sparkSession, write_archives(pages, folder, min_bytes), folder)
