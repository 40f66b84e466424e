"""WARC archives in Zstandard: a writer, and a reader that takes the dictionary from the leading skippable frame, decodes
one frame per record and checks headers and lengths.

Layout of a ``.warc.zst`` file: a skippable frame (magic 0x184D2A5D) with the dictionary, if there is one, then one
frame per record.  A record's block is an HTTP response; its ``Content-Length`` and ``WARC-Payload-Digest`` are those
of the full payload, also in a revisit, whose block ends after the HTTP headers.

Of the records with equal payloads of at least ``least`` bytes, that with the smallest page is the response and the
others revisit it; smaller payloads are always responses.

The reader also takes archives of others: records of all types, HTTP bodies in chunks or without a length, folded
header lines, digests of other algorithms or none.  Columns that a record does not give are null; the payload of a
request or response is its HTTP body, that of other records their block.

Defined results: a null html is an empty payload; a null url leaves out the target header; line breaks in a url are
percent-encoded; a null page revisits the smallest page that is not null, and is a response if there is none; rows that
repeat the smallest page (ties) are all responses; a payload of any length is one record, held whole by one task; an empty table gives no files and an empty result.  A malformed
archive raises :class:`WarcError` and nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh_path, is_small, join_with_hot_keys, stored, table
from .files import make_folder, reading, task_file, writing

#: Magic numbers of the format (fixed values).
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
#: The dictionary is trained on so many bytes of a file's first payloads.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 1 << 15
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
BATCH = 512


class WarcError(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page, url, payload: bytes, refers_to=None) -> bytes:
    """The bytes of a record; with ``refers_to`` a revisit of that page's record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        lines.append(f"Page-ID: {page}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """Header lines after the first, by lower-case name; a line that begins with a blank continues the one before."""
    out, name = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name is not None:
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"not a header: {line[:80]!r}")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def whole_number(of: dict[str, str], name: str) -> int | None:
    value = of.get(name)
    if value is None:
        return None
    if not re.fullmatch(r"-?[0-9]{1,19}", value) or not -(1 << 63) <= int(value) < 1 << 63:
        raise WarcError(f"{name} is no number: {value[:80]!r}")
    return int(value)


def agrees(claimed: str, data: bytes) -> bool:
    """Whether a digest ``algorithm:value``, in base 32 or 16, is that of the data; unknown algorithms are not checked."""
    algorithm, _, value = claimed.partition(":")
    algorithm = algorithm.lower().replace("-", "")
    if algorithm not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return True
    found = hashlib.new(algorithm, data).digest()
    return value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=") or value.lower() == found.hex()


def body_of_chunks(data: bytes) -> bytes:
    """An HTTP body without its chunk frames."""
    parts, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            raise WarcError("a chunk without its size")
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(parts)
        if data[at + n : at + n + 2] != b"\r\n":
            raise WarcError("a chunk is cut short")
        parts.append(data[at : at + n])
        at += n + 2


def parse(data: bytes) -> dict:
    """A record's columns, after checks of version, headers, lengths and digests."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not re.match(rb"WARC/[01]\.[0-9]+\r\n", head):
        raise WarcError("no WARC header")
    of = fields(head)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in of:
            raise WarcError(f"no {name}")
    kind, length, cut = of["warc-type"].lower(), whole_number(of, "content-length"), "warc-truncated" in of
    block = rest[: max(0, length)]
    if len(block) != length or rest[len(block) :] != b"\r\n\r\n":
        raise WarcError("the block's length differs from Content-Length")
    if not agrees(of.get("warc-block-digest", ""), block):
        raise WarcError("the block's digest differs")
    payload, size, raw = block, len(block), None
    if kind in ("request", "response", "revisit") and of.get("content-type", "application/http").lower().startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap and kind != "revisit":
            raise WarcError("no HTTP header")
        lines = fields(http) if http else {}
        size = whole_number(lines, "content-length")
        if "chunked" in lines.get("transfer-encoding", "").lower() and not cut:
            raw, payload, size = payload, body_of_chunks(payload), None
        if kind != "revisit":
            if size not in (None, len(payload)) and not cut:
                raise WarcError("the payload's length differs")
            size = len(payload)
    claimed = of.get("warc-payload-digest")
    if kind == "revisit":
        if payload or not (claimed or "warc-refers-to" in of):
            raise WarcError("a revisit with a payload or without a target")
    elif claimed and not cut and not agrees(claimed, payload) and not (raw is not None and agrees(claimed, raw)):
        raise WarcError("the payload's digest differs")
    known = claimed.partition(":")[2] if claimed else None if kind == "revisit" else digest(payload)
    return {"page_id": whole_number(of, "page-id"), "url": of.get("warc-target-uri"), "record_type": kind, "payload_bytes": size, "payload_digest": known, "refers_to": whole_number(of, "refers-to-page-id"), "payload": None if kind == "revisit" else payload}


def train(samples: list[bytes]) -> bytes:
    """A dictionary, or nothing where the samples do not allow one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def dump(records: Iterator[bytes], out) -> int:
    """Writes an archive; holds the sample for the dictionary, then one record."""
    held, size, n = [], 0, 0
    for data in records:
        held.append(data)
        size += len(data)
        if size >= SAMPLE_BYTES:
            break
    trained = train(held)
    if trained:
        out.write(struct.pack("<II", SKIPPABLE, len(trained)) + trained)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True)
    for part in (held, records):
        for data in part:
            out.write(packer.compress(data))
            n += 1
    return n


def load(source) -> Iterator[bytes]:
    """The records of an archive, one from each frame, read as a stream."""
    head = source.read(8)
    trained = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        data = source.read(struct.unpack("<I", head[4:])[0])
        if len(data) != struct.unpack("<I", head[4:])[0]:
            raise WarcError("the dictionary is cut short")
        if data[:4] == FRAME:  # a compressed dictionary
            try:
                data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
            except zstandard.ZstdError as e:
                raise WarcError(str(e)) from e
        trained, head = zstandard.ZstdCompressionDict(data), b""
    try:
        unpacker = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    except zstandard.ZstdError as e:
        raise WarcError(str(e)) from e
    rest = head
    while True:
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            rest = rest or source.read(1 << 18)
            if not rest:
                if parts:
                    raise WarcError("the last frame is cut short")
                return
            try:
                parts.append(frame.decompress(rest))
            except zstandard.ZstdError as e:
                raise WarcError(str(e)) from e
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def with_first(df: DataFrame, page: str, html: str, least: int) -> DataFrame:
    """``df`` with ``first``: the smallest page with an equal payload, where that payload occurs more than once."""
    payload = F.coalesce(F.col(html), F.lit(""))
    keyed = df.select(F.col(page).alias("page"), payload.alias("html"), "url", F.sha1(payload.cast("binary")).alias("sha"))
    sizes = df.select(F.col(page).alias("page"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("n"))
    shared = sizes.where(F.col("n") >= least).groupBy("sha").agg(F.min("page").alias("first"), F.count("*").alias("size")).where("size > 1")
    shared = stored(shared, "warc-shared")
    if is_small(shared):
        return keyed.join(F.broadcast(shared.select("sha", "first")), "sha", "left")
    return join_with_hot_keys(keyed, shared.select("sha", "first"), "sha", shared.select("sha", "size"), "left")


def write_warc(df: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Writes a record per row; returns the files: path, n_records."""
    bound_batches(df.sparkSession)
    make_folder(folder)
    rows = with_first(df.select(page, F.col(url).cast("string").alias("url"), html), page, html, least)

    def write(batches):
        def records():
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH):
                    for x in batch.slice(at, BATCH).to_pylist():
                        revisits = x["first"] is not None and x["page"] != x["first"]
                        yield record(x["page"], x["url"], x["html"].encode(), x["first"] if revisits else None)

        it = records()
        one = next(it, None)
        if one is None:
            return
        path = task_file(folder, ".warc.zst")
        with writing(path) as out:
            n = dump((x for part in ([one], it) for x in part), out)
        yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n}])

    return stored(rows.mapInArrow(write, "path string, n_records long"), "warc-files")


def read_warc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives named in ``files.path``."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches):
        for batch in batches:
            for path in batch["path"].to_pylist():
                with reading(path) as source:
                    held, size = [], 0
                    for data in load(source):
                        held.append(parse(data) | ({} if with_payload else {"payload": None}))
                        size += len(held[-1]["payload"] or b"")
                        if len(held) >= BATCH or size > 1 << 24:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    yield pa.RecordBatch.from_pylist(held, schema)

    columns = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return files.select("path").repartition(max(1, files.count())).mapInArrow(read, columns)


def op7_warc(spark, sf_dir) -> DataFrame:
    files = write_warc(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_warc(files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT hex, min(page_id) AS first FROM hashed GROUP BY hex),
digits AS (
  SELECT h.page_id, strlen(h.body) AS payload_bytes, h.hex, f.first,
         list_transform(range(0, 8), lambda i: CAST('0x' || substr(h.hex, CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER)) AS parts
  FROM hashed h JOIN firsts f ON h.hex = f.hex)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(parts, lambda v:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // 32768) % 32 + 1 AS INTEGER), 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // 1024) % 32 + 1 AS INTEGER), 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // 32) % 32 + 1 AS INTEGER), 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v % 32 + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM digits
"""
