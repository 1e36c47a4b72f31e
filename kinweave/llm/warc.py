"""WARC archives of Zstandard frames: writer and reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, trained on the archive's first
payloads (the first 64 KiB of ``sample`` of them at most; payloads themselves are whole); then comes one frame a record. The reader loads the dictionary, walks from frame
to frame by their block headers, decodes each, and validates version, mandatory headers, lengths and payload digest;
a fault raises ``ValueError`` with the archive and the offset. Archives are rows of a table (name, content) in a shared
folder, a few MB each, written and read by Spark; ``content`` is byte for byte a ``.warc.zst`` file.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest page_id is a response, and the
others revisit it without the payload. Payloads are equal if their SHA-256 and lengths are, which two known texts of one SHA-1 would not
be; the SHA-1 is the record's digest as the format asks.

Edge cases: null html: empty payload. Null url: ``urn:none``. Null page_id: sorts below every number. Rows that repeat
the page_id of a response are responses too. Empty table: no archives, no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import batch
from kinweave.operators.components import ensure_checkpoint_dir, rekeyed

ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 16 << 10
SAMPLE = 128
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x5d\x2a\x4d\x18"
FRAME = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:page:(null|-?\d+)>")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, response: bool, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if not response:
        head += [f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(payloads: list[bytes], size: int = DICTIONARY_BYTES):
    """A dictionary, or None where there is too little to learn from."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, payloads, level=LEVEL) if sum(map(len, payloads)) >= 8 * 1024 and len(payloads) >= 8 else None
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes], dictionary) -> bytes:
    import zstandard

    out = []
    if dictionary is not None:
        data = dictionary.as_bytes()
        out.append(MAGIC + len(data).to_bytes(4, "little") + data)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
    return b"".join(out + [press.compress(r) for r in records])


def _write(archive_bytes: int, sample: int):
    schema = pa.schema([("name", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        learn: list[bytes] = []
        size = 0

        def close():
            content = archive(records, train(learn))
            return batch(schema, name=[f"{hashlib.md5(content).hexdigest()}.warc.zst"], content=[content])

        for b in batches:
            for i in range(b.num_rows):
                page_id, url, html, response, refers = (b.column(k)[i].as_py() for k in range(5))
                payload = (html or "").encode()
                if len(learn) < sample:
                    learn.append(payload[: 64 << 10])
                records.append(record(page_id, url, payload, response, refers))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield close()
                    records, learn, size = [], [], 0
        if records:
            yield close()

    return run


def planned(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """page_id, url, html, response, refers_to of every record."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha2(F.encode("html", "UTF-8"), 256), "bytes": F.octet_length("html")})
    same = rows.where(F.col("bytes") >= min_bytes).groupBy("sha", "bytes").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = rows.join(rekeyed(same, "sha", "bytes"), ["sha", "bytes"], "left")
    response = F.col("n").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", response.alias("response"), F.when(~response, F.col("first")).alias("refers_to"))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, sample: int = SAMPLE,
) -> None:
    size = pages.agg(F.sum(F.octet_length(F.col(html_col).cast("string")))).first()[0] or 0
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, size // (2 * archive_bytes))  # else as many archives as shuffle partitions
    records = planned(pages, id_col, url_col, html_col, min_bytes).coalesce(tasks)
    archives = records.mapInArrow(_write(archive_bytes, sample), "name string, content binary")
    archives.write.option("compression", "uncompressed").mode("errorifexists").parquet(path)


def frame_end(data: bytes, at: int) -> int:
    """Where the frame at ``at`` ends, from its header and block headers (RFC 8878)."""
    if at + 5 > len(data):
        raise ValueError("truncated frame")
    flags = data[at + 4]
    single = flags >> 5 & 1
    pos = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        head = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if pos > len(data):
            raise ValueError("truncated frame")
        if head & 1:
            return pos + 4 * (flags >> 2 & 1)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; validates what every record must have."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, *fields = head.decode().split("\r\n")
    if not gap or first not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    headers = {}
    for f in fields:
        name, colon, value = f.partition(":")
        if not colon:
            raise ValueError(f"bad header line {f!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("wrong content length")
    return headers, rest[:length]


def records_of(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of one archive."""
    import zstandard

    at, dictionary = 0, None
    if content[:4] == MAGIC:
        size = int.from_bytes(content[4:8], "little")
        data = content[8 : 8 + size]
        if len(data) != size:
            raise ValueError("truncated dictionary")
        if data[:4] == FRAME:
            data = zstandard.ZstdDecompressor().decompress(data)
        dictionary, at = zstandard.ZstdCompressionDict(data), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(content):
        if content[at : at + 4] != FRAME:
            raise ValueError(f"no frame at {at}")
        end = frame_end(content, at)
        try:
            yield at, *parse(reader.decompress(content[at:end]))
        except (zstandard.ZstdError, ValueError) as e:
            raise ValueError(f"record at {at}: {e}") from e
        at = end


def page_of(value: str) -> int | None:
    m = _ID.fullmatch(value)
    if not m:
        raise ValueError(f"unknown record id {value}")
    return None if m[1] == "null" else int(m[1])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])
    for b in batches:
        for name, cell in zip(b.column(0).to_pylist(), b.column(1)):
            content = cell.as_py()
            rows = []
            try:
                for at, headers, block in records_of(content):
                    http, gap, payload = block.partition(b"\r\n\r\n")
                    length = re.search(rb"(?mi)^Content-Length: (\d+)\r?$", http + b"\r")
                    if not gap or not length:
                        raise ValueError(f"record at {at}: no http header")
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != int(length[1]) or payload_digest(payload) != digest):
                        raise ValueError(f"record at {at}: payload does not match its headers")
                    refers = page_of(headers["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), int(length[1]), digest, kind, refers, payload.decode() if kind == "response" else None))
            except ValueError as e:
                raise ValueError(f"{name}: {e}") from e
            yield batch(schema, **{f.name: [r[i] for r in rows] for i, f in enumerate(schema)})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, html (null for revisits)."""
    return spark.read.schema("name string, content binary").parquet(path).mapInArrow(
        _read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    )


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame) -> DataFrame:
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
x AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS top, count(*) OVER (PARTITION BY t) AS copies FROM p),
y AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(h, i, 1))::INT - 1) + 1, 4)), '') AS bits FROM x),
z AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda j: substr(bits, (5 * i + j)::INT, 1)::INT * (32 >> j::INT)))::INT, 1)), '') AS digest FROM y)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN copies = 1 OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN copies = 1 OR page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to FROM z
"""
