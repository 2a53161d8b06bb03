"""WARC archives with an index written first.

Each task appends gzipped records to an archive of its own and returns an index row per record: file, offset, length, URL
and digest. Reading sorts the index rows wanted by file and offset, joins neighbours into one byte range each, and takes
the records out of it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import new_path, written

#: A range read joins records at most GAP bytes apart and is RANGE bytes at most, or one record.
GAP, RANGE = 64 << 10, 8 << 20
#: Bytes of archive behind which a task begins another file.
ARCHIVE_BYTES = 1 << 30
_SPACE = re.compile(r"[\s\x00-\x1f\x7f]")
_DATE = "2024-01-01T00:00:00Z"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _header(value: object) -> str:
    """An id as a header's value: numbers as they are, strings with all but plain characters escaped."""
    return str(value) if isinstance(value, int) else quote(str(value))


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, revisit: bool, place: str = "") -> bytes:
    """One gzipped record. A revisit has the HTTP head and no payload; its head tells the payload's length. ``place`` tells equal records apart."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{place} {page_id} {url} {digest} {revisit}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {_SPACE.sub(lambda m: quote(m[0]), url)}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"X-Page-ID: {_header(page_id)}"] if page_id is not None else []),
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [f"X-Refers-To-Page-ID: {_header(refers_to)}"] if refers_to is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 1, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, the payload's length, and the payload (empty for revisits) of one gzipped record."""
    plain = gzip.decompress(raw)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    return headers, length, payload


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes the archives below ``folder`` and returns their index, itself a written table.

    Index: ``file, offset, length, url, digest, page_id, record_type``. Of records with equal payloads of at least
    ``least_bytes`` the one with the smallest id is the response (a null id comes last; of repeated rows one), the others
    revisit it. Null HTML is an empty payload, a null URL has no header, other columns are ignored, an empty table gives an
    empty index. A page is handled whole, in memory.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # by the place in the input: tells equal rows apart
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", F.xxhash64("url").alias("u"), "row")
    group = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(group, "digest", "left").withColumn("same", F.col("first") == order)
    schema = f"file string, offset long, length long, url string, digest string, page_id {kind}, record_type string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = out = None
        at, file = 0, ""
        root = folder.rstrip("/")
        for batch in batches:
            index: list[tuple] = []
            for page_id, url, html, sha1, first, revisit in zip(*(batch.column(n) for n in ("page_id", "url", "html", "digest", "first_id", "revisit")), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    file = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    store, path = _store(file)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out, at = store.open_output_stream(path, compression=None), 0
                page, address, digest, again = page_id.as_py(), url.as_py(), base32(sha1.as_py()), revisit.as_py()
                raw = record(page, address, html.as_py().encode(), digest, first.as_py(), again, f"{file} {at}")
                out.write(raw)
                index.append((file, at, len(raw), address, digest, page, "revisit" if again else "response"))
                at += len(raw)
            if index:
                cols = list(zip(*index, strict=True))
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), batch.schema.field("page_id").type, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["file", "offset", "length", "url", "digest", "page_id", "record_type"])
        if out is not None:
            out.close()

    ready = rows.select("page_id", "url", "html", "digest", F.col("first.page_id").alias("first_id"), (F.col("first").isNotNull() & ~F.col("same")).alias("revisit"))
    index = ready.mapInArrow(run, schema)
    return written(index, "index")


def read(spark: SparkSession, index: DataFrame) -> DataFrame:
    """The records that ``index`` lists, one row each, taken from the archives.

    ``page_id, record_type, refers_to, url, payload_bytes, payload_digest, payload``; the digest of a response is computed
    from what was read and has to be the one in its header. Ids are longs, or strings if the index has no whole numbers;
    blanks in URLs come back escaped. An empty index gives no rows.
    """
    kind = index.schema["page_id"].dataType
    whole = isinstance(kind, IntegralType)
    given = lambda x: None if x is None else int(x) if whole else unquote(x)
    id_type, named = (pa.int64(), "long") if whole else (pa.string(), "string")
    parts = max(1, index.rdd.getNumPartitions())
    wanted = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def ranges(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
        file, start, end, own = "", 0, 0, []
        for f, offset, length in rows:
            if own and (f != file or offset - end > GAP or offset + length - start > RANGE):
                yield file, start, end, own
                own = []
            if not own:
                file, start, end = f, offset, offset
            own.append((offset, length))
            end = max(end, offset + length)
        if own:
            yield file, start, end, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = "", None
        rows = (x for b in batches for x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        for file, start, end, own in ranges(rows):
            if file != opened:
                store, path = _store(file)
                opened, source = file, store.open_input_file(path)
            source.seek(start)
            data = source.read(end - start)
            out: list[tuple] = []
            for offset, length in own:
                headers, size, payload = parse(data[offset - start : offset - start + length])
                digest, again = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"] == "revisit"
                if not again and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{file} at {offset}: the payload is not the one that was written")
                page, to = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                out.append((given(page), headers["WARC-Type"], given(to), headers.get("WARC-Target-URI"), size, digest, None if again else payload))
            cols = list(zip(*out, strict=True))
            types = [id_type, pa.string(), id_type, pa.string(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest", "payload"])

    return wanted.mapInArrow(run, f"page_id {named}, record_type string, refers_to {named}, url string, payload_bytes long, payload_digest string, payload binary")


def archive_folder(spark: SparkSession) -> str:
    return new_path(spark, "warc")
