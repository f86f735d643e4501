"""WARC archives: a writer with revisit records, and a sequential reader.

Every record is one gzip member. The writer names, of rows with equal payloads of at least ``revisit_from`` bytes, the
one with the smallest page_id the response; the others become revisit records that refer to it and hold its HTTP
headers alone. Only digests and ids are shuffled to find them; pages themselves are shuffled by digest only where more
digests repeat than may be broadcast. A record's id follows from its page_id and payload, so a revisit can name the
response; rows without a page_id, or that repeat one with its payload, take an id of their archive and place, and nothing
refers to them by it. Tasks write archives of bounded size to the shared folder
under fresh names, and only the names that finished tasks report are read, so a lost or repeated task leaves no trace.
The reader goes through an archive from the start with incremental decompression, frames each record by its
content length and verifies block and payload digests; it holds one record at a time.

Defined results: a null html is an empty payload; a null url leaves the target out; control characters in a url are
percent-encoded; rows that repeat a page_id are records of their own, and none of them is a revisit of itself;
a row without a page_id is a response.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modgraph.llm.common import Batches, Mapper, discard, join_checked, materialize, shared_dir, text_bytes

ARCHIVE_BYTES, CHUNK = 64 << 20, 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_TYPE = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"
)


def record_id(page_id: int, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id} {digest}').urn}>"


def make_record(page_id: int, url: str | None, payload: bytes, refers_to: int | None, date: str, own: str | None = None, named: bool = True) -> bytes:
    """One record, uncompressed; own: its id where that is not of its page; named: whether the response has such an id."""
    digest = hashlib.sha256(payload).hexdigest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own or record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", *([f"WARC-Refers-To: {record_id(refers_to, digest)}"] if named else []), f"X-Refers-To-Page: {refers_to}"]
    head += [
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([] if page_id is None else [f"X-Page: {page_id}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The contents of each gzip member of a stream, decompressed piece by piece."""
    rest = b""
    while rest := rest or stream.read(CHUNK):
        member, out = zlib.decompressobj(31), bytearray()
        while True:
            out += member.decompress(rest)
            rest = member.unused_data
            if member.eof:
                break
            rest = stream.read(CHUNK)
            if not rest:
                raise ValueError("an archive ends within a record")
        yield bytes(out)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (lower-case names), HTTP head and payload of a record; ValueError if it is damaged."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    block = rest[:length]
    if headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("a block does not match its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    if headers["warc-type"] == "response" and headers["warc-payload-digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
        raise ValueError("a payload does not match its digest")
    return headers, http, payload


def write_archives(folder: str, date: str) -> Mapper:
    """Over rows (page_id, url, html, refers_to, named, again): archives in the folder; rows (path, records, bytes)."""

    def write(batches: Batches) -> Batches:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        name, out, records, size = "", None, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            files.move(f"{root}/.{name}", f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [records], "bytes": [size]})

        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "named", "again")]
            for html, page, url, refers, named, again in zip(text_bytes(batch.column("html")), *plain):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{root}/.{name}", compression=None)
                own = f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'{name} {records}').urn}>" if page is None or again else None
                member = gzip_member(make_record(page, url, html or b"", refers, date, own, named))
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return write


def read_archives(batches: Batches) -> Batches:
    """Over rows (path, ...): the records of the archives as RECORD_TYPE."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            files, at = pafs.FileSystem.from_uri(path)
            rows: list[tuple] = []
            with files.open_input_stream(at, compression=None) as stream:
                for data in members(stream):
                    headers, http, _ = parse_record(data)
                    size = int(re.search(rb"(?i)^content-length: *(\d+)", http, re.M)[1])
                    refers = headers.get("x-refers-to-page")
                    page = headers.get("x-page")
                    rows.append((None if page is None else int(page), size, headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"], None if refers is None else int(refers), headers.get("warc-target-uri")))
                    if len(rows) == 5000:
                        yield _records(rows)
                        rows = []
            if rows:
                yield _records(rows)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))


def write_pages(pages: DataFrame, folder: str | None = None, revisit_from: int = 100, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write pages (page_id, url, html); the table of archives (path, records, bytes)."""
    folder = folder or shared_dir(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    counted = materialize(rows.groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.max(F.octet_length("html")).alias("size")))
    alike = counted.where((F.col("size") >= revisit_from) & F.col("page_id").isNotNull()).groupBy("digest")
    alike = alike.agg(F.min(F.struct("page_id", "n")).alias("first"), F.sum("n").alias("all"))
    firsts = materialize(alike.where("all > 1").select("digest", F.col("first.page_id").alias("first"), (F.col("first.n") == 1).alias("named")))
    repeated = materialize(counted.where("n > 1 and page_id is not null").select("digest", "page_id", F.lit(True).alias("again")))
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    named = join_checked(join_checked(rows, firsts, "digest", "left"), repeated, ["digest", "page_id"], "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("named", "again")]
    named = named.select("page_id", "url", "html", refers.alias("refers_to"), *flags)
    discard(counted)
    return materialize(named.mapInArrow(write_archives(folder, date), "path string, records bigint, bytes bigint"))


def read_pages(archives: DataFrame) -> DataFrame:
    """The records (RECORD_TYPE) of a written table of archives; the number of tasks follows that of the archives."""
    most = 8 * archives.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(archives.count(), most))
    return archives.select("path").repartition(tasks, "path").mapInArrow(read_archives, RECORD_TYPE)


def duckdb_sql(revisit_from: int = 100) -> str:
    """What a round trip of pages gives, as DuckDB SQL."""
    return f"""
with rows as (select page_id, coalesce(html, '') as body, min(page_id) over (partition by coalesce(html, '')) as first from pages),
told as (select *, strlen(body) as size, strlen(body) >= {revisit_from} and first <> page_id as again from rows)
select page_id, size as payload_bytes, sha256(body) as payload_digest, case when again then 'revisit' else 'response' end as record_type,
  case when again then first end as refers_to from told"""
