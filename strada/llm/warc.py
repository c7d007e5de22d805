"""A deterministic sharded WARC writer and the reader of its archives.

Records are dealt by ranges of page_id and sorted; each task writes its records one after the other, each as its own gzip
member, and rolls to a new file once the current one has ROLL compressed bytes. Headers are made anew from the record: ids
are derived from page_id, dates are the given one, digests and lengths are computed from the bytes written. Files appear
under their own names only when complete (written under a temporary name and renamed), and a manifest lists them; a task
that runs twice writes the same bytes. Of records with equal payloads of at least `least` bytes, the one with the largest
page_id is a response and the others revisit it; which one that is comes from digests that are counted before they are
shuffled, so a payload with many copies is a row per task.

Cases. A null html is the empty payload; a null url is the empty target. Rows with a null page_id are left out. Rows that
repeat a page_id are written each, in order of url and payload; the first of them with the largest page_id's payload is the
response where they are equal. An empty table gives no files and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strada.llm import files
from strada.llm.common import materialize, n_partitions, ship, table, work_dir

ROLL, DATE = 64 << 20, "2025-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space for URLs


def sha1_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int, digest: str, k: int = 0) -> str:
    """Of a page's k-th row with a payload; each record of an archive has its own, and a response's can be told from its page_id and digest."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{digest}:{k}')}>"


def _line(text: str) -> str:
    """A header's value: control characters would end the line."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in text)


def make_record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None, date: str, k: int = 0) -> bytes:
    """A gzip member with one record."""
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = status if refers_to is not None else status + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, k)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_of(block)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", f"WARC-Page-ID: {page_id}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def records(f, chunk: int = 1 << 20):
    """(headers, block) of each record of a WARC file, one gzip member at a time."""
    data, member, parts = b"", zlib.decompressobj(31), []
    while data or (data := f.read(chunk)):
        parts.append(member.decompress(data))
        data = member.unused_data
        if member.eof:
            raw = b"".join(parts)
            head, _, rest = raw.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            yield headers, rest[: int(headers["Content-Length"])]
            member, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the file ends within a record")


def plan(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """(page_id, mark, url, html, digest, refers_to): mark 1 for each page; mark 0, without html, says to what a page with that digest refers.

    The two kinds are one table, so that pages are shuffled once, by the range of page_id, and meet their marks there.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html")).where("page_id IS NOT NULL")
    digest = F.unhex(F.sha1("html"))
    ids = materialize(own.select("page_id", digest.alias("digest"), F.octet_length("html").alias("n")).where(F.col("n") >= least), f"{path}/digests")
    winners = ids.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "winner")
    revisits = ids.join(winners, "digest").where("page_id <> winner").select("page_id", F.lit(0).alias("mark"), F.lit("").alias("url"), F.lit(None).cast("binary").alias("html"), "digest", F.col("winner").alias("refers_to"))
    return own.select("page_id", F.lit(1).alias("mark"), "url", "html", digest.alias("digest"), F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)


def marked(rows, least: int = 0):
    """(page_id, url, html, digest, refers_to, k) of the sorted rows of plan(); k counts the rows of a page_id with one payload.

    Of rows that repeat a page_id and its payload the first in the order of url is the page's; the others refer to what it
    refers to, or to itself.
    """
    at, refers, seen = None, {}, {}
    for page_id, mark, url, html, digest, refers_to in rows:
        if page_id != at:
            at, refers, seen = page_id, {}, {}
        if mark:
            k = seen[digest] = seen.get(digest, -1) + 1
            yield page_id, url, html, digest, refers.get(digest, page_id if k and len(html) >= least else None), k
        else:
            refers[digest] = refers_to


def write(pages: DataFrame, path: str, folder: str, least: int = 0, roll: int = ROLL, date: str = DATE) -> list[dict]:
    """Writes the archives and the manifest below folder; the manifest's files: name, records, bytes."""
    ship(pages.sparkSession)

    def run(batches):
        part, shard = TaskContext.get().partitionId(), 0
        rows = marked((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), least)
        held = next(rows, None)
        while held is not None:
            name, n, size = f"part-{part:06d}-{shard:04d}.warc.gz", 0, 0
            with files.committed(f"{folder}/{name}") as f:
                while held is not None and size < roll:
                    page_id, url, html, digest, refers_to, k = held
                    data = make_record(page_id, url, html, base64.b32encode(digest).decode(), refers_to, date, k)
                    f.write(data)
                    n, size = n + 1, size + len(data)
                    held = next(rows, None)
            yield pa.RecordBatch.from_pydict({"name": [name], "records": [n], "bytes": [size]})
            shard += 1

    dealt = plan(pages, path, least).repartitionByRange(n_partitions(pages.sparkSession), "page_id").sortWithinPartitions("page_id", "mark", "url", "digest")
    made = [r.asDict() for r in dealt.mapInArrow(run, "name string, records long, bytes long").collect()]  # one row a file
    made.sort(key=lambda r: r["name"])
    with files.committed(f"{folder}/manifest.json") as f:
        f.write(json.dumps({"files": made}).encode())
    return made


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) from the archives that the manifest lists.

    A response's digest is computed from the payload read and must be the one in its header; a revisit's is its header's,
    and its payload's length the one that its HTTP header states.
    """
    ship(spark)
    with files.opened(f"{folder}/manifest.json") as f:
        listed = [r["name"] for r in json.load(f)["files"]]

    def run(batches):
        names = [n for b in batches for n in b.column(0).to_pylist()]
        for name in names:
            rows: list = []
            with files.opened(f"{folder}/{name}") as f:
                for h, block in records(f):
                    if h["WARC-Block-Digest"] != f"sha1:{sha1_of(block)}":
                        raise ValueError(f"{name}: a block doesn't have its digest")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    n = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                    if h["WARC-Type"] == "response" and (sha1_of(payload), len(payload)) != (digest, n):
                        raise ValueError(f"{name}: a payload doesn't have its digest or length")
                    to = h.get("WARC-Refers-To-Page-ID")
                    rows.append((int(h["WARC-Page-ID"]), h["WARC-Target-URI"], n, digest, h["WARC-Type"], int(to) if to else None))
                    if len(rows) == 5000:
                        yield _batch(rows)
                        rows = []
            yield _batch(rows)

    return spark.createDataFrame([(n,) for n in listed], "name string").repartition(max(1, len(listed))).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    write(table(spark, sf_dir, "pages"), path, f"{path}/warc")
    return read(spark, f"{path}/warc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: A row per page as the archives should give it; base32 from four times ten hexadecimal digits.
SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url FROM pages WHERE page_id IS NOT NULL
), d AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY sha1(html)) AS winner,
         row_number() OVER (PARTITION BY page_id, sha1(html) ORDER BY url) AS k
  FROM p
), n AS (
  SELECT *, [CAST('0x' || substr(h, 10 * i + 1, 10) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS parts FROM d
)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((parts[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = winner AND k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = winner AND k = 1 THEN NULL ELSE winner END AS refers_to
FROM n
"""
