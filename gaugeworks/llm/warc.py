"""WARC archives: a writer in Spark SQL, and a reader that verifies record boundaries as chains."""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"WARC/1.0\r\n"
#: Bytes of records to a file, about, and bytes that a record's heads take.
FILE_BYTES, HEAD_BYTES = 64 << 20, 600
HEAD_END = b"\r\n\r\n"


def base32_sha1(body: Column) -> Column:
    """Upper-case base32 of the SHA-1 of ``body``: five hex digits are four base32 digits."""
    digest = F.sha1(body)
    digits = F.concat(*[F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def deduplicated(pages: DataFrame, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """page_id, url, html (null: '') with digest, n_bytes, record_type and refers_to, dealt to partitions of about ``file_bytes``.

    Of equal payloads of at least ``least_bytes`` the largest page_id is the response and the others revisit it.
    Digests are counted by partial aggregation and joined to ids alone, a join that Spark may split when a digest is hot;
    pages travel once, by id, so that no task gets all copies of a payload.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("n_bytes", F.octet_length("html").cast("long"))
    total = pages.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long") + HEAD_BYTES)).first()[0] or 0
    able = rows.where((F.col("n_bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    # only payloads that occur more than once travel back
    chosen = able.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("least")).where("least < keeper")
    revisits = able.join(chosen.select("digest", "keeper"), "digest").where("page_id < keeper").distinct()
    joined = rows.repartition(max(1, -(-total // file_bytes)), "page_id", "digest").join(revisits, ["page_id", "digest"], "left")
    return joined.select("page_id", "url", "html", "digest", "n_bytes", F.when(F.col("keeper").isNotNull(), "revisit").otherwise("response").alias("record_type"), F.col("keeper").alias("refers_to"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes a record for each row of pages(page_id, url, html) to gzip-compressed archives under ``path``.

    The text writer's line separator ends a record, so Spark's committer makes the files whole and a lost executor's
    attempt leaves nothing behind. Responses hold an HTTP head and the payload in UTF-8; revisits hold no payload but its digest, its
    length and the id they refer to. Null html: empty payload. Null url: no target. White space and control
    characters in a URL are percent-encoded, so that they cannot break a header. Null page_id: an empty id, always a response. Repeated
    rows are records of their own; rows of one id and equal payloads refer to none of them. Empty table: no records. Other columns are not read.

    A file holds about ``file_bytes`` before compression, or one page if that is larger. It is one gzip stream, since Spark's text writer
    makes no other; a reader takes it whole.
    """
    rows = deduplicated(pages, least_bytes, file_bytes)
    crlf = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(crlf * 2), F.col("html"))
    block = F.when(F.col("record_type") == "response", http).otherwise("")
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    head = F.concat(
        F.lit(f"WARC/1.0{crlf}WARC-Type: "),
        F.col("record_type"),
        F.lit(f"{crlf}WARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">"),
        F.coalesce(F.concat(F.lit(f"{crlf}WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")), F.lit("")),
        F.coalesce(F.concat(F.lit(f"{crlf}WARC-Target-URI: "), url), F.lit("")),
        F.lit(f"{crlf}WARC-Date: 1970-01-01T00:00:00Z{crlf}WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit(f"{crlf}X-Payload-Length: "),
        F.col("n_bytes").cast("string"),
        F.lit(f"{crlf}Content-Type: application/http;msgtype=response{crlf}Content-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(crlf * 2),
    )
    text = rows.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))
    text.write.option("lineSep", crlf * 2).option("compression", "gzip").text(path)


def plain(content: bytes) -> bytes:
    """``content`` without gzip, of one or of many members."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        d = zlib.decompressobj(31)
        out.append(d.decompress(content))
        content = d.unused_data
    return b"".join(out)


LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*([0-9]{1,18})[ \t]*(?=\r\n)", re.IGNORECASE)


def candidates(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """Start, end of head, end of block and successor of everything that looks like a record, also inside payloads.

    Ends of heads and lengths are found once and looked up for each magic string, so time stays in proportion to the data.
    """
    ends = [m.start() for m in re.finditer(re.escape(HEAD_END), data)]
    lengths = [(m.start(), m.end(), int(m[1])) for m in LENGTH.finditer(data)]
    begins = [x[0] for x in lengths]
    for magic in re.finditer(re.escape(MAGIC), data):
        at = magic.start()
        if (e := bisect.bisect_left(ends, at)) == len(ends):
            return
        end = ends[e]
        k = bisect.bisect_left(begins, at)
        if k < len(lengths) and lengths[k][1] <= end:
            block = end + 4 + lengths[k][2]
            if data[block : block + 4] == HEAD_END:
                yield at, end + 4, block, block + 4


def reachable(start: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which candidates the chain of successors from offset 0 comes to, by pointer jumping.

    In round k a marked candidate marks the one 2^k steps on, and every jump is doubled, so a chain
    of n records takes log2 n rounds. Jumps to where no candidate starts go to a last, idle place.
    """
    order = np.argsort(start, kind="stable")
    s = start[order]
    n = len(s)
    at = np.searchsorted(s, after[order])
    jump = np.r_[np.where((at < n) & (s[np.minimum(at, max(n - 1, 0))] == after[order]), at, n), n] if n else np.array([0])
    marked = np.zeros(n + 1, bool)
    marked[:n] = s == 0
    while True:
        was = marked.sum()
        marked[jump[np.flatnonzero(marked)]] = True
        if (jump == n).all() or (marked.sum() == was and (jump == jump[jump]).all()):
            break
        jump = jump[jump]
    out = np.zeros(n, bool)
    out[order] = marked[:n]
    return out


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The archives under ``path`` as rows (path, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def links(files: DataFrame) -> DataFrame:
    """(path, start, after) of every candidate record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = list(candidates(plain(b.column("content")[i].as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([b.column("path")[i].as_py()] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())], names=["path", "start", "after"])

    return files.mapInArrow(run, "path string, start long, after long")


def verified(found: DataFrame) -> DataFrame:
    """(path, start) of the candidates that a file's chain reaches; a file's offsets, not its bytes, meet in one task."""

    def run(t: pa.Table) -> pa.Table:
        ok = reachable(t.column("start").to_numpy(), t.column("after").to_numpy())
        return t.select(["path", "start"]).filter(pa.array(ok))

    return found.groupBy("path").applyInArrow(run, "path string, start long")


def header(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"\r\n" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head, re.IGNORECASE)
    return m[1].decode("utf-8", "replace").strip() if m else None


RECORD = "path string, start long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def bodies(files: DataFrame, payload: bool) -> DataFrame:
    """Every candidate record parsed; ``payload`` null where it isn't wanted."""

    def number(urn: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn or "")
        return int(m[1]) if m else None

    def rows(path: str, data: bytes) -> Iterator[dict]:
        for start, head_end, block_end, _ in candidates(data):
            head, block = data[start:head_end], data[head_end:block_end]
            kind = header(head, b"WARC-Type")
            body, length, digest = None, None, None
            if kind == "response":
                body = block.partition(HEAD_END)[2]
                length, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
            elif kind == "revisit":
                length, digest = int(header(head, b"X-Payload-Length") or 0), (header(head, b"WARC-Payload-Digest") or "").removeprefix("sha1:")
            yield {
                "path": path,
                "start": start,
                "page_id": number(header(head, b"WARC-Record-ID")),
                "url": header(head, b"WARC-Target-URI"),
                "record_type": kind,
                "refers_to": number(header(head, b"WARC-Refers-To")),
                "payload_bytes": length,
                "payload_digest": digest,
                "payload": body.decode("utf-8", "replace") if payload and body is not None else None,
            }

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                out, held = [], 0
                for r in rows(b.column("path")[i].as_py(), plain(b.column("content")[i].as_py())):
                    out.append(r)
                    held += 500 + len(r["payload"] or "")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return files.mapInArrow(run, RECORD)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives under ``path``: page_id, url, record_type, refers_to, payload_bytes, payload_digest and, if wanted, payload.

    Tasks emit a candidate wherever the magic stands, with the offset of its successor; pointer
    jumping from the start of a file keeps the candidates that the chain reaches; a semi join on (path, start) then drops
    what only looked like records inside payloads. An archive is one task's work, so writers bound its size; one
    row holds at most 2 GB. A truncated last record and all after a broken one are left out. No files: an error from the scan;
    empty files: no records.
    """
    files = scan(spark, path)
    good = verified(links(files))
    return bodies(files, payload).join(good, ["path", "start"], "left_semi").drop("path", "start")
