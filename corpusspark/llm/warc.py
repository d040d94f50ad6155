"""WARC archives with the index first.

Which record is a response or a revisit follows from narrow columns alone.  Records then go to their archives in one
shuffle and are written as gzip members, one per record; each writing task returns its part of the index (archive,
offset, length, url, digest), which is a table of its own.  Reading starts from the index: selected records are sorted
by archive and offset, and neighbours are fetched by one byte range.  Every attempt writes files of its own name, and
the index holds those of the attempts that counted, so lost executors cost nothing but an unused file.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from .common import base32_sha1, join_groups

END = "\r\n\r\n"
#: Bytes of payload per archive, bytes read per task, and the gap and size up to which ranges are read together.
ARCHIVE_BYTES, TASK_BYTES, GAP_BYTES, RANGE_BYTES = 256 << 20, 8 << 20, 64 << 10, 4 << 20
#: gzip level.
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long, digest_ok boolean"


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def headers(date: str = DATE) -> Column:
    """All of a record before its payload, from page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    nl = "\r\n"
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{nl}Content-Type: text/html; charset=utf-8{nl}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    revisit = F.col("record_type") == "revisit"
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    refers = F.concat(F.lit(f"{nl}WARC-Refers-To: "), _record_id(F.col("refers_to")), F.lit(f"{nl}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return F.concat(
        F.lit(f"WARC/1.1{nl}WARC-Type: "), F.col("record_type"), F.lit(f"{nl}WARC-Record-ID: "), _record_id(F.col("page_id")),
        F.lit(f"{nl}WARC-Date: {date}{nl}WARC-Target-URI: "), url, F.lit(f"{nl}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, refers).otherwise(F.lit("")), F.lit(f"{nl}Content-Type: application/http; msgtype=response{nl}Content-Length: "),
        block.cast("string"), F.lit(END), http)


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record, without the payloads.

    Of equal payloads the largest page_id is the response (null ids only where there is no other); the rest revisit it.
    Rows of the same page_id and payload are responses both.  Null html is an empty payload.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    narrow = cut_lineage(pages.select("page_id", F.octet_length(html).cast("long").alias("payload_bytes"), base32_sha1(html).alias("payload_digest")))
    total = narrow.count()
    groups = cut_lineage(narrow.groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")))
    alone = F.coalesce(F.col("page_id") == F.col("_first"), F.col("_first").isNull())
    return cut_lineage(join_groups(narrow, groups, "payload_digest", "_n", total).select(
        "page_id", "payload_bytes", "payload_digest", F.when(alone, "response").otherwise("revisit").alias("record_type"),
        F.when(~alone, F.col("_first")).alias("refers_to")))


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inside = _filesystem(folder)
        path, out, now, offset = "", None, None, 0
        for batch in batches:
            rows: list[tuple] = []
            for archive, page, url, digest, head, payload in zip(*[batch.column(c).to_pylist() for c in ("archive", "page_id", "url", "payload_digest", "head", "payload")], strict=True):
                if archive != now:
                    if out:
                        out.close()
                    name = f"archive-{archive:06d}-{uuid4().hex}.warc.gz"
                    out, path, now, offset = fs.open_output_stream(f"{inside}/{name}", compression=None), f"{folder}/{name}", archive, 0
                member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                blob = member.compress((head + payload + END).encode("utf-8", "surrogatepass")) + member.flush()
                out.write(blob)
                rows.append((path, offset, len(blob), page, url, digest))
                offset += len(blob)
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, INDEX_TYPES, strict=True)], INDEX_NAMES)
        if out:
            out.close()

    return write


INDEX_NAMES = ["path", "offset", "length", "page_id", "url", "payload_digest"]
INDEX_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Writes ``folder``/archive-*.warc.gz and returns the index: path, offset, length, page_id, url, payload_digest.

    Decisions and texts meet by one shuffle to the archives: within an archive a decision stands before its records.
    """
    plan = plan_records(pages)
    total, size = plan.agg(F.count("*"), F.coalesce(F.sum("payload_bytes"), F.lit(0))).first()
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    archives = max(-(-size // archive_bytes), min(parts, -(-total // 64)), 1)  # enough for every task to have one
    html = F.coalesce(F.col("html"), F.lit(""))
    texts = pages.select("page_id", "url", html.alias("html"), base32_sha1(html).alias("payload_digest"), F.lit(1).alias("_side"))
    once = plan.filter("record_type = 'revisit'").dropDuplicates(["page_id", "payload_digest"]).select("page_id", "payload_digest", "refers_to", F.lit(0).alias("_side"))
    both = texts.unionByName(once, allowMissingColumns=True).withColumn("archive", F.pmod(F.xxhash64("page_id"), F.lit(archives)).cast("int"))
    same = W.partitionBy("archive", "page_id", "payload_digest").orderBy("_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = both.repartition(archives, "archive").withColumn("_decided", F.first("_side").over(same)).withColumn("refers_to", F.first("refers_to").over(same))
    rows = met.filter("_side = 1").withColumn("record_type", F.when(F.col("_decided") == 0, "revisit").otherwise("response")).withColumn(
        "payload_bytes", F.octet_length("html").cast("long"))
    payload = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("html"))
    ready = rows.select("archive", "page_id", "url", "payload_digest", headers(date).alias("head"), payload.alias("payload")).sortWithinPartitions("archive", "page_id", "payload_digest")
    fs, inside = _filesystem(folder)
    fs.create_dir(inside, recursive=True)
    return cut_lineage(ready.mapInArrow(_writer(folder), "path string, offset long, length long, page_id long, url string, payload_digest string"))


def _parse(blob: bytes) -> tuple:
    """page_id, url, payload size, digest, type, refers_to and whether a response's payload has that digest."""
    head, _, block = blob.partition(b"\r\n\r\n")
    names = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = names["WARC-Payload-Digest"].removeprefix("sha1:")
    page, refers = names["WARC-Record-ID"][10:-1], names.get("WARC-Refers-To", "<urn:page:null>")[10:-1]
    right = names["WARC-Type"] == "revisit" or payload[size:] == b"\r\n\r\n" and base64.b32encode(hashlib.sha1(payload[:size]).digest()).decode() == digest
    return None if page == "null" else int(page), names["WARC-Target-URI"], size, digest, names["WARC-Type"], None if refers == "null" else int(refers), right


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """For paths with any scheme that Arrow knows (file, hdfs, s3, gs, ...); Hadoop writes file:/a where Arrow wants file:///a."""
    scheme, _, rest = path.partition(":")
    return pafs.FileSystem.from_uri(path if rest.startswith("//") or not rest else f"{scheme}://{rest}")


def _read_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (path, offset, length, ...) rows: neighbours are fetched by one read of RANGE_BYTES at most (or one record)."""
    for batch in batches:
        rows, i = list(zip(batch["path"], batch["offset"].tolist(), batch["length"].tolist(), strict=True)), 0
        out: list[tuple] = []
        while i < len(rows):
            path, start, length = rows[i]
            j, end = i + 1, start + length
            while j < len(rows) and rows[j][0] == path and rows[j][1] - end <= GAP_BYTES and rows[j][1] + rows[j][2] - start <= RANGE_BYTES:
                end = max(end, rows[j][1] + rows[j][2])
                j += 1
            fs, inside = _filesystem(path)
            with fs.open_input_file(inside) as f:
                blob = f.read_at(end - start, start)
            out += [(*_parse(zlib.decompress(blob[o - start : o - start + n], 31)), path, o, n) for _, o, n in rows[i:j]]
            i = j
        frame = pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok", "archive", "offset", "length"], dtype=object)
        for c in ("page_id", "refers_to"):
            frame[c] = frame[c].astype("Int64")
        yield frame[["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length", "digest_ok"]].astype(
            {"payload_bytes": "int64", "offset": "int64", "length": "int64", "digest_ok": "bool"})


def read_records(selected: DataFrame) -> DataFrame:
    """Reads the records of ``selected`` index rows (path, offset, length) back.

    The rows are range-partitioned by archive and offset into as many tasks as the bytes to fetch need (``TASK_BYTES``
    each, and enough for every core), not as the few bytes of the index would: neighbours stay together.
    """
    rows, size = selected.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(-(-size // TASK_BYTES), min(parts, -(-rows // 64)), 1)
    ranges = selected.select("path", "offset", "length").repartitionByRange(tasks, "path", "offset")
    return ranges.sortWithinPartitions("path", "offset").mapInPandas(_read_ranges, READ_SCHEMA)


def archive_round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes all pages (page_id, url, html; other columns are ignored) into archives and reads every record back.

    Null and repeated page_ids, null urls and null or empty html are records like any other; an empty table writes no
    archive and gives no rows.  The folder lies in the shared checkpoint folder unless one is named.
    """
    if folder is None:
        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/warc-{uuid4().hex}"
    pages = pages.select("page_id", "url", "html")
    if pages.isEmpty():
        return spark.createDataFrame([], READ_SCHEMA)
    return read_records(write_archives(pages, folder))
