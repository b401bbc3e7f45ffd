"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

The reader takes each archive from its start. A gzip member or a plain record must pass its checks: it inflates with a
right CRC, starts with a version line, has a content length that fits, ends with two line ends, and matches its digests.
Where one fails, the reader searches for the next member or version line that passes, goes on from there, and logs the
bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.common import make, stored

MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
EMPTY_DATE = "1970-01-01T00:00:00Z"
#: Uncompressed bytes after which the writer starts another archive; a reader's task holds one archive at a time.
ARCHIVE_BYTES = 16 << 20
RECORDS = "archive string, offset long, length long, kind string, reason string, warc_type string, page_id long, url string, refers_to long, payload_digest string, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A ``resource``-like record of the page: a response carries the payload, a revisit only refers to one."""
    block = b"" if refers_to is not None else payload
    lines = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", EMPTY_DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/octet-stream"),
    ]
    if refers_to is not None:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*lines, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class Parsed(NamedTuple):
    end: int
    headers: dict[str, str]
    block: bytes


def parse_record(data: bytes, at: int) -> Parsed | str:
    """The record that starts at ``at``, or what is wrong with it."""
    if not (line := VERSION.match(data, at)):
        return "no version line"
    if (stop := data.find(b"\r\n\r\n", line.end() - 2)) < 0:
        return "header does not end"
    headers = {}
    for row in data[line.end() : stop].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if row and not colon:
            return "header line without colon"
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", size := headers.get("content-length", "")):
        return "no content length"
    start = stop + 4
    end = start + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        return "record does not end where its length says"
    block = data[start:end]
    if (said := headers.get("warc-block-digest", "")).startswith("sha1:") and said[5:].upper() != sha1_base32(block):
        return "block digest differs"
    if headers.get("warc-type") != "revisit" and (said := headers.get("warc-payload-digest", "")).startswith("sha1:") and said[5:].upper() != sha1_base32(block):
        return "payload digest differs"
    return Parsed(end + 4, headers, block)


def parse_unit(data: bytes, at: int) -> Parsed | str:
    """The gzip member with one record, or the plain record, at ``at``; ``end`` is its end in the archive."""
    if data[at : at + 3] != MAGIC:
        return parse_record(data, at)
    inflate = zlib.decompressobj(31)
    try:
        first = inflate.decompress(memoryview(data)[at : at + 4096], 10)
        if first and not b"WARC/1.".startswith(first[:7]) and not first.startswith(b"WARC/1."):
            return "member holds no record"
        inflate = zlib.decompressobj(31)
        body = inflate.decompress(memoryview(data)[at:])
    except zlib.error as e:
        return f"member does not inflate: {e}"
    if not inflate.eof:
        return "member is cut off"
    found = parse_record(body, 0)
    if isinstance(found, str):
        return found
    return found._replace(end=len(data) - len(inflate.unused_data)) if found.end == len(body) else "bytes after the member's record"


def salvage(data: bytes) -> Iterator[tuple[int, int, Parsed | str]]:
    """(offset, length, record) for each record and (offset, length, reason) for each gap, in order; they tile the archive."""
    at = 0
    start = re.compile(re.escape(MAGIC) + rb"|WARC/1\.[01]\r\n")
    while at < len(data):
        found = parse_unit(data, at)
        if not isinstance(found, str):
            yield at, found.end - at, found
            at = found.end
            continue
        reason, gap = found, at
        at += 1
        while candidate := start.search(data, at):
            if not isinstance(parse_unit(data, candidate.start()), str):
                break
            at = candidate.start() + 1
        at = candidate.start() if candidate else len(data)
        yield gap, at - gap, reason


def plan_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 and refers_to: of pages with equal payloads of at least ``least_bytes`` bytes, that
    with the largest page_id is the response.

    A null html is an empty payload. Rows of null page_id are written as responses, as are rows that repeat both
    page_id and payload of the response. Digests are grouped with map-side combining; the join back on the digest can be
    split where many rows share one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    last = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    refers = F.when(F.col("page_id") < F.col("last"), F.col("last"))
    return rows.join(last, "sha1", "left").select("page_id", "url", "payload", "sha1", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, least_bytes: int = 0) -> None:
    """Writes one record per row into gzip archives below ``folder``, a shared URI, one gzip member per record.

    Each task writes whole archives under their final names only once they are complete, so that a task run again
    replaces its own archives with equal ones. Payloads are written whole, however long; null html is an empty payload, a null
    page_id has a record of its own, a response. Rows that repeat the page_id and payload of a response are responses too. An empty
    table writes no record. Other columns than page_id, url and html are not read.
    """

    def archives(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        stem, attempt = f"part-{context.partitionId():06d}", context.taskAttemptId()
        number, members, size = 0, [], 0

        def close() -> tuple[str, int, int]:
            name = f"{root}/{stem}-{number:05d}.warc.gz"
            with system.open_output_stream(f"{root}/.{stem}-{number:05d}-{attempt}", compression=None) as out:
                for m in members:
                    out.write(m)
            system.move(f"{root}/.{stem}-{number:05d}-{attempt}", name)
            return name, len(members), sum(map(len, members))

        done = []
        for frame in frames:
            for page_id, url, payload, sha1, refers_to in frame.itertuples(index=False):
                known = lambda x: None if pd.isna(x) else int(x)
                record = encode_record(known(page_id), url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), known(refers_to))
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                members.append(pack.compress(record) + pack.flush())
                size += len(record)
                if size >= archive_bytes:
                    done.append(close())
                    number, members, size = number + 1, [], 0
        if members:
            done.append(close())
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"])

    make(pages.sparkSession, folder)  # an empty table has no task that would
    planned = plan_revisits(pages, least_bytes).sortWithinPartitions("page_id", "sha1", "url")
    # strings keep nulls beside longs that pandas would turn into floats
    planned = planned.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    planned.mapInPandas(archives, "archive string, records long, bytes long").write.mode("overwrite").parquet(f"{folder}-manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` of all archives below ``folder``, compressed or not.

    Archive, offset and length say where; a gap has the reason of its first failed check. A revisit has no payload.
    Archives are read by Spark, so from any store that it reads; one archive must fit in memory and below 2 GB. An archive without
    records, or a folder of empty ones, gives no row.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        page = re.compile(r"<urn:page:(-?\d+)>")
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows, size = [], 0
                for offset, length, found in salvage(content):
                    if isinstance(found, str):
                        rows.append((path, offset, length, "gap", found, None, None, None, None, None, None))
                    else:
                        h = found.headers
                        ids = [int(m[1]) if (m := page.fullmatch(h.get(k, ""))) else None for k in ("warc-record-id", "warc-refers-to")]
                        revisit = h.get("warc-type") == "revisit"
                        rows.append((path, offset, length, "record", None, h.get("warc-type"), ids[0], h.get("warc-target-uri"), ids[1], h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None if revisit else found.block))
                        size += len(found.block)
                    if size > 4 << 20:
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    return files.select("path", "content").mapInPandas(parse, RECORDS)


def resolve(records: DataFrame, folder: str) -> DataFrame:
    """One row per response and revisit: page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit's payload is that
    of the response it refers to, or unknown (null) where that response was lost.

    What is needed of the records is stored below ``folder``, without payloads, so that archives are parsed once. Records without
    a page_id keep a null one. No records give no row.
    """
    wanted = records.where("kind = 'record' AND warc_type IN ('response', 'revisit')")
    records = stored(wanted.select("page_id", "warc_type", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes")), folder, "records")
    responses = records.where("warc_type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    revisits = records.where("warc_type = 'revisit'").select("page_id", F.col("refers_to"), "payload_digest")
    sizes = responses.where("page_id IS NOT NULL").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"))
    sizes = sizes.groupBy("refers_to", "d").agg(F.max("b").alias("payload_bytes"))
    joined = revisits.withColumnRenamed("payload_digest", "d").join(sizes, ["refers_to", "d"], "left")
    return responses.unionByName(joined.select("page_id", "payload_bytes", F.col("d").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to"))
