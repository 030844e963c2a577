"""WARC archives: a writer that stores repeated payloads once, and a reader that salvages.

Writing. One record per page. Of the pages whose payload (html in UTF-8; null: empty) is equal and
has at least `MIN_REVISIT` bytes, the one with the largest page_id is the response; the others are
revisit records that refer to it. Each record is a gzip member of its own. A task writes its pages,
sorted, into archives of about `ARCHIVE_BYTES`, each under a temporary name and then moved to one
that depends on the partition only, so a repeated task writes the same files over again. The list of
archives is itself a written table.

Reading. Archives are read through Spark (any file system it knows). A record counts if its gzip
member is whole and its checksum right (plain archives: if another version line or the end
follows), its header parses, its length matches and its block digest agrees. After a failed check
the reader searches the following bytes for the next position that starts a valid member, or a
version line with a valid record, and goes on there; the bytes between are reported as a gap with
the reason. Gaps are rows of the output, beside the records.

* Page payloads are shuffled once, by page_id, to meet the decision on their role; revisits then
  leave without their payload. Votes are aggregates on (digest, length).
* An archive is read in time linear in its size: members are inflated in chunks up to their own end, and a plain record's end is
  looked at before its bytes are copied. A member that would inflate beyond `MOST_INFLATED` and a header longer than
  `HEADER_BYTES` are gaps, with that reason.
* A revisit's length and digest are read back from the record it refers to.

Rows. Null page_id: a page like any other, written without a number; it is a response always, as it
cannot be referred to. Repeated page_ids: repeated rows of one page are written each; of equal
payloads under one id the copies are responses together. Null url: empty. Empty table: no archive, no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoledger.llm import common

MIN_REVISIT = 1000
ARCHIVE_BYTES = 8 << 20
LEVEL = 3
VERSION = b"WARC/1.1\r\n"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
URN = "urn:page:"
#: Bytes given to the inflater at a time, and the longest header that is searched for its end.
CHUNK = 1 << 14
HEADER_BYTES = 1 << 20
#: A member that inflates to more is no record: no cell of a table could hold it.
MOST_INFLATED = 1 << 30
#: Records and payload bytes of one batch of the reader's output.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version line, headers, blank line, block, two line ends."""
    fields = [*headers, ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value or "")


def page_record(page_id: int | None, url: str, html: str | None, digest: str, refers_to: int | None) -> bytes:
    """Record of a page; with `refers_to` a revisit without block."""
    block = b"" if refers_to is not None else (html or "").encode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if refers_to is not None:
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        headers.append(("WARC-Refers-To", f"<{URN}{refers_to}>"))
    return record_bytes(headers, block)


def _write_task(folder: str, archive_bytes: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
        files.create_dir(root)
        task_id = TaskContext.get()
        part, attempt = task_id.partitionId(), task_id.taskAttemptId()
        written: list[tuple[str, int, int]] = []
        held, size, count = [], 0, 0

        def flush() -> None:
            nonlocal held, size, count
            name = f"pages-{part:06d}-{len(written):06d}.warc.gz"
            draft = f"{root}/_draft-{attempt}-{name}"
            with files.open_output_stream(draft, compression=None) as out:
                out.write(b"".join(held))
            files.move(draft, f"{root}/{name}")
            written.append((name, count, size))
            held, size, count = [], 0, 0

        for batch in batches:
            for row in batch.to_pylist():
                member = gzip_member(
                    page_record(row["page_id"], row["url"], row["html"], row["digest"], row["refers_to"])
                )
                held.append(member)
                size, count = size + len(member), count + 1
                if size >= archive_bytes:
                    flush()
        if held:
            flush()
        if written:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*written, strict=True)], ["archive", "records", "bytes"]
            )

    return task


def write_archives(
    pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write all pages under the folder; returns the stored list of archives."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html")
    )
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    sized = rows.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    heads = common.stored(
        sized.where((F.col("bytes") >= min_revisit) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n"),
        "payload-heads",
    )
    revisits = common.stored(
        sized.where((F.col("bytes") >= min_revisit) & F.col("page_id").isNotNull())
        .join(heads, "digest")
        .where("page_id <> head")
        .select("page_id", "digest", F.col("head").alias("refers_to"))
        .distinct(),
        "revisits",
    )
    whole = rows.withColumn("digest", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    told = whole.join(revisits, ["page_id", "digest"], "left")
    told = told.select(
        "page_id",
        "url",
        F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"),
        "digest",
        "refers_to",
    )
    task = _write_task(folder, archive_bytes)
    ordered = told.sortWithinPartitions("page_id", "digest", "url")
    return common.stored(
        ordered.mapInArrow(task, "archive string, records long, bytes long"), "archives"
    )


class BadRecord(ValueError):
    """Why the bytes at a position are no valid record."""


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the record at the start of the data."""
    match = _VERSION_LINE.match(data)
    if not match:
        raise BadRecord("no version line")
    end = data.find(b"\r\n\r\n", match.end() - 2)
    if end < 0:
        raise BadRecord("header without end")
    headers = {}
    for line in data[match.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line and not colon:
            raise BadRecord("header line without colon")
        if line:
            headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if "warc-type" not in headers or "warc-record-id" not in headers:
        raise BadRecord("no type or record id")
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise BadRecord("no content length")
    start = end + 4
    stop = start + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise BadRecord("record end not where its length says")
    block = data[start:stop]
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:].lower() != hashlib.sha1(block).hexdigest():
        raise BadRecord("block digest differs")
    return headers, block, stop + 4


def _member_at(data: bytes, at: int, most: int = MOST_INFLATED) -> tuple[bytes, int]:
    """The inflated gzip member at a position, and its length.

    Only chunks up to the member's end are touched, so an archive is read in time linear in its size.
    """
    inflate, view, parts, size, fed = zlib.decompressobj(31), memoryview(data), [], 0, at
    try:
        while not inflate.eof and fed < len(data):
            chunk = view[fed : fed + CHUNK]
            parts.append(inflate.decompress(chunk, most + 1 - size))
            size, fed = size + len(parts[-1]), fed + len(chunk)
            if size > most:
                raise BadRecord("member inflates beyond the limit")
    except zlib.error as error:
        raise BadRecord("damaged member") from error
    if not inflate.eof:
        raise BadRecord("member without end")
    return b"".join(parts), fed - at - len(inflate.unused_data)


def record_at(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at a position, compressed or plain, and the bytes it takes."""
    if data.startswith(_MEMBER, at):
        inner, taken = _member_at(data, at)
        headers, block, used = parse_record(inner)
        if used != len(inner):
            raise BadRecord("bytes behind the record in its member")
        return headers, block, taken
    if not _VERSION_LINE.match(data, at):
        raise BadRecord("neither member nor version line")
    head = data.find(b"\r\n\r\n", at, at + HEADER_BYTES)
    if head < 0:
        raise BadRecord("header without end")
    length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)\s*\r\n", data[at : head + 2])
    if not length:
        raise BadRecord("no content length")
    stop = head + 8 + int(length[1])
    if data[stop - 4 : stop] != b"\r\n\r\n":
        raise BadRecord("record end not where its length says")
    return parse_record(data[at:stop])


def salvage(data: bytes) -> Iterator[tuple]:
    """('record', start, end, headers, block) and ('gap', start, end, reason) over an archive."""
    at, bad, reason = 0, None, ""
    starts = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
    while at < len(data):
        try:
            headers, block, taken = record_at(data, at)
        except BadRecord as error:
            if bad is None:
                bad, reason = at, str(error)
            found = starts.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if bad is not None:
            yield "gap", bad, at, reason
            bad = None
        yield "record", at, at + taken, headers, block
        at += taken
    if bad is not None:
        yield "gap", bad, len(data), reason


def _page_number(urn: str) -> int | None:
    found = re.fullmatch(rf"<{URN}(-?\d+)>", urn)
    return int(found[1]) if found else None


FOUND = (
    "archive string, start long, end long, kind string, reason string, page_id long, url string, "
    "record_type string, digest string, bytes long, refers_to long, html string"
)


def _read_task(with_payload: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FOUND.split(", ")]
        kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in FOUND.split(", ")]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

        for batch in batches:
            for k in range(batch.num_rows):
                archive, rows, held = batch["path"][k].as_py(), [], 0
                for what, start, end, *rest in salvage(batch["content"][k].as_buffer().to_pybytes()):
                    if what == "gap":
                        rows.append((archive, start, end, what, rest[0], *[None] * 7))
                        continue
                    headers, block = rest
                    payload = block.decode("utf-8", "replace") if with_payload else None
                    rows.append(
                        (
                            archive,
                            start,
                            end,
                            what,
                            None,
                            _page_number(headers.get("warc-record-id", "")),
                            headers.get("warc-target-uri"),
                            headers.get("warc-type"),
                            hashlib.sha1(block).hexdigest(),
                            len(block),
                            _page_number(headers.get("warc-refers-to", "")),
                            payload,
                        )
                    )
                    held += len(block) if with_payload else 0
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    return task


def read_archives(spark: SparkSession, folder: str, pattern: str = "*.warc*", with_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives in a folder, with their byte spans.

    `digest` and `bytes` are those of the record's own block.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", "content").mapInArrow(_read_task(with_payload), FOUND)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record; a
    revisit's payload is that of the response it refers to (null where that was lost)."""
    rows = records.where("kind = 'record'").select(
        "page_id", "url", "record_type", "digest", "bytes", "refers_to"
    )
    rows = common.stored(rows, "records")
    heads = common.stored(
        rows.where("record_type = 'response' and page_id is not null")
        .select(
            F.col("page_id").alias("head"), F.col("digest").alias("head_digest"), F.col("bytes").alias("head_bytes")
        )
        .dropDuplicates(["head"]),
        "heads",
    )
    names = ("payload_bytes", "payload_digest", "record_type", "refers_to")
    own = rows.where("record_type <> 'revisit'").select(
        "page_id", "url", F.col("bytes").alias(names[0]), F.col("digest").alias(names[1]), *names[2:]
    )
    # only revisits are joined: the others refer to nothing, and would meet in one task
    others = rows.where("record_type = 'revisit'")
    joined = others.join(heads, others["refers_to"] == heads["head"], "left").select(
        "page_id", "url", F.col("head_bytes").alias(names[0]), F.col("head_digest").alias(names[1]), *names[2:]
    )
    return own.union(joined)
