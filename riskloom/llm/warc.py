"""WARC archives: records with revisits written in gzip members, and a reader that splits archives by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.base import stored, sub_batches

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes handed to the decompressor at a time, and bytes read from an archive at a time.
STEP, READ = 16 << 10, 4 << 20
FILES = "path string, length long, records long"


def member(record: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def uri(prefix: str, value) -> str:
    """A URI that no white space or control character can break; ``value_of`` reads the value back."""
    return prefix + quote(str(value), safe="")


def header_value(value) -> str:
    """White space and control characters percent-encoded, so that a value stays in its line."""
    return re.sub("[\x00-\x20\x7f]", lambda m: quote(m[0]), str(value))


def record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *((k, v) for k, v in headers if v is not None), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page, url, payload: bytes | None, digest: bytes, size: int, top, date: str, media: str) -> bytes:
    """A response with its payload, or without payload a revisit of record ``top``. Both keep the HTTP headers of the full payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {media}\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [
        ("WARC-Record-ID", None if page is None else f"<{uri('urn:page:', page)}>"), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else header_value(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()), ("Content-Type", "application/http; msgtype=response"),
    ]
    if payload is not None:
        return record("response", headers, block + payload)
    refers = None if top is None else f"<{uri('urn:page:', top)}>"
    return record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers)], block)


def open_file(path: str, write: bool = False):
    system, inner = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    if not write:
        return system.open_input_file(inner)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner, compression=None)  # members are compressed already


def write_warc(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
    media: str = "text/html; charset=utf-8", file_bytes: int = 1 << 30,
) -> DataFrame:
    """Write one record for each row to archives in ``folder`` (shared storage); returns their ``path, length, records``.

    Each record is a gzip member of its own; an archive starts with a warcinfo record and is closed beyond ``file_bytes``. Of rows with equal payloads of at
    least ``min_bytes`` bytes (the same SHA-1 and length) the one with the largest ``key`` is a response, the others are revisits that refer
    to it and carry no payload; rows with smaller payloads are all responses. Of several rows with the largest key the one with the largest url is the response.

    Null payloads are empty. A null key or url has no header (nulls count as smallest); revisits of a row without key refer to nothing.
    Other columns are not read. An empty table gives no archive. Archives have unique names, and only those of tasks that succeeded are listed: a lost
    task writes its own anew, and what it left in the folder is not read.

    Payloads are not shuffled to find copies: rows shrink to digest, length and key and combine before their shuffle. Only payloads that occur more than once are
    joined back, and Spark broadcasts these when their stored size allows it, else splits hot payloads as it joins.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("page"), F.col(url).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("body")), "size": F.octet_length("body").cast("long")})
    counted = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size", "page").agg(F.count("*").alias("m"))
    most = counted.groupBy("digest", "size").agg(F.max(F.struct("page", "m")).alias("most"), F.sum("m").alias("n")).where("n > 1")
    copied = stored(most.select("digest", "size", F.lit(True).alias("copied"), F.col("most.page").alias("top"), F.col("most.m").alias("m")), "copied")
    marked = rows.join(copied, ["digest", "size"], "left")
    is_top = F.col("page").eqNullSafe(F.col("top"))
    once = marked.where(F.col("copied").isNull() | ~is_top | (F.col("m") == 1))
    revisit = F.col("copied").isNotNull() & ~is_top

    def columns(body: Column, top: Column) -> list[Column]:
        return ["page", "url", body.alias("body"), "digest", "size", top.alias("top")]

    out = once.select(*columns(F.when(~revisit, F.col("body")), F.when(revisit, F.col("top"))))
    many = copied.where("m > 1")
    if not many.isEmpty():  # several rows with the largest key
        tied = rows.join(many, ["digest", "size"]).where(is_top)
        best = tied.groupBy("digest", "size", "page").agg(F.max(F.struct("url", "body")).alias("best"), F.count("*").alias("all"))
        best = stored(best.select("page", F.col("best.url").alias("url"), F.col("best.body").alias("body"), "digest", "size"), "best")
        again = tied.groupBy("digest", "size", "page", "url").agg(F.count("*").alias("c"))
        chosen = best.select("digest", "size", F.col("url").alias("best_url"))
        again = again.join(chosen, ["digest", "size"]).withColumn("c", F.col("c") - F.col("url").eqNullSafe(F.col("best_url")).cast("long"))
        again = again.where("c > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "c")))
        out = out.union(best.select(*columns(F.col("body"), F.lit(None).cast(rows.schema["page"].dataType))))
        out = out.union(again.select(*columns(F.lit(None).cast("binary"), F.col("page"))))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = record("warcinfo", [("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        done, sink, path, length, n = [], None, "", 0, 0
        for batch in sub_batches(batches, "body"):
            for page, link, content, digest, size, top in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is not None and length >= file_bytes:
                    sink.close()
                    done.append((path, length, n))
                    sink = None
                if sink is None:
                    path = f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    sink, length, n = open_file(path, write=True), 0, 0
                    length += sink.write(member(info))
                length += sink.write(member(page_record(page, link, content, digest, size, top, date, media)))
                n += 1
        if sink is not None:
            sink.close()
            done.append((path, length, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "length", "records"])

    return stored(out.mapInArrow(write, FILES), "archives")


class Archive:
    """An archive of ``size`` bytes, read a few MB at a time."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.file, self.base, self.held = open_file(path), 0, b""

    def at(self, position: int, n: int = STEP) -> memoryview:
        """``n`` bytes from ``position``, fewer only at the end."""
        upto = self.base + len(self.held)
        if not self.base <= position <= upto or position + n > upto and upto < self.size:
            self.file.seek(position)
            self.base, self.held = position, self.file.read(READ)
        start = position - self.base
        return memoryview(self.held)[start : start + n]

    def candidate(self, position: int, end: int) -> int | None:
        """The first gzip magic that starts in the range."""
        while position < end:
            part = bytes(self.at(position, 4 * STEP))
            found = part.find(MAGIC)
            if found >= 0:
                return position + found if position + found < end else None
            if position + len(part) >= self.size:
                return None
            position += len(part) - len(MAGIC) + 1
        return None

    def member(self, position: int) -> tuple[bytes, int] | None:
        """The record of the gzip member there and where the next starts; None unless it is whole and holds a WARC record."""
        d, parts, known, at = zlib.decompressobj(31), [], False, position
        while not d.eof:
            if at >= self.size:
                return None
            step = self.at(at)
            if not step:
                raise EOFError(f"{self.path} is shorter than the {self.size} bytes stated")
            try:
                parts.append(d.decompress(step))
            except zlib.error:
                return None
            at += len(step)
            if not known:
                start = b"".join(parts)[:5]
                if not b"WARC/".startswith(start):
                    return None
                known = start == b"WARC/"
        return (b"".join(parts), at - len(d.unused_data)) if known else None

    def walk(self, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
        """``(position, next position, record)`` of the members that start in the range, from the first valid one; damaged stretches are skipped."""
        position = start
        while (position := self.candidate(position, end)) is not None:
            got = self.member(position)
            if got is None:
                position += 1
            else:
                yield position, got[1], got[0]
                position = got[1]


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """WARC headers in lower case, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    return headers, rest[: int(size)] if size.isdigit() else rest


def http_parts(block: bytes) -> tuple[int | None, bytes]:
    """The length that the HTTP headers state, and the payload."""
    head, _, body = block.partition(b"\r\n\r\n")
    found = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
    return (int(found[1]) if found else None), body


def archive_files(spark, folder: str) -> DataFrame:
    """``path, length`` of the archives in a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def _over(spark_rows: DataFrame, ddl: str, names: list[str], make: Callable) -> DataFrame:
    """Rows that ``make`` yields for each range ``(path, length, start, end, first)``, about a MB of them at a time."""

    arrow = to_arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for path, length, start, end, first in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "start", "end", "first"))):
                for row, weight in make(Archive(path, length), path, start, end, first):
                    held.append(row)
                    n += weight
                    if n > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], names=names)
                        held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], names=names)

    return spark_rows.mapInArrow(run, ddl)


def to_arrow(ddl: str) -> pa.Schema:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def split_ranges(files: DataFrame, split_bytes: int = 16 << 20, most_rounds: int = 1000) -> DataFrame:
    """``path, length, start, end, first``: byte ranges of the archives and where the first member starts that a range owns.

    A task looks for gzip magic in its range, takes the first candidate that decodes to a WARC record and follows the members that start inside, the last one
    beyond the end of the range. A payload may itself hold a gzip record, so ranges are compared: the members of a range must begin where those
    before it ended. Ranges that began elsewhere are walked again from there, until all agree (none has to be, as a rule; each round puts at least the first
    of an archive right). After a damaged stretch,
    whose end nobody knows, a range begins at its own first valid member.
    """
    names = ["path", "length", "start", "end", "first"]
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = files.select("path", "length", starts.alias("start")).withColumn("end", F.least(F.col("start") + split_bytes, "length"))
    ranges = ranges.withColumn("first", F.lit(None).cast("long"))
    width = max(1, ranges.sparkSession.sparkContext.defaultParallelism)

    def look(archive, path, start, end, asked):
        begin = after = None
        for at, then, _ in archive.walk(start if asked is None else asked, end):
            begin, after = at if begin is None else begin, then
        yield (path, archive.size, start, end, begin, after if after is not None and after >= end else None, asked), 100

    ddl = "path string, length long, start long, end long, first long, after long, asked long"
    columns = [*names, "after", "asked"]
    known = stored(_over(ranges.repartition(4 * width, "path", "start"), ddl, columns, look), "ranges")
    order = Window.partitionBy("path").orderBy("start")
    expected = F.coalesce(F.max("after").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    for _ in range(most_rounds):
        own = F.when(F.col("expected") < F.col("end"), F.col("expected"))
        wrong = (F.col("expected") > F.col("start")) & ~F.col("first").eqNullSafe(own) & ~F.col("asked").eqNullSafe(F.col("expected"))
        seen = known.withColumn("expected", expected).withColumn("wrong", wrong)
        if seen.where("wrong").isEmpty():
            return known.select(names)
        again = seen.where("wrong").select("path", "length", "start", "end", F.col("expected").alias("first"))
        known = stored(seen.where("not wrong").select(columns).union(_over(again, ddl, columns, look)), "ranges")
    raise RuntimeError(f"ranges did not agree in {most_rounds} rounds")


RECORD = (
    "path string, offset long, type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
    "content_type string, digest_ok boolean, payload_bytes long, payload binary"
)


def read_warc(files: DataFrame, split_bytes: int = 16 << 20, with_payload: bool = True) -> DataFrame:
    """The records of archives ``(path, length)``, read by byte ranges of ``split_bytes`` (see ``split_ranges``).

    ``payload_bytes`` is the length of the full payload: counted for a record that holds it, as its HTTP headers state it for a revisit (null where they do
    not). ``digest_ok`` says whether the payload held has the stated SHA-1 (null where there is none to compare). Payloads of application/http blocks
    come without their HTTP headers. ``record_id`` and ``refers_to`` come without angle brackets. Damaged members are skipped; what is valid around
    them is read. An archive without bytes has no records. A record is held whole by its task (and is under 2 GB).
    """
    names = [c.split(" ")[0] for c in RECORD.split(", ")]

    def records(archive, path, start, end, first):
        for at, _, data in archive.walk(first, end) if first is not None else ():
            headers, block = parsed(data)
            kind, media = headers.get("warc-type"), headers.get("content-type", "")
            stated, payload = http_parts(block) if media.startswith("application/http") else (None, block)
            digest = headers.get("warc-payload-digest")
            ok, size = None, stated
            if kind == "revisit":
                payload = None
            else:
                size = len(payload)
                if digest and digest.startswith("sha1:"):
                    ok = digest[5:] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
            ids = [v.strip("<>") if v else None for v in (headers.get("warc-record-id"), headers.get("warc-refers-to"))]
            row = (path, at, kind, ids[0], headers.get("warc-target-uri"), headers.get("warc-date"), ids[1], digest, media, ok, size, payload if with_payload else None)
            yield row, 500 + (len(payload or b"") if with_payload else 0)

    ranges = split_ranges(files, split_bytes)
    width = max(1, ranges.sparkSession.sparkContext.defaultParallelism)
    return _over(ranges.repartition(4 * width, "path", "start"), RECORD, names, records)
