"""WARC archives of captures, and their index, merged from locally sorted runs.

Writing: every page is one WARC/1.1 record and every record one gzip member, so that a reader can seek
to it; an archive begins with a warcinfo record and ends where its bytes reach a bound. Of pages
with equal payloads, the one with the smallest id is a response with an HTTP head and the payload, the
others are revisits with the head alone.

Spark's text writer puts the members into files on any file system that Spark reaches. It ends each row with
a separator, which here is one zero byte: a gzip member ends with the high byte of its length, which is zero
below 16 MiB, so that byte is left to the writer. A longer record is followed by an empty member.

Reading: each archive is parsed by one task, member by member, which sorts its captures by (URL key, timestamp, id): a
run. Runs are cut at common key borders, and for each range a loser tree merges the pieces of all
runs, so that ranges in order are the global capture history.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import parse_qsl, urlencode, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import delete_path, materialize, new_path

CRLF = "\r\n"

#: Fixed value: the profile of revisits whose payload is the same.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes that a writing task holds before it hands them on, and bytes that a reading one unpacks at a time.
HELD_BYTES, STEP = 4 << 20, 1 << 15

#: The alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Seconds since 1970 of the capture of page 0 where the pages carry no timestamp; each next page comes a second later.
FIRST_CAPTURE = 1_700_000_000

_CAPTURE = "url_key string, timestamp string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long, payload binary"
_NAMES = [x.split()[0] for x in _CAPTURE.split(", ")]
_KINDS = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _CAPTURE.split(", ")]


def base32_sha1(c: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each five hex digits are four letters."""
    digits = F.sha1(c)
    part = lambda k: F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 10).cast("int")
    letters = [
        F.substring(F.lit(BASE32), F.shiftright(part(k), 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for k in range(8) for j in range(4)
    ]
    return F.concat(*letters)


def url_key(url: str | None) -> str:
    """The sort-friendly key of a URL: host labels reversed, then path and sorted query; scheme, www, port, case of the host and fragment don't count."""
    parts = urlsplit((url or "").strip())
    try:
        host = (parts.hostname or "").lower()
    except ValueError:
        host = ""
    host = re.sub(r"^www\d*\.", "", host)
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{query}" if query else "")


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, first_id, first_url: each page with the page it revisits, if any.

    Pages with equal payloads of at least ``least_bytes`` bytes: the smallest page_id is the response; pages without an
    id are responses among themselves. The groups meet pre-aggregated, and only groups of two and more are joined back;
    the part of the join that holds a group with a third of all pages is split by adaptive execution.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": base32_sha1(F.col("html"))})
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    groups = pages.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_digest").alias("d")).agg(F.min(named).alias("first"), F.count("*").alias("n"))
    joined = pages.join(groups.where("n > 1").drop("n").hint("merge"), F.col("payload_digest") == F.col("d"), "left")
    first = F.when(F.coalesce(F.col("page_id") != F.col("first.page_id"), F.col("first.page_id").isNotNull()), F.col("first"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", first["page_id"].alias("first_id"), first["url"].alias("first_url"))


def uri(url: str) -> str:
    """A URL as a header holds it: control characters and spaces are percent-encoded, as they would end the header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _date(page_id: int | None) -> str:
    return datetime.fromtimestamp(FIRST_CAPTURE + (page_id or 0) % 10**9, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(kind: str, name: str, date: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC/1.1 record; fields that are None are left out."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), *fields, ("Content-Length", len(block))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head if v is not None), CRLF]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """Data as a gzip member that ends with a zero byte, followed by an empty one where its length would not."""
    def one(x: bytes) -> bytes:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(x) + z.flush()

    out = one(data)
    return out if out[-1] == 0 else out + one(b"")


def _capture_record(name: str, page: int | None, url: str, html: bytes, digest: str, first: int | None, first_url: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", uri(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "none" if page is None else page), ("Content-Type", "application/http; msgtype=response")]
    if first is None:
        return record("response", name, _date(page), fields, http + html)
    fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To-Target-URI", uri(first_url or "")), ("WARC-Refers-To-Date", _date(first)), ("X-Refers-To-Page", first)]
    return record("revisit", name, _date(page), fields, http)


def _members(label: str, archive_bytes: int):
    """Rows of ``records`` as gzip members, with the number of the task's archive that each goes to and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, archive, place, filled, held, out = TaskContext.get().partitionId(), 0, 0, 0, 0, []

        def name() -> str:
            return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{label}/{part}/{archive}/{place}"))

        def put(data: bytes) -> None:
            nonlocal place, filled, held
            packed = member(data)[:-1]  # the writer ends it with a zero byte
            out.append((archive, place, packed))
            place, filled, held = place + 1, filled + len(packed) + 1, held + len(packed)

        def flush() -> pa.RecordBatch:
            nonlocal held
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["archive", "place", "value"])
            out.clear()
            held = 0
            return done

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, html, _, digest, first, first_url = (c[k].as_py() for c in batch.columns)
                if place == 0:
                    put(record("warcinfo", name(), _date(0), [("Content-Type", "application/warc-fields")], b"software: gneiss\r\nformat: WARC File Format 1.1\r\n"))
                put(_capture_record(name(), page, url, html.encode(), digest, first, first_url))
                if held > HELD_BYTES:
                    yield flush()
                if filled >= archive_bytes:
                    archive, place, filled = archive + 1, 0, 0
        if out:
            yield flush()

    return run


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = 64 << 20) -> None:
    """Writes all pages as WARC archives of ``archive_bytes`` bytes, and the rest of a record, at most; records that share a digest stand together."""
    rows = records(pages, least_bytes).mapInArrow(_members(path, archive_bytes), "archive int, place long, value binary")
    rows = rows.sortWithinPartitions("archive", "place").select("archive", F.col("value").cast("string").alias("value"))
    rows.write.partitionBy("archive").option("lineSep", "\0").text(path)


def members_of(blob: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of each gzip member, in small steps, so that a long archive isn't copied for each."""
    at, view = 0, memoryview(blob)
    while at < len(blob):
        z, end, parts = zlib.decompressobj(31), at, []
        while not z.eof:
            if end >= len(blob):
                raise ValueError(f"the gzip member at byte {at} is cut off")
            step = view[end : end + STEP]
            parts.append(z.decompress(step))
            end += len(step)
        end -= len(z.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split(CRLF)
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields.get("Content-Length", -1))
    if not first.startswith("WARC/") or size < 0 or rest[size:] != b"\r\n\r\n":
        raise ValueError("no WARC record")
    return fields, rest[:size]


def _page(name: str | None) -> int | None:
    return None if name in (None, "none") else int(name)


def capture(data: bytes) -> tuple | None:
    """(url_key, timestamp, page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of a record, None for other kinds."""
    from base64 import b32encode
    from hashlib import sha1

    head, block = parse(data)
    kind = head["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\nContent-Length: *([0-9]+)", http)[1])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or b32encode(sha1(payload).digest()).decode() != digest):
        raise ValueError("the payload is damaged")
    stamp = datetime.fromisoformat(head["WARC-Date"]).astimezone(UTC).strftime("%Y%m%d%H%M%S")
    url = head["WARC-Target-URI"]
    return url_key(url), stamp, _page(head["X-Page-ID"]), url, kind, size, digest, _page(head.get("X-Refers-To-Page")), payload


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each archive's captures, sorted."""
    for batch in batches:
        for path, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            archive, captures = "/".join(path.rsplit("/", 2)[-2:]), []
            for at, length, data in members_of(blob.as_py()):
                if not data:
                    continue
                try:
                    found = capture(data)
                except (ValueError, KeyError, TypeError) as e:
                    raise ValueError(f"{path}: the record at byte {at} can't be read: {e}") from e
                if found:
                    captures.append((*found[:-1], archive, at, length, found[-1]))
            captures.sort(key=order)
            yield from _batches(captures, _NAMES, _KINDS)


def order(x: tuple) -> tuple:
    """URL key, timestamp, then id; captures without an id come first."""
    return x[0], x[1], x[2] is not None, x[2] or 0


def _batches(rows: list[tuple], names: list[str], kinds: list, most: int = 1000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), most):
        columns = list(zip(*rows[k : k + most], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


class LoserTree:
    """Merges k sorted iterators: an inner node holds the loser of its match, so the next winner takes log k comparisons."""

    def __init__(self, runs: list[Iterator[tuple]], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.heads: list = [next(r, None) for r in runs] or [None]
        self.keys: list = [None if h is None else key(h) for h in self.heads]
        self.losers = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None or (self.keys[b] is None and a < b)
        return self.keys[a] < self.keys[b] or (self.keys[a] == self.keys[b] and a < b)

    def __iter__(self) -> Iterator[tuple]:
        while self.keys[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self.keys[w] = None if self.heads[w] is None else self.key(self.heads[w])
            node = (w + self.k) // 2
            while node:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key range: the pieces of all runs, each ascending as it arrives, merged by the loser tree."""
    names, kinds, pieces, last = None, None, [], None
    for batch in batches:
        names, kinds = batch.schema.names, batch.schema.types
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            now = order(row)
            if last is None or row[names.index("archive")] != pieces[-1][-1][names.index("archive")] or now < last:
                pieces.append([])
            pieces[-1].append(row)
            last = now
    if names:
        merged, part = iter(LoserTree([iter(p) for p in pieces], order)), []
        for row in merged:
            part.append(row)
            if len(part) == 1000:
                yield from _batches(part, names, kinds)
                part = []
        yield from _batches(part, names, kinds)


def read_archives(spark, path: str) -> DataFrame:
    """All captures of the archives under ``path``, payloads included (none for revisits), each archive's sorted.

    offset and length are those of the capture's gzip member in the archive.
    """
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return blobs.select("path", "content").mapInArrow(_runs, _CAPTURE)


def merged_index(runs: DataFrame, captures_per_range: int = 50_000) -> DataFrame:
    """The captures' index in global order of (url_key, timestamp, page_id): runs merged range by range.

    Ranges are cut by quantiles of the whole order, page_id included, so that one URL or host with a
    third of all captures is spread over ranges too. A range is what a task holds.
    """
    index = materialize(runs.drop("payload"), "runs")
    ranges = max(1, -(-index.count() // captures_per_range))
    schema = index.schema
    return index.repartitionByRange(ranges, "url_key", "timestamp", "page_id").mapInArrow(_merge, schema)


def capture_histories(pages: DataFrame, least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives in the shared folder, reads them back and returns the merged index.

    One row per input row. A null html is empty; null URLs are empty; a null page_id stays null and its
    page revisits the smallest id with its payload, if there is one; repeated rows are captures of
    their own; extra columns are ignored; an empty table gives an empty index. The archives are deleted
    unless ``path`` names the folder for them.
    """
    spark = pages.sparkSession
    kept = path or new_path(spark, "warc")
    try:
        write_archives(pages, kept, least_bytes)
        return merged_index(read_archives(spark, kept))
    finally:
        if path is None:
            delete_path(spark, kept)
