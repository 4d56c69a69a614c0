"""Queries over images: documents packed into archives, filesystems and streams on executors, then scanned, walked and digested.

Whole tables go in; the SQL says what must come out again. Each row's file goes into one image of ``PER_IMAGE`` rows
at most, so an image stays a bounded row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.formats import builders, codecs
from gneiss.formats.builders import File
from gneiss.operators import analyze, diff, discovery, extraction, graph, lineage, reports, rules, sinks
from gneiss.plans.registry import _t, query

PER_IMAGE = 16

_IMAGE = "node_id string, format string, content binary"
_BODY = "coalesce(text, '')"


def files_of(rows: pd.DataFrame) -> list[File]:
    """Each document as a file in one of three folders, its attributes by its number."""
    return [
        File(f"s{d % 3}/d{d}.txt", (t or "").encode(), 384 + d % 64, d % 1000, d % 200, 1_600_000_000 + d)
        for d, t in sorted(zip(rows["doc_id"].tolist(), rows["text"].tolist(), strict=True), key=lambda x: x[0])
    ]


def packed(spark, d, format_: str, build: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """One image per PER_IMAGE documents: (node_id, format, content)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(f"i{key[0]}", format_, build(rows))], columns=["node_id", "format", "content"])

    docs = _t(spark, d, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / PER_IMAGE).cast("long").alias("image"))
    return docs.groupBy("image").applyInPandas(run, _IMAGE)


def each(spark, d, build: Callable[[int, bytes], Iterator[tuple[str, str, bytes]]]) -> DataFrame:
    """Images of single documents: (node_id, format, content) as often as ``build`` gives.

    Building takes far longer than reading, and a table may lie in few row groups, so rows are dealt over all cores first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = list(build(batch.column(0)[k].as_py(), (batch.column(1)[k].as_py() or "").encode()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], ["node_id", "format", "content"])

    docs = _t(spark, d, "documents").select("doc_id", "text")
    tasks = max(docs.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism)
    return docs.repartition(tasks, "doc_id").mapInArrow(run, _IMAGE)




def _doc() -> Column:
    """The document that a file's name tells."""
    return F.regexp_extract("path", r"d([0-9]+)[^/]*$", 1).cast("long").alias("doc_id")


_ATTRIBUTES = {"mode": "384 + doc_id % 64", "uid": "doc_id % 1000", "gid": "doc_id % 200", "mtime": "1600000000 + doc_id"}


def _reads(name: str, format_: str, kind: str, carried: tuple[str, ...], flat: str = "") -> None:
    """Registers read_<name>: all documents through an image and back."""
    path = "'s' || doc_id % 3 || '/d' || doc_id || '.txt'"
    more = "".join(f", ({_ATTRIBUTES[c]})::BIGINT AS {c}" for c in carried)
    sql = f"SELECT doc_id, {f"replace({path}, '/', '{flat}')" if flat else path} AS path, strlen({_BODY})::BIGINT AS size, sha256({_BODY}) AS sha256{more} FROM documents"

    def run(spark, d):
        entries = extraction.walk(packed(spark, d, kind, lambda rows: builders.REGISTRY[format_](files_of(rows))))
        live = entries.where("kind = 'regular' AND NOT deleted AND NOT superseded")
        return live.select(_doc(), "path", "size", F.sha2("content", 256).alias("sha256"), *carried)

    run.__name__ = f"read_{name}"
    query(sql)(run)


_ALL = ("mode", "uid", "gid", "mtime")
for _name, _format, _kind, _carried, _flat in (
    ("tar", "tar", "tar", _ALL, ""), ("cpio", "cpio", "cpio", _ALL, ""), ("cpio_odc", "cpio-odc", "cpio", _ALL, ""), ("ar", "ar", "ar", _ALL, ""), ("zip", "zip", "zip", ("mode",), ""),
    ("fit", "fit", "fit", (), "_"), ("romfs", "romfs", "romfs", (), ""), ("cramfs", "cramfs", "cramfs", ("mode", "uid", "gid"), ""), ("fat", "fat12", "fat", (), ""), ("fat32", "fat32", "fat", (), ""),
    ("jffs2", "jffs2", "jffs2", _ALL, ""), ("ext2", "ext2", "ext2", _ALL, ""), ("ext4", "ext4", "ext4", _ALL, ""), ("ubifs", "ubifs", "ubifs", _ALL, ""), ("yaffs2", "yaffs2", "yaffs2", _ALL, ""),
    ("qnx6", "qnx6", "qnx6", _ALL, ""), ("7z", "7z", "7z", ("mode", "mtime"), ""),
):
    _reads(_name, _format, _kind, _carried, _flat)


# --- blobs without names: each says its document and length ---------------------------------------


def _labelled(rows: pd.DataFrame) -> list[File]:
    return [File(f"p{k}", b"%d:%d:" % (d, len(t)) + t) for k, (d, t) in enumerate((d, (t or "").encode()) for d, t in zip(rows["doc_id"].tolist(), rows["text"].tolist(), strict=True))]


def _unlabelled(entries: DataFrame) -> DataFrame:
    """(doc_id, size, sha256) of blobs that begin with their document and length, whatever pads them."""
    head = F.split(F.substring("content", 1, 40).cast("string"), ":")
    rows = entries.where("kind = 'regular' AND NOT superseded AND content IS NOT NULL").select("*", head[0].alias("d"), head[1].alias("n"))
    rows = rows.select(F.col("d").cast("long").alias("doc_id"), F.expr("substring(content, length(d) + length(n) + 3, int(n))").alias("body"))
    return rows.select("doc_id", F.octet_length("body").cast("long").alias("size"), F.sha2("body", 256).alias("sha256"))


_WHOLE = f"SELECT doc_id, strlen({_BODY})::BIGINT AS size, sha256({_BODY}) AS sha256 FROM documents"


@query(_WHOLE)
def read_ubi(spark, d):
    return _unlabelled(extraction.walk(packed(spark, d, "ubi", lambda rows: builders.ubi([f.body for f in _labelled(rows)]))))


@query(_WHOLE)
def read_android_super(spark, d):
    return _unlabelled(extraction.walk(packed(spark, d, "android-super", lambda rows: builders.REGISTRY["android-super"](_labelled(rows)))))


@query(_WHOLE)
def read_android_sparse(spark, d):
    return _unlabelled(extraction.walk(each(spark, d, lambda k, t: [(str(k), "android-sparse", builders.android_sparse(b"%d:%d:" % (k, len(t)) + t + bytes(9000) + b"abcd" * 2048))])))


@query(_WHOLE)
def read_uimage_multi(spark, d):
    return _unlabelled(extraction.walk(packed(spark, d, "uimage", lambda rows: builders.uimage_multi(_labelled(rows)))))


_PARTS = f"""SELECT doc_id, v.form, v.part, strlen({_BODY})::BIGINT AS size, sha256({_BODY}) AS sha256 FROM documents,
(VALUES ('uimage', 'payload'), ('android-boot', 'kernel'), ('android-boot-3', 'ramdisk'), ('android-vendor-boot', 'vendor_ramdisk')) v(form, part) WHERE strlen({_BODY}) > 0 OR v.form = 'uimage'"""


@query(_PARTS)
def read_boot_images(spark, d):
    """Boot images of both layouts, vendor images, and compressed images, with the document as one of their parts."""

    def build(k: int, text: bytes):
        yield f"{k}/uimage", "uimage", builders.uimage(builders.STREAMS["gzip"](text), codec=1)
        yield f"{k}/android-boot", "android-boot", builders.android_boot(text, b"ramdisk", b"second")
        yield f"{k}/android-boot-3", "android-boot", builders.android_boot_3(b"kernel", text)
        yield f"{k}/android-vendor-boot", "android-vendor-boot", builders.android_vendor_boot(text, b"dtb")

    entries = extraction.walk(each(spark, d, build))
    form = F.substring_index("node_id", "/", -1)
    part = F.element_at(F.create_map(*(F.lit(x) for x in ("uimage", "payload", "android-boot", "kernel", "android-boot-3", "ramdisk", "android-vendor-boot", "vendor_ramdisk"))), form)
    return entries.where(F.col("path") == part).select(F.substring_index("node_id", "/", 1).cast("long").alias("doc_id"), form.alias("form"), F.col("path").alias("part"), "size", F.sha2("content", 256).alias("sha256"))


_CODECS = ", ".join(f"('{k}')" for k in builders.STREAMS)


@query(f"""SELECT doc_id, v.codec, strlen({_BODY})::BIGINT AS size, sha256({_BODY}) AS sha256, true AS ends_right, true AS found_right
FROM documents, (VALUES {_CODECS}) v(codec)""")
def read_streams(spark, d):
    """Every document under every codec, with other bytes after its end: payload, and whether the end was found."""

    def build(k: int, text: bytes):
        for codec, press in builders.STREAMS.items():
            raw = press(text)
            yield f"{k}/{codec}/{len(raw)}", codec, raw + b"tail of other bytes"

    entries = extraction.walk(each(spark, d, build)).where("path = 'payload'")
    parts = F.split("node_id", "/")
    return entries.select(
        parts[0].cast("long").alias("doc_id"), parts[1].alias("codec"), "size", F.sha2("content", 256).alias("sha256"),
        (F.col("extra")["consumed"] == parts[2]).alias("ends_right"), (F.size("diagnostics") == 0).alias("found_right"),
    )


@query(f"""SELECT doc_id, v.codec, strlen({_BODY}) > 0 OR v.codec IN ('gzip', 'lz4', 'zstd', 'xz', 'bzip2', 'lzma') AS refused FROM documents, (VALUES {_CODECS}) v(codec)""")
def damaged_streams(spark, d):
    """Streams without their last bytes end in a diagnostic, whatever the codec; no task fails."""

    def build(k: int, text: bytes):
        for codec, press in builders.STREAMS.items():
            yield f"{k}/{codec}", codec, press(text)[:-5]

    entries = extraction.walk(each(spark, d, build))
    parts = F.split("node_id", "/")
    return entries.select(parts[0].cast("long").alias("doc_id"), parts[1].alias("codec"), (F.size("diagnostics") > 0).alias("refused"))


@query(f"""WITH x AS (SELECT doc_id, strlen({_BODY}) AS n FROM documents), l AS (SELECT doc_id, n, v.kind FROM x, (VALUES ('fits'), ('bomb'), ('short')) v(kind))
SELECT doc_id, kind, CASE kind WHEN 'fits' THEN true WHEN 'short' THEN n = 0 ELSE false END AS passes FROM l""")
def codec_limits(spark, d):
    """A stream may grow to its limit and no further: payloads that fit, whole megabytes of one byte, and limits one byte short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passes(data: bytes, most: int) -> bool:
            try:
                return len(codecs.decompress("gzip", data, most)) <= most
            except codecs.CodecError:
                return False

        bomb = builders.STREAMS["gzip"](bytes(2 << 20))
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw, n = builders.STREAMS["gzip"]((t or "").encode()), len((t or "").encode())
                rows += [(k, "fits", passes(raw, n)), (k, "bomb", passes(bomb, len(bomb) * 100)), (k, "short", passes(raw, max(n - 1, 0)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.bool_()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.bool_())], ["doc_id", "kind", "passes"])

    return _t(spark, d, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, kind string, passes boolean")


_SQUASHED = ("gzip", "lzma", "lzo", "xz", "lz4", "zstd")


@query(f"""SELECT doc_id, codec, 's' || doc_id % 3 || '/d' || doc_id || '.txt' AS path, strlen({_BODY})::BIGINT AS size, sha256({_BODY}) AS sha256, (384 + doc_id % 64)::BIGINT AS mode, (doc_id % 1000)::BIGINT AS uid, (doc_id % 200)::BIGINT AS gid, (1600000000 + doc_id)::BIGINT AS mtime
FROM (SELECT *, {_SQUASHED!r}[(doc_id // {PER_IMAGE}) % 6 + 1] AS codec FROM documents)""".replace(repr(_SQUASHED), f"({list(_SQUASHED)!r})"))
def read_squashfs(spark, d):
    """SquashFS images of every codec, in turn."""
    turn = lambda rows: _SQUASHED[int(rows["doc_id"].min()) // PER_IMAGE % 6]
    entries = extraction.walk(packed(spark, d, "squashfs", lambda rows: builders.squashfs(files_of(rows), turn(rows))))
    codec = F.element_at(F.array(*map(F.lit, _SQUASHED)), (F.substring("node_id", 2, 20).cast("int") % 6 + 1).cast("int"))
    return entries.where("kind = 'regular'").select(_doc(), codec.alias("codec"), "path", "size", F.sha2("content", 256).alias("sha256"), "mode", "uid", "gid", "mtime")


_IFS = ("none", "zlib", "lzo", "ucl", "lz4")


@query(f"SELECT doc_id, 'proc/boot/s' || doc_id % 3 || '/d' || doc_id || '.txt' AS path, strlen({_BODY})::BIGINT AS size, sha256({_BODY}) AS sha256, (384 + doc_id % 64)::BIGINT AS mode, (1600000000 + doc_id)::BIGINT AS mtime FROM documents")
def read_qnx_ifs(spark, d):
    """Boot images of every packing, in turn."""
    turn = lambda rows: _IFS[int(rows["doc_id"].min()) // PER_IMAGE % 5]
    entries = extraction.walk(packed(spark, d, "qnx-ifs", lambda rows: builders.qnx_ifs(files_of(rows), turn(rows))))
    return entries.where("kind = 'regular'").select(_doc(), "path", "size", F.sha2("content", 256).alias("sha256"), "mode", "mtime")


@query(f"SELECT doc_id, strlen({_BODY})::BIGINT AS size, sha256({_BODY}) AS sha256, (384 + doc_id % 64)::BIGINT AS mode, (1600000000 + doc_id)::BIGINT AS mtime FROM documents")
def read_lzop(spark, d):
    """Several members in one file, each with its own name."""
    entries = extraction.walk(packed(spark, d, "lzop", lambda rows: builders.lzop(files_of(rows))))
    doc = F.regexp_extract(F.col("extra")["name"], r"d([0-9]+)", 1).cast("long")
    return entries.select(doc.alias("doc_id"), "size", F.sha2("content", 256).alias("sha256"), "mode", "mtime")


@query(f"SELECT doc_id, v.codec, sha256({_BODY}) AS sha256 FROM documents, (VALUES ('lzo1x'), ('ucl'), ('lz4'), ('deflate'), ('zlib')) v(codec) WHERE strlen({_BODY}) > 0 OR v.codec <> 'lzo1x'")
def raw_blocks(spark, d):
    """Blocks without a header, as filesystems hold them, there and back."""
    import zlib

    from gneiss.formats import lzo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (t or "").encode()
                z = zlib.compressobj(6, zlib.DEFLATED, -15)
                made = {"ucl": lzo.nrv2b(builders.nrv2b(raw), len(raw)), "lz4": codecs.lz4_block(builders.lz4_block(raw), len(raw)), "deflate": codecs.exact("deflate", z.compress(raw) + z.flush(), len(raw)), "zlib": codecs.exact("zlib", zlib.compress(raw), len(raw))}
                if raw:
                    made["lzo1x"] = lzo.lzo1x(builders.lzo1x(raw), len(raw))
                rows += [(k, codec, body) for codec, body in made.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary()))], ["doc_id", "codec", "body"])

    made = _t(spark, d, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, codec string, body binary")
    return made.select("doc_id", "codec", F.sha2("body", 256).alias("sha256"))


# --- history --------------------------------------------------------------------------------------


@query(f"""WITH x AS (SELECT doc_id, strlen({_BODY}) AS n, sha256({_BODY}) AS sha256 FROM documents)
SELECT doc_id, doc_id % 5 = 0 AS deleted, n::BIGINT AS size, sha256,
 (CASE WHEN n = 0 THEN 0 ELSE greatest(1, ceil((n // 2) / 4096)) + ceil(n / 4096) - 1 END)::BIGINT AS older FROM x""")
def jffs2_history(spark, d):
    """Three states of a log: half of each text, all of it, and every fifth file unlinked. The last state of each file, and how many older ones stand there."""

    def build(rows: pd.DataFrame) -> bytes:
        whole = files_of(rows)
        half = [File(f.name, f.body[: len(f.body) // 2], f.mode, f.uid, f.gid, f.mtime) for f in whole]
        return builders.jffs2_log([half, whole, [f for f in whole if int(f.name[4:-4]) % 5]])

    entries = extraction.walk(packed(spark, d, "jffs2", build)).where("kind = 'regular'")
    last = F.struct("superseded", F.struct("deleted", "size", F.sha2("content", 256).alias("sha256")).alias("x"))
    found = entries.groupBy(_doc()).agg(F.min(last).alias("last"), F.count_if("superseded").alias("older"))
    return found.select("doc_id", "last.x.deleted", "last.x.size", "last.x.sha256", "older")


_STATES = f"""WITH x AS (SELECT doc_id, strlen({_BODY}) AS n, {_BODY} AS t FROM documents)
SELECT doc_id, doc_id % 5 = 0 AS deleted, n::BIGINT AS size, sha256(t) AS sha256, (CASE WHEN n = 0 THEN 0 ELSE 1 END)::BIGINT AS older FROM x"""


def _states(rows: pd.DataFrame) -> list[list[File]]:
    """Half of each file, all of it, and every fifth one unlinked."""
    whole = files_of(rows)
    half = [File(f.name, f.body[: len(f.body) // 2], f.mode, f.uid, f.gid, f.mtime) for f in whole]
    return [half, whole, [f for f in whole if int(f.name[4:-4]) % 5]]


def _history(entries: DataFrame) -> DataFrame:
    last = F.struct("superseded", F.struct("deleted", "size", F.sha2("content", 256).alias("sha256")).alias("x"))
    found = entries.where("kind = 'regular'").groupBy(_doc()).agg(F.min(last).alias("last"), F.count_if("superseded").alias("older"))
    return found.select("doc_id", "last.x.deleted", "last.x.size", "last.x.sha256", "older")


@query(_STATES)
def ubifs_history(spark, d):
    """The first state in the index, the others in the journal: the last state of each file, deleted ones too, and the one before it."""
    return _history(extraction.walk(packed(spark, d, "ubifs", lambda rows: builders.ubifs(_states(rows)))))


@query(_STATES)
def yaffs2_history(spark, d):
    return _history(extraction.walk(packed(spark, d, "yaffs2", lambda rows: builders.yaffs2(_states(rows)))))


@query(f"""WITH x AS (SELECT doc_id, {_BODY} AS t, strlen({_BODY}) AS n FROM documents)
SELECT doc_id, doc_id % 5 = 0 AS deleted, (CASE WHEN doc_id % 5 = 0 THEN n // 2 ELSE n END)::BIGINT AS size, (CASE WHEN doc_id % 5 > 0 AND n > 0 THEN 1 ELSE 0 END)::BIGINT AS older FROM x""")
def qnx6_snapshots(spark, d):
    """The snapshot before the current one holds half of each file, and those that have gone since."""

    def build(rows: pd.DataFrame) -> bytes:
        half, _, less = _states(rows)
        return builders.qnx6(half, less)

    return _history(extraction.walk(packed(spark, d, "qnx6", build))).select("doc_id", "deleted", "size", "older")


@query(f"SELECT doc_id, doc_id % 4 = 1 AS deleted, strlen({_BODY})::BIGINT AS size, sha256({_BODY}) AS sha256 FROM documents")
def fat_deleted(spark, d):
    """Every fourth file is deleted before the image is read; its bytes still lie in one piece."""

    def build(rows: pd.DataFrame) -> bytes:
        own = files_of(rows)
        return builders.fat(own, 32, frozenset(f.name for f in own if int(f.name[4:-4]) % 4 == 1))

    entries = extraction.walk(packed(spark, d, "fat", build)).where("kind = 'regular'")
    return entries.select(_doc(), "deleted", "size", F.sha2("content", 256).alias("sha256"))


# --- nesting, sinks -------------------------------------------------------------------------------


@query(f"""SELECT doc_id, v.level::INTEGER AS level, CASE v.level WHEN 0 THEN 'd' || doc_id || '.cpio.gz' WHEN 1 THEN 'payload' ELSE 's' || doc_id % 3 || '/d' || doc_id || '.txt' END AS path,
CASE WHEN v.level = 2 THEN sha256({_BODY}) END AS sha256 FROM documents, (VALUES (0), (1), (2)) v(level)""")
def descend_archives(spark, d):
    """A tar of gzipped cpio archives, opened level by level."""

    def build(rows: pd.DataFrame) -> bytes:
        inner = [(f, builders.STREAMS["gzip"](builders.cpio([f]))) for f in files_of(rows)]
        return builders.tar([File(f"{f.name[3:-4]}.cpio.gz", raw) for f, raw in inner])

    found = extraction.descend(packed(spark, d, "tar", build), extraction.format_of, 4)
    doc = F.regexp_extract(F.concat_ws("/", "node_id", "path"), r"/d([0-9]+)\.cpio", 1).cast("long")
    return found.select(doc.alias("doc_id"), "level", "path", F.when(F.col("level") == 2, F.sha2("content", 256)).alias("sha256"))


@query(f"""WITH x AS (SELECT doc_id, doc_id // {PER_IMAGE} AS image, strlen({_BODY}) AS n, {_BODY} AS t FROM documents),
o AS (SELECT *, row_number() OVER w AS files, sum(least(n, 1500)) OVER w AS total FROM x WINDOW w AS (PARTITION BY image ORDER BY doc_id))
SELECT doc_id, files <= 12 AND total <= 9000 AS written, n > 1500 AS truncated, least(n, 1500)::BIGINT AS bytes FROM o""")
def sink_limits(spark, d):
    """Limits in the order of emission: 12 files, 9000 bytes in all, 1500 a file; what is over stays listed."""
    entries = extraction.walk(packed(spark, d, "tar", lambda rows: builders.tar(files_of(rows))))
    return extraction.limited(entries, 12, 9000, 1500).select(_doc(), "written", "truncated", F.octet_length("content").cast("long").alias("bytes"))


@query(f"""WITH x AS (SELECT doc_id, doc_id // {PER_IMAGE} AS image, 'same' || doc_id % 3 AS path FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY image, path ORDER BY doc_id) - 1 AS k FROM x)
SELECT doc_id, CASE WHEN k = 0 THEN path ELSE path || '~' || k END AS path FROM o""")
def duplicate_paths(spark, d):
    """Entries that share a path in an archive get suffixes in order."""

    def build(rows: pd.DataFrame) -> bytes:
        return builders.tar([File(f"same{int(f.name[4:-4]) % 3}", f.name[4:-4].encode()) for f in files_of(rows)])

    entries = extraction.unique_paths(extraction.walk(packed(spark, d, "tar", build)))
    return entries.select(F.col("content").cast("string").cast("long").alias("doc_id"), "path")


# --- scans ----------------------------------------------------------------------------------------

#: Where the image begins in a scanned blob, and the zeros behind it.
PAD, TAIL = 8192, 32768


def _up(n: str, to: int) -> str:
    return f"(ceil(({n}) / {to}) * {to})"


def _squashfs_super(t: bytes) -> bytes:
    import struct

    return b"hsqs" + struct.pack("<IIIIHHHHHHQQ", 1, 0, 131072, 0, 1, 17, 0, 0, 4, 0, 0, 96 + len(t)) + bytes(48) + t


def _ubi_super(t: bytes) -> bytes:
    import struct

    from gneiss.formats.validators import crc_ubi

    body = struct.pack("<QIBBH", 1, 4096, 6, 0, 0) + struct.pack("<II", 0, 0) + struct.pack("<III", 8, 4096, 1 + len(t) % 5)
    body = body.ljust(4088, b"\0")
    return struct.pack("<II", 0x06101831, crc_ubi(body)) + body


#: (group, format, image of a text, category, confidence, the size in SQL of a text of n bytes, or null where it isn't told)
SCANNED: list[tuple[str, str, Callable[[bytes], bytes], int, str | None]] = [
    ("filesystems", "squashfs", _squashfs_super, 85, _up("96 + n", 4096)),
    ("filesystems", "jffs2", lambda t: builders.jffs2_node(0x2003, t), 99, _up("12 + n", 4)),
    ("filesystems", "ubifs", _ubi_super, 99, "4096 * (1 + n % 5)"),
    ("filesystems", "cramfs", lambda t: builders.cramfs([File("a", t[:10])]), 99, "4096"),
    ("filesystems", "romfs", lambda t: builders.romfs([File("a", t)]), 99, _up("64 + " + _up("n", 16), 1024)),
    ("filesystems", "fat", lambda t: builders.fat([File("a", t)], 16), 85, None),
    ("filesystems", "ext2", lambda t: builders.ext2([File("a", t[:10])]), 85, None),
    ("filesystems", "ext4", lambda t: builders.ext4([File("a", t[:10])]), 85, None),
    ("filesystems", "qnx6", lambda t: builders.qnx6([File("a", t)], [File("a", t)]), 99, None),
    ("filesystems", "qnx-ifs", lambda t: builders.qnx_ifs([File("a", t)], "none"), 99, "512 + 100 + 28 + 36 + 4 + " + _up("n", 4) + " + 4"),
    ("filesystems", "yaffs2", lambda t: builders.yaffs2([[File("d/a", t), File("d/b", b""), File("d/c", b"")]]), 99, "2112 * (4 + ceil(n / 2048))"),
    ("containers", "ubi", lambda t: builders.ubi([t, b"x"]), 99, "16384 * (1 + greatest(1, ceil(n / 16256)))"),
    ("containers", "ar", lambda t: builders.ar([File("a", t), File("b", b"")]), 99, "8 + 120 + " + _up("n", 2)),
    ("containers", "cpio", lambda t: builders.cpio([File("a", t)]), 85, "112 + " + _up("n", 4) + " + 124"),
    ("containers", "tar", lambda t: builders.tar([File("a", t)]), 99, "512 + " + _up("n", 512) + " + 1024"),
    ("containers", "zip", lambda t: builders.zip_([File("a", t)], 0), 85, "30 + 1 + n + 46 + 1 + 22"),
    ("containers", "7z", lambda t: builders.sevenzip([File("a", t)]), 85, None),
    ("containers", "uimage", lambda t: builders.uimage(t), 99, "64 + n"),
    ("containers", "fit", lambda t: builders.fit([File("a", t)]), 99, None),
    ("containers", "android-boot", lambda t: builders.android_boot(t, b""), 85, "2048 + " + _up("n", 2048)),
    ("containers", "android-vendor-boot", lambda t: builders.android_vendor_boot(t, b""), 85, "4096 + " + _up("n", 2048)),
    ("containers", "android-sparse", lambda t: builders.android_sparse(bytes(4096) + t), 85, None),
    ("containers", "android-super", lambda t: builders.REGISTRY["android-super"]([File("a", t)]), 99, "0"),
    ("tables", "mbr", lambda t: builders.mbr([(0x83, 1 + len(t), 7)]), 85, "512"),
    ("tables", "gpt", lambda t: builders.gpt([("a", 64, 64 + len(t))]), 99, "1024 + 16384"),
    ("streams", "gzip", builders.STREAMS["gzip"], 85, None), ("streams", "xz", builders.STREAMS["xz"], 85, None), ("streams", "lzma", builders.STREAMS["lzma"], 85, None),
    ("streams", "bzip2", builders.STREAMS["bzip2"], 85, None), ("streams", "lz4", builders.STREAMS["lz4"], 85, None), ("streams", "zstd", builders.STREAMS["zstd"], 85, None),
    ("headers", "elf", lambda t: builders.elf32(t), 85, "52 + n + 17 + 120"),
    ("headers", "luks", lambda t: builders.luks1(1 + len(t) % 50) if len(t) % 2 else builders.luks2(4096 + len(t)), 85, "CASE WHEN n % 2 = 1 THEN 512 * (1 + n % 50) ELSE 4096 + n END"),
    ("headers", "dm-verity", lambda t: builders.verity(1 + len(t) % 128), 85, "CASE WHEN n % 128 = 0 THEN 4096 ELSE 8192 END"),
    ("headers", "dtb", lambda t: builders.fdt(("", {"model": t.replace(b"\0", b"") + b"\0"}, [])), 85, None),
    ("headers", "lzop", lambda t: builders.lzop([File("a", t)]), 85, None),
]


def _scans(group: str) -> None:
    """Registers scan_<group>: each document as an image of one of the group's formats, in turn, found again at its place."""
    own = [x[1:] for x in SCANNED if x[0] == group]
    cases = " ".join(f"WHEN {k} THEN struct_pack(f := '{f}', c := {c}, s := {f'({s})::BIGINT' if s else 'NULL::BIGINT'})" for k, (f, _, c, s) in enumerate(own))
    sql = f"""SELECT doc_id, x.f AS format, {PAD}::BIGINT AS "offset", x.c::INTEGER AS confidence, x.s AS size FROM (
    SELECT doc_id, CASE doc_id % {len(own)} {cases} END AS x FROM (SELECT doc_id, strlen({_BODY}) AS n FROM documents))"""

    def build(k: int, text: bytes):
        image = own[k % len(own)][1](text)
        yield str(k), own[k % len(own)][0], bytes(PAD) + image + bytes(TAIL)

    def run(spark, d):
        blobs = each(spark, d, build).select(F.col("node_id").alias("source_id"), "content")
        wanted = F.element_at(F.array(*(F.lit(x[0]) for x in own)), (F.pmod(F.col("image_id").cast("long"), F.lit(len(own))) + 1).cast("int"))
        told = F.element_at(F.array(*(F.lit(x[3] is not None) for x in own)), (F.pmod(F.col("image_id").cast("long"), F.lit(len(own))) + 1).cast("int"))
        found = discovery.scan(blobs).where((F.col("format") == wanted) & (F.col("offset") == PAD) & F.col("owner").isNull())
        return found.select(F.col("image_id").cast("long").alias("doc_id"), "format", "offset", "confidence", F.when(told, F.col("size")).alias("size"))

    run.__name__ = f"scan_{group}"
    query(sql)(run)


for _group in ("filesystems", "containers", "tables", "streams", "headers"):
    _scans(_group)


@query("SELECT doc_id, 'qnx6' AS format, 512::BIGINT AS \"offset\", 99::INTEGER AS confidence FROM documents")
def rescan_partitions(spark, d):
    """A filesystem whose magic must be aligned lies in a partition that is not: only a search of the partition's own span finds it."""
    blobs = each(spark, d, lambda k, t: [(str(k), "raw", b"table".ljust(512, b"\1") + builders.qnx6([File("a", t)], [File("a", t)]))]).select(F.col("node_id").alias("image_id"), "content")
    parts = blobs.select("image_id", F.lit(512).cast("long").alias("start"), (F.octet_length("content") - 512).cast("long").alias("length"), F.lit(b"ab").alias("head"))
    first = discovery.scan(blobs.select(F.col("image_id").alias("source_id"), "content")).where("format = 'qnx6'")
    found = graph.rescan(blobs, parts, first).where("format = 'qnx6'")
    return found.select(F.col("image_id").cast("long").alias("doc_id"), "format", "offset", "confidence")


# --- views, sinks, cases --------------------------------------------------------------------------

_SWAPPED = "'U-Boot 2020.01 Linux version 5.4 ' || coalesce(text, '') || repeat(' ', ((4 - (strlen(coalesce(text, '')) + 33) % 4) % 4)::INT)"


@query(f"SELECT doc_id, ([0, 2, 4])[doc_id % 3 + 1]::INTEGER AS word_swap, sha256({_SWAPPED}) AS sha256 FROM documents")
def word_swap(spark, d):
    """Images stored as they are, and with their 16- or 32-bit words in reverse, in turn: detected, and put right."""
    from gneiss.functions.text import swap_words

    def build(k: int, text: bytes):
        raw = b"U-Boot 2020.01 Linux version 5.4 " + text
        raw += b" " * (-len(raw) % 4)
        yield str(k), "raw", swap_words(raw, (0, 2, 4)[k % 3]) if k % 3 else raw

    blobs = each(spark, d, build).select(F.col("node_id").alias("image_id"), "content")
    return sinks.corrected_copy(blobs).select(F.col("image_id").cast("long").alias("doc_id"), "word_swap", "sha256")


def _entries(spark, d) -> DataFrame:
    return extraction.walk(packed(spark, d, "cpio", lambda rows: builders.cpio(files_of(rows))))


@query(_WHOLE)
def tar_sink(spark, d):
    """Entries as parts of tar archives, put together by image and read again."""
    parts = sinks.tar_parts(_entries(spark, d))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], "tar", b"".join(rows.sort_values("entry_ord")["part"]))], columns=["node_id", "format", "content"])

    again = extraction.walk(parts.groupBy("node_id").applyInPandas(run, _IMAGE))
    return again.select(_doc(), "size", F.sha2("content", 256).alias("sha256"))


@query(f"SELECT doc_id, md5({_BODY}) AS md5, sha1({_BODY}) AS sha1, sha256({_BODY}) AS sha256, '| s' || doc_id % 3 || '/d' || doc_id || '.txt | ' || strlen({_BODY}) || ' | regular |' AS row FROM documents")
def listing_sink(spark, d):
    """A listing's digests, and its rows as a Markdown table shows them."""
    rows = sinks.listing(_entries(spark, d))
    return rows.select(_doc(), "md5", "sha1", "sha256", reports.md_row(F.col("path"), F.col("size"), F.col("kind")).alias("row"))


_QUOTED = "replace(replace(replace(replace(coalesce(text, ''), chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't')"


@query(f"SELECT doc_id, '- path: \"' || {_QUOTED} || '\"' || chr(10) || '  kind: \"regular\"' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '  deleted: \"true\"' || chr(10) ELSE '' END AS item FROM documents")
def listing_items(spark, d):
    """Items of a YAML listing; the path here is a whole text, so that there is something to escape."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("entry_ord"), F.lit("n").alias("node_id"), F.coalesce("text", F.lit("")).alias("path"), F.lit("regular").alias("kind"), (F.col("doc_id") % 2 == 0).alias("deleted"))
    return sinks.listing_yaml(docs).select(F.col("entry_ord").alias("doc_id"), "item")


@query(f"SELECT doc_id, 3::BIGINT AS \"offset\", greatest(strlen({_BODY}) - 5, 0)::BIGINT AS length, sha256(substr({_BODY}, 4, greatest(length({_BODY}) - 5, 0))) AS sha256 FROM documents WHERE strlen({_BODY}) = length({_BODY})")
def carve_pieces(spark, d):
    """Pieces cut from blobs by offset and length; of ASCII texts, where SQL can count bytes as characters."""
    docs = _t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") == F.length("text"))
    blobs = docs.select(F.col("doc_id").alias("image_id"), F.col("text").cast("binary").alias("content"))
    plan = docs.select(F.col("doc_id").alias("image_id"), F.lit("p").alias("id"), F.lit(3).cast("long").alias("offset"), F.greatest(F.octet_length("text") - 5, F.lit(0)).cast("long").alias("length"))
    return sinks.carve(blobs, plan).select(F.col("image_id").alias("doc_id"), "offset", "length", "sha256")


@query("SELECT true AS same, 0::BIGINT AS unreadable, (SELECT count(*) FROM orders)::BIGINT AS orders, (SELECT count(*) FROM documents)::BIGINT AS entries")
def case_round_trip(spark, d):
    """A case written and read back holds the same rows: entries with maps and bytes, and a table of numbers and dates."""
    tables = {"entries": _entries(spark, d), "orders": _t(spark, d, "orders")}
    at = lineage.folder(spark, "case")
    sinks.write_case(tables, at)
    read, said = sinks.read_case(spark, at)
    same = sinks.round_trips(tables, read)
    counts = read["orders"].agg(F.count("*").alias("orders")).join(read["entries"].agg(F.count("*").alias("entries")))
    return counts.select(F.lit(same).alias("same"), F.lit(len(said)).cast("long").alias("unreadable"), "orders", "entries")


@query("SELECT 'diff-case-empty' AS code, 'b' AS side WHERE (SELECT count(*) FROM customer WHERE c_acctbal > 1e12) = 0 AND (SELECT count(*) FROM customer) > 0")
def empty_cases(spark, d):
    c = _t(spark, d, "customer")
    return diff.empty_cases(c, c.where("c_acctbal > 1e12"))


_EMAIL = next(r.pattern for r in rules.builtin("pii") if r.id == "email")


# --- whole runs -----------------------------------------------------------------------------------

#: Documents of a flash image: with texts of some kilobytes, an image of some ten megabytes.
PER_FLASH = 4096


def flash(rows: pd.DataFrame) -> bytes:
    """An image with a partition table and three partitions, each a filesystem of a third of the documents, and erased space behind them."""
    own = files_of(rows)
    parts = [builders.squashfs(own[0::3], "gzip", 131072), builders.jffs2_log([own[1::3]]), builders.ext(own[2::3], True)]
    at, table, body = 2048, [], b""
    for name, part in zip(("system", "data", "vendor"), parts, strict=True):
        part += bytes(-len(part) % 4096)
        table.append((name, at, at + len(part) // 512 - 1))
        at, body = at + len(part) // 512, body + part
    return builders.gpt(table).ljust(2048 * 512, b"\xff") + body + b"\xff" * 65536


def flashes(spark, d) -> DataFrame:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(f"i{key[0]}", flash(rows))], columns=["image_id", "content"])

    docs = _t(spark, d, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / PER_FLASH).cast("long").alias("image"))
    return docs.groupBy("image").applyInPandas(run, "image_id string, content binary")


@query(f"""SELECT doc_id, 'i' || doc_id // {PER_FLASH} || '/gpt/p' || (row_number() OVER (PARTITION BY doc_id // {PER_FLASH} ORDER BY doc_id) - 1) % 3 || '-' || (['system', 'data', 'vendor'])[((row_number() OVER (PARTITION BY doc_id // {PER_FLASH} ORDER BY doc_id) - 1) % 3 + 1)::INT] AS node,
strlen({_BODY})::BIGINT AS size, sha256({_BODY}) AS sha256 FROM documents""")
def analyze_flash(spark, d):
    """A whole run over images of a partition table and three filesystems: every file is found at its place."""
    case = analyze.analyze(flashes(spark, d), analyze.Run(packs=None, survey=False, artifacts=False))
    files = case["entries"].where("kind = 'regular' AND NOT superseded AND node_id LIKE '%/gpt/p%'")
    return files.select(_doc(), F.col("node_id").alias("node"), "size", F.sha2("content", 256).alias("sha256"))


@query(f"""WITH x AS (SELECT doc_id, len(regexp_extract_all(text, '{_EMAIL}')) AS n FROM documents) SELECT doc_id, n::BIGINT AS n FROM x WHERE n > 0""")
def analyze_hits(spark, d):
    """The same run with a pack: hits in the files of all partitions."""
    case = analyze.analyze(flashes(spark, d), analyze.Run(packs=("pii",), survey=False, artifacts=False))
    own = case["hits"].where("rule = 'email' AND node LIKE '%/gpt/p%'")
    return own.groupBy(_doc()).agg(F.count("*").alias("n"))
