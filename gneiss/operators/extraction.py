"""Extraction: blobs become entries, entries are limited and named, nested images are opened level by level."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.formats import readers
from gneiss.operators.lineage import cut

ENTRIES = (
    "node_id string, entry_ord long, path string, kind string, mode long, uid long, gid long, size long, mtime long, inode long, link_target string, "
    "deleted boolean, superseded boolean, version long, extra map<string,string>, head binary, content binary, diagnostics array<string>"
)
HEAD = 256


def walk(blobs: DataFrame, with_content: bool = True) -> DataFrame:
    """Entries of blobs (node_id, format, content): one blob, many rows, in reader order."""
    names = [x.split()[0] for x in ENTRIES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.binary(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for n, e in enumerate(readers.read(kind, data or b"")):
                    path = e.path.encode("utf-8", "surrogateescape").decode("utf-8", "backslashreplace")
                    body = e.content
                    size = len(body) if body is not None else None
                    rows.append((node, n, path, e.kind, e.mode, e.uid, e.gid, size, e.mtime, e.inode, e.link_target, e.deleted, e.superseded, e.version, list(e.extra.items()), body[:HEAD] if body is not None else None, body if with_content else None, e.diagnostics))
                    if len(rows) >= 256:
                        yield _batch(rows, names, kinds)
                        rows = []
                yield _batch(rows, names, kinds)

    return blobs.select("node_id", "format", F.col("content").cast("binary")).mapInArrow(run, ENTRIES)


def readable() -> list[str]:
    """The formats that have a reader."""
    return sorted(readers.REGISTRY)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def limited(entries: DataFrame, files: int, total: int, each: int) -> DataFrame:
    """Sink limits in emission order: written says whether an entry fits the caps on files and bytes, truncated whether it was cut to ``each`` bytes; all stay listed."""
    size = F.least(F.coalesce("size", F.lit(0)), F.lit(each))
    order = W.partitionBy("node_id").orderBy("entry_ord")
    so_far = F.sum(size).over(order)
    regular = F.col("kind") == "regular"
    n = F.sum(regular.cast("int")).over(order)
    return entries.withColumns(
        {"written": regular & (n <= files) & (so_far <= total), "truncated": F.coalesce("size", F.lit(0)) > each, "content": F.substring("content", 1, each)}
    )


def unique_paths(entries: DataFrame) -> DataFrame:
    """Repeats of a path in a node get the suffix ~1, ~2, ... in order."""
    n = F.row_number().over(W.partitionBy("node_id", "path").orderBy("entry_ord")) - 1
    return entries.withColumn("path", F.when(n == 0, F.col("path")).otherwise(F.concat_ws("~", "path", n.cast("string"))))


def budget(limit: int, ratio: int, image_bytes: int, free: int | None = None) -> int:
    """The larger of a limit and a multiple of the image's size; ratio 0 means the limit as it is; free disk bounds both."""
    most = max(limit, ratio * image_bytes) if ratio else limit
    return most if free is None else min(most, free)


def descend(blobs: DataFrame, identify, depth: int = 8) -> DataFrame:
    """Entries of blobs and of all containers nested in them, with level.

    ``identify`` maps a content column to a format or null. Nested blobs are named by their place, repeated paths by
    their suffixes. States within a write are no versions and are left out. Each level is checkpointed, so that a lost
    executor repeats one level only; the loop ends when nothing more can be opened.
    """
    level, out = blobs, None
    for d in range(depth):
        found = walk(level).where(F.col("extra")["partial"].isNull()).withColumn("level", F.lit(d))
        found = cut(found)
        out = found if out is None else out.unionByName(found)
        level = unique_paths(found).where("kind = 'regular' AND size > 0").select(
            F.concat_ws("/", "node_id", "path").alias("node_id"), identify(F.col("content")).alias("format"), "content"
        ).where("format IS NOT NULL")
        if level.isEmpty():
            break
    return out


#: Magics, in hexadecimal digits, at the start of a blob, and at other places.
HEADS = {
    "1f8b08": "gzip", "fd377a585a00": "xz", "425a68": "bzip2", "28b52ffd": "zstd", "04224d18": "lz4", "894c5a4f000d0a1a0a": "lzop", "5d00": "lzma", "504b0304": "zip", "377abcaf271c": "7z",
    "213c617263683e0a": "ar", "303730373031": "cpio", "303730373032": "cpio", "303730373037": "cpio", "27051956": "uimage", "2d726f6d3166732d": "romfs", "68737173": "squashfs", "73717368": "squashfs",
    "8519": "jffs2", "1985": "jffs2", "55424923": "ubi", "31181006": "ubifs", "453dcd28": "cramfs", "28cd3d45": "cramfs", "eb7eff00": "qnx-ifs", "d00dfeed": "fit", "414e44524f494421": "android-boot",
    "564e4452424f4f54": "android-vendor-boot", "3aff26ed": "android-sparse", "0300000001000000ffff": "yaffs2",
}
PLACES = ((257, b"ustar", "tar"), (4096, b"gDla", "android-super"), (8192, b"\x22\x11\x19\x68", "qnx6"), (8192, b"\x68\x19\x11\x22", "qnx6"), (1080, b"\x53\xef", "ext"), (82, b"FAT32   ", "fat"), (54, b"FAT16   ", "fat"), (54, b"FAT12   ", "fat"), (512, b"EFI PART", "gpt"), (4096, b"EFI PART", "gpt"), (510, b"\x55\xaa", "mbr"))


def format_of(content):
    """A format by its magic, for formats with readers: at the start first, then at the places of filesystems and tables."""
    head = F.lower(F.hex(F.substring(content, 1, 16)))
    first, *rest = sorted(HEADS, key=len, reverse=True)
    out = F.when(head.startswith(first), F.lit(HEADS[first]))
    for magic in rest:
        out = out.when(head.startswith(magic), F.lit(HEADS[magic]))
    for at, magic, name in PLACES:
        out = out.when(F.substring(content, at + 1, len(magic)) == F.lit(magic), F.lit(name))
    return out
