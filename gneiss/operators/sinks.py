"""Sinks and cases: files on disk, listings, tar parts, carved bytes, cases written as tables and read back."""

from __future__ import annotations

import json
import os
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import hashing, swap
from gneiss.functions.text import normalize_path, safe_filename


def placed(entries: DataFrame) -> DataFrame:
    """Entries with out_path, where a sink may put them, and refused, why it may not: parts made safe as file names."""
    checked = entries.withColumn("__p", normalize_path(F.col("path")))
    safe = F.array_join(F.transform(F.split("__p.path", "/"), lambda x: safe_filename(x, 255)), "/")
    return checked.withColumns({"out_path": F.when(F.col("__p.path").isNotNull(), safe), "refused": F.col("__p.why")}).drop("__p")


def listing(entries: DataFrame, digests: bool = True) -> DataFrame:
    """Metadata only: (node_id, entry_ord, path, kind, size, mode, uid, gid, mtime, link_target, deleted, superseded, version) with digests; contents are left behind."""
    keep = ["node_id", "entry_ord", "path", "kind", "size", "mode", "uid", "gid", "mtime", "link_target", "deleted", "superseded", "version"]
    if not digests:
        return entries.select(*keep)
    return entries.withColumn("__d", F.when(F.col("content").isNotNull(), hashing.digests(F.col("content")))).select(*keep, "__d.md5", "__d.sha1", "__d.sha256")


def write_files(entries: DataFrame, folder: str) -> DataFrame:
    """Writes regular entries below folder/node_id on a file system that all executors mount; returns (node_id, entry_ord, host_path, size, sha256, refused).

    Bytes are hashed as they are written. Modes lose their set-id bits; times are set. A task that is repeated writes the
    same bytes again. The result must be consumed for the files to be written.
    """
    names = ["node_id", "entry_ord", "host_path", "size", "sha256", "refused"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            rows = []
            for node, order, path, why, mode, mtime, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path is None:
                    rows.append((node, order, None, None, None, why))
                    continue
                top = os.path.realpath(os.path.join(folder, node.replace("/", "_")))
                host = os.path.join(top, path)
                if not os.path.realpath(host).startswith(top + os.sep):
                    rows.append((node, order, None, None, None, "outside"))
                    continue
                os.makedirs(os.path.dirname(host), exist_ok=True)
                part = f"{host}.part-{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(body or b"")
                os.chmod(part, (mode if mode is not None else 0o644) & 0o777 | 0o600)
                if mtime is not None:
                    os.utime(part, (mtime, mtime))
                os.replace(part, host)
                rows.append((node, order, host, len(body or b""), sha256(body or b"").hexdigest(), None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    chosen = placed(entries.where("kind = 'regular'")).select("node_id", "entry_ord", "out_path", "refused", "mode", "mtime", F.col("content").cast("binary"))
    return chosen.mapInArrow(run, "node_id string, entry_ord long, host_path string, size long, sha256 string, refused string")


def tar_parts(entries: DataFrame) -> DataFrame:
    """(node_id, entry_ord, part): each entry as its piece of a tar archive, and one end mark a node.

    A tar archive is the concatenation of its members, so the parts of a node in order, mark last, are the archive; no
    node is ever gathered to make one. Entries whose path is refused are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"directory": tarfile.DIRTYPE, "symlink": tarfile.SYMTYPE, "hardlink": tarfile.LNKTYPE, "fifo": tarfile.FIFOTYPE}
        for batch in batches:
            parts = []
            for _, _, path, kind, mode, uid, gid, mtime, target, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                info = tarfile.TarInfo(path)
                info.type, info.linkname = types.get(kind, tarfile.REGTYPE), target or ""
                info.mode, info.uid, info.gid, info.mtime = (mode if mode is not None else 0o644) & 0o777, uid or 0, gid or 0, mtime or 0
                body = (body or b"") if kind == "regular" else b""
                info.size = len(body)
                parts.append(info.tobuf(tarfile.GNU_FORMAT) + body + bytes(-len(body) % 512))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary())], ["node_id", "entry_ord", "part"])

    known = placed(entries).where("refused IS NULL AND kind IN ('regular', 'directory', 'symlink', 'hardlink', 'fifo')")
    members = known.select("node_id", "entry_ord", "out_path", "kind", "mode", "uid", "gid", "mtime", "link_target", F.col("content").cast("binary")).mapInArrow(run, "node_id string, entry_ord long, part binary")
    ends = entries.select("node_id").distinct().select("node_id", F.lit((1 << 63) - 1).alias("entry_ord"), F.unhex(F.repeat(F.lit("00"), F.lit(1024))).alias("part"))
    return members.unionByName(ends)


def carve(blobs: DataFrame, plan: DataFrame) -> DataFrame:
    """(image_id, id, offset, length, content, sha256) of planned pieces (image_id, id, offset, length) of blobs (image_id, content)."""
    both = plan.join(blobs.select("image_id", F.col("content").alias("__c")), "image_id")
    piece = F.substring("__c", (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return both.select("image_id", "id", "offset", "length", piece.alias("content")).withColumn("sha256", F.sha2("content", 256))


def corrected_copy(blobs: DataFrame) -> DataFrame:
    """Blobs (image_id, content) as their words should lie, with word_swap (0, 2 or 4 bytes), confidence and sha256; content changes only where a swap is detected."""
    found = blobs.withColumn("__s", swap.detected(F.col("content")))
    found = found.withColumns({"word_swap": F.col("__s.width"), "confidence": F.col("__s.confidence"), "evidence": F.col("__s.evidence")}).drop("__s")
    return found.withColumn("content", swap.corrected(F.col("content"), F.col("word_swap"))).withColumn("sha256", F.sha2("content", 256))


# --- cases ----------------------------------------------------------------------------------------

MANIFEST = "case"


def write_case(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes a case: each table as Parquet, and a manifest table of names, schemas and row counts, written last."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        rows.append((name, df.schema.json(), spark.read.schema(df.schema).parquet(f"{folder}/{name}").count()))
    spark.createDataFrame(rows, "name string, schema string, rows long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{MANIFEST}")


def read_case(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """The tables of a case, wherever it lies now, and diagnostics (code, message) of those that can't be read or hold fewer rows than the manifest says."""
    from pyspark.sql.types import StructType

    out, said = {}, []
    for r in spark.read.parquet(f"{folder}/{MANIFEST}").orderBy("name").collect():
        try:
            df = spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).parquet(f"{folder}/{r['name']}")
            n = df.count()
        except Exception as e:  # noqa: BLE001  a table that is gone or damaged is told, the others count
            said.append(("case-unreadable", f"{r['name']}: {type(e).__name__}"))
            continue
        if n != r["rows"]:
            said.append(("case-rows-missing", f"{r['name']}: {n} of {r['rows']} rows"))
            continue
        out[r["name"]] = df
    return out, said


def comparable(df: DataFrame) -> DataFrame:
    """df with maps as sorted arrays, so that rows can be compared."""
    return df.select(*(F.array_sort(F.map_entries(c)).alias(c) if t.startswith("map<") else F.col(c) for c, t in df.dtypes))


def round_trips(written: dict[str, DataFrame], read: dict[str, DataFrame]) -> bool:
    """Whether a case read back holds the same rows as often, both ways, in the same tables."""
    if set(written) != set(read):
        return False
    pairs = [(comparable(written[n]), comparable(read[n])) for n in written]
    return all(a.schema == b.schema and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() for a, b in pairs)


def yaml_item(fields: dict[str, Column]) -> Column:
    """One item of a YAML list: a line a field that is not null, strings in double quotes with their escapes."""
    lines = []
    for k, (name, c) in enumerate(fields.items()):
        quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(c.cast("string"), r'(["\\])', r"\\$1"), "\n", r"\\n"), "\t", r"\\t"), F.lit('"'))
        lines.append(F.concat(F.lit("- " if k == 0 else "  "), F.lit(f"{name}: "), quoted))
    return F.concat(F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n"), F.lit("\n"))


def listing_yaml(entries: DataFrame) -> DataFrame:
    """(node_id, entry_ord, item): each entry of a listing as an item of a YAML list; a node's items in order are its listing."""
    fields = {c: F.col(c) for c in ("path", "kind", "size", "mode", "uid", "gid", "mtime", "link_target", "sha256") if c in entries.columns}
    fields |= {c: F.when(F.col(c), F.lit("true")) for c in ("deleted", "superseded") if c in entries.columns}
    return entries.select("node_id", "entry_ord", yaml_item(fields).alias("item"))


def parse_listing(text: str) -> list[dict]:
    """The entries of a YAML listing; a text that is none raises ValueError."""
    import yaml

    try:
        items = yaml.safe_load(text) or []
    except yaml.YAMLError as e:
        raise ValueError(f"listing-unreadable: {e}") from e
    if not isinstance(items, list) or not all(isinstance(x, dict) and "path" in x for x in items):
        raise ValueError("listing-unreadable: no list of entries")
    number = {"size", "mode", "uid", "gid", "mtime"}
    return [{k: int(v) if k in number else v == "true" if k in ("deleted", "superseded") else v for k, v in x.items()} for x in items]
