"""The evidence graph: partition tables and their entries, unidentified regions, carves, node ids, mounts.

Rows of one image meet in windows and groups by image: its finds, never its bytes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.functions import entropy
from gneiss.operators import intervals

#: The formats that a kernel mounts, by the name that mount knows, and those that need a flash device.
MOUNT_TYPES = {
    "ext": "ext4", "ext2": "ext4", "ext3": "ext4", "ext4": "ext4", "squashfs": "squashfs", "qnx6": "qnx6", "fat": "vfat", "fat12": "vfat",
    "fat16": "vfat", "fat32": "vfat", "exfat": "exfat", "ntfs": "ntfs3", "cramfs": "cramfs", "romfs": "romfs",
}
FLASH_FORMATS = ("jffs2", "ubifs", "yaffs2")

#: Beyond every offset of an image.
FAR = 1 << 62


def choose_tables(findings: DataFrame) -> DataFrame:
    """The partition tables among findings (image_id, place, format, category, role, disk_guid, ...), with ``backup``.

    The k-th primary of a disk takes the k-th backup of that disk, whose place stands in ``backup``; such a
    backup is no table of its own. Tables without a disk's name are never paired.
    """
    turn = F.row_number().over(W.partitionBy("image_id", "disk_guid", "role").orderBy("place"))
    named = (F.col("format") == "gpt") & (F.coalesce("disk_guid", F.lit("")) != "")
    tables = findings.where("category = 'partition-table'").withColumn("__turn", F.when(named, turn))
    copies = tables.where("role = 'gpt-backup' AND __turn IS NOT NULL").select("image_id", "disk_guid", "__turn", F.col("place").alias("backup"))
    first = tables.where("role <=> 'gpt-primary'").join(copies, ["image_id", "disk_guid", "__turn"], "left")
    taken = first.where("backup IS NOT NULL").select("image_id", F.col("backup").alias("place"))
    others = tables.where("NOT role <=> 'gpt-primary'").join(taken, ["image_id", "place"], "left_anti").withColumn("backup", F.lit(None).cast(first.schema["backup"].dataType))
    return first.unionByName(others).select(*findings.columns, "backup")


def table_bytes(format: Column, size: Column, sector: Column, count: Column, entry: Column) -> Column:
    """The bytes that a table itself takes: a sector, or two and the whole sectors of its entries; never more than its size where that is known."""
    s, array = F.coalesce(sector, F.lit(512)), F.coalesce(count, F.lit(0)) * F.coalesce(entry, F.lit(0))
    whole = F.when(s > 0, F.ceil(array / s) * s + 2 * s).otherwise(array + 1024)
    claim = F.when(format == "gpt", whole).otherwise(F.lit(512)).cast("long")
    return F.when(size > 0, F.least(claim, size)).otherwise(claim)


def table_entries(tables: DataFrame) -> DataFrame:
    """One row per entry of tables (image_id, place, offset, format, partitions, image_size), clamped to the image.

    protective marks the entry of an old-style table that only shields a newer one in the same image.
    Tables inside an entry of an earlier table describe another disk: ``nested`` is true and their
    entries stay out of the map.
    """
    newer = F.max(F.col("format") == "gpt").over(W.partitionBy("image_id"))
    rows = tables.withColumn("__newer", newer).select("image_id", "place", "offset", "format", "image_size", "__newer", F.explode(intervals.parse_partitions(F.col("partitions"))).alias("e"))
    rows = rows.select("image_id", "place", "offset", "format", "image_size", "__newer", "e.*")
    rows = rows.withColumn("protective", (F.col("format") == "mbr") & F.col("__newer") & (F.col("type") == "0xee")).drop("__newer")
    return intervals.clamp(rows.join(nested_tables(rows), ["image_id", "place"]), "start", "size", "image_size")


def nested_tables(entries: DataFrame) -> DataFrame:
    """(image_id, place, nested) per table; only the entries of tables that are not nested themselves hold others, so the order by offset feeds back."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held = [], []
        for (offset, place), rows in pdf.groupby(["offset", "place"], sort=True):
            inside = any(a <= offset < b for a, b in held)
            out.append((pdf["image_id"].iloc[0], place, inside))
            if not inside:
                real = rows[~rows["protective"]]
                held += zip(real["start"], real["start"] + real["size"], strict=True)
        return pd.DataFrame(out, columns=["image_id", "place", "nested"])

    kinds = dict(entries.dtypes)
    return entries.select("image_id", "place", "offset", "start", "size", "protective").groupBy("image_id").applyInPandas(run, f"image_id {kinds['image_id']}, place {kinds['place']}, nested boolean")


def subtract_claims(gaps: DataFrame, claims: DataFrame, by: list[str]) -> DataFrame:
    """(by, gap_off, gap_end): what the claims (by, off, stop) leave of a key's gaps, which do not touch.

    What lies between gaps counts as claimed, so the rest is one pass over the claims in order, without a range join.
    """
    at = W.partitionBy(*by).orderBy("gap_off")
    between = gaps.select(*by, F.coalesce(F.lag("gap_end").over(at), F.lit(0)).cast("long").alias("off"), F.col("gap_off").alias("stop"))
    beyond = gaps.groupBy(*by).agg(F.max("gap_end").alias("off")).withColumn("stop", F.lit(FAR).cast("long"))
    known = claims.select(*by, "off", "stop").join(beyond.select(*by), by, "left_semi")
    return intervals.gaps(between.unionByName(beyond).unionByName(known), by, F.lit(0).cast("long"), 1)


def to_rescan(partitions: DataFrame, findings: DataFrame) -> DataFrame:
    """The partitions (image_id, start, length, head) that no find starts and whose head is not one byte repeated: their own span is searched again."""
    starts = findings.select("image_id", F.col("offset").alias("start")).distinct()
    return partitions.where("length > 0").where(_fill(F.col("head")).isNull()).join(starts, ["image_id", "start"], "left_anti")


def rescan(images: DataFrame, partitions: DataFrame, findings: DataFrame, signatures=None) -> DataFrame:
    """Findings of the spans that to_rescan chooses, offsets counted in the image (image_id, content): what is aligned to its partition only comes out here."""
    from gneiss.operators import discovery, sinks

    chosen = to_rescan(partitions, findings).groupBy("image_id", "start").agg(F.max("length").alias("length"))
    chosen = chosen.select("image_id", F.col("start").cast("string").alias("id"), F.col("start").alias("offset"), "length")
    pieces = sinks.carve(images, chosen).select(F.concat_ws("@", "image_id", "id").alias("source_id"), "content")
    found = discovery.scan(pieces, signatures).where("owner IS NULL").withColumn("start", F.element_at(F.split("image_id", "@"), -1).cast("long"))
    return found.withColumns({"image_id": F.regexp_replace("image_id", "@[0-9]+$", ""), "offset": F.col("offset") + F.col("start")})


def _fill(content: Column) -> Column:
    """The byte, in two hexadecimal digits, that a value consists of; null if there is none."""
    first = F.hex(F.substring(content, 1, 1))
    return F.when((F.octet_length(content) > 0) & (content == F.unhex(F.repeat(first, F.octet_length(content)))), F.lower(first))


def describe_gap(content: Column) -> Column:
    """struct(fill, entropy, class, chi_square, high): what a region that no signature matched looks like.

    One repeated byte is said of every byte, so it is tested on all; the other figures are the profile's.
    """
    fill, p = _fill(content), entropy.profile(content)
    kind, known = entropy.classify(p), p["sampled"] >= entropy.LEAST
    text = F.when(fill.isin("00", "ff"), F.concat(F.lit("0x"), fill)).otherwise(F.concat(F.lit("0x"), F.ltrim(fill, F.lit("0"))))
    number = lambda x: F.format_string("%.3f", x)
    return F.struct(
        F.when(fill.isNotNull(), text).alias("fill"),
        F.when(fill.isNotNull(), "0.000").when(known, number(p["mean"])).alias("entropy"),
        F.when(fill.isNotNull(), "erased").when(known, kind).alias("class"),
        F.when(fill.isNull() & known, number(p["chi_square"])).alias("chi_square"),
        (fill.isNull() & known & kind.isin("random", "packed")).alias("high"),
    )


def node_kind(category: Column, format: Column) -> Column:
    return (
        F.when(category == "partition-table", "partition").when(category == "filesystem", "filesystem")
        .when(category.isin("container", "compressed") | (format == "uimage"), "container").otherwise("region")
    )


def node_name(attrs: Column, format: Column) -> Column:
    """The first of label, volume_name and name that is not empty, else the format."""
    given = [F.nullif(F.try_element_at(attrs, F.lit(k)), F.lit("")) for k in ("label", "volume_name", "name")]
    return F.coalesce(*given, format)


def nodes_from_findings(findings: DataFrame) -> DataFrame:
    """Node rows of findings (image_id, offset, size, confidence, format, category, signature, evidence, attrs, diagnostics, also)."""
    own = F.create_map(F.lit("signature"), F.col("signature"), F.lit("category"), F.col("category"))
    kept = F.map_filter("attrs", lambda k, _: ~k.isin("signature", "category"))
    said = F.transform(
        "also",
        lambda x: F.format_string("also-matched: %s (%s) at 0x%x with confidence %d", x["format"], x["signature"], x["offset"], x["confidence"]),
    )
    return findings.select(
        "image_id", node_kind(F.col("category"), F.col("format")).alias("kind"), node_name(F.col("attrs"), F.col("format")).alias("name"), "format", "offset",
        F.col("size").alias("length"), "confidence", "evidence", F.map_concat(kept, own).alias("attrs"), F.concat("diagnostics", said).alias("diagnostics"),
    )


def in_byte_order(items: DataFrame, by: list[str]) -> DataFrame:
    """Items (by, offset, is_gap, ord) with ``item``, counted from 0: by offset, finds before gaps, else as they came."""
    return items.withColumn("item", F.row_number().over(W.partitionBy(*by).orderBy("offset", "is_gap", "ord")) - 1)


def number_nodes(nodes: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds id, n000001 and so on in each case's order, parent_id from ``parent`` (a value of ``order``), and parent_missing."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(order))
    named = nodes.withColumn("id", F.format_string("n%06d", place))
    known = named.select(*by, F.col(order).alias("parent"), F.col("id").alias("parent_id"))
    return named.join(known, [*by, "parent"], "left").withColumn("parent_missing", F.col("parent").isNotNull() & F.col("parent_id").isNull())


def used_before(nodes: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds files_before and bytes_before: what earlier walks (n_files, n_bytes) of a run have used of its budget."""
    window = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(window), F.lit(0)).cast("long")
    return nodes.withColumns({"files_before": total("n_files"), "bytes_before": total("n_bytes")})


def carve_plan(nodes: DataFrame, everything: bool, most: int) -> DataFrame:
    """(image_id, id, action, carved_in) of the nodes that a carve concerns: carve, unknown-size, too-large or in-parent.

    nodes: image_id, id, parent_id, kind, format, offset, length, file_size, is_table, protective, outside. Entries of
    partition tables are carved; with ``everything`` also finds that stand in an image, elsewhere than at a
    partition's start, or in a file that they do not fill.
    """
    above = nodes.select("image_id", F.col("id").alias("parent_id"), F.col("kind").alias("__kind"), F.col("offset").alias("__offset"), F.col("file_size").alias("__size"))
    rows = nodes.join(above, ["image_id", "parent_id"], "left")
    entry = F.expr("kind = 'partition' AND NOT (coalesce(is_table, false) OR coalesce(protective, false) OR coalesce(outside, false))")
    find = F.expr("kind IN ('filesystem', 'container', 'region') AND coalesce(format, '') <> ''") & F.lit(everything)
    at_start = find & F.expr("__kind = 'partition' AND __offset = offset")
    fills = F.expr("offset = 0 AND coalesce(__size, 0) <> 0 AND length >= __size")
    apart = find & (F.expr("__kind = 'image'") | (F.expr("__kind = 'partition'") & ~at_start) | (F.expr("__kind = 'file'") & ~fills))
    sized = F.when(F.col("length") == 0, "unknown-size").when(F.col("length") > most, "too-large").otherwise("carve")
    plan = rows.withColumn("action", F.when(entry | F.coalesce(apart, F.lit(False)), sized).when(at_start, "in-parent")).where("action IS NOT NULL")
    plan = plan.select("image_id", "id", "parent_id", "action")
    carved = plan.where("action = 'carve'").select("image_id", F.col("id").alias("parent_id"), F.col("id").alias("__carved"))
    return plan.join(carved, ["image_id", "parent_id"], "left").select("image_id", "id", "action", F.when(F.col("action") == "in-parent", F.col("__carved")).alias("carved_in"))


def mounts(carved: DataFrame) -> DataFrame:
    """carved (file, format, ...) with how: mount or flash, and mount_type; formats that neither way opens are left out."""
    pairs = F.create_map(*(F.lit(x) for kv in MOUNT_TYPES.items() for x in kv))
    kind = F.try_element_at(pairs, F.col("format"))
    how = F.when(kind.isNotNull(), "mount").when(F.col("format").isin(*FLASH_FORMATS), "flash")
    return carved.withColumns({"how": how, "mount_type": kind}).where("how IS NOT NULL")


def mount_script(rows: list) -> str:
    """A shell script that mounts the files (file, mount_type) of one case read-only, each below the folder given as its argument."""
    quote = lambda s: "'" + s.replace("'", "'\\''") + "'"
    lines = ["#!/bin/sh", "set -e", 'top="${1:?a folder for the mounts is needed}"', 'here="$(dirname "$0")"']
    for r in rows:
        lines += [f'mkdir -p "$top"/{quote(r["file"])}', f'mount -o ro,loop -t {r["mount_type"]} "$here"/{quote(r["file"])} "$top"/{quote(r["file"])}']
    return "\n".join(lines) + "\n"
