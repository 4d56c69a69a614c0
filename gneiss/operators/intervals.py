"""Interval algebra: conflicts between finds, covered starts, innermost parents, gaps, clamps, overlays."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: the least size of a gap that becomes a region.
MIN_REGION = 4096


def before() -> list[Column]:
    """The total order of finds."""
    return [F.col("offset"), F.col("confidence").desc(), F.col("size").desc(), F.col("signature"), F.col("format")]


class Find(NamedTuple):
    """What of a find decides whether it is kept."""

    offset: int
    size: int
    confidence: int
    format: str
    category: str


def owners(rows: list[Find]) -> list[int | None]:
    """The place of each find's owner, or None where it is kept, over an image's finds in their total order."""
    owner: list[int | None] = []
    open_: list[int] = []
    kept_here: int | None = None
    for k, f in enumerate(rows):
        absorbs = lambda o, f=f: f.category != "partition-table" or rows[o].category == "partition-table"
        if kept_here is not None and rows[kept_here].offset != f.offset:
            kept_here = None
        if kept_here is not None and absorbs(kept_here):
            owner.append(kept_here)
            continue
        open_ = [o for o in open_ if rows[o].offset + rows[o].size > f.offset]
        found = None
        for o in reversed(open_):
            x = rows[o]
            outranks = _tier(x.confidence) > _tier(f.confidence) or x.format == "ubi" or (f.category == "compressed" and x.category != "compressed")
            if outranks and f.offset + max(f.size, 1) <= x.offset + x.size and absorbs(o):
                found = o
                break
        owner.append(found)
        if found is None:
            if kept_here is None:
                kept_here = k
            if f.size > 0:
                open_.append(k)
    return owner


def resolve(findings: DataFrame, by: str = "image_id") -> DataFrame:
    """Adds owner (null if the find is kept) and place, over findings (by, offset, size, confidence, format, category, signature).

    In order, a find is absorbed by the kept find at its offset, or by the innermost open kept find that
    contains it and outranks it: a higher tier, or a remapping container, or any container of a
    compressed stream. Partition tables are absorbed by partition tables only. Kept state feeds
    back, so an image's finds (not its bytes) are one grouped task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["offset", "confidence", "size", "signature", "format"], ascending=[True, False, False, True, True]).reset_index(drop=True)
        rows = list(map(Find._make, pdf[list(Find._fields)].itertuples(index=False, name=None)))
        return pdf.assign(place=range(len(pdf)), owner=pd.array(owners(rows), "Int64"))

    schema = ", ".join(f"`{n}` {t}" for n, t in findings.dtypes) + ", place long, owner long"
    return findings.groupBy(by).applyInPandas(run, schema)


def _tier(score: int) -> int:
    return sum(score >= x for x in (25, 60, 85, 99))


def covered_starts(hits: DataFrame, by: list[str], order: list[str] = ("offset",)) -> DataFrame:
    """Drops hits that start inside the last accepted one of their group with a tier from consistent on; acceptance feeds back."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keep, end = [], -1
        pdf = pdf.sort_values(list(order))
        for at, size, score in pdf[["offset", "size", "confidence"]].itertuples(index=False):
            keep.append(at >= end)
            if keep[-1] and score >= 85 and size > 0:
                end = at + size
        return pdf[keep]

    return hits.groupBy(*by).applyInPandas(run, hits.schema)


def gaps(claims: DataFrame, by: list[str], end: Column, least: int = MIN_REGION) -> DataFrame:
    """(by, gap_off, gap_end): what no claim (by, off, stop) covers, up to ``end``, at least ``least`` long.

    ``end`` is an aggregate over a group's claims. A running maximum, then one row a group for the tail.
    """
    real = claims.where("stop > off")
    run = W.partitionBy(*by).orderBy("off", F.col("stop").desc()).rowsBetween(W.unboundedPreceding, -1)
    inner = real.withColumn("seen", F.greatest(F.coalesce(F.max("stop").over(run), F.lit(0).cast("long")), F.lit(0))).select(*by, F.col("seen").alias("gap_off"), F.col("off").alias("gap_end"))
    tail = claims.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("stop") > F.col("off"), F.col("stop"))), F.lit(0)).alias("gap_off"), end.alias("gap_end"))
    return inner.unionByName(tail).where(F.col("gap_end") - F.col("gap_off") >= least)


def innermost_parent(points: DataFrame, extents: DataFrame, by: list[str], width: int) -> DataFrame:
    """points (by, point, at) with the innermost extent (by, ord, off, stop) that holds them as ``parent``; null without one.

    The smallest length wins, the later one on ties. Both sides are dealt into bins of ``width`` and lie in one stream
    per bin, sorted by place, over which a heap of the open extents runs: work is linear in the rows, and a
    task holds the extents that are open. An extent lies in as many bins as it reaches, so ``width`` should be above most
    lengths; a key with many rows is spread over its bins.
    """
    kinds = {c: points.schema[c].dataType.simpleString() for c in [*by, "point", "at"]}
    order = extents.schema["ord"].dataType.simpleString()
    starts = extents.where("stop > off").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("off") / width), F.floor((F.col("stop") - 1) / width))))
    starts = starts.select(*by, "__bin", F.col("off").cast("long").alias("__x"), F.lit(0).alias("__side"), F.col("stop").cast("long").alias("__stop"), F.col("ord"), F.lit(None).cast(kinds["point"]).alias("point"), F.lit(None).cast(kinds["at"]).alias("at"))
    asked = points.select(*by, F.floor(F.col("at") / width).alias("__bin"), F.col("at").cast("long").alias("__x"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__stop"), F.lit(None).cast(order).alias("ord"), "point", "at")
    stream = starts.unionByName(asked).repartition(*by, "__bin").sortWithinPartitions(*by, "__bin", "__x", "__side")
    n, names = len(by), [*by, "point", "at", "parent"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows, parents = [], []
            for k, (key, x, side, stop, own) in enumerate(zip(zip(*columns[: n + 1], strict=True), *columns[n + 1 : n + 5], strict=True)):
                if key != now:
                    now, heap = key, []
                if side == 0:
                    heapq.heappush(heap, (stop - x, _Later(own), stop))
                    continue
                while heap and heap[0][2] <= x:  # it has ended, and places only grow
                    heapq.heappop(heap)
                rows.append(k)
                parents.append(heap[0][1].value if heap else None)
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in range(n)), kept.column(n + 5), kept.column(n + 6), pa.array(parents, batch.schema.field(n + 4).type)], names)

    return stream.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in [*by, "point", "at"]), f"parent {order}"]))


class _Later:
    """A value that sorts before smaller ones."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __lt__(self, other: _Later) -> bool:
        return self.value > other.value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Later) and self.value == other.value


def clamp(rows: DataFrame, start: str, size: str, limit: str) -> DataFrame:
    """Adds length, outside and claimed_size: extents cut to the image's end; those that start beyond it have none."""
    s, n, end = F.col(start), F.col(size), F.col(limit)
    cut = F.greatest(F.lit(0).cast("long"), F.least(n, end - s))
    return rows.withColumns(
        {"length": F.when(s >= end, F.lit(0).cast("long")).otherwise(cut), "outside": s >= end, "claimed_size": F.when((s < end) & (s + n > end), n)}
    )


def overlay(writes: DataFrame, by: list[str]) -> DataFrame:
    """(by, version, off, stop): the pieces of a key's line, each with the latest write (by, off, stop, version) that covers it.

    A key's writes are one stream in the order of their starts, over which a heap of open writes runs, latest first; a
    task holds the open writes only. Neighbouring pieces of one write are one.
    """
    kinds = dict(writes.dtypes)
    stream = writes.where("stop > off").select(*by, "off", "stop", "version").repartition(*by).sortWithinPartitions(*by, "off", F.col("version").desc())
    n, names = len(by), [*by, "version", "off", "stop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, heap, at, last, out = None, None, [], 0, None, []

        def advance(to) -> None:
            """Emits what lies between the current place and ``to``, or all that is open for None."""
            nonlocal at, last
            while heap and (to is None or at < to):
                latest, stop = heap[0]
                if stop <= at:
                    heapq.heappop(heap)
                    continue
                end = stop if to is None else min(stop, to)
                if last and last[0] == latest.value and last[2] == at:
                    last[2] = end
                else:
                    emit()
                    last = [latest.value, at, end]
                at = end

        def emit() -> None:
            if last:
                out.append((*now, *last))

        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, (off, stop, version) = row[:n], row[n:]
                if key != now:
                    advance(None)
                    emit()
                    now, heap, at, last = key, [], off, None
                advance(off)
                at = max(at, off)
                heapq.heappush(heap, (_Later(version), stop))
            if out:
                yield pieces(schema, out)
                out = []
        if schema is not None:
            advance(None)
            emit()
            yield pieces(schema, out)

    def pieces(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
        types = [*(schema.field(k).type for k in range(n)), schema.field(n + 2).type, schema.field(n).type, schema.field(n + 1).type]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return stream.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def parse_partitions(text: Column) -> Column:
    """array<struct<index, start, size, type, more>> of "index:start:size:type[:more];..."; items that don't parse are left out."""
    items = F.transform(F.split(text, ";"), lambda x: F.split(x, ":", 5))
    good = F.filter(items, lambda p: (F.size(p) >= 4) & reduce(lambda a, b: a & b, (F.get(p, F.lit(k)).rlike("^[0-9]+$") for k in range(3))))
    number = lambda p, k: F.get(p, F.lit(k)).try_cast("bigint")
    return F.transform(good, lambda p: F.struct(number(p, 0).alias("index"), number(p, 1).alias("start"), number(p, 2).alias("size"), F.get(p, F.lit(3)).alias("type"), F.get(p, F.lit(4)).alias("more")))


def parse_covers(text: Column) -> Column:
    """array<struct<off, len>> of "off:len;..."; bad items and empty ranges are left out."""
    pairs = F.transform(F.split(text, ";"), lambda x: F.struct(F.get(F.split(x, ":"), F.lit(0)).try_cast("bigint").alias("off"), F.get(F.split(x, ":"), F.lit(1)).try_cast("bigint").alias("len")))
    return F.filter(pairs, lambda p: p["off"].isNotNull() & (F.coalesce(p["len"], F.lit(0)) > 0))
