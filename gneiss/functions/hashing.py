"""Digests and their verification."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digests(c: Column) -> Column:
    """struct(md5, sha1, sha256, bytes) of a string or binary column, lower-case hex."""
    return F.struct(
        F.md5(c.cast("binary")).alias("md5"), F.sha1(c.cast("binary")).alias("sha1"), F.sha2(c.cast("binary"), 256).alias("sha256"), F.octet_length(c).cast("long").alias("bytes")
    )


def _crc_table(polynomial: int) -> list[int]:
    out = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ polynomial if k & 1 else k >> 1
        out.append(k)
    return out


#: Fixed value: the reversed polynomial of CRC-32C.
CASTAGNOLI = _crc_table(0x82F63B78)


def crc32c(raw: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in raw:
        crc = crc >> 8 ^ CASTAGNOLI[(crc ^ b) & 0xFF]
    return crc ^ 0xFFFFFFFF


def crcs(c: Column) -> Column:
    """struct(crc32, crc32c, jffs2, ubi, qnx6) of a binary column: the plain one, Castagnoli's, without inversions, without the last one, and highest bit first."""
    names = ("crc32", "crc32c", "jffs2", "ubi", "qnx6")
    kind = pa.struct([(n, pa.int64()) for n in names])

    def run(raw: pa.Array) -> pa.Array:
        import zlib

        from gneiss.formats.qnx import crc_be
        from gneiss.formats.validators import _crc0, crc_ubi

        return pa.array([None if x is None else dict(zip(names, (zlib.crc32(x), crc32c(x), _crc0(x), crc_ubi(x), crc_be(x)), strict=True)) for x in raw.to_pylist()], kind)

    return F.arrow_udf(run, "struct<crc32:bigint,crc32c:bigint,jffs2:bigint,ubi:bigint,qnx6:bigint>")(c.cast("binary"))


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """(source_id, md5, sha1, sha256, bytes) of sources that lie in chunks: hash states run over each source's chunks in order.

    A source's chunks are one task's stream, sorted by offset, never a group in memory.
    """
    def run(batches):
        import hashlib

        state, done = None, []

        def row():
            source, hashes, size = state
            return (source, *(h.hexdigest() for h in hashes), size)

        for batch in batches:
            for source, content, core in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if state is None or state[0] != source:
                    if state:
                        done.append(row())
                    state = [source, [hashlib.md5(), hashlib.sha1(), hashlib.sha256()], 0]
                for h in state[1]:
                    h.update(content[:core])
                state[2] += core
        if state:
            done.append(row())
        columns = list(zip(*done, strict=True)) if done else [()] * 5
        kinds = [pa.string()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["source_id", "md5", "sha1", "sha256", "bytes"])

    ordered = chunks.repartition("source_id").sortWithinPartitions("source_id", "chunk_off")
    return ordered.select("source_id", "content", "core_len").mapInArrow(run, "source_id string, md5 string, sha1 string, sha256 string, bytes long")


def verify(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """recorded (path, sha256) against live (path, sha256, readable): the state of each recorded file."""
    both = recorded.join(live.select("path", F.col("sha256").alias("now"), "readable"), "path", "left")
    state = (
        F.when(F.coalesce("sha256", F.lit("")) == "", "no recorded hash")
        .when(F.col("readable").isNull(), "missing")
        .when(~F.col("readable"), "unreadable")
        .when(F.col("sha256") == F.col("now"), "verified")
        .otherwise("MISMATCH")
    )
    return both.select("path", state.alias("state"))


def all_verified(states: DataFrame) -> DataFrame:
    """One row: verified only if there is something and all of it matches."""
    return states.agg(((F.count("*") > 0) & F.coalesce(F.bool_and(F.col("state") == "verified"), F.lit(False))).alias("verified"))
