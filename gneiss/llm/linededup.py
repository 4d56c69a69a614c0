"""Line dedup over levelled sorted runs of line hashes.

A run is a bucketed table, sorted by key within each bucket, of (key, n_docs): how many documents
of a batch hold the line. Level 0 gets one run per batch; when a level holds ``fanout`` runs they
are merged into one run of the next level. A key whose count reaches ``min_docs`` is closed: it
moves to the closed runs, and later batches merge-anti-join those, so that a line that stands in
a third of all documents is not counted and written again by each batch. Runs share one bucketing,
so merging and anti-joining them needs no shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import SPACE, give_back, materialize, new_path, slices

def line_key(line: bytes) -> bytes:
    """The key of a line: white space stripped at both ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def _key_rows(min_chars: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {k for k in map(line_key, (text or "").encode().split(b"\n")) if k}
                if min_chars > 1:
                    own = {k for k in own if len(k.decode()) >= min_chars}
                ids.extend([doc] * len(own))
                keys.extend(xxhash.xxh3_128_digest(k) for k in own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])
        give_back()

    return run


def line_keys(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(doc_id, key): the distinct line keys of every document, 128-bit hashes, keys of min_chars code points on."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _key_rows(min_chars), "doc_id long, key binary"
    )


class LineRuns:
    """The levelled runs. ``buckets`` must suit the whole corpus: a bucket of a run is read by one task."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 4, buckets: int = 16):
        self.spark, self.min_docs, self.fanout, self.buckets = spark, min_docs, fanout, buckets
        self.name = f"gneiss_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.closed: list[str] = []
        self._n = 0

    def _write(self, df: DataFrame) -> str:
        self._n += 1
        name = f"{self.name}_{self._n}"
        df.repartition(self.buckets, "key").sortWithinPartitions("key").write.bucketBy(self.buckets, "key").sortBy(
            "key"
        ).format("parquet").saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """A level's runs, merged by key: full outer merge joins. (A group-by over their union would trust
        a partitioning that the scans under a union don't keep.)"""
        out = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).withColumnRenamed("n_docs", "more")
            out = out.join(more.hint("merge"), "key", "full_outer").select(
                "key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs")
            )
        return out

    def add(self, keys: DataFrame) -> None:
        """One batch: its (doc_id, key) rows, counted, less the closed keys, become a run of level 0."""
        counts = keys.groupBy("key").agg(F.count("*").alias("n_docs")).repartition(self.buckets, "key")
        for name in self.closed:
            counts = counts.join(self.spark.table(name).select("key").hint("merge"), "key", "left_anti")
        self.levels[0].append(self._write(counts))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merges a level's runs into one run of the next level; keys that have reached min_docs are closed."""
        names = self.levels[level]
        if level + 1 == len(self.levels):
            self.levels.append([])
        merged = self._merged(names)
        self.levels[level + 1].append(self._write(merged.where(F.col("n_docs") < self.min_docs)))
        self.closed.append(self._write(merged.where(F.col("n_docs") >= self.min_docs)))
        self.levels[level] = []
        self._drop(names)

    def frequent(self) -> DataFrame:
        """The keys found in at least min_docs documents so far; a key may come twice."""
        open_runs = [x for level in self.levels for x in level]
        found = [self._merged(open_runs).where(F.col("n_docs") >= self.min_docs)] if open_runs else []
        found += [self.spark.table(x) for x in self.closed]
        out = self.spark.createDataFrame([], "key binary")
        for x in found:
            out = out.unionByName(x.select("key"))
        return out

    def _drop(self, names: list[str]) -> None:
        for x in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {x} PURGE")

    def drop(self) -> None:
        self._drop([*(x for level in self.levels for x in level), *self.closed])
        self.levels, self.closed = [[]], []


def strip_lines(text: str | None, gone: list[bytes] | None) -> tuple[int, int, str]:
    """How many lines the text has, how many go, and what stays without the lines whose key hashes are gone."""
    import xxhash

    lines = (text or "").encode().split(b"\n")
    if not gone:
        return len(lines), 0, text or ""
    gone = set(gone)
    stay = [x for x in lines if not (k := line_key(x)) or xxhash.xxh3_128_digest(k) not in gone]
    return len(lines), len(lines) - len(stay), b"\n".join(stay).decode()


def _count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [strip_lines(t, g) for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        n_lines, n_dropped, kept = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_text"],
        )


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int, batches: int, fanout: int) -> tuple[DataFrame, DataFrame]:
    """All (doc_id, key) rows, and the keys found in at least min_docs documents; both are written tables."""
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    path = new_path(spark, "lines")
    keys = line_keys(docs, min_chars).withColumn("batch", batch)
    # one folder a batch, so that a batch reads no other's rows
    keys.write.partitionBy("batch").parquet(path)
    keys = spark.read.schema(keys.schema).parquet(path)
    runs = LineRuns(spark, min_docs, fanout, buckets=max(16, -(-keys.count() // 4_000_000)))
    for k in range(batches):
        runs.add(keys.where(F.col("batch") == k).select("doc_id", "key"))
    frequent = materialize(runs.frequent(), "frequent")
    runs.drop()
    return keys.select("doc_id", "key"), frequent


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drops every line whose key stands in at least ``min_docs`` documents, in all documents.

    Returns doc_id, n_lines, n_dropped, kept_text: one row per input row. A null text is one empty
    line; empty keys are never dropped; a row is a document, so repeated rows count as often as they
    stand there; rows whose doc_id is null are kept and deduplicated like others. Extra columns
    are ignored; an empty table gives an empty result. The corpus is fed to the runs in ``batches``
    batches, as it would arrive over time; the outcome does not depend on their number.

    A key in a third of all documents: its counts meet pre-aggregated, and the semi-join that marks
    its documents is a sort-merge join whose hot partitions adaptive execution splits.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = _with_gone(docs, min_docs, min_chars, batches, fanout)
    return joined.select("doc_id", "text", "__gone").mapInArrow(
        _count_lines, "doc_id long, n_lines long, n_dropped long, kept_text string"
    )


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2) -> DataFrame:
    """The input's columns, with the kept lines in ``text`` and its length in ``n_chars`` where that column exists; null texts stay null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = {n: batch.column(n) for n in names}
            had = columns["text"]
            kept = [None if t is None else strip_lines(t, g)[2] for t, g in zip(had.to_pylist(), batch.column("__gone").to_pylist(), strict=True)]
            columns["text"] = pa.array(kept, had.type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in kept], pa.int64()).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return _with_gone(docs, min_docs, min_chars, batches, fanout).mapInArrow(run, docs.schema)


def _with_gone(docs: DataFrame, min_docs: int, min_chars: int, batches: int, fanout: int) -> DataFrame:
    """The rows, and in __gone the hashes of their frequent lines."""
    keys, frequent = frequent_lines(docs, min_docs, min_chars, batches, fanout)
    gone = keys.join(frequent.hint("merge"), "key", "left_semi")
    gone = gone.groupBy(F.col("doc_id").alias("__gone_id")).agg(F.collect_set("key").alias("__gone"))
    return docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__gone_id")), "left").drop("__gone_id")
