"""What the corpus operators share: tables in the shared folder, skew-safe joins, components.

Every intermediate table goes to the folder that the session names in
``spark.checkpoint.dir``, as Parquet, so that a lost executor costs a task retry
and never a result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that count as white space in every contract of this package.
SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="gneiss-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/gneiss/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any file system that Spark can reach."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns the table read again."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one operator; ``clean`` deletes them, whether the operator ended well or not."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def put(self, df: DataFrame, label: str) -> DataFrame:
        """df as a table that lives until ``clean``."""
        self.paths.append(path := new_path(self.spark, label))
        return materialize(df, label, path)

    def clean(self) -> None:
        for path in self.paths:
            delete_path(self.spark, path)
        self.paths.clear()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clean()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices: what a worker makes of a slice's texts is a twentieth of what it would make of a whole batch's."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on between tasks, and several share an executor."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Remembered:
    """A worker's table of bounded size in two generations: what is still in use outlives the turn."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}

    def turn(self) -> None:
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(links: DataFrame, label: str, most_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of the undirected links (u, v); component is the smallest node.

    Alternating large-star and small-star rounds: in each, every link is pointed at the smallest
    neighbour of its centre. That neighbour is a pre-aggregated min(), and links meet it in a
    sort-merge join whose hot partitions adaptive execution splits, so no node's neighbours are
    ever gathered. Each round is a table in the shared folder; only a count and a hash sum, which
    tell whether the round changed anything, come to the driver. The last round's table belongs to
    ``scratch``, where one is given.
    """
    spark = links.sparkSession
    path = new_path(spark, f"{label}-links")
    edges = materialize(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), label, path
    )
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges, path = _replace(large, label, path)
        least = edges.groupBy("u").agg(F.min("v").alias("v"))
        small = _star(edges).select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least)
        edges, path = _replace(small, label, path)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == (state["n"], state["s"]):
            break
        seen = (state["n"], state["s"])
    else:
        raise RuntimeError("components did not settle")
    if scratch is not None:
        scratch.paths.append(path)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _star(edges: DataFrame) -> DataFrame:
    """Each link (u, v) with the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least.hint("merge"), "u").select("u", "v", F.least("u", "least").alias("least"))


def _replace(edges: DataFrame, label: str, old: str) -> tuple[DataFrame, str]:
    path = new_path(edges.sparkSession, f"{label}-links")
    out = materialize(edges.where("u <> v").distinct(), label, path)
    delete_path(edges.sparkSession, old)
    return out, path
