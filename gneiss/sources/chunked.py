"""Large images as chunks: a Python data source with one input partition per chunk, and Spark's readers for the rest."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 16 << 20
SCHEMA = "source_id string, chunk_off long, core_len long, content binary"


class Piece(InputPartition):
    def __init__(self, path: str, off: int, core: int, more: int):
        self.path, self.off, self.core, self.more = path, off, core, more


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.overlap = options["path"], int(options.get("chunk", CHUNK)), int(options.get("overlap", 64))

    def partitions(self) -> list[Piece]:
        import glob
        import os

        out = []
        for path in sorted(glob.glob(self.path)):
            total = os.path.getsize(path)
            out += [Piece(path, at, min(self.size, total - at), self.overlap) for at in range(0, total, self.size)]
        return out

    def read(self, part: Piece) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            f.seek(part.off)
            yield part.path, part.off, part.core, f.read(part.core + part.more)


class ChunkSource(DataSource):
    """Images on a file system that all executors mount: format "image_chunks" with path, chunk and overlap."""

    @classmethod
    def name(cls) -> str:
        return "image_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(self.options)


def chunks(spark: SparkSession, path: str, chunk: int = CHUNK, overlap: int = 64) -> DataFrame:
    spark.dataSource.register(ChunkSource)
    return spark.read.format("image_chunks").option("chunk", chunk).option("overlap", overlap).load(path)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of up to 2 GiB from any file system that Spark reads: (source_id, length, content). Unused content is not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_id"), "length", "content")


def sub_range(blob: DataFrame, off: str, length: str) -> DataFrame:
    """Part of each blob, with an id that tells where it came from."""
    return blob.withColumns(
        {"content": F.substring("content", F.col(off) + 1, F.col(length)), "source_id": F.concat_ws("+", "source_id", F.format_string("0x%x", F.col(off).cast("long")))}
    )


def write_case(tables: dict[str, DataFrame], path: str) -> None:
    """A case: each table as Parquet under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_case(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def round_trips(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
