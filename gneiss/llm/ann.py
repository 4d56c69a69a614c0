"""Nearest neighbours by a hash-prefix forest.

The rows are dealt into blocks of bounded size. In a block each tree is one sorted array of long
hash strings: bit i of a string tells on which side of the i-th random hyperplane of the tree, set
through the block's own median, a vector lies. A query descends every tree to its longest
matching prefix, by binary search, and then ascends all trees synchronously, one bit at a time, so that
prefixes of equal length are widened together until enough candidates are found. Candidates are
ranked by exact distances in double precision. A query's answers from all blocks are merged.

Vectors that are equal form one class: the forest holds one representative, and a class stands for
its members with the smallest ids, of which a query can use no more than it asks for, and itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.llm.common import materialize

_OUT = "query_id long, vec_id long, score double"


class Forest:
    """Sorted arrays of hash strings over the rows of ``x``."""

    def __init__(self, x: np.ndarray, trees: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        self.x, self.trees, self.bits = x, trees, bits
        self.centre = np.median(x, axis=0) if len(x) else np.zeros(x.shape[1])
        self.planes = rng.standard_normal((trees, bits, x.shape[1]))
        self.shift = [np.median((x - self.centre) @ p.T, axis=0) if len(x) else np.zeros(bits) for p in self.planes]
        self.keys, self.rows = [], []
        for t in range(trees):
            k = self.strings(x, t)
            order = np.argsort(k, kind="stable")
            self.keys.append(k[order])
            self.rows.append(order)

    def strings(self, x: np.ndarray, tree: int) -> np.ndarray:
        """Hash strings as unsigned numbers: the first bit is the highest."""
        bits = ((x - self.centre) @ self.planes[tree].T) >= self.shift[tree]
        weights = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        return (bits.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)

    def candidates(self, q: np.ndarray, enough: int) -> list[np.ndarray]:
        """For each row of q the rows that share the longest prefixes with it, at least ``enough`` where there are so many."""
        spans = []  # per prefix length, from the full string to the empty one: first and last place in each tree
        strings = [self.strings(q, t) for t in range(self.trees)]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        open_ = np.arange(len(q))
        for cut in range(self.bits + 1):
            low, high = [], []
            mask = np.uint64((1 << cut) - 1)
            for t in range(self.trees):
                s = strings[t][open_]
                low.append(np.searchsorted(self.keys[t], s & ~mask, "left"))
                high.append(np.searchsorted(self.keys[t], s | mask, "right"))
            low, high = np.array(low), np.array(high)
            ready = ((high - low).sum(axis=0) >= enough) | (cut == self.bits)
            still = []
            for j, row in enumerate(open_):
                if ready[j]:
                    found = np.unique(np.concatenate([self.rows[t][low[t, j] : high[t, j]] for t in range(self.trees)]))
                    if len(found) >= min(enough, len(self.x)) or cut == self.bits:
                        out[row] = found
                        continue
                still.append(row)
            open_ = np.array(still, np.int64)
            if not len(open_):
                break
        return out


def _search(k: int, trees: int, bits: int, enough: int):
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        ids, found, scores = [], [], []
        if points.num_rows and queries.num_rows:
            dims = np.array(points["dims"].to_pylist())
            asked_dims = np.array(queries["dims"].to_pylist())
            for dim in np.unique(asked_dims):
                p, q = points.filter(pa.array(dims == dim)), queries.filter(pa.array(asked_dims == dim))
                if not p.num_rows:
                    continue
                x = np.array(p["vector"].combine_chunks().flatten(), np.float64).reshape(p.num_rows, dim)
                members = p["members"].to_pylist()
                forest = Forest(x, trees, bits, 7)
                y = np.array(q["vector"].combine_chunks().flatten(), np.float64).reshape(q.num_rows, dim)
                for own, row, near in zip(q["query_id"].to_pylist(), y, forest.candidates(y, enough), strict=True):
                    d = np.sqrt(((x[near] - row) ** 2).sum(axis=1))
                    # whole distance classes up to the k-th, with all members: ties go to smaller ids
                    edge = np.partition(d, k)[k] if len(d) > k else np.inf
                    best = sorted((s, m) for s, j in zip(d[d <= edge], near[d <= edge], strict=True) for m in members[j] if m != own)[:k]
                    ids += [own] * len(best)
                    scores += [s for s, _ in best]
                    found += [m for _, m in best]
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.float64())})

    return run


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not empty, all components finite numbers, not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, trees: int = 48, bits: int = 24, enough: int = 3000, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by ``every``, its k nearest rows by Euclidean distance.

    Unusable vectors (see usable) take no part. Vectors of another length than the query's are no
    candidates. Repeated rows with one vec_id and vector are one row; null ids take no part; extra
    columns are ignored. Every usable row is indexed; a query meets every block.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & usable(vector))
    # equal vectors, told by their components' text, are one class; its smallest ids come by a bounded pre-aggregation
    rows = materialize(rows, "vectors")
    # of a class a query can use its k smallest ids besides its own, and a class is asked for as often as it holds queries
    ranked = rows.groupBy("vector").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n"))
    lone = ranked.where("n = 1").select("class_id", "vector", F.array("class_id").alias("members"))
    many = ranked.where("n > 1").select("class_id", F.col("vector").alias("v"))
    held = rows.join(many.hint("merge"), rows["vector"] == F.col("v")).select("class_id", "vec_id")
    # a ranking limit, which Spark also applies before the shuffle, so that a hot class sends few rows
    first = W.partitionBy("class_id").orderBy("vec_id")
    held = held.distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    whole = held.groupBy("class_id").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    points = lone.unionByName(
        whole.join(many.hint("merge"), "class_id").select("class_id", F.col("v").alias("vector"), "members")
    )
    points = materialize(points, "points")
    blocks = max(1, -(-points.count() // block))
    points = points.select(F.pmod(F.xxhash64("class_id"), F.lit(blocks)).cast("long").alias("block"), F.size("vector").alias("dims"), "vector", "members")
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.size("vector").alias("dims"), "vector", F.col("vec_id").alias("query_id")
    )
    found = points.groupBy("block").cogroup(queries.groupBy("block")).applyInArrow(_search(k, trees, bits, enough), _OUT)
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    best = best.select("query_id", F.posexplode("best").alias("at", "x"))
    return best.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
