"""Resharding by minimum-cost flow.

The law is ``rows``: shard counts differ by one at most. Rows of an old shard form blocks by size class.
From the old shards' blocks and the new shards' capacities a minimum-cost flow says how many rows of which
block go where, with the bytes moved as its cost: staying is free, a moved row costs its block's
bytes a row. The network has one node for each old shard's block and one for each new shard, so it is
as large as old shards times size classes, whatever the corpus. A block's rows are told apart
by their place in an order of the block, which is counted in parts, so that no block is one task.

Then the files of the shards that change are written anew, the others stay as they are, and the result is read from
both. A block's price a row is its mean size, and a class spans a quarter of a doubling, so the bytes moved are the fewest
for the blocks and at most 2 ** (1 / 4) times, 1.19, the fewest for single rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.llm.common import materialize, new_path

#: Bytes that a row takes besides its text.
ROW_BYTES = 16

#: Size classes to a doubling of the size, and their number at most.
CLASSES_A_DOUBLING, MOST_CLASSES = 4, 128


class Flow:
    """Successive shortest paths with potentials, on integers."""

    def __init__(self):
        self.arcs: dict[str, list[list]] = defaultdict(list)

    def add(self, a: str, b: str, capacity: int, cost: int) -> list:
        there, back = [b, capacity, cost, None], [a, 0, -cost, None]
        there[3], back[3] = back, there
        self.arcs[a].append(there)
        self.arcs[b].append(back)
        return there

    def run(self, source: str, sink: str) -> int:
        """Sends all that can flow; returns its cost. Costs must not be negative at the start."""
        height: dict[str, int] = defaultdict(int)
        total = 0
        while True:
            dist, via, heap = {source: 0}, {}, [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > dist[a]:
                    continue
                for arc in self.arcs[a]:
                    if arc[1] > 0:
                        e = d + arc[2] + height[a] - height[arc[0]]
                        if e < dist.get(arc[0], 1 << 80):
                            dist[arc[0]], via[arc[0]] = e, arc
                            heapq.heappush(heap, (e, arc[0]))
            if sink not in dist:
                return total
            far = max(dist.values())
            for a in self.arcs:
                height[a] += dist.get(a, far)
            send, b = 1 << 80, sink
            while b != source:
                send, b = min(send, via[b][1]), via[b][3][0]
            b = sink
            while b != source:
                arc = via[b]
                arc[1] -= send
                arc[3][1] += send
                total += send * arc[2]
                b = arc[3][0]


def plan(blocks: list[tuple[int, int, int, int]], old: int, new: int) -> list[tuple[int, int, int, int]]:
    """(old_shard, size_class, new_shard, rows): the transfers that move the fewest bytes.

    ``blocks`` are (old_shard, size_class, rows, bytes). Counts of the new shards differ by one at
    most; which shards get one more is left to the flow. Rows are whole, so the flow is exact.
    """
    total = sum(n for _, _, n, _ in blocks)
    least, more = divmod(total, new)
    net, arcs = Flow(), []
    # every shard must be filled to ``least``: the row beyond costs more than all else together
    beyond = 1 + sum(b for _, _, _, b in blocks)
    for j in range(new):
        net.add(f"n{j}", "sink", least, 0)
        net.add(f"n{j}", "extra", 1, beyond)
    net.add("extra", "sink", more, 0)
    for i, c, n, size in blocks:
        node, price = f"b{i}.{c}", max(1, -(-size // max(1, n)))
        net.add("source", node, n, 0)
        if i < new:
            arcs.append((i, c, i, n, net.add(node, f"n{i}", n, 0)))
        # all ways to other shards cost the same, so they share one node
        net.add(node, "pool", n, price)
    pool = {j: net.add("pool", f"n{j}", total, 0) for j in range(new)}
    net.run("source", "sink")
    out, moved = [], []
    sent = defaultdict(int)
    for i, c, j, n, arc in arcs:
        if k := n - arc[1]:
            out.append((i, c, j, k))
            sent[i, c] += k
    for i, c, n, _ in blocks:
        if n > sent[i, c]:
            moved.append([i, c, n - sent[i, c]])
    for j, arc in pool.items():
        room = total - arc[1]
        while room:
            i, c, n = moved[-1]
            k = min(n, room)
            out.append((i, c, j, k))
            room -= k
            moved[-1][2] -= k
            if not moved[-1][2]:
                moved.pop()
    return sorted(out)


def unchanged(moves: list[tuple[int, int, int, int]]) -> set[int]:
    """The shards that neither give nor take a row."""
    return {i for i, _, _, _ in moves} - {x for i, _, j, _ in moves if i != j for x in (i, j)}


def assign(docs: DataFrame, old_shard, shards: int = 40, rows_a_part: int = 5_000) -> DataFrame:
    """The input's rows with size, old_shard, shard and slot; see assigned."""
    return assigned(docs, old_shard, shards, rows_a_part)[0]


def assigned(docs: DataFrame, old_shard, shards: int = 40, rows_a_part: int = 5_000) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """The input's rows with size (long), old_shard, shard (int) and slot (long, gapless from 0 in each shard), and the transfers of plan.

    ``old_shard`` is a column of integers from 0 on. Only the table of blocks, at most MOST_CLASSES rows
    to an old shard, comes to the driver.
    """
    size = (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + ROW_BYTES).cast("long")
    kind = F.least(F.floor(F.log2(size.cast("double")) * CLASSES_A_DOUBLING), F.lit(MOST_CLASSES - 1)).cast("int")
    mark = F.xxhash64("doc_id", "text")
    rows = docs.withColumns({"size": size, "old_shard": old_shard.cast("int"), "__class": kind, "__mark": mark})
    counts = rows.groupBy("old_shard").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.max("old_shard").alias("last")).first()
    if counts["most"] is None:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).drop("__class", "__mark"), []
    parts = -(-counts["most"] // rows_a_part)
    rows = rows.withColumn("__part", F.pmod("__mark", F.lit(parts)).cast("int"))
    stats = materialize(rows.groupBy("old_shard", "__class", "__part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "blocks")
    # where each part's rows of a class begin: in the part's own order, and in the block's
    inside = W.partitionBy("old_shard", "__part").orderBy("__class").rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy("old_shard", "__class").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    starts = stats.withColumns({"first": F.coalesce(F.sum("n").over(inside), none), "before": F.coalesce(F.sum("n").over(across), none)})
    starts = starts.select(*(F.col(c).alias(f"s{c}") for c in ("old_shard", "__class", "__part")), (F.col("before") - F.col("first")).alias("__lift"))
    blocks = [tuple(r) for r in stats.groupBy("old_shard", "__class").agg(F.sum("n"), F.sum("bytes")).collect()]
    moves, base, at = [], defaultdict(int), defaultdict(int)
    transfers = plan(blocks, counts["last"] + 1, shards)
    for i, c, j, n in transfers:
        moves.append((i, c, at[i, c], at[i, c] + n, j, base[j]))
        at[i, c] += n
        base[j] += n
    moves = docs.sparkSession.createDataFrame(moves, "m_old int, m_class int, lo long, hi long, shard int, base long")
    order = W.partitionBy("old_shard", "__part").orderBy("__class", "__mark", "doc_id", "size")
    ranked = rows.withColumn("__rank", F.row_number().over(order) - 1)
    ranked = ranked.join(
        starts,
        (F.col("old_shard") == F.col("sold_shard")) & (F.col("__class") == F.col("s__class")) & (F.col("__part") == F.col("s__part")),
    ).withColumn("__rank", F.col("__rank") + F.col("__lift"))
    # at most shards + MOST_CLASSES * old shards rows, and one for each extra cut: small by the network's size
    ranked = ranked.join(
        F.broadcast(moves),
        (F.col("old_shard") == F.col("m_old")) & (F.col("__class") == F.col("m_class")) & (F.col("__rank") >= F.col("lo")) & (F.col("__rank") < F.col("hi")),
    )
    ranked = ranked.withColumn("slot", F.col("base") + F.col("__rank") - F.col("lo"))
    return ranked.select(*docs.columns, "size", "old_shard", "shard", "slot"), transfers


_FILE = "doc_id long, text string, old_shard int, slot long"


def _write(placed: DataFrame, path: str) -> None:
    placed.select("doc_id", "text", "old_shard", "slot", "shard").write.partitionBy("shard").parquet(path)


def reshard(docs: DataFrame, old_shard, shards: int = 40, path: str | None = None) -> DataFrame:
    """Writes doc_id and text into files by shard and returns the files' rows with old_shard, shard and slot.

    One row per input row. A null text stays null and counts ROW_BYTES; null ids and repeated rows
    are placed like others; extra columns are ignored; an empty table gives an empty result. The rows come from a
    table, not from shard files, so all of them are written; see reshard_files for files.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = path or new_path(spark, "shards")
    _write(assigned(docs, old_shard, shards)[0], path)
    return spark.read.schema(_FILE + ", shard int").parquet(path)


def reshard_files(spark: SparkSession, layout: dict[int, str], shards: int, path: str) -> dict[int, str]:
    """Reshards files as ``reshard`` writes them; ``layout`` and the result name each shard's folder.

    Only shards that give or take a row are written, to ``path``; the folders of the others stand in
    the result as they stood in ``layout``, with their slots. Old folders are left to the caller.
    """
    if not layout:
        return {}
    docs = spark.read.schema(_FILE).parquet(layout[min(layout)]).withColumn("was", F.lit(min(layout)))
    for shard in sorted(layout)[1:]:
        docs = docs.unionByName(spark.read.schema(_FILE).parquet(layout[shard]).withColumn("was", F.lit(shard)))
    placed, transfers = assigned(docs.select("doc_id", "text", "was"), F.col("was"), shards)
    kept = {i: layout[i] for i in unchanged(transfers) if i < shards}
    changed = placed.where(~F.col("shard").isin(sorted(kept)))
    held = {j for _, _, j, _ in transfers} - set(kept)
    if held:
        _write(changed, path)
    return kept | {j: f"{path}/shard={j}" for j in held}


def read_layout(spark: SparkSession, layout: dict[int, str]) -> DataFrame:
    """doc_id, text, old_shard, slot, shard of the files that a layout names; old_shard is that of the shard's last writing."""
    out = spark.createDataFrame([], _FILE + ", shard int")
    for shard, folder in layout.items():
        out = out.unionByName(spark.read.schema(_FILE).parquet(folder).withColumn("shard", F.lit(shard)))
    return out
