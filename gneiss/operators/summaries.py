"""Counts, tallies, folds, record merging and tree walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.lineage import cut

SEVERITIES = ("info", "warning", "error")


def counts(rows: DataFrame, by: str, name: str = "n") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias(name))


def counts_wide(rows: DataFrame, by: str, kind: str, kinds: list[str]) -> DataFrame:
    """One row a key, one column a kind."""
    return rows.groupBy(by).agg(*(F.count_if(F.col(kind) == k).alias(k) for k in kinds))


def tally(diagnostics: DataFrame) -> DataFrame:
    """(severity, code, n, first_owner, message) of warnings and errors (severity, code, owner, ord, message), worst first, then most."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    rows = diagnostics.where(F.col("severity").isin("warning", "error")).groupBy("severity", "code").agg(
        F.count("*").alias("n"), F.min_by("owner", "ord").alias("first_owner"), F.min_by("message", "ord").alias("message")
    )
    return rows.orderBy(rank.desc(), F.col("n").desc(), "code")


def fold_coverage(rows: DataFrame) -> DataFrame:
    """(format, ord, status, detail) of coverage events (ord, format, status, detail), in order.

    A later status overwrites, but supported never overwrites partial; an empty detail keeps the old one.
    Closed form: the last status, where supported after a partial that nothing else followed counts as partial.
    """
    events = rows.groupBy("format").agg(F.array_sort(F.collect_list(F.struct("ord", "status", "detail"))).alias("all"))
    step = lambda acc, e: F.struct(
        F.when((acc["status"] == "partial") & (e["status"] == "supported"), acc["status"]).otherwise(e["status"]).alias("status"),
        F.when(F.coalesce(e["detail"], F.lit("")) == "", acc["detail"]).otherwise(e["detail"]).alias("detail"),
    )
    start = F.struct(F.lit("").alias("status"), F.lit("").alias("detail"))
    state = F.aggregate("all", start, step)
    return events.select("format", F.col("all")[0]["ord"].alias("ord"), state["status"].alias("status"), state["detail"].alias("detail"))


def merge_records(records: DataFrame, by: list[str], order: str, fields: str = "fields", severity: str | None = None) -> DataFrame:
    """One record a key: per field the sum if all its values are digits, else the first value that is there.

    Of rows alike in ``order`` any may be the first, so it should tell all rows apart.
    """
    parts = records.select(*by, order, F.explode(fields).alias("field", "value"))
    digits = F.col("value").rlike("^[0-9]+$")
    merged = parts.groupBy(*by, "field").agg(
        F.when(F.bool_and(digits), F.sum(F.when(digits, F.col("value").cast("decimal(38,0)"))).cast("string")).otherwise(F.min_by("value", F.when(F.col("value").isNotNull(), F.col(order)))).alias("value")
    )
    out = merged.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias(fields))
    if severity:
        rank = F.array_position(F.array(*map(F.lit, ("info", "low", "medium", "high", "critical"))), F.col(severity))
        out = out.join(records.groupBy(*by).agg(F.max_by(severity, rank).alias(severity)), by)
    return out


def merge_values(rows: DataFrame, by: list[str], value: str, order: list[Column]) -> DataFrame:
    """The same rule for one long-form field: (by, value)."""
    digits = F.col(value).rlike("^[0-9]+$")
    total = F.sum(F.when(digits, F.col(value).cast("decimal(38,0)"))).cast("string")
    return rows.groupBy(*by).agg(F.when(F.bool_and(digits), total).otherwise(F.min_by(value, F.struct(*order))).alias("value"))


def tree_walk(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent_id, ord) with depth and key: in the order of key a tree is walked depth first, children by ord.

    Nodes without a known parent are roots. Levels are added until one is empty, whatever the depth. Nodes on a
    cycle, and those below one, are reached from no root: they come out with a null depth and key.
    """
    orphans = nodes.join(nodes.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_anti")
    pad = F.format_string("%012d", "ord")
    level = cut(orphans.select("id", "parent_id", "ord", F.lit(0).alias("depth"), pad.alias("key")))
    out, d = level, 0
    while not level.isEmpty():
        d += 1
        above = level.select(F.col("id").alias("parent_id"), F.col("key").alias("above"))
        level = cut(nodes.join(above, "parent_id").select("id", "parent_id", "ord", F.lit(d).alias("depth"), F.concat_ws("/", "above", pad).alias("key")))
        out = out.unionByName(level)
    lost = nodes.join(out.select("id"), "id", "left_anti")
    return out.unionByName(lost.select("id", "parent_id", "ord", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("key")))
