"""Versions of a key: the live one, older and deleted ones, lookups as of a cutoff, runs of writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key: ``order`` sorts ascending by age, oldest first."""
    newest = W.partitionBy(*by).orderBy(*(c.desc() for c in order))
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def states(rows: DataFrame, live: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Adds version (1 = oldest), superseded (not the newest of a live key) and deleted (the key is not in ``live``)."""
    old, new = W.partitionBy(*by).orderBy(*order), W.partitionBy(*by).orderBy(*(c.desc() for c in order))
    marked = rows.join(live.select(*by).distinct().withColumn("__live", F.lit(True)), by, "left")
    is_live = F.coalesce("__live", F.lit(False))
    return marked.withColumns(
        {"version": F.row_number().over(old).cast("long"), "superseded": is_live & (F.row_number().over(new) > 1), "deleted": ~is_live}
    ).drop("__live")


def cap(rows: DataFrame, by: list[str], order: list[Column], most: int = 64) -> DataFrame:
    """The newest ``most`` rows of each key."""
    newest = W.partitionBy(*by).orderBy(*(c.desc() for c in order))
    return rows.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= most).drop("__n")


def cap_counts(rows: DataFrame, by: list[str], most: int = 64) -> DataFrame:
    """How many versions a key has and how many of them a cap drops; from an aggregate, so totals stay exact."""
    return rows.groupBy(*by).agg(F.count("*").alias("versions"), F.greatest(F.count("*") - most, F.lit(0).cast("long")).alias("dropped"))


def as_of(asked: DataFrame, rows: DataFrame, by: list[str], at: str, version: list[str], value: str, earliest: bool = False) -> DataFrame:
    """asked (by, at) with ``value`` of the newest row whose first version column is not after ``at``.

    Both sides are one ordered stream a key: a window carries the last row forward, so nothing is joined and
    no key's versions are multiplied by its questions. ``earliest``: where nothing is early enough, the first row.
    """
    first, *rest = version
    mine = rows.select(*by, F.col(first).alias("__t"), F.struct(*rest, F.col(value).alias("__v")).alias("__row"), F.lit(0).alias("__side"), F.lit(None).cast(asked.schema[at].dataType).alias(at))
    theirs = asked.select(*by, F.col(at).alias("__t"), F.lit(None).cast(mine.schema["__row"].dataType).alias("__row"), F.lit(1).alias("__side"), at)
    key = [F.col("__t"), F.col("__side"), *(F.col(f"__row.{c}") for c in rest)]
    carried = W.partitionBy(*by).orderBy(*key).rowsBetween(W.unboundedPreceding, 0)
    both = mine.unionByName(theirs).withColumn("__last", F.last("__row", ignorenulls=True).over(carried))
    if earliest:
        whole = W.partitionBy(*by).orderBy(*key).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        both = both.withColumn("__last", F.coalesce("__last", F.first("__row", ignorenulls=True).over(whole)))
    return both.where("__side = 1").select(*by, at, F.col("__last.__v").alias(value))


def write_groups(rows: DataFrame, by: list[str], order: list[Column], continues: Column) -> DataFrame:
    """Adds group: a row joins its predecessor's group where ``continues`` holds; lag() is available in it."""
    window = W.partitionBy(*by).orderBy(*order)
    fresh = F.when(F.row_number().over(window) == 1, 1).otherwise(F.when(continues, 0).otherwise(1))
    return rows.withColumn("__fresh", fresh).withColumn("group", F.sum("__fresh").over(window.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("__fresh")


def running_versions(rows: DataFrame, by: list[str], order: list[Column], raw: str) -> DataFrame:
    """Adds version: the raw number, or one more than the predecessor's where that is larger, in closed form."""
    window = W.partitionBy(*by).orderBy(*order)
    n = F.row_number().over(window)
    lifted = rows.withColumn("__n", n.cast("long")).withColumn("__lift", F.col(raw) - F.col("__n"))
    most = F.max("__lift").over(window.rowsBetween(W.unboundedPreceding, 0))
    return lifted.withColumn("version", F.col("__n") + F.greatest(F.lit(0).cast("long"), most)).drop("__n", "__lift")


def names(entries: DataFrame) -> DataFrame:
    """Live names of (parent, name, inode, version): the newest entry of each (parent, name), unless it unlinks (inode 0)."""
    return latest(entries, ["parent", "name"], [F.col("version")]).where("inode <> 0")


def orphan_name(name: Column, inode: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("lost+found/#"), inode.cast("string")))


def snapshot_diff(previous: DataFrame, current: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, state): added, removed, changed or same, of two snapshots with one row a key."""
    a, b = previous.select(*by, F.col(value).alias("__a"), F.lit(1).alias("__in_a")), current.select(*by, F.col(value).alias("__b"), F.lit(1).alias("__in_b"))
    both = a.join(b, by, "full_outer")
    state = F.when(F.col("__in_a").isNull(), "added").when(F.col("__in_b").isNull(), "removed").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("changed")
    return both.select(*by, state.alias("state"))
