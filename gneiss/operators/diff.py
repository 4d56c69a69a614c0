"""Comparing two cases: files by path and content, facts by key, records by identity and field, symbols by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How many rows of a list are shown, and how much of a joined text.
SHOWN, TEXT_SHOWN, LABEL_SHOWN = 200, 300, 120


def flatten(entries: DataFrame) -> DataFrame:
    """One row per path of (path, sha256, node, ord, size): the sorted set of contents, the first node and size, and how many rows."""
    good = entries.where("path IS NOT NULL AND coalesce(sha256, '') <> ''")
    return good.groupBy("path").agg(
        F.array_sort(F.collect_set("sha256")).alias("contents"), F.min_by("node", "ord").alias("node"), F.min_by("size", "ord").alias("size"), F.count("*").alias("entries")
    )


def files(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, state, sha_a, sha_b) of two flattened sides: same, changed, removed or added; the shown content is the smallest."""
    x = a.select("path", F.col("contents").alias("a"))
    y = b.select("path", F.col("contents").alias("b"))
    state = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return x.join(y, "path", "full_outer").select("path", state.alias("state"), F.array_min("a").alias("sha_a"), F.array_min("b").alias("sha_b"))


def contents(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: distinct contents of both sides, those in common, and of these the moved ones: never at a shared path."""
    of = lambda d: d.select(F.explode("contents").alias("sha"))
    common = of(a).intersect(of(b))
    x, y = a.select("path", F.col("contents").alias("x")), b.select("path", F.col("contents").alias("y"))
    at_shared = x.join(y, "path").select(F.explode(F.array_intersect("x", "y")).alias("sha")).distinct()
    moved = common.join(at_shared, "sha", "left_anti")
    count = lambda d, name: d.agg(F.count("*").alias(name))
    return (
        of(a).agg(F.count_distinct("sha").alias("distinct_a")).join(of(b).agg(F.count_distinct("sha").alias("distinct_b")))
        .join(count(common, "common")).join(count(moved, "moved"))
    )  # fmt: skip  # four tables of one row each


def shown(values: Column) -> Column:
    """A set of values as one text, cut after TEXT_SHOWN characters."""
    text = F.array_join(F.array_sort(values), " | ")
    return F.when(F.length(text) > TEXT_SHOWN, F.concat(F.substring(text, 1, TEXT_SHOWN), F.lit("..."))).otherwise(text)


def facts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, state, value_a, value_b) of facts (key, value): value sets are compared, joined texts shown."""
    x = a.groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("a"))
    y = b.groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("b"))
    state = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return x.join(y, "key", "full_outer").select("key", state.alias("state"), shown(F.col("a")).alias("value_a"), shown(F.col("b")).alias("value_b"))


def records(a: DataFrame, b: DataFrame) -> DataFrame:
    """(kind, identity, state, changed) of records (kind, identity, path, ord, fields map): per key the first counts.

    changed are the names of the fields that differ, sorted; a record that is equal but for its path has moved.
    """

    def side(d: DataFrame, s: str) -> DataFrame:
        key = F.coalesce(F.when(F.col("identity") != "", F.col("identity")), F.col("path"))
        first = d.withColumn("identity", key).withColumn("__n", F.row_number().over(W.partitionBy("kind", "identity").orderBy("ord", "path"))).where("__n = 1")
        return first.select("kind", "identity", F.col("path").alias(f"path_{s}"), F.col("fields").alias(f"fields_{s}"))

    both = side(a, "a").join(side(b, "b"), ["kind", "identity"], "full_outer")
    differ = F.map_filter(F.map_zip_with("fields_a", "fields_b", lambda k, x, y: ~x.eqNullSafe(y)), lambda k, v: v)
    changed = F.array_sort(F.map_keys(differ))
    state = (
        F.when(F.col("path_b").isNull(), "removed").when(F.col("path_a").isNull(), "added").when(F.size(changed) > 0, "changed")
        .when(F.col("path_a") != F.col("path_b"), "moved").otherwise("same")
    )
    return both.select("kind", "identity", state.alias("state"), F.coalesce(F.array_join(changed, ","), F.lit("")).alias("changed"))


def label(fields: Column) -> Column:
    """What a record is called: its first telling field."""
    return F.substring(F.coalesce(*(F.nullif(fields[k], F.lit("")) for k in ("subject", "module", "banner", "version", "first_subject")), F.lit("")), 1, LABEL_SHOWN)


def symbol_names(lines: Column) -> Column:
    """The last token of a line."""
    return F.regexp_extract(F.rtrim(lines), r"(\S+)$", 1)


def symbols(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, state) of symbol names: common, only_a or only_b. Where one side has none, the names are left out; counts are of symbol_counts."""
    x, y = a.select("name").where("name <> ''").distinct().withColumn("a", F.lit(True)), b.select("name").where("name <> ''").distinct().withColumn("b", F.lit(True))
    state = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("common")
    return x.join(y, "name", "full_outer").select("name", state.alias("state"))


def totals(states: DataFrame) -> DataFrame:
    """(state, total): exact, whatever is shown."""
    return states.groupBy("state").agg(F.count("*").alias("total"))


def shown_rows(states: DataFrame, by: str, most: int = SHOWN) -> DataFrame:
    """The first ``most`` rows of each state by key, each with its state's exact total."""
    first = states.withColumn("__n", F.row_number().over(W.partitionBy("state").orderBy(by))).where(F.col("__n") <= most).drop("__n")
    return first.join(totals(states), "state")


def identical(*all_states: DataFrame) -> DataFrame:
    """One row: whether every list holds nothing but same and common rows."""
    out = None
    for s in all_states:
        own = s.select((~F.col("state").isin("same", "common")).cast("long").alias("differs"))
        out = own if out is None else out.unionByName(own)
    return out.agg((F.coalesce(F.sum("differs"), F.lit(0)) == 0).alias("identical"))


def recovery(truth: DataFrame, found: DataFrame, by: list[str], item: str) -> DataFrame:
    """(by, expected, recovered, share): which share of the distinct true items was found."""
    want = truth.select(*by, item).distinct()
    got = want.join(found.select(item).distinct().withColumn("__found", F.lit(1)), item, "left")
    return got.groupBy(*by).agg(F.count("*").alias("expected"), F.count("__found").alias("recovered")).withColumn("share", F.round(F.col("recovered") / F.col("expected"), 6))


def empty_cases(a: DataFrame, b: DataFrame) -> DataFrame:
    """(code, side) of each side that holds no entry: then everything on the other one looks removed or added."""
    empty = lambda d, side: d.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("diff-case-empty").alias("code"), F.lit(side).alias("side"))
    return empty(a, "a").unionByName(empty(b, "b"))
