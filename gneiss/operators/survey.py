"""Platforms and facts: weighted markers, the best analyser per tree, keys and values with their conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values: (platform, rank, kind, group, paths). A group counts once if any of its paths is there; strong
#: groups weigh their number twice, support once, and without a strong one there is no platform.
MARKERS = (
    [("linux", 1, "file", 1, (p,), True) for p in ("etc/passwd", "etc/inittab", "etc/fstab", "etc/shadow", "bin/busybox", "sbin/init", "bin/sh")]
    + [("linux", 1, "dir", 1, (p,), True) for p in ("etc/init.d", "etc/rc.d", "etc/systemd/system")]
    + [("linux", 1, "file", 2, ("etc/os-release", "usr/lib/os-release", "etc/openwrt_release", "etc/lsb-release"), True)]
    + [("linux", 1, "file", 1, (p,), False) for p in ("etc/group", "etc/hostname", "etc/resolv.conf", "usr/bin/env", "lib/ld.so.1", "etc/hosts")]
    + [("linux", 1, "dir", 1, (p,), False) for p in ("proc", "sys", "usr/lib", "var/log", "etc/network", "usr/bin")]
    + [("android", 2, "file", 1, ("build.prop", "system/build.prop", "default.prop"), True)]
    + [("android", 2, "file", 1, (p,), True) for p in ("bin/app_process", "bin/app_process32", "bin/app_process64", "system/bin/app_process64", "framework/framework.jar", "system/framework/framework.jar")]
    + [("android", 2, "dir", 1, (p,), True) for p in ("etc/permissions", "system/etc/permissions", "priv-app", "system/priv-app", "apex", "system/apex")]
    + [("android", 2, "file", 1, ("system/packages.xml", "system/users/userlist.xml"), True)]
    + [("android", 2, "dir", 1, (p,), False) for p in ("app", "system/app", "framework", "system/framework", "etc/init", "system/etc/init", "lib/hw", "vendor/lib/hw", "odm", "data/data", "misc/wifi", "etc/selinux", "system/etc/selinux")]
    + [("android", 2, "file", 1, (p,), False) for p in ("bin/toybox", "system/bin/toybox", "bin/toolbox", "init.rc", "etc/selinux/plat_sepolicy.cil")]
    + [("qnx", 2, "dir", 1, (p,), True) for p in ("proc/boot", "etc/system/config")]
    + [("qnx", 2, "file", 1, p, True) for p in (("usr/sbin/qconn", "bin/qconn"), ("etc/secpolgenerate.cfg", "lib64/libsecpol.so"))]
    + [("qnx", 2, "file", 1, (p,), False) for p in ("bin/ksh", "bin/slogger2", "bin/secpol", "bin/secpolgenerate", "bin/on", "sbin/chkqnx6fs", "sbin/mkqnx6fs", "etc/nopasswd", "etc/inetd.conf", "lib64/libslog2.so.1", "lib/libslog2.so.1")]
    + [("qnx", 2, "dir", 1, (p,), False) for p in ("proc/boot", "etc/system", "etc/system/config")]
)
PLATFORMS = ("linux", "android", "qnx")
MANAGER_DIRS, MANAGER_NAME, MOST_MANAGERS = ("sbin", "bin", "proc/boot", "usr/sbin"), r"^(devb-|devc-|io-)", 8


def path_index(entries: DataFrame) -> DataFrame:
    """Live entries (node, path, kind, ord ...), slashes stripped, the first of each path."""
    live = entries.where("NOT deleted AND NOT superseded").withColumn("path", F.btrim("path", F.lit("/"))).where("path <> ''")
    return live.withColumn("__n", F.row_number().over(W.partitionBy("node", "path").orderBy("ord"))).where("__n = 1").drop("__n")


def directories(index: DataFrame) -> DataFrame:
    """(node, path) of all directories, those that only a child's path implies included."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    implied = index.where(F.size(parts) > 1).select("node", F.explode(above).alias("path"))
    return index.where("kind = 'directory'").select("node", "path").union(implied).distinct()


def scores(index: DataFrame) -> DataFrame:
    """(node, platform, rank, score): strong markers twice, support once, none without a strong one."""
    spark = index.sparkSession
    rows = [(p, r, k, n, g, path, strong) for g, (p, r, k, n, paths, strong) in enumerate(MARKERS) for path in paths]
    markers = F.broadcast(spark.createDataFrame(rows, "platform string, rank int, what string, weight int, marker int, path string, strong boolean"))
    there = index.where("kind <> 'directory'").select("node", "path", F.lit("file").alias("what")).union(directories(index).withColumn("what", F.lit("dir")))
    hit = there.join(markers, ["path", "what"]).select("node", "platform", "rank", "marker", "weight", "strong").distinct()
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
    managers = index.where(parent.isin(*MANAGER_DIRS) & name.rlike(MANAGER_NAME)).groupBy("node").agg(F.count("*").alias("n"))
    managers = managers.select("node", F.lit("qnx").alias("platform"), F.lit(2).alias("rank"), (F.col("n") >= 2).cast("long").alias("s"), F.least("n", F.lit(MOST_MANAGERS)).alias("t"))
    weights = hit.select("node", "platform", "rank", F.when(F.col("strong"), F.col("weight")).otherwise(0).cast("long").alias("s"), F.when(F.col("strong"), 0).otherwise(F.col("weight")).cast("long").alias("t"))
    total = weights.unionByName(managers).groupBy("node", "platform", "rank").agg(F.sum("s").alias("strong"), F.sum("t").alias("support"))
    return total.where("strong > 0").select("node", "platform", "rank", (2 * F.col("strong") + F.col("support")).alias("score"))


def best(scored: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of each key's rows (by, platform, rank, score): the highest rank, then score, then the first in ``order``."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("platform"))
    window = W.partitionBy(*by).orderBy(F.col("rank").desc(), F.col("score").desc(), place, "platform")
    return scored.where("score > 0").withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def add_facts(facts: DataFrame, by: str = "node") -> DataFrame:
    """Facts (by, ord, key, value) without empty values and repeats: of equal (key, value) the first stays."""
    good = facts.where("coalesce(value, '') <> ''")
    return good.groupBy(by, "key", "value").agg(F.min("ord").alias("ord"))


def disagreements(facts: DataFrame, by: str = "node") -> DataFrame:
    """(by, key, n_values): keys with several values; all of them are kept."""
    return add_facts(facts, by).groupBy(by, "key").agg(F.count("*").alias("n_values")).where("n_values > 1")


def env_pairs(rows: DataFrame, by: list[str], text: str, separator: str = "\n") -> DataFrame:
    """(by, key, value) of k=v items: # comments and empty values dropped, matching quotes stripped, the first of a key wins."""
    items = rows.select(*by, F.posexplode(F.split(text, separator)).alias("pos", "line")).withColumn("line", F.trim("line"))
    items = items.where(~F.col("line").startswith("#") & (F.instr("line", "=") > 1))
    key = F.trim(F.substring_index("line", "=", 1))
    value = F.trim(F.expr("substring(line, instr(line, '=') + 1)"))
    quoted = F.regexp_extract(value, r"""^(["'])(.*)\1$""", 2)
    value = F.when(value.rlike(r"""^(["']).*\1$"""), quoted).otherwise(value)
    pairs = items.select(*by, key.alias("key"), value.alias("value"), "pos").where("value <> ''")
    return pairs.groupBy(*by, "key").agg(F.min_by("value", "pos").alias("value"))


def hash_kind(c: Column, in_shadow: bool) -> Column:
    """What kind of password hash a field holds."""
    return (
        F.when(c == "", "empty").when(c.isin("*", "!", "!!", "!*"), "locked").when(c == "x", "invalid" if in_shadow else "in-shadow")
        .when(c.startswith("@S@"), "qnx-strong").when(c.startswith("$1$"), "md5").when(c.startswith("$2"), "bcrypt").when(c.startswith("$5$"), "sha256")
        .when(c.startswith("$6$"), "sha512").when(c.startswith("$y$") | c.startswith("$7$"), "yescrypt").when(c.startswith("$"), "crypt-other")
        .when(F.octet_length(c) == 13, "descrypt").otherwise("unrecognised")
    )


def accounts(rows: DataFrame, text: str, in_shadow: bool) -> DataFrame:
    """(node, name, password) of the lines of passwd or shadow files."""
    lines = rows.select("node", F.explode(F.split(text, "\n")).alias("line")).where("trim(line) <> '' AND NOT startswith(line, '#')")
    parts = F.split("line", ":")
    return lines.where(F.size(parts) >= 2).select("node", parts[0].alias("name"), hash_kind(parts[1], in_shadow).alias("password")).where("name <> ''")


def json_facts(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, key, value) of a JSON object's top level: scalars as text, arrays as their counts; invalid texts give nothing."""
    top = F.from_json(text, "map<string,string>")
    good = F.when(F.expr(f"try_parse_json({text})").isNotNull(), top)
    pairs = rows.select(*by, F.explode(good).alias("key", "raw"))
    value = F.when(F.col("raw").startswith("["), F.json_array_length("raw").cast("string")).when(~F.col("raw").startswith("{"), F.col("raw"))
    return pairs.select(*by, "key", value.alias("value")).where("value IS NOT NULL")


def resolve_links(index: DataFrame, hops: int = 16) -> DataFrame:
    """(node, path, target): where a path ends after following symbolic links; null for loops and dead ends.

    Each hop is a join on the path; entries that are done leave the frontier.
    """
    links = index.where("kind = 'symlink'").select("node", "path", F.col("link_target").alias("to"))
    real = index.where("kind <> 'symlink'").select("node", "path")
    base = F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
    step = links.withColumn("target", _joined(base, F.col("to"))).select("node", "path", "target")
    nexts = step.select("node", F.col("path").alias("target"), F.col("target").alias("then"))
    out = step
    size = 1
    while size < hops:
        out = out.join(nexts, ["node", "target"], "left").select("node", "path", F.coalesce("then", "target").alias("target"))
        nexts = out.select("node", F.col("path").alias("target"), F.col("target").alias("then"))
        size *= 2
    known = real.select("node", F.col("path").alias("target"), F.lit(True).alias("there"))
    return out.join(known, ["node", "target"], "left").select("node", "path", F.when(F.col("there"), F.col("target")).alias("target"))


def _joined(base: Column, to: Column) -> Column:
    """A link's target as a path: absolute ones start at the root, ".." climbs and stops there."""
    whole = F.when(to.startswith("/"), to).otherwise(F.concat_ws("/", base, to))
    climb = lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(p)))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), climb), "/")
