"""One run over images: findings, gaps, nested files, hits, platforms, records, and what could not be read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators import discovery, extraction, facts, graph, intervals, records, rules, sinks
from gneiss.operators.lineage import cut


@dataclass(frozen=True)
class Run:
    """The parameters of a run; None lifts a limit."""

    packs: tuple[str, ...] | None = ("credentials", "network", "pii")
    history: bool = True
    depth: int = 8
    files: int | None = None
    total_bytes: int | None = None
    file_bytes: int | None = None
    hits: int | None = None
    hits_per_rule: int | None = None
    carve_all: bool = False
    carve_bytes: int = 1 << 31
    correct_words: bool = True
    survey: bool = True
    artifacts: bool = True


_NONE = (1 << 62) - 1


def analyze(images: DataFrame, run: Run | None = None) -> dict[str, DataFrame]:
    """The tables of a case of images (image_id, content): images, findings, gaps, nodes, carves, entries, hits, platforms, facts, records, symbols, coverage and diagnostics.

    Images are rows of bounded size. Each of the large tables is cut from its lineage once it is made, so a lost executor
    costs a step, and no step is done twice.
    """
    run = run or Run()
    views = sinks.corrected_copy(images) if run.correct_words else images.withColumns({"word_swap": F.lit(0), "confidence": F.lit(0), "evidence": F.lit(""), "sha256": F.sha2("content", 256)})
    views = cut(views)
    findings = cut(discovery.scan(views.select(F.col("image_id").alias("source_id"), "content")))
    kept = findings.where("owner IS NULL")
    size = views.select("image_id", F.octet_length("content").cast("long").alias("image_size"))

    claims = kept.select("image_id", F.col("offset").alias("off"), (F.col("offset") + F.col("size")).alias("stop"))
    ends = size.select("image_id", F.lit(0).cast("long").alias("off"), F.lit(0).cast("long").alias("stop"), "image_size")
    spans = claims.join(size, "image_id").unionByName(ends)
    gaps = intervals.gaps(spans, ["image_id"], F.max("image_size"))
    regions = sinks.carve(views, gaps.select("image_id", F.lit("").alias("id"), F.col("gap_off").alias("offset"), (F.col("gap_end") - F.col("gap_off")).alias("length")))
    gaps = cut(regions.select("image_id", "offset", "length", "content", graph.describe_gap(F.col("content")).alias("g")).select("image_id", "offset", "length", "content", "g.*"))

    # every find that a reader knows is opened; tables open to partitions, and what these hold is found by its magic
    readable = sinks.carve(views, kept.where("size > 0").select("image_id", F.concat_ws("@", "format", F.col("offset").cast("string")).alias("id"), "offset", F.col("size").alias("length"), "format").select("image_id", "id", "offset", "length"))
    formats = kept.select("image_id", "offset", F.concat_ws("@", "format", F.col("offset").cast("string")).alias("id"), F.col("format").alias("found"))
    outer = readable.join(formats.drop("offset"), ["image_id", "id"]).where(F.col("found").isin(*extraction.readable()) & ~F.col("found").isin("gpt", "mbr"))
    tables = kept.where("format IN ('gpt', 'mbr')").select("image_id", "offset", "format").join(views.select("image_id", "content"), "image_id")
    tables = tables.where("offset = 0").groupBy("image_id", "offset").agg(F.min("format").alias("format"), F.first("content").alias("content"))
    blobs = outer.select(F.concat_ws("/", "image_id", "id").alias("node_id"), F.col("found").alias("format"), "content")
    blobs = blobs.unionByName(tables.select(F.concat_ws("/", "image_id", F.col("format")).alias("node_id"), "format", "content"))
    entries = extraction.descend(blobs, extraction.format_of, run.depth)
    if not run.history:
        entries = entries.where("NOT deleted AND NOT superseded")
    entries = cut(extraction.limited(entries, run.files or _NONE, run.total_bytes or _NONE, run.file_bytes or (1 << 31) - 1))

    order = F.monotonically_increasing_id()
    listed = entries.select(F.col("node_id").alias("node"), F.col("entry_ord").alias("ord"), "path", "kind", "link_target", "deleted", "superseded", "written", "entry_ord", "content", F.coalesce("size", F.lit(0)).alias("bytes"))
    out = {"images": views.drop("content"), "findings": findings, "gaps": gaps.drop("content"), "entries": entries}
    nodes = kept.withColumn("also", F.array().cast("array<struct<format:string,signature:string,offset:long,confidence:int>>"))
    out["nodes"] = graph.nodes_from_findings(nodes)
    if run.carve_all:
        out["carves"] = sinks.carve(views, kept.where((F.col("size") > 0) & (F.col("size") <= run.carve_bytes)).select("image_id", F.concat_ws("@", "format", F.col("offset").cast("string")).alias("id"), "offset", F.col("size").alias("length"))).drop("content")
    if run.packs:
        swept = rules.select_files(listed).select("node", "path", F.col("content").alias("content"), F.lit(False).alias("region"))
        regions = gaps.where("coalesce(class, '') NOT IN ('erased', 'random')").select(F.col("image_id").alias("node"), F.concat(F.lit("@"), F.col("offset").cast("string")).alias("path"), "content", F.lit(True).alias("region"))
        items = cut(swept.unionByName(regions).withColumn("item", order))
        out["hits"] = cut(rules.sweep(items, rules.builtin(*run.packs), run.hits, None, run.hits_per_rule))
    problems = entries.select(F.col("node_id").alias("node"), F.explode("diagnostics").alias("message")).select("node", F.regexp_extract("message", r"^([a-z0-9-]+)", 1).alias("code"), "message")
    problems = problems.unionByName(findings.select(F.col("image_id").alias("node"), F.explode("diagnostics").alias("code")).withColumn("message", F.col("code")))
    if run.survey:
        out["platforms"], out["facts"], said = facts.describe(listed.select("node", "ord", "path", "kind", "link_target", "deleted", "superseded", "content"))
        problems = problems.unionByName(said)
    if run.artifacts:
        examined = cut(records.examine(listed.select("node", "entry_ord", "path", "kind", "deleted", "superseded", "written", "content")))
        out["records"] = records.collect(examined)
        kernels = listed.where("kind = 'regular' AND written").join(examined.where("kind = 'linux-kernel'").select("node", "path").distinct(), ["node", "path"], "left_semi")
        out["symbols"] = records.kernel_symbols(kernels)
        problems = problems.unionByName(examined.where("code IS NOT NULL").select("node", "code", "message"))
    out["diagnostics"] = problems
    opened = entries.groupBy("node_id").agg(F.count("*").alias("entries"), F.count_if(F.col("kind") == "diagnostic").alias("failed"))
    out["coverage"] = opened.select(F.regexp_replace(F.regexp_extract("node_id", "/([^/]*)$", 1), "@.*", "").alias("format"), "entries", "failed").groupBy("format").agg(F.count("*").alias("nodes"), F.sum("entries").alias("entries"), F.sum("failed").alias("failed"))
    return out
