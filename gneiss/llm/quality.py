"""Quality rules whose thresholds come from the corpus: quantile sketches per language and source.

Each document is measured once. Per (lang, source) each measure's values go into a KLL sketch,
which Spark builds map-side and merges; sketches of a language, and of the whole corpus, are merges
of the group sketches. A group takes its fences from the smallest of these levels that holds
``least_rows`` rows, so that a source of a few documents doesn't set its own. The upper fence of a measure is median + fence * (upper
quantile - median); the word length also has a lower one, median - fence * (median - lower quantile),
with the quantile of 1 - upper. Each gap counts as the measure's least spread at least. With quartiles a quarter of a
group may be junk on one side and the fences still hold. Documents are joined with their group's
fences and go where they lie outside of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import SPACE, give_back, materialize, slices

#: The shares that get adaptive fences, and the least spread that counts for each: a fence never comes closer to the median
#: than ``fence`` of them. At 3 that is 0.15 of repeated words where the base rule stands at 0.30.
MEASURES = {"symbol_share": 0.05, "dup_line_share": 0.1, "repeat_share": 0.05, "word_length": 0.4}
#: The measures that also have a fence below, with the least spread there; of the others, less is never junk.
BELOW = {"word_length": 0.75}

#: Rows that pass the base rules which a group or language must hold to set its own fences.
LEAST_ROWS = 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What is measured: the counts, and the lines that duplicate lines are a share of.
MEASURED = (*COUNTS, "n_lines")


def repeated_words(words: list, window: int = 8) -> int:
    """How many words stand in windows of ``window`` words that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    # windows get the same class if and only if they are equal: ranks of pairs, doubled up to the window's length
    size = 1
    while size < window:
        step = min(size, window - size)
        pair = ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        ids, size = np.unique(pair, return_inverse=True)[1].astype(np.int64), size + step
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[window : window + n] -= again
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a whole text; lines of white space don't count."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # of bytes, this cuts at the white space of the contract and no other
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    chars = len(text) - sum(map(text.count, SPACE.decode()))
    return len(words), chars, sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measured(docs: DataFrame) -> DataFrame:
    """The input's columns and, named __q_..., the measured counts; no shuffle."""
    names, at = docs.columns, docs.columns.index("text")
    counts = [f"__q_{c}" for c in MEASURED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [measure(t.as_py()) for t in batch.column(at)]
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(len(counts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *counts])
        give_back()

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counts)])
    return docs.mapInArrow(run, schema)


def _judged(rows: DataFrame, fences: DataFrame, min_words: int, most_repeat_percent: int) -> DataFrame:
    """Measured rows with __q_base_failed and __q_reason, which is empty for rows that stay."""
    group = F.col("lang").eqNullSafe(F.col("__q_lang")) & F.col("source").eqNullSafe(F.col("__q_source"))
    joined = _shares(rows, min_words, most_repeat_percent).join(fences, group, "left")
    under = {m: F.col(f"__q_{m}") < F.col(f"__q_least_{m}") for m in BELOW}
    over = [F.when((F.col(f"__q_{m}") > F.col(f"__q_most_{m}")) | under.get(m, F.lit(False)), F.lit(m)) for m in MEASURES]
    return joined.withColumn("__q_reason", F.concat_ws(",", F.when(F.col("__q_base_failed"), F.lit("base")), *over))


def _shares(rows: DataFrame, min_words: int, most_repeat_percent: int) -> DataFrame:
    n, repeat = F.col("__q_n_words"), F.col("__q_n_repeat_words")
    words = F.greatest(n, F.lit(1))
    return rows.withColumns(
        {
            "__q_base_failed": (n < min_words) | (100 * repeat > most_repeat_percent * n),
            "__q_symbol_share": F.col("__q_n_symbols") / words,
            "__q_dup_line_share": F.col("__q_n_dup_lines") / F.greatest(F.col("__q_n_lines"), F.lit(1)),
            "__q_repeat_share": repeat / words,
            "__q_word_length": F.col("__q_word_chars") / words,
        }
    )


def quality(docs: DataFrame, min_words: int = 20, most_repeat_percent: int = 30, upper: float = 0.75, fence: float = 3.0) -> DataFrame:
    """doc_id, lang, source, the five counts, base_failed, kept, reason: one row per input row.

    base_failed: fewer than min_words words, or more than most_repeat_percent percent of the words in
    repeated windows. kept is false there, and where a share lies outside its group's fences. Sketches are
    filled with the documents that pass the base rules. Null languages and sources are groups of
    their own; a null text has no words; repeated rows and null ids stay; extra columns are ignored;
    an empty table gives an empty result.

    Groups of fewer than ``LEAST_ROWS`` rows take the fences of their language, or of the corpus.
    The fences are one row per group. Their table is joined by Spark's choice: broadcast where its
    size is within spark.sql.autoBroadcastJoinThreshold, else by a sort-merge join whose hot
    partitions adaptive execution splits.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")))
    rows = materialize(measured(slim).drop("text"), "measured")
    judged = _judged(rows, thresholds(rows, min_words, most_repeat_percent, upper, fence), min_words, most_repeat_percent)
    return judged.select(
        "doc_id", "lang", "source", *(F.col(f"__q_{c}").alias(c) for c in COUNTS),
        F.col("__q_base_failed").alias("base_failed"), (F.col("__q_reason") == "").alias("kept"), F.col("__q_reason").alias("reason"),
    )


def keep_good(docs: DataFrame, min_words: int = 20, most_repeat_percent: int = 30, upper: float = 0.75, fence: float = 3.0) -> DataFrame:
    """The input's rows and columns less the rows that ``quality`` would reject; texts are measured twice and never shuffled."""
    fences = thresholds(measured(docs.select("text", "lang", "source")).drop("text"), min_words, most_repeat_percent, upper, fence)
    fences = materialize(fences, "fences")  # one row a group
    return _judged(measured(docs), fences, min_words, most_repeat_percent).where(F.col("__q_reason") == "").select(*docs.columns)


def thresholds(rows: DataFrame, min_words: int, most_repeat_percent: int, upper: float, fence: float, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The fences of each measure for each language and source, from merged KLL sketches of the rows that pass the base rules.

    The level is the group, its language or the corpus: the first that holds ``least_rows`` such rows, else the corpus.
    """
    rows = _shares(rows, min_words, most_repeat_percent).where(~F.col("__q_base_failed"))
    sketches = rows.groupBy(F.col("lang").alias("__q_lang"), F.col("source").alias("__q_source")).agg(
        F.count("*").alias("n"), *(F.kll_sketch_agg_double(F.col(f"__q_{m}")).alias(m) for m in MEASURES)
    )
    sketches = materialize(sketches, "sketches")
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(F.col(m)).alias(m) for m in MEASURES)]
    languages = sketches.groupBy(F.col("__q_lang").alias("__q_of")).agg(*merged)
    corpus = sketches.agg(*merged)
    names = ["n", *MEASURES]
    level = lambda df, x: df.select(*[c for c in df.columns if c not in names], F.struct(*names).alias(x))
    same = F.col("__q_lang").eqNullSafe(F.col("__q_of"))
    levels = level(sketches, "own").join(level(languages, "wide"), same).crossJoin(F.broadcast(level(corpus, "all")))
    chosen = F.when(F.col("own.n") >= least_rows, F.col("own")).when(F.col("wide.n") >= least_rows, F.col("wide")).otherwise(F.col("all"))
    return levels.select("__q_lang", "__q_source", chosen.alias("x")).select("__q_lang", "__q_source", "x.*").select("__q_lang", "__q_source", *_fences(upper, fence))


def _fences(upper: float, fence: float) -> list[Column]:
    out = []
    for m, least in MEASURES.items():
        low, mid, top = (F.kll_sketch_get_quantile_double(F.col(m), F.lit(q)) for q in (1 - upper, 0.5, upper))
        out.append((mid + fence * F.greatest(top - mid, F.lit(least))).alias(f"__q_most_{m}"))
        if m in BELOW:
            out.append((mid - fence * F.greatest(mid - low, F.lit(BELOW[m]))).alias(f"__q_least_{m}"))
    return out
