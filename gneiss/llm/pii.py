"""Personal data: fixed patterns, and terms that give a protected entity away.

The patterns find e-mail addresses, IP addresses, payment cards and phone numbers. Each found value
is a protected entity. Any word of a document that holds an entity may disclose it: over the corpus,
with c(e, t) the documents that hold both, c(e) those that hold e, c(t) those that hold t, and N all
documents, log(c(e, t) N / (c(e) (c(t) + 2))) is what t tells about e, and log(N / c(e)) is what there
is to know. The 2 are documents yet unseen that hold t without e: they keep words seen once or twice
from telling all, and fade as counts grow. A term whose share reaches ``remove`` is removed
wherever it stands in the entity's documents, one that reaches ``generalise`` is generalised to its shape.

Documents without personal data get no span and no change.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch, materialize, slices

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, as the contract states them; the look-behind only spares tries that must fail.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?()[]{}\"'“”«»…"

#: Documents added to each word's count: those yet unseen that hold it without the entity.
UNSEEN = 2

#: Distinct words that a task counts before it hands the counts on.
HELD_WORDS = 200_000


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern, found from each @ on, so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start: leftmost non-overlapping matches per kind that pass their check."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in PATTERNS["ip"].finditer(text) if "." in text else ():
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in PATTERNS["card"].finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in PATTERNS["phone"].finditer(text) if "+" in text else ():
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def entity(kind: str, value: str) -> str:
    """One name for the spellings of a value."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', value)}"


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(term, start, end): words without punctuation at their ends, lower-cased."""
    out = []
    for m in _WORD.finditer(text):
        w = m[0]
        left = len(w) - len(w.lstrip(_EDGE))
        core = w.strip(_EDGE)
        if core:
            out.append((core.lower(), m.start() + left, m.start() + left + len(core)))
    return out


def terms_beside(text: str, spans: list[tuple[str, int, int]]) -> dict[str, list[tuple[int, int]]]:
    """The words of a whole text, each with all places where it stands clear of the base spans."""
    merged: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    out: dict[str, list[tuple[int, int]]] = {}
    k = 0
    for word, x, y in words_of(text):
        while k < len(merged) and merged[k][1] <= x:
            k += 1
        if k == len(merged) or merged[k][0] >= y:
            out.setdefault(word, []).append((x, y))
    return out


_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
#: Words with their places: starts and ends in turn, as unsigned 32-bit little-endian numbers, which take an eighth of arrays of structs.
_WORDS = pa.list_(pa.struct([("term", pa.string()), ("at", pa.binary())]))
_SPANS = "array<struct<kind:string,start:long,end:long>>"
_TERMS = "array<struct<start:long,end:long,share:double>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its base spans, its distinct entities, and, where there are any, its words with their places."""
    for batch in slices(batches):
        base, entities, words = [], [], []
        for text in batch.column(2):
            text = text.as_py() or ""
            spans = base_spans(text)
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            entities.append(sorted({entity(k, text[a:b]) for k, a, b in spans}))
            beside = terms_beside(text, spans) if spans else {}
            words.append([{"term": t, "at": np.array(at, "<u4").tobytes()} for t, at in beside.items()])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(base, _KIND), pa.array(entities, pa.list_(pa.string())), pa.array(words, _WORDS)],
            ["doc_id", "text_key", "base", "entities", "words"],
        )


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): in how many documents of the task each word stands, handed on whenever the table is full."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            # of bytes, split() cuts at the same white space as words_of
            raw = {w.decode().strip(_EDGE).lower() for w in set((text.as_py() or "").encode().split())}
            raw.discard("")
            counts.update(raw)
            if len(counts) > HELD_WORDS:
                yield flush()
    yield flush()


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's spans of terms, in order, from its terms' shares and places."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
    for batch in batches:
        out = []
        for shares, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            spans = sorted((a, b, x) for x, raw in zip(shares, places, strict=True) for a, b in np.frombuffer(raw, "<u4").reshape(-1, 2).tolist())
            out.append([{"start": a, "end": b, "share": x} for a, b, x in spans])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["id", "key", "terms"])


def disclosing_terms(scratch: Scratch, docs: DataFrame, found: DataFrame, generalise: float = 0.8) -> DataFrame:
    """id, key, term, at, share: the terms that tell at least ``generalise`` of what there is to know about an entity of
    their document, with the largest such share and all places where they stand.

    ``found`` has a row per document. Everything is counted over all documents; repeated rows count as often
    as they stand there. A word and an entity become a pair only where the word's own count leaves it a chance:
    c(e, t) is at most c(t) and c(e). Words' counts meet pre-aggregated per task.
    """
    held = found.where(F.size("entities") > 0).groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    held = scratch.put(held.agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("words").alias("words")), "held")
    total = F.lit(float(found.count()))
    each = held.select("id", "key", "copies", F.explode("entities").alias("entity"))
    known = each.groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    each = each.join(known.hint("merge"), "entity").select(F.col("id").alias("of"), F.col("key").alias("of_key"), "entity", "n_entity")
    vocabulary = docs.select(F.col("text").cast("string")).mapInArrow(_vocabulary, "term string, n long")
    vocabulary = vocabulary.groupBy("term").agg(F.sum("n").alias("n_term"))
    words = held.select("id", "key", "copies", F.explode("words").alias("x")).select("id", "key", "copies", "x.term", "x.at")
    words = words.join(vocabulary.hint("merge"), "term", "left").withColumn("n_term", F.coalesce("n_term", F.lit(1)))

    def share(n_both: Column) -> Column:
        told = F.log(n_both * total / (F.col("n_entity") * (F.greatest("n_term", n_both) + UNSEEN)))
        there = F.log(total / F.col("n_entity"))
        return F.when(there > 0, told / there).otherwise(F.lit(0.0))

    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))
    chance = share(F.least("n_term", "n_entity")) >= generalise
    pairs = scratch.put(words.join(each.hint("merge"), same & chance).drop("of", "of_key"), "pairs")
    joint = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    joint = joint.select("entity", "term", share(F.col("n_both")).alias("share")).where(F.col("share") >= generalise)
    told = pairs.select("id", "key", "entity", "term", "at").join(joint.hint("merge"), ["entity", "term"])
    return told.groupBy("id", "key", "term").agg(F.max("share").alias("share"), F.first("at").alias("at"))


def shape(word: str) -> str:
    """A word's shape: letters and digits by kind, runs cut short."""
    return re.sub(r"(.)\1{2,}", r"\1\1", "".join("9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word))


def find_spans(docs: DataFrame, generalise: float = 0.8) -> DataFrame:
    """doc_id, text_key, base, terms: one row per input row.

    base are the patterns' spans (kind, start, end) by kind, then start, in code points, end
    exclusive; terms are the spans (start, end, share) of all occurrences of terms that disclose one of
    the row's own entities. text_key tells rows with one doc_id and different texts apart. A null text is
    empty; repeated rows count and come out as often as they stand there; extra columns are ignored.
    Texts are not shuffled: only spans and terms are.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(
        docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
            _find, f"doc_id long, text_key long, base {_SPANS}, entities array<string>, words array<struct<term:string,at:binary>>"
        ),
        "found",
    )
    with Scratch(docs.sparkSession) as scratch:
        told = materialize(disclosing_terms(scratch, docs, found, generalise), "told")
    # a document's terms are as many as it has words, and so are its places
    terms = told.groupBy("id", "key").agg(F.collect_list("share").alias("shares"), F.collect_list("at").alias("places")).mapInArrow(_places, f"id long, key long, terms {_TERMS}")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))
    none = F.array().cast(_TERMS)
    return found.join(terms.hint("merge"), same, "left").select("doc_id", "text_key", "base", F.coalesce("terms", none).alias("terms"))


def _sanitise(remove: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, base, terms in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                text, parts, at = text.as_py() or "", [], 0
                spans = [(x["start"], x["end"], f"[{x['kind'].upper()}]") for x in base.as_py() or []]
                for x in terms.as_py() or []:
                    spans.append((x["start"], x["end"], "" if x["share"] >= remove else shape(text[x["start"] : x["end"]])))
                for a, b, instead in sorted(spans):
                    if b > at:
                        parts += [text[at : max(a, at)], instead]
                        at = b
                out.append("".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "clean_text"])

    return run


def sanitise(docs: DataFrame, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """The input's columns, with the sanitised text in ``text`` and its length in ``n_chars`` where that column exists.

    Base spans stand as [KIND]; terms whose share reaches ``remove`` are left out, the others are
    generalised to their shape. Texts without spans stay as they are, null included.
    """
    spans = find_spans(docs, generalise).where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["doc_id", "text_key"])
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("base").alias("__base"), F.col("terms").alias("__terms"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    joined = docs.join(spans.hint("merge"), same, "left").drop("__id", "__key")
    names = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            clean = next(_sanitise(remove)(iter([batch.select(["doc_id", "text", "__base", "__terms"])]))).column(1)
            had = batch.column("text")
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array([c if t is not None else None for c, t in zip(clean.to_pylist(), had.to_pylist(), strict=True)], had.type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in columns["text"].to_pylist()], pa.int64()).cast(batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return joined.mapInArrow(run, docs.schema)
