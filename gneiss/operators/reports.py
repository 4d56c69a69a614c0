"""Reports: typed documents, rendered as Markdown or HTML, every text escaped by the renderer.

Only summaries of bounded size reach a document; rows beyond a list's cap are counted, not shown.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: characters that mean something to Markdown inside a table's cell.
MARKUP = r"([\\`*_{}\[\]<>#|~])"


@dataclass
class Paragraph:
    text: str


@dataclass
class Table:
    head: list[str]
    rows: list[list]


@dataclass
class KeyValues:
    pairs: list[tuple[str, str]]


@dataclass
class Callout:
    level: str
    text: str


@dataclass
class CodeBlock:
    text: str


@dataclass
class BulletList:
    items: list[str]


@dataclass
class Section:
    title: str
    blocks: list = field(default_factory=list)


@dataclass
class Document:
    title: str
    sections: list[Section] = field(default_factory=list)


def plain(x) -> str:
    return "" if x is None else str(x)


def md(x) -> str:
    """A text inside Markdown: markup escaped, line ends as spaces."""
    return re.sub(MARKUP, r"\\\1", re.sub(r"[\r\n]+", " ", plain(x)))


def md_cell(c: Column) -> Column:
    """md for a column."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[\r\n]+", " "), MARKUP, r"\\$1")


def md_row(*cells: Column) -> Column:
    """A table's row of a row's values."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(md_cell, cells)), F.lit(" |"))


def squared(t: Table) -> list[list]:
    """Rows as wide as the head: short ones filled, long ones cut."""
    n = len(t.head)
    return [[*r[:n], *[""] * (n - len(r))] for r in t.rows]


def md_table(t: Table) -> str:
    line = lambda cells: "| " + " | ".join(map(md, cells)) + " |"
    return "\n".join([line(t.head), "|" + "---|" * len(t.head), *map(line, squared(t))])


def _fence(text: str) -> str:
    """A fence longer than any run of backticks in the text."""
    return "`" * max(3, 1 + max(map(len, re.findall("`+", text)), default=0))


def markdown(d: Document) -> str:
    out = [f"# {md(d.title)}"]
    for s in d.sections:
        out.append(f"## {md(s.title)}")
        for b in s.blocks:
            match b:
                case Paragraph(text):
                    out.append(md(text))
                case Table():
                    out.append(md_table(b))
                case KeyValues(pairs):
                    out.append(md_table(Table(["key", "value"], [list(p) for p in pairs])))
                case Callout(level, text):
                    out.append(f"> **{md(level)}** {md(text)}")
                case CodeBlock(text):
                    out.append(f"{_fence(text)}\n{text}\n{_fence(text)}")
                case BulletList(items):
                    out.append("\n".join(f"- {md(x)}" for x in items))
    return "\n\n".join(out) + "\n"


def page(d: Document) -> str:
    """The document as one HTML page without scripts or outside references."""
    e = lambda x: html.escape(plain(x), quote=True)
    out = [f'<!DOCTYPE html>\n<html lang="en">\n<head><meta charset="utf-8"><title>{e(d.title)}</title></head>\n<body>\n<h1>{e(d.title)}</h1>']

    def table(t: Table) -> str:
        head = "".join(f"<th>{e(x)}</th>" for x in t.head)
        return f"<table>\n<tr>{head}</tr>\n" + "".join("<tr>" + "".join(f"<td>{e(x)}</td>" for x in r) + "</tr>\n" for r in squared(t)) + "</table>"

    for s in d.sections:
        out.append(f"<h2>{e(s.title)}</h2>")
        for b in s.blocks:
            match b:
                case Paragraph(text):
                    out.append(f"<p>{e(text)}</p>")
                case Table():
                    out.append(table(b))
                case KeyValues(pairs):
                    out.append(table(Table(["key", "value"], [list(p) for p in pairs])))
                case Callout(level, text):
                    out.append(f'<p class="{e(level)}"><strong>{e(level)}</strong> {e(text)}</p>')
                case CodeBlock(text):
                    out.append(f"<pre>{e(text)}</pre>")
                case BulletList(items):
                    out.append("<ul>" + "".join(f"<li>{e(x)}</li>" for x in items) + "</ul>")
    return "\n".join([*out, "</body>\n</html>\n"])


def capped_table(df: DataFrame, order: list, most: int = 200) -> tuple[Table, int]:
    """The first rows of a DataFrame as a table, and how many rows there are in all; ``most`` rows reach the driver."""
    total = df.count()
    rows = df.orderBy(*order).limit(most).collect()
    return Table(df.columns, [list(r) for r in rows]), total


def build_report(title: str, tables: dict[str, DataFrame], most: int = 200) -> Document:
    """The report of a case: evidence, structure, platforms, artifacts, hits, coverage and diagnostics.

    ``tables`` may hold evidence (path, sha256, state), nodes, findings, platforms, facts, records, hits, coverage and diagnostics;
    what was not produced has no section. Totals are exact, lists show the first ``most`` rows.
    """
    from gneiss.operators import rules, summaries

    out = Document(title)

    def add(name: str, *blocks) -> None:
        out.sections.append(Section(name, [b for b in blocks if b is not None]))

    def shown(df: DataFrame, *order) -> list:
        table, total = capped_table(df, list(order), most)
        return [table, Paragraph(f"{len(table.rows)} of {total} rows are shown.") if total > len(table.rows) else None]

    if "evidence" in tables:
        states = tables["evidence"].groupBy("state").agg(F.count("*").alias("n")).orderBy("state").collect()
        sound = bool(states) and all(r["state"] == "verified" for r in states)
        add("Evidence", Callout("info" if sound else "warning", "all evidence is verified" if sound else "not all evidence is verified"), *shown(tables["evidence"], "path"))
    if "findings" in tables:
        kept = tables["findings"].where("owner IS NULL")
        add("Structure", *shown(summaries.counts(kept, "format"), F.col("n").desc(), "format"), *shown(kept.select("image_id", "offset", "size", "format", "confidence"), "image_id", "offset", "format"))
    if "facts" in tables:
        add("Platforms", *shown(tables["platforms"], "node") if "platforms" in tables else [], *shown(tables["facts"].select("node", "key", "value", "source"), "node", "key", "value"))
    if "records" in tables:
        add("Extracted artifacts", *shown(summaries.counts(tables["records"], "kind"), "kind"))
    if "hits" in tables:
        add("Search hits", *shown(rules.summary(tables["hits"]), "by", "value"))
    if "coverage" in tables:
        add("Coverage and limits", *shown(tables["coverage"], "format"))
    if "diagnostics" in tables:
        add("Diagnostics", *shown(tables["diagnostics"].groupBy("code").agg(F.count("*").alias("n")), F.col("n").desc(), "code"))
    return out


def json_schema(schema: T.StructType, title: str) -> dict:
    """A table's rows as a JSON schema, draft 2020-12."""

    def of(t: T.DataType) -> dict:
        if isinstance(t, T.StructType):
            return {"type": "object", "properties": {f.name: of(f.dataType) for f in t.fields}, "required": [f.name for f in t.fields if not f.nullable], "additionalProperties": False}
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": of(t.elementType)}
        if isinstance(t, T.MapType):
            return {"type": "object", "additionalProperties": of(t.valueType)}
        if isinstance(t, T.IntegralType):
            return {"type": "integer"}
        if isinstance(t, (T.FractionalType, T.DecimalType)):
            return {"type": "number"}
        return {"type": "boolean"} if isinstance(t, T.BooleanType) else {"type": "string"}

    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": title, **of(schema)}
