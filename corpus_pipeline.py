"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, personal data, packing.

Each stage works on what its predecessor kept, written as Parquet in the shared folder and read
again, so that a lost executor never costs more than the stage at work. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm import linededup, packing, pii, quality, setsketch
from gneiss.llm.common import delete_path, materialize, new_path, table
from gneiss.llm.queries import tokenizer_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: base rules, then fences of their language and source.

    Null texts have no words and go; null languages and sources are groups of their own; repeated rows are judged alike;
    further columns stay.
    """
    return quality.keep_good(docs)


def without_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all documents; each row is a document.

    Null texts stay null, empty lines stay, no row goes; further columns stay, n_chars follows the text.
    """
    return linededup.drop_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that are near duplicates by five-word shingles one stays: the smallest id, then the smallest text hash.

    Rows are judged by their texts: a repeated id with another text is another row, of identical rows one stays, and rows
    without words (null and empty texts) all stay.
    """
    return setsketch.one_of_each_group(docs, shingle=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced; null texts stay null, no row goes, further columns stay."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences; a null text is one end token, repeated rows are packed as often as they stand there."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", without_frequent_lines),
    ("near_dedup", one_of_each_group),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Registers, sketches and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's table goes when the next one's is written."""
    docs, paths = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            paths.append(new_path(spark, name))
            docs = materialize(docs, name, paths[-1])
            for path in paths[:-1]:
                delete_path(spark, path)
            del paths[:-1]
    return docs
