"""The corpus pipeline: five of the training-data operators in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs; all but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm._common import stash, table
from textloom.llm.line_dedup import drop_boilerplate
from textloom.llm.mixing import mixed_documents
from textloom.llm.quality import keep_good
from textloom.llm.sentencepieces import encode_mixed
from textloom.llm.simhash import keep_one

STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_boilerplate),
    ("simhash near-dedup", keep_one),
    ("mixing to target weights", mixed_documents),
    ("sentencepiece encoding", encode_mixed),
]

#: A learnt classifier and fingerprints are beyond SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
