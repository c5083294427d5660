"""From raw documents to sampled pieces: five stages of the training-text operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result to the shared folder and reads it again as the next stage's input, and
deletes what it no longer needs.
All stages but the last return the columns of ``documents``.

1. language: documents without a letter, or nearly orthogonal to all learnt
   language profiles, go.
2. near_duplicates: of each component of the Jaccard join the document with the
   smallest doc_id stays.
3. decontaminate: documents with any benchmark window go.
4. secrets: secrets are cut out of the texts, which stay otherwise whole.
5. pieces: the texts' reproducibly sampled pieces are added.

Nulls: a null text has no letter and goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waybill.llm.common import read_table
from waybill.llm.decontaminate import uncontaminated
from waybill.llm.jaccard_join import representatives
from waybill.llm.language_hd import identified
from waybill.llm.piece_sampling import encoded
from waybill.llm.secret_scan import redacted
from waybill.session import Tables, prepared, swept


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return redacted(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return encoded(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("pieces", pieces),
]

#: Language profiles and sampling have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before have written is gone."""
    with Tables(spark, "pipeline") as tables:
        docs, written = read_table(spark, sf_dir, "documents"), None
        for name, stage in STAGES:
            with swept(spark):
                docs = (tables.keep if name == STAGES[-1][0] else tables.put)(stage(spark, docs, sf_dir), name)
            if written is not None:
                tables.drop(written)
            written = docs
        return docs
