"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.

Defined results of all stages: an empty table gives an empty one; a null text is an empty one, and stays null where it isn't changed; texts
of any length are worked on whole; repeated rows are rows of their own (but for ``near_copies``, which keeps all rows of an id that stays);
rows without an id are kept, each by itself; other columns are carried, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.llm import jaccard, mixing, pieces, quality_model, secrets
from sparklode.llm.store import materialize, table

#: Shingles and similarity of near copies.
SHINGLE, SIMILARITY = 5, Fraction(4, 5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is fitted on the labelled rows of ``documents``. An empty text is rejected as poor."""
    model = quality_model.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_model.selected(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return jaccard.deduplicated(docs, SHINGLE, SIMILARITY)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mark; ``n_chars``, where there is such a column, is counted anew (null for a null text)."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents of equal ids are drawn each by itself, and a null source is one of its own."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether they decode to its text; a null or empty text has none."""
    return pieces.encoded(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("secrets", without_secrets), ("mix", mix), ("pieces", encode)]

#: Several stages (a fitted model, token ids) can't be said in SQL; the tests hold the run against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
