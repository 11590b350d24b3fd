"""Readers that several of the problems share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.session import table


def of_format(spark: SparkSession, sf_dir: str, rows: DataFrame, wanted: str) -> DataFrame:
    """The rows whose document is delivered as ``wanted`` (pdf or scan); repeats stay."""
    documents = table(spark, sf_dir, "raw_manifest").where(F.col("format") == wanted).select(F.col("doc_id").alias("document_id")).distinct()
    return rows.join(documents, "document_id", "left_semi")


def clauses(spark: SparkSession, sf_dir: str, wanted: str | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "prepare_da_pairs")
    return of_format(spark, sf_dir, rows, wanted) if wanted else rows
