"""The queries of the core by name, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clauseloom.session import table

ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that says the same over whole tables where there is any."""

    def add(f):
        ALL[f.__name__] = (f, sql)
        return f

    return add


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers once each; a repeat differs in loaded_at only, so its key is enough to tell it."""
    return table(spark, d, "tcr_check").dropDuplicates(["sample_id", "experiment_group"])


def clauses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "prepare_da_pairs").dropDuplicates(["sample_id"])


def recall(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "term_recall").dropDuplicates(["sample_id"])


def scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "b1_neardup_consistency").distinct()


ANSWERS = "(SELECT DISTINCT * EXCLUDE (loaded_at) FROM tcr_check)"
CLAUSES = "(SELECT DISTINCT * EXCLUDE (loaded_at) FROM prepare_da_pairs)"
SCORES = "(SELECT DISTINCT * FROM b1_neardup_consistency)"
RECALL = "(SELECT DISTINCT * FROM term_recall)"
