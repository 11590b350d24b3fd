"""Alignment, lookup and comparison joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import sections as S


def unique_key(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides whose key occurs exactly once on either side; counted before the join, so a hot key joins nothing."""
    once = [side.groupBy(*keys).agg(*[F.first(c).alias(c) for c in side.columns if c not in keys], F.count("*").alias("n")).where("n = 1").drop("n") for side in (left, right)]
    return once[0].join(once[1], keys)


def positional(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """Rows of equal key and equal place within it."""
    a = left.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(left_order)))
    b = right.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(right_order)))
    return a.join(b, [*keys, "place"])


def gate(clauses: DataFrame) -> DataFrame:
    """document_id, sources, refs, count_ratio, coverage, passes: whether a document's sides are even enough to align."""
    rows = clauses.select("sample_id", "document_id", "section_no", F.col("ref_text").isNotNull().alias("has")).distinct()
    per = rows.groupBy("document_id").agg(
        F.count("*").alias("sources"), F.count_if("has").alias("refs"),
        F.count_distinct(F.when(F.col("has"), S.section_key(F.col("section_no")))).alias("shared"), F.count_distinct(S.section_key(F.col("section_no"))).alias("keys"),
    )
    ratio, coverage = F.col("refs") / F.col("sources"), F.when(F.col("keys") > 0, F.col("shared") / F.col("keys")).otherwise(0.0)
    passes = ratio.between(0.75, 1.35) | ((F.col("keys") >= 10) & (coverage >= 0.9))
    return per.select("document_id", "sources", "refs", ratio.alias("count_ratio"), coverage.alias("coverage"), passes.alias("passes"))


def arms(answers: DataFrame, first: str, second: str) -> DataFrame:
    """source_lang, pairs, delta, up, down, same: the second group's term consistency against the first's, sample by sample."""
    rows = answers.select("sample_id", "source_lang", "experiment_group", "tcr_sample").distinct()
    a = rows.where(F.col("experiment_group") == first).select("sample_id", "source_lang", F.col("tcr_sample").alias("x"))
    b = rows.where(F.col("experiment_group") == second).select("sample_id", F.col("tcr_sample").alias("y"))
    both = a.join(b, "sample_id").where("x is not null and y is not null")
    return both.groupBy("source_lang").agg(
        F.count("*").alias("pairs"), F.avg(F.col("y") - F.col("x")).alias("delta"), F.count_if(F.col("y") > F.col("x")).alias("up"),
        F.count_if(F.col("y") < F.col("x")).alias("down"), F.count_if(F.col("y") == F.col("x")).alias("same"),
    )


def missing_from(groups: DataFrame, key: str, group: str) -> DataFrame:
    """group, present, missing: how many of all keys each group has and lacks (sets are equal where nothing is missing)."""
    rows = groups.select(key, group).distinct()
    total = rows.agg(F.count_distinct(key).alias("total"))
    return rows.groupBy(group).agg(F.count("*").alias("present")).join(F.broadcast(total)).select(group, "present", (F.col("total") - F.col("present")).alias("missing"))
