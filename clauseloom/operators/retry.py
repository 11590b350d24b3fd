"""Retries: what to repair, what a repair changed, which answer counts in the end, and what is still to be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import text as T

# Where the answer of a stage stands, the first column that isn't blank.
ANSWERS = {
    "first_pass": ("hypothesis", "hypothesis_translation", "translation", "translated_text", "mt"),
    "retry": ("retry_translation", "hypothesis", "hypothesis_translation", "translation", "translated_text"),
    "final": ("final_translation", "hypothesis", "hypothesis_translation", "translation", "retry_translation"),
}


def answer_of(rows: DataFrame, stage: str) -> Column:
    """The answer of a stage from whichever of its columns the rows have; an unknown stage is an error."""
    return T.first_nonblank(*[F.col(c) for c in ANSWERS[stage] if c in rows.columns])


def unique(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """rows, or an error when they are made where a key occurs twice."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rows.columns if c not in keys])
    said = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"repeated key in {what}: "), F.concat_ws(", ", *keys))).cast("boolean"))
    return many.where(F.coalesce(said, F.lit(True))).select(*rows.columns)


def pool(answers: DataFrame) -> DataFrame:
    """Answers to be tried again: those that ask for it or have failed terms, with retry_count one up and a priority (0 with a high term lost, else 1)."""
    have = set(answers.columns)
    asks = F.coalesce(T.truthy(F.col("retry_needed")), F.lit(False)) if "retry_needed" in have else F.lit(False)
    before = F.coalesce(F.col("retry_count"), F.lit(0)) if "retry_count" in have else F.lit(0)
    lost = F.exists("failed_terms", lambda x: F.coalesce(x.error_type, F.lit("missing")) == "missing")
    rows = answers.where(asks | (F.size("failed_terms") > 0))
    return rows.withColumn("retry_count", before + 1).withColumn("retry_priority", F.when(F.coalesce(lost, F.lit(False)), 0).otherwise(1))


def overlay(first: DataFrame, retried: DataFrame) -> DataFrame:
    """first with the answers of successful retries (sample_id, retry_translation, status) in place of their own, and origin: first_pass or retry_overlay."""
    good = retried.where((F.lower(F.trim("status")) == "success") & (F.coalesce(F.trim("retry_translation"), F.lit("")) != ""))
    last = good.groupBy("sample_id").agg(F.max("retry_translation").alias("_new"))
    joined = first.join(last, "sample_id", "left")
    origin = F.when(F.col("_new").isNotNull(), "retry_overlay").otherwise("first_pass")
    return joined.withColumn("origin", origin).withColumn("hypothesis", F.coalesce("_new", "hypothesis")).drop("_new")


def recheck(first: DataFrame, retried: DataFrame) -> DataFrame:
    """sample_id, before, after, gain, recovered, still_fail of each retry (sample_id, tcr, status) and its first answer.

    A repeated key on either side, or a retry without a first answer, is an error when the rows are made."""
    a = unique(first.select("sample_id", F.col("tcr").alias("before"), F.col("status").alias("was")), ["sample_id"], "first answers")
    b = unique(retried.select("sample_id", F.col("tcr").alias("after"), F.col("status").alias("is")), ["sample_id"], "retries")
    joined = b.join(a, "sample_id", "left")
    lost = F.when(F.col("was").isNull(), F.raise_error(F.concat(F.lit("no first answer of "), F.col("sample_id"))).cast("boolean"))
    return joined.where(F.coalesce(lost, F.lit(True))).select(
        "sample_id", "before", "after", (F.col("after") - F.col("before")).alias("gain"),
        ((F.col("was") == "fail") & (F.col("is") == "pass")).alias("recovered"), ((F.col("was") == "fail") & (F.col("is") == "fail")).alias("still_fail"),
    )


def recheck_summary(first: DataFrame, rechecked: DataFrame) -> DataFrame:
    """One row: retries, recovered, still_fail, recovery_rate, mean gain, and the passes of all answers once retries count."""
    firsts = first.agg(F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("tcr").isNotNull()).alias("with_terms"))
    sums = rechecked.agg(F.count("*").alias("retries"), F.count_if("recovered").alias("recovered"), F.count_if("still_fail").alias("still_fail"), F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"), F.avg("gain").alias("mean_gain"))
    both = sums.join(F.broadcast(firsts))
    passes = F.col("passed") + F.col("recovered")
    return both.select("*", T.percent(F.col("recovered"), F.col("retries")).alias("recovery_rate"), passes.alias("final_passed"), T.percent(passes, F.col("with_terms")).alias("final_pass_rate")).drop("passed")


def remaining(wanted: DataFrame, history: DataFrame, keys: list[str], attempts: int) -> DataFrame:
    """Wanted rows that never succeeded and failed fewer than ``attempts`` times; history: keys, status."""
    done = history.groupBy(*keys).agg(F.count_if(F.lower("status") == "success").alias("good"), F.count_if(F.lower("status") != "success").alias("bad"))
    return wanted.join(done.where((F.col("good") > 0) | (F.col("bad") >= attempts)), keys, "left_anti")


def run_summary(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """status, samples, mean_latency of the latest attempt of each sample (sample_id, attempt, status, latency), and lacking: wanted samples without a success."""
    latest = rows.groupBy("sample_id").agg(F.max_by(F.struct("status", "latency"), "attempt").alias("x")).select("sample_id", "x.*")
    good = latest.where("lower(status) = 'success'")
    lacking = wanted.select("sample_id").distinct().join(good, "sample_id", "left_anti").agg(F.count("*").alias("lacking"))
    return latest.groupBy("status").agg(F.count("*").alias("samples"), F.avg("latency").alias("mean_latency")).join(F.broadcast(lacking))


# The columns that a source or a reference may stand in.
SOURCES, REFERENCES = ("source_text", "text", "src", "source"), ("ref_text", "reference", "ref", "target_text")


def triples(rows: DataFrame, least_ref: int) -> DataFrame:
    """rows with src, mt, ref from whichever columns they have, and whole: none is blank and the reference has ``least_ref`` characters."""
    pick = lambda names: T.first_nonblank(*[F.col(n) for n in names if n in rows.columns], F.lit(None).cast("string"))
    named = rows.withColumn("src", pick(SOURCES)).withColumn("mt", pick(ANSWERS["first_pass"])).withColumn("ref", pick(REFERENCES))
    return named.withColumn("whole", F.coalesce(F.col("src").isNotNull() & F.col("mt").isNotNull() & (F.length("ref") >= least_ref), F.lit(False)))


def metric_spec(spec: str) -> tuple[str, str]:
    """The path and the prefix of ``path:prefix``; anything else is an error."""
    path, colon, prefix = spec.rpartition(":")
    if not (path and colon and prefix):
        raise ValueError(f"path:prefix is needed, not {spec}")
    return path, prefix


def merged(base: DataFrame, metrics: dict[str, DataFrame], key: str) -> DataFrame:
    """base with the columns of each metric's table under its prefix; keys that base doesn't have are left out."""
    for prefix, table in metrics.items():
        named = table.dropDuplicates([key]).select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in table.columns if c != key])
        base = base.join(named, key, "left")
    return base


def failures_to(path: str):
    """A function for foreachBatch that appends a batch's rows with a status other than success, as they are, to a table of JSON lines."""

    def run(batch: DataFrame, number: int) -> None:
        batch.where("status <> 'success'").withColumn("batch", F.lit(number)).write.mode("append").json(path)

    return run
