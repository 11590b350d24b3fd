"""What a translation service asks of the library: requests checked, terms merged, answers verified, listings, health and self-checks.

Everything is a table; a web front end only passes rows in and out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import text as T
from clauseloom.operators import cascade, models, terms

# The codes of an answer's envelope.
CODES = {"ok": 200, "empty_text": 400, "text_too_long": 400, "unknown_language": 400, "document_upload_unsupported": 400, "backend_failed": 502, "unresolved_language": 422, "not_found": 404}


def envelope(reason: Column, data: Column) -> Column:
    """A struct of code, msg and data; data only where the reason is ok."""
    codes = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return F.struct(F.coalesce(F.element_at(codes, reason), F.lit(500)).alias("code"), reason.alias("msg"), F.when(reason == "ok", data).alias("data"))


def authorised(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """requests with allowed: whether the header ``Bearer <token>`` names one of the tokens, kept as sha256."""
    given = F.sha2(F.regexp_extract("authorization", r"(?i)^Bearer\s+(\S+)\s*$", 1), 256)
    known = tokens.select(F.col("sha256").alias("_t"), F.lit(True).alias("_ok")).distinct()
    return requests.withColumn("_t", given).join(known, "_t", "left").withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_t", "_ok")


def translated(requests: DataFrame, termbase: DataFrame, backend: Callable[[list[str]], list[tuple[str, str]]], most: int = 8000) -> DataFrame:
    """request_id, response of requests (request_id, text, language_type): checked, language by script where none is named, terms of the
    text found, the backend asked, and the answer's missing hard terms named."""
    checked = requests.withColumn("_reason", cascade.request_reason(requests, most))
    good = checked.where("_reason = 'ok'").withColumn("_lang", F.coalesce(F.lower(T.language_type(F.col("language_type"))), F.when(T.script(F.col("text")) != "latin", T.script(F.col("text")))))
    texts = good.where("_lang is not null").select(F.col("request_id").alias("sample_id"), F.col("_lang").alias("source_lang"), F.col("text").alias("source_text"))
    usable = terms.usable(termbase)
    found = terms.matched(terms.longest(terms.occurrences(texts, usable))).join(usable.groupBy("term_id").agg(F.min("target_term").alias("target_term")), "term_id")
    per = found.groupBy("sample_id").agg(F.array_sort(F.collect_set(F.when(F.col("priority") == "high", F.col("target_term")))).alias("hard"))
    listed = texts.join(per, "sample_id", "left").withColumn("prompt", F.concat_ws("\n", F.lit("Translate into Chinese. Return only the translation."), F.array_join(F.coalesce("hard", F.array().cast("array<string>")), "\n"), "source_text"))
    answers = models.generated(listed.select(F.col("sample_id"), "prompt"), ["sample_id"], "prompt", backend).select("sample_id", "result", "status")
    done = listed.join(answers, "sample_id").select(F.col("sample_id").alias("request_id"), F.when(F.col("status") == "success", "ok").otherwise("backend_failed").alias("_r"), F.struct(F.col("result").alias("translation"), "source_lang", missing_targets(F.col("result"), F.col("hard")).alias("missing_terms")).alias("_d"))
    joined = checked.join(done, "request_id", "left")
    reason = F.when(F.col("_reason") != "ok", F.col("_reason")).otherwise(F.coalesce("_r", F.lit("unresolved_language")))
    return joined.select("request_id", envelope(reason, F.col("_d")).alias("response"))


def missing_targets(answer: Column, targets: Column) -> Column:
    """The targets that an answer doesn't hold."""
    return F.filter(F.coalesce(targets, F.array().cast("array<string>")), lambda t: ~F.contains(F.coalesce(answer, F.lit("")), t))


def listing(termbase: DataFrame, source_lang: str, target_lang: str, most: int) -> DataFrame:
    """The first ``most`` active terms of a language pair in order of their source: source_term, target_term, priority, domain."""
    rows = termbase.where((T.language(F.col("source_lang")) == source_lang) & (T.language(F.col("target_lang")) == target_lang) & (F.lower(F.coalesce("status", F.lit("active"))) == "active"))
    return rows.select("source_term", "target_term", "priority", "domain").distinct().orderBy("source_term", "target_term", "priority", "domain").limit(most)


def health(components: dict[str, Callable[[], bool]], deep: bool = False) -> dict:
    """ok, and for a deep look each component's state; a component that raises is down."""
    if not deep:
        return {"status": "ok"}
    states = {}
    for name, probe in components.items():
        try:
            states[name] = bool(probe())
        except Exception:
            states[name] = False
    return {"status": "ok" if all(states.values()) else "degraded", "components": states}


def self_check(probes: DataFrame, expected: dict[str, str]) -> DataFrame:
    """ts, failed: what each probe (ts, ok, model, termbase_md5, manifest_sha256, answer) finds wrong: availability, another model, a changed termbase or manifest, thinking aloud in the answer."""
    cases = [("availability", ~F.coalesce(F.col("ok"), F.lit(False)))]
    cases += [(name, F.coalesce(F.col(name), F.lit("")) != value) for name, value in expected.items()]
    cases += [("thinking", F.size(T.thinking_marks(F.col("answer"))) > 0)]
    return probes.select("ts", F.filter(F.array(*[F.when(c, n) for n, c in cases]), lambda x: x.isNotNull()).alias("failed"))
