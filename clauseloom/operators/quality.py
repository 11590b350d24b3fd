"""Exclusion rules, tiers and selections over aligned clauses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import text as T
from clauseloom.operators import cascade, stats

# The thresholds of the exclusion rules, the headline sets and the tiers with the rules whose rows each leaves out.
RATIO_CUT, HEALTHY, LONG_SOURCE, COVERAGE, BARE_NUMBERS, MORE_SENTENCES = 0.75, 0.29, 1200, 0.75, 3, 2
HEADLINE_V1 = ("R2", "R2a", "R2b", "G1", "G2")
HEADLINE_V2 = ("R2", "R2a", "R2b", "G1", "G2", "R3", "R5", "β")
ALL_RULES = ("R4", "R2", "R2a", "R2b", "R3", "R5", "B", "G1", "G2", "β")
TIERS = {
    "strict": (), "least": ("R2",), "middle": ("R2", "R2a", "R2b"), "headline_v1": HEADLINE_V1,
    "with_r3": ("R2", "R2a", "R2b", "G1", "G2", "R3"), "headline_v2": HEADLINE_V2, "full": ALL_RULES,
}
SECTION_HEAD = r"^\s*(?:[0-9]{1,3}(?:\.[0-9]{1,3})*\.?|[A-Z]\.)\s*"
STOPPED, COLON = r"[.。!?！？;；]\s*$", r"[:：]\s*$"


def candidate_score() -> Column:
    """How well a pair of cleaned texts (s, r) serves as its clause's: length ratio near 0.55, long sides, whole ends."""
    ratio = F.length("r") / F.greatest(F.length("s"), F.lit(1))
    whole = F.when(T.complete_end(F.col("s")) & T.strict_end(F.col("r")), 1.0).otherwise(0.0)
    return F.lit(10.0) - F.abs(ratio - 0.55) + F.least(F.length("s"), F.lit(240)) / 240 + F.least(F.length("r"), F.lit(140)) / 140 + whole


def orphans(clauses: DataFrame) -> DataFrame:
    """sample_id, orphan: whether the next clause of the document, by reference order, has no section number."""
    rows = clauses.where("order_ref is not null").select("sample_id", "document_id", "order_ref", "section_no")
    ahead = stats.following(rows, "document_id", ["order_ref", "sample_id"], F.coalesce(F.trim("section_no"), F.lit("")))
    return ahead.select("sample_id", F.coalesce(F.col("next") == "", F.lit(False)).alias("orphan"))


def bare_numbers(text: Column) -> Column:
    """How many numbers without words a text begins with."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    other = F.array_position(F.transform(tokens, lambda x: x.rlike(r"^[0-9]+(?:\.[0-9]+)*\.?$")), False)
    return F.when(other == 0, F.size(tokens)).otherwise(other - 1)


def rules() -> dict[str, Column]:
    """The exclusion rules of a clause with source_text, ref_text, source_char_count, ref_char_count and orphan."""
    src, ref, ns, nr = F.col("source_text"), F.col("ref_text"), F.col("source_char_count"), F.col("ref_char_count")
    body = F.trim(F.regexp_replace(src, SECTION_HEAD, ""))
    ended = cascade.source_terminated(src)
    continues = body.rlike(rf"^(?:{cascade.CONTINUING})\b")
    cut = src.rlike(rf"(?i)\b(?:{cascade.CUT_BEHIND})\s*$")
    dangling = cut | src.rlike(rf"(?:{T.THAI_DANGLING})\s*$")
    r2 = continues | (~ended & dangling)
    r2a = ~r2 & ~ended & ref.rlike(STOPPED)
    r2b = nr / F.greatest(ns, F.lit(1)) > RATIO_CUT
    # a stop behind a figure is that of a clause number
    more = T.count(ref, "[。！？]") - T.count(src, r'(?:^|[^0-9])[.!?](?:\s+[A-Z"“(]|\s*$)')
    broken = F.contains(src, F.lit("(cid:")) | F.contains(ref, F.lit("(cid:")) | F.contains(src, F.lit("�")) | F.contains(ref, F.lit("�"))
    return {
        "R4": (bare_numbers(src) >= BARE_NUMBERS) & ~src.rlike(STOPPED),
        "R2": r2,
        "R2a": r2a,
        "R2b": r2b,
        "R3": cascade.watermark(src) | cascade.watermark(ref) | broken,
        "R5": ref.rlike(r"(?:\s|（|\(|、)[0-9](?:\s+[0-9])+"),
        "B": (more >= MORE_SENTENCES) & ended & ~cut & ~(r2 | r2a | r2b),
        "G1": F.coalesce("orphan", F.lit(False)),
        "G2": (ns > LONG_SOURCE) & (nr < ns * HEALTHY * COVERAGE),
    }


def ledger(clauses: DataFrame) -> DataFrame:
    """sample_id, rules, bucket: the exclusion rules each clause with a reference meets, joined by commas; only clauses that meet any.
    Rows of tables (R4) have a bucket of their own."""
    rows = clauses.where("ref_text is not null and source_text is not null").select("sample_id", "source_text", "ref_text", "source_char_count", "ref_char_count")
    joined = rows.join(orphans(clauses), "sample_id", "left")
    hit = F.filter(F.array(*[F.when(c, name) for name, c in rules().items()]), lambda x: x.isNotNull())
    bucket = F.when(F.array_contains("hit", "R4"), "table_row_separate_metric").otherwise("data_defect_excluded")
    return joined.withColumn("hit", hit).where(F.size("hit") > 0).select("sample_id", F.array_join("hit", ",").alias("rules"), bucket.alias("bucket"))


def training_reason(clauses: DataFrame) -> DataFrame:
    """sample_id, reason: why a clause is left out of training data, the first of R2, R2a, R2b, R3, G2 and G1; ok if none holds."""
    held = rules()
    rows = clauses.where("ref_text is not null and source_text is not null").join(orphans(clauses), "sample_id", "left")
    return rows.select("sample_id", cascade.first_reason([(r, F.coalesce(held[r], F.lit(False))) for r in ("R2", "R2a", "R2b", "R3", "G2", "G1")]).alias("reason"))


def sensitivity(scores: DataFrame, rules: DataFrame) -> DataFrame:
    """tier, n, mean_score, excluded, exclusion_rate of the scored samples that no rule of the tier leaves out."""
    listed = F.array(*[F.struct(F.lit(t).alias("tier"), (F.array(*map(F.lit, r)) if r else F.array().cast("array<string>")).alias("out")) for t, r in TIERS.items()])
    rows = scores.join(rules, "sample_id", "left").withColumn("t", F.explode(listed)).select("score", "t.*", F.split(F.coalesce("rules", F.lit("")), ",").alias("hit"))
    kept = ~F.arrays_overlap("hit", "out")
    return rows.groupBy("tier").agg(
        F.count_if(kept).alias("n"), F.avg(F.when(kept, F.col("score"))).alias("mean_score"), F.count_if(~kept).alias("excluded"), (F.count_if(~kept) / F.count("*")).alias("exclusion_rate")
    )


def headline(scores: DataFrame, rules: DataFrame) -> DataFrame:
    """sample_id, in_v1, in_v2, in_full of the scored samples: whether no rule of either headline set, or none at all, leaves them out."""
    rows = scores.join(rules, "sample_id", "left").select("sample_id", F.split(F.coalesce("rules", F.lit("")), ",").alias("hit"))
    kept = lambda listed: ~F.arrays_overlap("hit", F.array(*map(F.lit, listed)))
    return rows.select("sample_id", kept(HEADLINE_V1).alias("in_v1"), kept(HEADLINE_V2).alias("in_v2"), kept(ALL_RULES).alias("in_full"))


def sample(clauses: DataFrame, per_language: int) -> DataFrame:
    """Up to ``per_language`` clauses a language, dealt round-robin over strata in the order of a hash of the id.

    Both places are asked for up to ``per_language`` only, so that tasks keep no more of a group before it is shuffled.
    """
    has = F.coalesce(F.trim("section_no"), F.lit("")) != ""
    rows = clauses.select("sample_id", "document_id", "language_pair", "segment_type", T.length_bucket(F.col("source_char_count")).alias("bucket"), has.alias("has_section"))
    keyed = rows.withColumn("h", F.md5("sample_id"))
    turn = F.row_number().over(Window.partitionBy("language_pair", "document_id", "segment_type", "bucket", "has_section").orderBy("h"))
    place = F.row_number().over(Window.partitionBy("language_pair").orderBy("turn", "h"))
    dealt = keyed.withColumn("turn", turn).where(F.col("turn") <= per_language)
    return dealt.withColumn("place", place).where(F.col("place") <= per_language).select("sample_id", "language_pair", "turn", "place")


def best_per_clause(clauses: DataFrame) -> DataFrame:
    """The best scored clause of every document, scope and section among those that pass the prefilter."""
    passed = cascade.prefiltered(clauses).where("reason = 'ok'")
    scored = passed.select("sample_id", "document_id", F.coalesce("scope", F.lit("")).alias("scope"), "section_no", F.round(candidate_score(), 6).alias("score"))
    best = scored.groupBy("document_id", "scope", "section_no").agg(F.min_by(F.struct("sample_id", "score"), F.struct(-F.col("score"), "sample_id")).alias("b"))
    return best.select("b.sample_id", "document_id", "scope", "section_no", "b.score")
