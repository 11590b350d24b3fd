"""The queries pN_... and, where SQL can say the same over whole tables, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import align, chars, defects, encode, neardup, pack, scans, sentences, spans, truncation
from clauseloom.llm.common import clauses
from clauseloom.session import cut, spread, table

TOKENIZERS = os.environ.get("CLAUSELOOM_TOKENIZERS", encode.TOKENIZERS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(clauses(spark, sf_dir, "pdf"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noise(scans.fields(clauses(spark, sf_dir, "scan")), scans.fields(clauses(spark, sf_dir, "pdf")))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(scans.fields(clauses(spark, sf_dir, "scan")), scans.fields(clauses(spark, sf_dir, "pdf")))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "prepare_da_pairs")
    sides = F.array(F.struct(F.col("source_lang").alias("lang"), F.col("source_text").alias("text")), F.struct(F.lit("zh").alias("lang"), F.col("ref_text").alias("text")))
    return rows.select(F.explode(sides).alias("x")).select("x.*").where("text is not null")


def _defects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return defects.found(table(spark, sf_dir, "tcr_check"), _written(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _defects(spark, sf_dir)[0]


def _cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, sample_id, experiment_group, route of every text that was cut off."""
    sources = clauses(spark, sf_dir, "pdf").select("document_id", "sample_id", F.col("source_lang").alias("lang"), F.col("source_text").alias("text"), F.col("segment_type").alias("kind"))
    seen = cut(truncation.states(sources).withColumn("fingerprint", F.xxhash64("text")).drop("text", "kind", "tidied"))
    cut_sources = truncation.cut_off(seen, sources.drop("document_id", "sample_id"), ["sample_id"], ["document_id"], ["document_id"])
    return cut_sources.select(F.lit("source_text").alias("field"), "sample_id", F.lit("").alias("experiment_group"), "route").union(
        _defects(spark, sf_dir)[1].select(F.lit("hypothesis"), "sample_id", "experiment_group", "route")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut_texts(spark, sf_dir).drop("route").distinct()


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document's sources and each experiment group's answers are cut, and by what it was seen."""
    found = cut(_cut_texts(spark, sf_dir)).withColumn("cut", F.lit(1))
    sources = clauses(spark, sf_dir, "pdf").select("sample_id", "document_id").distinct()
    answers = table(spark, sf_dir, "tcr_check").select("sample_id", "experiment_group").distinct()
    by_source = sources.join(found.where("field = 'source_text'"), "sample_id", "left").select(F.lit("document_id").alias("source_kind"), F.col("document_id").alias("source"), "cut", "route")
    by_group = answers.join(found.where("field = 'hypothesis'"), ["sample_id", "experiment_group"], "left").select(F.lit("experiment_group"), "experiment_group", "cut", "route")
    routes = [F.count_if(F.col("route") == r).alias(f"by_{r}") for r in ("structure", "limit", "baseline", "suffix")]
    return by_source.union(by_group).groupBy("source_kind", "source").agg(
        F.count("*").alias("texts"), F.count("cut").alias("cut_texts"), (F.count("cut") / F.count("*")).alias("share"), *routes
    )


def p5_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with its text."""
    return sentences.clause_units(clauses(spark, sf_dir, "pdf")).select("field", "sample_id", "lang", "sent_start", "sentence").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.clause_units(clauses(spark, sf_dir, "pdf")).select("field", "sample_id", "sent_start").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit("").alias("experiment_group")
    sections = chars.inconsistent(table(spark, sf_dir, "term_recall").select("sample_id", "section_no"), "section_no", section=True)
    texts = chars.inconsistent(clauses(spark, sf_dir, "pdf").select("sample_id", "source_text"), "source_text")
    answers = table(spark, sf_dir, "tcr_check").select("sample_id", "experiment_group", "hypothesis")
    answers = chars.inconsistent(answers, "hypothesis").where(~defects.without_content(F.col("hypothesis")))
    return (
        sections.select(F.lit("section_no").alias("field"), "sample_id", none)
        .union(texts.select(F.lit("source_text"), "sample_id", none))
        .union(answers.select(F.lit("hypothesis"), "sample_id", "experiment_group"))
        .distinct()
    )


def p6_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows name each section, once equal sections are written alike."""
    rows = table(spark, sf_dir, "term_recall").select("sample_id", "section_no").distinct()
    return chars.consistent(rows, "section_no", section=True).groupBy(F.col("section_no_form").alias("section")).agg(
        F.count("*").alias("clauses"), F.countDistinct("section_no").alias("spellings")
    )


def studied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clauses of the near-duplicate study with their texts."""
    listed = table(spark, sf_dir, "b1_neardup_consistency").select("sample_id").distinct()
    return table(spark, sf_dir, "prepare_da_pairs").select("sample_id", "source_text").join(listed, "sample_id", "left_semi")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.pairs(studied(spark, sf_dir))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(studied(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(spread(documents(spark, sf_dir), "doc_id"), tokenizers=TOKENIZERS)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.packed(spread(documents(spark, sf_dir), "doc_id"), TOKENIZERS)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.fill(p9_containers(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(documents(spark, sf_dir))


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_amounts(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p2_repaired": p2_repaired,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p4_rates": p4_rates,
        "p5_found": p5_found,
        "p5_units": p5_units,
        "p6_found": p6_found,
        "p6_sections": p6_sections,
        "p7_found": p7_found,
        "p7_groups": p7_groups,
        "p8_ids": p8_ids,
        "p9_containers": p9_containers,
        "p9_fill": p9_fill,
        "p10_found": p10_found,
        "p10_shared": p10_shared,
    }


SIMILAR = r"""
WITH listed AS (SELECT DISTINCT sample_id FROM b1_neardup_consistency),
texts AS (
  SELECT DISTINCT sample_id, trim(regexp_replace(lower(source_text), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS t
  FROM prepare_da_pairs WHERE sample_id IN (SELECT sample_id FROM listed) AND source_text IS NOT NULL),
grams AS (SELECT DISTINCT sample_id, substr(t, i, 5) AS g FROM (SELECT sample_id, t, unnest(range(1, length(t) - 3)) AS i FROM texts)),
sizes AS (SELECT sample_id, count(*) AS n FROM grams GROUP BY sample_id),
common AS (SELECT a.sample_id AS a, b.sample_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.sample_id < b.sample_id GROUP BY 1, 2)
SELECT a AS sample_id_a, b AS sample_id_b FROM common
JOIN sizes x ON x.sample_id = a JOIN sizes y ON y.sample_id = b
WHERE c::DOUBLE / (x.n + y.n - c) >= 0.7
"""

GRAMS = """
WITH places AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200),
grams AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS g FROM places),
shared AS (SELECT g FROM grams GROUP BY g HAVING min(doc_id) <> max(doc_id)),
found AS (SELECT doc_id, i, g FROM grams SEMI JOIN shared USING (g))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p7_found": SIMILAR,
        "p10_found": GRAMS + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM found a JOIN found b ON a.g = b.g AND a.doc_id < b.doc_id",
        "p10_shared": GRAMS
        + """, covered AS (
  SELECT doc_id, sum(least(200, coalesce(following - i, 200)))::BIGINT AS shared_chars
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM found) GROUP BY doc_id)
SELECT d.doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(shared_chars, 0)::BIGINT AS shared_chars,
  CASE WHEN length(text) > 0 THEN coalesce(shared_chars, 0)::DOUBLE / length(text) ELSE 0.0 END AS share
FROM documents d LEFT JOIN covered USING (doc_id)""",
    }
