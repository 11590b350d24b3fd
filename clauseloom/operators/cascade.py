"""Predicates over lines, segments and pairs, and the ordered cascades of reasons built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import sections as S
from clauseloom.functions import text as T

# Limits of segments and pairs.
MOST_CHARS, LEAST_SOURCE, LEAST_REF, LEAST_RATIO, MOST_RATIO = 3000, 30, 15, 0.10, 1.50
EXACT = ("exact_section", "exact_section_scoped")
PAGE_WORDS = "page|página|seite|страница|หน้า"
CONTENTS = "contents|table of contents|inhaltsverzeichnis|sommaire|目录|สารบัญ|содержание|الفهرس"
HEADED = "annex|appendix|chapter|section|part|附录|附件|第.+[章节]|приложение|ภาคผนวก"
LETTER = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}A-Za-zÀ-ÖØ-öø-ÿ\x{0400}-\x{04ff}\x{0e00}-\x{0e7f}\x{0600}-\x{06ff}]"


def noise_line(line: Column) -> Column:
    """Empty, a page number, a line of contents, dots, or hardly any letter."""
    return T.let(T.clean(F.coalesce(line, F.lit(""))), cleaned_noise)


def cleaned_noise(c: Column) -> Column:
    """noise_line() of a line that is cleaned already."""
    patterns = [r"^[-–—]? *[0-9]{1,4} *[-–—]?$", rf"(?iu)^(?:{PAGE_WORDS}) [0-9]{{1,4}}(?: */ *[0-9]{{1,4}})?$", "^第 *[0-9]{1,4} *页 *共 *[0-9]{1,4} *页$", "[.·…]{4,} *[0-9]{1,4}$", "[.·…]{10,}"]
    return (c == "") | c.rlike("|".join(f"(?:{p})" for p in patterns)) | ((F.length(c) > 20) & (T.good_ratio(c) < 0.25))


def keep_segment(text: Column, kind: Column, section: Column, least: int) -> Column:
    n, has = F.length(text), F.coalesce(section, F.lit("")) != ""
    return F.coalesce((n >= least) | (kind.isin("title", "table") & (n >= 8)) | (has & (n >= 10)), F.lit(False))


def language_content(text: Column) -> Column:
    return text.rlike(LETTER)


def directory(c: Column) -> Column:
    """Looks like a line or a part of a table of contents."""
    return c.rlike(r"[.·…]{4,} *[0-9]{1,4} *$") | F.lower(c).rlike(CONTENTS) | c.rlike(rf"(?i)^(?:{HEADED})(?:[^\p{{L}}\p{{N}}_].*)? [0-9]{{1,4}}$") | c.rlike(r"^(?:[0-9]+(?:\.[0-9]+)* +){4,}[0-9]+(?:\.[0-9]+)*$")


def header_or_footer(c: Column) -> Column:
    return c.rlike(rf"(?iu)^(?:{PAGE_WORDS}) [0-9]{{1,4}}(?: *(?:of|/) *[0-9]{{1,4}})?$") | c.rlike("^[-–—]? *[0-9]{1,4} *[-–—]?$") | c.rlike(r"(?i)\bpage +[0-9]+ +of +[0-9]+\b")


def file_name_noise(c: Column) -> Column:
    """A file's name twice in a row, or a Chinese one more than once."""
    names = F.regexp_extract_all(c, F.lit(r"\b[A-Za-z0-9]+(?:_[A-Za-z0-9]+){2,}\b"), F.lit(0))
    twice = (F.size(names) >= 2) & (F.try_element_at(names, F.lit(1)) == F.try_element_at(names, F.lit(2)))
    return twice | F.exists(names, lambda x: F.lower(x).endswith("_zh") & (F.length(c) - F.length(F.replace(c, x, F.lit(""))) > F.length(x)))


def symbol_noise(c: Column) -> Column:
    return F.contains(c, F.lit("(cid:")) | F.contains(c, F.lit("�")) | (c == "") | c.rlike(r"^[^\p{L}\p{N}]+$") | ((F.length(c) > 20) & (T.good_ratio(c) < 0.35))


def bad_text(t: Column) -> Column:
    """Whether a cleaned text is noise of some kind or holds no language."""
    return symbol_noise(t) | directory(t) | header_or_footer(t) | file_name_noise(t) | ~language_content(t)


def short_but_meaningful(text: Column, kind: Column, section: Column) -> Column:
    n, has = F.length(text), F.coalesce(section, F.lit("")) != ""
    return F.coalesce((F.lower(kind).isin("title", "table", "structure") & (n >= 8)) | (has & (n >= 10) & language_content(text)), F.lit(False))


def section_prefixes(text: Column, section: Column) -> Column:
    """The cleaned text begins with the clause number and then a delimiter."""
    s = S.stripped(section)
    return F.coalesce(F.startswith(text, s) & F.substring(text, F.length(s) + 1, F.lit(1)).rlike(r"^$|[ .)）:：、-]"), F.lit(False))


def section_agrees(text: Column, section: Column) -> Column:
    """The text begins with a clause number of the same canonical key."""
    return F.coalesce(S.section_key(section) == S.section_key(S.section_no(text)), F.lit(False))


def exact_section(section: Column, sources: Column, refs: Column) -> Column:
    """Whether a clause number may be aligned exactly, given how often either side has it."""
    s = S.stripped(section)
    return (s != "") & ~s.rlike("^[A-Z]$") & ~(s.rlike("^[0-9]{1,3}$") & ((sources != 1) | (refs != 1))) & (sources <= 3) & (refs <= 3)


def alignment_sane(source: Column, ref: Column, kind: Column, section: Column, least: int) -> Column:
    ratio = F.length(ref) / F.greatest(F.length(source), F.lit(1))
    chinese = T.count(ref, T.CJK)
    return F.coalesce(
        (source != "") & (ref != "") & (chinese >= 2) & (chinese / F.greatest(F.length(ref), F.lit(1)) >= 0.08)
        & keep_segment(source, kind, section, least) & keep_segment(ref, kind, section, 8) & ratio.between(0.08, 6.5),
        F.lit(False),
    )


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""


def first_reason(cases: list[tuple[str, Column]], otherwise: str = "ok") -> Column:
    """The name of the first case that holds."""
    return reduce(lambda chain, case: chain.when(case[1], case[0]), cases[1:], F.when(cases[0][1], cases[0][0])).otherwise(otherwise)


def da_prefilter(s: Column, r: Column) -> Column:
    """Why an aligned clause with these cleaned texts can't be scored: the first of fifteen reasons, ok if there is none."""
    ratio = F.length(r) / F.greatest(F.length(s), F.lit(1))
    missing = reduce(lambda a, b: a | b, map(_blank, ("sample_id", "document_id", "language_pair", "source_lang", "target_lang")))
    section = F.col("section_no")
    return first_reason([
        ("missing_required_fields", missing),
        ("non_exact_section", ~F.coalesce(F.col("alignment_method").isin(*EXACT), F.lit(False))),
        ("non_high_confidence", F.coalesce(F.col("alignment_confidence"), F.lit("")) != "high"),
        ("use_for_da_not_true", ~F.coalesce(F.col("use_for_da"), F.lit(False))),
        ("missing_section_no", S.stripped(section) == ""),
        ("missing_source_or_ref", (s == "") | (r == "")),
        ("source_too_short", F.length(s) < LEAST_SOURCE),
        ("ref_too_short", F.length(r) < LEAST_REF),
        ("too_long", (F.length(s) > MOST_CHARS) | (F.length(r) > MOST_CHARS)),
        ("source_noise_or_directory", bad_text(s)),
        ("ref_noise_or_directory", bad_text(r)),
        ("source_section_mismatch", ~section_prefixes(s, section)),
        ("ref_section_mismatch", ~section_agrees(r, section)),
        ("length_ratio_abnormal", (ratio < LEAST_RATIO) | (ratio > MOST_RATIO)),
        ("possible_truncation", ~T.complete_end(s) | ~T.strict_end(r)),
    ])


def prefiltered(clauses: DataFrame) -> DataFrame:
    """clauses with judged: s and r (the cleaned texts) and reason."""
    cleaned = F.struct(T.clean(F.coalesce("source_text", F.lit(""))).alias("s"), T.clean(F.coalesce("ref_text", F.lit(""))).alias("r"))
    judged = T.let(cleaned, lambda t: F.struct(t.s.alias("s"), t.r.alias("r"), da_prefilter(t.s, t.r).alias("reason")))
    return clauses.withColumn("judged", judged).select("*", "judged.*").drop("judged")


def eval_rows(clauses: DataFrame) -> DataFrame:
    """sample_id, reason: why a clause is left out of the evaluation (ok: it isn't).  Of equal texts of a document the first sample_id stays."""
    missing = reduce(lambda a, b: a | b, map(_blank, ("sample_id", "document_id", "language_pair", "source_lang", "target_lang", "source_text")))
    reason = lambda s: first_reason([
        ("missing_required_fields", missing),
        ("empty_source_text", s == ""),
        ("noise_or_directory", bad_text(s)),
        ("too_long", F.length(s) > MOST_CHARS),
        ("too_short", (F.length(s) < LEAST_SOURCE) & ~short_but_meaningful(s, F.col("segment_type"), F.col("section_no"))),
    ])
    told = T.let(T.clean(F.coalesce("source_text", F.lit(""))), lambda s: F.struct(F.md5(s).alias("sum"), reason(s).alias("reason")))
    judged = clauses.select("sample_id", "language_pair", "document_id", told.alias("t")).select("sample_id", "language_pair", "document_id", "t.*")
    # the first of equal texts, found by aggregation and joined back, so that no task holds a hot text's rows
    firsts = judged.where("reason = 'ok'").groupBy("language_pair", "document_id", "sum").agg(F.min("sample_id").alias("first"))
    joined = judged.join(firsts, ["language_pair", "document_id", "sum"], "left")
    return joined.select("sample_id", F.when((F.col("reason") == "ok") & (F.col("first") != F.col("sample_id")), "duplicate_source_text").otherwise(F.col("reason")).alias("reason"))


def da_filter(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """rows with reason: why a reference doesn't serve scoring; flags that rows don't have count as unsaid."""
    have = set(rows.columns)
    flag = lambda names: [T.truthy(F.col(n)) for n in names if n in have]
    any_is = lambda names, value: F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(x == value, F.lit(False)) for x in flag(names)], F.lit(False)), F.lit(False))
    text = lambda name: F.lower(F.coalesce(F.col(name), F.lit(""))) if name in have else F.lit("")
    score = T.confidence(F.col("alignment_confidence"))
    summary = F.coalesce(*flag(("is_summary_ref", "ref_is_summary")), F.contains(text("ref_type"), F.lit("summary")))
    origin = F.when(text("ref_source") != "", text("ref_source")).otherwise(text("reference_source"))
    machine = any_is(("is_machine_ref", "machine_ref", "ref_is_machine_translation"), True) | F.contains(origin, F.lit("machine")) | origin.isin("mt", "machine_ref")
    return rows.withColumn("reason", first_reason([
        ("use_for_da_not_true", ~F.coalesce(T.truthy(F.col("use_for_da")), F.lit(False))),
        ("missing_ref_text", F.coalesce(F.trim("ref_text"), F.lit("")) == ""),
        ("missing_alignment_confidence", score.isNull()),
        ("alignment_confidence_below_threshold", score < least),
        ("source_ref_not_aligned", any_is(("source_ref_aligned", "ref_aligned", "is_aligned"), False)),
        ("summary_ref", summary),
        ("machine_ref_unconfirmed", machine & ~any_is(("ref_confirmed", "human_verified"), True)),
    ]))


# What page marks consist of; the strong parts stand for themselves, of the weak ones two are needed.
STRONG_MARKS = ("(?i)Applus", "(?i)IDIADA", r"(?i)I\s*\.\s*R\s*\.\s*I\s*\.\s*S", r"(?:^|[^\p{L}\p{N}_])IRIS(?:[^\p{L}\p{N}_]|$)", "[Ff]or reference purposes only", r"ECE/TRANS/WP\.29", "(?i)shall not be held responsible")
WEAK_MARKS = (r"(?i)Download\s+from\b", r"(?i)powered\s+by\b", r"由\s*Applus", r"IDIADA\s*支持", r"应用程序\s*下载", "仅供参考")


def watermark(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    weak = reduce(lambda a, b: a + b, [t.rlike(p).cast("int") for p in WEAK_MARKS])
    return reduce(lambda a, b: a | b, [t.rlike(p) for p in STRONG_MARKS]) | (weak >= 2)


def source_terminated(text: Column) -> Column:
    return F.when(T.thai_dominant(text), ~text.rlike(rf"(?:{T.THAI_DANGLING})\s*$")).otherwise(text.rlike(r"[.。!?！？;；]\s*$"))


# Function words that continue a sentence, and those behind which one is cut.
CONTINUING = "or|and|but|nor|of|to|in|on|at|by|for|with|from|as|than|that|which|where|when|if|shall|may|is|are|was|were|be|been|the|a|an"
CUT_BEHIND = "and|or|but|nor|of|to|in|on|at|by|for|with|from|as|than|that|which|where|when|if|the|a|an|is|are|was|were|be|been|shall|may|not|its|their|this|these"


def half_sentence(text: Column) -> Column:
    """The last word in Latin letters is one that a sentence can't end with."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(rf"\b(?:{CUT_BEHIND})\s*$")


def page_noise(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return t.rlike(r"\(cid:[0-9]+\)|\x{fffd}|[.·…]{6,}|_{4,}")


def table_row(text: Column) -> Column:
    """Four tokens or more, and more than 22 of a hundred characters figures."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.size(F.filter(F.split(t, r"\s+"), lambda x: x != "")) >= 4) & (T.count(t, "[0-9]") > 0.22 * F.length(t))


#: Classes of a line of a reference, the first that holds; text if none does.
LINE_CLASSES = {
    "empty": r"^\s*$", "page_number": r"^\s*[-–—]?\s*[0-9]{1,4}\s*[-–—]?\s*$", "page_label": rf"(?i)^\s*(?:{PAGE_WORDS})\s*[0-9]+|^\s*第\s*[0-9]+\s*页",
    "contents": r"[.·…]{4,}\s*[0-9]*\s*$", "address": r"(?i)https?://|www\.", "date_stamp": r"^\s*[0-9]{4}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}日?\s*$",
    "broken": r"\(cid:[0-9]+\)|\x{fffd}", "symbols": r"^[^\p{L}\p{N}]+$",
}


def line_class(line: Column) -> Column:
    return first_reason([(name, line.rlike(p)) for name, p in LINE_CLASSES.items()], "text")


#: Classes of a marked span of an answer.
SPAN_CLASSES = {"empty": r"^\s*$", "punctuation": r"^[\p{P}\p{S}\s]+$", "figure": r"^[0-9０-９.,/%\s-]+$", "clause_number": r"^\s*(?:第\s*[0-9]+\s*[章节条款]|[0-9]+(?:\.[0-9]+)+)\s*$", "latin": r"^[\x21-\x7e\s]+$"}


def span_class(span: Column) -> Column:
    return first_reason([(name, span.rlike(p)) for name, p in SPAN_CLASSES.items()], "text")


def mostly_chinese(text: Column) -> Column:
    return T.count(text, T.CJK) > T.count(text, r"[A-Za-z]")


def request_reason(rows: DataFrame, most: int = 8000) -> Column:
    """Why a request (columns text, language_type, file_base64 where present) is refused; ok if it isn't."""
    have = set(rows.columns)
    cases = [("document_upload_unsupported", F.coalesce(F.col("file_base64"), F.lit("")) != "")] if "file_base64" in have else []
    text = F.coalesce(F.trim("text"), F.lit(""))
    return first_reason([
        *cases, ("empty_text", text == ""), ("text_too_long", F.length(text) > most),
        ("unknown_language", (F.coalesce(F.trim("language_type"), F.lit("")) != "") & T.language_type(F.col("language_type")).isNull()),
    ])


def repeated_lines(lines: DataFrame, least_share: float = 1 / 3) -> DataFrame:
    """doc, line, masked: lines among the first or last three of a page that recur on a third of the document's pages, three at least.

    lines: doc, page, at, line (cleaned).  masked tells that the figures of the line are masked.
    """
    kept = lines.where(~noise_line(F.col("line")))
    ends = [F.row_number().over(Window.partitionBy("doc", "page").orderBy(order)) for order in (F.col("at"), F.col("at").desc())]
    edge = kept.withColumn("top", ends[0]).withColumn("bottom", ends[1]).where("(top <= 3 or bottom <= 3) and length(line) between 6 and 180")
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    both = edge.select("doc", F.explode(F.array(F.struct(F.col("line"), F.lit(False).alias("masked")), F.struct(T.digits_masked(F.col("line")).alias("line"), F.lit(True).alias("masked")))).alias("x")).select("doc", "x.*")
    counts = both.groupBy("doc", "line", "masked").agg(F.count("*").alias("n")).join(pages, "doc")
    return counts.where((F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") * least_share))) & (~F.col("masked") | F.contains("line", F.lit("#")))).select("doc", "line", "masked", "n")
