"""Features by which a text is routed to a prompt, the route, and prompts from templates; all in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseloom.functions import text as T

# Patterns and words that the features count, and the limits of the routes.
COUNTED = {
    "colon_count": "[:：]", "semicolon_count": "[;；]", "table_delimiter_count": r"[|\t]", "parentheses_count": r"[()（）\[\]【】]",
    "unit_count": r"(?i)(?<![\p{L}\p{N}_])\d+(?:[.,]\d+)?\s?(?:km/h|kph|kg|g|mg|mm|cm|m|km|kw|w|v|a|hz|n|nm|db|pa|kpa|mpa|bar|s|ms|h|min|%|°c|celsius)(?![\p{L}\p{N}_])",
    "standard_count": r"(?i)(?<![\p{L}\p{N}_])(?:UN\s*R|UN/ECE|UNECE|ECE|ISO|IEC|SAE|FMVSS|SASO|GSO|GB/T|GB|Regulation\s+No\.?|R\d{2,3})(?![\p{L}\p{N}_])",
    "certificate_count": r"(?i)(?:certificate|approval\s+number|certificat|genehmigungsnummer|n[uú]mero\s+de\s+homologaci[oó]n|номер|شهادة|证书|认证编号)",
    "list_marker_count": r"(?m)^\s*(?:[-*•·]|\d+[.)]|[A-Za-z][.)])\s+",
}
#: No letter or figure of the Latin script before.
NUMBERING, CLAUSE = r"(?:\d+(?:[./-]\d+)+|\d+[.)])", r"(?:\d+(?:\.\d+){1,4}|[A-Za-z]?\d+/\d+)"
LEGAL = (
    "definition|definitions|requirement|requirements|certification|approval|test|testing|conformity|compliance|shall|must|definitionen|anforderung|anforderungen|genehmigung|prüfung|"
    "essai|exigence|homologation|conformité|ensayo|requisito|homologación|conformidad|испыт|требован|одобр|соответств|تعريف|متطلبات|مطابقة|اختبار|اعتماد|ข้อกำหนด|การทดสอบ|การรับรอง"
)
STRUCTURED = ("table", "list", "title", "note")
SHORT, MANY_SIGNALS, MANY_MARKERS = 120, 3, 5
SIGNALS = {
    "has_colon": "colon_count", "has_semicolon": "semicolon_count", "has_table_delimiter": "table_delimiter_count", "has_numbering": "numbering_count", "has_parentheses": "parentheses_count",
    "has_unit": "unit_count", "has_standard_no": "standard_count", "has_certificate_no": "certificate_count", "has_list_marker": "list_marker_count",
}


def counts(text: Column) -> Column:
    """A struct of the counts of a text's markers and legal words."""
    t = F.coalesce(text, F.lit(""))
    out = {name: T.count(t, pattern) for name, pattern in COUNTED.items()}
    out["numbering_count"] = T.count(t, rf"(?<![A-Za-z0-9]){NUMBERING}")
    out["clause_count"] = T.count(t, rf"(?<![A-Za-z0-9]){CLAUSE}(?![A-Za-z0-9])")
    lower = F.lower(t)
    out["legal_keyword_count"] = T.let(lower, lambda x: reduce(lambda a, b: a + b, [F.contains(x, F.lit(w)).cast("int") for w in LEGAL.split("|")]))
    return F.struct(*[c.alias(n) for n, c in out.items()])


def features(c: Column, chars: Column, kind: Column, section: Column, high: Column) -> Column:
    """A struct of flags and sums over the struct of counts()."""
    flags = {name: c[count] > 0 for name, count in SIGNALS.items()}
    flags["has_clause_no"] = (F.coalesce(section, F.lit("")) != "") | (c.clause_count > 0)
    signals = reduce(lambda a, b: a + b, [x.cast("int") for x in flags.values()])
    markers = reduce(lambda a, b: a + b, [c[n] for n in (*COUNTED, "numbering_count", "clause_count")])
    structured = F.coalesce(F.lower(F.trim(kind)).isin(*STRUCTURED), F.lit(False))
    field = reduce(lambda a, b: a | b, [flags[n] for n in ("has_colon", "has_certificate_no", "has_standard_no", "has_clause_no", "has_list_marker")])
    short = chars <= SHORT
    return F.struct(
        signals.alias("structure_signal_count"), markers.alias("structure_marker_count"), (structured & (signals >= 1)).alias("structured_segment_with_signal"), (short & field).alias("field_like_short"),
        ((signals >= MANY_SIGNALS) | (markers >= MANY_MARKERS)).alias("many_structure_markers"), (short & (high == 0) & (signals <= 1) & ~structured).alias("simple_short_text"), *[x.alias(n) for n, x in flags.items()],
    )


def route(c: Column, f: Column, high: Column, required: Column, retry: Column) -> Column:
    """A struct of mode and reason: how a text is to be prompted, and by which rule."""
    structure = f.structured_segment_with_signal | f.many_structure_markers | f.field_like_short
    case = lambda mode, why: F.struct(F.lit(mode).alias("mode"), F.lit(why).alias("reason"))
    return (
        F.when(retry, case("retry_repair", "retry_needed"))
        .when(structure, case("structure", "structural segment or dense markers"))
        .when((high >= 2) | (required >= 2), case("strict_term", "several high or required terms"))
        .when((high >= 1) & (c.legal_keyword_count >= 1), case("strict_term", "high term in legal context"))
        .when(f.simple_short_text, case("lightweight", "short simple text"))
        .otherwise(case("natural_legal", "ordinary prose"))
    )


def term_lines(terms: Column) -> Column:
    """A line for each distinct pair of matched terms: - source => target [priority/status]."""
    said = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("-"))
    whole = F.filter(terms, lambda x: (F.trim(x.source_term) != "") & (F.trim(x.target_term) != ""))
    pairs = F.array_distinct(F.transform(whole, lambda x: F.concat(F.lit("- "), F.trim(x.source_term), F.lit(" => "), F.trim(x.target_term), F.lit(" ["), said(x.priority), F.lit("/"), said(x.status), F.lit("]"))))
    return F.array_join(pairs, "\n")


def target_lines(targets: Column) -> Column:
    kept = F.array_distinct(F.filter(F.transform(targets, lambda t: F.trim(t)), lambda t: t != ""))
    return F.array_join(F.transform(kept, lambda t: F.concat(F.lit("- "), t)), "\n")


#: A template for each mode, which callers may replace; {name} stands for a value.
TEMPLATES = {
    "general_no_terms": "Translate from {source} into {target}. Return only the translation.\n\n{text}",
    "general_with_terms": "Translate from {source} into {target}. Return only the translation.\nRequired terms:\n{required}\nFor reference:\n{review}\n{soft}\n\n{text}",
    "lightweight": "Translate this short text from {source} into {target}. Return only the translation.\nRequired terms:\n{required}\n\n{text}",
    "structure": "Translate from {source} into {target}; keep numbers, marks, separators and their order. Return only the translation.\nRequired terms:\n{required}\n\n{text}",
    "strict_term": "Translate from {source} into {target}; use every required term exactly. Return only the translation.\nRequired terms:\n{required}\nFor reference:\n{review}\n{soft}\n\n{text}",
    "natural_legal": "Translate from {source} into {target} as a regulation reads. Return only the translation.\nRequired terms:\n{required}\nFor reference:\n{review}\n{soft}\n\n{text}",
    "retry_repair": "Repair the translation from {source} into {target}: it lacks the terms below. Return only the repaired translation.\nMissing terms:\n{required}\n\nSource:\n{text}\n\nTranslation:\n{translation}",
}


def prompt(mode: Column, values: dict[str, Column], templates: dict[str, str] = TEMPLATES) -> Column:
    """The template of a mode with its values filled in, each once; an unknown mode takes natural_legal's."""

    def filled(template: str) -> Column:
        parts, rest = [], template
        while rest:
            head, brace, tail = rest.partition("{")
            parts.append(F.lit(head))
            name, _, rest = tail.partition("}") if brace else ("", "", "")
            if name:
                parts.append(F.coalesce(values[name], F.lit("")))
        return F.concat(*parts)

    out = filled(templates["natural_legal"])
    for name, template in templates.items():
        if name != "natural_legal":
            out = F.when(mode == name, filled(template)).otherwise(out)
    return out
