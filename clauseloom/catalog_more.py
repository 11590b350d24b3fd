"""More queries of the core: predicates, routes, splits, alignment, retries, retrieval and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom import statements as Q
from clauseloom.functions import prompts as P
from clauseloom.functions import sections as S
from clauseloom.functions import split
from clauseloom.functions import text as T
from clauseloom.operators import alignment, cascade, pages, quality, retrieval, retry, terms
from clauseloom.registry import ANSWERS, CLAUSES, RECALL, SCORES, answers, clauses, query, recall, scores
from clauseloom.session import cut, table

# -- predicates and scalars over clauses ------------------------------------------------------------

PREDICATES = {
    "noise": (lambda c: cascade.cleaned_noise(c), Q.noise_line("c")),
    "kept": (lambda c: cascade.keep_segment(F.col("source_text"), F.col("segment_type"), F.col("section_no"), 30), "coalesce(length(source_text) >= 30 OR (segment_type IN ('title', 'table') AND length(source_text) >= 8) OR (coalesce(section_no, '') <> '' AND length(source_text) >= 10), false)"),
    "directory": (lambda c: cascade.directory(c), Q.directory("c")),
    "header": (lambda c: cascade.header_or_footer(c), Q.header_or_footer("c")),
    "file_name": (lambda c: cascade.file_name_noise(c), Q.file_name_noise("c")),
    "symbols": (lambda c: cascade.symbol_noise(c), Q.symbol_noise("c", "c")),
    "language": (lambda c: cascade.language_content(F.col("source_text")), f"regexp_matches(source_text, '{cascade.LETTER}')"),
    "ended": (lambda c: T.sentence_end(F.col("source_text")), "coalesce(regexp_matches(trim(source_text, ' '), '[。.!?！？;；:：؟؛]$'), false)"),
    "strict_end": (lambda c: T.strict_end(c), Q.strict_end("c")),
    "complete_end": (lambda c: T.complete_end(c), Q.complete_end("c")),
    "terminated": (lambda c: cascade.source_terminated(F.col("source_text")), Q.source_terminated("source_text")),
    "thai": (lambda c: T.thai_dominant(F.col("source_text")), Q.thai_dominant("source_text")),
    "half": (lambda c: cascade.half_sentence(F.col("source_text")), f"regexp_matches(lower(coalesce(source_text, '')), '\\b(?:{cascade.CUT_BEHIND})\\s*$')"),
    "page_noise": (lambda c: cascade.page_noise(F.col("source_text")), r"regexp_matches(coalesce(source_text, ''), '\(cid:[0-9]+\)|\x{fffd}|[.·…]{6,}|_{4,}')"),
    "table_row": (lambda c: cascade.table_row(F.col("source_text")), f"len(list_filter(regexp_split_to_array(trim(coalesce(source_text, ''), ' '), '\\s+'), lambda x: x <> '')) >= 4 AND {Q.n_of("trim(coalesce(source_text, ''), ' ')", '[0-9]')} > 0.22 * length(trim(coalesce(source_text, ''), ' '))"),
    "chinese": (lambda c: cascade.mostly_chinese(F.col("ref_text")), f"{Q.n_of('ref_text', Q.CJK)} > {Q.n_of('ref_text', '[A-Za-z]')}"),
    "prefix": (lambda c: cascade.section_prefixes(c, F.col("section_no")), f"coalesce(starts_with(c, {Q.strip('section_no')}) AND regexp_matches(substr(c, length({Q.strip('section_no')}) + 1, 1), '^$|[ .)）:：、-]'), false)"),
}


@query(f"SELECT sample_id, {', '.join(f'{sql} AS {n}' for n, (_, sql) in PREDICATES.items())} FROM (SELECT *, {Q.clean('source_text')} AS c FROM {CLAUSES}) WHERE source_text IS NOT NULL")
def clause_predicates(s, d):
    told = T.let(T.clean(F.col("source_text")), lambda c: F.struct(*[f(c).alias(n) for n, (f, _) in PREDICATES.items()]))
    return clauses(s, d).where("source_text is not null").select("sample_id", told.alias("t")).select("sample_id", "t.*")


@query(f"""SELECT sample_id, regexp_replace(document_id || '_' || language_pair || '_' || lpad(order_source::VARCHAR, 6, '0'), '[^A-Za-z0-9_.-]+', '_', 'g') AS made_id, greatest(4096, least(8192, ceil(source_char_count * 1.2::DOUBLE)::INT + 64)) AS tokens,
 regexp_replace(source_text, '[0-9]+', '#', 'g') AS masked, array_to_string(regexp_extract_all(regexp_replace(lower(coalesce(source_text, '')), '^\\s*[0-9]+(?:\\.[0-9]+)*\\.?\\s*', ''), '[a-z0-9]+'), ' ') AS words,
 CASE alignment_confidence {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in T.CONFIDENCE.items())} END AS confidence, coalesce(nullif(trim(section_no, ' '), ''), nullif(trim(scope, ' '), ''), sample_id) AS named FROM {CLAUSES} WHERE order_source IS NOT NULL""")
def clause_scalars(s, d):
    return clauses(s, d).where("order_source is not null").select(
        "sample_id", T.sample_id(F.col("document_id"), F.col("language_pair"), F.col("order_source")).alias("made_id"), T.dynamic_tokens(F.col("source_char_count")).cast("int").alias("tokens"), T.digits_masked(F.col("source_text")).alias("masked"),
        F.array_join(T.word_list(F.col("source_text")), " ").alias("words"), T.confidence(F.col("alignment_confidence")).alias("confidence"), T.first_nonblank(F.col("section_no"), F.col("scope"), F.col("sample_id")).alias("named"),
    )


_MISSING = " OR ".join(Q.blank(c) for c in ("sample_id", "document_id", "language_pair", "source_lang", "target_lang", "source_text"))


@query(f"""WITH c AS (SELECT *, {Q.clean("coalesce(source_text, '')")} AS s FROM {CLAUSES}), j AS (SELECT sample_id, language_pair, document_id, s, CASE WHEN {_MISSING} THEN 'missing_required_fields' WHEN s = '' THEN 'empty_source_text' WHEN {Q.bad_text('s')} THEN 'noise_or_directory'
 WHEN length(s) > 3000 THEN 'too_long' WHEN length(s) < 30 AND NOT coalesce((lower(segment_type) IN ('title', 'table', 'structure') AND length(s) >= 8) OR (coalesce(section_no, '') <> '' AND length(s) >= 10 AND regexp_matches(s, '{cascade.LETTER}')), false) THEN 'too_short' ELSE 'ok' END AS reason FROM c)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN reason = 'ok' AND sample_id <> min(sample_id) FILTER (reason = 'ok') OVER (PARTITION BY language_pair, document_id, s) THEN 'duplicate_source_text' ELSE reason END AS reason FROM j) GROUP BY 1""")
def eval_reasons(s, d):
    return cascade.eval_rows(clauses(s, d)).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN NOT coalesce(use_for_da, false) THEN 'use_for_da_not_true' WHEN coalesce(trim(ref_text, ' '), '') = '' THEN 'missing_ref_text' WHEN k IS NULL THEN 'missing_alignment_confidence' WHEN k < 0.8 THEN 'alignment_confidence_below_threshold' ELSE 'ok' END AS reason, count(*) AS n FROM (SELECT *, CASE alignment_confidence {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in T.CONFIDENCE.items())} END AS k FROM {CLAUSES}) GROUP BY 1")
def reference_filter(s, d):
    return cascade.da_filter(clauses(s, d)).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE {' '.join(f"WHEN regexp_matches(x, {Q.q(p)}) THEN '{k}'" for k, p in cascade.LINE_CLASSES.items())} ELSE 'text' END AS kind FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL)) GROUP BY 1")
def line_classes(s, d):
    rows = table(s, d, "documents").where("text is not null").select(F.explode(F.split("text", "\n")).alias("x"))
    return rows.groupBy(cascade.line_class(F.col("x")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE {' '.join(f"WHEN regexp_matches(x, {Q.q(p)}) THEN '{k}'" for k, p in cascade.SPAN_CLASSES.items())} ELSE 'text' END AS kind FROM (SELECT f.required_target_term AS x FROM (SELECT unnest(failed_terms) AS f FROM {ANSWERS}) WHERE f.required_target_term IS NOT NULL)) GROUP BY 1")
def span_classes(s, d):
    spans = answers(s, d).select(F.explode("failed_terms").alias("f")).select(F.col("f.required_target_term").alias("x")).where("x is not null")
    return spans.groupBy(cascade.span_class(F.col("x")).alias("kind")).agg(F.count("*").alias("n"))


# -- routes and prompts -----------------------------------------------------------------------------


def _routed(s, d):
    rows = clauses(s, d).join(recall(s, d).select("sample_id", "matched_high_count", F.size("required_target_terms").alias("required")), "sample_id").where("source_text is not null")
    high = F.coalesce("matched_high_count", F.lit(0))
    counted = rows.withColumn("high", high).withColumn("c", P.counts(F.col("source_text")))
    return counted.withColumn("f", P.features(F.col("c"), F.col("source_char_count"), F.col("segment_type"), F.col("section_no"), F.col("high")))


_PLAIN = {n: p for n, p in P.COUNTED.items() if "(?<!" not in p}  # without looking around
_COUNT_SQL = ", ".join(f"{Q.n_of('source_text', p)} AS {n}" for n, p in _PLAIN.items())


@query(f"SELECT sample_id, {_COUNT_SQL}, ({' + '.join(f"contains(lower(source_text), '{w}')::INT" for w in P.LEGAL.split('|'))})::INT AS legal_keyword_count FROM {CLAUSES} JOIN (SELECT DISTINCT sample_id FROM term_recall) USING (sample_id) WHERE source_text IS NOT NULL")
def route_counts(s, d):
    return _routed(s, d).select("sample_id", *[F.col(f"c.{n}").alias(n) for n in (*_PLAIN, "legal_keyword_count")])


@query()
def route_features(s, d):
    """Every feature of each clause.  Without SQL: two counts look around; tested against a loop."""
    return _routed(s, d).select("sample_id", "c.*", "f.*")


@query()
def prompt_routes(s, d):
    """How each clause is prompted, and why.  Without SQL, as it stands on route_features."""
    routed = _routed(s, d).withColumn("r", P.route(F.col("c"), F.col("f"), F.col("high"), F.coalesce("required", F.lit(0)), F.lit(False)))
    return routed.select("sample_id", "r.mode", "r.reason")


@query()
def prompt_texts(s, d):
    """The prompt of each answer's group and mode, with its hash.  Without SQL, as templates are a parameter; tested by example."""
    rows = recall(s, d).join(clauses(s, d).select("sample_id", "source_text"), "sample_id")
    mode = F.when(F.col("experiment_group") == "no_term_baseline", "general_no_terms").when(F.col("experiment_group") == "term_baseline", "general_with_terms").otherwise(F.col("prompt_mode"))
    review = F.filter("matched_terms", lambda x: x.priority == "medium")
    values = {
        "source": T.chinese_name(F.col("source_lang")), "target": T.chinese_name(F.col("target_lang")), "required": P.target_lines(F.col("required_target_terms")), "review": P.term_lines(review),
        "soft": P.term_lines(F.filter("matched_terms", lambda x: x.priority == "low")), "text": F.col("source_text"), "translation": F.lit(""),
    }
    text = P.prompt(mode, values)
    return rows.select("sample_id", mode.alias("mode"), text.alias("prompt"), F.sha2(text, 256).alias("prompt_hash"))


@query(f"SELECT g AS experiment_group, sample_id, CASE WHEN g = 'no_term_baseline' THEN 0 ELSE coalesce(len(required_target_terms), 0) END::INT AS required, g <> 'no_term_baseline' AS uses_terms, g = 'graded_prompt' AS uses_routing FROM {RECALL}, (SELECT unnest(['no_term_baseline', 'term_baseline', 'graded_prompt']) AS g)")
def group_fan_out(s, d):
    """Each sample once for each experiment group."""
    groups = F.explode(F.array(*map(F.lit, ("no_term_baseline", "term_baseline", "graded_prompt"))))
    rows = recall(s, d).select(groups.alias("experiment_group"), "sample_id", F.coalesce(F.size("required_target_terms"), F.lit(0)).alias("n"))
    plain = F.col("experiment_group") == "no_term_baseline"
    return rows.select("experiment_group", "sample_id", F.when(plain, 0).otherwise(F.greatest("n", F.lit(0))).alias("required"), (~plain).alias("uses_terms"), (F.col("experiment_group") == "graded_prompt").alias("uses_routing"))


# -- sentences and alignment ------------------------------------------------------------------------


@query()
def sentence_counts(s, d):
    """Sentences and labelled units of both sides.  Without SQL: stops are told by what surrounds them; tested by example."""
    n = lambda c: F.size(split.sentences_auto(F.col(c)))
    return clauses(s, d).select("sample_id", n("source_text").alias("source_sentences"), n("ref_text").alias("ref_sentences"), F.size(split.labelled_units(F.col("source_text"))).alias("units"))


@query()
def sentence_pairs(s, d):
    """Sentences of source, reference and answer where all have equally many.  Without SQL; tested by example."""
    rows = answers(s, d).where("experiment_group = 'graded_prompt'").select("sample_id", "source_text", "ref_text", "hypothesis")
    return alignment.zipped(rows, "sample_id", ("source_text", "ref_text", "hypothesis"))


@query()
def labelled_pairs(s, d):
    """Labelled units of source, reference and answer.  Without SQL; tested by example."""
    rows = answers(s, d).where("experiment_group = 'graded_prompt'").select("sample_id", "source_text", "ref_text", "hypothesis")
    return alignment.labelled(rows, "sample_id", ("source_text", "ref_text", "hypothesis"))


@query()
def sentence_blocks(s, d):
    """Sentences aligned many to many by length.  Without SQL: a walk of least cost; tested against all paths."""
    rows = answers(s, d).select("sample_id", "experiment_group", "source_text", "ref_text", "hypothesis")
    return alignment.sentence_blocks(rows, ["sample_id", "experiment_group"], ("source_text", "ref_text", "hypothesis"))


@query()
def clause_alignment(s, d):
    """Sources aligned with references filed by their own order.  Without SQL: order is matched greedily; tested against a loop."""
    rows = clauses(s, d)
    side = lambda text, order: rows.where(f"{order} is not null and {text} is not null").select(F.col("document_id").alias("doc"), F.struct(F.col(order).alias("o"), F.col("sample_id").alias("s")).alias("_o"), "scope", text, "segment_type", "section_no")
    shape = lambda df, text, section: df.select("doc", F.concat_ws("/", F.lpad(F.col("_o.o").cast("string"), 8, "0"), F.col("_o.s")).alias("ord"), F.coalesce("scope", F.lit("")).alias("scope"), section.alias("section_no"), F.col(text).alias("text"), F.col("segment_type").alias("kind"))
    sources = shape(side("source_text", "order_source"), "source_text", F.col("section_no"))
    refs = shape(side("ref_text", "order_ref"), "ref_text", S.section_no(F.col("ref_text")))
    return alignment.aligned(sources, refs)


# -- retries ----------------------------------------------------------------------------------------


def _checked(s, d, group):
    return terms.checked(answers(s, d).where(F.col("experiment_group") == group)).select("sample_id", "tcr", "status")


PAIR = f"""(SELECT a.sample_id, a.tcr_sample AS before, b.tcr_sample AS after, a.tcr_status AS was, b.tcr_status AS is_ FROM {ANSWERS} a JOIN {ANSWERS} b ON a.sample_id = b.sample_id AND a.experiment_group = 'no_term_baseline' AND b.experiment_group = 'term_baseline')"""


@query(f"SELECT sample_id, before, after, after - before AS gain, coalesce(was = 'fail' AND is_ = 'pass', false) AS recovered, coalesce(was = 'fail' AND is_ = 'fail', false) AS still_fail FROM {PAIR}")
def retry_recheck(s, d):
    """The second group as a retry of the first."""
    a, b = _given(s, d)
    return retry.recheck(a, b)


def _given(s, d):
    rows = answers(s, d).select("sample_id", "experiment_group", F.col("tcr_sample").alias("tcr"), F.col("tcr_status").alias("status"))
    a = rows.where("experiment_group = 'no_term_baseline'").drop("experiment_group")
    return a, rows.where("experiment_group = 'term_baseline'").drop("experiment_group").join(a.select("sample_id"), "sample_id", "left_semi")


@query(f"""WITH r AS (SELECT * FROM {PAIR}), f AS (SELECT count(*) FILTER (tcr_status = 'pass') AS passed, count(tcr_sample) AS with_terms FROM {ANSWERS} WHERE experiment_group = 'no_term_baseline')
SELECT count(*) AS retries, count(*) FILTER (was = 'fail' AND is_ = 'pass') AS recovered, count(*) FILTER (was = 'fail' AND is_ = 'fail') AS still_fail, avg(before) AS mean_before, avg(after) AS mean_after, avg(after - before) AS mean_gain, any_value(with_terms) AS with_terms,
 round(100.0::DOUBLE * count(*) FILTER (was = 'fail' AND is_ = 'pass') / count(*), 4) AS recovery_rate, any_value(passed) + count(*) FILTER (was = 'fail' AND is_ = 'pass') AS final_passed, round(100.0::DOUBLE * (any_value(passed) + count(*) FILTER (was = 'fail' AND is_ = 'pass')) / any_value(with_terms), 4) AS final_pass_rate FROM r, f""")
def retry_summary(s, d):
    a, b = _given(s, d)
    return retry.recheck_summary(a, retry.recheck(a, b))


@query(f"SELECT sample_id, experiment_group, 1::INT AS retry_count, CASE WHEN len(list_filter(failed_terms, lambda x: coalesce(x.error_type, 'missing') = 'missing')) > 0 THEN 0 ELSE 1 END::INT AS retry_priority FROM {ANSWERS} WHERE len(failed_terms) > 0")
def retry_pool(s, d):
    return retry.pool(answers(s, d)).select("sample_id", "experiment_group", "retry_count", "retry_priority")


@query(f"SELECT a.sample_id, CASE WHEN coalesce(trim(b.hypothesis, ' '), '') <> '' AND b.tcr_status = 'pass' THEN b.hypothesis ELSE a.hypothesis END AS hypothesis, CASE WHEN coalesce(trim(b.hypothesis, ' '), '') <> '' AND b.tcr_status = 'pass' THEN 'retry_overlay' ELSE 'first_pass' END AS origin FROM (SELECT * FROM {ANSWERS} WHERE experiment_group = 'no_term_baseline') a LEFT JOIN (SELECT * FROM {ANSWERS} WHERE experiment_group = 'term_baseline') b USING (sample_id)")
def final_answers(s, d):
    """First answers, those of the second group in their place where they pass."""
    rows = answers(s, d)
    second = rows.where("experiment_group = 'term_baseline'").select("sample_id", F.col("hypothesis").alias("retry_translation"), F.when(F.col("tcr_status") == "pass", "success").otherwise("failed").alias("status"))
    return retry.overlay(rows.where("experiment_group = 'no_term_baseline'").select("sample_id", "hypothesis"), second)


@query(f"SELECT experiment_group, count(*) AS samples, count(*) = (SELECT count(DISTINCT sample_id) FROM {ANSWERS}) AS whole, count(DISTINCT (source_text)) AS texts FROM {ANSWERS} GROUP BY 1")
def group_fairness(s, d):
    rows = answers(s, d)
    all_ = rows.agg(F.count_distinct("sample_id").alias("all"))
    return rows.groupBy("experiment_group").agg(F.count("*").alias("samples"), F.count_distinct("source_text").alias("texts")).join(F.broadcast(all_)).select("experiment_group", "samples", (F.col("samples") == F.col("all")).alias("whole"), "texts")


@query(f"SELECT document_id, language_pair, source_lang, segment_type, count(*) AS n, count(score) AS scored, count(*) - count(score) AS failed, round(avg(score), 9) AS mean, stddev_pop(score) AS deviation FROM {SCORES} JOIN (SELECT sample_id, language_pair, source_lang, segment_type FROM {CLAUSES}) USING (sample_id) GROUP BY ALL")
def score_summary_by_keys(s, d):
    keys = ("document_id", "language_pair", "source_lang", "segment_type")
    rows = scores(s, d).join(clauses(s, d).select("sample_id", *keys[1:]), "sample_id")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count("score").alias("scored"), (F.count("*") - F.count("score")).alias("failed"), F.round(F.avg("score"), 9).alias("mean"), F.stddev_pop("score").alias("deviation"))


@query(f"SELECT language_pair, sample_id, section_no, left(source_text, 100) AS preview FROM {CLAUSES} QUALIFY row_number() OVER (PARTITION BY language_pair ORDER BY sample_id) <= 5")
def previews(s, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("language_pair").orderBy("sample_id"))
    return clauses(s, d).withColumn("k", rank).where("k <= 5").select("language_pair", "sample_id", "section_no", F.left("source_text", F.lit(100)).alias("preview"))


@query(f"SELECT language_pair, count(*) AS base, least(count(*), 300) AS reached, count(*) >= 300 AS full_ FROM {CLAUSES} GROUP BY 1")
def split_reach(s, d):
    return clauses(s, d).groupBy("language_pair").agg(F.count("*").alias("base")).select("language_pair", "base", F.least("base", F.lit(300)).cast("long").alias("reached"), (F.col("base") >= 300).alias("full_"))


@query(f"SELECT sample_id, document_id, language_pair, source_lang, target_lang, source_text, page_source, order_source, section_no, segment_type, source_char_count, 'source_only' AS split_role FROM {CLAUSES}")
def source_only_split(s, d):
    """A split that no reference leaks into."""
    leaks = ("ref_text", "page_ref", "order_ref", "scope", "ref_char_count", "alignment_method", "alignment_confidence", "use_for_da", "loaded_at")
    return clauses(s, d).drop(*leaks).withColumn("split_role", F.lit("source_only"))


@query(f"SELECT document_id, count(*) AS clauses, count(k) AS keyed, count(DISTINCT k) AS keys, count(ref_text) AS refs FROM (SELECT document_id, ref_text, {Q.section_key('section_no')} AS k FROM {CLAUSES}) GROUP BY 1")
def document_diagnostics(s, d):
    rows = clauses(s, d).select("document_id", "ref_text", S.section_key(F.col("section_no")).alias("k"))
    return rows.groupBy("document_id").agg(F.count("*").alias("clauses"), F.count("k").alias("keyed"), F.count_distinct("k").alias("keys"), F.count("ref_text").alias("refs"))


@query(f"SELECT a.sample_id FROM {CLAUSES} a WHERE ref_text IS NOT NULL INTERSECT SELECT sample_id FROM term_recall")
def samples_with_both(s, d):
    return clauses(s, d).where("ref_text is not null").select("sample_id").intersect(recall(s, d).select("sample_id"))


# -- retrieval and associations ---------------------------------------------------------------------


@query()
def best_matches(s, d):
    """The best match of every hundredth studied clause among all of them.  Without SQL: ratios match the longest block first; tested against a loop."""
    rows = scores(s, d).select("sample_id").join(clauses(s, d).select("sample_id", "document_id", "source_text").where("source_lang in ('en', 'de', 'fr', 'es')"), "sample_id")
    asked = rows.where(F.pmod(F.regexp_extract("sample_id", "([0-9]+)$", 1).cast("long"), F.lit(100)) == 0)
    return retrieval.best_matches(rows, asked, "sample_id", "source_text", "document_id")


EQUAL = f"(SELECT md5(lower(regexp_replace(source_text, '\\s+', ' ', 'g'))) AS g, score, hypothesis, source_text, ref_text FROM {SCORES} JOIN (SELECT sample_id, source_text, ref_text FROM {CLAUSES}) USING (sample_id) LEFT JOIN (SELECT sample_id, hypothesis FROM {ANSWERS} WHERE experiment_group = 'graded_prompt') USING (sample_id) WHERE source_text IS NOT NULL)"


def _equal(s, d):
    texts = scores(s, d).join(clauses(s, d).select("sample_id", F.col("source_text").alias("source"), F.col("ref_text").alias("ref")), "sample_id").where("source is not null")
    graded = answers(s, d).where("experiment_group = 'graded_prompt'").select("sample_id", F.col("hypothesis").alias("answer"))
    rows = texts.join(graded, "sample_id", "left")
    return rows.select("sample_id", F.md5(F.lower(F.regexp_replace("source", r"[ \t\n\f\r]+", " "))).alias("g")), rows.select("sample_id", "score", "source", "ref", "answer")


@query(f"SELECT g, count(*) AS n, avg(score) AS mean, max(score) - min(score) AS range, stddev_pop(score) AS deviation, count(DISTINCT hypothesis) AS answers, count(DISTINCT source_text) AS sources, count(DISTINCT ref_text) AS refs, max(score) - avg(score) AS lift FROM {EQUAL} GROUP BY 1 HAVING count(*) > 1")
def group_statistics(s, d):
    """Statistics of the groups of equal texts."""
    groups, rows = _equal(s, d)
    return retrieval.group_statistics(groups, rows, "sample_id", "g")


@query(f"SELECT count(score) AS n, avg(score) AS base, avg(CASE WHEN score IS NOT NULL THEN top END) AS ceiling FROM (SELECT score, max(score) OVER (PARTITION BY g) AS top FROM {EQUAL})")
def score_ceiling(s, d):
    groups, rows = _equal(s, d)
    return retrieval.ceiling(groups, rows.select("sample_id", "score"), "sample_id", "g")


def _instances(s, d):
    from clauseloom.catalog import _spots

    base = terms.usable(table(s, d, "termbase")).where("priority = 'high'").groupBy("term_id").agg(F.min("target_term").alias("target_term"))
    return _spots(s, d).groupBy("sample_id", "term_id").agg(F.count("*").alias("times")).join(base, "term_id"), clauses(s, d).select("sample_id", "ref_text").where("ref_text is not null")


@query()
def term_associations(s, d):
    """The forms that references have beside each hard term.  Without SQL for its size; tested against a loop."""
    return retrieval.associations(*_instances(s, d))


@query()
def term_association_classes(s, d):
    instances, refs = _instances(s, d)
    instances = cut(instances)
    return retrieval.association_classes(cut(retrieval.associations(instances, refs)), instances, refs)


@query()
def term_forms_by_document(s, d):
    instances, refs = _instances(s, d)
    return retrieval.form_counts(instances, refs, clauses(s, d).select("sample_id", "document_id"))


@query()
def verified_terms(s, d):
    """How surely each term's target stands in the references of texts that hold the term."""
    forms = terms.usable(table(s, d, "termbase")).select(F.col("source_term").alias("source_form"), F.col("target_term").alias("target_form"), F.regexp_extract(F.lower("source_term"), r"[\p{L}\p{N}_]+", 0).alias("head")).distinct()
    return retrieval.verified_forms(forms, clauses(s, d).select("sample_id", "source_text", "ref_text").where("source_text is not null and ref_text is not null"))


# -- pages ------------------------------------------------------------------------------------------


def _lines(s, d):
    docs = table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), T.language(F.col("lang")).alias("lang"), F.lit(1).alias("page"), "text")
    return pages.lines_of(docs)


@query()
def document_segments(s, d):
    """Documents' lines joined to clauses.  Without SQL: a walk over lines; tested by example."""
    return pages.segments(pages.scoped_lines(cut(pages.kept_lines(cut(_lines(s, d))))))


@query(f"SELECT odd, count(*) AS pages, avg(share) AS chinese FROM (SELECT page_source % 2 = 1 AS odd, {Q.n_of('source_text', Q.CJK)}::DOUBLE / greatest(length(source_text), 1) AS share FROM {CLAUSES} WHERE source_text IS NOT NULL AND page_source IS NOT NULL) GROUP BY 1")
def page_shares(s, d):
    rows = clauses(s, d).where("source_text is not null and page_source is not null").select(F.lit(1).alias("doc"), F.col("page_source").alias("page"), F.col("source_text").alias("text"))
    return pages.page_shares(rows).drop("doc")


# -- spans, triples and audits ----------------------------------------------------------------------


@query(f"""SELECT sample_id, experiment_group, term_id, min(required_target_term) AS target, min(observed) AS span FROM (SELECT sample_id, experiment_group, lower(source_text) AS t, unnest(failed_terms, recursive := true) FROM {ANSWERS})
 WHERE observed <> '' AND contains(t, lower(source_term)) AND (contains(observed, required_target_term) OR contains(required_target_term, observed)) GROUP BY 1, 2, 3""")
def span_conflicts(s, d):
    """What was observed in the place of a term that the source holds, where it is a part of the target or holds it; the first a term."""
    rows = answers(s, d).select("sample_id", "experiment_group", F.lower("source_text").alias("t"), F.explode("failed_terms").alias("f")).select("sample_id", "experiment_group", "t", "f.*")
    near = F.contains("observed", "required_target_term") | F.contains("required_target_term", "observed")
    met = rows.where((F.col("observed") != "") & F.contains("t", F.lower("source_term")) & near)
    return met.groupBy("sample_id", "experiment_group", "term_id").agg(F.min("required_target_term").alias("target"), F.min("observed").alias("span"))


@query(f"SELECT count(*) AS rows, count(*) FILTER (whole) AS triples, count(*) - count(*) FILTER (whole) AS skipped FROM (SELECT coalesce(trim(source_text, ' '), '') <> '' AND coalesce(trim(hypothesis, ' '), '') <> '' AND length(coalesce(trim(ref_text, ' '), '')) >= 2 AS whole FROM {ANSWERS})")
def score_triples(s, d):
    """How many answers make a triple of source, answer and reference, whatever the columns are called."""
    made = retry.triples(answers(s, d), 2)
    return made.agg(F.count("*").alias("rows"), F.count_if("whole").alias("triples"), F.count_if(~F.col("whole")).alias("skipped"))


@query(f"SELECT document_id, coalesce(scope, '') AS scope, section_no, count(*) AS n FROM {Q.prefiltered(CLAUSES)} WHERE reason = 'ok' GROUP BY ALL HAVING count(*) > 1")
def repeated_sections(s, d):
    """The audit of scored clauses: sections that still have more than one."""
    kept = cascade.prefiltered(clauses(s, d)).where("reason = 'ok'")
    return kept.groupBy("document_id", F.coalesce("scope", F.lit("")).alias("scope"), "section_no").agg(F.count("*").alias("n")).where("n > 1")
