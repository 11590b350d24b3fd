"""The queries of the core over answers, terms, clauses, documents and probes, with the SQL that states the same over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseloom import statements as Q
from clauseloom.functions import sections as S
from clauseloom.functions import text as T
from clauseloom.operators import cascade, joins, quality, stats, terms
from clauseloom.registry import ALL, ANSWERS, CLAUSES, SCORES, answers, clauses, query, recall, scores
from clauseloom.session import table
from clauseloom.statements import clean, n_of, terminal
from clauseloom.streaming import monitor

FLAGSHIP = "tcr_group_summary"

# Pieces of SQL used by several statements.
CJK = Q.CJK
BUCKET = "CASE WHEN source_char_count < 80 THEN 'short' WHEN source_char_count <= 300 THEN 'medium' ELSE 'long' END"
BAND = "CASE WHEN source_char_count < 100 THEN '<100' WHEN source_char_count < 200 THEN '100-199' WHEN source_char_count < 300 THEN '200-299' ELSE '300+' END"
KEY = Q.section_key("section_no")


# -- term consistency ---------------------------------------------------------------------------


@query(f"""SELECT experiment_group, count(*) AS n, count(*) FILTER (tcr_status = 'pass') AS passed, count(*) FILTER (tcr_status = 'fail') AS failed,
 count(*) FILTER (tcr_status = 'no_terms') AS no_terms, avg(tcr_sample) AS mean_tcr, count(*) FILTER (tcr_status = 'pass') / nullif(count(*) FILTER (tcr_status IN ('pass', 'fail')), 0) AS pass_rate FROM {ANSWERS} GROUP BY 1""")
def tcr_group_summary(s, d):
    n = lambda status: F.count_if(F.col("tcr_status") == status)
    return answers(s, d).groupBy("experiment_group").agg(
        F.count("*").alias("n"), n("pass").alias("passed"), n("fail").alias("failed"), n("no_terms").alias("no_terms"), F.avg("tcr_sample").alias("mean_tcr"),
        (n("pass") / F.nullif(n("pass") + n("fail"), F.lit(0))).alias("pass_rate"),
    )


CHECKED = f"""SELECT sample_id, experiment_group, len(targets)::INT AS required, (len(targets) - len(gone))::INT AS correct, array_to_string(gone, '|') AS missing
 FROM (SELECT *, list_filter(targets, lambda t: NOT {Q.contains_term('h', 'tight', 't')}) AS gone FROM {Q.prepared(ANSWERS)})"""
STATUS = "CASE WHEN required > 0 THEN round(correct * 100.0::DOUBLE / required, 4) END AS tcr, CASE WHEN required <= 0 THEN 'no_terms' WHEN correct = required THEN 'pass' ELSE 'fail' END AS status"


@query(f"SELECT *, {STATUS} FROM ({CHECKED})")
def tcr_rows(s, d):
    return terms.checked(answers(s, d))


@query(f"SELECT sum(correct)::BIGINT AS correct, sum(required)::BIGINT AS required, sum(correct)::DOUBLE / sum(required) AS micro, avg(CASE WHEN required = 0 OR correct = required THEN 1.0 ELSE 0.0 END) AS sample_rate FROM ({CHECKED})")
def tcr_micro(s, d):
    ok = F.when((F.col("required") == 0) | (F.col("correct") == F.col("required")), 1.0).otherwise(0.0)
    return terms.checked(answers(s, d)).agg(F.sum("correct").alias("correct"), F.sum("required").alias("required"), (F.sum("correct") / F.sum("required")).alias("micro"), F.avg(ok).alias("sample_rate"))


@query(f"SELECT coalesce(experiment_group, 'all') AS experiment_group, coalesce(prompt_mode, 'all') AS prompt_mode, count(*) AS n, sum(matched_hard_term_count)::BIGINT AS terms, avg(tcr_sample) AS mean_tcr FROM {ANSWERS} GROUP BY ROLLUP (experiment_group, prompt_mode)")
def tcr_rollup(s, d):
    return answers(s, d).rollup("experiment_group", "prompt_mode").agg(F.count("*").alias("n"), F.sum("matched_hard_term_count").alias("terms"), F.avg("tcr_sample").alias("mean_tcr")).select(
        F.coalesce("experiment_group", F.lit("all")).alias("experiment_group"), F.coalesce("prompt_mode", F.lit("all")).alias("prompt_mode"), "n", "terms", "mean_tcr"
    )


@query(f"SELECT experiment_group, error_type, count(*) AS n FROM {ANSWERS} GROUP BY ALL")
def tcr_error_types(s, d):
    return answers(s, d).groupBy("experiment_group", "error_type").agg(F.count("*").alias("n"))


FAILED = f"(SELECT experiment_group, sample_id, hypothesis, unnest(failed_terms) AS f FROM {ANSWERS})"


@query(f"SELECT experiment_group, term, n, rank FROM (SELECT experiment_group, f.required_target_term AS term, count(*) AS n, row_number() OVER (PARTITION BY experiment_group ORDER BY count(*) DESC, f.required_target_term)::INT AS rank FROM {FAILED} GROUP BY 1, 2) WHERE rank <= 10")
def failed_terms_top10(s, d):
    n = answers(s, d).select("experiment_group", F.explode("failed_terms").alias("f")).groupBy("experiment_group", F.col("f.required_target_term").alias("term")).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("experiment_group").orderBy(F.col("n").desc(), "term"))).where("rank <= 10")


@query(f"SELECT term, n, sum(n) OVER (ORDER BY n DESC, term ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(n) OVER () AS cumulative FROM (SELECT f.required_target_term AS term, count(*) AS n FROM {FAILED} GROUP BY 1)")
def failed_terms_cumulative(s, d):
    n = answers(s, d).select(F.explode("failed_terms").alias("f")).groupBy(F.col("f.required_target_term").alias("term")).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.col("n").desc(), "term")  # the distinct terms of the termbase, not the rows
    return n.select("term", "n", (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy())).alias("cumulative"))


@query(f"SELECT experiment_group, CASE WHEN coalesce(trim(hypothesis, ' '), '') = '' THEN 'missing_translation' WHEN contains(hypothesis, substr(f.required_target_term, 1, 1)) THEN 'partial' ELSE 'missing' END AS kind, count(*) AS n FROM {FAILED} GROUP BY ALL")
def failure_kinds(s, d):
    failed = answers(s, d).select("experiment_group", "hypothesis", F.explode("failed_terms").alias("f"))
    return failed.groupBy("experiment_group", terms.failure_kind(F.col("hypothesis"), F.col("f.required_target_term")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT sample_id, experiment_group, len(failed_terms)::INT AS failures, array_to_string(list_transform(failed_terms, lambda x: x.source_term || ' => ' || x.required_target_term), '; ') AS terms, sha256(coalesce(source_text, '') || chr(10) || array_to_string(required_target_terms, '; ')) AS prompt_hash FROM {ANSWERS} WHERE tcr_status = 'fail'")
def retry_inputs(s, d):
    failed = answers(s, d).where("tcr_status = 'fail'")
    lines = F.array_join(F.transform("failed_terms", lambda x: F.concat(x.source_term, F.lit(" => "), x.required_target_term)), "; ")
    prompt = F.concat(F.coalesce("source_text", F.lit("")), F.lit("\n"), F.array_join("required_target_terms", "; "))
    return failed.select("sample_id", "experiment_group", F.size("failed_terms").alias("failures"), lines.alias("terms"), F.sha2(prompt, 256).alias("prompt_hash"))


ARMS = f"""WITH a AS (SELECT sample_id, source_lang, tcr_sample AS x FROM {ANSWERS} WHERE experiment_group = 'no_term_baseline'), b AS (SELECT sample_id, tcr_sample AS y FROM {ANSWERS} WHERE experiment_group = 'graded_prompt')
SELECT source_lang, count(*) AS pairs, avg(y - x) AS delta, count(*) FILTER (y > x) AS up, count(*) FILTER (y < x) AS down, count(*) FILTER (y = x) AS same FROM a JOIN b USING (sample_id) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1"""


@query(ARMS)
def arm_comparison(s, d):
    return joins.arms(answers(s, d), "no_term_baseline", "graded_prompt")


@query(f"SELECT a.sample_id, len(list_filter(list_transform(b.failed_terms, lambda x: x.term_id), lambda t: NOT list_contains(list_transform(a.failed_terms, lambda x: x.term_id), t))) = 0 AND len(b.failed_terms) < len(a.failed_terms) AS accepted FROM {ANSWERS} a JOIN {ANSWERS} b ON a.sample_id = b.sample_id AND a.experiment_group = 'no_term_baseline' AND b.experiment_group = 'graded_prompt' WHERE a.tcr_status = 'fail'")
def strict_subset_guard(s, d):
    rows = answers(s, d).select("sample_id", "experiment_group", "tcr_status", F.transform("failed_terms", lambda x: x.term_id).alias("t"))
    a = rows.where("experiment_group = 'no_term_baseline' and tcr_status = 'fail'").select("sample_id", F.col("t").alias("before"))
    b = rows.where("experiment_group = 'graded_prompt'").select("sample_id", F.col("t").alias("after"))
    return a.join(b, "sample_id").select("sample_id", ((F.size(F.array_except("after", "before")) == 0) & (F.size("after") < F.size("before"))).alias("accepted"))


@query(f"SELECT sample_id, experiment_group FROM (SELECT sample_id, experiment_group, row_number() OVER (PARTITION BY sample_id ORDER BY (tcr_status = 'pass')::INT DESC, coalesce(tcr_sample, -1) DESC, experiment_group) AS r FROM {ANSWERS}) WHERE r = 1")
def rerank_choice(s, d):
    order = Window.partitionBy("sample_id").orderBy((F.col("tcr_status") == "pass").cast("int").desc(), F.coalesce("tcr_sample", F.lit(-1.0)).desc(), "experiment_group")
    return answers(s, d).withColumn("r", F.row_number().over(order)).where("r = 1").select("sample_id", "experiment_group")


@query("SELECT sample_id, experiment_group, max(loaded_at) AS loaded_at, count(*) AS deliveries FROM tcr_check GROUP BY 1, 2")
def latest_delivery(s, d):
    return table(s, d, "tcr_check").groupBy("sample_id", "experiment_group").agg(F.max("loaded_at").alias("loaded_at"), F.count("*").alias("deliveries"))


GROUPS = "(SELECT DISTINCT sample_id, experiment_group FROM tcr_check)"


@query(f"SELECT experiment_group, count(*) AS present, (SELECT count(DISTINCT sample_id) FROM tcr_check) - count(*) AS missing FROM {GROUPS} GROUP BY 1")
def group_sample_sets(s, d):
    return joins.missing_from(table(s, d, "tcr_check"), "sample_id", "experiment_group")


@query(f"SELECT sample_id FROM {GROUPS} WHERE experiment_group = 'term_baseline' AND sample_id NOT IN (SELECT sample_id FROM {GROUPS} WHERE experiment_group = 'graded_prompt')")
def resume_pending(s, d):
    rows = table(s, d, "tcr_check").select("sample_id", "experiment_group").distinct()
    return rows.where("experiment_group = 'term_baseline'").select("sample_id").join(rows.where("experiment_group = 'graded_prompt'"), "sample_id", "left_anti")


@query(f"SELECT experiment_group, source_lang, count(*) AS answers, count(*) FILTER ({terminal('hypothesis')}) AS ended FROM {ANSWERS} GROUP BY ALL")
def terminal_marks(s, d):
    return answers(s, d).groupBy("experiment_group", "source_lang").agg(F.count("*").alias("answers"), F.count_if(T.terminal(F.col("hypothesis"))).alias("ended"))


NUM = "list_distinct(regexp_extract_all(coalesce({c}, ''), '[0-9]+'))"


@query(f"SELECT sample_id, experiment_group, len(list_filter({NUM.format(c='source_text')}, lambda x: NOT list_contains({NUM.format(c='hypothesis')}, x)))::INT AS missing FROM {ANSWERS}")
def number_consistency(s, d):
    return answers(s, d).select("sample_id", "experiment_group", F.size(F.array_except(T.numbers(F.col("source_text")), T.numbers(F.col("hypothesis")))).alias("missing"))


@query()
def character_error_rate(s, d):
    """Every answer with a reference, both without white space.  Without SQL: DuckDB's distance counts bytes, not characters."""
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), f"[{T.SPACES}]+", "")
    rows = answers(s, d).select("sample_id", "experiment_group", flat(F.col("hypothesis")).alias("h"), flat(F.col("ref_text")).alias("r")).where("r <> ''")
    n = F.levenshtein("h", "r")
    return rows.select("sample_id", "experiment_group", n.alias("distance"), (n / F.length("r")).alias("cer"))


# -- terms ---------------------------------------------------------------------------------------

LANG = " ".join(f"""WHEN f IN ({", ".join(repr(x) for x in v.split("|"))}) THEN {k!r}""" for k, v in T.LANGUAGES.items())


def code(c: str) -> str:
    return f"(CASE {LANG.replace(' f IN', f" lower(regexp_replace(trim({c}, ' '), '[-_].*$', '')) IN").replace('WHEN f IN', f"WHEN lower(regexp_replace(trim({c}, ' '), '[-_].*$', '')) IN")} ELSE lower(trim({c}, ' ')) END)"


USABLE = f"""(SELECT DISTINCT * FROM (SELECT term_id, {code('source_lang')} AS source_lang, {code('target_lang')} AS target_lang, coalesce(nullif(lower(trim(priority, ' ')), ''), '') AS priority, coalesce(nullif(lower(trim(status, ' ')), ''), 'active') AS status,
 trim(source_term, ' ') AS source_term, trim(target_term, ' ') AS target_term, list_filter(list_transform(regexp_split_to_array(coalesce(alias, ''), '[|;,\n]+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS aliases FROM termbase)
 WHERE status = 'active' AND coalesce(source_term, '') <> '' AND coalesce(target_term, '') <> '')"""


@query(f"SELECT term_id, source_lang, target_lang, priority, status, source_term, target_term, array_to_string(aliases, ';') AS aliases, length(source_term)::INT AS n FROM {USABLE}")
def termbase_usable(s, d):
    return terms.usable(table(s, d, "termbase")).withColumn("aliases", F.array_join("aliases", ";")).withColumn("n", F.length("source_term"))


@query("SELECT DISTINCT term_id, alias_ FROM (SELECT term_id, trim(unnest(regexp_split_to_array(coalesce(alias, ''), '[|;,\n]+')), ' ') AS alias_ FROM termbase) WHERE alias_ <> ''")
def termbase_aliases(s, d):
    return table(s, d, "termbase").select("term_id", F.explode(T.split_aliases(F.col("alias"))).alias("alias_")).distinct()


@query(f"SELECT source_lang, lower(target_term) AS target, min(term_id) AS first_term, count(*) AS n FROM {USABLE} GROUP BY 1, 2")
def termbase_dedup(s, d):
    return terms.usable(table(s, d, "termbase")).groupBy("source_lang", F.lower("target_term").alias("target")).agg(F.min("term_id").alias("first_term"), F.count("*").alias("n"))


@query("SELECT source_lang, coalesce(priority, 'none') AS priority, coalesce(status, 'none') AS status, count(*) AS n FROM termbase GROUP BY ALL")
def termbase_profile(s, d):
    none = lambda c: F.coalesce(c, F.lit("none")).alias(c)
    return table(s, d, "termbase").groupBy("source_lang", none("priority"), none("status")).agg(F.count("*").alias("n"))


OWN = f"(SELECT DISTINCT source_lang, target_term FROM {USABLE})"


@query(f"SELECT l.source_lang, t.target_term FROM (SELECT DISTINCT source_lang FROM {OWN}) l CROSS JOIN (SELECT DISTINCT target_term FROM {OWN}) t ANTI JOIN {OWN} h ON h.source_lang = l.source_lang AND h.target_term = t.target_term")
def termbase_gaps(s, d):
    """The concepts that the terms of other languages have and a language's own don't."""
    own = terms.usable(table(s, d, "termbase")).select("source_lang", "target_term").distinct()
    # as many languages as there are: a list of a few codes stands beside each concept
    langs = own.groupBy().agg(F.sort_array(F.collect_set("source_lang")).alias("langs"))
    return own.groupBy("target_term").agg(F.collect_set("source_lang").alias("have")).join(F.broadcast(langs)).select(F.explode(F.array_except("langs", "have")).alias("source_lang"), "target_term")


SPOTS = f"""listed AS (SELECT *, unnest([{{'m': source_term, 'a': 0}}] || list_transform(aliases, lambda x: {{'m': x, 'a': 1}})) AS x FROM {USABLE}),
met AS (SELECT sample_id, term_id, priority, -length(source_term) AS n, x.m AS matched_text, x.a AS is_alias, lower(source_text) AS t, lower(x.m) AS w, string_split(lower(source_text), lower(x.m)) AS p,
 regexp_matches(lower(x.m), '^[\\p{{L}}\\p{{N}}]') AND regexp_matches(lower(x.m), '[\\p{{L}}\\p{{N}}]$') AS bounded
 FROM (SELECT DISTINCT sample_id, source_lang, source_text FROM prepare_da_pairs) c JOIN listed u USING (source_lang) WHERE contains(lower(source_text), lower(x.m))),
spots AS (SELECT *, unnest(range(1, len(p))) AS i FROM met),
placed AS (SELECT * EXCLUDE (p, i), (list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(w))::INT AS first FROM spots),
found AS (SELECT sample_id, term_id, priority, n, matched_text, is_alias, first, (first + length(w))::INT AS last FROM placed
 WHERE NOT bounded OR ((first = 0 OR regexp_matches(substr(t, first, 1), '[^\\p{{L}}\\p{{N}}_]')) AND (first + length(w) = length(t) OR regexp_matches(substr(t, first + length(w)::INT + 1, 1), '[^\\p{{L}}\\p{{N}}_]')))),
kept AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, first, last ORDER BY is_alias, n, term_id) AS k FROM found a
 WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.sample_id = a.sample_id AND b.first <= a.first AND b.last >= a.last AND (b.first < a.first OR b.last > a.last))) WHERE k = 1)"""


def _spots(s, d):
    texts = table(s, d, "prepare_da_pairs").select("sample_id", "source_lang", "source_text").dropDuplicates(["sample_id"]).where("source_text is not null")
    return terms.longest(terms.occurrences(texts, terms.usable(table(s, d, "termbase"))))


@query(f"WITH {SPOTS} SELECT sample_id, term_id, priority, is_alias::INT AS is_alias, first, last FROM kept")
def term_occurrences(s, d):
    return _spots(s, d).select("sample_id", "term_id", "priority", "is_alias", "first", "last")


@query(f"WITH {SPOTS} SELECT sample_id, term_id, priority, matched_text, CASE WHEN is_alias = 1 THEN 'alias' ELSE 'source_term' END AS matched_by FROM kept QUALIFY row_number() OVER (PARTITION BY sample_id, term_id ORDER BY first - last, is_alias, first) = 1")
def matched_terms(s, d):
    return terms.matched(_spots(s, d))


@query(f"WITH {SPOTS} SELECT sample_id, count(DISTINCT term_id) AS matched, count(DISTINCT term_id) FILTER (priority = 'high') AS high FROM kept GROUP BY 1")
def term_match_counts(s, d):
    return _spots(s, d).groupBy("sample_id").agg(F.count_distinct("term_id").alias("matched"), F.count_distinct(F.when(F.col("priority") == "high", F.col("term_id"))).alias("high"))


HARD = f"(SELECT * FROM {USABLE} WHERE priority = 'high')"


@query(f"""WITH hard AS {HARD}, said AS (SELECT source_lang, lower(target_term) AS key, lower(w) AS w FROM (SELECT source_lang, target_term, unnest([source_term] || aliases) AS w FROM hard)),
wanted AS (SELECT sample_id, experiment_group, source_lang, lower(source_text) AS t, unnest(required_target_terms) AS target FROM {ANSWERS}),
told AS (SELECT sample_id, experiment_group, list_sort(list_distinct(list(target))) AS l FROM wanted a JOIN said b ON a.source_lang = b.source_lang AND lower(trim(a.target, ' ')) = b.key AND contains(t, w) GROUP BY 1, 2),
{SPOTS.replace(USABLE, 'hard')},
recalled AS (SELECT sample_id, list_sort(list_distinct(list(h.target_term))) AS r FROM (SELECT DISTINCT sample_id, term_id FROM found) JOIN hard h USING (term_id) GROUP BY 1)
SELECT sample_id, experiment_group, CASE WHEN l IS NOT NULL THEN 'listed' WHEN r IS NOT NULL THEN 'recalled' ELSE 'none' END AS origin, array_to_string(coalesce(l, r, []), '|') AS terms
FROM (SELECT DISTINCT sample_id, experiment_group FROM tcr_check) LEFT JOIN told USING (sample_id, experiment_group) LEFT JOIN recalled USING (sample_id)""")
def required_terms(s, d):
    return terms.required(answers(s, d), terms.usable(table(s, d, "termbase")))


@query(f"""SELECT experiment_group, given, kind, count(*) AS n FROM (SELECT experiment_group, f.error_type AS given,
 CASE WHEN len(list_filter(own, lambda a: {Q.contains_term('h', 'tight', 'a')})) > 0 THEN 'alias_only'
  WHEN (length(han) >= 4 AND len(list_filter(range(1, greatest(length(han) - m + 1, 1) + 1), lambda i: contains(h, substr(han, i, m)))) > 0) OR len(list_filter(regexp_split_to_array(target, '[\\s\\-/()（）,，;；:：]+'), lambda w: length(w) >= 2 AND {Q.contains_term('h', 'tight', 'w')})) > 0 THEN 'partial'
  WHEN {Q.contains_term('h', 'tight', 'source')} THEN 'wrong_translation' ELSE 'missing' END AS kind
 FROM (SELECT *, greatest(2, length(han) // 3)::INT AS m, list_filter(al, lambda a, i: a <> target AND list_position(list_transform(list_filter(al, lambda y: y <> target), lambda y: lower(y)), lower(a)) IS NOT NULL) || CASE WHEN source <> '' AND source <> target AND length(source) <= 20 THEN [source] ELSE [] END AS own
  FROM (SELECT experiment_group, h, tight, f, coalesce(trim(f.source_term, ' '), '') AS source, coalesce(trim(f.required_target_term, ' '), '') AS target, regexp_replace(coalesce(trim(f.required_target_term, ' '), ''), '[^一-鿿]+', '', 'g') AS han,
   coalesce(al, []) AS al FROM (SELECT experiment_group, h, tight, unnest(failed_terms) AS f FROM {Q.prepared(ANSWERS)}) LEFT JOIN (SELECT term_id AS tid, arg_min(aliases, (source_lang, source_term)) AS al FROM {USABLE} GROUP BY 1) ON tid = f.term_id))) GROUP BY ALL""")
def failure_kinds_by_rule(s, d):
    return terms.failure_kinds(answers(s, d), terms.usable(table(s, d, "termbase"))).groupBy("experiment_group", "given", "kind").agg(F.count("*").alias("n"))


SUFFIXES = ("s", "es", "en", "er", "e", "n", "а", "ы", "и", "у", "ой", "ом", "ами", "ов")


@query()
def tolerant_matches(s, d):
    """Without SQL: tested against a loop."""
    texts = table(s, d, "prepare_da_pairs").select("sample_id", "source_lang", "source_text").dropDuplicates(["sample_id"])
    return terms.tolerant_impact(texts, terms.usable(table(s, d, "termbase")), SUFFIXES)


_STATUS, _PRIORITY = "lower(coalesce(nullif(x.status, ''), 'active'))", "lower(coalesce(x.priority, ''))"
_TIER = {"hard": f"{_PRIORITY} = 'high' AND {_STATUS} = 'active'", "review": f"({_STATUS} = 'review' OR ({_STATUS} = 'active' AND {_PRIORITY} = 'medium'))", "soft": f"{_PRIORITY} = 'low' AND {_STATUS} = 'active'"}


@query(f"""SELECT DISTINCT sample_id, {', '.join(f"coalesce(len(list_filter(matched_terms, lambda x: {c})), -1)::INT AS {n}" for n, c in _TIER.items())},
 coalesce(array_to_string(list_filter(ts, lambda t, i: list_position(ts, t) = i), '|')) AS targets FROM (SELECT *, list_filter(list_transform(list_filter(matched_terms, lambda x: {_TIER['hard']}), lambda x: trim(x.target_term, ' ')), lambda t: t <> '') AS ts FROM term_recall)""")
def term_tiers(s, d):
    return terms.tiers(recall(s, d))


@query(f"SELECT kind, count(*) AS n FROM (SELECT DISTINCT sample_id, section_no, {KEY} AS k, split_part({KEY}, ':', 1) AS kind FROM term_recall) WHERE k IS NOT NULL GROUP BY 1")
def section_key_kinds(s, d):
    keyed = recall(s, d).withColumn("k", S.section_key(F.col("section_no"))).where("k is not null")
    return keyed.groupBy(F.substring_index("k", ":", 1).alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT sample_id, section_no, {KEY} AS section_key FROM term_recall")
def section_keys(s, d):
    return recall(s, d).select("sample_id", "section_no", S.section_key(F.col("section_no")).alias("section_key"))


# -- clauses -------------------------------------------------------------------------------------


@query(f"SELECT sample_id, {clean('source_text')} AS source, {clean('ref_text')} AS ref FROM {CLAUSES}")
def cleaned_texts(s, d):
    return clauses(s, d).select("sample_id", T.clean(F.col("source_text")).alias("source"), T.clean(F.col("ref_text")).alias("ref"))


@query(f"SELECT sample_id, {n_of('ref_text', CJK)} AS cjk, {Q.good('source_text')} AS good FROM {CLAUSES}")
def character_ratios(s, d):
    return clauses(s, d).select("sample_id", T.count(F.col("ref_text"), T.CJK).alias("cjk"), T.good_ratio(F.col("source_text")).alias("good"))


@query(f"SELECT language_pair, {BUCKET} AS bucket, {BAND} AS band, count(*) AS n FROM {CLAUSES} GROUP BY ALL")
def length_classes(s, d):
    n = F.col("source_char_count")
    return clauses(s, d).groupBy("language_pair", T.length_bucket(n).alias("bucket"), T.band(n).alias("band")).agg(F.count("*").alias("n"))


@query(f"SELECT band, count(*) AS n, avg(score) AS mean_score FROM (SELECT score, unnest(list_filter(['all', CASE WHEN source_char_count <= 199 THEN '<=199' END, {BAND}], lambda x: x IS NOT NULL)) AS band FROM {SCORES} JOIN (SELECT sample_id, source_char_count FROM {CLAUSES}) USING (sample_id)) GROUP BY 1")
def overlapping_bands(s, d):
    n = F.col("source_char_count")
    rows = scores(s, d).join(clauses(s, d).select("sample_id", "source_char_count"), "sample_id")
    memberships = F.filter(F.array(F.lit("all"), F.when(n <= 199, "<=199"), T.band(n)), lambda x: x.isNotNull())
    return rows.select("score", F.explode(memberships).alias("band")).groupBy("band").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


@query(f"SELECT language_pair, alignment_method, alignment_confidence, segment_type, count(*) AS n FROM {CLAUSES} GROUP BY ALL")
def alignment_counts(s, d):
    keys = ("language_pair", "alignment_method", "alignment_confidence", "segment_type")
    return clauses(s, d).groupBy(*keys).agg(F.count("*").alias("n"))


@query(f"SELECT sample_id, {Q.section_no('source_text')} AS found FROM {CLAUSES}")
def section_numbers(s, d):
    return clauses(s, d).select("sample_id", S.section_no(F.col("source_text")).alias("found"))


@query(f"SELECT segment_type, {Q.segment_type('source_text', "coalesce(trim(section_no, ' '), '') <> ''")} AS by_rule, count(*) AS n FROM {CLAUSES} GROUP BY ALL")
def segment_types(s, d):
    has = F.coalesce(F.trim("section_no"), F.lit("")) != ""
    return clauses(s, d).groupBy("segment_type", T.segment_type(F.col("source_text"), has).alias("by_rule")).agg(F.count("*").alias("n"))


REASONED = Q.prefiltered(CLAUSES)


@query(f"SELECT reason, count(*) AS n FROM {REASONED} GROUP BY 1")
def prefilter_reasons(s, d):
    return cascade.prefiltered(clauses(s, d)).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""SELECT sample_id, document_id, scope, section_no, score FROM (SELECT *, row_number() OVER (PARTITION BY document_id, scope, section_no ORDER BY score DESC, sample_id) AS rank FROM (SELECT sample_id, document_id, coalesce(scope, '') AS scope, section_no,
 round(10.0::DOUBLE - abs(length(r)::DOUBLE / greatest(length(s), 1) - 0.55) + least(length(s), 240)::DOUBLE / 240 + least(length(r), 140)::DOUBLE / 140 + CASE WHEN {Q.complete_end('s')} AND {Q.strict_end('r')} THEN 1.0 ELSE 0.0 END, 6) AS score FROM {REASONED} WHERE reason = 'ok')) WHERE rank = 1""")
def best_candidates(s, d):
    return quality.best_per_clause(clauses(s, d))


LEDGER = Q.ledger(CLAUSES)


@query(f"SELECT * FROM {LEDGER}")
def exclusion_ledger(s, d):
    return quality.ledger(clauses(s, d))


@query(f"SELECT rule, count(*) AS n FROM (SELECT unnest(string_split(rules, ',')) AS rule FROM {LEDGER}) GROUP BY 1")
def exclusion_summary(s, d):
    return quality.ledger(clauses(s, d)).select(F.explode(F.split("rules", ",")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


TIER_SQL = " UNION ALL ".join(f"SELECT '{t}' AS tier, [{', '.join(repr(x) for x in r)}]::VARCHAR[] AS gone" for t, r in quality.TIERS.items())


@query(f"SELECT tier, count(*) FILTER (NOT list_has_any(hit, gone)) AS n, avg(score) FILTER (NOT list_has_any(hit, gone)) AS mean_score, count(*) FILTER (list_has_any(hit, gone)) AS excluded, count(*) FILTER (list_has_any(hit, gone))::DOUBLE / count(*) AS exclusion_rate FROM (SELECT score, string_split(coalesce(rules, ''), ',') AS hit FROM {SCORES} LEFT JOIN {LEDGER} USING (sample_id)), ({TIER_SQL}) GROUP BY 1")
def sensitivity_tiers(s, d):
    return quality.sensitivity(scores(s, d), quality.ledger(clauses(s, d)))


@query(f"SELECT DISTINCT sample_id, {', '.join(f"NOT list_has_any(hit, [{', '.join(map(repr, r))}]) AS {n}" for n, r in (('in_v1', quality.HEADLINE_V1), ('in_v2', quality.HEADLINE_V2), ('in_full', quality.ALL_RULES)))} FROM (SELECT sample_id, string_split(coalesce(rules, ''), ',') AS hit FROM {SCORES} LEFT JOIN {LEDGER} USING (sample_id))")
def headline_sets(s, d):
    return quality.headline(scores(s, d).select("sample_id").distinct(), quality.ledger(clauses(s, d)))


@query(f"SELECT bucket, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM {CLAUSES} WHERE ref_text IS NOT NULL AND source_text IS NOT NULL) AS rate FROM {LEDGER} GROUP BY 1")
def exclusion_buckets(s, d):
    all_ = clauses(s, d).where("ref_text is not null and source_text is not null").agg(F.count("*").alias("all"))
    return quality.ledger(clauses(s, d)).groupBy("bucket").agg(F.count("*").alias("n")).join(F.broadcast(all_)).select("bucket", "n", (F.col("n") / F.col("all")).alias("rate"))


@query(f"SELECT sample_id, CASE WHEN list_contains(hit, 'R2') THEN 'R2' WHEN list_contains(hit, 'R2a') THEN 'R2a' WHEN list_contains(hit, 'R2b') THEN 'R2b' WHEN list_contains(hit, 'R3') THEN 'R3' WHEN list_contains(hit, 'G2') THEN 'G2' WHEN list_contains(hit, 'G1') THEN 'G1' ELSE 'ok' END AS reason FROM (SELECT c.sample_id, string_split(coalesce(rules, ''), ',') AS hit FROM {CLAUSES} c LEFT JOIN {LEDGER} USING (sample_id) WHERE ref_text IS NOT NULL AND source_text IS NOT NULL)")
def training_reasons(s, d):
    return quality.training_reason(clauses(s, d))


@query(f"SELECT side, count(*) AS clauses, count(*) FILTER (strong) AS hits FROM (SELECT 'source' AS side, {Q.watermark('source_text')} AS strong FROM {CLAUSES} UNION ALL SELECT 'ref', {Q.watermark('ref_text')} FROM {CLAUSES}) GROUP BY 1")
def watermark_audit(s, d):
    sides = F.array(F.struct(F.lit("source").alias("side"), F.col("source_text").alias("t")), F.struct(F.lit("ref").alias("side"), F.col("ref_text").alias("t")))
    return clauses(s, d).select(F.explode(sides).alias("x")).groupBy("x.side").agg(F.count("*").alias("clauses"), F.count_if(cascade.watermark(F.col("x.t"))).alias("hits"))


@query(f"SELECT language_pair, count(*) AS n, avg(ratio) AS mean, quantile_cont(ratio, 0.1) AS p10, quantile_cont(ratio, 0.5) AS p50, quantile_cont(ratio, 0.9) AS p90 FROM (SELECT language_pair, ref_char_count::DOUBLE / source_char_count AS ratio FROM {CLAUSES} WHERE ref_char_count > 0 AND source_char_count > 0) GROUP BY 1")
def alignment_health(s, d):
    rows = clauses(s, d).where("ref_char_count > 0 and source_char_count > 0").withColumn("ratio", F.col("ref_char_count") / F.col("source_char_count"))
    means = rows.groupBy("language_pair").agg(F.count("*").alias("n"), F.avg("ratio").alias("mean"))
    return means.join(stats.quantiles(rows, ["language_pair"], "ratio", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), "language_pair")


@query(f"""WITH r AS (SELECT sample_id, language_pair, ref_char_count::DOUBLE / source_char_count AS ratio FROM {CLAUSES} WHERE ref_char_count > 0 AND source_char_count > 0), m AS (SELECT language_pair, quantile_cont(ratio, 0.5) AS mid FROM r GROUP BY 1)
SELECT sample_id, language_pair, ratio FROM r JOIN m USING (language_pair) WHERE ratio > 2 * mid""")
def length_outliers(s, d):
    rows = clauses(s, d).where("ref_char_count > 0 and source_char_count > 0").select("sample_id", "language_pair", (F.col("ref_char_count") / F.col("source_char_count")).alias("ratio"))
    middle = stats.quantiles(rows, ["language_pair"], "ratio", {"mid": 0.5})
    return rows.join(middle, "language_pair").where("ratio > 2 * mid").select("sample_id", "language_pair", "ratio")


@query(f"""SELECT sample_id, language_pair, turn, place FROM (SELECT *, row_number() OVER (PARTITION BY language_pair ORDER BY turn, h)::INT AS place FROM (SELECT sample_id, language_pair, md5(sample_id) AS h,
 row_number() OVER (PARTITION BY language_pair, document_id, segment_type, {BUCKET}, coalesce(trim(section_no, ' '), '') <> '' ORDER BY md5(sample_id))::INT AS turn FROM {CLAUSES})) WHERE place <= 300""")
def stratified_sample(s, d):
    return quality.sample(clauses(s, d), 300)


@query(f"SELECT source_text, count(*) AS n, min(sample_id) AS first_sample FROM {CLAUSES} WHERE source_text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def repeated_sources(s, d):
    return clauses(s, d).where("source_text is not null").groupBy("source_text").agg(F.count("*").alias("n"), F.min("sample_id").alias("first_sample")).where("n > 1")


KEYED = f"(SELECT sample_id, document_id, {KEY} AS k, ref_text IS NOT NULL AS has FROM {CLAUSES})"


@query(f"SELECT document_id, k AS section_key, count(*) AS n FROM {KEYED} WHERE k IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def ambiguous_keys(s, d):
    rows = clauses(s, d).select("document_id", S.section_key(F.col("section_no")).alias("section_key")).where("section_key is not null")
    return rows.groupBy("document_id", "section_key").agg(F.count("*").alias("n")).where("n > 1")


RKEYED = f"(SELECT sample_id, document_id, {KEY} AS k FROM (SELECT DISTINCT sample_id, document_id, section_no FROM term_recall))"


@query(f"SELECT document_id, k AS section_key, min(a.sample_id) AS source_sample, min(b.sample_id) AS other_sample FROM (SELECT * FROM {KEYED} WHERE k IS NOT NULL) a JOIN (SELECT * FROM {RKEYED} WHERE k IS NOT NULL) b USING (document_id, k) GROUP BY 1, 2 HAVING count(DISTINCT a.sample_id) = 1 AND count(DISTINCT b.sample_id) = 1")
def clause_key_alignment(s, d):
    key = S.section_key(F.col("section_no")).alias("section_key")
    a = clauses(s, d).select("document_id", key, F.col("sample_id").alias("source_sample")).where("section_key is not null")
    b = recall(s, d).select("document_id", key, F.col("sample_id").alias("other_sample")).where("section_key is not null")
    return joins.unique_key(a, b, ["document_id", "section_key"])


@query(f"WITH a AS (SELECT *, row_number() OVER (PARTITION BY document_id, k ORDER BY sample_id) AS rn FROM {KEYED} WHERE k IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY document_id, k ORDER BY sample_id) AS rn FROM {RKEYED} WHERE k IS NOT NULL) SELECT a.document_id, a.k AS section_key, a.rn::INT AS place, a.sample_id AS source_sample, b.sample_id AS other_sample FROM a JOIN b USING (document_id, k, rn)")
def positional_alignment(s, d):
    key = S.section_key(F.col("section_no")).alias("section_key")
    a = clauses(s, d).select("document_id", key, F.col("sample_id").alias("source_sample")).where("section_key is not null")
    b = recall(s, d).select("document_id", key, F.col("sample_id").alias("other_sample")).where("section_key is not null")
    return joins.positional(a, b, ["document_id", "section_key"], "source_sample", "other_sample")


@query(f"SELECT document_id, sources, refs, refs::DOUBLE / sources AS count_ratio, CASE WHEN keys > 0 THEN shared::DOUBLE / keys ELSE 0 END AS coverage, (refs::DOUBLE / sources BETWEEN 0.75 AND 1.35) OR (keys >= 10 AND shared::DOUBLE / keys >= 0.9) AS passes FROM (SELECT document_id, count(*) AS sources, count(*) FILTER (has) AS refs, count(DISTINCT k) FILTER (has) AS shared, count(DISTINCT k) AS keys FROM {KEYED} GROUP BY 1)")
def document_gate(s, d):
    return joins.gate(clauses(s, d))


@query(f"SELECT sample_id, abs(order_source::DOUBLE / max(order_source) OVER w - order_ref::DOUBLE / max(order_ref) OVER w) AS gap FROM {CLAUSES} WHERE order_ref IS NOT NULL AND order_source IS NOT NULL WINDOW w AS (PARTITION BY document_id)")
def order_gaps(s, d):
    rows = clauses(s, d).where("order_ref is not null and order_source is not null")
    most = rows.groupBy("document_id").agg(F.max("order_source").alias("ms"), F.max("order_ref").alias("mr"))
    return rows.join(most, "document_id").select("sample_id", F.abs(F.col("order_source") / F.col("ms") - F.col("order_ref") / F.col("mr")).alias("gap"))


@query(f"SELECT sample_id, coalesce(lead(coalesce(trim(section_no, ' '), '')) OVER (PARTITION BY document_id ORDER BY order_ref, sample_id) = '', false) AS orphan FROM {CLAUSES} WHERE order_ref IS NOT NULL")
def orphan_followers(s, d):
    return quality.orphans(clauses(s, d))


@query(f"SELECT sample_id, last_value(nullif(trim(scope, ' '), '') IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY order_source, sample_id ROWS UNBOUNDED PRECEDING) AS carried FROM {CLAUSES} WHERE order_source IS NOT NULL")
def scope_carried(s, d):
    rows = clauses(s, d).select("sample_id", "document_id", "order_source", "scope").where("order_source is not null")
    return stats.carried(rows, "document_id", ["order_source", "sample_id"], F.nullif(F.trim("scope"), F.lit(""))).select("sample_id", "carried")


@query(f"SELECT t.sample_id, t.experiment_group, p.alignment_method AS method, p.page_source, coalesce(p.scope, '') AS scope FROM {ANSWERS} t LEFT JOIN {CLAUSES} p USING (sample_id)")
def reference_lookup(s, d):
    meta = clauses(s, d).select("sample_id", F.col("alignment_method").alias("method"), "page_source", F.coalesce("scope", F.lit("")).alias("scope"))
    return answers(s, d).select("sample_id", "experiment_group").join(meta, "sample_id", "left").select("sample_id", "experiment_group", "method", "page_source", F.coalesce("scope", F.lit("")).alias("scope"))


@query(f"SELECT sample_id, b.score AS nd_score, r.matched_total_count AS tr_terms, c.source_char_count AS cl_chars FROM {CLAUSES} c LEFT JOIN {SCORES} b USING (sample_id) LEFT JOIN (SELECT DISTINCT sample_id, matched_total_count FROM term_recall) r USING (sample_id)")
def merged_metrics(s, d):
    base = clauses(s, d).select("sample_id", F.col("source_char_count").alias("cl_chars"))
    return base.join(scores(s, d).select("sample_id", F.col("score").alias("nd_score")), "sample_id", "left").join(recall(s, d).select("sample_id", F.col("matched_total_count").alias("tr_terms")), "sample_id", "left")


GRAM_SQL = " || ".join(f"flatten(list_transform(list_filter(regexp_extract_all(t, '{CJK}+'), lambda r: length(r) >= {n}), lambda r: list_transform(range(1, length(r) - {n - 2}), lambda i: substr(r, i, {n}))))" for n in range(2, 11))


@query(f"SELECT gram, count(*) AS n, count(DISTINCT sample_id) AS clauses FROM (SELECT sample_id, unnest({GRAM_SQL} || regexp_extract_all(t, '[A-Za-z][A-Za-z0-9./-]*[A-Za-z0-9]')) AS gram FROM (SELECT sample_id, coalesce(ref_text, '') AS t FROM {CLAUSES})) GROUP BY 1")
def reference_grams(s, d):
    """Runs of 2 to 10 Chinese characters and Latin terms of the references."""
    per = clauses(s, d).select("sample_id", F.explode(T.gram_counts(F.col("ref_text"))).alias("gram")).groupBy("gram", "sample_id").agg(F.count("*").alias("k"))
    return per.groupBy("gram").agg(F.sum("k").alias("n"), F.count("*").alias("clauses"))


WORDS = f"(SELECT DISTINCT sample_id, source_lang, unnest(regexp_extract_all(lower(source_text), '[\\p{{L}}]{{4,}}')) AS w FROM {CLAUSES})"


@query(f"""WITH w AS {WORDS}, l AS (SELECT source_lang, w, count(*) AS c FROM w GROUP BY 1, 2), g AS (SELECT w, sum(c) AS all_c FROM l GROUP BY 1), n AS (SELECT source_lang, count(DISTINCT sample_id) AS docs FROM w GROUP BY 1), t AS (SELECT sum(docs) AS docs FROM n)
SELECT l.source_lang, l.w AS word, c::BIGINT AS clauses, (c::DOUBLE / n.docs) / (all_c::DOUBLE / t.docs) AS lift FROM l JOIN g USING (w) JOIN n USING (source_lang) CROSS JOIN t WHERE c >= 2 AND (c::DOUBLE / n.docs) / (all_c::DOUBLE / t.docs) >= 1.5""")
def word_lift(s, d):
    w = clauses(s, d).select("sample_id", "source_lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("source_text"), F.lit(r"[\p{L}]{4,}"), F.lit(0)))).alias("w"))
    local = w.groupBy("source_lang", "w").agg(F.count("*").alias("c"))
    everywhere = local.groupBy("w").agg(F.sum("c").alias("all_c"))
    sizes = w.groupBy("source_lang").agg(F.count_distinct("sample_id").alias("docs"))
    total = sizes.agg(F.sum("docs").alias("total"))
    lift = (F.col("c") / F.col("docs")) / (F.col("all_c") / F.col("total"))
    return local.join(everywhere, "w").join(F.broadcast(sizes), "source_lang").join(F.broadcast(total)).withColumn("lift", lift).where("c >= 2 and lift >= 1.5").select("source_lang", F.col("w").alias("word"), F.col("c").alias("clauses"), "lift")


# -- scores, documents, manifest, probes ------------------------------------------------------------


@query(f"SELECT document_id, count(*) AS n, count(score) AS scored, round(avg(score), 9) AS mean, median(score) AS median, stddev_pop(score) AS deviation FROM {SCORES} GROUP BY 1")
def score_summary(s, d):
    return scores(s, d).groupBy("document_id").agg(F.count("*").alias("n"), F.count("score").alias("scored"), F.round(F.avg("score"), 9).alias("mean"), F.stddev_pop("score").alias("deviation")).join(stats.quantiles(scores(s, d), ["document_id"], "score", {"median": 0.5}), "document_id", "left")


@query(f"SELECT in_headline_v1, in_headline_v2, count(*) AS n, avg(score) AS mean FROM {SCORES} GROUP BY ALL")
def headline_subsets(s, d):
    return scores(s, d).groupBy("in_headline_v1", "in_headline_v2").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


@query("SELECT doc_id, language_pair, max(path) FILTER (role = 'source') AS source_path, max(path) FILTER (role = 'reference') AS reference_path FROM raw_manifest GROUP BY 1, 2 HAVING count(*) FILTER (role = 'source') > 0 AND count(*) FILTER (role = 'reference') > 0")
def manifest_pairs(s, d):
    pairs = table(s, d, "raw_manifest").groupBy("doc_id", "language_pair").pivot("role", ["source", "reference"]).agg(F.max("path"), F.count(F.lit(1)).alias("n"))
    names = pairs.toDF("doc_id", "language_pair", "source_path", "ns", "reference_path", "nr")
    return names.where("ns > 0 and nr > 0").select("doc_id", "language_pair", "source_path", "reference_path")


@query(f"SELECT lang, count(*) AS n FROM (SELECT CASE {' '.join(f'''WHEN f IN ({", ".join(repr(x) for x in v.split("|"))}) THEN {k!r}''' for k, v in T.LANGUAGES.items())} ELSE l END AS lang FROM (SELECT lower(trim(lang, ' ')) AS l, lower(regexp_replace(trim(lang, ' '), '[-_].*$', '')) AS f FROM documents)) GROUP BY 1")
def language_codes(s, d):
    return table(s, d, "documents").groupBy(T.language(F.col("lang")).alias("lang")).agg(F.count("*").alias("n"))


HEAD = "substr(text, 1, 500)"


@query(f"SELECT doc_id, CASE {' '.join(f'''WHEN {n_of(HEAD, p)} > 0.2 * {n_of(HEAD, chr(92) + 'p{L}')} THEN {k!r}''' for k, p in (('ru', '[Ѐ-ӿ]'), ('ar', '[؀-ۿ]'), ('th', '[ก-ฮ]'), ('zh', CJK)))} WHEN {n_of(HEAD, chr(92) + 'p{L}')} > 0 THEN 'latin' END AS script FROM documents")
def document_scripts(s, d):
    return table(s, d, "documents").select("doc_id", T.script(F.col("text")).alias("script"))


@query("SELECT source, count(*) AS n, count(text) AS with_text, sum(length(text))::BIGINT AS chars, max(length(text)) AS longest FROM documents GROUP BY 1")
def document_funnel(s, d):
    n = F.length("text")
    return table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count("text").alias("with_text"), F.sum(n).alias("chars"), F.max(n).cast("long").alias("longest"))


LINES = "(SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents WHERE text IS NOT NULL)"
NOISE = ("empty", r"^$"), ("page_number", r"^[-–—\s]*[0-9]{1,4}[-–—\s]*$"), ("page_label", r"(?i)^(?:page|seite|p\.)\s*[0-9]+$"), ("dot_leader", r"\.{4,}\s*[0-9]+$")


@query(f"SELECT kind, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM (SELECT line, CASE {' '.join(f'''WHEN regexp_matches(line, '{p}') THEN '{k}' ''' for k, p in NOISE)} ELSE 'text' END AS kind FROM {LINES}) GROUP BY 1")
def line_noise(s, d):
    rows = table(s, d, "documents").where("text is not null").select(F.explode(F.split("text", "\n")).alias("raw")).select(F.trim("raw").alias("line"))
    kind = F.lit("text")
    for name, pattern in reversed(NOISE):
        kind = F.when(F.col("line").rlike(pattern), name).otherwise(kind)
    return rows.withColumn("kind", kind).groupBy("kind").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query(f"SELECT regexp_replace(line, '[0-9]+', '#', 'g') AS template, count(DISTINCT doc_id) AS documents FROM {LINES} WHERE length(line) BETWEEN 6 AND 180 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3 AND contains(regexp_replace(any_value(line), '[0-9]+', '#', 'g'), '#')")
def repeated_line_templates(s, d):
    rows = table(s, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("raw")).select("doc_id", F.trim("raw").alias("line")).where("length(line) between 6 and 180")
    return rows.groupBy(T.digits_masked(F.col("line")).alias("template")).agg(F.count_distinct("doc_id").alias("documents")).where("documents >= 3 and contains(template, '#')")


PATTERNS = {"replacement": "�", "cid": "(cid:", "ellipsis": "…", "soft_hyphen": "\xad", "no_break": "\xa0"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS pattern, count(*) FILTER (contains(hypothesis, '{v}')) AS answers FROM {ANSWERS}" for k, v in PATTERNS.items()))
def broken_marks(s, d):
    hit = F.filter(F.array(*[F.struct(F.lit(k).alias("pattern"), F.coalesce(F.contains(F.col("hypothesis"), F.lit(v)), F.lit(False)).cast("int").alias("hit")) for k, v in PATTERNS.items()]), lambda x: x.pattern.isNotNull())
    return answers(s, d).select(F.explode(hit).alias("x")).groupBy("x.pattern").agg(F.sum("x.hit").alias("answers"))


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, event_type, count(*) AS probes, count(*) FILTER (event_type = 'error') AS failures, avg(value) AS mean_value, max(value) AS longest FROM events GROUP BY 1, 2")
def probe_windows(s, d):
    return monitor.summary(table(s, d, "events"))


@query("SELECT event_type, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS longest FROM events GROUP BY 1")
def probe_latency(s, d):
    events = table(s, d, "events")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("longest")).join(stats.quantiles(events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}), "event_type")


from clauseloom import catalog_more  # noqa: E402, F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
