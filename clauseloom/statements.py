"""Pieces of SQL that several statements share; each says in DuckDB's terms what an expression of the library says in Spark's."""

from __future__ import annotations

import unicodedata

from clauseloom.functions import sections as S
from clauseloom.functions import text as T
from clauseloom.operators import cascade as C
from clauseloom.operators import quality as Q

CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spelt(c: str, table: dict[str, str]) -> str:
    """Each character of c replaced by what the table says."""
    listed = ", ".join(f"{q(k)}: {q(v)}" for k, v in table.items())
    return f"array_to_string(list_transform(string_split({c}, ''), lambda x: coalesce(map_extract(MAP {{{listed}}}, x)[1], x)), '')"


def clean(c: str) -> str:
    out = f"translate({c}, {q(T.FORMS[0])}, {q(T.FORMS[1])})"
    out = f"CASE WHEN regexp_matches({c}, '[{''.join(T.LIGATURES)}]') THEN {spelt(out, T.LIGATURES)} ELSE {out} END"
    out = f"replace({out}, chr(1600), '')"
    for pattern, to in ((r"\(cid:[0-9]+\)", ""), (r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " "), ("[_＿]{3,}", " "), (f"[{T.SPACES}]+", " ")):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    out = f"trim({out}, ' ')"
    for _ in range(2):
        out = f"regexp_replace({out}, '({CJK}) ({CJK})', '\\1\\2', 'g')"
    return out


#: Characters of the Basic Multilingual Plane, but Hangul, and their compatibility forms before composition.
_FORMS = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4 and unicodedata.normalize("NFKC", chr(c)) != chr(c)}


def nfkc(c: str) -> str:
    flat = f"CASE WHEN regexp_matches({c}, '[{T.COMPATIBLE}]') THEN nfc_normalize({spelt(c, _FORMS)}) ELSE nfc_normalize({c}) END"
    return f"regexp_replace({flat}, '^[{T.SPACES}]+|[{T.SPACES}]+$', '', 'g')"


def n_of(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))::INT"


def has(c: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({c}, {q(pattern)}), false)"


def terminal(c: str) -> str:
    return f"coalesce(regexp_matches(trim({c}, ' '), '[.!?。！？؟]$'), false)"


def good(c: str) -> str:
    return f"CASE WHEN length({c}) > 0 THEN {n_of(c, r'[\p{L}\p{N}\x{0e00}-\x{0e7f}\x{0600}-\x{06ff}]')} / length({c}) ELSE 0 END"


def strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^[{T.SPACES}]+|[{T.SPACES}]+$', '', 'g')"


def digits(c: str) -> str:
    return f"translate({c}, {q(S.DIGITS[0])}, {q(S.DIGITS[1])})"


def chinese(c: str) -> str:
    tens = f"^([{S.CHINESE}]?)十([{S.CHINESE}]?)$"
    digit = lambda g, empty: f"CASE WHEN regexp_extract({c}, '{tens}', {g}) = '' THEN {empty} ELSE translate(regexp_extract({c}, '{tens}', {g}), '{S.CHINESE}', '0123456789')::INT END"
    return f"CASE WHEN regexp_matches({c}, '^[{S.CHINESE}]$') THEN translate({c}, '{S.CHINESE}', '0123456789')::INT WHEN regexp_matches({c}, '{tens}') THEN ({digit(1, 1)}) * 10 + ({digit(2, 0)}) END"


def figure(c: str) -> str:
    """A number in figures or Chinese, for the units of a clause number (Roman numerals don't stand there)."""
    flat = digits(c)
    return f"coalesce(CASE WHEN regexp_matches({flat}, '^[0-9]{{1,9}}$') THEN {flat}::INT END, {chinese(c)})"


def section_key(c: str) -> str:
    s = strip(c)
    latin = f"translate({s}, '{S.LOOKALIKES[0]}', '{S.LOOKALIKES[1]}')"
    unit = r"^第\s*([一二三四五六七八九十百千万\p{Nd}]+)\s*([章节条款])"
    code = r"(?i)^(?:Article\s+|第\s*)L\.?\s*([0-9]+(?:-[0-9]+)*)\s*条?$"
    article = rf"(?i)^(?:{S.ARTICLE})\s*(\p{{Nd}}+[A-Za-z0-9.-]*)"
    of_unit = figure(f"regexp_extract({s}, '{unit}', 1)")
    number = f"regexp_extract({s}, '{article}', 1)"
    return f"""CASE WHEN {s} = '' THEN NULL WHEN regexp_matches({latin}, '^(?:[A-Z]\\.)?\\p{{Nd}}{{1,3}}(?:\\.\\p{{Nd}}{{1,3}}){{0,6}}$') THEN 'num:' || {digits(latin)}
 WHEN regexp_matches({s}, '^[٠-٩]+(?:/[٠-٩]+)+$') THEN 'num:' || replace({digits(s)}, '/', '.') WHEN regexp_extract({s}, '{code}', 1) <> '' THEN 'art:L' || regexp_extract({s}, '{code}', 1)
 WHEN regexp_matches({s}, '{unit}') AND ({of_unit}) IS NOT NULL THEN CASE regexp_extract({s}, '{unit}', 2) {' '.join(f"WHEN '{k}' THEN '{v}:'" for k, v in S.UNITS.items())} END || ({of_unit})
 WHEN regexp_matches({s}, '{unit}') THEN 'raw:' || {s} WHEN {number} <> '' THEN 'art:' || coalesce(({figure(number)})::VARCHAR, {number}) ELSE 'raw:' || {s} END"""


def section_no(c: str) -> str:
    """The lookaheads of the patterns are said by what may follow, or by a second pattern that must not match."""
    out = []
    for pattern in S.PATTERNS:
        p = S.unicode_digits(pattern)
        if "(?!" in p:
            head, rest = p.split("(?!", 1)
            no = head + "(?:" + rest[:-1] + ")"
            found = f"CASE WHEN NOT regexp_matches({c}, '{no}') THEN regexp_extract({c}, '{head}', 1) END"
        else:
            found = f"regexp_extract({c}, '{p.replace('(?=', '(?:')}', 1)"
        out.append(f"nullif(rtrim({clean_short(found)}, '.)'), '')")
    return f"coalesce({', '.join(out)})"


def clean_short(c: str) -> str:
    """clean() for a clause number, which holds neither forms nor debris."""
    out = f"trim(regexp_replace(replace({c}, chr(1600), ''), '[{T.SPACES}]+', ' ', 'g'), ' ')"
    for _ in range(2):
        out = f"regexp_replace({out}, '({CJK}) ({CJK})', '\\1\\2', 'g')"
    return out


def noise_line(c: str) -> str:
    """c: a cleaned line."""
    return f"""({c} = '' OR regexp_matches({c}, '^[-–—]? *[0-9]{{1,4}} *[-–—]?$') OR regexp_matches({c}, '(?i)^(?:{C.PAGE_WORDS}) [0-9]{{1,4}}(?: */ *[0-9]{{1,4}})?$')
 OR regexp_matches({c}, '^第 *[0-9]{{1,4}} *页 *共 *[0-9]{{1,4}} *页$') OR regexp_matches({c}, '[.·…]{{4,}} *[0-9]{{1,4}}$') OR regexp_matches({c}, '[.·…]{{10,}}') OR (length({c}) > 20 AND {good(c)} < 0.25))"""


def directory(c: str) -> str:
    return f"(regexp_matches({c}, '[.·…]{{4,}} *[0-9]{{1,4}} *$') OR regexp_matches(lower({c}), '{C.CONTENTS}') OR regexp_matches({c}, '(?i)^(?:{C.HEADED})(?:[^\\p{{L}}\\p{{N}}_].*)? [0-9]{{1,4}}$') OR regexp_matches({c}, '^(?:[0-9]+(?:\\.[0-9]+)* +){{4,}}[0-9]+(?:\\.[0-9]+)*$'))"


def header_or_footer(c: str) -> str:
    return f"(regexp_matches({c}, '(?i)^(?:{C.PAGE_WORDS}) [0-9]{{1,4}}(?: *(?:of|/) *[0-9]{{1,4}})?$') OR regexp_matches({c}, '^[-–—]? *[0-9]{{1,4}} *[-–—]?$') OR regexp_matches({c}, '(?i)\\bpage +[0-9]+ +of +[0-9]+\\b'))"


def file_name_noise(c: str) -> str:
    names = f"regexp_extract_all({c}, '\\b[A-Za-z0-9]+(?:_[A-Za-z0-9]+){{2,}}\\b')"
    return f"(coalesce({names}[1] = {names}[2], false) OR len(list_filter({names}, lambda x: ends_with(lower(x), '_zh') AND length({c}) - length(replace({c}, x, '')) > length(x))) > 0)"


def symbol_noise(raw: str, c: str) -> str:
    return f"(contains({raw}, '(cid:') OR contains({raw}, chr(65533)) OR {c} = '' OR regexp_matches({c}, '^[^\\p{{L}}\\p{{N}}]+$') OR (length({c}) > 20 AND {good(c)} < 0.35))"


def bad_text(c: str) -> str:
    """c: a cleaned text that is judged as it is."""
    return f"({symbol_noise(c, c)} OR {directory(c)} OR {header_or_footer(c)} OR {file_name_noise(c)} OR NOT regexp_matches({c}, '{C.LETTER}'))"


def thai_dominant(c: str) -> str:
    return f"({n_of(c, '[\\x{0e00}-\\x{0e7f}]')} > 0 AND {n_of(c, '[\\x{0e00}-\\x{0e7f}]')} > {n_of(c, '[A-Za-z一-鿿]')})"


def strict_end(c: str) -> str:
    return f"coalesce(regexp_matches({c}, '[。.!?！？;；）)]$'), false)"


def complete_end(c: str) -> str:
    return f"({strict_end(c)} OR CASE WHEN {thai_dominant(c)} THEN NOT regexp_matches({c}, '(?:{T.THAI_DANGLING})$') ELSE length({c}) <= 100 AND NOT regexp_matches({c}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{T.DANGLING})$') END)"


def blank(c: str) -> str:
    return f"coalesce({c}::VARCHAR, '') = ''"


def segment_type(c: str, section: str) -> str:
    letters, upper = n_of(c, r"\p{L}"), n_of(c, r"\p{Lu}")
    return f"""CASE WHEN regexp_matches({c}, '(?i)^[{T.SPACES}]*(?:{T.TABLE})(?:[^\\p{{L}}\\p{{N}}_]|$)') THEN 'table' WHEN regexp_matches({c}, '(?i)^[{T.SPACES}]*(?:{T.NOTE})(?:[^\\p{{L}}\\p{{N}}_]|$)') THEN 'note'
 WHEN regexp_matches({c}, '^[{T.SPACES}]*[-*•●▪]') THEN 'list' WHEN {section} THEN 'paragraph'
 WHEN length({c}) <= 120 AND NOT regexp_matches({c}, '[。.!?！？;；]$') AND (regexp_matches(lower({c}), '{T.TITLE}') OR ({letters} > 0 AND {upper} > 0.65 * {letters})) THEN 'title' ELSE 'paragraph' END"""


def watermark(c: str) -> str:
    t = f"coalesce({c}, '')"
    weak = " + ".join(f"regexp_matches({t}, '{p}')::INT" for p in C.WEAK_MARKS)
    return "(" + " OR ".join(f"regexp_matches({t}, '{p}')" for p in C.STRONG_MARKS) + f" OR ({weak}) >= 2)"


def source_terminated(c: str) -> str:
    return f"CASE WHEN {thai_dominant(c)} THEN NOT regexp_matches({c}, '(?:{T.THAI_DANGLING})\\s*$') ELSE regexp_matches({c}, '[.。!?！？;；]\\s*$') END"


def ledger(clauses: str) -> str:
    src, ref, ns, nr = "source_text", "ref_text", "source_char_count", "ref_char_count"
    body = f"trim(regexp_replace({src}, '{Q.SECTION_HEAD}', ''), ' ')"
    tokens = f"list_filter(regexp_split_to_array({src}, '\\s+'), lambda x: x <> '')"
    other = f"list_position(list_transform({tokens}, lambda x: regexp_matches(x, '^[0-9]+(?:\\.[0-9]+)*\\.?$')), false)"
    marks = " OR ".join(f"contains({c}, {m})" for c in (src, ref) for m in ("'(cid:'", "chr(65533)"))
    flags = f"""SELECT sample_id, {src}, {ref}, {ns}, {nr}, coalesce(orphan, false) AS orphan, {source_terminated(src)} AS ended, regexp_matches({src}, '(?i)\\b(?:{C.CUT_BEHIND})\\s*$') AS cut, regexp_matches({src}, '(?:{T.THAI_DANGLING})\\s*$') AS thai_cut,
  regexp_matches({body}, '^(?:{C.CONTINUING})\\b') AS continues, regexp_matches({ref}, '{Q.STOPPED}') AS ref_ended, {nr}::DOUBLE / greatest({ns}, 1) > {Q.RATIO_CUT} AS r2b,
  {n_of(ref, '[。！？]')} - {n_of(src, '(?:^|[^0-9])[.!?](?:\\s+[A-Z"“(]|\\s*$)')} AS more
 FROM {clauses} LEFT JOIN (SELECT sample_id AS sid, coalesce(lead(coalesce(trim(section_no, ' '), '')) OVER (PARTITION BY document_id ORDER BY order_ref, sample_id) = '', false) AS orphan FROM {clauses} WHERE order_ref IS NOT NULL) ON sid = sample_id
 WHERE {ref} IS NOT NULL AND {src} IS NOT NULL"""
    step = f"SELECT *, continues OR (NOT ended AND (cut OR thai_cut)) AS r2, NOT (continues OR (NOT ended AND (cut OR thai_cut))) AND NOT ended AND ref_ended AS r2a FROM ({flags})"
    cases = [
        ("R4", f"(CASE WHEN {other} IS NULL OR {other} = 0 THEN len({tokens}) ELSE {other} - 1 END) >= {Q.BARE_NUMBERS} AND NOT regexp_matches({src}, '{Q.STOPPED}')"), ("R2", "r2"), ("R2a", "r2a"), ("R2b", "r2b"),
        ("R3", f"{watermark(src)} OR {watermark(ref)} OR {marks}"), ("R5", f"regexp_matches({ref}, '(?:\\s|（|\\(|、)[0-9](?:\\s+[0-9])+')"),
        ("B", f"more >= {Q.MORE_SENTENCES} AND ended AND NOT cut AND NOT (r2 OR r2a OR r2b)"), ("G1", "orphan"), ("G2", f"{ns} > {Q.LONG_SOURCE} AND {nr} < {ns} * {Q.HEALTHY} * {Q.COVERAGE}"),
    ]
    hit = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in cases)
    return f"(SELECT sample_id, array_to_string(hit, ',') AS rules, CASE WHEN list_contains(hit, 'R4') THEN 'table_row_separate_metric' ELSE 'data_defect_excluded' END AS bucket FROM (SELECT sample_id, list_filter([{hit}], lambda x: x IS NOT NULL) AS hit FROM ({step})) WHERE len(hit) > 0)"


def prefiltered(clauses: str) -> str:
    ratio = "length(r)::DOUBLE / greatest(length(s), 1)"
    missing = " OR ".join(blank(c) for c in ("sample_id", "document_id", "language_pair", "source_lang", "target_lang"))
    section = strip("section_no")
    cases = [
        ("missing_required_fields", missing), ("non_exact_section", f"NOT coalesce(alignment_method IN ({', '.join(map(q, C.EXACT))}), false)"), ("non_high_confidence", "coalesce(alignment_confidence, '') <> 'high'"),
        ("use_for_da_not_true", "NOT coalesce(use_for_da, false)"), ("missing_section_no", f"{section} = ''"), ("missing_source_or_ref", "s = '' OR r = ''"),
        ("source_too_short", f"length(s) < {C.LEAST_SOURCE}"), ("ref_too_short", f"length(r) < {C.LEAST_REF}"), ("too_long", f"length(s) > {C.MOST_CHARS} OR length(r) > {C.MOST_CHARS}"),
        ("source_noise_or_directory", bad_text("s")), ("ref_noise_or_directory", bad_text("r")),
        ("source_section_mismatch", f"NOT (starts_with(s, {section}) AND regexp_matches(substr(s, length({section}) + 1, 1), '^$|[ .)）:：、-]'))"),
        ("ref_section_mismatch", f"NOT coalesce(({section_key('section_no')}) = ({section_key('rs')}), false)"),
        ("length_ratio_abnormal", f"{ratio} < {C.LEAST_RATIO} OR {ratio} > {C.MOST_RATIO}"), ("possible_truncation", f"NOT {complete_end('s')} OR NOT {strict_end('r')}"),
    ]
    chain = " ".join(f"WHEN {c} THEN '{r}'" for r, c in cases)
    return f"""(SELECT *, CASE {chain} ELSE 'ok' END AS reason FROM (SELECT *, {section_no('r')} AS rs FROM (SELECT *, {clean("coalesce(source_text, '')")} AS s, {clean("coalesce(ref_text, '')")} AS r FROM {clauses})))"""


def contains_term(hay: str, tight: str, term: str) -> str:
    loose = f"(contains(lower({hay}), lower(regexp_replace({term}, '[{T.SPACES}]+', ' ', 'g'))) OR contains(lower({tight}), lower(regexp_replace({term}, '[{T.SPACES}]+', '', 'g'))))"
    return f"({term} <> '' AND CASE WHEN regexp_matches({term}, '[A-Za-z0-9]') THEN {loose} ELSE contains({hay}, {term}) END)"


def prepared(answers: str) -> str:
    targets = f"list_transform(list_filter(coalesce(required_target_terms, []), lambda x: x IS NOT NULL), lambda x: {nfkc_short('x')})"
    return f"""(SELECT *, regexp_replace(h0, '[{T.SPACES}]+', ' ', 'g') AS h, regexp_replace(h0, '[{T.SPACES}]+', '', 'g') AS tight,
 list_filter(t0, lambda x, i: x <> '' AND list_position(t0, x) = i) AS targets FROM (SELECT *, {nfkc("coalesce(hypothesis, '')")} AS h0, {targets} AS t0 FROM {answers}))"""


def nfkc_short(c: str) -> str:
    """The compatibility form of a term, in which only full-width forms of ASCII can stand."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    return f"trim(nfc_normalize(translate({c}, {q(wide)}, {q(plain)})), ' ')"
