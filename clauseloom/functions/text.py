"""Scalar text expressions; all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[㐀-䶿一-鿿]"
#: White space of all scripts, within a class.
SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Arabic presentation forms and what they stand for: those of one letter, and those of several.
_FORMS = {chr(c): unicodedata.normalize("NFKC", chr(c)) for block in ((0xFB50, 0xFDFF), (0xFE70, 0xFEFF)) for c in range(block[0], block[1] + 1)}
_FORMS = {c: to for c, to in _FORMS.items() if c != to}
FORMS = tuple("".join(x) for x in zip(*[(c, to) for c, to in _FORMS.items() if len(to) == 1]))
LIGATURES = {c: to for c, to in _FORMS.items() if len(to) > 1}
#: The blocks of the presentation forms, within a class.
PRESENTED = r"\x{fb50}-\x{fdff}\x{fe70}-\x{feff}"
# Language codes by the spellings in use, and the words that name an article.
LANGUAGES = {
    "ar": "ar|ara|arabic", "de": "de|ger|german|deu", "en": "en|eng|english", "es": "es|spa|spanish", "fr": "fr|fra|french", "id": "id|indonesian",
    "it": "it|italian", "ms": "ms|malay", "nl": "nl|dutch", "no": "no|norwegian", "pt": "pt|portuguese", "ru": "ru|rus|russian", "sv": "sv|swedish",
    "th": "th|tha|thai", "vi": "vi|vietnamese", "zh": "zh|chi|chinese|zho|cn",
}


def _ranges(chars: list[int]) -> str:
    out, start = [], None
    for i, c in enumerate(chars):
        start = c if start is None else start
        if i + 1 == len(chars) or chars[i + 1] != c + 1:
            out.append(f"\\x{{{start:x}}}-\\x{{{c:x}}}")
            start = None
    return "".join(out)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("int")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used, also where the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def first_nonblank(*columns: Column) -> Column:
    """The first value that isn't blank, trimmed; null if there is none."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def clean(text: Column) -> Column:
    """Extraction debris removed, Arabic presentation forms as letters, white space as single spaces, none between Chinese characters."""
    forms = F.translate(text, *FORMS)
    # (one literal that the optimizer folds; a map of so many would be compiled entry by entry)
    spelt = F.str_to_map(F.lit("\x1f".join(f"{c}\x1e{to}" for c, to in LIGATURES.items())), F.lit("\x1f"), F.lit("\x1e"))
    # few texts hold a form; a class of ranges tells them, as one of single characters asks these in turn for each character of a text
    forms = F.when(forms.rlike(f"[{_ranges(sorted(map(ord, LIGATURES)))}]"), F.array_join(F.transform(F.split(forms, ""), lambda c: F.coalesce(F.element_at(spelt, c), c)), "")).otherwise(forms)
    out = F.when(text.rlike(f"[{PRESENTED}]"), forms).otherwise(text)
    out = F.regexp_replace(F.translate(out, "\u0640", ""), r"\(cid:[0-9]+\)", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " "), "[_＿]{3,}", " ")
    out = F.trim(F.regexp_replace(out, f"[{SPACES}]+", " "))
    return F.regexp_replace(out, rf"(?<={CJK}) (?={CJK})", "")


def good_ratio(text: Column) -> Column:
    """The share of letters, figures and characters of the Thai, Arabic and Chinese blocks; 0 without text."""
    return F.when(F.length(text) > 0, count(text, r"[\p{L}\p{N}\u0e00-\u0e7f\u0600-\u06ff]") / F.length(text)).otherwise(0.0)


def length_bucket(n: Column) -> Column:
    return F.when(n < 80, "short").when(n <= 300, "medium").otherwise("long")


def band(n: Column) -> Column:
    return F.when(n < 100, "<100").when(n < 200, "100-199").when(n < 300, "200-299").otherwise("300+")


def language(code: Column) -> Column:
    """A code as it is used here, from any spelling and without a region; an unknown one in lower case, null for null."""
    flat = F.lower(F.regexp_replace(F.trim(code), "[-_].*$", ""))
    out = F.lit(None).cast("string")
    for name, spellings in LANGUAGES.items():
        out = F.when(flat.isin(*spellings.split("|")), name).otherwise(out)
    return F.coalesce(out, F.lower(F.trim(code)))


# The names of the languages in Chinese prompts.
CHINESE_NAMES = {"ar": "阿拉伯语", "de": "德语", "en": "英语", "es": "西班牙语", "fr": "法语", "ru": "俄语", "th": "泰语", "zh": "中文"}


def chinese_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in CHINESE_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, language(code)), F.initcap(code))


def language_type(value: Column) -> Column:
    """A two-letter type in capitals; null for any that isn't listed."""
    flat = F.upper(F.trim(value))
    return F.when(flat.isin(*[c.upper() for c in CHINESE_NAMES]), flat)


def language_of_file(name: Column) -> Column:
    """The language that a file's name tells; null without one."""
    patterns = (r"^([a-z]{2})\.jsonl$", r"mt_([a-z]{2})\.", r"_src_([a-z]{2})", r"_([a-z]{2})\.pdf$")
    flat = F.lower(F.regexp_extract(name, "[^/]*$", 0))
    found = [F.regexp_extract(flat, p, 1) for p in patterns]
    return F.coalesce(*[F.when(x.isin(*LANGUAGES), x) for x in found])


def script(text: Column) -> Column:
    """ru, ar or th where more than a fifth of the letters among the first 500 characters say so; zh likewise; else latin; null without letters."""
    head = F.substring(text, 1, 500)
    letters = count(head, r"\p{L}")
    share = {"ru": "[Ѐ-ӿ]", "ar": "[؀-ۿ]", "th": "[ก-ฮ]", "zh": CJK}
    out = F.when(letters > 0, "latin")
    for name, pattern in reversed(share.items()):
        out = F.when(count(head, pattern) > 0.2 * letters, name).otherwise(out)
    return out


def terminal(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike("[.!?。！？؟]$"), F.lit(False))


# Words that open a table or a note, and words of titles.
TABLE, NOTE = "table|tabla|tabelle|tableau|таблица|表|جدول", "note|notes|nota|remarque|примечание|หมายเหตุ|ملاحظة|注"
TITLE = (
    "chapter|annex|appendix|regulation|resolution|section|capítulo|anexo|chapitre|anlage|глава|приложение|"
    "บท|ภาคผนวก|الفصل|ملحق|第|附录|目录"
)
#: No letter or figure of any script follows.
WORD_END = r"(?:[^\p{L}\p{N}_]|$)"


def segment_type(text: Column, has_section: Column) -> Column:
    """table, note, list, paragraph or title, by the first rule that holds."""
    upper, letters = count(text, r"\p{Lu}"), count(text, r"\p{L}")
    titled = F.lower(text).rlike(TITLE) | ((letters > 0) & (upper > 0.65 * letters))
    return (
        F.when(text.rlike(rf"(?iu)^[{SPACES}]*(?:{TABLE}){WORD_END}"), "table")
        .when(text.rlike(rf"(?iu)^[{SPACES}]*(?:{NOTE}){WORD_END}"), "note")
        .when(text.rlike(rf"^[{SPACES}]*[-*•●▪]"), "list")
        .when(has_section, "paragraph")
        .when((F.length(text) <= 120) & ~text.rlike("[。.!?！？;；]$") & titled, "title")
        .otherwise("paragraph")
    )


def sentence_end(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike("[。.!?！？;；:：؟؛]$"), F.lit(False))


def strict_end(flat: Column) -> Column:
    """Whether a cleaned text ends with a stop or a closing bracket."""
    return F.coalesce(flat.rlike("[。.!?！？;；）)]$"), F.lit(False))


# Words behind which a text can't end.
DANGLING = "and|or|of|the|to|with|which|that|de|la|del|y|и|в|на"
THAI_DANGLING = "และ|หรือ|ของ|ใน|ที่|เพื่อ|โดย|จาก|กับ|ตาม|ซึ่ง|แห่ง|เมื่อ|ถ้า|แต่"


def thai_dominant(text: Column) -> Column:
    thai = count(text, "[\u0e00-\u0e7f]")
    return (thai > 0) & (thai > count(text, "[A-Za-z一-鿿]"))


def complete_end(flat: Column) -> Column:
    """Whether a cleaned source text ends as complete ones do; in Thai, which has no stop, with no dangling word."""
    short = (F.length(flat) <= 100) & ~flat.rlike(rf"(?iu)(?:^|[^\p{{L}}\p{{N}}_])(?:{DANGLING})$")
    return strict_end(flat) | F.when(thai_dominant(flat), ~flat.rlike(f"(?:{THAI_DANGLING})$")).otherwise(short)


def digits_masked(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "#")


def split_aliases(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[|;,\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9]+"), F.lit(0)))


def han_grams(text: Column, n: int) -> Column:
    """All n-character substrings of the runs of Chinese characters."""
    runs = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{CJK}+"), F.lit(0)), lambda r: F.length(r) >= n)
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substring(r, i, F.lit(n)))))


def first_value(*columns: Column) -> Column:
    """The first value that is neither null nor empty, as it is."""
    return F.coalesce(*[F.when(c.cast("string") != "", c) for c in columns])


def row_key(*columns: Column, number: Column) -> Column:
    """The first id that isn't blank, else row_ and the row's number."""
    return F.coalesce(first_nonblank(*columns), F.concat(F.lit("row_"), number))


def json_list(text: Column, kind: str = "array<string>") -> Column:
    """A list written as JSON; empty where it isn't one."""
    empty = F.from_json(F.lit("[]"), kind)
    return F.coalesce(F.from_json(F.when(F.trim(text).startswith("["), text), kind), empty)


def truthy(value: Column) -> Column:
    """true, false or null for whatever says neither."""
    flat = F.lower(F.trim(value.cast("string")))
    return F.when(flat.isin("true", "t", "yes", "y", "1"), True).when(flat.isin("false", "f", "no", "n", "0"), False)


# Names of stages and levels of confidence.
STAGES = {"first": "first_pass", "first-pass": "first_pass", "first_pass": "first_pass", "retry": "retry", "retry_tcr": "retry", "final": "final"}
CONFIDENCE = {"high": 1.0, "exact": 1.0, "exact_section": 1.0, "manual": 1.0, "verified": 1.0, "medium": 0.5, "med": 0.5, "low": 0.0}


def stage(name: Column) -> Column:
    """The stage of that name; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair]), F.lower(F.trim(name)))


def confidence(value: Column) -> Column:
    """A number, or the number of a level; null for neither."""
    levels = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    flat = F.lower(F.trim(value.cast("string")))
    return F.coalesce(flat.try_cast("double"), F.element_at(levels, flat))


def dynamic_tokens(chars: Column, floor: int = 4096, ceiling: int = 8192, ratio: float = 1.2) -> Column:
    """How many tokens an answer to so many characters may take."""
    return F.greatest(F.lit(floor), F.least(F.lit(ceiling), F.ceil(chars * ratio).cast("int") + 64))


def sample_id(document: Column, pair: Column, order: Column) -> Column:
    return F.regexp_replace(F.concat_ws("_", document, pair, F.lpad(order.cast("string"), 6, "0")), "[^A-Za-z0-9_.-]+", "_")


def generation_clean(text: Column) -> Column:
    """A model's answer: lines stripped, runs of blank lines as one."""
    lines = F.array_join(F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: F.trim(x)), "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), rf"^[{SPACES}]+|[{SPACES}]+$", "")


def word_list(text: Column) -> Column:
    """Lower-case words and figures in Latin letters, without a clause number at the head."""
    body = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^\s*[0-9]+(?:\.[0-9]+)*\.?\s*", "")
    return F.regexp_extract_all(body, F.lit("[a-z0-9]+"), F.lit(0))


def stem(word: Column, suffixes: tuple[str, ...], least: int = 5) -> Column:
    """A word without the first of the suffixes that leaves ``least`` characters."""
    out = word
    for suffix in reversed(suffixes):
        fits = word.endswith(suffix) & (F.length(word) - len(suffix) >= least)
        out = F.when(fits, F.substring(word, F.lit(1), F.length(word) - len(suffix))).otherwise(out)
    return out


# What gives a secret or a private address away, and the marks of a model thinking aloud.
SECRETS = (r"sk-[A-Za-z0-9_\-]{6,}", r"(?i)bearer\s+[A-Za-z0-9._\-]+")
ADDRESS = r"(?i)https?://[^\s\"'<>]+|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?\b"
THINKING = ("<think>", "</think>", "<|thinking|>", "reasoning_content")


def redacted(text: Column) -> Column:
    """Secrets and addresses masked."""
    out = text
    for pattern in SECRETS:
        out = F.regexp_replace(out, pattern, "***")
    return F.regexp_replace(out, ADDRESS, "<address>")


def clipped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def thinking_marks(text: Column) -> Column:
    """The marks of thinking aloud that an answer holds."""
    return F.filter(F.array(*map(F.lit, THINKING)), lambda m: F.contains(F.lower(F.coalesce(text, F.lit(""))), m))


def percent(part: Column, whole: Column, digits: int = 4) -> Column:
    """part in hundredths of whole; null where there is no whole."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)


def gram_counts(text: Column, least: int = 2, most: int = 10) -> Column:
    """Substrings of least to most characters of the runs of Chinese characters, and the Latin terms whole; with repeats."""
    latin = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9./-]*[A-Za-z0-9]"), F.lit(0))
    return F.concat(*[han_grams(text, n) for n in range(least, most + 1)], latin)


def nfkc(text: Column) -> Column:
    """The compatibility form, white space at the ends off; only texts that may change leave the JVM."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    changes = text.rlike(f"[{COMPATIBLE}\\p{{M}}]")
    return F.regexp_replace(F.when(changes, run(F.when(changes, text))).otherwise(text), f"^[{SPACES}]+|[{SPACES}]+$", "")


#: Characters whose compatibility form is another one, as ranges within a class.
COMPATIBLE = _ranges([c for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFKC", chr(c)) != chr(c)])
