"""Clause numbers, their canonical keys, numerals and headings that open a scope; all expressions stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseloom.functions import text as T

# Words and patterns of clause numbers, look-alike letters, numerals and the words of headings that open a scope.
LOOKALIKES = ("АВЕКМНОРСТУХ", "ABEKMHOPCTYX")
CHINESE = "零一二三四五六七八九"
ARTICLE = "Article|Art\\.|Artículo|Articulo|Статья|ข้อ|มาตรา|المادة|مادة|§"
UNITS = {"章": "chap", "节": "sec", "条": "art", "款": "para"}
PATTERNS = (
    r"^\s*(\d{1,3}(?:\.\d{1,3}){1,6})(?:[.)])?(?=\s|$)",
    r"^\s*(\d{1,3})[.)](?=\s|$)",
    r"^\s*([A-ZА-Я](?:\.\d{1,3}){1,4})(?:[.)])?(?=\s|$)",
    r"(?i)^\s*((?:Article|Art\.)\s+\d+[A-Za-z0-9.-]*)\b",
    r"(?i)^\s*(Article\s+L\.?\s*\d+(?:-\d+)*)\b",
    r"^\s*(第\s*L\.?\s*\d+(?:-\d+)*\s*条)",
    r"(?i)^\s*((?:Artículo|Articulo)\s+\d+[A-Za-z0-9.-]*)\b",
    r"^\s*((?:Статья|СТАТЬЯ)\s+\d+[A-Za-zА-Яа-я0-9.-]*)",
    r"^\s*(第\s*[一二三四五六七八九十百千万\d]+\s*[章节条款])(?!所述|所指|所列|所称|规定的|适用于|和第|至第|第[一二三四五六七八九十百千万\d]+项)",
    r"^\s*((?:ข้อ|มาตรา)\s*\d+[A-Za-z0-9.-]*)",
    r"^\s*((?:المادة|مادة)\s*\d+[A-Za-z0-9.-]*)",
    r"^\s*([٠-٩]+(?:/[٠-٩]+)+)",
    r"^\s*(§\s*\d+[a-z]?)\b(?!\s*(?:Absatz|Abs\.|Satz|in\s+Verbindung))",
)
SCOPES = {
    "en": "Annex|ANNEX", "de": "Anlage|ANLAGE|Anhang|ANHANG", "fr": "Annexe|ANNEXE", "es": "Anexo|ANEXO",
    "ru": "Приложение|ПРИЛОЖЕНИЕ", "th": "ภาคผนวก", "ar": "ملحق|الملحق", "zh": "附\\s*录",
}
FOREIGN_SCOPE = r"(?i)第\s*\d+\s*号\s*法规|Regulation\s+No|this\s+Regulation|Consolidated\s+Resolution|R\.E\.3"
SCOPE_PUNCTUATION = "[.。,，;；:：!?！？)）]"
SCOPE_MOST, SCOPE_CHARS, SCOPE_DESCENTS, SCOPE_HITS, TITLE_CHARS = 30, 80, 0.25, 3, 60
ROMAN = "IVXLCDM"
ROMAN_VALUES = (1, 5, 10, 50, 100, 500, 1000)

#: All decimal digits but the ASCII ones, and what they stand for.
_OTHERS = [c for c in map(chr, range(0x80, 0x1FBFA)) if unicodedata.category(c) == "Nd"]
DIGITS = ("".join(_OTHERS), "".join(str(unicodedata.digit(c)) for c in _OTHERS))


def unicode_digits(pattern: str) -> str:
    """A pattern whose digits are those of all scripts."""
    return pattern.replace(r"\d", r"\p{Nd}")


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{T.SPACES}]+|[{T.SPACES}]+$", "")


def ascii_digits(text: Column) -> Column:
    return F.translate(text, *DIGITS)


def section_no(text: Column) -> Column:
    """The clause number a text begins with, by the first pattern that finds one, without a stop or bracket behind it; null without one."""

    def number(pattern: str) -> Column:
        found = F.regexp_extract(text, unicode_digits(pattern), 1)
        spaced = F.trim(F.regexp_replace(F.translate(found, "\u0640", ""), f"[{T.SPACES}]+", " "))
        return F.nullif(F.rtrim(F.regexp_replace(spaced, rf"(?<={T.CJK}) (?={T.CJK})", ""), F.lit(".)")), F.lit(""))

    # only a text that begins with what a number can begin with is looked at by every pattern
    may = text.rlike(rf"^\s*(?:\p{{Nd}}|[A-ZА-Я]\.|§|第|(?iu:Art|Статья|ข้อ|มาตรา|المادة|مادة))")
    return F.when(may, F.coalesce(*map(number, PATTERNS)))


def chinese_numeral(text: Column) -> Column:
    """0 to 99 as a number; null for anything else, also for hundreds and thousands."""
    tens = rf"^([{CHINESE}]?)十([{CHINESE}]?)$"
    digit = lambda c, empty: F.when(c == "", empty).otherwise(F.translate(c, CHINESE, "0123456789").cast("int"))
    return F.when(text.rlike(f"^[{CHINESE}]$"), F.translate(text, CHINESE, "0123456789").cast("int")).when(
        text.rlike(tens), digit(F.regexp_extract(text, tens, 1), 1) * 10 + digit(F.regexp_extract(text, tens, 2), 0)
    )


def roman_numeral(text: Column) -> Column:
    """The value of a Roman numeral (a letter before a greater one is taken off); null for anything else."""
    values = F.create_map(*[F.lit(x) for pair in zip(ROMAN, ROMAN_VALUES) for x in pair])
    letters = F.transform(F.split(F.reverse(F.upper(text)), ""), lambda c: F.element_at(values, c))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("behind"))
    total = F.aggregate(letters, start, lambda s, v: F.struct((s.total + F.when(v < s.behind, -v).otherwise(v)).alias("total"), v.alias("behind")), lambda s: s.total)
    return F.when(text.rlike(f"(?i)^[{ROMAN}]+$"), total)


def numeral(text: Column) -> Column:
    """A number in figures of any script, Roman or Chinese; null for anything else."""
    return T.let(ascii_digits(stripped(text)), lambda flat: F.when(flat.rlike("^[0-9]{1,9}$"), flat.cast("int")).otherwise(F.coalesce(roman_numeral(flat), chinese_numeral(flat))))


def section_key(section: Column) -> Column:
    """kind:number of a clause number, equal for equal clauses of different languages; null for a blank one.

    num a chain of figures, art an article, chap, sec and para the units above and below it, raw what is none of them.
    """
    return T.let(stripped(section), _key)


def _key(s: Column) -> Column:
    latin = F.translate(s, *LOOKALIKES)
    code = F.regexp_extract(s, r"(?i)^(?:Article\s+|第\s*)L\.?\s*([0-9]+(?:-[0-9]+)*)\s*条?$", 1)
    unit = unicode_digits(r"^第\s*([一二三四五六七八九十百千万\d]+)\s*([章节条款])")
    kinds = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    of_unit = numeral(F.regexp_extract(s, unit, 1))
    article = F.regexp_extract(s, unicode_digits(rf"(?i)^(?:{ARTICLE})\s*(\d+[A-Za-z0-9.-]*)"), 1)
    return (
        F.when(s == "", None)
        .when(latin.rlike(unicode_digits(r"^(?:[A-Z]\.)?\d{1,3}(?:\.\d{1,3}){0,6}$")), F.concat(F.lit("num:"), ascii_digits(latin)))
        .when(s.rlike("^[٠-٩]+(?:/[٠-٩]+)+$"), F.concat(F.lit("num:"), F.translate(ascii_digits(s), "/", ".")))
        .when(code != "", F.concat(F.lit("art:L"), code))
        .when(s.rlike(unit) & of_unit.isNotNull(), F.concat(F.element_at(kinds, F.regexp_extract(s, unit, 2)), F.lit(":"), of_unit))
        .when(s.rlike(unit), F.concat(F.lit("raw:"), s))
        .when(article != "", F.concat(F.lit("art:"), F.coalesce(numeral(article).cast("string"), article)))
        .otherwise(F.concat(F.lit("raw:"), s))
    )


def scoped_key(section: Column, scope: Column, use_scope: Column | None = None) -> Column:
    """scope::kind:number, without the scope where there is none or it isn't to be used; empty without a clause number."""
    key = F.coalesce(section_key(section), F.lit(""))
    scoped = (stripped(scope) != "") & (key != "")
    scoped = scoped if use_scope is None else scoped & use_scope
    return F.when(scoped, F.concat(stripped(scope), F.lit("::"), key)).otherwise(key)


def title_line(line: Column) -> Column:
    """A cleaned line: short, no end of a sentence, no clause number, with letters."""
    flat = F.coalesce(line, F.lit(""))
    return (flat != "") & (F.length(flat) <= TITLE_CHARS) & section_no(flat).isNull() & ~flat.rlike("[。.!?！？;；:：]$") & flat.rlike("[A-Za-zÀ-ÖØ-öø-ÿ㐀-䶿一-鿿]")


def scope_heading(line: Column, lang: Column, index: Column, following: Column) -> Column:
    """X and a number where a line is the heading of an annex of its document, else null.

    A heading with a title proves itself; a bare one must stand at the top of its page or before a title.
    """
    latin, chinese = r"\s+(\d{1,3}|[IVXLCDM]+|[๐-๙]+)([A-Z])?(?![A-Za-z0-9])", r"\s*([一二三四五六七八九十百千零\d]+)\s*([A-Z])?"
    patterns = {code: unicode_digits(rf"^\s*(?:{words})" + (chinese if code == "zh" else latin)) for code, words in SCOPES.items()}

    def part(group: int) -> Column:
        out = F.regexp_extract(line, patterns["en"], group)
        for code, pattern in patterns.items():
            out = F.when(lang == code, F.regexp_extract(line, pattern, group)).otherwise(out) if code != "en" else out
        return out

    def heading(m: Column) -> Column:
        rest = stripped(F.substring(line, F.length(m.found) + 1, F.length(line)))
        proper = m.n.between(1, SCOPE_MOST) & ~line.rlike(FOREIGN_SCOPE) & (F.length(line) <= SCOPE_CHARS) & ~rest.rlike(SCOPE_PUNCTUATION) & ~rest.rlike(r"\s[0-9]{2,4}$")
        placed = rest.rlike("^[-–—]") | (index <= 1) | title_line(following)
        return F.when(proper & placed, F.concat(F.lit("X"), m.n, F.coalesce(m.letter, F.lit(""))))

    # few lines begin with any of the words
    may = line.rlike(rf"^\s*(?:{'|'.join(SCOPES.values())})")
    match = F.struct(part(0).alias("found"), T.let(part(1), numeral).alias("n"), part(2).alias("letter"))
    return F.when(may, T.let(match, heading))
