"""Sentences, labelled units and pieces of bounded length of single texts, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseloom.functions import text as T

BREAK, DOT = "\ue0ff", "\ue0fe"
# Abbreviations whose stop ends no sentence, the letters that count items in Thai, and the marks of items.
ABBREVIATIONS = "e\\.g|i\\.e|cf|etc|vs|approx|min|max|No|Nos|Fig|Figs|Art|para|paras|Rev|Amend|Suppl|Ch|Sect|Vol|Ann|Tab|Eq|Ref|Dr|Mr|Mrs|Ms|St|Inc|Ltd|Co"
SECTION = r"^\s*(?:[0-9]{1,3}(?:\.[0-9]{1,3})*\.?|[A-Z]\.)\s+"
THAI_ITEMS, LATIN_ITEMS = "กขคงจฉชซ", "abcdefgh"
MARKER = r"[(（]\s*(?:[0-9๐-๙]{1,3}(?:\.[0-9๐-๙]{1,3})*|[ก-ฮ]|[a-zA-Z])\s*[)）]|(?:(?<=\s)|^)[0-9๐-๙]{1,3}(?:\.[0-9๐-๙]{1,3})+\)|(?:^|(?<=[:;.،；：]\s{0,3}))[0-9]{1,3}°(?=\s)"


def _protected(text: Column) -> Column:
    """Stops of abbreviations, figures and initials as placeholders."""
    t = F.regexp_replace(text, rf"(?i)\b({ABBREVIATIONS})\.", f"$1{DOT}")
    t = F.regexp_replace(t, r"(?<=[0-9])\.(?=[0-9])", DOT)
    return F.regexp_replace(t, rf"(?<=(?:\b|{DOT})[A-Z])\.(?=[A-Z](?:\b|\.))", DOT)


def _pieces(marked: Column) -> Column:
    return F.filter(F.transform(F.split(marked, BREAK), lambda x: F.trim(F.translate(x, DOT, "."))), lambda x: x != "")


def sentences_latin(text: Column, semicolon: bool = False, strip_section: bool = True) -> Column:
    """Sentences of a text in a script with capitals; a leading clause number is no part of the first unless asked for."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SECTION, "")) if strip_section else F.trim(F.coalesce(text, F.lit("")))
    t = _protected(t)
    t = F.regexp_replace(t, r";(?=\s)", ".") if semicolon else t
    return _pieces(F.regexp_replace(t, r"([.!?])(?=\s+[\"“'(\[A-ZА-ЯЁ-])", f"$1{BREAK}"))


def sentences_chinese(text: Column, semicolon: bool = False, strip_section: bool = True) -> Column:
    """Sentences of a Chinese text; closing quotation marks and brackets belong to the sentence before."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SECTION, "")) if strip_section else F.trim(F.coalesce(text, F.lit("")))
    t = F.translate(_protected(t), "；", "。") if semicolon else _protected(t)
    return _pieces(F.regexp_replace(t, r"([。！？](?:[”』」）)\]】]|\s)*)", f"$1{BREAK}"))


def label(mark: Column) -> Column:
    """A mark of an item in one form: figures as ASCII, Thai letters as the Latin ones that translations use, lower case."""
    flat = F.regexp_replace(F.translate(mark, "๐๑๒๓๔๕๖๗๘๙", "0123456789"), r"[()（）\s°]", "")
    return F.lower(F.when(F.length(flat) == 1, F.translate(flat, THAI_ITEMS, LATIN_ITEMS)).otherwise(flat))


def labelled_units(text: Column) -> Column:
    """Array of (label, body): a text cut before its items' marks; what stands before the first is _head."""
    pieces = F.filter(F.transform(F.split(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), f"({MARKER})", f"{BREAK}$1"), BREAK), lambda x: F.trim(x)), lambda x: x != "")
    mark = lambda x: F.regexp_extract(x, f"^(?:{MARKER})", 0)
    return F.transform(pieces, lambda x: F.struct(F.when(mark(x) == "", "_head").otherwise(label(mark(x))).alias("label"), x.alias("body")))


def sentences_thai(text: Column) -> Column:
    """The labelled units of a Thai text; a block without marks stays whole, as no statistical splitter is at hand."""
    return F.transform(labelled_units(text), lambda u: u.body)


def sentences_auto(text: Column, semicolon: bool = False) -> Column:
    """By the script that most letters belong to."""
    thai, han, latin = (T.count(F.coalesce(text, F.lit("")), p) for p in ("[\\x{0e00}-\\x{0e7f}]", "[一-鿿]", "[A-Za-z]"))
    return F.when((thai > han) & (thai > latin), sentences_thai(text)).when(han > latin, sentences_chinese(text, semicolon)).otherwise(sentences_latin(text, semicolon))


def long_text(text: Column, most: int) -> Column:
    """A cleaned text in pieces of at most ``most`` characters, whole sentences packed as long as they fit; a longer sentence is cut."""
    sentences = F.split(F.regexp_replace(text, r"(?<=[。.!?！？;；؟؛])\s+", BREAK), BREAK)
    cut = F.flatten(F.transform(sentences, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(x) - 1) / most), F.lit(0)).cast("int")), lambda i: F.substring(x, i * most + 1, F.lit(most)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, x: Column) -> Column:
        fits = F.length(s.open) + F.length(x) + 1 <= most
        grown = F.when(s.open == "", x).otherwise(F.concat(s.open, F.lit(" "), x))
        return F.when((s.open == "") | fits, F.struct(s.done.alias("done"), grown.alias("open"))).otherwise(F.struct(F.array_append(s.done, s.open).alias("done"), x.alias("open")))

    packed = F.aggregate(cut, start, step, lambda s: F.when(s.open == "", s.done).otherwise(F.array_append(s.done, s.open)))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(packed)
