"""One consistent form for text that looks the same.

Texts that hold no code point the form could change are in the form already; one
pass of a regular expression finds the others.  Those are exploded to positioned
code points, joined with broadcast tables (decompositions, combining classes,
look-alikes, built from the Unicode database, so of a fixed size), marks are put in
order of their class behind their letter and composed with it, and the letters of a
word that mixes scripts take the look-alikes of the word's own script.

The form: full-width letters and digits, ligatures, presentation and radical forms
as ordinary letters; letters composed with their accents (canonical composition);
no invisible characters; every space as U+0020; words of one script.  Kept as they
are: punctuation of any width, superscripts, the degree and numero signs, digits of
other scripts, Thai spelling, line breaks.  In a section number also the full-width
stop becomes a stop and a single look-alike letter before the first stop is Latin.

Defined cases: null -> null; empty and blank texts stay as they are; repeated texts
are worked once.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.session import cut

# Letters of other scripts by the Latin letter they look like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTYXaesijopcyxhdqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιυ", "ABEZHIKMNOPTYXoviu"))

#: Spaces, line breaks and other white space, for the inside of a character class.
WHITE = "\\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
INVISIBLE = "\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff"
SPACES = "\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: Full-width letters and digits, ligatures, presentation forms, radicals, compatibility ideographs, half-width forms.
FORMS = "\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\ufb00-\ufb06\ufb13-\ufb17\ufb1d-\ufdf9\ufe70-\ufefc\u2e80-\u2fd5\uf900-\ufaff\uff66-\uffdc"
#: Stands before each composition in the packed list of them.
MARK = "\ue0fd"
#: Signs that the Unicode database equates with letters: ohm, kelvin, angstrom.
SINGLES = "\u2126\u212a\u212b"
OTHERS = "".join([*CYRILLIC, *GREEK])
#: What the form could change: the classes above and marks that aren't Thai; in texts that hold look-alikes, also words of two scripts.
#: Looks at a character before a long class does: most characters of a text lie in these few ranges and in none of the classes above.
RARE = "(?=[^\x21-\x7e\xc0-\u02ff\u0620-\u10ff\u3001-\ufdff])"
#: Characters of which none is invisible or white, those of most texts; a run of them is passed over in one step.
CLEAN = "\x21-\x7e\u3001-\ufdff\xae-\u034e\u061d-\u115e\u0350-\u061b\uff00-\uffef\u2010-\u2027\u2030-\u205e\xa1-\xac"
CHANGEABLE = f"[{INVISIBLE}{SPACES}{FORMS}{SINGLES}[\\p{{M}}&&[^\u0e00-\u0e7f]]]"
MIXED = (
    rf"[\p{{IsLatin}}][\p{{L}}\p{{N}}\p{{M}}]*[{OTHERS}]|[{OTHERS}][\p{{L}}\p{{N}}\p{{M}}]*[\p{{IsLatin}}]"
    r"|[\p{IsGreek}][\p{L}\p{N}\p{M}]*\p{IsCyrillic}|\p{IsCyrillic}[\p{L}\p{N}\p{M}]*\p{IsGreek}"
)
PREFIX = rf"^[{WHITE}]*[{OTHERS}]\."


def _listed(code: int, classes: str) -> bool:
    import re

    return re.match(f"[{classes}]", chr(code)) is not None


@lru_cache
def tables() -> tuple[list[tuple], dict[str, str]]:
    """Rows (char, parts, classes of the parts, white, gone, latin, cyrillic, greek) and the compositions of two."""
    to_cyrillic, to_greek = {v: k for k, v in CYRILLIC.items()}, {v: k for k, v in GREEK.items()}
    rows, composed = [], {}
    for code in range(0xA0, 0x2FA20):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or 0x20000 <= code < 0x2F800:
            continue
        char = chr(code)
        canonical = unicodedata.decomposition(char)
        parts = unicodedata.normalize("NFD", char)
        gone, space, form = (_listed(code, c) for c in (INVISIBLE, SPACES, FORMS)) if code < 0x10000 else (False,) * 3
        if form:
            parts = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", char))
        if canonical and "<" not in canonical and len(canonical.split()) == 2:
            pair = "".join(chr(int(x, 16)) for x in canonical.split())
            if unicodedata.normalize("NFC", pair) == char:
                composed[pair] = char
        look = CYRILLIC.get(char) or GREEK.get(char)
        if gone or space or form or parts != char or unicodedata.combining(char) or look:
            rows.append((char, list(parts), [unicodedata.combining(p) for p in parts], space, gone, look, to_cyrillic.get(look) if char in GREEK else None, to_greek.get(look) if char in CYRILLIC else None))
    for latin in sorted({*to_cyrillic, *to_greek}):
        rows.append((latin, [latin], [0], False, False, None, to_cyrillic.get(latin), to_greek.get(latin)))
    return rows, composed


#: A Korean syllable written in its letters, and all syllables in order.
JAMO = "([\u1100-\u1112])([\u1161-\u1175])([\u11a8-\u11c2]?)"
SYLLABLES = "".join(map(chr, range(0xAC00, 0xD7A4)))


def syllables(text: Column) -> Column:
    """Korean letters joined to syllables, which are numbered by their letters."""

    def place(c: Column, first: int) -> Column:
        return F.instr(F.lit("".join(map(chr, range(first, first + 28)))), c)

    def whole(m: Column) -> Column:
        lead, vowel, tail = (F.substring(m, i, F.lit(1)) for i in (1, 2, 3))
        number = ((place(lead, 0x1100) - 1) * 21 + place(vowel, 0x1161) - 1) * 28 + F.when(tail == "", 0).otherwise(place(tail, 0x11A8))
        return F.substring(F.lit(SYLLABLES), number + 1, F.lit(1))

    from clauseloom.llm.sentences import within

    return F.when(text.rlike(JAMO), within(text, JAMO, whole)).otherwise(text)


def changeable(text: Column, section: bool = False) -> Column:
    found = text.rlike(CHANGEABLE) | text.rlike(JAMO) | (text.rlike("[\u0370-\u04ff\u0501\u051b\u051d]") & text.rlike(MIXED))
    return found | text.rlike(PREFIX) | text.contains("\uff0e") if section else found


def forms(texts: DataFrame, section: bool = False) -> DataFrame:
    """text, form of every distinct text of a column named text; meant for changeable texts."""
    spark = texts.sparkSession
    rows, composed = tables()
    strings = pa.list_(pa.string())
    kinds = (("char", pa.string()), ("parts", strings), ("classes", pa.list_(pa.int32())), ("space", pa.bool_()), ("gone", pa.bool_()), *((x, pa.string()) for x in ("latin", "cyrillic", "greek")))
    known = F.broadcast(spark.createDataFrame(pa.table({name: pa.array(column, kind) for (name, kind), column in zip(kinds, zip(*rows))})))
    pairs = F.lit("".join(MARK + pair + whole for pair, whole in composed.items()))
    work = cut(texts.select("text").distinct().withColumn("id", F.md5("text")))
    raw = F.translate("text", "\uff0e", ".") if section else F.col("text")
    chars = work.select("id", F.posexplode(F.split(raw, "")).alias("at", "char")).where("char <> ''")
    joined = chars.join(known, "char", "left").where("gone is null or not gone")
    # a code point's parts with their combining classes, then clusters: a part of class 0 and the marks behind it
    parts = joined.select(
        "id", "at", "latin", "cyrillic", "greek",
        F.posexplode(F.when(F.col("space"), F.array(F.struct(F.lit(" ").alias("p"), F.lit(0).alias("c")))).otherwise(
            F.coalesce(F.arrays_zip(F.col("parts").alias("p"), F.col("classes").alias("c")), F.array(F.struct(F.col("char").alias("p"), F.lit(0).alias("c"))))
        )).alias("sub", "part"),
    )
    in_text = Window.partitionBy("id").orderBy("at", "sub")
    clustered = parts.withColumn("cluster", F.sum((F.col("part.c") == 0).cast("int")).over(in_text))
    glyphs = clustered.groupBy("id", "cluster").agg(
        F.array_sort(F.collect_list(F.struct(F.col("part.c").alias("c"), "at", "sub", F.col("part.p").alias("p")))).alias("parts"),
        *(F.first(F.when(F.col("part.c") == 0, F.col(c)), ignorenulls=True).alias(c) for c in ("latin", "cyrillic", "greek")),
    )
    # each mark in turn joins the letter where a composed letter exists, else it stays behind it
    fold = F.aggregate(
        F.transform("parts", lambda x: x.p),
        F.struct(F.lit("").alias("base"), F.lit("").alias("rest")),
        lambda a, p: F.when(a.base == "", F.struct(p.alias("base"), F.lit("").alias("rest")))
        .when(F.instr(pairs, F.concat(F.lit(MARK), a.base, p)) > 0, F.struct(F.substring(pairs, F.instr(pairs, F.concat(F.lit(MARK), a.base, p)) + 3, F.lit(1)).alias("base"), a.rest.alias("rest")))
        .otherwise(F.struct(a.base.alias("base"), F.concat(a.rest, p).alias("rest"))),
        lambda a: F.concat(a.base, a.rest),
    )
    shown = glyphs.select("id", "cluster", fold.alias("glyph"), "latin", "cyrillic", "greek").withColumn("inner", F.col("glyph").rlike(r"^[\p{L}\p{N}\p{M}]"))
    in_order = Window.partitionBy("id").orderBy("cluster")
    worded = shown.withColumn("word", F.sum((~F.col("inner")).cast("int")).over(in_order))
    for script in ("Latin", "Cyrillic", "Greek"):
        worded = worded.withColumn(f"is{script}", F.col("glyph").rlike(rf"^\p{{Is{script}}}"))
    word = Window.partitionBy("id", "word")

    def count(condition: Column) -> Column:
        return F.sum((F.col("inner") & condition).cast("int")).over(word)

    own = {
        "latin": F.col("isLatin") & F.col("cyrillic").isNull(),
        "latin_not_greek": F.col("isLatin") & F.col("greek").isNull(),
        "cyrillic": F.col("isCyrillic") & F.col("latin").isNull(),
        "greek": F.col("isGreek") & F.col("latin").isNull(),
    }
    counted = worded.select(
        "*",
        *(count(condition).alias(f"own_{script}") for script, condition in own.items()),
        *(count(F.col(f"is{s}")).alias(f"n_{s.lower()}") for s in ("Latin", "Cyrillic", "Greek")),
    )
    mixed = (F.col("n_latin") > 0).cast("int") + (F.col("n_cyrillic") > 0).cast("int") + (F.col("n_greek") > 0).cast("int") > 1
    # the script whose letters have no look-alike here, else the one with most letters, else Latin
    own_latin = F.when(F.col("n_cyrillic") > 0, F.col("own_latin")).otherwise(F.col("own_latin_not_greek"))
    owned = {"latin": own_latin, "cyrillic": F.col("own_cyrillic"), "greek": F.col("own_greek")}
    weight = [n * 10000 + F.col(f"n_{script}") for script, n in owned.items()]
    most = F.greatest(*weight)
    target = F.when(weight[0] == most, F.col("latin")).when(weight[1] == most, F.col("cyrillic")).otherwise(F.col("greek"))
    settled = counted.select("id", "cluster", F.when(mixed & F.col("inner"), F.coalesce(target, F.col("glyph"))).otherwise(F.col("glyph")).alias("glyph"))
    rebuilt = settled.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "glyph"))), lambda x: x.glyph), "").alias("form")
    )
    out = work.join(rebuilt, "id", "left").select("text", syllables(F.coalesce("form", F.lit(""))).alias("form"))
    if section:
        first = F.regexp_extract("form", rf"^([{WHITE}]*)([{OTHERS}])\.", 2)
        latin = F.translate(first, OTHERS, "".join([*CYRILLIC.values(), *GREEK.values()]))
        space = F.regexp_extract("form", rf"^([{WHITE}]*)", 1)
        out = out.withColumn("form", F.when(first != "", F.concat(space, latin, F.expr("substring(form, length(regexp_extract(form, '^(\\\\s*)', 1)) + 2)"))).otherwise(F.col("form")))
    return out


def stripped(text: Column) -> Column:
    edges = F.substring(text, 1, 1).rlike(f"[{WHITE}]") | F.right(text, F.lit(1)).rlike(f"[{WHITE}]")
    return F.when(edges, F.regexp_replace(text, rf"^[{WHITE}]+|[{WHITE}]+$", "")).otherwise(text)


def consistent(rows: DataFrame, column: str, section: bool = False) -> DataFrame:
    """rows with ``column``_form: the consistent form of the column, equal to it where nothing changes."""
    texts = rows.select(F.col(column).alias("text")).where(F.col("text").isNotNull() & changeable(F.col("text"), section))
    changed = forms(texts, section).where("form <> text")
    return rows.join(changed.select(F.col("text").alias(column), F.col("form").alias("_form")), column, "left").withColumn(
        f"{column}_form", F.coalesce("_form", F.col(column))
    ).drop("_form")


def inconsistent(rows: DataFrame, column: str, section: bool = False) -> DataFrame:
    """The rows whose text, without the white space around it, isn't in the consistent form."""
    # only changeable texts are moved, and looked for once; the others are in the form
    risky = cut(rows.withColumn("text", stripped(F.col(column))).where(changeable(F.col("text"), section)))
    return risky.join(forms(risky, section).where("form <> text").select("text"), "text", "left_semi").drop("text")
