"""Sentence units of documents in several scripts, as SQL expressions.

Stops that end no sentence (in decimals, clause numbers, URLs, initials,
abbreviations, within quotations) are masked by private-use characters of the same
length, a break is put behind the terminators that the script's rule lets end a
sentence, the text is split at the breaks and the masks are taken off.  Lengths
never change, so every unit knows its place in the raw text.  In Thai the white
space itself parts sentences; there the spaces that part none are marked: before a
phrase that continues a sentence, behind one that opens a clause, around numbers,
names and quotations.

Defined cases: null and blank texts have no unit; a title, list item or table line
is one unit; unknown languages follow the rule for Latin and Cyrillic script.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.chars import CYRILLIC, GREEK, WHITE

BREAK, JOIN, EDGE = "\ue0ff", "\ue0fe", "\ue0fd"
STOPS = ".!?…。！？؟"
MASKS = "".join(chr(0xE001 + i) for i in range(len(STOPS)))
DOT = MASKS[0]
#: What is used here, and where a text's own such characters are kept meanwhile.
OURS = MASKS + EDGE + JOIN + BREAK
ASIDE = "".join(chr(0x10FF00 + i) for i in range(len(OURS)))
IGNORED = "\xad\u200b-\u200f\u2060\ufeff\u0300-\u036f"
W = f"[{WHITE}]"
I = f"[{IGNORED}]*"
DIGIT = "[0-9０-９]"

# Abbreviations whose stop ends no sentence, and words that continue a sentence behind a closed quotation.
ABBREVIATIONS = {
    "en": "approx no nos fig figs para paras sec art vol ed cf etc al mr mrs dr st vs e.g i.e a.m p.m u.s",
    "de": "ca nr abb abs art bzw vgl usw inkl max min kap ziff str dr z.b d.h u.a i.d.r s.o",
    "fr": "env art fig al chap réf max min mme dr n° p.ex c.-à-d",
    "es": "aprox núm núms art fig pág cap máx mín sr sra dr p.ej ee.uu",
    "ru": "прибл п пп рис см мес табл стр гл ст др пр руб тыс млн т.е т.д т.п",
    "ar": "",
}
CONTINUES = {
    "en": "shall must may should is are was were and or has have",
    "de": "ist sind wird werden und oder muss müssen darf steht",
    "fr": "doit doivent est sont et ou peut",
    "es": "se es son y o debe deben puede",
    "ru": "наносят наносится и или должна должен указано",
    "ar": "على أو",
}
QUOTES = {"en": "“”", "de": "„“", "fr": "«»", "es": "«»", "ru": "«»", "ar": "«»", "th": "“”", "zh": "“”"}
THAI_CONTINUES = (
    "หรือไม่ ต้องเปลี่ยน เมื่อวัด ประกอบ โดยรวม ให้ใช้กับ ครอบคลุม เป็นเวลา นาที และ ไว้บน ภายในกำหนด ดูรูป เช่น แต่ "
    "อาจเพิกถอน ขนาด รวมถึง สำหรับ(?!รถที่) ซึ่ง ที่ หรือ เดือน ปี ตาม(?!ที่) จึง"
)
#: A clause that opens a sentence; with the number or the words up to the next space.
THAI_OPENS = "ตามที่อธิบายในข้อ{W}*[0-9.]+ โดยไม่คำนึงถึงข้อ{W}*[0-9.]+ สำหรับรถที่ได้รับการรับรองหลัง{W}*[0-9]+ ในกรณีของ{T} เว้นแต่ติดตั้ง{T} ในระหว่างการทดสอบ ต้องแห้ง เช่น"
THAI_NUMBER = "ข้อ"

_SAME: dict[str, str] = {}
for _other, _latin in [*CYRILLIC.items(), *GREEK.items()]:
    _SAME[_latin] = _SAME.get(_latin, "") + _other
    _SAME[_other] = _SAME.get(_other, "") + _latin


def loose(word: str) -> str:
    """A pattern for a word however its letters are written: look-alikes, full-width, accents apart, invisible characters between."""
    import unicodedata

    out = []
    for char in unicodedata.normalize("NFC", word):
        if char == ".":
            out.append(rf"([.{DOT}]){W}*")
            continue
        base = unicodedata.normalize("NFD", char)[0]
        kinds = {char, base, *_SAME.get(base, ""), *_SAME.get(char, "")}
        if "a" <= base <= "z":
            kinds.add(chr(ord(base) + 0xFEE0))
            kinds.add(chr(ord(base.upper()) + 0xFEE0))
            kinds |= {*_SAME.get(base.upper(), "")}
        out.append("[" + "".join(sorted(k.replace("-", r"\-") for k in kinds)) + "]" + I)
    return "".join(out)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def within(text: Column, pattern: str, change) -> Column:
    """The text with change(match) put for each match of the pattern; every character is looked at once."""
    # (a compiled pattern serves all rows of a replacement, but one row of a split; matches are the odd pieces)
    pieces = F.split(F.regexp_replace(text, pattern, f"{EDGE}$0{EDGE}"), EDGE)
    return F.array_join(F.transform(pieces, lambda piece, i: F.when(i % 2 == 1, change(piece)).otherwise(piece)), "")


def _quoted(text: Column, pair: str, change) -> Column:
    """The text with change(..) made to each quotation up to its last stop and closing mark; a quotation that is never closed runs to the end."""
    opening, closing = pair
    mark, inner = f"[{opening}{closing}]", f"[^{opening}{closing}]*"
    last = rf"[{STOPS}]?{I}{closing}$"

    def closed(q: Column) -> Column:
        return let(F.regexp_extract(q, last, 0), lambda tail: F.concat(change(F.substring(q, F.lit(1), F.length(q) - F.length(tail))), tail))

    def change_all(t: Column) -> Column:
        return within(t, rf"{opening}{inner}(?:{closing}|$)", lambda q: F.when(q.endswith(closing), closed(q)).otherwise(change(q)))

    return F.when(text.rlike(mark), let(text, change_all)).otherwise(text)


def _mask(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, DOT)


def _inside_quotes(text: Column, pair: str) -> Column:
    """Stops within a quotation masked, but the last one before its closing; so are those behind a quotation that is never closed."""
    return _quoted(text, pair, lambda q: F.translate(q, STOPS, MASKS))


def _figures(text: Column, before: str = "") -> Column:
    """Stops of decimals and codes masked, and that of a clause number at the head."""
    few = I.replace("*", "{0,3}")
    text = _mask(text, rf"\.(?={I}{DIGIT})(?<=(?:{DIGIT}|\p{{Lu}}){few}\.)")
    return F.regexp_replace(text, rf"^({W}*{before}(?:\p{{Lu}}{I}{DOT})?{DIGIT}+(?:[{IGNORED}{DOT}]*{DIGIT})*{I})\.(?={I}{W})", f"$1{DOT}")


def _masked(text: Column, lang: str) -> Column:
    text = _figures(text)
    address = r"(?:https?://|www\.)\S+"
    text = F.when(text.rlike("://|www\\."), let(text, lambda t: within(t, address, lambda u: F.regexp_replace(u, r"\.(?=[\p{L}\p{N}])", DOT)))).otherwise(text)
    # (the stop first: what stands before it is only looked at where there is one)
    text = _mask(text, rf"\.(?={W}+\p{{Lu}}\p{{L}})(?<=(?:^|[^0-9\s]{W}{{1,2}})\p{{Lu}}\.)(?<!(?:^|[^0-9\s]{W}{{1,2}})[NVKCWAН]\.)")
    word = rf"(?<![\p{{L}}\p{{M}}])(?=[\p{{L}}\p{{M}}{IGNORED}°º\-]++[.{DOT}])"
    parts = [loose(w).replace(f"([.{DOT}])", f"[.{DOT}]") for w in sorted(ABBREVIATIONS[lang].split(), key=len, reverse=True)]
    text = let(text, lambda t: within(t, rf"(?iu){word}(?:{'|'.join(parts)})[.{DOT}]", lambda m: F.translate(m, ".", DOT)))
    return _inside_quotes(text, QUOTES[lang])


def _latin(text: Column, lang: str) -> Column:
    """Breaks by the rule of scripts with capital letters."""
    text = _masked(text, lang)
    start = rf"(?=[\"“„«'(\[¿¡{IGNORED}]*\p{{Lu}})"
    goes_on = "|".join(CONTINUES[lang].split())
    closer = "”»“\"’'"
    text = F.regexp_replace(text, rf"([.!?…]+{I}[{closer}]+{I})(?={W})(?!{W}+(?iu:{goes_on})(?![\p{{L}}])){_behind(start)}", f"$1{BREAK}")
    text = F.regexp_replace(text, rf"([.!?…]+{I}[)\]]*{I})(?={W}){_behind(start)}", f"$1{BREAK}")
    # a space left out: a word, a stop and a capitalised word
    return F.regexp_replace(text, rf"([.!?…](?<=[\p{{Ll}}\p{{N}}{closer}].)[.!?…]*[{closer})]*)(?=[¿¡«“„]?\p{{Lu}}[\p{{Ll}}'’ ])", f"$1{BREAK}")


def _behind(start: str) -> str:
    return start.replace("(?=", f"(?={W}+", 1)


def _arabic(text: Column) -> Column:
    text = _inside_quotes(_figures(text, rf"(?:المادة{W}+)?"), QUOTES["ar"])
    goes_on = "|".join(CONTINUES["ar"].split())
    start = rf"(?=[«\"(\[{IGNORED}]*[\p{{L}}])"
    text = F.regexp_replace(text, rf"([.!?؟…]+{I}[»\"”]+{I})(?={W})(?!{W}+(?:{goes_on})(?![\p{{L}}\p{{M}}])){_behind(start)}", f"$1{BREAK}")
    text = F.regexp_replace(text, rf"([.!?؟…]+{I}[)\]]*{I})(?={W}){_behind(start)}", f"$1{BREAK}")
    return F.regexp_replace(text, r"([.!?؟…](?<=[\p{L}\p{M}\p{N}]{2}.)[.!?؟…]*)(?=\p{IsArabic}{2})", f"$1{BREAK}")


def _chinese(text: Column) -> Column:
    text = _inside_quotes(text, QUOTES["zh"])
    closer = "”’」』\"»"
    text = F.regexp_replace(text, rf"([。！？]+{I}[{closer}]+{I})(?!{W}*(?:字样|[，、；：,;:）)。！？的{closer}]|$))", f"$1{BREAK}")
    return F.regexp_replace(text, rf"([。！？]+{I}[）)\]】]*{I})(?!{W}*(?:[，、；：,;:）)。！？{closer}{BREAK}]|$))", f"$1{BREAK}")


def _thai(text: Column) -> Column:
    thai = "\u0e00-\u0e7f"
    text = _quoted(text, QUOTES["th"], lambda q: F.regexp_replace(q, rf"({W}+)", f"$1{JOIN}"))
    number = rf"{W}*(?:{loose(THAI_NUMBER)}{W}+)?(?:\p{{Lu}}{I}[.．]?{I})?{DIGIT}[0-9０-９.．{IGNORED}]*"
    text = F.regexp_replace(text, rf"^({number})({W}++)(?!{JOIN})", f"$1$2{JOIN}")
    text = F.regexp_replace(text, rf"({W}++)(?=[^{thai}{JOIN}])", f"$1{JOIN}")
    words = "|".join(_thai_loose(w) for w in THAI_CONTINUES.split())
    text = F.regexp_replace(text, rf"({W}++)(?=(?:{words}))", f"$1{JOIN}")
    some = rf"[{thai}{IGNORED}]+"
    opens = "|".join(_thai_loose(w).replace("{T}", some).replace("{W}", f"[{WHITE}{JOIN}]").replace("{w}", f"[{WHITE}{JOIN}]") for w in THAI_OPENS.split())
    text = F.regexp_replace(text, rf"({opens})({W}++)(?!{JOIN})", f"$1$2{JOIN}")
    return F.regexp_replace(text, rf"({W}++)(?!{JOIN}|$)", f"$1{BREAK}")


def _thai_loose(pattern: str) -> str:
    """Invisible characters allowed between Thai letters."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        if "\u0e00" <= char <= "\u0e7f":
            out.append(char + I)
            i += 1
        elif char == "[":
            end = pattern.index("]", i) + 1
            end += pattern[end : end + 1] in ("*", "+")
            out.append(pattern[i:end].replace("[0-9.]", f"[0-9０-９.{IGNORED}]").replace("[0-9]", f"[0-9０-９{IGNORED}]"))
            i = end
        elif pattern.startswith("(?!", i):
            end = pattern.index(")", i) + 1
            out.append(pattern[i:end])
            i = end
        elif char == "{":
            end = pattern.index("}", i) + 1
            end += pattern[end : end + 1] in ("*", "+")
            out.append(pattern[i:end])
            i = end
        else:
            out.append(char)
            i += 1
    return "".join(out)


def marked(text: Column, lang: Column) -> Column:
    """The text with breaks between its sentences and masks on other stops."""
    # a text may hold characters that are used here
    text = F.when(text.rlike(f"[{OURS}]"), F.translate(text, OURS, ASIDE)).otherwise(text)
    out = F.when(lang == "zh", _chinese(text)).when(lang == "th", _thai(text)).when(lang == "ar", _arabic(text))
    for code in ("de", "fr", "es", "ru"):
        out = out.when(lang == code, _latin(text, code))
    return out.otherwise(_latin(text, "en"))


def restored(text: Column) -> Column:
    """The text without breaks and with its own characters; those of the private use that it had itself come back."""
    out = F.translate(F.translate(text, MASKS, STOPS), BREAK + JOIN, "")
    return F.when(out.rlike(f"[{ASIDE}]"), F.translate(out, ASIDE, OURS)).otherwise(out)


def units(rows: DataFrame, text: str, lang: Column, single: Column) -> DataFrame:
    """rows with sent_start and sentence, one row a unit; ``single`` rows are one unit as a whole."""
    whole = F.when(single, F.col(text)).otherwise(marked(F.col(text), lang))
    pieces = rows.withColumn("_pieces", F.split(let(whole, lambda t: t), BREAK))
    sizes = F.transform("_pieces", lambda p: F.length(F.translate(p, JOIN, "")))
    exploded = pieces.withColumn("_sizes", sizes).select("*", F.posexplode("_pieces").alias("_i", "_piece"))
    before = F.aggregate(F.slice("_sizes", F.lit(1), F.col("_i")), F.lit(0), lambda a, n: a + n)
    plain = F.col("_plain")
    lead = F.length(plain) - F.length(F.regexp_replace(plain, rf"^{W}+", ""))
    return (
        exploded.withColumn("_plain", restored(F.col("_piece")))
        .withColumn("sent_start", (before + lead).cast("int"))
        .withColumn("sentence", F.regexp_replace(plain, rf"^{W}+|{W}+$", ""))
        .where("sentence <> ''")
        .drop("_pieces", "_sizes", "_i", "_piece", "_plain")
    )


def clause_units(clauses: DataFrame) -> DataFrame:
    """field, sample_id, document_id, lang, segment_type, sent_start, sentence of both texts of every clause."""
    kept = ("sample_id", "document_id", "segment_type")
    source = clauses.select(F.lit("source_text").alias("field"), *kept, F.col("source_lang").alias("lang"), F.col("source_text").alias("text"))
    reference = clauses.select(F.lit("ref_text").alias("field"), *kept, F.lit("zh").alias("lang"), F.col("ref_text").alias("text"))
    single = F.coalesce(F.col("segment_type").isin("title", "list", "table"), F.lit(False))
    return units(source.union(reference).where(F.col("text").isNotNull()), "text", F.col("lang"), single).drop("text")
