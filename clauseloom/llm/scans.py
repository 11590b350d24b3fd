"""Repair of text from scanned pages, and the noise found in it.

Lines that belong to the page are found first.  A line that holds only a page number
(with its marks, in figures or Roman numerals) is one; so is a header: a line naming
a code whose template (codes and figures masked, a page number at its end left out)
recurs over clauses and whose words no clean clause has.  Without them the lines run
on; a hyphen at a line's end is taken out where clean clauses don't have the
hyphenated word.

What recognition makes of characters is learned: rare words join frequent ones whose
anagram hashes differ by one or two characters for one, and differences that several
words show, much more often than rare words of clean clauses do, are confusions of
their language.  Misread words then are found by a key that is the same for both
sides of every confusion, so a word that clean clauses don't have joins the frequent
word it stands for, however many of its characters are misread; the least number of
confusions that leads from one to the other is counted.  Of several words the one with the
fewest confusions is taken, then the most frequent.  In scripts
without spaces a character takes the place of a word: its neighbours are the key, a
character that clean clauses hardly have is the rare one.

Clean clauses are those of documents with a text layer.

Defined cases: null and blank texts have no noise; a text of page lines only is
repaired to an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.session import cut

ROMAN = r"(?:x[lc]|l?x{0,3})(?:i[xv]|v?i{0,3})"
PAGE = (
    r"(?iu)^[\s\-–—\[\](){}|·.]*(?:(?:page|p\.|pg\.?|seite|s\.|página|pág\.|стр\.|с\.|หน้า|صفحة|第)\s*)?"
    rf"(?:[0-9]{{1,4}}|{ROMAN}(?<=[ixvl]))(?:\s*[/／]\s*[0-9]{{1,4}}|\s*(?:of|von|de|sur|из|共)\s*[0-9]+)?(?:\s*页)?[\s\-–—\[\](){{}}|·]*$"
)
CODE = r"[A-Z][A-Za-z]*[-/]?[0-9]+(?:[./][0-9]+)?"
SUFFIX = r"(?iu)\s*(?:\||—|–|-|\s{2})\s*(?:p\.\s*)?#\s*$"
BROKEN_WORD = r"([\p{L}\p{M}\p{N}]+)[-‐¬\xad][ ]*\n\s*([\p{Ll}\p{M}\p{N}]+)"
RECURS = 3
#: Misread characters that make a case; how often a clean word must occur; how many contexts a character confusion needs.
LEAST, FREQUENT, SUPPORT = 2, 3, 3
UNSPACED = ("zh", "th")


def fields(clauses: DataFrame) -> DataFrame:
    """field, sample_id, lang, kind, text of both texts of every clause."""
    return clauses.select(
        "sample_id", F.col("segment_type").alias("kind"),
        F.explode(F.array(
            F.struct(F.lit("source_text").alias("field"), F.col("source_lang").alias("lang"), F.col("source_text").alias("text")),
            F.struct(F.lit("ref_text").alias("field"), F.lit("zh").alias("lang"), F.col("ref_text").alias("text")),
        )).alias("f"),
    ).select("f.field", "sample_id", "f.lang", "kind", "f.text").where("text is not null").dropDuplicates(["field", "sample_id"])


def _pieces(masked: Column) -> Column:
    """Words of a masked line, and pairs of neighbours where words aren't parted."""
    words = F.filter(F.regexp_extract_all(masked, F.lit(r"[\p{L}\p{M}]{2,}"), F.lit(0)), lambda w: ~w.rlike(r"\p{IsHan}"))
    runs = F.regexp_extract_all(masked, F.lit(r"\p{IsHan}{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, pairs))


def _masked(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(line), CODE, "⌂"), "[0-9]+", "#"))


def lines(scan: DataFrame, clean: DataFrame) -> DataFrame:
    """field, sample_id, lang, at, line, mark (page_number, running_header or null) of every line of the scanned texts."""
    split = scan.select("field", "sample_id", "lang", "kind", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    page = F.trim("line").rlike(PAGE) & F.trim("line").rlike("[0-9A-Za-z]")
    template = F.regexp_replace(_masked(F.col("line")), SUFFIX, "")
    marked = cut(split.withColumn("page", page).withColumn("template", template))
    coded = marked.where(~F.col("page") & F.col("template").contains("⌂"))
    recurring = coded.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= RECURS)
    words = recurring.select("template", F.explode_outer(_pieces(F.col("template"))).alias("piece"))
    body = clean.select(F.explode(_pieces(_masked(F.col("text")))).alias("piece")).distinct().withColumn("known", F.lit(1))
    judged = words.join(body, "piece", "left").groupBy("template").agg(F.count("piece").alias("pieces"), F.count("known").alias("known"))
    # a template without words is a header only as a document symbol: a letter, a slash, a code
    symbol = F.col("template").rlike(r"^\p{L}{1,3}/⌂(?:/#)?$")
    headers = judged.where(((F.col("pieces") > 0) & (F.col("known") * 2 < F.col("pieces"))) | ((F.col("pieces") == 0) & symbol)).select("template", F.lit(True).alias("header"))
    mark = F.when(F.col("page"), "page_number").when(F.col("header"), "running_header")
    return marked.join(headers, "template", "left").select("field", "sample_id", "lang", "at", "line", mark.alias("mark"))


def bodies(marked: DataFrame) -> DataFrame:
    """field, sample_id, lang, body: the other lines of each text in order, empty ones left out; a text without any has an empty body."""
    ordered = F.array_sort(F.collect_list(F.when(F.expr("mark is null and trim(line) <> ''"), F.struct("at", F.trim("line").alias("line")))))
    return marked.groupBy("field", "sample_id", "lang").agg(F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("body"))


def _broken(texts: DataFrame) -> DataFrame:
    """field, sample_id, first, second, form (with the hyphen) of each word with a hyphen at a line's end."""
    # (all matches of a group, one after the other)
    firsts = F.regexp_extract_all("body", F.lit(BROKEN_WORD), F.lit(1))
    seconds = F.regexp_extract_all("body", F.lit(BROKEN_WORD), F.lit(2))
    broken = texts.where("lang not in ('zh', 'th')").select("field", "sample_id", F.explode(F.arrays_zip(firsts.alias("first"), seconds.alias("second"))).alias("w")).select("field", "sample_id", "w.*")
    return broken.withColumn("form", F.lower(F.concat_ws("-", "first", "second")))


def _hyphenated(clean: DataFrame) -> DataFrame:
    return clean.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]+-[\p{L}\p{M}]+"), F.lit(0))).alias("form")).distinct()


def hyphens(texts: DataFrame, clean: DataFrame) -> DataFrame:
    """field, sample_id, first, second of each word broken across lines in the bodies."""
    return _broken(texts).join(_hyphenated(clean), "form", "left_anti").drop("form")


def compounds_kept(texts: DataFrame, clean: DataFrame) -> DataFrame:
    """The texts with each hyphen at a line's end that belongs to its word (hyphens() leaves it out) set within the line."""
    own = _broken(texts).join(_hyphenated(clean), "form", "left_semi").groupBy("field", "sample_id").agg(F.collect_set(F.struct("first", "second")).alias("own"))
    edge = r"[\p{L}\p{M}\p{N}]"

    def whole(body: Column, w: Column) -> Column:
        pattern = F.concat(F.lit(f"(?<!{edge})"), w["first"], F.lit(r"[-‐¬\xad][ ]*\n\s*"), w["second"], F.lit(f"(?!{edge})"))
        return F.regexp_replace(body, pattern, F.concat_ws("-", w["first"], w["second"]))

    body = F.when(F.col("own").isNull(), F.col("body")).otherwise(F.aggregate("own", F.col("body"), whole))
    return texts.join(own, ["field", "sample_id"], "left").select("field", "sample_id", "lang", body.alias("body"))


def joined(body: Column, lang: Column) -> Column:
    """A body as running text."""
    spaced = F.regexp_replace(F.regexp_replace(body, BROKEN_WORD, "$1$2"), r"\s*\n\s*", " ")
    return F.when(lang == "zh", F.regexp_replace(body, r"\n", "")).otherwise(spaced)


def _value(char: Column) -> Column:
    return F.xxhash64(char) % (1 << 40)


def _anagram(word: Column) -> Column:
    """The anagram hash: equal for all orders of a word's characters, and changed by a confusion by the difference of its sides."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, c: total + _value(c))


def _without(words: DataFrame, pairs: bool) -> DataFrame:
    """lang, word, rest, part: the words' anagram hashes less one character, or with ``pairs`` also less two neighbours."""
    one = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.struct(F.substring("word", i, F.lit(1)).alias("part"), _value(F.substring("word", i, F.lit(1))).alias("v")))
    two = F.transform(
        F.sequence(F.lit(1), F.length("word") - 1),
        lambda i: F.struct(F.substring("word", i, F.lit(2)).alias("part"), (_value(F.substring("word", i, F.lit(1))) + _value(F.substring("word", i + 1, F.lit(1)))).alias("v")),
    )
    parts = F.array_distinct(F.concat(one, two) if pairs else one)
    hashed = words.select("lang", "word", _anagram(F.col("word")).alias("h"), F.explode(parts).alias("x"))
    return hashed.select("lang", "word", (F.col("h") - F.col("x.v")).alias("rest"), "x.part")


def learned(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """lang, wrong, right: what recognition makes of characters in the words (lang, word), learned from them and the clean lexicon (lang, right, count).

    Rare words join frequent ones whose anagram hashes differ by one or two characters for one, and that lie as few edits apart.  A
    difference that SUPPORT words show is a confusion if rare words of clean texts, which differ from frequent ones by grammar, show it
    a fifth as often at most.
    """
    frequent = _without(lexicon.where(F.col("count") >= FREQUENT).select("lang", F.col("right").alias("word")), False).select("lang", "rest", F.col("word").alias("known"), F.col("part").alias("right"))
    clean_rare = lexicon.where(F.col("count") < FREQUENT).select("lang", F.col("right").alias("word"))
    scan_rare = words.join(lexicon.select("lang", F.col("right").alias("word")), ["lang", "word"], "left_anti")
    counts = []
    for rare, name in ((scan_rare, "seen"), (clean_rare, "usual")):
        met = _without(rare.where(~F.col("word").rlike("^[0-9]+$") & (F.length("word") >= 4)), True).join(frequent, ["lang", "rest"])
        near = met.where((F.col("part") != F.col("right")) & ~F.contains("part", "right") & (F.levenshtein("word", "known", 2) == F.length("part")))
        counts.append(near.groupBy("lang", F.col("part").alias("wrong"), "right").agg(F.count_distinct("word").alias(name)))
    sizes = [x.groupBy("lang").agg(F.count("*").alias(n)) for x, n in ((words, "all_seen"), (lexicon, "all_usual"))]
    joined = counts[0].join(counts[1], ["lang", "wrong", "right"], "left").join(F.broadcast(sizes[0]), "lang").join(F.broadcast(sizes[1]), "lang")
    often = F.col("seen") / F.col("all_seen") > 5 * F.coalesce("usual", F.lit(0)) / F.col("all_usual")
    return joined.where((F.col("seen") >= SUPPORT) & often).select("lang", "wrong", "right")


def rules_of(single: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """(wrong, right) with how many confusions lead from one to the other; what confuses a confusion's own characters counts as well."""
    rules = dict.fromkeys(single, 1)
    fresh = list(single)
    while fresh:
        wrong, right = fresh.pop()
        if len(wrong) > 1:
            for w, r in single:
                for i in range(len(wrong)):
                    longer = wrong[:i] + w + wrong[i + len(r) :]
                    if wrong.startswith(r, i) and len(longer) <= 4 and rules[wrong, right] + 1 < rules.get((longer, right), 4):
                        rules[longer, right] = rules[wrong, right] + 1
                        fresh.append((longer, right))
    return rules


def key_map(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """What stands for a character in a word's key, so that both sides of every confusion have one key."""
    root: dict[str, str] = {}

    def of(c: str) -> str:
        while root.get(c, c) != c:
            c = root[c]
        return c

    for w, r in pairs:
        if len(w) == 1 and of(w) != of(r):
            root[of(w)] = of(r)
    spelt = {of(r): w for w, r in pairs if len(w) > 1}

    def key(c: str, depth: int = 0) -> str:
        return "".join(key(x, depth + 1) for x in spelt[of(c)]) if of(c) in spelt and depth < 3 else of(c)

    return {c: key(c) for c in sorted({x for pair in pairs for side in pair for x in side})}


def confusion_key(word: Column, pairs: list[tuple[str, str]]) -> Column:
    """Equal for all words that any number of confusions leads from one to the other."""
    keys = key_map(pairs)
    ones = {c: k for c, k in keys.items() if len(k) == 1}
    # a character of a longer key may stand in another key: all are put at once, by way of placeholders
    many = {c: k for c, k in keys.items() if len(k) > 1}
    for i, c in enumerate(many):
        word = F.replace(word, F.lit(c), F.lit(chr(0xE100 + i)))
    word = F.translate(word, "".join(ones), "".join(ones.values())) if ones else word
    for i, k in enumerate(many.values()):
        word = F.replace(word, F.lit(chr(0xE100 + i)), F.lit(k))
    return word


def by_first(rules: dict[tuple[str, str], int]) -> dict[str, list[tuple[str, str, int]]]:
    out: dict[str, list[tuple[str, str, int]]] = {}
    for (w, r), n in rules.items():
        out.setdefault(w[0], []).append((w, r, n))
    return out


def confusions(word: str, right: str, rules: dict[str, list[tuple[str, str, int]]]) -> int | None:
    """The least number of confusions (rules by their first character) that lead from word to right, None if none do."""
    best = {(0, 0): 0}
    for i in range(len(word)):
        for j in range(min(len(right), i + 1)):
            if (i, j) not in best:
                continue
            n = best[i, j]
            if word[i] == right[j]:
                best[i + 1, j + 1] = min(n, best.get((i + 1, j + 1), n))
            for w, r, cost in rules.get(word[i], ()):
                if word.startswith(w, i) and right.startswith(r, j):
                    to = (i + len(w), j + len(r))
                    best[to] = min(n + cost, best.get(to, n + cost))
    return best.get((len(word), len(right)))


def corrections(words: DataFrame, clean: DataFrame) -> DataFrame:
    """lang, word, right, wrong_count of each word (lang, word) that clean texts don't have but that stands for a frequent one."""
    # in scripts without spaces only what is written in Latin letters is a word
    token = F.when(F.col("lang").isin(*UNSPACED), r"[a-z0-9]{3,}").otherwise(r"[\p{L}\p{M}\p{N}]{3,}")
    lexicon = cut(clean.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), token, F.lit(0))).alias("right")).groupBy("lang", "right").count())
    words = cut(words.distinct())
    # at most the pairs of characters that SUPPORT words show, a language
    told: dict[str, list[tuple[str, str]]] = {}
    for r in learned(words, lexicon).orderBy("lang", "wrong", "right").collect():
        told.setdefault(r["lang"], []).append((r["wrong"], r["right"]))

    def key(word: Column) -> Column:
        out = word
        for lang, pairs in told.items():
            out = F.when(F.col("lang") == lang, confusion_key(word, pairs)).otherwise(out)
        return out

    rare = words.join(lexicon.select("lang", F.col("right").alias("word")), ["lang", "word"], "left_anti").where(~F.col("word").rlike(r"^[0-9]+$"))
    frequent = lexicon.where(F.col("count") >= FREQUENT).withColumn("key", key(F.col("right")))
    found = rare.withColumn("key", key(F.col("word"))).join(frequent, ["lang", "key"]).select("lang", "word", "right", "count")
    rules = {lang: by_first(rules_of(pairs)) for lang, pairs in told.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [confusions(w, r, rules.get(lang, {})) for lang, w, r in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32())], names=["lang", "word", "right", "count", "wrong_count"])

    near = found.mapInArrow(run, "lang string, word string, right string, count long, wrong_count int").where("wrong_count is not null")
    # fewer confusions first, then the more frequent word
    return near.groupBy("lang", "word").agg(F.min_by(F.struct("right", "wrong_count"), F.struct("wrong_count", -F.col("count"), "right")).alias("best")).select("lang", "word", "best.*")


def misread_words(texts: DataFrame, clean: DataFrame) -> DataFrame:
    """field, sample_id, wrong: misread characters in words."""
    token = F.lit(r"[\p{L}\p{M}\p{N}]{3,}")
    used = cut(texts.where(~F.col("lang").isin(*UNSPACED)).select("field", "sample_id", "lang", F.explode(F.regexp_extract_all(F.lower(joined(F.col("body"), F.col("lang"))), token, F.lit(0))).alias("word")).groupBy("field", "sample_id", "lang", "word").count())
    fixes = corrections(used.select("lang", "word").distinct(), clean)
    return used.join(fixes, ["lang", "word"]).groupBy("field", "sample_id").agg(F.sum(F.col("wrong_count") * F.col("count")).alias("wrong"))


#: Bits of a character in a packed run of them.
BITS = 21


def packed(text: str) -> int:
    """Up to three characters as one number."""
    out = 0
    for c in text:
        out = out << BITS | ord(c)
    return out


def _contexts(rows: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """keys, before, char, after, count of every inner Chinese or Thai character of the rows (keys, text); names and figures are one
    character here and white space is none; characters are numbers, neighbours packed ones.  Without keys a batch counts for itself first."""
    flat = F.regexp_replace(F.regexp_replace("text", r"[0-9A-Za-z./\-]+", "0"), r"\s+", "")
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keys)).to_pylist()]
            codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            at = np.arange(reach, len(codes) - reach)
            char = codes[at]
            letter = ((char >= 0x3400) & (char <= 0x9FFF)) | ((char >= 0x0E00) & (char <= 0x0E7F)) | (char == 0x3007) | (char == 0x3005)
            at = at[letter & (row[at - reach] == row[at + reach])] if len(at) else at
            before, after, char = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), codes[at]
            for k in range(reach):
                before = before << BITS | codes[at - reach + k]
                after = after << BITS | codes[at + 1 + k]
            count = np.ones(len(at), np.int64)
            if not keys and len(at):
                order = np.lexsort((after, char, before))
                before, char, after = before[order], char[order], after[order]
                first = np.concatenate(([True], (before[1:] != before[:-1]) | (char[1:] != char[:-1]) | (after[1:] != after[:-1])))
                starts = np.flatnonzero(first)
                count = np.diff(np.append(starts, len(at)))
                before, char, after = before[starts], char[starts], after[starts]
            kept = [batch.column(i).take(pa.array(row[at])) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, (before, char, after, count))], names=[*keys, "before", "char", "after", "count"])

    shape = "".join(f"{k} {kinds[k]}, " for k in keys)
    each = rows.select(*keys, flat.alias("text")).mapInArrow(run, f"{shape}before long, char long, after long, count long")
    return each.groupBy(*keys, "before", "char", "after").agg(F.sum("count").alias("count"))


def _odd_characters(texts: DataFrame, clean: DataFrame, lang: str, reach: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seen, odd, pairs): the characters of the scanned texts (field, sample_id, before, char, after, count); those
    that stand where clean texts have another (with right); char, right, contexts of what recurs as a misreading."""
    spot = ["before", "after"]
    mine = texts.where(F.col("lang") == lang).select("field", "sample_id", joined(F.col("body"), F.col("lang")).alias("text"))
    seen = cut(_contexts(mine, ["field", "sample_id"], reach))
    known = cut(_contexts(clean.where(F.col("lang") == lang).select("text"), [], reach))
    usual = known.where(F.col("count") >= FREQUENT).groupBy(*spot).agg(F.max_by("char", "count").alias("right"))
    odd = seen.join(known, ["before", "char", "after"], "left_anti").join(usual, spot).where("char <> right")
    # a character that clean texts have as often as scanned ones is no misreading
    total_seen, total_known = (x.groupBy().agg(F.sum("count").alias("all")) for x in (seen, known))
    often = seen.groupBy("char").agg(F.sum("count").alias("here")).join(known.groupBy("char").agg(F.sum("count").alias("there")), "char", "left")
    rates = often.join(F.broadcast(total_seen.withColumnRenamed("all", "all_here"))).join(F.broadcast(total_known.withColumnRenamed("all", "all_there")))
    foreign = rates.where(F.col("here") / F.col("all_here") > 5 * F.coalesce("there", F.lit(0)) / F.col("all_there")).select("char")
    if lang == "zh":
        odd = odd.join(foreign, "char", "left_semi")
    pairs = odd.groupBy("char", "right").agg(F.count_distinct("before", "after").alias("contexts")).where(F.col("contexts") >= SUPPORT)
    return seen, odd, pairs


def misread_characters(texts: DataFrame, clean: DataFrame, lang: str, reach: int) -> DataFrame:
    """field, sample_id, wrong: misread characters in a script without spaces."""
    seen, odd, pairs = _odd_characters(texts, clean, lang, reach)
    if lang == "zh":
        # a character found to be foreign is wrong wherever it stands, also beside another wrong one; so is a figure within a name's letters
        names = texts.where(F.col("lang") == lang).select("field", "sample_id", F.regexp_count(joined(F.col("body"), F.col("lang")), F.lit(r"(?<=[a-z])[0-9](?=[a-z])")).cast("long").alias("wrong"))
        signs = seen.join(pairs.select("char").distinct(), "char", "left_semi").select("field", "sample_id", F.col("count").alias("wrong"))
        return signs.union(names).groupBy("field", "sample_id").agg(F.sum("wrong").alias("wrong"))
    return odd.join(pairs, ["char", "right"], "left_semi").groupBy("field", "sample_id").agg(F.sum("count").alias("wrong"))


def character_fixes(texts: DataFrame, clean: DataFrame, lang: str, reach: int) -> DataFrame:
    """field, sample_id, fixes: (before, char, after, right) of each character that misread_characters counts.

    The right character is the one clean texts have between these neighbours; where a neighbour is
    wrong too, it is the one that the misread character stands for in most contexts.
    """
    seen, odd, pairs = _odd_characters(texts, clean, lang, reach)
    key = ["field", "sample_id", "before", "char", "after"]
    fixes = odd.join(pairs, ["char", "right"], "left_semi").select(*key, "right")
    if lang == "zh":
        mostly = pairs.groupBy("char").agg(F.max_by("right", F.struct("contexts", "right")).alias("mostly"))
        fixes = seen.join(mostly, "char").join(fixes, key, "left").select(*key, F.coalesce("right", "mostly").alias("right"))
    return fixes.groupBy("field", "sample_id").agg(F.collect_list(F.struct("before", "char", "after", "right")).alias("fixes"))


def _placed(text: str, fixes: list, reach: int) -> str:
    """The text with the fixes at their places; the neighbours are those of _contexts."""
    flat, at = [], []
    for m in re.finditer(r"([0-9A-Za-z./\-]+)|\s+|(.)", text, re.ASCII | re.DOTALL):
        if m.group(1) or m.group(2):
            flat.append("0" if m.group(1) else m.group(2))
            at.append(m.start())
    flat, out = "".join(flat), list(text)
    right = {(x["before"], x["char"], x["after"]): x["right"] for x in fixes}
    for i in range(reach, len(flat) - reach):
        c = right.get((packed(flat[i - reach : i]), ord(flat[i]), packed(flat[i + 1 : i + 1 + reach])))
        if c is not None:
            out[at[i]] = chr(c)
    return "".join(out)


def characters_repaired(texts: DataFrame, clean: DataFrame, lang: str, reach: int) -> DataFrame:
    """field, sample_id, lang, text of the texts in a script without spaces, misread characters corrected."""
    rows = texts.where(F.col("lang") == lang).join(character_fixes(texts, clean, lang, reach), ["field", "sample_id"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixed = [_placed(t, x, reach) if x else t for t, x in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fixed, pa.string())], names=["field", "sample_id", "lang", "text"])

    return rows.select("field", "sample_id", "lang", "text", "fixes").mapInArrow(run, "field string, sample_id string, lang string, text string")


def noise(scan: DataFrame, clean: DataFrame) -> DataFrame:
    """field, sample_id, noise of everything found in the scanned texts (fields of clauses)."""
    key = ["field", "sample_id"]
    marked = cut(lines(scan, clean))
    texts = cut(bodies(marked))
    wrong = misread_words(compounds_kept(texts, clean), clean).union(misread_characters(texts, clean, "zh", 1)).union(misread_characters(texts, clean, "th", 2))
    return (
        marked.where("mark is not null").select(*key, F.col("mark").alias("noise"))
        .union(hyphens(texts, clean).select(*key, F.lit("hyphenation")))
        .union(wrong.where(F.col("wrong") >= LEAST).select(*key, F.lit("misread")))
        .distinct()
    )


def repaired(scan: DataFrame, clean: DataFrame) -> DataFrame:
    """field, sample_id, text: continuous text without page lines and broken words, misread words and characters corrected."""
    marked = cut(lines(scan, clean))
    texts = cut(compounds_kept(bodies(marked), clean).withColumn("text", joined(F.col("body"), F.col("lang"))))
    spaced = texts.where(F.coalesce(~F.col("lang").isin(*UNSPACED), F.lit(True))).select("field", "sample_id", "lang", "text")
    unspaced = characters_repaired(texts, clean, "zh", 1).union(characters_repaired(texts, clean, "th", 2))
    edge = F.when(F.col("lang").isin(*UNSPACED), "[^A-Za-z0-9]").otherwise(r"[^\p{L}\p{M}\p{N}]")
    token = F.concat(F.lit("(?<="), edge, F.lit(")|(?="), edge, F.lit(")"))
    parts = cut(spaced.union(unspaced).select("field", "sample_id", "lang", F.posexplode(F.split("text", token)).alias("at", "part")).withColumn("word", F.lower("part")))
    # what is a figure by itself stays, also beside letters of a code
    name = ~F.col("lang").isin(*UNSPACED) | F.col("part").rlike("[a-z][0-9]+[a-z]")
    fixes = corrections(parts.where(name).select("lang", "word").where(F.length("word") >= 3).distinct(), clean)
    fixed = parts.join(fixes, ["lang", "word"], "left")
    # the case of the first letter is kept
    right = F.when(F.substring("part", 1, 1) == F.upper(F.substring("part", 1, 1)), F.concat(F.upper(F.substring("right", 1, 1)), F.substring("right", F.lit(2), F.length("right")))).otherwise(F.col("right"))
    ordered = F.array_sort(F.collect_list(F.struct("at", F.coalesce(right, "part").alias("part"))))
    return fixed.groupBy("field", "sample_id").agg(F.array_join(F.transform(ordered, lambda x: x.part), "").alias("text"))
