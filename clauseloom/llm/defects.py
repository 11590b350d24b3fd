"""Defective answers: empty, truncated, refusal, copy, wrong language.

empty: null, or nothing but white space, marks, a label or a clause number.
copy: the letters and digits of the source again, whatever the case, accents, look-alikes or dressing.
refusal: what it says occurs neither in any source nor in any reference (its runs of
  GRAMS characters are unknown to both; only answers that have little of their own reference
  are asked about), and its template recurs: openings of such answers are clustered by MinHash, verified by the exact similarity of their shingles, and a
  cluster must answer several unrelated prompts.
wrong_language: most letters belong to a language that is neither Chinese nor the source's;
  languages in Latin script are told apart by the trigrams of all sources.
truncated: the cut answers of the truncation operator among the rest.

One defect an answer, the first that holds in the order empty, copy, refusal,
wrong_language, truncated.  Table lines may repeat their source.

Defined cases: a null source can't be copied; repeated rows count once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm import truncation
from clauseloom.llm.chars import CLEAN, CYRILLIC, GREEK, INVISIBLE, RARE
from clauseloom.llm.sentences import let
from clauseloom.session import cut

# Labels put before an answer, and words that stand for nothing.
LABELS = "译文|翻译|答案|答复|回答|中文|结果|translation|translated text|answer|output|response|target|chinese|übersetzung|traduction|traducción|перевод|คำแปล|الترجمة"
NOTHING = "null|none|nil|nan|n a|na|undefined|empty|todo|tbd|无|空"
CLAUSE = r"(?:(?:article|artículo|artikel|art\.?|§|статья|المادة|ข้อ|第)\s*)?(?:\p{L}{0,2}[.．]?\s*)?[0-9０-９]+(?:[.．\-/][0-9０-９]+)*\p{Ll}?[.．)）]?\s*(?:条)?"
#: Characters of a run in Chinese and in other scripts; bits of the map of runs that are looked for; share of an answer's runs
#: that its reference doesn't have, from which it is looked for elsewhere, and share that occurs nowhere, of a refusal.
GRAMS = (3, 7)
WANTED_BITS = 24
UNLIKE, ALIEN = 0.5, 0.5
#: Bits of a trigram's hash in the profile of a language.
PROFILE = 13
PROMPTS = 2
#: Parts of a band that are compared with another such block at once.
BAND = 256
#: Characters of an opening, and the parts between marks that are looked at.
OPENING, PARTS = 120, 6


def content(text: Column) -> Column:
    """What is left of an answer without invisible characters, wrapping marks, a label and a leading clause number."""
    return bare(truncation.tidy(text))


def bare(out: Column) -> Column:
    """content() of a text that is tidy already."""
    out = F.regexp_replace(out, r"^[\p{P}\p{S}\s]*(?:text|markdown|json|html)?[\p{P}\p{S}\s]*(?=(?iu:" + LABELS + r"))", "")
    out = F.regexp_replace(out, rf"(?iu)^(?:{LABELS})\s*[:：]+[\p{{P}}\p{{S}}\s]*", "")
    return F.regexp_replace(out, rf"(?iu)^{CLAUSE}(?=[\s\p{{P}}]|$)[\s.．]*", "")


def without_content(text: Column) -> Column:
    return nothing(content(text))


def nothing(left: Column) -> Column:
    """Whether what content() left says nothing."""
    words = F.trim(F.regexp_replace(left, r"[\p{P}\p{S}\s]+", " "))
    return F.coalesce(~left.rlike(r"\p{L}|\p{N}") | ((F.length(left) < 40) & words.rlike(rf"(?iu)^(?:{NOTHING}|{LABELS})$")), F.lit(True))


#: The letters of a script; ranges are quicker than properties.
LETTERS = {"zh": "[\u3400-\u9fff\U00020000-\U000323af]", "ru": "[\u0400-\u052f]", "ar": "[\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufefc]", "th": "[\u0e00-\u0e7f]", "latin": "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f\u1e00-\u1eff]"}
_LOOK = str.maketrans({**CYRILLIC, **GREEK})


def key(text: str) -> str:
    """Letters and digits only, without case, accents, look-alikes and forms."""
    flat = unicodedata.normalize("NFKD", text.translate(_LOOK)).casefold()
    return "".join(c for c in flat if c.isalnum())


def is_copy(source: str | None, answer: str | None) -> bool:
    if not source or not answer:
        return False
    a, b = key(source), key(answer)
    if not a or not b:
        return False
    if a in b:
        return len(a) >= 0.4 * len(b)
    return b in a and len(b) >= max(20, 0.3 * len(a))


def _copied(source: Column, answer: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(sources, answers):
        return sources.combine(answers, is_copy)

    return run(source, answer)


def script(text: Column) -> Column:
    """zh, ru, ar, th or latin by the letters of a text; null without any."""

    def letters(pattern: str) -> Column:
        # runs are taken out, which is quicker than counting single characters
        return F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))

    def most(n: Column) -> Column:
        out = F.when(F.greatest(n.zh, n.ru, n.ar, n.th, n.latin) == 0, F.lit(None).cast("string"))
        for code in ("zh", "ru", "ar", "th"):
            out = out.when(n[code] == F.greatest(n.zh, n.ru, n.ar, n.th, n.latin), code)
        return out.otherwise("latin")

    han = letters(LETTERS["zh"])
    # a Chinese character stands for about two letters
    counts = F.struct((2 * han).alias("zh"), *[letters(LETTERS[code]).alias(code) for code in ("ru", "ar", "th", "latin")])
    # where a third of all characters is Chinese, no other script can weigh more
    return F.when((F.length(text) > 0) & (3 * han >= F.length(text)), "zh").otherwise(let(counts, most))


def _grams(codes: np.ndarray, size: int, bits: int) -> np.ndarray:
    n = max(len(codes) - size + 1, 0)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = (h ^ codes[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _plain(text: Column) -> Column:
    """Letters only, in lower case, other runs as one space."""
    visible = F.when(text.rlike(rf"^[{CLEAN} \n]*+\z"), text).otherwise(F.regexp_replace(text, f"{RARE}[{INVISIBLE}]+", ""))
    return F.lower(F.regexp_replace(visible, r"[^\p{L}\p{M}]+", " "))


def unlike_reference(answer: Column, reference: Column) -> Column:
    """The share of the runs of Chinese characters of an answer that its reference doesn't have; 1 where there is none.

    A bit of a table is set for each run of a reference and looked at for those of its answer, a batch at a time.
    """
    size, bits = GRAMS[0], 24

    @F.pandas_udf("double")
    def run(answers, references):
        import pandas as pd

        sides = []
        for texts in (answers, references):
            texts = [t or "" for t in texts]
            lengths = np.array([len(t) for t in texts], np.int64)
            codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            n = np.maximum(lengths - size + 1, 0)
            row = np.repeat(np.arange(len(texts)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(lengths) - lengths, n)
            h = _grams(codes, size, 63).astype(np.uint64)[at] if len(codes) >= size else np.array([], np.uint64)
            sides.append((row, ((h ^ (row.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - bits), n))
        (row, own, n), (_, other, _) = sides
        seen = np.zeros(1 << bits, bool)
        seen[other] = True
        unknown = np.bincount(row, ~seen[own], len(n))
        return pd.Series(np.where(n > 0, unknown / np.maximum(n, 1), 1.0))

    han = lambda text: F.regexp_replace(text, "[^\u3400-\u9fff]+", " ")
    return run(han(answer), han(reference))


def _runs(plain: str, spoken: str | None) -> np.ndarray:
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.unique(_grams(codes, GRAMS[0] if spoken in ("zh", "th", None) else GRAMS[1], 63))


def counted(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Of a table of lang and text: lang, at, n, how often each hashed trigram occurs in a language in Latin script, and, where
    lang is null, at of every run of characters that may be wanted (words of 64 bits, a bit for each value of the low bits of its hash).  All texts are counted."""
    # bits are sent as they are and spread out in the tasks, so that the driver never holds a byte for each
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value.view(np.uint8), bitorder="little").view(bool)
        low = len(bits) - 1
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            lines = batch.column(1).to_pylist()
            met = []
            for lang in set(langs):
                codes = np.frombuffer("\n".join(lines[i] or "" for i in np.flatnonzero(langs == lang)).encode("utf-32-le", "surrogatepass"), np.uint32)
                for size in GRAMS:
                    h = _grams(codes, size, 63)
                    met.append(np.unique(h[bits[h & low]]))
                latin = (codes < 0x250) & (codes > 32)
                if lang is not None and 2 * np.count_nonzero(latin) > np.count_nonzero(codes > 32):
                    found = np.bincount(_grams(codes, 3, PROFILE), minlength=1 << PROFILE)
                    sums[lang] = sums[lang] + found if lang in sums else found
            hits = np.unique(np.concatenate(met)) if met else np.array([], np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(hits), pa.string()), pa.array(hits), pa.nulls(len(hits), pa.int64())], names=["lang", "at", "n"])
        for lang, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(found[at].astype(np.int64))], names=["lang", "at", "n"])

    return texts.select("lang", _plain(F.col("text"))).mapInArrow(run, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))


def profiles(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages in Latin script and the log share of each of 2 ** PROFILE hashed trigrams in each; a row for a language and hash reaches the driver."""
    rows = counts.where("lang is not null").toArrow()
    langs = np.array(rows.column("lang").to_pylist(), object)
    listed = sorted(set(langs))
    found = np.ones((len(listed), 1 << PROFILE))
    where = {lang: i for i, lang in enumerate(listed)}
    if listed:
        found[[where[x] for x in langs], rows.column("at").to_numpy()] += rows.column("n").to_numpy()
    return listed, np.log(found / found.sum(axis=1, keepdims=True)).astype(np.float32)


def alien_share(rows: DataFrame, keys: list[str], sources_and_references: DataFrame) -> DataFrame:
    """keys, spoken, alien of each row (keys, plain, spoken): the share of its runs that occur in no source and no reference, and
    its language: a text in Latin script is of the language whose profile makes its trigrams most probable."""
    kinds = dict(rows.dtypes)
    shape = ", ".join(f"{c} {kinds[c]}" for c in keys)
    row = F.xxhash64(*keys).alias("row")  # stands for the keys where there are many rows of them

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_runs(t or "", s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.concatenate([np.array([], np.int64), *found]))], names=["row", "at"])

    runs = cut(rows.select(row, "plain", "spoken").mapInArrow(exploded, "row long, at long"))
    # at most 2 ** WANTED_BITS bits, as words of 64
    words = runs.select(F.expr(f"at & {(1 << WANTED_BITS) - 1}L").alias("low")).groupBy(F.expr("low >> 6").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(low & 63 as int))")).alias("bits")).toArrow()
    wanted = np.zeros((1 << WANTED_BITS) // 64, np.int64)
    wanted[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    counts = cut(counted(sources_and_references, wanted))
    langs, weights = profiles(counts)
    known = counts.where("lang is null").select("at", F.lit(1).alias("known"))
    share = runs.join(known, "at", "left").groupBy("row").agg((1 - F.count("known") / F.count("*")).alias("alien"))
    profile = rows.sparkSession.sparkContext.broadcast(weights)

    def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.column(len(keys) + 1).to_pylist()
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                if out[i] == "latin" and langs:
                    h = _grams(np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32), 3, PROFILE)
                    out[i] = langs[int(profile.value[:, h].sum(axis=1).argmax())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(out, pa.string())], names=[*keys, "spoken"])

    told = rows.select(*keys, "plain", "spoken").mapInArrow(spoken, f"{shape}, spoken string").dropDuplicates(keys)
    return told.withColumn("row", row).join(share, "row", "left").select(*keys, "spoken", F.coalesce("alien", F.lit(0.0)).alias("alien"))


def templates(odd: DataFrame, hashes: int = 16, rows_: int = 2, similarity: float = 0.5) -> DataFrame:
    """Keys of the odd answers (sample_id, experiment_group, source_text, plain) whose opening or part of it recurs.

    The parts of an opening (between marks) are sets of character trigrams.  Every part is a
    template of its own, to which all parts belong that share a MinHash band with it and are
    similar enough; a band's parts are compared in blocks of BAND, so that no task holds a band.
    A template of PROMPTS different sources marks its answers.
    """
    parts = odd.select(
        "sample_id", "experiment_group", F.xxhash64("source_text").alias("prompt"),
        F.explode(F.array_distinct(F.filter(F.transform(F.slice(F.split(F.lower("opening"), r"[\p{P}]+"), 1, PARTS), lambda p: F.trim(p)), lambda p: F.length(p) >= 4))).alias("part"),
    )
    shingled = parts.select("part").distinct().withColumn("set", F.expr("array_distinct(transform(sequence(1, greatest(length(part) - 2, 1)), i -> substring(part, i, 3)))"))
    # (a second parameter of the function would be the place in the set, not the seed)
    minima = F.array(*[F.array_min(F.transform("set", lambda g: F.xxhash64(g, F.lit(seed)))) for seed in range(hashes)])
    # used several times below, as are the pairs: a plan that held each use would be too large for the driver
    shingled = cut(shingled.withColumn("minima", minima))
    banded = shingled.select(
        "part", "set", F.explode(F.array(*[F.xxhash64(F.lit(b), F.slice("minima", b * rows_ + 1, rows_)) for b in range(hashes // rows_)])).alias("band")
    )
    blocks = banded.groupBy("band").agg(F.ceil(F.count("*") / BAND).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = F.pmod(F.xxhash64("part"), F.col("blocks")).cast("int")
    # of two blocks each holds its parts once: those of the lower on the left, those of the higher on the right
    laid = banded.join(blocks, "band").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    laid = laid.select("band", "part", "set", F.col("own"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    left = laid.where("own = low").select("band", "low", "high", "part", "set")
    right = laid.where("own = high").select("band", "low", "high", F.col("part").alias("template"), F.col("set").alias("first"))
    common = F.size(F.array_intersect("set", "first"))
    close = (F.least(F.size("set"), F.size("first")) >= similarity * F.greatest(F.size("set"), F.size("first"))) & (common / (F.size("set") + F.size("first") - common) >= similarity)
    same = cut(left.join(right, ["band", "low", "high"]).where("low < high or part < template").where(close).select("part", "template").distinct())
    itself = shingled.select("part", F.col("part").alias("template"))
    member = cut(itself.union(same).union(same.select(F.col("template").alias("part"), F.col("part").alias("template"))))
    recurring = parts.join(member, "part").groupBy("template").agg(F.count_distinct("prompt").alias("prompts")).where(F.col("prompts") >= PROMPTS)
    return parts.join(member.join(recurring, "template", "left_semi").select("part").distinct(), "part", "left_semi").select("sample_id", "experiment_group").distinct()


def labelled(answers: DataFrame, sources_and_references: DataFrame) -> DataFrame:
    """document_id, sample_id, experiment_group, defect (null where there is none but a cut), and what truncation.states() says of every answer.

    sources_and_references: lang, text.
    """
    keys = ["sample_id", "experiment_group"]
    ends = truncation.states(
        answers.select("document_id", *keys, "source_lang", "segment_type", "source_text", "ref_text", F.lit("zh").alias("lang"), F.col("hypothesis").alias("text"), F.col("segment_type").alias("kind"))
    )
    rows = (
        ends.withColumn("left", bare(F.col("tidied")))
        .withColumn("spoken", script(F.col("left")))
    )
    table_line = F.coalesce(F.col("segment_type") == "table", F.lit(False))
    other = F.coalesce(F.col("spoken") != "zh", F.lit(True))
    first = F.when(nothing(F.col("left")), "empty").when(
        ~table_line & other & _copied(F.when(other, F.col("source_text")), F.when(other, F.col("left"))), "copy"
    )
    # no answer in another script can be like a reference
    unlike = unlike_reference(F.when(~other, F.col("left")), F.when(~other, F.col("ref_text")))
    compared = rows.withColumn("first", first).withColumn("unlike", unlike).withColumn("fingerprint", F.xxhash64("text"))
    # what has little of its own reference is looked for in all sources and references
    plain = F.lower(F.regexp_replace("left", r"[^\p{L}\p{M}]+", " "))
    odd = F.when(F.col("first").isNull() & (F.col("unlike") >= UNLIKE), F.struct("source_text", F.substring("left", 1, OPENING).alias("opening"), plain.alias("plain")))
    scored = cut(compared.withColumn("odd", odd).drop("source_text", "ref_text", "left", "text", "kind", "lang", "tidied", "unlike"))
    asked = scored.where("odd is not null").select(*keys, "spoken", "odd.*").dropDuplicates(keys)
    told = cut(alien_share(asked, keys, sources_and_references))
    refused = templates(asked.drop("spoken").join(told.where(F.col("alien") >= ALIEN).select(*keys), keys, "left_semi")).withColumn("refused", F.lit(True))
    spoken = F.coalesce("told", F.col("spoken"))
    foreign = spoken.isNotNull() & (spoken != "zh")
    joined = scored.drop("odd").join(told.select(*keys, F.col("spoken").alias("told")).join(refused, keys, "left"), keys, "left")
    return joined.withColumn(
        "defect",
        F.coalesce("first", F.when(F.col("refused"), "refusal"), F.when(~table_line & foreign & (spoken != F.col("source_lang")), "wrong_language")),
    ).drop("first", "refused", "spoken", "told", "source_lang", "segment_type")


def found(answers: DataFrame, sources_and_references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sample_id, experiment_group, defect) of every defective answer, and the keys and routes of the truncated ones."""
    keys = ["sample_id", "experiment_group"]
    decided = cut(labelled(answers, sources_and_references))
    sound = decided.where("defect is null").withColumn("lang", F.lit("zh"))
    corpus = answers.select(F.lit("zh").alias("lang"), F.col("hypothesis").alias("text"), F.col("segment_type").alias("kind"))
    cut_answers = truncation.cut_off(sound, corpus, keys, ["document_id", "experiment_group"], ["document_id"])
    defects = decided.where("defect is not null").select(*keys, "defect").distinct()
    return defects.union(cut_answers.select(*keys, F.lit("truncated"))), cut_answers
