"""Texts that were cut off.

Structure comes first: a stack automaton folds over a text's marks; quotations (straight
ones too), brackets, markup tags or code fences still open at the end are a cut, as are a
broken escape, entity, tag or multibyte sequence there.  A text whose structure closes and
that ends with a terminator, a colon or a semicolon is whole (an abbreviation's stop is no
terminator).

A text without a terminator is judged by the baseline of its source.  Where LIMIT_TEXTS
unterminated texts of a source all have its greatest length, in characters or bytes, that
length is the limit of the field and they are cut.  Of the other texts of the source, the
share without a terminator is its habit (smoothed by the habit of the language): below
HABIT a missing terminator is a cut.  A source that habitually leaves terminators out, as
Thai ones do, says nothing by it; for its texts the corpus is asked as a tie-break: of
every place where the text's last characters occur (names and digits masked), how often
does a sentence end there?  Longer suffixes correct the share of the shorter ones by as
much as they have occurred.  The suffixes are counted over all texts in one pass.

Defined cases: null and blank texts, titles, list items and table lines are no case;
repeated rows count once in the result and as often as they occur in the counts; a text
without a source belongs to the source of all such texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm import sentences
from clauseloom.llm.chars import CLEAN, INVISIBLE, RARE, WHITE
from clauseloom.session import cut

#: Suffix lengths by script, the longest first; the places that a shorter suffix's share weighs; the share that makes an end.
LENGTHS = {"zh": (11, 9, 7, 5, 3), "": (32, 25, 18, 12, 8, 5)}
PRIOR = 4.0
SHARE = 0.12
#: Texts of the greatest length that make it a limit; the habit from which a missing terminator says nothing; the texts that the language's habit weighs.
LIMIT_TEXTS, HABIT, WEIGHT = 3, 0.25, 4.0
MAP_BITS = 20
# Pairs of marks, and elements of markup that are never closed.
PAIRS = {"“": "”", "„": "“", "«": "»", "（": "）", "(": ")", "「": "」", "『": "』", "【": "】", "[": "]", "《": "》"}
VOID = ("br", "hr", "img", "input", "meta", "link", "wbr", "col")
CLOSERS = "”’“\"'»)）」』】\\]》"
#: A name with digits, such as an approval number.
NAME = r"[A-Za-z]+[-/]?[0-9][A-Za-z0-9]*(?:[./\-][A-Za-z0-9]+)*"
TAG = r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>"
MARK = "```|" + TAG + "|[" + "".join("\\" + c for c in dict.fromkeys("".join(k + v for k, v in PAIRS.items()))) + '"]'
BROKEN = r"(?=[�\\&<.…])(?:�|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|&#?\w{0,7}|<(?:[A-Za-z/!?][^<>]*)?|\.\.\.|…)$"


def open_marks(text: Column) -> Column:
    """The stack automaton: the closing marks still awaited where the text ends."""
    awaited = F.create_map(*[F.lit(x) for pair in PAIRS.items() for x in pair])
    toggles = ('"', "```")

    def until(stack: Column, mark: Column) -> Column:
        # everything opened within what is closed here is given up with it
        return F.slice(stack, F.lit(1), F.size(stack) - F.array_position(F.reverse(stack), mark).cast("int"))

    def step(stack: Column, mark: Column) -> Column:
        name = F.lower(F.regexp_extract(mark, "^<([A-Za-z][A-Za-z0-9]*)", 1))
        push = (
            F.when(mark.isin(*toggles), mark)
            .when((name != "") & ~mark.endswith("/>") & ~name.isin(*VOID), F.concat(F.lit("</"), name, F.lit(">")))
            .otherwise(F.element_at(awaited, mark))
        )
        closing = F.lower(F.regexp_replace(mark, r"\s", ""))
        return F.when(F.array_contains(stack, closing), until(stack, closing)).when(push.isNotNull(), F.array_append(stack, push)).otherwise(stack)

    # a text with none of these never needs the automaton
    some = text.rlike('[“„«（(「『【\\[《"<]|```')
    return F.when(some, F.aggregate(F.regexp_extract_all(text, F.lit(MARK), F.lit(0)), F.array().cast("array<string>"), step)).otherwise(F.array().cast("array<string>"))


def tidy(text: Column) -> Column:
    """Without invisible characters, white space as single spaces, ends stripped."""
    seen = F.regexp_replace(text, f"{RARE}[{INVISIBLE}]+", "")
    # (a single space stays as it is)
    seen = F.regexp_replace(seen, f"{RARE}(?! [^{WHITE}])[{WHITE}]+", " ")
    # most texts are runs of clean characters between single spaces already
    return F.trim(F.when(text.rlike(rf"^(?:[{CLEAN}]++ )*+[{CLEAN}]*+\z"), text).otherwise(seen))


def masked(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, "(?<![A-Za-z])" + NAME, "0"), r"[0-9０-９]+(?:[.,][0-9０-９]+)*", "0"))


def abbreviated(text: Column, lang: Column) -> Column:
    out = F.lit(False)
    for code, words in sentences.ABBREVIATIONS.items():
        if words:
            # an initial or a unit may end a sentence, a longer abbreviation doesn't
            listed = "|".join(w.replace(".", r"\.\s*") for w in words.split() if w not in ("no", "al", "etc"))
            out = F.when(lang == code, text.rlike(rf"(?iu)(?<![\p{{L}}\p{{M}}])(?:{listed})\.$")).otherwise(out)
    return out


def exempt(kind: Column) -> Column:
    return F.coalesce(kind.isin("title", "list", "table"), F.lit(False))


def states(rows: DataFrame) -> DataFrame:
    """rows (.., lang, text, kind) with state (whole, broken, bare or, for what is no case, null), chars, bytes, tidied, and body where it isn't whole."""
    body, last = F.col("tidied"), F.col("_last")
    with_body = rows.withColumn("tidied", tidy(F.col("text"))).withColumn("_last", F.right(F.rtrim("tidied", F.lit(CLOSERS.replace("\\", "") + " *_`~")), F.lit(1)))
    # the words that an abbreviation at the end can have
    words = F.substring_index("tidied", " ", -4)
    stopped = last.isin(*".!?…。！？؟:：;；؛")
    # in Chinese a full stop of other scripts is one but behind a figure
    figure = (last == ".") & (F.col("lang") == "zh") & body.rlike(rf"[0-9]\.[{CLOSERS} *_`~]*$")
    ended = stopped & ~figure & ~((F.right("tidied", F.lit(1)) == ".") & abbreviated(words, F.col("lang")))
    thai = F.coalesce(F.col("lang") == "th", F.lit(False))
    state = (
        F.when(F.coalesce(body == "", F.lit(True)) | exempt(F.col("kind")), None)
        .when(body.rlike(BROKEN) | (F.size(open_marks(body)) > 0), "broken")
        # Thai has no sign for the end; a colon or a semicolon leads in there as well
        .when(ended & (~thai | last.isin(*":：;；")), "whole")
        .otherwise("bare")
    )
    out = with_body.withColumn("state", state)
    return out.withColumn("chars", F.length("text")).withColumn("bytes", F.octet_length("text")).withColumn("body", F.when(F.col("state").isin("broken", "bare"), F.col("tidied"))).drop("_last")


def baselines(seen: DataFrame, source: list[str], habit: list[str]) -> DataFrame:
    """source.., lang, longest, largest (limits, null where there is none), habit.

    seen: source.., lang, state, chars, bytes, fingerprint.  The columns ``habit`` are a part of ``source``.
    """
    bare = F.col("state") == "bare"
    # by length first: a hot source shrinks to its lengths before it is gathered
    counts = cut(
        seen.where("state is not null").groupBy(*source, "lang", "chars", "bytes").agg(
            F.count("*").alias("n"), F.count_if(bare).alias("bare"), F.min(F.when(bare, F.col("fingerprint"))).alias("x"), F.max(F.when(bare, F.col("fingerprint"))).alias("y")
        )
    )
    most = counts.groupBy(*source, "lang").agg(F.max("chars").alias("longest"), F.max("bytes").alias("largest"))
    full = {"chars": F.col("chars") == F.col("longest"), "bytes": F.col("bytes") > F.col("largest") - 4}
    either = full["chars"] | full["bytes"]
    sums = [F.sum(F.when(at, F.col(c))).alias(f"{c}_{unit}") for unit, at in (("all", F.lit(True)), *full.items(), ("either", either)) for c in ("n", "bare")]
    # by chance as many texts would end in the bytes before
    sums.append(F.sum(F.when(F.col("bytes").between(F.col("largest") - 7, F.col("largest") - 4), F.col("n"))).alias("n_before"))
    ends = [f(F.when(full["chars"] if unit == "chars" else F.col("bytes") == F.col("largest"), F.col(c))).alias(f"{c}_{unit}") for unit in full for f, c in ((F.min, "x"), (F.max, "y"))]
    per = _left(counts, most, [*source, "lang"]).groupBy(*source, "lang").agg(F.max("longest").alias("longest"), F.max("largest").alias("largest"), *sums, *ends)
    limited = {unit: F.coalesce((F.col(f"bare_{unit}") >= LIMIT_TEXTS) & (F.col(f"x_{unit}") != F.col(f"y_{unit}")), F.lit(False)) for unit in full}
    limited["bytes"] = limited["bytes"] & (F.col("n_bytes") >= LIMIT_TEXTS * F.coalesce("n_before", F.lit(0)))

    def free(c: str) -> Column:
        """What doesn't lie at a limit."""
        gone = F.when(limited["chars"] & limited["bytes"], F.col(f"{c}_either")).when(limited["chars"], F.col(f"{c}_chars")).when(limited["bytes"], F.col(f"{c}_bytes")).otherwise(0)
        return F.coalesce(f"{c}_all", F.lit(0)) - F.coalesce(gone, F.lit(0))

    per = cut(per.select(*source, "lang", F.when(limited["chars"], F.col("longest")).alias("longest"), F.when(limited["bytes"], F.col("largest")).alias("largest"), free("n").alias("n"), free("bare").alias("bare")))
    by_lang = per.groupBy("lang").agg((F.sum("bare") / F.sum("n")).alias("usual"))  # as many rows as languages
    by_habit = per.groupBy(*habit, "lang").agg(F.sum("n").alias("n"), F.sum("bare").alias("bare"))
    by_habit = _left(by_habit, by_lang, ["lang"], small=True).select(
        *habit, "lang", ((F.coalesce("bare", F.lit(0)) + WEIGHT * F.coalesce("usual", F.lit(0.0))) / (F.coalesce("n", F.lit(0)) + WEIGHT)).alias("habit")
    )
    return _left(per.drop("n", "bare"), by_habit, [*habit, "lang"])


def _left(left: DataFrame, right: DataFrame, keys: list[str], small: bool = False) -> DataFrame:
    """A left join in which nulls equal nulls."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    renamed = F.broadcast(renamed) if small else renamed
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]
    return left.join(renamed, on, "left").drop(*[f"_r_{c}" for c in keys])


def at_limit() -> Column:
    """A cut byte sequence may fall short of the limit by a part of one character."""
    return F.coalesce(F.col("chars") == F.col("longest"), F.lit(False)) | F.coalesce(F.col("bytes") > F.col("largest") - 4, F.lit(False))


def _hashes(codes: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length, the hash of the characters up to and with each place (0 where there are fewer)."""
    base = np.uint64(0x9E3779B97F4A7C15)
    n = len(codes)
    powers = np.full(n + 1, base, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    inverse = np.full(n + 1, pow(int(base), -1, 1 << 64), np.uint64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + base) * np.uint64(0xBF58476D1CE4E5B9) * powers[:n], out=total[1:])
    out = []
    for k in lengths:
        h = np.zeros(n, np.uint64)
        if n >= k:
            x = (total[k:] - total[: n - k + 1]) * inverse[: n - k + 1]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + np.uint64(k)
            h[k - 1 :] = x ^ (x >> np.uint64(29))
        out.append(h)
    return out


def suffixes(asked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lang, level, hash: the suffixes of each asked text, level 0 the longest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, levels, hashes = [], [], []
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            for i, (lang, tail) in enumerate(zip(langs, batch.column(batch.schema.get_field_index("ending")).to_pylist())):
                lengths = LENGTHS.get(lang, LENGTHS[""])
                codes = np.frombuffer(tail.encode("utf-32-le", "surrogatepass"), np.uint32)
                for level, (k, h) in enumerate(zip(lengths, _hashes(codes, lengths) if len(codes) else [])):
                    if len(codes) >= k:
                        index.append(i)
                        levels.append(level)
                        hashes.append(h[-1])
            at = pa.array(index, pa.int64())
            kept = [batch.column(batch.schema.get_field_index(c)).take(at) for c in (*keys, "lang")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(levels, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64))], names=[*keys, "lang", "level", "hash"])

    kinds = dict(asked.dtypes)
    shape = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "lang"))
    return asked.select(*keys, "lang", "ending").mapInArrow(run, f"{shape}, level int, hash long")


def endings(corpus: DataFrame, wanted: np.ndarray) -> DataFrame:
    """hash, total, final of the wanted suffixes over all texts (lang, line): places and sentence ends among them.

    wanted: a bit for each value of the hash's low bits that any suffix asked for has.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(np.packbits(wanted, bitorder="little"))
    stop = sentences.BREAK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        low = np.uint64((1 << MAP_BITS) - 1)
        bits = np.unpackbits(shared.value, bitorder="little").view(bool)
        terminators = np.array(sorted(map(ord, ".!?…。！？؟" + stop)), np.uint32)
        for batch in batches:
            langs, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = []
            for lengths in {LENGTHS.get(x, LENGTHS[""]) for x in langs}:
                text = "\n".join(line for lang, line in zip(langs, lines) if LENGTHS.get(lang, LENGTHS[""]) is lengths or LENGTHS.get(lang, LENGTHS[""]) == lengths) + "\n\n\n\n"
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                after = np.roll(codes, -1)
                # a stop within a name or before a small letter ends nothing
                stops = np.isin(after, terminators)
                nexts = np.roll(codes, -2)
                final = stops & ((after > 0x2100) | np.isin(nexts, np.array([10, 32, *map(ord, CLOSERS)], np.uint32)))
                inner = after != 10
                for k, h in zip(lengths, _hashes(codes, lengths)):
                    use = bits[(h & low).astype(np.int64)] & inner & (h != 0)
                    if use.any():
                        found.append(pd.DataFrame({"hash": h[use].view(np.int64), "final": final[use].astype(np.int64)}))
            if found:
                sums = pd.concat(found).groupby("hash")["final"].agg(["size", "sum"]).reset_index()
                yield pa.RecordBatch.from_arrays([pa.array(sums["hash"]), pa.array(sums["size"].astype(np.int64)), pa.array(sums["sum"].astype(np.int64))], names=["hash", "total", "final"])

    counts = corpus.select("lang", "line").mapInArrow(run, "hash long, total long, final long")
    return counts.groupBy("hash").agg(F.sum("total").alias("total"), F.sum("final").alias("final"))


def suffix_shares(asked: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """keys, share: how often a sentence ends in the corpus (lang, text, kind) where the asked texts (keys, lang, body) end."""
    ends = asked.withColumn("ending", masked(F.rtrim("body", F.lit(CLOSERS.replace("\\", "") + " "))))
    wants = cut(suffixes(ends, keys))
    bits = np.zeros(1 << MAP_BITS, bool)
    # at most 2 ** MAP_BITS integers
    low = wants.select(F.expr(f"hash & {(1 << MAP_BITS) - 1}L").cast("int").alias("low")).distinct().toArrow()
    bits[low.column("low").to_numpy()] = True
    langs = wants.select("lang").distinct()  # as many rows as languages
    text = tidy(F.col("text"))
    ended = F.regexp_replace(F.regexp_replace(sentences.marked(text, F.col("lang")), rf"[{CLOSERS} {sentences.JOIN}]*{sentences.BREAK}", sentences.BREAK), sentences.JOIN, "")
    rows = corpus.where(F.col("text").isNotNull() & ~exempt(F.col("kind"))).join(F.broadcast(langs), "lang", "left_semi")
    counts = endings(rows.select("lang", masked(F.when(F.col("lang") == "th", ended).otherwise(text)).alias("line")), bits)
    # cut, so that the caller's plan doesn't hold this one: the driver keeps a plan's description for every stage that ends
    return cut(
        wants.join(counts, "hash")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("rank"), "total", "final"))).alias("seen"))
        .select(*keys, F.aggregate("seen", F.lit(0.0), lambda p, x: (x.final + PRIOR * p) / (x.total + PRIOR)).alias("share"))
    )


def cut_off(seen: DataFrame, corpus: DataFrame, keys: list[str], source: list[str], habit: list[str]) -> DataFrame:
    """keys, route of the texts that were cut off; route is structure, limit, baseline or suffix.

    seen: rows that states() has looked at (keys, source.., lang, state, chars, bytes, body, fingerprint), kept by the caller;
    corpus: lang, text, kind of all texts.  The source's columns mustn't be called like those of a baseline.
    """
    base = cut(baselines(seen.select(*source, "lang", "state", "chars", "bytes", "fingerprint"), source, habit))
    bare = _left(seen.where("state = 'bare'").select(*dict.fromkeys([*keys, *source, "lang", "chars", "bytes", "body"])), base, [*source, "lang"])
    route = F.when(at_limit(), "limit").when(F.col("habit") < HABIT, "baseline").otherwise("ask")
    judged = cut(bare.withColumn("route", route).select(*keys, "lang", "route", F.when(F.col("route") == "ask", F.col("body")).alias("body")))
    asked = judged.where("route = 'ask'").dropDuplicates(keys)
    shares = suffix_shares(asked.select(*keys, "lang", "body"), corpus, keys)
    unlike = _left(asked.select(*keys), shares, keys).where(F.coalesce("share", F.lit(0.0)) < SHARE)
    return (
        seen.where("state = 'broken'").select(*keys, F.lit("structure").alias("route"))
        .union(judged.where("route <> 'ask'").select(*keys, "route"))
        .union(unlike.select(*keys, F.lit("suffix")))
        .dropDuplicates(keys)
    )
