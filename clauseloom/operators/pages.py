"""From page lines to segments: page lines taken out, headings carried, lines joined to clauses; lines of right-to-left pages put in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import sections as S
from clauseloom.functions import split
from clauseloom.functions import text as T
from clauseloom.operators import cascade, stats
from clauseloom.session import cut


def lines_of(pages: DataFrame) -> DataFrame:
    """doc, lang, page, at, line (cleaned) of pages (doc, lang, page, text)."""
    each = pages.select("doc", "lang", "page", F.posexplode(F.split("text", "\r?\n")).alias("at", "raw"))
    return each.select("doc", "lang", "page", "at", T.clean(F.col("raw")).alias("line"))


def kept_lines(lines: DataFrame) -> DataFrame:
    """The lines that belong to no page: not noise, not repeated on the document's pages (as they are, with figures masked, or as the larger part of a line)."""
    repeated = cut(cascade.repeated_lines(lines))
    text = cut(lines.where(~cascade.noise_line(F.col("line"))))
    exact, masked = (repeated.where(F.col("masked") == m).select("doc", "line") for m in (False, True))
    plain = text.join(exact, ["doc", "line"], "left_anti").withColumn("mask", T.digits_masked(F.col("line")))
    plain = plain.join(masked.withColumnRenamed("line", "mask"), ["doc", "mask"], "left_anti").drop("mask")
    # a repeated line within a longer one: they meet by the repeated line's first word
    word = lambda c: F.regexp_extract(c, r"[\p{L}\p{N}]+", 0)
    listed = exact.select("doc", F.col("line").alias("part"), word(F.col("line")).alias("word")).where("word <> ''")
    words = plain.select("doc", "page", "at", "line", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word"))
    holding = words.join(listed, ["doc", "word"]).where(F.contains("line", "part") & (F.length("part") >= 0.6 * F.length("line"))).select("doc", "page", "at").distinct()
    return plain.join(holding, ["doc", "page", "at"], "left_anti")


def scoped_lines(lines: DataFrame) -> DataFrame:
    """lines with number (their place in the document), section and scope: the last heading of an annex above, until a § begins.

    A document whose headings fall back too often has none that can be trusted."""
    page = Window.partitionBy("doc", "page").orderBy("at")
    numbered = lines.withColumn("number", (F.col("page") * 100_000 + F.col("at")).cast("long"))
    seen = numbered.withColumn("index", F.row_number().over(page) - 1).withColumn("following", F.lead("line").over(page)).withColumn("section", S.section_no(F.col("line")))
    headed = cut(seen.withColumn("heading", S.scope_heading(F.col("line"), F.col("lang"), F.col("index"), F.coalesce("following", F.lit("")))).drop("index", "following"))
    trusted = reliable(headed.where("heading is not null").select("doc", "number", "heading"))
    joined = headed.join(trusted.where(~F.col("reliable")).select("doc", F.lit(True).alias("odd")), "doc", "left").withColumn("heading", F.when(F.col("odd").isNull(), F.col("heading"))).drop("odd")
    return stats.carried(joined, "doc", ["number"], F.col("heading"), F.coalesce(F.startswith(F.col("section"), F.lit("§")), F.lit(False))).withColumn("scope", F.coalesce("carried", F.lit(""))).drop("carried", "heading")


def reliable(headings: DataFrame) -> DataFrame:
    """doc, hits, descents, reliable: whether a document's annex headings (doc, number, heading) mostly ascend."""
    n = F.regexp_extract("heading", "[0-9]+", 0).cast("int")
    steps = headings.select("doc", "number", n.alias("n")).withColumn("before", F.lag("n").over(Window.partitionBy("doc").orderBy("number")))
    per = steps.groupBy("doc").agg(F.count("*").alias("hits"), F.count_if(F.col("n") < F.col("before")).alias("descents"))
    return per.withColumn("reliable", (F.col("hits") < S.SCOPE_HITS) | (F.col("descents") / (F.col("hits") - 1) <= S.SCOPE_DESCENTS))


def segments(lines: DataFrame, most: int = cascade.MOST_CHARS, least: int = cascade.LEAST_SOURCE) -> DataFrame:
    """doc, lang, page, ord, scope, section_no, kind, text of the clauses of scoped lines.

    A line with a clause number begins a clause, but for plain figures within a § paragraph; so does a title, table or note behind
    a finished line, and a line that would make the clause too long.  The walk keeps the open clause's length and kind, so it takes
    a document's lines in turn; where a line must begin a clause in any case the documents are cut into parts that are walked for
    themselves.
    """
    number = F.coalesce(F.col("section"), F.lit(""))
    hard = (number != "") & (~number.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){0,6}$") | F.startswith(number, F.lit("§")))
    marked = lines.withColumn("kind", T.segment_type(F.col("line"), number != "")).withColumn("ended", T.sentence_end(F.col("line"))).withColumn("start", F.when(hard, F.col("number")))
    parts = stats.carried(marked.withColumn("start", F.col("start").cast("string")), "doc", ["number"], F.col("start")).withColumn("part", F.coalesce("carried", F.lit("")))
    listed = parts.groupBy("doc", "lang", "part").agg(F.sort_array(F.collect_list(F.struct("number", "page", "line", "section", "scope", "kind", "ended"))).alias("lines"))
    kind = dict(lines.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, lang, rows in zip(*(batch.column(i).to_pylist() for i in range(3))):
                out += [(doc, lang, *clause) for clause in joined_lines(rows, most)]
            cols = list(zip(*out)) if out else [()] * 6
            types = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc", "lang", "number", "page", "scope", "text"])

    walked = listed.select("doc", "lang", "lines").mapInArrow(run, f"doc {kind['doc']}, lang string, number long, page long, scope string, text string")
    pieces = walked.withColumn("whole", S.section_no(F.col("text"))).select("doc", "lang", "number", "page", "scope", "whole", F.posexplode(split.long_text(T.clean(F.col("text")), most)).alias("i", "text"))
    typed = pieces.withColumn("section_no", F.coalesce(S.section_no(F.col("text")), "whole"))
    typed = typed.withColumn("kind", T.segment_type(F.col("text"), F.col("section_no").isNotNull()))
    good = typed.where(cascade.keep_segment(F.col("text"), F.col("kind"), F.col("section_no"), least))
    return good.withColumn("ord", F.row_number().over(Window.partitionBy("doc").orderBy("number", "i"))).select("doc", "lang", "page", "ord", "scope", "section_no", "kind", "text")


def joined_lines(rows: list[dict], most: int) -> list[tuple]:
    """(number, page, scope, text) of the clauses that consecutive lines make."""
    out, held, paragraph = [], [], False

    def close() -> None:
        if held:
            out.append((held[0]["number"], held[0]["page"], held[-1]["scope"], " ".join(x["line"] for x in held)))
            held.clear()

    for row in rows:
        section = row["section"] or ""
        if section.startswith("§"):
            close()
            paragraph = True
        elif section and paragraph and section.replace(".", "").isdigit():
            pass  # an item within the paragraph
        elif section:
            close()
            paragraph = False
        elif held and row["kind"] in ("title", "table", "note") and row["kind"] != held[0]["kind"] and held[-1]["ended"]:
            close()
        elif held and sum(len(x["line"]) + 1 for x in held) + len(row["line"]) > most:
            close()
        held.append(row)
    close()
    return out


def rtl_lines(words: DataFrame) -> DataFrame:
    """page, top, line: the lines of pages from placed words (page, top, x0, text).

    Words whose tops lie within 3 of a line's first make a line.  Where more than two fifths of a line's characters are Arabic, its
    runs of Arabic and other words stand in reverse order, and the words of Arabic runs as well."""
    share = lambda c: F.regexp_count(c, F.lit(r"[\x{0600}-\x{06ff}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]")) / F.greatest(F.length(c), F.lit(1))
    by_page = F.sort_array(F.collect_list(F.struct("top", "x0", "text", (share(F.col("text")) > 0.3).alias("rtl"))))
    start = F.struct(F.array().cast("array<struct<first:double,words:array<struct<x0:double,text:string,rtl:boolean>>>>").alias("lines"))

    def step(s: Column, w: Column) -> Column:
        word = F.struct(w.x0.alias("x0"), w.text.alias("text"), w.rtl.alias("rtl"))
        last = F.try_element_at(s.lines, F.lit(-1))
        joins = F.coalesce(F.abs(last.first - w.top) <= 3, F.lit(False))
        grown = F.concat(F.slice(s.lines, F.lit(1), F.greatest(F.size(s.lines) - 1, F.lit(0))), F.array(F.struct(last.first.alias("first"), F.array_append(last.words, word).alias("words"))))
        return F.struct(F.when(joins, grown).otherwise(F.array_append(s.lines, F.struct(w.top.alias("first"), F.array(word).alias("words")))).alias("lines"))

    typed = words.select("page", F.col("top").cast("double").alias("top"), F.col("x0").cast("double").alias("x0"), "text")
    lines = typed.groupBy("page").agg(by_page.alias("w")).select("page", F.explode(F.aggregate("w", start, step, lambda s: s.lines)).alias("l"))
    ordered = lines.select("page", F.col("l.first").alias("top"), F.sort_array("l.words").alias("words"))
    text = F.array_join(F.transform("words", lambda w: w.text), " ")
    # runs: a word opens one where it is of another direction than the word before
    opened = F.transform("words", lambda w, i: F.when((i > 0) & (F.get("words", i - 1).rtl == w.rtl), F.lit("")).otherwise(F.lit("\x1e")))
    tagged = F.array_join(F.transform("words", lambda w, i: F.concat(F.get(opened, i), F.when(w.rtl, F.lit("\x01")).otherwise(F.lit("\x02")), w.text)), "\x1f")
    runs = F.filter(F.split(tagged, "\x1e"), lambda r: r != "")
    inner = lambda r: F.filter(F.split(r, "\x1f"), lambda w: w != "")
    turned = F.flatten(F.transform(F.reverse(runs), lambda r: F.when(F.startswith(r, F.lit("\x01")), F.reverse(inner(r))).otherwise(inner(r))))
    rtl = F.array_join(F.transform(turned, lambda w: F.substring(w, 2, 1 << 20)), " ")
    return ordered.select("page", "top", F.when(share(F.replace(text, F.lit(" "), F.lit(""))) > 0.4, rtl).otherwise(text).alias("line"))


def page_shares(pages: DataFrame) -> DataFrame:
    """doc, odd, pages, chinese: the mean share of Chinese characters of odd and of even pages."""
    share = T.count(F.col("text"), T.CJK) / F.greatest(F.length("text"), F.lit(1))
    return pages.groupBy("doc", (F.col("page") % 2 == 1).alias("odd")).agg(F.count("*").alias("pages"), F.avg(share).alias("chinese"))


def facing_pairs(clauses: DataFrame) -> DataFrame:
    """doc, source_page, section_no, source_text, ref_text: a page's clause with the first of the same number on the page behind (doc, page, ord, section_no, text)."""
    rows = clauses.where("coalesce(section_no, '') <> ''")
    ahead = rows.groupBy("doc", (F.col("page") - 1).alias("page"), "section_no").agg(F.min_by("text", "ord").alias("ref_text"))
    return rows.join(ahead, ["doc", "page", "section_no"]).select("doc", F.col("page").alias("source_page"), "section_no", F.col("text").alias("source_text"), "ref_text")
