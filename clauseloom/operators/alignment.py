"""Alignment of the clauses of a source with those of its reference, of labelled units, and of sentences by length."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import sections as S
from clauseloom.functions import split
from clauseloom.operators import cascade
from clauseloom.session import cut

# Limits of titles, gates and tolerances, and the costs of alignment by length.
TITLE_CHARS, TITLE_SHARE = 100, 0.3
GATE, KEYS, COVERAGE, ORDER_GATE, TOLERANCE = (0.75, 1.35), 10, 0.90, (0.8, 1.25), 0.04
MOVES = {(1, 1): 0.89, (1, 0): 0.01, (0, 1): 0.01, (1, 2): 0.045, (2, 1): 0.045, (2, 2): 0.01}
VARIANCE = 6.8


def keyed(segments: DataFrame) -> DataFrame:
    """segments (doc, ord, scope, section_no, text, kind) with bare and scoped keys and flags: title (a short repeat of its key's
    text), stub (a reference to a paragraph's part) and contents (a heading with a space where the same key has one without)."""
    scope = S.stripped(F.col("scope"))
    rows = segments.withColumn("bare", F.coalesce(S.section_key(F.col("section_no")), F.lit(""))).withColumn("n", F.length("text"))
    rows = cut(rows.withColumn("scoped", F.when((scope != "") & (F.col("bare") != ""), F.concat(scope, F.lit("::"), "bare")).otherwise(F.col("bare"))))
    spaced, paragraph = F.col("text").rlike(r"^§\s+[0-9]+[a-z]?\s"), F.startswith(F.col("section_no"), F.lit("§"))
    # flags of a key, by aggregation: a hot key's rows aren't gathered
    per = rows.where("scoped <> ''").groupBy("doc", "scoped").agg(F.count("*").alias("k"), F.max("n").alias("most"), F.max((paragraph & ~spaced).cast("int")).alias("tight"))
    joined = rows.join(per, ["doc", "scoped"], "left")
    limit = F.greatest(F.lit(float(TITLE_CHARS)), TITLE_SHARE * F.col("most"))
    return joined.select(
        *segments.columns, "bare", "scoped",
        F.coalesce((F.col("k") > 1) & (F.col("most") >= limit) & (F.col("n") < limit), F.lit(False)).alias("title"),
        F.coalesce(paragraph & F.col("text").rlike(r"^§\s*[0-9]+[a-z]?\s*\("), F.lit(False)).alias("stub"),
        F.coalesce((F.col("k") > 1) & paragraph & spaced & (F.col("tight") == 1), F.lit(False)).alias("contents"),
    )


def _counts(rows: DataFrame, key: str, dropped: Column) -> DataFrame:
    return rows.where(~dropped & (F.col(key) != "")).groupBy("doc", F.col(key).alias("key")).agg(F.count("*").alias("n"))


def aligned(sources: DataFrame, refs: DataFrame, least: int = 30) -> DataFrame:
    """doc, source_ord, ref_ord, method, confidence, use_for_da of the clauses (doc, ord, scope, section_no, text, kind) of sources and references.

    A document uses keys with their scope where these pair at least as many unique ones as bare keys do.  In documents whose sides
    are even enough, keys unique on both sides align exactly if the pair is sane; the k-th of repeated keys goes with the k-th
    reference as ambiguous.  What is left aligns by order, nearest first free reference within a tolerance: a greedy choice over the
    rest of a document, made for one document at a time on (place, length, flag) alone.
    """
    a, b = cut(keyed(sources)), cut(keyed(refs))
    uses = None
    for key in ("scoped", "bare"):
        once = [_counts(x, key, F.col("title")).where("n = 1") for x in (a, b)]
        n = once[0].join(once[1].select("doc", "key"), ["doc", "key"]).groupBy("doc").agg(F.count("*").alias(key))
        uses = n if uses is None else uses.join(n, "doc", "full")
    uses = uses.select("doc", (F.coalesce("scoped", F.lit(0)) >= F.coalesce("bare", F.lit(0))).alias("use_scope"))
    pick = lambda x: x.join(uses, "doc", "left").withColumn("key", F.when(F.coalesce("use_scope", F.lit(True)), F.col("scoped")).otherwise(F.col("bare")))
    a, b = cut(pick(a)), cut(pick(b))
    out_a, out_b = F.col("title") | F.col("stub"), F.col("title") | F.col("stub") | F.col("contents")
    known = b.where(~F.col("title") & (F.col("key") != "")).select("doc", "key").distinct().withColumn("known", F.lit(1))
    covered = a.where(~F.col("title") & (F.col("key") != "")).join(known, ["doc", "key"], "left").groupBy("doc").agg(F.count("*").alias("keys"), F.count("known").alias("hit"))
    sizes = a.groupBy("doc").agg(F.count("*").alias("na")).join(b.groupBy("doc").agg(F.count("*").alias("nb")), "doc").join(covered, "doc", "left")
    ratio = F.col("na") / F.col("nb")
    gates = sizes.select("doc", "na", "nb", (ratio.between(*GATE) | F.coalesce((F.col("keys") >= KEYS) & (F.col("hit") / F.col("keys") >= COVERAGE), F.lit(False))).alias("exact"), ratio.between(*ORDER_GATE).alias("ordered"))
    order = Window.partitionBy("doc", "key").orderBy("ord")
    counted = lambda x, dropped: x.where(~dropped & (F.col("key") != "")).withColumn("rank", F.row_number().over(order))
    ka, kb = _counts(a, "key", out_a), _counts(b, "key", out_b)
    x = counted(a, out_a).join(ka.withColumnRenamed("n", "ca"), ["doc", "key"]).join(kb.withColumnRenamed("n", "cb"), ["doc", "key"]).join(gates.where("exact").select("doc"), "doc")
    y = counted(b, out_b).select("doc", "key", "rank", F.col("ord").alias("ref_ord"), F.col("text").alias("ref_text"))
    pairs = x.join(y, ["doc", "key", "rank"])
    unique = (F.col("ca") == 1) & (F.col("cb") == 1)
    sane = cascade.alignment_sane(F.col("text"), F.col("ref_text"), F.col("kind"), F.col("section_no"), least)
    by_key = pairs.withColumn("sane", sane).select("doc", "ord", "ref_ord", "ca", "cb", "sane")
    by_key = cut(by_key).where(~unique | F.col("sane")).select(
        "doc", F.col("ord").alias("source_ord"), "ref_ord", F.when(unique, "exact_section_scoped").otherwise("scoped_ambiguous").alias("method"),
        F.when(unique, "high").otherwise("needs_review").alias("confidence"), unique.alias("use_for_da"),
    )
    return by_key.union(_by_order(a, b, by_key, gates, least))


def _by_order(a: DataFrame, b: DataFrame, taken: DataFrame, gates: DataFrame, least: int) -> DataFrame:
    at = lambda x: x.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("ord")) - 1)
    open_docs = gates.where("ordered").select("doc", "na", "nb")
    left = at(a.select("doc", "ord", "text", "kind", "section_no")).join(open_docs, "doc").join(taken.select("doc", F.col("source_ord").alias("ord")), ["doc", "ord"], "left_anti")
    right = at(b.select("doc", "ord", "text", "kind", "section_no")).join(open_docs.select("doc"), "doc").join(taken.select("doc", F.col("ref_ord").alias("ord")), ["doc", "ord"], "left_anti")
    # what sanity asks of either side for itself, so that the walk needs lengths and flags only
    chinese = F.regexp_count("text", F.lit("[㐀-䶿一-鿿]"))
    fit = (chinese >= 2) & (chinese / F.greatest(F.length("text"), F.lit(1)) >= 0.08) & cascade.keep_segment(F.col("text"), F.col("kind"), F.col("section_no"), 8)
    s = left.groupBy("doc", "na", "nb").agg(F.sort_array(F.collect_list(F.struct("place", "ord", F.length("text").alias("n"), cascade.keep_segment(F.col("text"), F.col("kind"), F.col("section_no"), least).alias("ok")))).alias("s"))
    r = right.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("place", "ord", F.length("text").alias("n"), F.coalesce(fit, F.lit(False)).alias("ok")))).alias("r"))
    kind = dict(a.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, na, nb, s, r in zip(*(batch.column(i).to_pylist() for i in range(5))):
                for i, j in walk(s, r, na, nb):
                    out.append((doc, s[i]["ord"], r[j]["ord"]))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.schema.field(0).type, batch.schema.field(3).type.value_type.field(1).type, batch.schema.field(4).type.value_type.field(1).type))], names=["doc", "source_ord", "ref_ord"])

    found = s.join(r, "doc").mapInArrow(run, f"doc {kind['doc']}, source_ord {kind['ord']}, ref_ord {dict(b.dtypes)['ord']}")
    return found.select("doc", "source_ord", "ref_ord", F.lit("order_based"), F.lit("medium"), F.lit(True))


def walk(sources: list[dict], refs: list[dict], na: int, nb: int) -> list[tuple[int, int]]:
    """The nearest free reference of each source in turn, if it is near enough and the pair is sane; places tell the order of all clauses of a side.

    The free references are a chain, so that the nearest is found by walking over those taken since.
    """
    from bisect import bisect_left

    places = [r["place"] for r in refs]
    ahead, behind = list(range(len(refs) + 1)), list(range(len(refs) + 1))

    def free(chain: list[int], at: int) -> int:
        while chain[at] != at:
            chain[at] = chain[chain[at]]
            at = chain[at]
        return at

    out = []
    for i, s in enumerate(sources):
        expected = round(s["place"] * (nb - 1) / max(na - 1, 1))
        at = bisect_left(places, expected)
        up, down = free(ahead, at), free(behind, at) - 1  # behind[k] stands for reference k - 1
        best = min([j for j in (down, up) if 0 <= j < len(refs)], key=lambda j: (abs(places[j] - expected), j), default=None)
        if best is None or abs(places[best] - expected) > max(2, int(TOLERANCE * nb)):
            continue
        ratio = refs[best]["n"] / max(s["n"], 1)
        if not (s["ok"] and refs[best]["ok"] and 0.08 <= ratio <= 6.5):
            continue
        out.append((i, best))
        ahead[best], behind[best + 1] = best + 1, best
    return out


def labelled(rows: DataFrame, id_col: str, texts: tuple[str, str, str]) -> DataFrame:
    """id, label, number and a column for each of three texts: the units of one label, the k-th with the k-th, as far as all three have one."""
    out = None
    for name in texts:
        units = rows.select(id_col, F.posexplode(split.labelled_units(F.col(name))).alias("at", "u")).select(id_col, "u.label", "at", F.col("u.body").alias(name))
        ranked = units.withColumn("number", F.row_number().over(Window.partitionBy(id_col, "label").orderBy("at"))).drop("at")
        out = ranked if out is None else out.join(ranked, [id_col, "label", "number"])
    return out


def zipped(rows: DataFrame, id_col: str, texts: tuple[str, str, str]) -> DataFrame:
    """parent, id (parent#sNN), number and three sentences where all three texts have equally many sentences."""
    counted = rows.select(F.col(id_col).alias("parent"), *[split.sentences_auto(F.col(t)).alias(t) for t in texts])
    even = counted.where((F.size(texts[0]) > 0) & (F.size(texts[0]) == F.size(texts[1])) & (F.size(texts[1]) == F.size(texts[2])))
    each = even.select("parent", F.posexplode(F.arrays_zip(*texts)).alias("number", "x"))
    return each.select("parent", F.format_string("%s#s%02d", "parent", F.col("number") + 1).alias("id"), "number", *[F.col(f"x.{t}").alias(t) for t in texts])


def by_length(a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]]:
    """Blocks of sentences (numbers of either side) of least cost, in order, given their lengths.

    The cost of a block is how far its lengths, b's scaled to a's by the ratio of the totals, lie apart, less the log prior of its shape.
    """
    scale = sum(b) / sum(a) if sum(a) and sum(b) else 1.0
    at_a, at_b = [0], [0]
    for n in a:
        at_a.append(at_a[-1] + n)
    for n in b:
        at_b.append(at_b[-1] + n)
    best: dict[tuple[int, int], tuple[float, tuple[int, int] | None]] = {(0, 0): (0.0, None)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if (i, j) not in best:
                continue
            for (di, dj), prior in MOVES.items():
                if i + di > len(a) or j + dj > len(b):
                    continue
                x, y = at_a[i + di] - at_a[i], (at_b[j + dj] - at_b[j]) / scale
                apart = abs(x - y) / math.sqrt(VARIANCE * ((x + y) / 2 or 1)) if x or y else 0.0
                cost = best[i, j][0] + (apart - math.log(prior) if x or y else 0.0)
                if cost < best.get((i + di, j + dj), (math.inf,))[0]:
                    best[i + di, j + dj] = (cost, (i, j))
    blocks, at = [], (len(a), len(b))
    while best.get(at, (0, None))[1] is not None:
        before = best[at][1]
        blocks.append((list(range(before[0], at[0])), list(range(before[1], at[1]))))
        at = before
    return blocks[::-1]


def three_way(source: list[str], ref: list[str], answer: list[str]) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges (from, to) of source, reference and answer sentences that belong together: cut wherever either alignment by length cuts the source.

    A range without a block wholly inside it on both sides is left out."""
    first, second = (by_length([len(x) for x in source], [len(x) for x in side]) for side in (ref, answer))
    cuts = sorted({block[0][-1] + 1 for block in (*first, *second) if block[0]} | {len(source)})

    def within(blocks: list, low: int, high: int) -> tuple[int, int] | None:
        held = [x for s, x in blocks if s and x and s[0] >= low and s[-1] < high]
        return (min(x[0] for x in held), max(x[-1] for x in held) + 1) if held else None

    out, low = [], 0
    for high in cuts:
        r, h = within(first, low, high), within(second, low, high)
        if low < high and r and h:
            out.append((low, high, *r, *h))
        low = high
    return out


def sentence_blocks(rows: DataFrame, keys: list[str], texts: tuple[str, str, str]) -> DataFrame:
    """keys, block, source_from, source_to, ref_from, ref_to, answer_from, answer_to: sentences of three texts aligned many to many; each row is walked for itself."""
    split_rows = rows.select(*keys, *[split.sentences_auto(F.col(t)).alias(f"_{i}") for i, t in enumerate(texts)])
    names = ["source_from", "source_to", "ref_from", "ref_to", "answer_from", "answer_to"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, blocks, out = [], [], []
            for i, sides in enumerate(zip(*(batch.column(len(keys) + k).to_pylist() for k in range(3)))):
                if all(sides):
                    for number, block in enumerate(three_way(*sides)):
                        index.append(i)
                        blocks.append(number)
                        out.append(block)
            at = pa.array(index, pa.int64())
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(len(keys))], pa.array(blocks, pa.int32()), *[pa.array(c, pa.int32()) for c in cols]], names=[*keys, "block", *names])

    return split_rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", block int, " + ", ".join(f"{n} int" for n in names))
