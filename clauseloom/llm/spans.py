"""Long exact spans shared between documents, by a sparse de Bruijn graph.

Tokens are characters.  Of all k-mers of K tokens the least of every W consecutive
ones (by a hash) is an edge of the graph; as K + W - 1 is the least length asked
for, two documents that share a span of that length share an edge, and each edge
overlaps the next.  Edges of one document only are dropped.  Spark joins give every
edge the number of its successors and predecessors; where an edge has one successor
and that has one predecessor, both lie on one nonbranching path.  Every document
that holds any part of such a path walks all of it, so a path's name is its first
edge and its place in a document is the run of edges between two branchings: paths
are compacted without iterating.  Two documents on one path share at least the
path's text; the source texts on either side (less than K tokens, or another edge
would lie there) then give the exact ends of the shared span.

Equal texts are one document in the graph and are told apart again at the end.

Defined cases: null texts and texts below the length have no span; a passage that
is repeated within one document only is not shared; the ids may have any type.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.session import cut, spread

LEAST = 200
#: Characters hashed at once; bounds a task's memory whatever a text's length.
CHUNK = 1 << 20
#: Walks of a path from which amounts are found without making pairs of them.
HOT = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-mers that are the leftmost least of a window of w k-mers within one text."""
    n = len(codes) - k + 1
    if n < w:
        return np.array([], np.int64), np.array([], np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    powers = np.empty(len(codes), np.uint64)
    powers[0] = 1
    powers[1:] = base
    np.cumprod(powers, out=powers)
    inverse = np.full(n, pow(int(base), -1, 1 << 64), np.uint64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) + base) * powers, out=total[1:])
    hashes = _mix((total[k:] - total[:n]) * inverse)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    span = 1  # least[i] is the least of span k-mers from i on
    while span < w:
        step = min(span, w - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    # the windows that lie within one text: those starting from its start to its end - (k + w - 1)
    last = ends - (k + w - 1)
    fit = last >= starts
    counts = (last - starts + 1)[fit]
    if not counts.sum():
        return np.array([], np.int64), np.array([], np.uint64)
    windows = np.repeat(starts[fit] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    at = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    return at, hashes[at]


def thinned(at: np.ndarray, hashes: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """Which edges to keep: within a periodic run the same edge follows itself, and its first and last place say all."""
    if len(at) < 3:
        return np.ones(len(at), bool)
    same = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1]) & (at[1:] - at[:-1] < k)
    return ~np.concatenate(([False], same[1:] & same[:-1], [False]))


def _edges_of(texts: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, position in it and hash of every edge of some texts."""
    parts: list[tuple[int, int, str]] = []  # text, where the part starts in it, part
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    room = 0

    def flush() -> None:
        nonlocal parts, room
        if not parts:
            return
        codes = np.frombuffer("".join(p for _, _, p in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(p) for _, _, p in parts], np.int64)
        ends = np.cumsum(lengths)
        at, hashes = sampled(codes, ends - lengths, ends, k, w)
        which = np.searchsorted(ends, at, "right")
        shift = np.array([s for _, s, _ in parts], np.int64) - (ends - lengths)
        number = np.array([i for i, _, _ in parts], np.int64)
        out.append((number[which], at + shift[which], hashes))
        parts, room = [], 0

    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text) - (k + w - 2)), CHUNK):
            part = text[start : start + CHUNK + k + w - 2]
            parts.append((i, start, part))
            room += len(part)
            if room >= CHUNK:
                flush()
    flush()
    if not out:
        return np.array([], np.int64), np.array([], np.int64), np.array([], np.uint64)
    number, at, hashes = (np.concatenate(x) for x in zip(*out))
    once = np.ones(len(at), bool)  # a part's last edge may be the next part's first
    once[1:] = (number[1:] != number[:-1]) | (at[1:] != at[:-1])
    number, at, hashes = number[once], at[once], hashes[once]
    kept = thinned(at, hashes, number, k)
    return number[kept], at[kept], hashes[kept]


def edges(texts: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """rep, pos, edge, next, prev: each sampled k-mer with the links to its neighbours in the text (null at an end)."""
    k = least // 2 + 1
    w = least - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1).to_pylist()
            number, at, hashes = _edges_of(column, k, w)
            inner = number[1:] == number[:-1] if len(number) else np.array([], bool)
            gap = (at[1:] - at[:-1]).astype(np.uint64) if len(at) else np.array([], np.uint64)
            link = _mix(hashes[1:] * np.uint64(31) ^ _mix(hashes[:-1] + gap)).view(np.int64) if len(at) else np.array([], np.int64)
            ending, beginning = np.append(inner, False), np.insert(inner, 0, False)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(number)),
                    pa.array(at),
                    pa.array(hashes.view(np.int64)),
                    pa.array(np.append(link, 0) if len(at) else link, mask=~ending if len(at) else None),
                    pa.array(np.insert(link, 0, 0) if len(at) else link, mask=~beginning if len(at) else None),
                ],
                names=["rep", "pos", "edge", "next", "prev"],
            )

    kind = dict(texts.dtypes)[id_col]
    return texts.select(id_col, text_col).mapInArrow(run, f"rep {kind}, pos long, edge long, next long, prev long")


def paths(found: DataFrame, least: int = LEAST) -> DataFrame:
    """path, rep, first, end: where each document walks each nonbranching path of edges of several documents."""
    k = least // 2 + 1
    shared = found.groupBy("edge").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most").select("edge")
    kept = cut(found.join(shared, "edge", "left_semi"))  # from here on, only repeats
    nodes = kept.groupBy("edge").agg(
        ((F.min("next") == F.max("next")) & (F.count("next") == F.count("*"))).alias("one_next"),
        ((F.min("prev") == F.max("prev")) & (F.count("prev") == F.count("*"))).alias("one_prev"),
    )
    by_place = Window.partitionBy("rep").orderBy("pos")
    follows = (F.lag("next").over(by_place) == F.col("prev")) & F.lag("one_next").over(by_place) & F.col("one_prev")
    runs = kept.join(nodes, "edge").withColumn("starts", ~F.coalesce(follows, F.lit(False))).withColumn(
        "path", F.last(F.when(F.col("starts"), F.col("edge")), ignorenulls=True).over(by_place)
    ).withColumn("run", F.sum(F.col("starts").cast("int")).over(by_place))
    return runs.groupBy("rep", "run", "path").agg(F.min("pos").alias("first"), (F.max("pos") + k).alias("end")).drop("run")


def _common(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def walked(documents: DataFrame, id_col: str, text_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(around, members): rep, path, first, end of each walk of a text along a path of the graph, with the texts before and after
    that may still be shared; and the rep of each document long enough to share."""
    k = least // 2 + 1
    long = spread(documents.select(id_col, text_col), id_col).where(F.length(text_col) >= least)
    members = long.select(F.col(id_col).alias("member"), F.md5(text_col).alias("sum"))
    firsts = members.groupBy("sum").agg(F.min("member").alias("rep"), F.count("*").alias("n"))
    copies = firsts.where("n > 1")
    members = members.join(copies.select("sum", "rep"), "sum").select("member", "rep")
    spare = members.where("member <> rep").select(F.col("member").alias("rep"))
    # the edges are made twice rather than kept: they are larger than the texts they come from
    walks = paths(edges(long, id_col, text_col, least), least)
    places = cut(walks.join(spare, "rep", "left_anti"))
    around = (
        places.groupBy("rep").agg(F.collect_list(F.struct("path", "first", "end")).alias("places"))
        .join(long.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")), "rep")
        .select("rep", "text", F.explode("places").alias("at"))
        .select(
            "rep", "at.path", "at.first", "at.end",
            F.expr(f"substring(text, greatest(at.first - {k - 1}, 0) + 1, least(at.first, {k - 1}))").alias("before"),
            F.expr(f"substring(text, at.end + 1, {k - 1})").alias("after"),
        )
    )
    return around, members


def spans_of(around: DataFrame) -> DataFrame:
    """rep_a, start_a, rep_b, start_b, length of every maximal span of two different texts that runs through a path."""
    a, b = (around.select("path", *(F.col(c).alias(f"{c}_{side}") for c in ("rep", "first", "end", "before", "after"))) for side in "ab")
    pairs = a.join(b, "path").where("rep_a < rep_b")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            left = np.array([_common(x[::-1], y[::-1]) for x, y in zip(get["before_a"].to_pylist(), get["before_b"].to_pylist())], np.int64)
            right = np.array([_common(x, y) for x, y in zip(get["after_a"].to_pylist(), get["after_b"].to_pylist())], np.int64)
            first_a, end_a, first_b = (get[c].to_numpy() for c in ("first_a", "end_a", "first_b"))
            length = end_a - first_a + left + right
            out = pa.RecordBatch.from_arrays(
                [get["rep_a"], pa.array(first_a - left), get["rep_b"], pa.array(first_b - left), pa.array(length)],
                names=["rep_a", "start_a", "rep_b", "start_b", "length"],
            )
            yield out

    kind = dict(around.dtypes)["rep"]
    return pairs.mapInArrow(extend, f"rep_a {kind}, start_a long, rep_b {kind}, start_b long, length long")


def shared_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(spans, members): rep_a, start_a, rep_b, start_b, length of every maximal span of two different
    texts that runs through a path of the graph, and the rep of each document long enough to share."""
    around, members = walked(documents, id_col, text_col, least)
    return spans_of(around), members


def covered_on_hot_paths(around: DataFrame, least: int) -> DataFrame:
    """rep, start, end: what a walk shares with any other walk of its path, without a pair of them being made.

    Walks are alike to the left for l characters and to the right for r if they have one key (path, l, r, those characters).  With c
    characters lacking to the least length, the walk shares its path with l more on the left for the greatest l for which another has
    the key of (l, what is lacking behind it), and likewise on the right.
    """
    k = least // 2 + 1
    lacking = F.greatest(F.lit(least) - (F.col("end") - F.col("first")), F.lit(0)).cast("int")
    reach = F.sequence(F.lit(0), F.lit(k - 1))
    left = F.transform(reach, lambda m: F.struct(F.lit("l").alias("side"), m.alias("m"), m.alias("l"), F.greatest(F.col("lacking") - m, F.lit(0)).alias("r")))
    right = F.transform(reach, lambda m: F.struct(F.lit("r").alias("side"), m.alias("m"), F.greatest(F.col("lacking") - m, F.lit(0)).alias("l"), m.alias("r")))
    each = around.withColumn("lacking", lacking).withColumn("x", F.explode(F.concat(left, right))).where("x.l <= length(before) and x.r <= length(after)")
    key = F.xxhash64("path", "x.l", "x.r", F.right("before", F.col("x.l")), F.left("after", F.col("x.r")))
    keyed = cut(each.select("rep", "path", "first", "end", "x.side", "x.m", key.alias("key")))
    met = keyed.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("key")
    far = keyed.join(met, "key", "left_semi").groupBy("rep", "path", "first", "end").agg(*[F.max(F.when(F.col("side") == s, F.col("m"))).alias(s) for s in "lr"])
    return far.select("rep", (F.col("first") - F.col("l")).alias("start"), (F.col("end") + F.col("r")).alias("end"))


def joined(spans: DataFrame) -> DataFrame:
    """Spans of one pair on one diagonal that overlap or touch, made one."""
    diagonal = Window.partitionBy("rep_a", "rep_b", F.col("start_b") - F.col("start_a")).orderBy("start_a")
    reach = F.max(F.col("start_a") + F.col("length")).over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.distinct().withColumn("fresh", F.coalesce(F.col("start_a") > reach, F.lit(True)).cast("int"))
    numbered = marked.withColumn("span", F.sum("fresh").over(diagonal)).withColumn("shift", F.col("start_b") - F.col("start_a"))
    return numbered.groupBy("rep_a", "rep_b", "shift", "span").agg(
        F.min("start_a").alias("start_a"), F.min("start_b").alias("start_b"), (F.max(F.col("start_a") + F.col("length")) - F.min("start_a")).alias("length")
    ).drop("shift", "span")


def shared_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id_a < id_b of any two documents that share a span of at least ``least`` characters."""
    spans, members = shared_spans(documents, id_col, text_col, least)
    members = cut(members)
    # a span of one path is whole unless it reaches the texts kept on either side, which lie within the path's own branchings
    pairs = joined(spans).where(F.col("length") >= least).select("rep_a", "rep_b").distinct()
    for side in "ab":
        others = members.select(F.col("rep").alias(f"rep_{side}"), F.col("member").alias(f"member_{side}"))
        pairs = pairs.join(others, f"rep_{side}", "left").withColumn(f"doc_{side}", F.coalesce(f"member_{side}", f"rep_{side}"))
    different = pairs.select("doc_a", "doc_b")
    x, y = (members.select("rep", F.col("member").alias(f"doc_{side}")) for side in "ab")
    equal = x.join(y, "rep").where("doc_a < doc_b").select("doc_a", "doc_b")
    return different.union(equal).select(
        F.least("doc_a", "doc_b").alias(f"{id_col}_a"), F.greatest("doc_a", "doc_b").alias(f"{id_col}_b")
    ).distinct()


def shared_amounts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, n_chars, shared_chars, share of every document: its characters that lie in a span shared elsewhere.

    Walks of a path are compared pair by pair where it has few; a passage that many documents hold makes no pairs.
    """
    around, members = walked(documents, id_col, text_col, least)
    around, members = cut(around), cut(members)
    hot = around.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("path")
    whole = joined(spans_of(around.join(hot, "path", "left_anti"))).where(F.col("length") >= least)
    sides = [whole.select(F.col(f"rep_{s}").alias("rep"), F.col(f"start_{s}").alias("start"), (F.col(f"start_{s}") + F.col("length")).alias("end")) for s in "ab"]
    sides.append(covered_on_hot_paths(around.join(hot, "path", "left_semi"), least))
    by_place = Window.partitionBy("rep").orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # spans of one text that several others share repeat; distinct before sorting
    covered = sides[0].union(sides[1]).union(sides[2]).distinct().withColumn("new", F.greatest(F.col("end") - F.greatest("start", reach), F.lit(0)))
    amounts = covered.groupBy("rep").agg(F.sum("new").alias("part"))
    sizes = documents.select(F.col(id_col), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"))
    named = sizes.join(members.withColumnRenamed("member", id_col), id_col, "left").withColumn("copied", F.col("rep").isNotNull())
    amount = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("part", F.lit(0)))
    return (
        named.withColumn("rep", F.coalesce("rep", F.col(id_col)))
        .join(amounts, "rep", "left")
        .select(id_col, "n_chars", amount.cast("long").alias("shared_chars"))
        .withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
    )
