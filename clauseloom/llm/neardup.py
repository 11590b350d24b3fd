"""Near-duplicate texts by bit-sliced comparison.

A text is the set of its SHINGLE-character substrings (lower case, white space runs
as one space, ends stripped).  Its sketch has a bit for the parity of the shingles
that hash there, so two sketches differ in at most as many bits as the sets differ
in shingles: sets of Jaccard similarity t or more differ in at most
(1 - t) / (1 + t) * (size + size), and a pair whose sketches differ in more bits can
be left out without losing one.

Sketches are compared in blocks: the bits that two sketches share are one product of
matrices of zeros and ones, and what a pair must share at least is a sum of one number
of either text, which two more columns take off.  All numbers are whole, so nothing is
rounded.  A sketch has about as many bits as the larger texts have shingles, folded
further for smaller ones: fewer bits would let unrelated texts pass, more cost time.
What remains is verified by the exact similarity.

Texts of similarity t have sizes within a factor t, so texts are laid out by size
class and a class meets itself and the next.  Where texts are more than one task
holds, classes are cut into cells by what their texts are about: shingles are grouped
as a sample has them together, and a text with more shingles of some groups than any
text of a cell has, or fewer than all, by more than similar texts can differ, isn't
sent to that cell (a bound without loss, whatever was learned).  Cells are cut into
tiles of bounded size.  Every pair within tiles that meet is measured and none is
emitted but the few that survive.

Equal texts are one class, compared once and told apart at the end.

Defined cases: null texts and texts shorter than a shingle have no similarity to
anything; repeated rows count once; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.session import cut

SHINGLE = 5
THRESHOLD = 0.7
#: Texts on either side of a task at most, and bytes of their sketches.
TILE, TILE_BYTES = 32768, 1 << 22
#: Texts on either side of a product at most, and numbers in either matrix.
BLOCK, CELLS = 1024, 1 << 21
#: Groups of shingles, texts that they are learned from, cells of all size classes together and texts that those are learned from.
GROUPS, SAMPLE, MOST_CELLS, MORE = 128, 1024, 192, 16384


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct substrings of a normal text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - size + 1
    if n < 1:
        return np.array([], np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = (h ^ (h >> np.uint64(29)) ^ codes[i : i + n]) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


def size_class(n: int, threshold: float) -> int:
    """Sets within a factor ``threshold`` lie in one class or in adjacent ones."""
    return int(math.log(n) / -math.log(threshold - 1e-6)) if n else -1


def bits_for(n: float) -> int:
    """Bits of sketches of sets of at most ``n`` shingles; sums of so many bits are exact in 32-bit floats."""
    return 1 << min(22, max(6, math.ceil(math.log2(1.1 * n))))


def planes_of(level: int, threshold: float) -> int:
    """Bits of a sketch when the larger set's class is ``level``."""
    return bits_for((threshold - 1e-6) ** -(level + 1))


def sketch(hashes: np.ndarray, bits: int) -> np.ndarray:
    parity = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little")


def folded(sketches: np.ndarray, bits: int) -> np.ndarray:
    """Rows of sketches of more bits as sketches of ``bits`` bits."""
    while sketches.shape[1] * 8 > bits:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _matrix(sketches: np.ndarray, sizes: np.ndarray, threshold: float, left: bool) -> np.ndarray:
    """The bits as numbers, and columns whose product takes off what two sketches must share at least.

    Sketches of x and y bits differ in x + y less twice the shared bits, which must be at most share * (size + size).
    """
    x = np.unpackbits(sketches, axis=1)
    least = np.floor((x.sum(axis=1, dtype=np.int64) - (1 - threshold) / (1 + threshold) * sizes) / 2 - 1e-6)
    one = np.ones(len(x))
    return np.hstack([x.astype(np.float32), np.column_stack([-least, one] if left else [one, -least]).astype(np.float32)])


def kinds(sample: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in order, group of each): shingles of some share of the sample, those of the same texts grouped.

    Any grouping is right, as it only serves bounds; a good one has groups that a text has nearly whole or not at all.
    """
    found, count = np.unique(np.concatenate([*sample, np.array([], np.uint64)]), return_counts=True)
    often = np.sort(np.lexsort((found, -count))[: int((count >= max(4, 0.004 * len(sample))).sum())][:16384])
    found = found[often]
    if len(found) < 2 * GROUPS:
        return found[:0], np.array([], np.int64)
    within = np.zeros((len(found), len(sample)), np.float32)
    for i, shingle in enumerate(sample):
        within[np.isin(found, shingle, assume_unique=True), i] = 1
    within /= np.linalg.norm(within, axis=1, keepdims=True)
    centers = within[np.random.default_rng(1).choice(len(found), GROUPS, replace=False)]
    for _ in range(5):
        label = (within @ centers.T).argmax(axis=1)
        chosen = np.zeros((GROUPS, len(found)), np.float32)
        chosen[label, np.arange(len(found))] = 1
        centers = chosen @ within
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-9)
    return found, (within @ centers.T).argmax(axis=1)


def kind(hashes: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of a text's shingles each group has, 255 at most."""
    found, label = known
    if not len(found):
        return np.zeros(GROUPS, np.uint8)
    at = np.minimum(np.searchsorted(found, hashes), len(found) - 1)
    return np.minimum(np.bincount(label[at[found[at] == hashes]], minlength=GROUPS), 255).astype(np.uint8)


def may_meet(f: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, least: int, most: int, threshold: float) -> np.ndarray:
    """Which texts may be similar to any of some whose counts and sizes lie within these limits.

    What a text has beyond the highest count of a group isn't in the other, and what it lacks to the lowest isn't in it;
    a pair shares at least t / (1 + t) of both sizes, so either text has only the rest of its own besides.
    """
    share = threshold / (1 + threshold)
    over = (np.maximum(f, high) - high).sum(axis=1, dtype=np.int32)
    under = (np.maximum(f, low) - f).sum(axis=1, dtype=np.int32)
    return (over <= sizes - share * (sizes + least) + 1e-6) & (under <= most - share * (sizes + most) + 1e-6) & (sizes <= most / threshold + 1e-6) & (sizes >= threshold * least - 1e-6)


def near(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, threshold: float, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs of sketches that differ in at most the bits that the threshold allows.

    a, b: rows of sketch bytes, of one length.  Where both are the ``same`` rows, a pair is given once or twice.
    """
    share = (1 - threshold) / (1 + threshold)
    order_a, order_b = np.argsort(size_a, kind="stable"), np.argsort(size_b, kind="stable")
    a, size_a, b, size_b = a[order_a], size_a[order_a], b[order_b], size_b[order_b]
    found_a, found_b = [np.array([], np.int64)], [np.array([], np.int64)]
    step = max(1, min(BLOCK, CELLS // (a.shape[1] * 8)))
    for left in range(0, len(b), step):
        sizes = size_b[left : left + step]
        right = None
        for top in range(0, min(len(a), left + step) if same else len(a), step):
            own = size_a[top : top + step]
            if own[-1] < threshold * sizes[0] - 1e-9 or sizes[-1] < threshold * own[0] - 1e-9:
                continue
            if right is None:
                right = _matrix(b[left : left + step], sizes, threshold, False).T
            q, lane = np.nonzero(_matrix(a[top : top + step], own, threshold, True) @ right >= 0)
            found_a.append(top + q)
            found_b.append(left + lane)
    i, j = np.concatenate(found_a), np.concatenate(found_b)
    apart = np.bitwise_count(a[i] ^ b[j]).sum(axis=1)
    fits = apart <= share * (size_a[i] + size_b[j]) + 1e-9
    return order_a[i[fits]], order_b[j[fits]]


def sketched(reps: DataFrame, threshold: float, size: int, known: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """rep, n, level, sketch and counts of groups of each rep's normal text; texts without a shingle are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, ns, levels, out, counts = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                h = shingles(text, size)
                if len(h):
                    level = size_class(len(h), threshold)
                    kept.append(i)
                    ns.append(len(h))
                    levels.append(level)
                    out.append(sketch(h, planes_of(level + 1, threshold)).tobytes())
                    counts.append(kind(h, known).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(ns, pa.int32()), pa.array(levels, pa.int32()), pa.array(out, pa.binary()), pa.array(counts, pa.binary())],
                names=["rep", "n", "level", "sketch", "counts"],
            )

    kind_of = dict(reps.dtypes)["rep"]
    return reps.select("rep", "text").mapInArrow(run, f"rep {kind_of}, n int, level int, sketch binary, counts binary")


def _split(f: np.ndarray) -> tuple[int, float]:
    """The group whose counts differ most, and their mean."""
    some = f[:: max(1, len(f) // 512)].astype(np.float32)
    group = int(some.var(axis=0).argmax())
    return group, float(some[:, group].mean())


def grown(f: np.ndarray, most: float, first: int) -> tuple[tuple | int, int]:
    """(tree, next number): cuts (group, mean, rows up to it, rows beyond) down to leaves, numbered from ``first``."""
    group, mean = _split(f) if len(f) else (0, 0.0)
    many = f[:, group] > mean
    if len(f) <= most or not 0 < many.sum() < len(f):
        return first, first + 1
    few, following = grown(f[~many], most, first)
    rest, following = grown(f[many], most, following)
    return (group, mean, few, rest), following


def cells_of(f: np.ndarray, tree: tuple | int) -> np.ndarray:
    out, stack = np.zeros(len(f), np.int64), [(np.arange(len(f)), tree)]
    while stack:
        at, node = stack.pop()
        if isinstance(node, int):
            out[at] = node
        else:
            many = f[at, node[0]] > node[1]
            stack += [(at[~many], node[2]), (at[many], node[3])]
    return out


def _counts(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), GROUPS)


def laid(sketches: DataFrame, threshold: float, tile: int) -> tuple[DataFrame | None, list[int]]:
    """(texts with the tiles x <= y that they meet and are met in, level of each tile).

    A text goes to its own tile and to those whose counts don't keep it apart from all of their texts.
    """
    counted = {r["level"]: r["count"] for r in sketches.groupBy("level").count().collect()}
    if not counted:
        return None, []
    total = sum(counted.values())
    # cells are few and the sample is bounded, whatever the corpus; a poor sample costs time, but no pair
    some = sketches.select("level", "counts", F.xxhash64("rep").alias("h")).orderBy("h").limit(MORE).collect() if total > tile else []
    trees, level_of = {}, []
    for level in sorted(counted):
        rows = [r["counts"] for r in some if r["level"] == level]
        f = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), GROUPS)
        trees[level], following = grown(f, max(16, len(some) * max(1 / MOST_CELLS, tile / 8 / total)), len(level_of))
        level_of += [level] * (following - len(level_of))

    def placed(levels: np.ndarray, f: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(f), np.int64)
        for level in np.unique(levels):
            at = np.flatnonzero(levels == level)
            cell[at] = cells_of(f[at], trees[int(level)])
        return cell

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {}
        for batch in batches:
            levels, n, f = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _counts(batch.column(2))
            cell = placed(levels, f)
            for c in np.unique(cell).tolist():
                at = cell == c
                old = kept.get(c, (0, 1 << 31, 0, np.full(f.shape[1], 255, np.uint8), np.zeros(f.shape[1], np.uint8)))
                kept[c] = old[0] + int(at.sum()), min(old[1], int(n[at].min())), max(old[2], int(n[at].max())), np.minimum(old[3], f[at].min(axis=0)), np.maximum(old[4], f[at].max(axis=0))
        rows = [{"cell": c, "texts": k, "least": lo, "most": hi, "low": low.tobytes(), "high": high.tobytes()} for c, (k, lo, hi, low, high) in kept.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("cell", pa.int32()), ("texts", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("low", pa.binary()), ("high", pa.binary())]))

    def joined(group: pa.Table) -> pa.Table:
        get = group.to_pydict()
        low, high = (np.array([np.frombuffer(x, np.uint8) for x in get[name]]) for name in ("low", "high"))
        out = {"cell": [get["cell"][0]], "texts": [sum(get["texts"])], "least": [min(get["least"])], "most": [max(get["most"])], "low": [low.min(axis=0).tobytes()], "high": [high.max(axis=0).tobytes()]}
        return pa.table(out, schema=group.schema)

    form = "cell int, texts long, least long, most long, low binary, high binary"
    boxes = sorted(sketches.select("level", "n", "counts").mapInArrow(limits, form).groupBy("cell").applyInArrow(joined, form).collect())
    # tiles of a cell follow each other, and cells of a level do
    first, tiles, tile_levels = {}, {}, []
    for r in boxes:
        level = level_of[r["cell"]]
        fit = min(tile, max(1, TILE_BYTES * 8 // planes_of(level + 1, threshold)))
        first[r["cell"]], tiles[r["cell"]] = len(tile_levels), -(-r["texts"] // fit)
        tile_levels += [level] * tiles[r["cell"]]
    bounds = [(r["cell"], level_of[r["cell"]], np.frombuffer(bytes(r["low"]), np.uint8), np.frombuffer(bytes(r["high"]), np.uint8), r["least"], r["most"]) for r in boxes]
    kind_of = dict(sketches.dtypes)["rep"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels, n, f, h = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64), _counts(batch.column(4)), batch.column(5).to_numpy()
            cell = placed(levels, f)
            mine = np.array([first[c] for c in cell.tolist()], np.int64) + h % np.array([tiles[c] for c in cell.tolist()], np.int64)
            for c, level, low, high, least, most in bounds:
                at = np.flatnonzero(np.abs(levels - level) <= 1)
                at = at[may_meet(f[at], n[at], low, high, least, most, threshold)] if len(at) else at
                for t in range(first[c], first[c] + tiles[c]) if len(at) else ():
                    got = batch.take(pa.array(at))
                    own = mine[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(own, t), pa.int32()), pa.array(np.maximum(own, t), pa.int32()), pa.array(own > t), got.column(0), got.column(2), got.column(3)],
                        names=["x", "y", "right", "rep", "n", "sketch"],
                    )

    rows = sketches.select("rep", "level", "n", "sketch", "counts", F.pmod(F.xxhash64("rep"), F.lit(1 << 30)).alias("h"))
    return rows.mapInArrow(meet, f"x int, y int, right boolean, rep {kind_of}, n int, sketch binary"), tile_levels


def candidates(sketches: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """rep_a < rep_b of all pairs whose sketches are near enough."""
    kind_of = dict(sketches.dtypes)["rep"]
    rows, level_of = laid(sketches, threshold, tile)
    if rows is None:
        return sketches.sparkSession.createDataFrame([], f"rep_a {kind_of}, rep_b {kind_of}")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        x, y = (k.as_py() for k in key)
        bits = planes_of(level_of[y], threshold)
        right = group.column("right").to_numpy(zero_copy_only=False).astype(bool)
        sizes = group.column("n").to_numpy().astype(np.int64)
        data = group.column("sketch").to_pylist()
        rows = np.zeros((len(data), bits // 8), np.uint8)
        for length in {len(s) for s in data}:
            at = [i for i, s in enumerate(data) if len(s) == length]
            rows[at] = folded(np.frombuffer(b"".join(data[i] for i in at), np.uint8).reshape(len(at), length), bits)
        same = x == y
        # in the pair of a tile with itself every text is on both sides
        a = np.arange(len(data)) if same else np.flatnonzero(~right)
        b = a if same else np.flatnonzero(right)
        i, j = near(rows[a], sizes[a], rows[b], sizes[b], threshold, same) if len(a) and len(b) else (np.array([], np.int64),) * 2
        reps = group.column("rep").combine_chunks()
        return pa.table({"rep_a": reps.take(pa.array(a[i])), "rep_b": reps.take(pa.array(b[j]))})

    pairs = rows.groupBy("x", "y").applyInArrow(compare, f"rep_a {kind_of}, rep_b {kind_of}")
    return pairs.where("rep_a <> rep_b").select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b")).distinct()


def verified(pairs: DataFrame, reps: DataFrame, threshold: float, size: int) -> DataFrame:
    """The pairs with the exact similarity of their shingle sets, where it reaches the threshold."""
    for side in "ab":
        pairs = pairs.join(reps.select(F.col("rep").alias(f"rep_{side}"), F.col("text").alias(f"text_{side}")), f"rep_{side}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            kept, values = [], []
            for i, (x, y) in enumerate(zip(get["text_a"].to_pylist(), get["text_b"].to_pylist())):
                a, b = ({t[p : p + size] for p in range(len(t) - size + 1)} for t in (x, y))
                common = len(a & b)
                value = common / (len(a) + len(b) - common)
                if value >= threshold:
                    kept.append(i)
                    values.append(value)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([get["rep_a"].take(at), get["rep_b"].take(at), pa.array(values, pa.float64())], names=["rep_a", "rep_b", "similarity"])

    kind = dict(reps.dtypes)["rep"]
    return pairs.mapInArrow(run, f"rep_a {kind}, rep_b {kind}, similarity double")


def near_duplicates(texts: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, size: int = SHINGLE, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(links, members): rep_a < rep_b, similarity of all similar different texts; member, rep of every row with a text."""
    kind = dict(texts.dtypes)[id_col]

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normal(t) for t in batch.column(1).to_pylist()], pa.string())], names=["member", "text"])

    rows = texts.select(id_col, text_col).where(F.col(text_col).isNotNull())
    tidied = rows.mapInArrow(tidy, f"member {kind}, text string").withColumn("sum", F.md5("text"))
    # the least member of each text bears it; the texts of its copies aren't moved
    members = cut(tidied.dropDuplicates(["member"]))
    owners = members.groupBy("sum").agg(F.min("member").alias("rep"))
    reps = cut(members.select(F.col("member").alias("rep"), "text").join(owners.select("rep"), "rep", "left_semi"))
    # one tile's texts are measured as quickly as groups are learned
    some = reps.select(F.substring("text", 1, 4000).alias("text"), F.xxhash64("rep").alias("h")).orderBy("h").limit(SAMPLE).collect() if reps.count() > tile else []
    known = kinds([shingles(r["text"], size) for r in some])
    links = verified(candidates(cut(sketched(reps, threshold, size, known)), threshold, tile), reps, threshold, size)
    long = F.length("text") >= size
    return links, members.where(long).join(owners, "sum").select("member", "rep")


def pairs(texts: DataFrame, id_col: str = "sample_id", text_col: str = "source_text", threshold: float = THRESHOLD) -> DataFrame:
    """id_a < id_b of all rows whose texts are similar or equal."""
    links, members = near_duplicates(texts, id_col, text_col, threshold)
    links = cut(links)
    out = links.select("rep_a", "rep_b")
    for side in "ab":
        out = out.join(members.select(F.col("rep").alias(f"rep_{side}"), F.col("member").alias(f"m_{side}")), f"rep_{side}")
    x, y = (members.select("rep", F.col("member").alias(f"m_{side}")) for side in "ab")
    equal = x.join(y, "rep").where("m_a < m_b")
    both = out.select("m_a", "m_b").union(equal.select("m_a", "m_b"))
    return both.select(F.least("m_a", "m_b").alias(f"{id_col}_a"), F.greatest("m_a", "m_b").alias(f"{id_col}_b")).distinct()


def groups(texts: DataFrame, id_col: str = "sample_id", text_col: str = "source_text", threshold: float = THRESHOLD) -> DataFrame:
    """id, group, links: the connected group of each row's text (its least id) and the number of texts it is linked to.

    Labels travel along links and are halved by pointer jumping; the rounds grow with the logarithm of a chain's length.
    """
    found, members = near_duplicates(texts, id_col, text_col, threshold)
    both = cut(found.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).unionByName(found.select(F.col("rep_b").alias("a"), F.col("rep_a").alias("b"))))
    label = cut(both.groupBy("a").agg(F.count("*").alias("links")).select(F.col("a").alias("node"), F.col("a").alias("label"), "links"))
    while True:
        least = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        hooked = label.join(least, "node").select("node", F.least("label", "seen").alias("next"), F.col("label").alias("old"), "links")
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("further"))
        new = cut(hooked.join(jump, "next").select("node", F.least("next", "further").alias("label"), "old", "links"))
        moved = new.where(F.col("label") != F.col("old")).limit(1).count()
        label = new.drop("old")
        if not moved:
            break
    named = members.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    return named.select(F.col("member").alias(id_col), F.coalesce("label", "rep").alias("group"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
