"""Filling containers of fixed capacity with whole texts, by tiers.

Sizes are integers up to the capacity, so the number of texts of each size (a
histogram of at most ``capacity`` entries, whatever the corpus) says all that a
packing needs.  Each text is routed to the tier of the smallest context window that
holds it (capacity, a half, a quarter, ...).  Every tier is packed for itself first:
a container takes the tier's largest pieces as long as one fits.  The gap it leaves
is then filled from the shorter tiers: by pieces of two of them that fill it
exactly, else by the largest that fits of each in turn, so that no tier is used up
for the longer ones; with one tier this is plain best fit.  A plan line (one pattern of sizes) stands for as many equal containers as
the histogram allows, so the plan has at most about one line a size.  Texts find
their container by their rank among the texts of their size, counted in salted
groups, so that no task holds all texts of a hot size; pieces that fill a container
are numbered where they lie.

A text above the capacity is split into full containers and one rest; nothing else
is split.  Null and empty texts have size 0 and are spread over the containers.
Containers are dealt to step groups back and forth, so that the groups hold nearly
the same number of tokens.

Defined cases: no rows -> no rows; repeated rows are packed each for itself (the
rank breaks ties by the id and then arbitrarily, without a loss); only id and size
are read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.session import cut

CAPACITY = 2048
TIERS = 4
STEP = 8
#: Pieces of one size that a task ranks.
SALTED = 1_000_000


def tier_of(size: int, capacity: int, tiers: int) -> int:
    """The tier of the smallest context window (capacity, a half, a quarter, ...) that holds a size."""
    return min(tiers - 1, (capacity // size).bit_length() - 1)


def _exact(gap: int, shelves: list[list[int]], left: dict[int, int]) -> tuple[int, ...]:
    """A piece, or pieces of two tiers, that fill a gap exactly, of the longest tiers that can; none if no such are left."""
    if gap in left and any(shelf and shelf[0] <= gap <= shelf[-1] for shelf in shelves):
        return (gap,)
    for i, longer in enumerate(shelves):
        for size in reversed(longer[: bisect_right(longer, gap)]):
            other = gap - size
            if other in left and other < (longer[0] if longer else 0) and i + 1 < len(shelves):
                return (size, other)
    return ()


def plan(histogram: dict[int, int], capacity: int, tiers: int = TIERS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Lines (((size, how many a container), ...), containers), the longest tier first.

    Sizes are 1 to capacity; every item of the histogram lies in exactly one container.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    shelves: list[list[int]] = [[] for _ in range(tiers)]
    for size in sorted(left):
        shelves[tier_of(size, capacity, tiers)].append(size)
    lines = []
    for tier in range(tiers):
        while shelves[tier]:
            used: dict[int, int] = {}
            gap = capacity

            def take(shelf: list[int], most: int) -> int:
                """Up to ``most`` of the shelf's largest size that fits and isn't used up."""
                nonlocal gap
                at = bisect_right(shelf, gap) - 1
                while at >= 0 and used.get(shelf[at], 0) >= left[shelf[at]]:
                    at -= 1
                if at < 0:
                    return 0
                size = shelf[at]
                n = min(most, gap // size, left[size] - used.get(size, 0))
                used[size] = used.get(size, 0) + n
                gap -= n * size
                return n

            # the tier itself first, the largest before the smaller ones
            while take(shelves[tier], capacity):
                pass
            # the gap goes to the shorter tiers: pieces of two of them that fill it exactly, else the largest that fits of each in turn
            for size in _exact(gap, shelves[tier + 1 :], left):
                used[size] = used.get(size, 0) + 1
                gap -= size
            while gap and any([take(shelf, 1) for shelf in shelves[tier + 1 :]]):
                pass
            times = min(left[s] // n for s, n in used.items())
            for s, n in used.items():
                left[s] -= n * times
                if not left[s]:
                    del left[s]
                    shelves[tier_of(s, capacity, tiers)].remove(s)
            lines.append((tuple(sorted(used.items(), reverse=True)), times))
    return lines


def _numbered(full: DataFrame, first: int = 0) -> DataFrame:
    """full with container_id, counting from ``first``: each part counts for itself, from where the parts before it end.

    ``full`` reads a checkpoint, whose parts stay the same however often they are read.
    """
    full = full.withColumn("part", F.spark_partition_id())
    # one row a part
    counts = {r["part"]: r["count"] for r in full.groupBy("part").count().collect()}
    starts, at = {}, first
    for part in sorted(counts):
        starts[part] = at
        at += counts[part]
    kinds = ", ".join(f"`{n}` {k}" for n, k in full.drop("part").dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # (a task may run a part under another number, as in a union; the rows know theirs)
            at = starts[batch.column(batch.num_columns - 1)[0].as_py()] if at is None else at
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.arange(at, at + batch.num_rows))], names=[*batch.schema.names[:-1], "container_id"])
            at += batch.num_rows

    return full.mapInArrow(run, f"{kinds}, container_id long")


def pack(sizes: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, tiers: int = TIERS, step: int = STEP, salted: int = SALTED) -> DataFrame:
    """id, piece, pieces, piece_start, piece_size, tier, container_id, step_group of each piece of (id, size).

    ``sizes`` is read several times and should be materialised.
    """
    whole = F.floor(F.col("size") / capacity).cast("int")
    rest = F.col("size") % capacity
    count = F.when(F.col("size") == 0, 1).otherwise(whole + (rest > 0).cast("int"))
    pieces = (
        sizes.select(id_col, F.col("size").cast("int").alias("size"))
        .withColumn("pieces", count.cast("int"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumn("piece_start", F.col("piece") * capacity)
        .withColumn("piece_size", F.least(F.col("size") - F.col("piece_start"), F.lit(capacity)))
        .drop("size")
    )
    part = pieces.where(F.col("piece_size") < capacity)
    # at most ``capacity`` rows
    histogram = {r["piece_size"]: r["count"] for r in part.groupBy("piece_size").count().collect()}
    # a hot size is ranked in as many groups as it needs
    salts = max(1, -(-max(histogram.values(), default=0) // salted))
    part = part.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)).cast("int"))
    offsets = np.zeros(capacity * salts, np.int64)
    if salts > 1:
        # at most ``capacity`` x ``salts`` rows, which is less than twice the rows over ``salted``
        for row in part.groupBy("piece_size", "salt").count().collect():
            offsets[row["piece_size"] * salts + row["salt"]] = row["count"]
        by_size = offsets.reshape(capacity, salts)
        offsets = (np.cumsum(by_size, axis=1) - by_size).ravel()
    empty = histogram.pop(0, 0)
    lines = plan(histogram, capacity, tiers)
    # For each size, runs of ranks: from the run's start, `per` ranks to each container from `first` on.
    sizes_, starts, firsts, pers, seen, at = [], [], [], [], {}, 0
    for pattern, times in lines:
        for size, per in pattern:
            sizes_.append(size)
            starts.append(seen.get(size, 0))
            firsts.append(at)
            pers.append(per)
            seen[size] = seen.get(size, 0) + per * times
        at += times
    planned = max(at, 1 if empty else 0)
    order = np.lexsort((starts, sizes_)) if sizes_ else np.array([], int)
    runs = [np.array(x, np.int64)[order] for x in (sizes_, starts, firsts, pers)]
    # a piece that fills a container needs no rank
    full = _numbered(pieces.where(F.col("piece_size") == capacity), planned)
    shared = sizes.sparkSession.sparkContext.broadcast((runs, offsets))
    big = 1 << 44

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (run_size, run_start, run_first, run_per), offset = shared.value
        keys = run_size * big + run_start
        for batch in batches:
            size, salt, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("piece_size", "salt", "rank"))
            rank = offset[size.astype(np.int64) * salts + salt] + rank - 1
            container = rank % max(planned, 1)  # where the size is 0
            some = size > 0
            run = np.searchsorted(keys, size[some].astype(np.int64) * big + rank[some], "right") - 1
            container[some] = run_first[run] + (rank[some] - run_start[run]) // run_per[run]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in (id_col, "pieces", "piece", "piece_start", "piece_size")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(container.astype(np.int64))], names=[id_col, "pieces", "piece", "piece_start", "piece_size", "container_id"])

    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("piece_size", "salt").orderBy(id_col, "piece")).cast("long"))
    kind = dict(sizes.dtypes)[id_col]
    placed = ranked.mapInArrow(place, f"`{id_col}` {kind}, pieces int, piece int, piece_start int, piece_size int, container_id long").unionByName(full)
    # containers are dealt to the groups back and forth: planned ones come with the longest tiers first, full ones behind them
    n_full = full.select(F.count("*")).first()[0]
    groups = max(1, -(-(planned + n_full) // step))
    lap, seat = F.floor(F.col("container_id") / groups), F.col("container_id") % groups
    ratio = F.floor(F.lit(capacity) / F.greatest("piece_size", F.lit(1)))
    tier = F.least(F.lit(tiers - 1), F.length(F.conv(ratio.cast("string"), 10, 2)) - 1)
    return placed.select(
        id_col, "piece", "pieces", "piece_start", "piece_size", tier.cast("int").alias("tier"), "container_id",
        F.when(lap % 2 == 0, seat).otherwise(groups - 1 - seat).cast("long").alias("step_group"),
    )


def packed(documents: DataFrame, tokenizers: str, capacity: int = CAPACITY) -> DataFrame:
    from clauseloom.llm.encode import token_sizes

    # The sizes are read for the histogram and for the placing; encoding twice would cost more than keeping two integers a text.
    return pack(cut(token_sizes(documents, tokenizers=tokenizers)), capacity=capacity)


def fill(assignments: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, fill and the least number of containers any packing could use."""
    by_container = assignments.groupBy("container_id", "step_group").agg(F.sum("piece_size").alias("tokens"))
    by_group = by_container.groupBy("step_group").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"))
    return by_group.agg(
        F.sum("n").alias("containers"),
        F.sum("tokens").alias("tokens"),
        (F.sum("tokens") / (F.sum("n") * capacity)).alias("fill"),
        F.ceil(F.sum("tokens") / capacity).alias("least_containers"),
        F.max("most").alias("fullest"),
        F.min("tokens").alias("least_group_tokens"),
        F.max("tokens").alias("most_group_tokens"),
    )
