"""Exact quantiles and neighbours in an order, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The accuracy of the first pass of a quantile; rows of one key that a task orders.
ACCURACY, BLOCK = 100_000, 1024


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and a column for each share: the exact quantiles of value, with linear interpolation; nulls are left out.

    A first pass brackets each quantile by approximate ones; a second counts what lies below the bracket and keeps what lies in
    it, which is at most some hundred-thousandths of a group.
    """
    kept = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    bounds = [F.percentile_approx("v", [max(0.0, p - 8 / ACCURACY), min(1.0, p + 8 / ACCURACY)], ACCURACY).alias(f"b_{n}") for n, p in shares.items()]
    ends = kept.groupBy(*keys).agg(F.count("*").alias("n"), *bounds)
    inside = lambda n: F.col("v").between(F.col(f"b_{n}")[0], F.col(f"b_{n}")[1])
    joined = kept.join(F.broadcast(ends) if not keys else ends, keys) if keys else kept.crossJoin(F.broadcast(ends))
    # with the values next to the bracket, as interpolation may need one
    near = [f for n in shares for f in (
        F.array_sort(F.collect_list(F.when(inside(n), F.col("v")))).alias(f"v_{n}"), F.count_if(F.col("v") < F.col(f"b_{n}")[0]).alias(f"k_{n}"),
        F.max(F.when(F.col("v") < F.col(f"b_{n}")[0], F.col("v"))).alias(f"l_{n}"), F.min(F.when(F.col("v") > F.col(f"b_{n}")[1], F.col("v"))).alias(f"h_{n}"),
    )]
    sums = joined.groupBy(*keys).agg(F.count("*").alias("n"), *near)

    def at(n: str, p: float) -> Column:
        place = (F.col("n") - 1) * F.lit(p)
        low = (F.floor(place) - F.col(f"k_{n}")).cast("int") + 1
        listed = F.concat(F.array(F.col(f"l_{n}")), F.col(f"v_{n}"), F.array(F.col(f"h_{n}")))
        first, second = F.get(listed, low), F.get(listed, low + 1)
        return first + (place - F.floor(place)) * (F.coalesce(second, first) - first)

    return sums.select(*keys, *[at(n, p).alias(n) for n, p in shares.items()])


def following(rows: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """rows with next: the value of the row behind in the order of its key (null for the last).  order begins with an integer.

    Rows are ordered in blocks of the first order column; the last row of a block takes the first of the next block.
    """
    blocked = rows.withColumn("_b", F.floor(F.col(order[0]) / BLOCK)).withColumn("_v", value)
    firsts = blocked.groupBy(key, "_b").agg(F.min_by("_v", F.struct(*order)).alias("_first"))
    beyond = firsts.withColumn("_beyond", F.lead("_first").over(Window.partitionBy(key).orderBy("_b"))).select(key, "_b", "_beyond")
    within = Window.partitionBy(key, "_b").orderBy(*order)
    out = blocked.withColumn("_next", F.lead(F.struct("_v")).over(within)).join(beyond, [key, "_b"], "left")
    return out.withColumn("next", F.when(F.col("_next").isNotNull(), F.col("_next._v")).otherwise(F.col("_beyond"))).drop("_b", "_v", "_next", "_beyond")


def carried(rows: DataFrame, key: str, order: list[str], value: Column, reset: Column | None = None) -> DataFrame:
    """rows with carried: the last value that isn't null up to each row in the order of its key; a row where reset holds forgets what came before."""
    held = F.struct(value.alias("v"), F.lit(1).alias("set"))
    mark = F.when(value.isNotNull(), held)
    if reset is not None:
        mark = mark.when(reset, F.struct(F.lit(None).cast("string").alias("v"), F.lit(1).alias("set")))
    blocked = rows.withColumn("_b", F.floor(F.col(order[0]) / BLOCK)).withColumn("_m", mark)
    lasts = blocked.where("_m is not null").groupBy(key, "_b").agg(F.max_by("_m", F.struct(*order)).alias("_last"))
    blocks = blocked.select(key, "_b").distinct().join(lasts, [key, "_b"], "left")
    before = blocks.withColumn("_before", F.last("_last", ignorenulls=True).over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select(key, "_b", "_before")
    within = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.withColumn("_own", F.last("_m", ignorenulls=True).over(within)).join(before, [key, "_b"], "left")
    return out.withColumn("carried", F.coalesce("_own", "_before")["v"]).drop("_b", "_m", "_own", "_before")
