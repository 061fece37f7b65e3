"""Running sums and numbers in an order, for groups of any size.

Bounds that cut the order into ranges of about equal rows come from a sample of the order columns alone, so a group that
holds most rows is dealt over most ranges. A row's range is an expression of its own columns and the bounds: whichever
task evaluates it, again after a loss too, it is the same. Each range of a group has one sum, made with partial sums;
sums of the ranges before it, of which a group has RANGES at most, are added to those of a window within the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Ranges of the order at most, and sampled rows for each.
RANGES, SAMPLED = 256, 50
_RANGE = "__range"


def _place(order: tuple[str, ...]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def ranged(rows: DataFrame, order: tuple[str, ...], ranges: int | None = None) -> DataFrame:
    """rows with the number of their range. The sample, of order columns only, has SAMPLED rows a range on the driver."""
    spark = rows.sparkSession
    ranges = min(RANGES, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = rows.select(*order)
    n = keys.count() if ranges > 1 else 0
    want = ranges * SAMPLED
    held = keys if n <= want else keys.sample(want / n, seed=7)
    found = held.distinct().sort(*order).limit(4 * want).collect() if n else []
    cuts = [found[i * len(found) // ranges] for i in range(1, ranges)] if len(found) >= ranges else found[1:]
    if not cuts:
        return rows.withColumn(_RANGE, F.lit(0))
    # the first columns decide where no two bounds agree in them; a range then has the rows of two at most
    order = next(order[:i] for i in range(1, len(order) + 1) if i == len(order) or len({c[:i] for c in cuts}) == len(cuts))
    bounds = F.array(*[F.struct(*[F.lit(c[f.name]).cast(f.dataType).alias(f.name) for f in keys.select(*order).schema]) for c in cuts])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    # bounds up to the row's place, by halving: a place is made once a row, and compared with few bounds
    below = lambda at: F.aggregate(steps, F.lit(0), lambda n, s: n + F.when(F.get(bounds, n + s - 1) <= at, s).otherwise(0))
    return rows.withColumn(_RANGE, F.get(F.transform(F.array(_place(order)), below), F.lit(0)))


def running(rows: DataFrame, order: tuple[str, ...], amounts: dict[str, Column], by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """rows with, for each amount, its sum over the rows of the group that stand before the row; 0 for the first one. NULL
    amounts count as 0, NULLs of an order column come first, and rows of equal order stand in any order: name columns
    enough. Amounts of type decimal or integer have exact sums; sums of doubles depend on the ranges in their last bits."""
    own = ranged(rows, order, ranges).withColumns({f"__amount_{k}": v for k, v in amounts.items()})
    zero = lambda c: F.coalesce(c, F.lit(0))
    # one column, so that NULLs are equal and the window's rows lie where the join wants them
    own = own.withColumn("__group", F.struct(*by, _RANGE)).drop(_RANGE)
    totals = own.groupBy("__group").agg(*[zero(F.sum(f"__amount_{k}")).alias(f"__of_{k}") for k in amounts])
    earlier = W.partitionBy(*[F.col("__group")[c] for c in by]).orderBy(F.col("__group")[_RANGE]).rowsBetween(W.unboundedPreceding, -1)  # RANGES rows a group at most
    offsets = totals.select(F.col("__group").alias("__key"), *[zero(F.sum(f"__of_{k}").over(earlier)).alias(f"__before_{k}") for k in amounts])
    local = W.partitionBy("__group").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = own.select("*", *[zero(F.sum(f"__amount_{k}").over(local)).alias(f"__within_{k}") for k in amounts])
    joined = within.join(F.broadcast(offsets) if not by else offsets, F.col("__group") == F.col("__key"))
    return joined.select(*rows.columns, *[(F.col(f"__before_{k}") + F.col(f"__within_{k}")).alias(k) for k in amounts])


def numbered(rows: DataFrame, order: tuple[str, ...], name: str, by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """rows with their number in the group, from 0."""
    return running(rows, order, {name: F.lit(1).cast("bigint")}, by, ranges)
