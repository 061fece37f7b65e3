"""Exact order statistics by radix selection: no sort of values, no shuffle of rows.

A double's bits, made order preserving, are a key of 64 bits. Each round counts the rows of a group by the next digit of
their keys (partial sums; a shuffle has the occupied bins alone) and keeps, for each rank wanted, the bin that holds it;
the next round reads only rows of kept bins. It ends as soon as each kept bin has one value, after DIGITS rounds at
most. Kept bins of up to GROUPS groups are broadcast; more stay a table and are joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Bits of each round's digit: the first one has the sign, the exponent and ten bits of the fraction.
DIGITS = (22, 21, 21)
GROUPS = 50_000


def keyed(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with a bigint in the order of doubles: -inf first, zeros alike, NaN last. From exact arithmetic on powers of two,
    as SQL has no function for a double's bits. Steps are columns, so that each is evaluated once a row."""
    v, a, p = F.col(value), F.col("__a"), F.col("__p")
    out = rows.withColumn("__a", F.abs(v)).withColumn("__g", F.least(F.floor(F.log2(F.least(F.greatest(a, F.lit(2.0**-1022)), F.lit(2.0**1023)))).cast("int"), F.lit(1023)))
    out = out.withColumn("__p", F.pow(F.lit(2.0), F.col("__g").cast("double")))
    out = out.withColumn("__s", F.when(p > a, -1).when((F.col("__g") < 1023) & (p * 2 <= a), 1).otherwise(0))  # a logarithm may be one off
    q = F.when(F.col("__s") < 0, p / 2).when(F.col("__s") > 0, p * 2).otherwise(p)
    normal = (F.col("__g") + F.col("__s") + 1023).cast("bigint") * F.lit(1 << 52) + ((a / q - 1) * F.lit(2.0**52)).cast("bigint")
    small = (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")  # below the least normal number
    out = out.withColumn("__b", F.when(F.isnan(v), F.lit((1 << 63) - 1)).when(a < 2.0**-1022, small).when(a == float("inf"), F.lit(0x7FF << 52)).otherwise(normal))
    return out.withColumn(name, F.when(v < 0, -F.col("__b")).otherwise(F.col("__b"))).drop("__a", "__g", "__p", "__s", "__b")


def _kept(bins: DataFrame, by: str, ranks: Column | None) -> DataFrame:
    """The bin of each rank; bins: by, (j, r,) digit, c, least, most. ranks: of n, in the first round."""
    group = [by] if ranks is not None else [by, "j"]
    upto = F.sum("c").over(W.partitionBy(*group).orderBy("digit"))  # bins of a group, not rows
    if ranks is not None:
        bins = bins.withColumn("n", F.sum("c").over(W.partitionBy(by))).withColumn("upto", upto).select("*", F.posexplode(ranks).alias("j", "r"))
    else:
        bins = bins.withColumn("upto", upto)
    hit = bins.filter((F.col("upto") >= F.col("r")) & (F.col("upto") - F.col("c") < F.col("r")))
    return hit.select(by, "j", (F.col("r") - F.col("upto") + F.col("c")).alias("r"), "digit", "least", "most")


def selected(rows: DataFrame, by: str, value: str, ranks: Column) -> DataFrame:
    """(by, j, value): of the values of each group that aren't NULL, those at the ranks (from 1), an array of bigint made of
    n, their number; j is a rank's place in it. A rank beyond the group gives no row."""
    spark = rows.sparkSession
    own = rows.filter(F.col(value).isNotNull()).select(F.col(by), (F.col(value).cast("double") + F.lit(0.0)).alias("v"))
    own = keyed(own, "v", "k")
    kept = None
    for i, width in enumerate(DIGITS):
        shift = sum(DIGITS[i + 1 :])
        digit = F.shiftright("k", shift) if i == 0 else F.shiftright("k", shift).bitwiseAND(F.lit((1 << width) - 1))
        if kept is None:
            seen, group = own, [by]
        else:
            above = F.shiftright("k", shift + width)
            seen = own.join(kept.select(F.col(by).alias("__g"), "j", "r", F.col("digit").alias("__d")), F.col(by).eqNullSafe(F.col("__g")) & (above == F.col("__d")))
            group = [by, "j", "r"]
        bins = seen.groupBy(*group, digit.alias("digit")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        found = _kept(bins, by, ranks if kept is None else None)
        if kept is not None:  # keys so far
            up = kept.select(F.col(by).alias("__g"), F.col("j").alias("__j"), F.col("digit").alias("__d"))
            found = found.join(F.broadcast(up) if few else up, F.col(by).eqNullSafe(F.col("__g")) & (F.col("j") == F.col("__j"))).select(by, "j", "r", (F.shiftleft(F.col("__d"), width) + F.col("digit")).alias("digit"), "least", "most")
        got = found.limit(GROUPS + 1).collect()
        few = len(got) <= GROUPS
        kept = F.broadcast(spark.createDataFrame(got, found.schema)) if few else found
        if few and all(r.least == r.most or (r.least != r.least and r.most != r.most) for r in got):
            break
    return kept.select(by, "j", F.col("least").alias("value"))


def median(rows: DataFrame, by: str, value: str = "value") -> DataFrame:
    """(by, median): the mean of both middle values."""
    n = F.col("n")
    got = selected(rows, by, value, F.array(F.floor((n + 1) / 2).cast("bigint"), F.floor(n / 2 + 1).cast("bigint")))
    return got.groupBy(by).agg((F.sum("value") / 2).alias("median"))


def quantile(rows: DataFrame, by: str, shares: tuple[float, ...], value: str = "value") -> DataFrame:
    """(by, share, value): the least value that has at least that share of the group's values at or below it."""
    at = F.array(*[F.greatest(F.lit(1), F.ceil(F.lit(float(s)) * F.col("n"))).cast("bigint") for s in shares])
    share = reduce(lambda c, s: c.when(F.col("j") == s[0], s[1]), list(enumerate(shares))[1:], F.when(F.col("j") == 0, shares[0]))
    return selected(rows, by, value, at).select(by, share.alias("share"), "value")
