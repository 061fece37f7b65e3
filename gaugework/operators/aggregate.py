"""Summaries of the score table (metric, value, status, validity): one aggregation, then row-wise intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugework.functions import stats
from gaugework.functions.values import clamped
from gaugework.operators import select

STATUSES = ("scored", "blocked", "non_evaluable", "skipped", "error")


def usable() -> Column:
    """Only scored and valid rows carry a number; everything else is counted, never averaged."""
    return (F.col("status") == "scored") & (F.col("validity") == "valid")


def aggregated(scores: DataFrame, by: str = "metric", median: bool = False) -> DataFrame:
    """One aggregation with partial sums; the median, where it is asked for, by a path of its own."""
    if median:
        return aggregated(scores, by).join(medians(scores, by), by, "left")
    v = F.when(usable(), F.col("value"))
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    return scores.groupBy(by).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_samp(v).alias("sd"), F.count_if(usable()).alias("included"), F.count_if(usable() & (F.col("value") >= 0.5)).alias("successes"), F.count("*").alias("total"), *counts)


def population(scores: DataFrame, by: str = "metric") -> DataFrame:
    """Terminal counts: a scored row that isn't valid is an error."""
    s = F.when((F.col("status") == "scored") & (F.col("validity") != "valid"), "error").otherwise(F.col("status"))
    return scores.groupBy(by).agg(*[F.count_if(s == x).alias(f"n_{x}") for x in STATUSES])


def medians(scores: DataFrame, by: str = "metric") -> DataFrame:
    """Exact medians of usable values, by radix selection."""
    return select.median(scores.filter(usable()), by)


def mean_interval(agg: DataFrame, level: float = 0.95, low: float | None = None, high: float | None = None) -> DataFrame:
    """Adds Student-t bounds, clamped to a score range where one is given; NULL below two values."""
    half = stats.t_column(F.col("included") - 1, level) * F.col("sd") / F.sqrt(F.col("included"))
    lo, hi = clamped(F.col("mean") - half, low, None), clamped(F.col("mean") + half, None, high)
    return agg.withColumn("lower", F.round(lo, stats.PLACES)).withColumn("upper", F.round(hi, stats.PLACES))


SMALL = 5


def estimates(agg: DataFrame, specs: DataFrame, level: float = 0.95) -> DataFrame:
    """agg of aggregated(), specs: metric, aggregation, score_type, low, high. (metric, point, n, method, lower, upper,
    code, bound): a proportion has a Wilson interval and, where all outcomes are the same, the bound of the rule of three;
    a mean of other scores has a Student-t one, clamped to the score range; order statistics have none, and a code."""
    a = agg.join(F.broadcast(specs), "metric")
    how, n = F.col("aggregation"), F.col("included")
    point = F.when(how.isin("mean", "rate"), F.col("mean")).when(how == "median", F.col("median")).when(how == "min", F.col("min")).when(how == "max", F.col("max"))
    share = (F.col("score_type") == "binary") & how.isin("mean", "rate")
    a = mean_interval(a, level).withColumnsRenamed({"lower": "t_lower", "upper": "t_upper"})
    w_lower, w_upper = stats.wilson(F.col("successes"), n, level)
    t_lower = F.when(F.col("t_lower").isNotNull(), F.greatest(F.col("t_lower"), F.coalesce("low", "t_lower")))
    t_upper = F.when(F.col("t_upper").isNotNull(), F.least(F.col("t_upper"), F.coalesce("high", "t_upper")))
    empty = point.isNull() | (n == 0)
    student = how == "mean"
    pick = lambda w, t: F.when(empty, None).when(share, w).when(student, t)
    method = F.when(empty, "none").when(share, "wilson").when(student & (n > 1), "student_t").otherwise("none")
    same = share & F.col("successes").isin(0) | share & (F.col("successes") == n)
    code = F.when(empty, None).when(same, "rule_of_three").when(share, None).when(student, F.when(n < SMALL, "low_reliability_small_n")).otherwise("no_interval_for_aggregation")
    return a.select("metric", point.alias("point"), n.alias("n"), method.alias("method"), pick(w_lower, t_lower).alias("lower"), pick(w_upper, t_upper).alias("upper"), code.alias("code"), F.when(~empty & same, stats.rule_of_three(n)).alias("bound"))


def clusters(diagnostics: DataFrame) -> DataFrame:
    """diagnostics: metric, score_id, code, severity, message; one vote for each score and code."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    one = diagnostics.groupBy("metric", "score_id", "code").agg(F.min(F.struct((-rank).alias("r"), "message")).alias("best"))
    out = one.groupBy("metric", "code").agg(F.count("*").alias("n"), F.min("best").alias("best"))
    return out.select("metric", "code", "n", F.when(F.col("best.r") == -2, "error").when(F.col("best.r") == -1, "warning").otherwise("info").alias("severity"), F.col("best.message").alias("message"))


def confusion(pred: Column, gold: Column) -> list[Column]:
    return [F.count_if(pred & gold).alias("tp"), F.count_if(pred & ~gold).alias("fp"), F.count_if(~pred & gold).alias("fn"), F.count_if(~pred & ~gold).alias("tn")]


def kappa() -> tuple[Column, Column]:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    po = (tp + tn) / F.nullif(n, F.lit(0.0))
    pe = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / F.nullif(n * n, F.lit(0.0))
    return po, F.when(pe >= 1, F.lit(1.0)).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0)))
