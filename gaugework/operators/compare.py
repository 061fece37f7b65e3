"""Comparison with a baseline: state, paired differences, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugework.operators import aggregate as A
from gaugework.operators.joins import paired

#: Fixed value: the parts of a run that must agree before two runs are compared.
GATING = ("metric", "evaluator", "dataset", "example", "config", "authority")


def changed_dimensions(current: DataFrame, baseline: DataFrame, gating: tuple[str, ...] | None = None) -> DataFrame:
    """(dimension, changed) of fingerprints (dimension, digest); a dimension that either side lacks counts as changed."""
    out = current.select("dimension", F.col("digest").alias("a")).join(baseline.select("dimension", F.col("digest").alias("b")), "dimension", "full")
    if gating is not None:
        wanted = out.sparkSession.createDataFrame([(g,) for g in gating], "dimension string")
        out = F.broadcast(wanted).join(out, "dimension", "left")
    return out.select("dimension", (F.col("a").isNull() | F.col("b").isNull() | (F.col("a") != F.col("b"))).alias("changed"))


def baseline_state(requested: Column, has_baseline: Column, any_changed: Column) -> Column:
    return F.when(~requested, "comparison_not_requested").when(~has_baseline, "missing_baseline").when(any_changed, "not_comparable").otherwise("comparable")


def deltas(pairs: DataFrame, lower_is_better: Column, level: float = 0.95) -> DataFrame:
    """pairs: metric, now, then. (metric, n_paired, delta, adjusted, lower, upper, outcome): Student-t interval of the
    differences; an interval that holds zero is noise, and one pair alone leaves the outcome unresolved."""
    d = pairs.select("metric", (F.col("now") - F.col("then")).alias("value"), F.lit("scored").alias("status"), F.lit("valid").alias("validity"))
    a = A.mean_interval(A.aggregated(d), level).withColumn("down", lower_is_better)
    better = (F.col("mean") > 0) != F.col("down")
    out = F.when(F.col("lower").isNull(), "unresolved").when((F.col("lower") <= 0) & (F.col("upper") >= 0), "within_noise").when(better, "improvement").otherwise("regression")
    return a.select("metric", F.col("included").alias("n_paired"), F.col("mean").alias("delta"), F.when(F.col("down"), -F.col("mean")).otherwise(F.col("mean")).alias("adjusted"), "lower", "upper", out.alias("outcome"))


def compared(current: DataFrame, baseline: DataFrame, directions: DataFrame, level: float = 0.95) -> DataFrame:
    """directions: metric, lower_is_better. deltas() of every metric of either run, metrics without a pair unresolved and
    those without a direction skipped: their outcome is NULL."""
    named = current.select("metric").union(baseline.select("metric")).distinct().join(F.broadcast(directions), "metric", "left")
    known = F.broadcast(directions)
    pairs = paired(current.join(known, "metric", "left_semi"), baseline.join(known, "metric", "left_semi"))
    down = named.filter("lower_is_better").select("metric", F.lit(True).alias("down_"))
    got = deltas(pairs.join(F.broadcast(down), "metric", "left"), F.lit(False), level)
    out = named.join(got, "metric", "left")
    low, flip = F.col("lower_is_better"), F.when(F.col("outcome") == "improvement", "regression").when(F.col("outcome") == "regression", "improvement").otherwise(F.col("outcome"))
    outcome = F.when(low.isNull(), None).when(F.col("n_paired").isNull(), "unresolved").when(low, flip).otherwise(F.col("outcome"))
    return out.select("metric", low.isNull().alias("skipped"), F.coalesce("n_paired", F.lit(0)).alias("n_paired"), "delta", F.when(low, -F.col("delta")).otherwise(F.col("delta")).alias("adjusted"), "lower", "upper", outcome.alias("outcome"))


def drift(state: Column, regressed: Column) -> Column:
    """struct<code, severity, metrics>: state of the comparison and the sorted list of regressed metrics."""
    made = lambda c, s="info", m=None: F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), (m if m is not None else F.array().cast("array<string>")).alias("metrics"))
    return F.when(state.isin("missing_baseline", "comparison_not_requested"), made("drift.missing_baseline")).when(state == "not_comparable", made("drift.not_comparable")).when(F.size(regressed) > 0, made("drift.regression", "warning", regressed)).otherwise(made("drift.no_comparable_regression"))


def regressions(found: DataFrame) -> DataFrame:
    """One row: the sorted metrics that regressed, and the examples that both runs share at most."""
    return found.agg(F.array_sort(F.collect_list(F.when(F.col("outcome") == "regression", F.col("metric")))).alias("regressed"), F.coalesce(F.max("n_paired"), F.lit(0)).alias("shared"))
