"""Projections for dashboards, explorers and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugework.operators.aggregate import usable

TOP = 200


def metric_state(value: Column, included: Column, n_error: Column, n_blocked: Column, n_non_evaluable: Column, n_skipped: Column) -> Column:
    """struct<status, validity, value>: scored only with a value; otherwise the worst of the terminal counts, never a zero."""
    made = lambda s, v: F.struct(F.lit(s).alias("status"), F.lit(v).alias("validity"), F.lit(None).cast("double").alias("value"))
    scored = F.struct(F.lit("scored").alias("status"), F.lit("valid").alias("validity"), value.cast("double").alias("value"))
    return F.when(value.isNotNull() & (included > 0), scored).when(n_error > 0, made("error", "invalid")).when(n_blocked > 0, made("blocked", "not_measured")).when(n_non_evaluable > 0, made("non_evaluable", "not_measured")).when(n_skipped > 0, made("skipped", "not_applicable")).otherwise(made("non_evaluable", "not_measured"))


def attention(value: Column, below: Column, above: Column) -> Column:
    return F.coalesce(value < below, F.lit(False)) | F.coalesce(value > above, F.lit(False))


def tier(declared: Column, needs_judge: Column, lens: Column) -> Column:
    return F.when(declared.isNotNull(), declared).when(needs_judge, "judge").when(lens == "reference", "reference").otherwise("runtime")


def dashboard(config: DataFrame, estimates: DataFrame, populations: DataFrame, deltas: DataFrame) -> DataFrame:
    """config: metric, workflow, place (NULL: last), tier, needs_judge, lens, below, above. A row for each configured
    metric, in the order of place, workflow and name; what a metric lacks is NULL."""
    j = config
    for other in (estimates, populations, deltas):
        j = j.join(other, "metric", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    state = metric_state(F.col("point"), zero("n"), *[zero(f"n_{s}") for s in ("error", "blocked", "non_evaluable", "skipped")])
    out = j.withColumn("state", state)
    order = (F.coalesce("place", F.lit(1_000_000)), F.coalesce("workflow", F.lit("")), F.col("metric"))
    rows = out.select(*[c.alias(f"__{i}") for i, c in enumerate(order)], "metric", F.coalesce("workflow", F.lit("general")).alias("workflow"), tier(F.col("tier"), F.col("needs_judge"), F.col("lens")).alias("tier"), "state.status", "state.validity", "state.value", "lower", "upper", "outcome", attention(F.col("state.value"), F.col("below"), F.col("above")).alias("flagged"))
    return rows.orderBy("__0", "__1", "__2").drop("__0", "__1", "__2")


def first_calls(scores: DataFrame, ordinal: str, limit: int = TOP) -> tuple[DataFrame, DataFrame]:
    """(the first calls of each metric, without those that have no id; metric, omitted). Calls without an id take a place
    among the first ones. Ranks are limited as they are made, so a metric's other calls are never sorted whole."""
    w = W.partitionBy("metric").orderBy(ordinal)
    shown = scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).filter("example_id IS NOT NULL")
    return shown, scores.groupBy("metric").agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("omitted"))


def explorer(scores: DataFrame, ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(example_id, unit_id, row) by call, metrics in order with a value only where it was measured; rows without an
    identity as diagnostics."""
    known = F.coalesce(F.col("example_id").cast("string"), F.lit("")) != ""
    one = F.struct("metric", F.col(ordinal).alias("ordinal"), F.when(usable(), F.col("value")).alias("value"), "status")
    calls = scores.filter(known).groupBy("example_id", F.coalesce(F.col("unit_id").cast("string"), F.lit("")).alias("unit_id")).agg(F.array_sort(F.collect_list(one)).alias("row"))
    return calls, scores.filter(~known).select("metric", F.lit("score_without_identity").alias("code"))


def series_points(entries: DataFrame) -> DataFrame:
    """Entries of each series, oldest first by ordinal, with the last verified run before each."""
    w = W.partitionBy("series_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    return entries.withColumn("previous", F.last(F.when(F.col("verified"), F.col("run_key")), ignorenulls=True).over(w))


def evaluability(aggregated: DataFrame) -> DataFrame:
    return aggregated.agg(F.round(F.count_if(F.col("included") > 0) / F.nullif(F.count("*"), F.lit(0)), 10).alias("evaluability"), F.sum("total").alias("scores"))
