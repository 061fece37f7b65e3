"""Checks of stored summaries against the scores they come from. Each gives the rows that disagree; none: the record holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugework.functions.values import close
from gaugework.operators import aggregate as A

COUNTS = [f"n_{s}" for s in A.STATUSES]


def aggregates(stored: DataFrame, scores: DataFrame) -> DataFrame:
    """stored: metric, aggregation, value, included, n_ for each status. Values agree within the tolerance, counts exactly.
    A stored metric without scores disagrees unless it is empty; scores without a stored metric aren't asked for."""
    again = A.aggregated(scores, median=True)
    j = stored.alias("s").join(again.alias("a"), F.col("s.metric") == F.col("a.metric"), "left")
    how = F.col("s.aggregation")
    value = F.when(how.isin("mean", "rate"), F.col("a.mean")).when(how == "median", F.col("a.median")).when(how == "min", F.col("a.min")).when(how == "max", F.col("a.max"))
    same = close(F.col("s.value"), value) & (F.col("s.included") == F.coalesce("a.included", F.lit(0)))
    for c in COUNTS:
        same = same & (F.col(f"s.{c}") == F.coalesce(f"a.{c}", F.lit(0)))
    return j.filter(~F.coalesce(same, F.lit(False))).select("s.metric", F.col("s.value").alias("stored"), value.alias("recomputed"), F.col("s.included").alias("stored_included"), F.coalesce("a.included", F.lit(0)).alias("included"))


def estimates(stored: DataFrame, aggregated: DataFrame, scores: DataFrame) -> DataFrame:
    """stored: metric, point, n; aggregated: metric, value. The point is the aggregate's value, n the usable scores."""
    n = scores.groupBy("metric").agg(F.count_if(A.usable() & F.col("value").isNotNull()).alias("again"))
    j = stored.join(n, "metric", "left").join(aggregated.select("metric", F.col("value").alias("expected")), "metric", "left")
    wrong_n, wrong_point = F.col("n") != F.coalesce("again", F.lit(0)), ~close(F.col("point"), F.col("expected"))
    return j.filter(wrong_n | wrong_point).select("metric", F.when(wrong_n, "n_effective").otherwise("point").alias("problem"))


def clusters(stored: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Clusters that only one side has, in every column. A record without clusters isn't checked."""
    again = A.clusters(diagnostics).select(*stored.columns)
    out = stored.exceptAll(again).withColumn("side", F.lit("stored")).unionByName(again.exceptAll(stored).withColumn("side", F.lit("recomputed")))
    return out.join(F.broadcast(stored.limit(1).select(F.lit(True).alias("__any"))), how="left_semi")


def populations(stored: DataFrame, scores: DataFrame) -> DataFrame:
    """stored: metric, n_ for each status: the terminal counts."""
    again = A.population(scores)
    j = stored.alias("s").join(again.alias("a"), F.col("s.metric") == F.col("a.metric"), "left")
    wrong = [F.when(F.col(f"s.{c}") != F.coalesce(f"a.{c}", F.lit(0)), F.lit(c)) for c in COUNTS]
    return j.select("s.metric", F.array_join(F.array_compact(F.array(*wrong)), ",").alias("problem")).filter("problem <> ''")


def comparison_state(records: DataFrame) -> DataFrame:
    """records: run_id, comparison_state, baseline_state; both present and different, or a delta without a comparable state."""
    return records.filter("comparison_state IS NOT NULL AND baseline_state IS NOT NULL AND comparison_state <> baseline_state").select("run_id", F.lit("comparison_state").alias("problem"))


def evidence(scores: DataFrame, records: DataFrame) -> DataFrame:
    """scores: score_id, value, refs (array); records: evidence_id, status, ordinal, of which the last one of an id counts.
    Only refs that start with judge: are held against records; a value needs an ok one."""
    last = records.groupBy("evidence_id").agg(F.max_by("status", "ordinal").alias("status"))
    refs = scores.select("score_id", "value", F.explode("refs").alias("ref")).filter(F.col("ref").startswith("judge:"))
    j = refs.join(last, F.col("ref") == F.col("evidence_id"), "left")
    problem = F.when(F.col("evidence_id").isNull(), "dangling").when(F.col("value").isNotNull() & (F.col("status") != "ok"), "value_without_ok")
    return j.select("score_id", "ref", problem.alias("problem")).filter("problem IS NOT NULL")


def verdicts(records: DataFrame) -> DataFrame:
    """records: run_id, verdict, ci_should_fail, passing, failing, blocked (arrays): the verdict is the one its lists make."""
    want = F.when(F.size("blocked") > 0, "blocked").when(F.size("failing") > 0, "fail").when(F.size("passing") > 0, "pass").otherwise("informational")
    return records.filter((want != F.col("verdict")) | (F.col("ci_should_fail") != want.isin("blocked", "fail"))).select("run_id", "verdict", want.alias("expected"))


def studies(records: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """records: metric, tp, fp, fn, tn, agreement, kappa: the stored arithmetic of a rater study."""
    po, k = A.kappa()
    bad = lambda stored, again: ~F.coalesce(F.abs(F.col(stored) - again) <= tolerance, F.lit(False))
    return records.filter(bad("agreement", po) | bad("kappa", k)).select("metric")
