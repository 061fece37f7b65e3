"""Grants, authority, gates, the verdict and what follows from it, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: the order in which verdicts win.
PRECEDENCE = {"informational": 0, "pass": 1, "fail": 2, "blocked": 3}
#: Severity of data policies and standing of datasets, worst last.
POLICIES = ("permitted", "redacted", "unknown", "missing", "forbidden")
DATASETS = ("validated", "proposed", "retired")
#: Fixed value: what a grant may bind.
BINDINGS = ("decision_policy_sha256", "dataset_validation_sha256", "evaluator_capability_sha256", "study_evidence_sha256")


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """The texts whose conditions hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in pairs]), lambda x: x.isNotNull())


def grant(expires: Column, now: Column, pairs: dict[str, tuple[Column, Column]]) -> Column:
    """struct<status, mismatched>: expiry first, by ISO texts, and only where now is known; then every digest that the
    grant declares must be the run's. pairs: declared and current digest by name."""
    wrong = reasons(*[(a.isNotNull() & (b.isNull() | (a != b)), name) for name, (a, b) in pairs.items()])
    late = F.coalesce(now > expires, F.lit(False))
    status = F.when(late, "expired").when(F.size(wrong) > 0, "mismatched").otherwise("matched")
    return F.struct(status.alias("status"), F.when(late, F.array().cast("array<string>")).otherwise(wrong).alias("mismatched"))


def authority(metric_status: Column, threshold_approved: Column, dataset_status: Column, policy: Column, fake_judge: Column, grant_status: Column | None = None, calibration: Column | None = None, needs_baseline: Column | None = None, baseline_state: Column | None = None) -> Column:
    """struct<level, can_gate, blocked, reasons>: what keeps a metric from authority comes first, then what blocks it.
    grant_status: NULL without a grant; calibration: NULL for metrics without a judge. Any other input that is NULL is
    not known and counts as the worst: no authority comes from missing data."""
    none = F.lit(None).cast("string")
    shut = lambda c: F.coalesce(c, F.lit(True))
    named = lambda prefix, c: F.concat(F.lit(prefix), F.coalesce(c, F.lit("missing")))
    grant_status, calibration, baseline_state = (none if c is None else c for c in (grant_status, calibration, baseline_state))
    needs_baseline = F.lit(False) if needs_baseline is None else needs_baseline
    why = reasons(
        (shut(fake_judge), "judge_fake_non_authoritative"),
        (grant_status.isin("missing", "mismatched"), F.concat(F.lit("grant_"), grant_status)),
        (shut(metric_status != "gating"), named("metric_status=", metric_status)),
        (shut(~threshold_approved), "threshold_proposed"),
        (shut(dataset_status == "proposed"), "dataset_proposed"),
        (calibration.isin("uncalibrated", "calibrating"), F.concat(F.lit("judge_"), calibration)),
    )
    stops = reasons(
        (shut(~policy.isin("permitted", "redacted")), named("policy_", policy)),
        (calibration.isin("drifted", "retired"), F.concat(F.lit("judge_"), calibration)),
        (dataset_status == "retired", "dataset_retired"),
        (grant_status == "expired", "grant_expired"),
        (shut(needs_baseline) & ~F.coalesce(baseline_state == "comparable", F.lit(False)), named("baseline_", baseline_state)),
    )
    free = F.size(why) == 0
    blocked = free & (F.size(stops) > 0)
    return F.struct(F.when(free, "gating").otherwise("informational").alias("level"), (free & ~blocked).alias("can_gate"), blocked.alias("blocked"), F.when(free, stops).otherwise(why).alias("reasons"))


def worst(value: Column, order: tuple[str, ...], empty: str) -> Column:
    """Aggregate: the value that stands last in the order; values outside it count as the last."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0))
    rank = F.max(F.when(value.isNotNull(), F.when(place == 0, len(order)).otherwise(place)))
    return F.coalesce(F.element_at(F.array(*map(F.lit, order)), rank.cast("int")), F.lit(empty))


def scoped(bindings: DataFrame, sources: DataFrame) -> DataFrame:
    """bindings: metric, source (NULL: all of the run); sources: source, kind, data_policy, dataset_status. (metric, policy,
    dataset_status): the worst over the metric's own sources, or over the run; any trace source makes data proposed."""
    of = sources.withColumn("dataset_status", F.when(F.col("kind") == "trace", "proposed").otherwise(F.col("dataset_status")))
    bound = bindings.filter("source IS NOT NULL").join(of, "source", "left").select("metric", "data_policy", "dataset_status")
    whole = bindings.filter("source IS NULL").crossJoin(F.broadcast(of.agg(worst(F.col("data_policy"), POLICIES, "unknown").alias("data_policy"), worst(F.col("dataset_status"), DATASETS, "proposed").alias("dataset_status")))).select("metric", "data_policy", "dataset_status")
    return bound.unionByName(whole).groupBy("metric").agg(worst(F.col("data_policy"), POLICIES, "unknown").alias("policy"), worst(F.col("dataset_status"), DATASETS, "proposed").alias("dataset_status"))


def apply_policy(point: Column, n: Column, missing: Column, lower: Column, upper: Column, threshold: Column, higher: Column, min_n: int = 2, max_missing: float = 0.0, statistic: str = "bound") -> Column:
    """struct<verdict, reason>: with 'bound' the lower bound decides where higher is better, the upper bound otherwise;
    with 'point' the point does."""
    value = point if statistic == "point" else F.when(higher, lower).otherwise(upper)
    ok = F.when(higher, value >= threshold).otherwise(value <= threshold)
    made = lambda v, r: F.struct(F.lit(v).alias("verdict"), F.lit(r).cast("string").alias("reason"))
    low, high = ("point", "point") if statistic == "point" else ("lower_confidence_bound", "upper_confidence_bound")
    miss = F.when(higher, made("fail", f"{low}_below_threshold")).otherwise(made("fail", f"{high}_above_threshold"))
    return F.when(point.isNull(), made("blocked", "no_measured_value")).when(n < min_n, made("blocked", "insufficient_samples")).when(missing > max_missing, made("blocked", "excessive_missing_evidence")).when(value.isNull(), made("blocked", "decision_statistic_unavailable")).when(ok, made("pass", None)).otherwise(miss)


def apply_threshold(value: Column, excluded: Column, threshold: Column, higher: Column) -> Column:
    """struct<verdict, reason> of a gate without a policy: the point against its threshold, and no row may be excluded."""
    ok = F.when(higher, value >= threshold).otherwise(value <= threshold)
    made = lambda v, r: F.struct(F.lit(v).alias("verdict"), F.lit(r).cast("string").alias("reason"))
    return F.when(value.isNull(), made("blocked", "no_measured_value")).when(excluded > 0, made("blocked", "incomplete_measurement")).when(threshold.isNull(), made("blocked", "no_approved_threshold")).when(ok, made("pass", None)).when(higher, made("fail", "below_threshold")).otherwise(made("fail", "above_threshold"))


def gate(resolved: Column, outcome: Column) -> Column:
    """struct<verdict, reason>: a blocked authority blocks with its first reasons, one that may gate decides by the outcome,
    any other is informational."""
    made = lambda v, r: F.struct(F.lit(v).alias("verdict"), r.cast("string").alias("reason"))
    why = F.when(F.size(resolved["reasons"]) > 0, F.array_join(resolved["reasons"], ",")).otherwise("gate_blocked")
    return F.when(resolved["blocked"], made("blocked", why)).when(resolved["can_gate"], outcome).otherwise(made("informational", F.lit(None)))


def rank(verdict: Column) -> Column:
    out = F.lit(0)
    for name, r in PRECEDENCE.items():
        out = F.when(verdict == name, r).otherwise(out)
    return out


def decide(gates: DataFrame, order: str = "metric") -> DataFrame:
    """gates: metric, verdict, reason (NULL where there is none, or no such column) and the column that orders metrics. One row: the verdict of highest precedence
    (informational without gates), whether CI fails, the metrics of each kind, and the reasons of those that fail or are
    blocked, each in order. A run has as many gates as its configuration has metrics."""
    gates = gates if "reason" in gates.columns else gates.withColumn("reason", F.lit(None).cast("string"))
    top = F.coalesce(F.max(rank(F.col("verdict"))), F.lit(0))
    name = F.when(top == 3, "blocked").when(top == 2, "fail").when(top == 1, "pass").otherwise("informational")
    of = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.struct(F.col(order).alias("o"), "metric", "reason"))))
    lists = [F.array_join(F.transform(of(F.col("verdict") == v), lambda x: x["metric"]), ",").alias(n) for v, n in (("pass", "pass_gates"), ("fail", "fail_gates"), ("blocked", "blocked_gates"), ("informational", "informational_metrics"))]
    why = F.transform(of(F.col("verdict").isin("fail", "blocked")), lambda x: F.struct(x["metric"].alias("metric"), F.split(F.coalesce(x["reason"], F.lit("gate_blocked")), ",").alias("reasons")))
    return gates.agg(name.alias("verdict"), (top >= 2).alias("ci_should_fail"), *lists, why.alias("reasons"))


def exit_code(verdict: Column) -> Column:
    """struct<class, code>; NULL, a run that made no verdict, is an error of the infrastructure."""
    made = lambda c, n: F.struct(F.lit(c).alias("class"), F.lit(n).alias("code"))
    return F.when(verdict.isin("informational", "pass"), made("zero", 0)).when(verdict == "fail", made("nonzero_fail", 1)).when(verdict == "blocked", made("nonzero_blocked", 1)).otherwise(made("infrastructure_error", 2))


def calibration(status: Column, variance_runs: Column, agreement: Column, kappa: Column, least_agreement: float = 0.8, least_kappa: float = 0.6) -> Column:
    """The calibration that a study supports: a claim of 'calibrated' needs two variance runs and both measures at their
    limits, otherwise it is still calibrating; any other status stands as it is, none is uncalibrated."""
    proven = (variance_runs >= 2) & (agreement >= least_agreement) & (kappa >= least_kappa)
    return F.when(status.isNull(), "uncalibrated").when(status != "calibrated", status).when(F.coalesce(proven, F.lit(False)), "calibrated").otherwise("calibrating")


def supports_threshold(passed: Column, wants_approval: Column) -> Column:
    """Benchmark evidence may support a threshold; asked to approve one, it ends the run."""
    return F.when(F.coalesce(wants_approval, F.lit(False)), F.raise_error(F.lit("benchmark evidence cannot approve a threshold")).cast("boolean")).otherwise(F.coalesce(passed, F.lit(False)))
