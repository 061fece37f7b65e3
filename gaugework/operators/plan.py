"""The plan of a run: subjects, populations before any effect, effects, and what ran against what was planned."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugework.operators.scan import numbered
from gaugework.operators.scoring import INTEGRITY, Metric, matches


def subjects(examples: DataFrame, *order: str) -> DataFrame:
    """examples with subject_id s0, s1, ... in the given order."""
    out = numbered(examples, order, "__number")
    return out.withColumn("subject_id", F.concat(F.lit("s"), F.col("__number").cast("string"))).drop("__number")


def ledger(examples: DataFrame, metrics: list[Metric]) -> DataFrame:
    """(metric, available, matched, selector_excluded, eligible, prerequisite_excluded): one pass over the examples. A
    metric that needs a reference can't use examples without one. Every two parts add up to their whole."""
    own = ~F.col("example_id").eqNullSafe(F.lit(INTEGRITY))
    rows = []
    for m in metrics:
        hit = own & matches(m)
        fit = hit & (F.col("reference").isNotNull() if m.needs_reference else F.lit(True))
        rows.append(F.struct(F.lit(m.name).alias("metric"), own.cast("int").alias("a"), hit.cast("int").alias("m"), fit.cast("int").alias("e")))
    x = examples.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    total = x.groupBy("metric").agg(*[F.sum(c).alias(n) for c, n in (("a", "available"), ("m", "matched"), ("e", "eligible"))])
    return total.select("metric", "available", "matched", (F.col("available") - F.col("matched")).alias("selector_excluded"), "eligible", (F.col("matched") - F.col("eligible")).alias("prerequisite_excluded"))


def judge_effects(examples: DataFrame, metrics: list[Metric]) -> DataFrame:
    """(example_id, metric, permitted): a call for each eligible example of each judged metric, none for integrity rows;
    data that may not leave the process is denied before any call."""
    own = ~F.col("example_id").eqNullSafe(F.lit(INTEGRITY))
    every = [F.when(own & matches(m) & (F.col("reference").isNotNull() if m.needs_reference else F.lit(True)), F.lit(m.name)) for m in metrics]
    rows = examples.select("example_id", F.explode(F.array_compact(F.array(*every))).alias("metric"), F.col("egress_ok").alias("permitted"))
    return rows


def replay_effects(examples: DataFrame, metrics: list[Metric]) -> DataFrame:
    """(example_id, permitted): examples without an output that any metric wants."""
    wanted = F.lit(False)
    for m in metrics:
        wanted = wanted | matches(m)
    own = ~F.col("example_id").eqNullSafe(F.lit(INTEGRITY))
    return examples.filter(own & F.col("output").isNull() & wanted).select("example_id", F.col("egress_ok").alias("permitted"))


def reconcile(planned: DataFrame, executed: DataFrame, *keys: str) -> DataFrame:
    """Rows that only one side has, with the code that says which."""
    keys = list(keys)
    a = planned.select(*keys).distinct().join(executed.select(*keys).distinct(), keys, "left_anti").withColumn("code", F.lit("planned_not_executed"))
    return a.unionByName(executed.select(*keys).distinct().join(planned.select(*keys).distinct(), keys, "left_anti").withColumn("code", F.lit("executed_not_planned")))


def enriched(populations: DataFrame, plan: DataFrame) -> DataFrame:
    """Terminal counts beside those of the plan; a metric that the plan lacks keeps its own with NULLs."""
    return populations.join(plan, "metric", "left")


def preflight(effects: DataFrame, tokens_per_call: int, prices: DataFrame) -> DataFrame:
    """(metric, calls, denied, cost_bound): the most a run can cost before it is started; NULL where no price is known."""
    n = effects.groupBy("metric").agg(F.count_if("permitted").alias("calls"), F.count_if(~F.col("permitted")).alias("denied"))
    return n.join(F.broadcast(prices), "metric", "left").select("metric", "calls", "denied", (F.col("calls") * F.lit(tokens_per_call) / 1000 * F.col("price")).alias("cost_bound"))
