"""The scoring loop: metric specs over examples, one scan, one long score table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from gaugework.functions.values import merged
from gaugework.operators.scorers import once

SCORE = "struct<value:double,status:string,validity:string,code:string>"
INTEGRITY, NO_MATCH = "__route_integrity__", "__selector_no_match__"


@dataclass(frozen=True)
class Metric:
    """score builds the outcome from an example's columns. applies_to: allowed values by column, all of which must hold;
    sources binds it to some; low and high are its declared range; needs_reference is for planning alone."""

    name: str
    score: Callable[[], Column]
    applies_to: dict[str, list[str]] = field(default_factory=dict)
    sources: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    needs_reference: bool = False
    lower_is_better: bool = False


def matches(metric: Metric) -> Column:
    """Every key is among its values; a NULL matches nothing; the integrity row is scored by every metric."""
    ok = F.lit(True)
    for key, values in metric.applies_to.items():
        ok = ok & F.col(key).isin(*values)
    if metric.sources:
        ok = ok & F.col("source_name").isin(*metric.sources)
    return F.col("example_id").eqNullSafe(F.lit(INTEGRITY)) | F.coalesce(ok, F.lit(False))


def guarded(metric: Metric, score: Column) -> Column:
    """The route-error guard: an integrity row is an error of every metric, whatever the scorer says. A value outside the
    declared range ends the run. The score is evaluated once a row."""
    error = F.struct(F.lit(None).cast("double").alias("value"), F.lit("error").alias("status"), F.lit("not_measured").alias("validity"), F.lit("route_incomplete").alias("code"))
    fail = F.raise_error(F.lit(f"{metric.name}: value outside its declared range")).cast(SCORE)

    def held(s: Column) -> Column:
        low = F.lit(False) if metric.low is None else s["value"] < metric.low
        high = F.lit(False) if metric.high is None else s["value"] > metric.high
        return F.when(F.coalesce((s["status"] == "scored") & (low | high), F.lit(False)), fail).otherwise(s)

    plain = metric.low is None and metric.high is None
    return F.when(F.col("example_id").eqNullSafe(F.lit(INTEGRITY)), error).otherwise(score.cast(SCORE) if plain else once(score.cast(SCORE), held))


def scored(examples: DataFrame, metrics: list[Metric], keys: tuple[str, ...] = ("example_id", "unit_id")) -> DataFrame:
    """(keys, metric, value, status, validity, code): a row for each example and each metric that it matches. One scan, no
    product: the metrics of an example are an array that is laid out."""
    names = [m.name for m in metrics]
    if len(set(names)) < len(names):
        raise ValueError("metric names must be unique")
    every = [F.when(matches(m), F.struct(F.lit(m.name).alias("metric"), guarded(m, m.score()).alias("s"))) for m in metrics]
    rows = examples.select(*keys, F.explode(F.array(*every)).alias("m")).filter("m IS NOT NULL")
    return rows.select(*keys, "m.metric", "m.s.value", "m.s.status", "m.s.validity", "m.s.code")


def with_gaps(scores: DataFrame, metrics: list[Metric], examples: DataFrame) -> DataFrame:
    """scores and, for each metric with a selector that matched no example, one row that says so. Only selectors are
    evaluated for it, in one aggregation over the examples."""
    chosen = [m for m in metrics if m.applies_to or m.sources]
    if not chosen:
        return scores
    own = examples.filter(~F.col("example_id").eqNullSafe(F.lit(INTEGRITY)))
    seen = own.agg(*[F.coalesce(F.bool_or(matches(m)), F.lit(False)).alias(f"m{i}") for i, m in enumerate(chosen)])
    gone = seen.select(F.explode(F.array_compact(F.array(*[F.when(~F.col(f"m{i}"), m.name) for i, m in enumerate(chosen)]))).alias("metric"))
    literal = {"value": F.lit(None).cast("double"), "status": F.lit("non_evaluable"), "validity": F.lit("not_applicable"), "code": F.lit("selector.no_match")}
    rest = {c: F.lit(NO_MATCH).cast(t) if c in ("example_id", "unit_id") else F.lit(None).cast(t) for c, t in scores.dtypes if c not in literal and c != "metric"}
    return scores.unionByName(gone.select(*[({**literal, **rest, "metric": F.col("metric")})[c].alias(c) for c in scores.columns]))


def with_integrity(examples: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """examples and, if there is any diagnostic of the route, one integrity row."""
    row = diagnostics.limit(1).select(*[(F.lit(INTEGRITY) if c == "example_id" else F.lit(None)).cast(t).alias(c) for c, t in examples.dtypes])
    return examples.unionByName(row)


def flattened(batches: DataFrame, emits: dict[str, list[str]]) -> DataFrame:
    """batches: example_id, metric, refs, scores (array of struct<metric, value, status, validity, refs>). A row for each
    member, its refs before the batch's; a member that its metric doesn't declare ends the run."""
    declared = F.create_map(*[x for k, v in emits.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = batches.select("example_id", F.col("metric").alias("of"), F.col("refs").alias("shared"), F.explode("scores").alias("s"))
    known = F.coalesce(F.array_contains(declared[F.col("of")], F.col("s.metric")), F.lit(False))
    name = F.when(known, F.col("s.metric")).otherwise(F.raise_error(F.concat(F.lit("undeclared score "), F.col("s.metric"))).cast("string"))
    return rows.select("example_id", name.alias("metric"), "s.value", "s.status", "s.validity", merged(F.col("s.refs"), F.col("shared")).alias("refs"))


def from_traces(units: DataFrame) -> DataFrame:
    """Examples of trace units: trace_id, unit_id, source, data_policy, behavior (VARIANT), metadata."""
    get = lambda k: F.try_variant_get("behavior", f"$['{k}']", "variant")
    return units.select(F.col("unit_id").alias("example_id"), "unit_id", "trace_id", get("input").alias("input"), get("output").alias("output"), F.lit(None).cast("variant").alias("reference"), F.col("source").alias("trace_source"), "metadata", F.col("data_policy").isin("permitted", "redacted").alias("egress_ok"))


def without_raw(evidence: DataFrame, keep: bool = False) -> DataFrame:
    """Raw responses leave the record unless they were asked for."""
    return evidence if keep else evidence.withColumn("raw_response", F.lit(None).cast("string"))


def grouped(units: DataFrame) -> DataFrame:
    """Calls of a trace as one trajectory: units has trace_id, unit_id, ordinal, input, output, egress_ok. Arrays are in the
    calls' order, NULLs kept; a trace may leave the process only if all its calls may; first is the place of its first
    call, by which traces are ordered. A trace's calls meet in one row, so it must fit a task."""
    a = units.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "unit_id", "input", "output"))).alias("calls"), F.every("egress_ok").alias("egress_ok"), F.min("ordinal").alias("first"))
    each = lambda c: F.transform("calls", lambda x: x[c])
    return a.select("trace_id", each("unit_id").alias("members"), each("input").alias("inputs"), each("output").alias("outputs"), "egress_ok", "first")
