"""Judge effects: the plan of calls, cache, budget, the offline judge, parsing and evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugework.functions.values import at_path, clamped, unfenced
from gaugework.operators.scan import running

RESULT = "struct<status:string,value:double,raw:string,rationale:string,code:string>"
RETRIED = ("timeout", "provider_error")


def request_key(*parts: Column) -> Column:
    """Content address of a request: equal requests of any run share it; NULL differs from an empty text."""
    marked = [F.when(p.isNull(), "-").otherwise(F.concat(F.lit("+"), F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"))) for p in parts]
    return F.sha2(F.concat_ws("|", *marked).cast("binary"), 256)


def result(status: Column | str, value: Column | None = None, raw: Column | None = None, rationale: Column | None = None, code: str | None = None) -> Column:
    status = F.lit(status) if isinstance(status, str) else status
    none = F.lit(None)
    return F.struct(status.alias("status"), (none if value is None else value).cast("double").alias("value"), (none if raw is None else raw).cast("string").alias("raw"), (none if rationale is None else rationale).cast("string").alias("rationale"), F.lit(code).cast("string").alias("code"))


def offline_judge(directive: Column, default: float | None = None) -> Column:
    """The answer that a directive (VARIANT, or NULL) in an example's context stands for. Any unknown mode is a provider's
    error; a value that is no finite number is malformed; nothing is ever made up."""
    get = lambda k: at_path(directive, k)
    is_object = F.coalesce(F.schema_of_variant(directive).startswith("OBJECT"), F.lit(False))
    mode = F.when(is_object & get("mode").isNotNull(), get("mode").cast("string")).otherwise("ok")
    value, kind = get("value"), F.schema_of_variant(get("value"))
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    amount = F.try_variant_get(value, "$", "double")
    given = F.when(is_object & value.isNotNull(), F.when(number, amount)).otherwise(F.lit(default))
    absent = F.when(is_object & value.isNotNull(), kind == "VOID").otherwise(F.lit(default is None))
    finite = given.isNotNull() & ~F.isnan(given) & (F.abs(given) < float("inf"))
    rationale = F.when(is_object, F.try_variant_get(get("rationale"), "$", "string"))
    ok = F.when(absent, result("missing", code="judge_missing_response")).when(~F.coalesce(finite, F.lit(False)), result("malformed", code="judge_unparseable_value")).otherwise(result("ok", given, F.to_json(F.struct(given.alias("score"), rationale.alias("rationale"))), rationale))
    out = F.when(mode == "ok", ok)
    for name, code in (("timeout", "judge_timeout"), ("provider_error", "judge_provider_error"), ("missing", "judge_missing_response")):
        out = out.when(mode == name, result(name, code=code))
    out = out.when(mode == "malformed", result("malformed", raw=F.coalesce(F.try_variant_get(get("raw"), "$", "string"), F.lit("not json")), code="judge_malformed_response"))
    return out.otherwise(result("provider_error", code="judge_unknown_mode"))


@dataclass(frozen=True)
class Rubric:
    """criteria: type (score, boolean or label) by name; labels of the label criteria."""

    criteria: dict[str, str]
    labels: dict[str, tuple[str, ...]]
    allow_violations: bool = True
    allow_citations: bool = True
    require_citations: bool = False


def parsed(raw: Column, rubric: Rubric, dossier: Column) -> Column:
    """struct<status, score, facets, violations, citations, refusal, problem> of a judge's JSON text, fenced or not. A
    refusal, missing evidence and a parser's error carry no score; undeclared facets and citations outside the dossier
    (array of texts) are errors."""
    # a lambda's variable, so that the text is parsed once
    return F.get(F.transform(F.array(F.try_parse_json(unfenced(raw))), lambda doc: _parsed(doc, rubric, dossier)), F.lit(0))


def _parsed(doc: Column, rubric: Rubric, dossier: Column) -> Column:
    get = lambda k: at_path(doc, k)
    kind = lambda v: F.schema_of_variant(v)
    is_number = lambda v: F.coalesce(kind(v).isin("BIGINT", "DOUBLE", "FLOAT") | kind(v).startswith("DECIMAL"), F.lit(False))
    refusal = get("refusal")
    declined = F.coalesce((kind(get("refused")) == "BOOLEAN") & (F.try_variant_get(get("refused"), "$", "boolean")), F.lit(False)) | (refusal.isNotNull() & (kind(refusal) != "VOID") & ~F.coalesce((kind(refusal) == "BOOLEAN") & ~F.try_variant_get(refusal, "$", "boolean"), F.lit(False)))
    missing = F.coalesce((kind(get("missing_evidence")) == "BOOLEAN") & F.try_variant_get(get("missing_evidence"), "$", "boolean"), F.lit(False))
    given = F.when(get("score").isNotNull(), get("score")).otherwise(get("value"))
    score = F.when(is_number(given), F.try_variant_get(given, "$", "double"))
    score = F.when(~F.isnan(score) & (F.abs(score) < float("inf")), score)
    facets = get("facets")
    bad_facet = F.lit(False)
    for name, of in rubric.criteria.items():
        v = at_path(facets, name)
        good = is_number(v) if of == "score" else kind(v) == "BOOLEAN" if of == "boolean" else (kind(v) == "STRING") & F.try_variant_get(v, "$", "string").isin(*rubric.labels.get(name, ()))
        bad_facet = bad_facet | (v.isNotNull() & ~F.coalesce(good, F.lit(False)))
    keys = F.json_object_keys(F.to_json(facets))
    undeclared = F.size(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, rubric.criteria)).cast("array<string>"))) > 0
    texts = lambda v: F.when(v.isNull() | (kind(v) == "VOID"), F.array().cast("array<string>")).when(kind(v).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(v, "$", "array<string>"))
    violations, citations = texts(get("violations")), texts(get("citations"))
    has_facets = facets.isNotNull() & (kind(facets) != "VOID")
    problem = (
        F.when(~F.coalesce(kind(doc).startswith("OBJECT"), F.lit(False)), "not_an_object")
        .when(score.isNull(), "no_finite_score")
        .when(has_facets & ~kind(facets).startswith("OBJECT"), "facets_not_a_mapping")
        .when(has_facets & undeclared, "undeclared_facet")
        .when(has_facets & bad_facet, "invalid_facet")
        .when(violations.isNull(), "violations_not_texts")
        .when((F.size(violations) > 0) & ~F.lit(rubric.allow_violations), "violations_not_allowed")
        .when(citations.isNull(), "citations_not_texts")
        .when((F.size(citations) > 0) & ~F.lit(rubric.allow_citations), "citations_not_allowed")
        .when(F.size(F.array_except(citations, dossier)) > 0, "unresolved_citation")
        .when((F.size(citations) == 0) & F.lit(rubric.require_citations), "citation_required")
    )
    of_object = F.coalesce(kind(doc).startswith("OBJECT"), F.lit(False))
    status = F.when(of_object & declined, "refused").when(of_object & missing, "missing_evidence").when(problem.isNotNull(), "parser_error").otherwise("ok")
    fine = status == "ok"
    return F.struct(status.alias("status"), F.when(fine, clamped(score, 0, 1)).alias("score"), F.when(fine, F.to_json(facets)).alias("facets"), F.when(fine, violations).alias("violations"), F.when(fine, citations).alias("citations"), F.when(status == "refused", F.try_variant_get(refusal, "$", "string")).alias("refusal"), F.when(status == "parser_error", problem).alias("problem"))


def cost(tokens: Column, price_per_thousand: Column) -> Column:
    """NULL where either is unknown: an unknown cost is not free."""
    return tokens / 1000 * price_per_thousand


def within_budget(effects: DataFrame, ordinal: str, amounts: dict[str, tuple[Column, float]], by: tuple[str, ...] = ()) -> DataFrame:
    """effects with dispatched: whether every running sum before an effect is below its limit. Effects run in order, so
    a stop holds for all that follow. Sums are of decimals to twelve places and so exact in any partitioning; a group,
    and a run is one, is dealt over tasks by ranges of its order."""
    sums = {f"__spent_{k}": F.round(a, 12).cast("decimal(28,12)") for k, (a, _) in amounts.items()}
    out = running(effects, (ordinal,), sums, by)
    ok = reduce(lambda c, k: c & (F.col(f"__spent_{k}") < F.lit(amounts[k][1]).cast("decimal(28,12)")), amounts, F.lit(True))
    return out.select(*effects.columns, ok.alias("dispatched"))


def answered(effects: DataFrame, cache: DataFrame | None, judge: Column, mode: str = "read_write", attempts: int = 3) -> DataFrame:
    """effects: example_id, metric, key, permitted, dispatched and what the judge column reads. Adds result, cache_state and
    attempts. A denied effect is missing evidence, one beyond the budget too, whatever the cache holds; a cached answer
    (key, result) is not asked for again unless mode is refresh; timeouts and provider's errors are tried again."""
    reads = cache is not None and mode in ("read_write", "read_only")
    j = effects.join(cache.select("key", F.col("result").alias("cached")), "key", "left") if reads else effects.withColumn("cached", F.lit(None).cast(RESULT))
    denied, spent = ~F.col("permitted"), ~F.col("dispatched")
    hit = F.col("cached").isNotNull()
    j = j.withColumn("asked", F.when(~denied & ~spent & ~hit, judge.cast(RESULT)))
    out = F.when(denied, result("missing", code="judge_egress_forbidden").cast(RESULT)).when(spent, result("missing", code="judge_budget_exhausted").cast(RESULT)).when(hit, F.col("cached")).otherwise(F.col("asked"))
    state = F.when(denied | spent, None).when(F.lit(not reads and mode == "off"), "disabled").when(hit, "hit").otherwise("miss")
    tries = F.when(denied | spent | hit, 0).when(F.col("asked.status").isin(*RETRIED), attempts).otherwise(1)
    return j.withColumns({"result": out, "cache_state": state, "attempts": tries}).drop("cached", "asked")


def to_cache(found: DataFrame, cache: DataFrame | None) -> DataFrame:
    """New rows of the cache: usable answers whose key it lacks, once each."""
    fresh = found.filter((F.col("cache_state") == "miss") & (F.col("result.status") == "ok")).groupBy("key").agg(F.any_value("result").alias("result"))
    return fresh if cache is None else fresh.join(cache, "key", "left_anti")


def evidence(found: DataFrame) -> DataFrame:
    """(evidence_id, example_id, metric, status, value, code, cache_state, attempts); a value stands only beside ok."""
    ok = F.col("result.status") == "ok"
    return found.select(F.concat(F.lit("judge:"), F.col("example_id").cast("string"), F.lit(":"), F.col("metric")).alias("evidence_id"), "example_id", "metric", F.col("result.status").alias("status"), F.when(ok, F.col("result.value")).alias("value"), F.col("result.code").alias("code"), "cache_state", "attempts")


def external(effects: DataFrame, call: Callable[[dict], dict], attempts: int = 3) -> DataFrame:
    """Rows of effects (key and what call reads) through a host's judge: call gives status, value, raw, rationale. Only this
    path runs Python. A call may run again after a lost executor; the cache and the key keep its answer one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                for n in range(1, attempts + 1):
                    try:
                        got = call(row)
                    except Exception as e:  # a judge's fault is evidence of it, never a score
                        got = {"status": "provider_error", "code": type(e).__name__}
                    if got.get("status") not in RETRIED:
                        break
                out.append((row["key"], got.get("status"), got.get("value"), got.get("raw"), got.get("rationale"), got.get("code"), n))
            kinds = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["key", "status", "value", "raw", "rationale", "code", "attempts"])

    return effects.mapInArrow(rows, "key string, status string, value double, raw string, rationale string, code string, attempts bigint")
