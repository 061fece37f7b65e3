"""Built-in scorers as Column builders: each returns struct<value, status, validity, code>. No Python runs per row."""

from __future__ import annotations

from collections.abc import Callable
from json import dumps

from pyspark.sql import Column, functions as F

from gaugework.functions.pytext import python_text
from gaugework.functions.values import canonical, member
from gaugework.functions.words import tokens, words


def outcome(value: Column, status: str = "scored", validity: str = "valid", code: Column | str | None = None) -> Column:
    code = F.lit(code) if isinstance(code, str) or code is None else code
    return F.struct(value.cast("double").alias("value"), F.lit(status).alias("status"), F.lit(validity).alias("validity"), code.cast("string").alias("code"))


def unmeasured(code: str, status: str = "non_evaluable", validity: str | None = None) -> Column:
    """Without a validity: a score that cannot be made does not apply, a wrong one is invalid, a blocked one not measured."""
    return outcome(F.lit(None), status, validity or {"non_evaluable": "not_applicable", "error": "invalid"}.get(status, "not_measured"), code)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is evaluated one time, as a lambda's variable, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def flag(ok: Column, code: str | None = None) -> Column:
    """1 or 0; a miss carries the code."""
    return outcome(ok.cast("double"), code=F.when(~ok, F.lit(code)) if code else None)


def exact_match(output: Column, reference: Column, json: bool = False) -> Column:
    """json: both are VARIANTs, of which a JSON null is no value; objects and lists are equal by members, numbers by value."""
    if json:
        null = lambda v: F.schema_of_variant(v) == "VOID"
        output, reference = (F.when(~null(v), canonical(v)) for v in (output, reference))
        return once(F.struct(output.alias("o"), reference.alias("r")), lambda x: exact_match(x["o"], x["r"]))
    return F.when(output.isNull(), unmeasured("exact_match.no_output")).when(reference.isNull(), unmeasured("exact_match.no_reference")).otherwise(flag(output == reference))


def set_overlap_json(output: Column, reference: Column) -> Column:
    """Of JSON values of any kind, each as its text: the words of what Python's str() gives. JSON nulls are no values."""
    return once(F.struct(python_text(output).alias("o"), python_text(reference).alias("r")), lambda x: set_overlap(x["o"], x["r"]))


def set_overlap(output: Column, reference: Column) -> Column:
    sizes = once(F.struct(tokens(output).alias("a"), tokens(reference).alias("b")), lambda x: F.struct(F.size(x["a"]).alias("a"), F.size(x["b"]).alias("b"), F.size(F.array_intersect(x["a"], x["b"])).alias("both")))
    value = once(sizes, lambda x: F.when(x["a"] + x["b"] == 0, F.lit(1.0)).otherwise(x["both"] / (x["a"] + x["b"] - x["both"])))
    return F.when(output.isNull(), unmeasured("set_overlap.no_output")).when(reference.isNull(), unmeasured("set_overlap.no_reference")).otherwise(outcome(value))


def _kind(payload: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(payload, path, "variant"))


def is_object(payload: Column) -> Column:
    return F.coalesce(F.schema_of_variant(payload).startswith("OBJECT<"), F.lit(False))


def present(payload: Column, field: str) -> Column:
    """True for a JSON null too: presence is not a value."""
    return F.try_variant_get(payload, member(field), "variant").isNotNull()


def field_presence(payload: Column, fields: list[str]) -> Column:
    if not fields:
        return unmeasured("field_presence.no_fields")
    hits = sum((F.coalesce(present(payload, f), F.lit(False)).cast("int") for f in fields), F.lit(0))
    return F.when(payload.isNull() | ~is_object(payload), unmeasured("field_presence.output_not_mapping")).otherwise(outcome(hits / len(fields), code=F.when(hits < len(fields), "field_presence.missing_fields")))


def structural_shape(payload: Column) -> Column:
    return F.when(payload.isNull(), unmeasured("structural_shape.no_output")).otherwise(flag(is_object(payload)))


def numeric_bounds(payload: Column, field: str | None, low: float | None = None, high: float | None = None) -> Column:
    if not field:
        return unmeasured("numeric_bounds.no_field")
    if low is None and high is None:
        return unmeasured("numeric_bounds.no_bounds")
    if low is not None and high is not None and low > high:
        return unmeasured("numeric_bounds.bad_bounds")
    kind, value = _kind(payload, member(field)), F.try_variant_get(payload, member(field), "double")
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    ok = (F.lit(True) if low is None else value >= low) & (F.lit(True) if high is None else value <= high)
    return F.when(~F.coalesce(is_object(payload) & present(payload, field), F.lit(False)), unmeasured("numeric_bounds.field_absent")).when(~F.coalesce(number, F.lit(False)), unmeasured("numeric_bounds.not_numeric", "error")).otherwise(flag(ok, "numeric_bounds.out_of_bounds"))


def enum_membership(value: Column, allowed: list[str]) -> Column:
    if not allowed:
        return unmeasured("enum_membership.no_allowed")
    return F.when(value.isNull(), unmeasured("enum_membership.field_absent")).otherwise(flag(value.isin(allowed), "enum_membership.not_allowed"))


def enum_field(payload: Column, field: str | None, allowed: list) -> Column:
    """A member of an object (VARIANT) against values of any JSON kind; a null member is a value that may be allowed."""
    if not field:
        return unmeasured("enum_membership.no_field")
    if not allowed:
        return unmeasured("enum_membership.no_allowed")
    texts = [canonical(F.parse_json(F.lit(dumps(v)))) for v in allowed]
    absent = ~F.coalesce(is_object(payload) & present(payload, field), F.lit(False))
    value = once(canonical(F.try_variant_get(payload, member(field), "variant")), lambda v: flag(v.isin(*texts), "enum_membership.not_allowed"))
    return F.when(absent, unmeasured("enum_membership.field_absent")).otherwise(value)


def word_count_bounds(text: Column, low: int | None = None, high: int | None = None) -> Column:
    if low is None and high is None:
        return unmeasured("word_count_bounds.no_bounds")
    ok = lambda n: (F.lit(True) if low is None else n >= low) & (F.lit(True) if high is None else n <= high)
    made = once(F.size(words(text)), lambda n: flag(ok(n), "word_count_bounds.out_of_bounds"))
    return F.when(text.isNull(), unmeasured("word_count_bounds.field_absent")).otherwise(made)


def shape_of_counts(made: Column, members: Column, aggregate: Column | None = None, sequence: Column | None = None) -> Column:
    """The share of a unit's members that made an output, from counts alone. aggregate: the unit is more than a call;
    sequence: its output is a list, one a member. Where they are not given they hold; NULL says that they don't."""
    holds = lambda c: F.lit(True) if c is None else F.coalesce(c, F.lit(False))
    rungs = {"not_aggregate": ~holds(aggregate), "no_members": F.coalesce(members, F.lit(0)) == 0, "output_not_sequence": ~holds(sequence), "output_all_null": F.coalesce(made, F.lit(0)) == 0}
    ladder = F
    for code, at in rungs.items():
        ladder = ladder.when(at, unmeasured(f"trajectory_shape.{code}"))
    return ladder.otherwise(outcome(made / members))


def trajectory_shape(outputs: Column, members: Column) -> Column:
    return shape_of_counts(F.size(F.filter(outputs, lambda x: x.isNotNull())), members)


def judge_score(status: Column, value: Column, required: bool = True, low: float = 0.0, high: float = 1.0) -> Column:
    """status NULL: no evidence."""
    absent = unmeasured("judge.evidence_missing", "blocked") if required else unmeasured("judge.evidence_absent")
    lost = status.isin("missing", "timeout", "provider_error")
    blocked = outcome(F.lit(None), "blocked", "not_measured", F.concat(F.lit("judge."), status))
    return F.when(status.isNull(), absent).when(lost, blocked).when((status != "ok") | value.isNull(), unmeasured("judge.unparseable", "error", "not_measured")).when(~value.between(low, high), unmeasured("judge.value_out_of_range", "error", "not_measured")).otherwise(outcome(value))


def answer_nonempty(payload: Column) -> Column:
    return flag(is_object(payload) & (F.coalesce(F.try_variant_get(payload, "$.answer", "string"), F.lit("")) != ""))
