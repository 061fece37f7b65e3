"""Span sources: open-convention lines, recordings, and the payloads of three providers.

Every reader gives (ordinal, code, trace_id, unit_id, behavior fields, metadata); a bad span is a row with a code, never
the end of the read. Values are VARIANT; the first key that is present wins, a JSON null too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugework.functions.values import once
from gaugework.functions.words import stripped
from gaugework.sources.jsonl import _object_or_absent, field, kind, parsed

#: Attribute keys of the open conventions, first present wins. A host adds the parser keys of its own.
INPUT = ("llm.input_messages", "input.value", "gen_ai.prompt")
OUTPUT = ("llm.output_messages", "output.value", "gen_ai.completion")
MODEL = ("llm.model_name", "gen_ai.request.model")
TOOLS = ("llm.tools", "tool_calls", "message.tool_calls", "gen_ai.tool.calls")
RAW = ("llm.output.raw", "raw_output.value", "output.raw.value")
PARSER = ("parser.diagnostics",)
TIMING = ("start_time", "end_time", "duration_ms")
#: Pages that a provider's read goes through at most.
PAGES = 100


def first_present(attributes: Column, keys: tuple[str, ...]) -> Column:
    """NULL both where no key is present and where the first present one is null. attributes: a map of VARIANTs."""
    first = F.coalesce(*[F.try_element_at(attributes, F.lit(k)) for k in keys])
    return once(first, lambda v: F.when(~F.is_variant_null(v), v))


def text_id(v: Column) -> Column:
    """The stripped text of a string that isn't blank; NULL for anything else."""
    text = lambda v: F.when(kind(v) == "string", stripped(F.try_variant_get(v, "$", "string")))
    return once(once(v, text), lambda t: F.when(t != "", t))


def trace_id(span: Column) -> Column:
    ctx = field(span, "context")
    return F.coalesce(*[text_id(field(c, k)) for k in ("trace_id", "span_id") for c in (ctx, span)])


def structured(value: Column, mime: Column) -> Column:
    """A string that is marked as JSON or looks like an object or array, as what it holds; others as they are."""
    marked = F.coalesce(F.lower(F.try_variant_get(mime, "$", "string")).contains("json"), F.lit(False))
    held = lambda text: F.when(F.ltrim(text).rlike(r"^[{\[]") | marked, F.coalesce(F.try_parse_json(text), value)).otherwise(value)
    return once(F.when(kind(value) == "string", F.try_variant_get(value, "$", "string")), held)


def mapped(spans: DataFrame, parse_json: bool = False, parser_keys: tuple[str, ...] = PARSER, invalid_json: Column | None = None) -> DataFrame:
    """spans: ordinal, span (VARIANT), default_unit. A span needs an object, an id and either an output or a raw or parser
    layer; those layers never stand for the output. parse_json reads structure from texts."""
    # both are cast once, by generators, so that each look-up is one of a map
    spans = spans.select("*", F.inline(F.array(F.struct(field(F.col("span"), "attributes").alias("__at")))))
    spans = spans.select("*", F.inline(F.array(F.struct(F.try_variant_get("__at", "$", "map<string,variant>").alias("__map")))))
    s, a = F.col("span"), F.col("__map")
    get = lambda keys: first_present(a, keys)
    shape = F.coalesce(kind(s) != "object", F.lit(True)) | ~_object_or_absent(s, "attributes")
    parts = {"shape": shape, "id": trace_id(s), "output": get(OUTPUT), "raw": get(RAW), "diags": get(parser_keys), "input": get(INPUT), "model": get(MODEL), "tools": get(TOOLS), "own_unit": text_id(field(s, "span_id")), "mime_in": F.try_element_at(a, F.lit("input.mime_type")), "mime_out": F.try_element_at(a, F.lit("output.mime_type"))}
    # a generator, so that each part is looked up once
    spans = spans.select("*", F.inline(F.array(F.struct(*[c.alias(f"__{n}") for n, c in parts.items()]))))
    output, raw, diags = F.col("__output"), F.col("__raw"), F.col("__diags")
    code = F.when(F.col("__shape"), "trace_invalid_record").when(F.col("__id").isNull(), "trace_mapping_incomplete").when(output.isNull() & raw.isNull() & diags.isNull(), "trace_mapping_incomplete")
    if invalid_json is not None:
        code = F.when(invalid_json, "trace_invalid_json").otherwise(code)
    struct_of = (lambda v, m: structured(v, F.col(m))) if parse_json else (lambda v, m: v)
    unit = F.coalesce("__own_unit", "default_unit") if parse_json else F.col("default_unit")
    timing = [F.when(kind(field(s, k)).isin("string", "integer", "number"), field(s, k).cast("string")).alias(k) for k in TIMING]
    name = F.when(kind(field(s, "name")) == "string", F.try_variant_get(field(s, "name"), "$", "string"))
    cols = {"trace_id": F.col("__id"), "unit_id": unit, "input": struct_of(F.col("__input"), "__mime_in"), "output": struct_of(output, "__mime_out"), "model": F.col("__model"), "tool_calls": F.col("__tools"), "raw_output": raw, "parser_diagnostics": diags, "timing": F.struct(*timing), "span_name": name, "metadata": field(s, "_metadata")}
    coded = spans.withColumn("code", code)
    return coded.select("ordinal", "code", *[F.when(F.col("code").isNull(), c).alias(n) for n, c in cols.items()])


def open_convention(numbered: DataFrame, name: str, parser_keys: tuple[str, ...] = PARSER) -> DataFrame:
    """numbered: line, raw. Units are named by their line."""
    own = parsed(numbered).select(F.col("line").alias("ordinal"), F.col("doc").alias("span"), F.concat(F.lit(f"{name}#"), F.col("line").cast("string")).alias("default_unit"))
    return mapped(own, False, parser_keys, F.col("span").isNull())


def items(payload: Column, key: str) -> Column:
    """The members of a list, or NULL where the payload has none."""
    return F.try_variant_get(payload, f"$['{key}']", "array<variant>")


def _exploded(recordings: DataFrame, key: str, malformed: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the item and its place, recordings that have no such list as one diagnostic each)."""
    # by a generator, so that filters do not parse it again
    own = recordings.select("recording", F.inline(F.array(F.struct(items(F.try_parse_json("raw"), key).alias("list")))))
    rows = own.filter("list IS NOT NULL").select("recording", F.posexplode("list").alias("ordinal", "item"))
    return rows, own.filter("list IS NULL").select("recording", F.lit(malformed).alias("code"))


def recording(recordings: DataFrame, name: str, malformed: str = "backend_malformed_response") -> tuple[DataFrame, DataFrame]:
    """recordings: recording, raw, of {"spans": [...]}. (units, diagnostics of recordings that aren't one)."""
    rows, bad = _exploded(recordings, "spans", malformed)
    return mapped(rows.select("ordinal", F.col("item").alias("span"), F.concat(F.lit(f"{name}#"), F.col("ordinal").cast("string")).alias("default_unit")), True), bad


def observation_metadata(span: Column) -> Column:
    """What a lane of concurrent observations keeps of a span besides its behavior."""
    keep = ("parent_id", "concurrent", "start_time", "end_time")
    return F.struct(*[field(span, k).cast("string").alias(k) for k in keep])


def _span(trace: Column, ident: Column, attributes: dict[str, Column], start: Column, end: Column, metadata: dict[str, Column]) -> Column:
    """An open-convention span of known fields alone; NULL members are left out. Values go in as they are, not by their text."""
    there = lambda _, v: v.isNotNull() & ~F.is_variant_null(v)
    obj = lambda parts: F.to_variant_object(F.map_filter(F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]), there))
    times = {k: _text(v) for k, v in (("start_time", start), ("end_time", end))}
    return obj({"context": obj({"trace_id": trace, "span_id": ident}), "span_id": ident, "attributes": obj(attributes), **times, "_metadata": obj(metadata)})


def _text(v: Column) -> Column:
    return F.when(kind(v) == "string", v)


def _provider(rows: DataFrame, bad: Column, name: str, malformed: str, bad_recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    units = mapped(rows.filter(~bad).select("ordinal", F.explode(F.array("span")).alias("span"), F.concat(F.lit(f"{name}#"), F.col("ordinal").cast("string")).alias("default_unit")), True)
    return units, bad_recordings.unionByName(rows.filter(bad).select("recording", F.lit(malformed).alias("code")))


def nested_observations(recordings: DataFrame, name: str = "langfuse") -> tuple[DataFrame, DataFrame]:
    """Payloads {"data": [trace]}, a trace with its observations or, where those are bare ids, one span of its own output,
    marked as such in trace_level."""
    code = f"{name}_malformed_response"
    rows, bad = _exploded(recordings, "data", code)
    t = F.col("item")
    full = F.coalesce(F.filter(items(t, "observations"), lambda o: kind(o) == "object"), F.array().cast("array<variant>"))
    # by a generator, so that a trace's observations are listed once
    rows = rows.select("*", F.inline(F.array(F.struct(full.alias("full")))))
    own = F.size("full") == 0
    rows = rows.withColumn("obs", F.explode(F.when(own, F.array(F.lit(None).cast("variant"))).otherwise(F.col("full"))))
    broken = F.coalesce(kind(t) != "object", F.lit(True)) | (F.size("full") == 0) & F.coalesce(kind(field(t, "output")), F.lit("null")).isin("null")
    o = F.col("obs")
    meta = {"trace_name": _text(field(t, "name")), "session_id": _text(field(t, "sessionId"))}
    of_obs = _span(field(t, "id"), field(o, "id"), {"output.value": field(o, "output"), "input.value": field(o, "input"), "llm.model_name": field(o, "model")}, field(o, "startTime"), field(o, "endTime"), meta | {"usage": field(o, "usage")})
    of_trace = _span(field(t, "id"), field(t, "id"), {"output.value": field(t, "output"), "input.value": field(t, "input")}, field(t, "timestamp"), F.lit(None).cast("variant"), meta)
    return _provider(rows.withColumn("span", F.when(o.isNull(), of_trace).otherwise(of_obs)), broken, name, code, bad)


def runs(recordings: DataFrame, name: str = "langsmith") -> tuple[DataFrame, DataFrame]:
    """Payloads {"runs": [run]}: a run's whole inputs and outputs are the span's."""
    code = f"{name}_malformed_response"
    rows, bad = _exploded(recordings, "runs", code)
    r = F.col("item")
    span = _span(field(r, "trace_id"), field(r, "id"), {"output.value": field(r, "outputs"), "input.value": field(r, "inputs"), "llm.model_name": field(field(field(r, "extra"), "metadata"), "ls_model_name")}, field(r, "start_time"), field(r, "end_time"), {"run_type": field(r, "run_type"), "trace_name": _text(field(r, "name"))})
    return _provider(rows.withColumn("span", span), F.coalesce(kind(r) != "object", F.lit(True)), name, code, bad)


def rebuilt_spans(recordings: DataFrame, name: str = "phoenix") -> tuple[DataFrame, DataFrame]:
    """Payloads {"spans": [span]} whose id lies in the context: rebuilt from known fields; other entries stay for the
    mapping to name."""
    code = f"{name}_malformed_response"
    rows, bad = _exploded(recordings, "spans", code)
    s = F.col("item")
    a = field(s, "attributes")
    keys = (*INPUT, *OUTPUT, *MODEL, *TOOLS, *RAW, *PARSER, "input.mime_type", "output.mime_type")
    span = _span(field(field(s, "context"), "trace_id"), field(field(s, "context"), "span_id"), {k: field(a, k) for k in keys}, field(s, "start_time"), field(s, "end_time"), {"trace_name": _text(field(s, "name"))})
    return _provider(rows.withColumn("span", F.when(kind(s) == "object", span).otherwise(s)), F.lit(False), name, code, bad)


def collect_pages(fetch, limit: int = PAGES) -> tuple[list, str | None]:
    """Pages that fetch(cursor) gives as (items, next cursor), and why the read stopped early: a fault, a page that isn't a
    list, a cursor that came before, or the limit. What was read before stays."""
    out, cursor, seen = [], None, set()
    for _ in range(limit):
        try:
            page, cursor = fetch(cursor)
        except Exception:  # a provider's fault is a diagnostic
            return out, "fetch_failed"
        if not isinstance(page, list):
            return out, "page_malformed"
        out += page
        if cursor is None:
            return out, None
        if cursor in seen:
            return out, "cursor_repeated"
        seen.add(cursor)
    return out, "page_limit"


def connected(policy: str, fetch, read, name: str) -> tuple[DataFrame | None, str | None]:
    """A provider's read: nothing is fetched unless the policy lets data in; a fault is a code. read: payload to units."""
    if policy not in ("permitted", "redacted"):
        return None, f"{name}_egress_forbidden"
    try:
        payload = fetch()
    except Exception:  # a provider's fault is a diagnostic
        return None, "backend_unavailable"
    return read(payload), None
