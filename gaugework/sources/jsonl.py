"""JSON Lines sources: numbered lines, dataset and trace records, annotations, and the manifest of a read.

A line that is not JSON or not a valid record becomes a row with a diagnostic code; the read goes on. Annotations are
the exception: any bad line fails the whole read. Record checks are one CASE ladder, so they run inside the scan's stage.
JSON is strict: NaN, Infinity and repeated keys of an object count as invalid JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gaugework.functions.values import once
from gaugework.functions.words import stripped

#: Fixed value: where a text is cut into lines.
BREAKS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
POLICIES = ("permitted", "redacted", "forbidden", "missing", "unknown")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, raw): stripped lines that aren't blank, numbered from 1 with blank ones counted. A file is one row
    of the scan, as numbers need its start; keep files below Spark's 2 GB a value and give many of them."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    cut = whole.select("path", F.posexplode(F.split("value", BREAKS)).alias("line", "raw"))
    return cut.select("path", (F.col("line") + 1).cast("bigint").alias("line"), stripped(F.col("raw")).alias("raw")).filter("raw <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """lines() for files of any size, which Spark may split: a line's number is the count of lines in the file's blocks
    before its own, and its place there. Only line feeds and carriage returns end a line here."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("id"))
    blocks = rows.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = rows.join(blocks.select("path", "block", "first", before.alias("before")), ["path", "block"])
    return out.select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), stripped(F.col("value")).alias("raw")).filter("raw <> ''")


def field(doc: Column, name: str) -> Column:
    """A member as VARIANT: SQL NULL where it is absent, a JSON null where it is present and null."""
    return F.try_variant_get(doc, f"$['{name}']", "variant")


def member_text(raw: Column, doc: Column, name: str) -> Column:
    """The JSON text of a member, with the keys of its objects in the record's order, which a VARIANT does not keep."""
    value = field(doc, name)
    return F.when(kind(value).isin("object", "array"), F.get_json_object(raw, f"$.{name}")).otherwise(F.to_json(value))


def kind(doc: Column) -> Column:
    """object, array, string, integer, boolean, null or number; SQL NULL for an absent member."""

    def named(of: Column) -> Column:
        whole = of.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$") & ~doc.cast("string").rlike("[.eE]")
        return F.when(of.isNull(), None).when(of.startswith("OBJECT"), "object").when(of.startswith("ARRAY"), "array").when(of == "STRING", "string").when(of == "BOOLEAN", "boolean").when(of == "VOID", "null").when(whole, "integer").otherwise("number")

    return once(F.schema_of_variant(doc), named)


def _present(doc: Column, name: str) -> Column:
    return field(doc, name).isNotNull()


def _object_or_absent(doc: Column, name: str) -> Column:
    return F.coalesce(kind(field(doc, name)), F.lit("object")) == "object"


def _id(value: Column) -> Column:
    """The stripped text of a string or integer; NULL for any other kind, a null and an absent member."""
    return F.when(kind(value).isin("string", "integer"), stripped(value.cast("string")))


def _read(records: DataFrame, code: Column, ladder: dict[str, Column]) -> DataFrame:
    """records with a code and the ladder's columns, which are NULL where a code stands."""
    coded = records.withColumn("code", code)
    return coded.select("line", "code", *[F.when(F.col("code").isNull(), c).alias(name) for name, c in ladder.items()])


def parsed(numbered: DataFrame) -> DataFrame:
    return numbered.withColumn("doc", F.try_parse_json("raw"))


def dataset(numbered: DataFrame, name: str) -> DataFrame:
    """numbered: line, raw. (line, code, example_id, unit_id, trace_id, input, output, reference, context, metadata):
    an absent output awaits its replay; context and metadata may be absent, but nothing else than objects."""
    doc = F.col("doc")
    chosen = F.coalesce(field(doc, "id"), field(doc, "example_id"))
    own = F.concat(F.lit(f"{name}#"), F.col("line").cast("string"))
    bad = (kind(doc) != "object") | ~_present(doc, "input") | ~_object_or_absent(doc, "context") | ~_object_or_absent(doc, "metadata") | (chosen.isNotNull() & (F.coalesce(_id(chosen), F.lit("")) == ""))
    code = F.when(doc.isNull(), "dataset_invalid_json").when(bad, "dataset_invalid_record")
    some = {c: _value(field(doc, c)) for c in ("output", "reference")}
    return _read(parsed(numbered), code, {"example_id": F.coalesce(_id(chosen), own), "unit_id": own, "trace_id": F.lit(f"dataset:{name}"), "input": field(doc, "input"), **some, "context": field(doc, "context"), "metadata": field(doc, "metadata")})


def _value(v: Column) -> Column:
    """Where a member may be absent, a present null says the same as none."""
    return F.when(kind(v) != "null", v)


def traces(numbered: DataFrame, name: str, policy: str = "missing") -> DataFrame:
    """numbered: line, raw. (line, code, trace_id, unit_id, source, data_policy, behavior, metadata, provenance): the
    record's data policy goes before the source's."""
    doc = F.col("doc")
    trace, unit, own = field(doc, "trace_id"), field(doc, "unit_id"), F.concat(F.lit(f"{name}#"), F.col("line").cast("string"))
    has_unit = F.coalesce(kind(unit), F.lit("null")) != "null"
    wrong_text = lambda c: _present(doc, c) & (kind(field(doc, c)) != "string")
    rule = F.coalesce(field(doc, "data_policy").cast("string"), F.lit(policy))
    bad = (
        (kind(doc) != "object") | ~_object_or_absent(doc, "provenance") | ~_object_or_absent(doc, "metadata")
        | (F.coalesce(kind(trace), F.lit("")) != "string") | (stripped(trace.cast("string")) == "") | (F.coalesce(kind(field(doc, "behavior")), F.lit("")) != "object")
        | wrong_text("source") | wrong_text("data_policy") | ~rule.isin(*POLICIES) | (has_unit & (F.coalesce(_id(unit), F.lit("")) == ""))
    )
    code = F.when(doc.isNull(), "trace_invalid_json").when(bad, "trace_invalid_record")
    return _read(parsed(numbered), code, {"trace_id": trace.cast("string"), "unit_id": F.coalesce(_id(unit), own), "source": F.coalesce(field(doc, "source").cast("string"), F.lit("local_jsonl")), "data_policy": rule, "behavior": field(doc, "behavior"), "metadata": field(doc, "metadata"), "provenance": field(doc, "provenance")})


def annotations(numbered: DataFrame) -> DataFrame:
    """(line, annotation_id, value, validation_record); the first action fails if any line is bad."""
    doc, record = F.col("doc"), field(F.col("doc"), "validation_record")
    ident = field(doc, "annotation_id")
    bad = doc.isNull() | (kind(doc) != "object") | (F.coalesce(kind(ident), F.lit("")) != "string") | (stripped(ident.cast("string")) == "") | ~_present(doc, "value") | ~F.coalesce(kind(record), F.lit("null")).isin("string", "null")
    fail = F.raise_error(F.concat(F.lit("annotations line "), F.col("line").cast("string"), F.lit(": invalid record"))).cast("bigint")
    guarded = parsed(numbered).withColumn("line", F.when(F.coalesce(bad, F.lit(True)), fail).otherwise(F.col("line")))
    return guarded.filter("line > 0").select("line", ident.cast("string").alias("annotation_id"), field(doc, "value").alias("value"), _value(record).cast("string").alias("validation_record"))


def completeness(seen: Column, emitted: Column, rejected: Column, fallback: Column | None = None, blocked: Column | None = None) -> Column:
    """The weakest claim that the counts allow."""
    part = (rejected > 0) | (emitted < seen) | (fallback > 0 if fallback is not None else F.lit(False))
    return F.when(blocked if blocked is not None else F.lit(False), "blocked").when((seen == 0) & (emitted == 0) & (rejected == 0), "empty").when(part, "partial").otherwise("complete_within_declared_scope")


def dataset_manifest(read: DataFrame) -> DataFrame:
    """One row: counts, completeness and which layers any example has, by one aggregation."""
    ok = F.col("code").isNull()
    out = read.agg(F.count("*").alias("records_seen"), F.count_if(ok).alias("units_emitted"), F.count_if(~ok).alias("rejected"), *[(F.count(c) > 0).alias(f"has_{c}") for c in ("output", "reference")])
    return out.withColumn("completeness", completeness(F.col("records_seen"), F.col("units_emitted"), F.col("rejected")))
