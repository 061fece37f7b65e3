"""Reports, workflow annotations and JSON lines."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from gaugework.functions.values import annotation_text, annotation_title, shown
from gaugework.sinks.records import write_text

#: Fixed value: the level of an annotation by a gate's state.
LEVELS = {"pass": "notice", "fail": "error", "blocked": "error", "informational": "notice"}


def annotations(gates: DataFrame, verdict: DataFrame, diagnostics: DataFrame, title: str = "gaugework") -> DataFrame:
    """(place, line) in order: the verdict, each metric's gate, then diagnostics as warnings. gates: place, metric, verdict,
    value, reason, authority."""
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    of = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "none").otherwise(annotation_text(F.col(c)))
    listed = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "none").otherwise(annotation_text(F.array_join(F.split(F.col(c), ","), ", ")))
    head = verdict.select(F.lit(0).cast("bigint").alias("group"), F.lit(0).cast("bigint").alias("place"), F.concat(F.lit(f"::notice title={title}::verdict="), "verdict", F.lit(" ci="), F.when(F.col("ci_should_fail"), "exit-nonzero").otherwise("exit-zero")).alias("line"))
    body = gates.select(F.lit(1).cast("bigint").alias("group"), F.col("place").cast("bigint").alias("place"), F.concat(F.lit("::"), level[F.col("verdict")], F.lit(" title="), annotation_title(F.col("metric")), F.lit("::gate="), "verdict", F.lit(" value="), shown(F.col("value")), F.lit(" reasons="), listed("reason"), F.lit(" authority="), of("authority")).alias("line"))
    rest = diagnostics.select(F.lit(2).cast("bigint").alias("group"), F.col("place").cast("bigint").alias("place"), F.concat(F.lit("::warning title="), annotation_title(F.col("code")), F.lit("::"), annotation_text(F.col("message"))).alias("line"))
    return head.unionByName(body).unionByName(rest).orderBy("group", "place")


def report(verdict: dict, metrics: list[dict]) -> str:
    """A Markdown report of collected rows: the verdict and a line for each metric; an absent value reads n/a."""
    number = lambda v: "n/a" if v is None else f"{v:.4g}"
    head = [f"# Verdict: {verdict['verdict']}", "", f"CI: {'fails' if verdict['ci_should_fail'] else 'passes'}", "", "| metric | gate | value | interval | n | reason |", "| --- | --- | --- | --- | --- | --- |"]
    band = lambda m: "n/a" if m.get("lower") is None else f"[{number(m['lower'])}, {number(m['upper'])}]"
    cell = lambda t: str(t or "").replace("|", "\\|").replace("\n", " ")
    return "\n".join(head + [f"| {cell(m['metric'])} | {m['verdict']} | {number(m.get('value'))} | {band(m)} | {m.get('n', 0)} | {cell(m.get('reason'))} |" for m in metrics]) + "\n"


def object_line(columns: dict[str, Column]) -> Column:
    """A JSON object of the members that aren't SQL NULL, keys in order; VARIANT members as they are."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f'"{k}":'), F.to_json(c))) for k, c in sorted(columns.items())]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def lines_of(rows: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, line) sorted by key: VARIANT and text columns as JSON objects."""
    text = lambda f: F.col(f.name) if f.dataType.simpleString() == "variant" else F.to_variant_object(F.struct(F.col(f.name).alias("v")))
    cols = {}
    for f in rows.schema.fields:
        cols[f.name] = F.col(f.name) if f.dataType.simpleString() == "variant" else F.when(F.col(f.name).isNotNull(), F.try_variant_get(text(f), "$.v", "variant"))
    return rows.select(F.col(key), object_line(cols).alias("line")).orderBy(key)


def write_lines(rows: DataFrame, folder: str, key: str = "example_id") -> None:
    """Sorted JSON lines as text files whose names and rows are in order: as many files as the data needs."""
    lines_of(rows, key).select("line").write.mode("overwrite").text(folder)


def write_one_file(rows: DataFrame, path: str | Path, key: str = "example_id", most: int = 1_000_000) -> int:
    """The same as one file, for results of a size that the driver can hold; more rows are refused, not cut."""
    got = [r[0] for r in lines_of(rows, key).select("line").limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"over {most} rows: use write_lines")
    write_text(Path(path), "".join(line + "\n" for line in got))
    return len(got)
