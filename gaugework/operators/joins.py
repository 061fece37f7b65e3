"""Joins that check cardinality: the right side is counted for each key first, so no row is dropped unseen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gaugework.functions.values import at_path, canonical

ONE, MANY, OPTIONAL = "one_to_one", "one_to_many", "optional_one"
MISSING, AMBIGUOUS, NO_ID = "assembly_join_missing", "assembly_join_ambiguous", "assembly_no_example_id"


def counted(left: DataFrame, right: DataFrame, left_key: str, right_key: str, cardinality: str) -> DataFrame:
    """Left rows with n (matches), r (the matching right row, NULL unless the cardinality allows it) and diagnostic (NULL
    for rows that are kept). Keys that are NULL match each other; one_to_many gives a row a match."""
    r = right.select(F.col(right_key).alias("__k"), F.struct(*right.columns).alias("r"))
    if cardinality == MANY:
        one = r.withColumn("n", F.lit(1).cast("bigint"))
    else:
        one = r.groupBy("__k").agg(F.count("*").alias("n"), F.any_value("r").alias("r")).withColumn("r", F.when(F.col("n") == 1, F.col("r")))
    out = left.join(one, F.col(left_key).eqNullSafe(F.col("__k")), "left").drop("__k").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    ok = {ONE: F.col("n") == 1, MANY: F.col("n") >= 1, OPTIONAL: F.col("n") <= 1}[cardinality]
    return out.withColumn("diagnostic", F.when(ok, None).when(F.col("n") == 0, MISSING).otherwise(AMBIGUOUS))


def assemble(left: DataFrame, right: DataFrame, left_key: str, right_key: str, cardinality: str) -> tuple[DataFrame, DataFrame]:
    """(kept rows with r, dropped rows with n and diagnostic)."""
    out = counted(left, right, left_key, right_key, cardinality)
    return out.filter("diagnostic IS NULL").drop("diagnostic", "n"), out.filter("diagnostic IS NOT NULL").drop("r")


class Assembly:
    """A chain of joins over sources of JSON records, each a DataFrame with a VARIANT column `record`. The first source
    seeds the rows; a row is a struct of records, one column a source. Joins are evaluated in order, as a dropped row
    changes what the next one counts. A key is the canonical JSON under a dotted path: objects and lists match by
    content, JSON nulls match each other, and a path that a record lacks matches nothing."""

    def __init__(self, sources: dict[str, DataFrame]) -> None:
        self.sources, self.dropped = sources, []
        first = next(iter(sources))
        self.rows = sources[first].select(F.col("record").alias(first))

    def _key(self, ref: str) -> tuple[str, Column]:
        source, _, path = ref.partition(".")
        return source, canonical(at_path(F.col(source), path))

    def join(self, left: str, right: str, cardinality: str) -> Assembly:
        """left, right: source.path. Diagnostics are one for each dropped row."""
        _, key = self._key(left)
        name, path = right.split(".", 1)
        r = self.sources[name].select(canonical(at_path(F.col("record"), path)).alias("__k"), F.col("record").alias(name)).filter("__k IS NOT NULL")
        if cardinality != MANY:
            r = r.groupBy("__k").agg(F.count("*").alias("__n"), F.any_value(name).alias(name))
        else:
            r = r.withColumn("__n", F.lit(1).cast("bigint"))
        out = self.rows.withColumn("__l", key).join(r, F.col("__l") == F.col("__k"), "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
        ok = {ONE: F.col("__n") == 1, MANY: F.col("__n") >= 1, OPTIONAL: F.col("__n") <= 1}[cardinality]
        code = F.when(F.col("__n") == 0, MISSING).otherwise(AMBIGUOUS)
        self.dropped.append(out.filter(~ok).select(code.alias("code"), F.lit(left).alias("left"), F.lit(right).alias("right"), F.col("__n").alias("matches")))
        self.rows = out.filter(ok).drop("__l", "__k", "__n")
        return self

    def project(self, fields: dict[str, str]) -> DataFrame:
        """example_id and each other field as VARIANT, SQL NULL where a source or path is absent. A row without an
        example_id goes, with a diagnostic. Unordered; write_lines sorts by example_id."""
        cols = {name: at_path(F.col(ref.partition(".")[0]), ref.partition(".")[2]) for name, ref in fields.items()}
        out = self.rows.select(*[c.alias(name) for name, c in cols.items()])
        ident = F.col("example_id")
        text = F.when(F.schema_of_variant(ident) != "VOID", F.coalesce(F.try_variant_get(ident, "$", "string"), F.to_json(ident)))
        out = out.withColumn("example_id", text)
        bad = F.coalesce(F.col("example_id") == "", F.lit(True))
        self.dropped.append(out.filter(bad).select(F.lit(NO_ID).alias("code"), F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"), F.lit(0).cast("bigint").alias("matches")))
        return out.filter(~bad)

    def diagnostics(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.dropped)

    def source_counts(self) -> DataFrame:
        """(source, records)."""
        return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("source"), F.count("*").alias("records")) for name, df in self.sources.items()])


def usable_rows(scores: DataFrame) -> DataFrame:
    """Rows that carry a measured value for an example."""
    return scores.filter((F.col("status") == "scored") & (F.col("validity") == "valid") & F.col("value").isNotNull() & (F.coalesce(F.col("example_id").cast("string"), F.lit("")) != ""))


def last_by(rows: DataFrame, keys: list[str], value: str, ordinal: str, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, ordinal).alias(name))


def first_by(rows: DataFrame, keys: list[str], value: str, ordinal: str, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(value, ordinal).alias(name))


def paired(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Inner join on (metric, example_id) of usable rows; of repeated ids the last usable one by ordinal counts."""
    keys = ["metric", "example_id"]
    return last_by(usable_rows(current), keys, "value", "ordinal", "now").join(last_by(usable_rows(baseline), keys, "value", "ordinal", "then"), keys)
