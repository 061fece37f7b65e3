"""Run series: an index that only grows, one line a run, and the runs' history."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugework.sinks.records import canonical, digest, inside, verified, write_text

INDEX = "index.jsonl"
FIELDS = "series_id string, run_id string, run_key string, verdict string, ci_should_fail boolean, examples bigint, evaluability double, generated_at string, baseline_run_id string"


def run_key(record: dict) -> str:
    return digest(canonical(record))[:16]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, entry fields) of an index, oldest first by ordinal; lines that aren't entries are skipped."""
    from gaugework.sources.jsonl import lines

    rows = lines(spark, path).select(F.col("line").alias("ordinal"), F.from_json("raw", FIELDS).alias("e"))
    return rows.select("ordinal", "e.*").filter("series_id IS NOT NULL AND run_key IS NOT NULL")


def appended(entries: DataFrame, new: DataFrame) -> DataFrame:
    """entries and those new ones whose key they lack, once each: a run that is recorded again changes nothing. Both have
    ordinal; new ones follow."""
    last = F.coalesce(F.max("ordinal"), F.lit(0)).alias("__last")
    once = new.groupBy("run_key").agg(F.min_by(F.struct(*new.columns), "ordinal").alias("e")).select("e.*").join(entries.select("run_key").distinct(), "run_key", "left_anti")
    fresh = once.crossJoin(F.broadcast(entries.agg(last))).withColumn("ordinal", F.col("ordinal") + F.col("__last")).drop("__last")
    return entries.unionByName(fresh.select(*entries.columns))


def record_run(root: str | Path, entry: dict, folder: str | Path) -> bool:
    """Add a whole run to the index file of its root; False if its key is there already. The index is replaced in one step."""
    if verified(folder):
        return False
    path = inside(root, INDEX)
    old = path.read_text(encoding="utf-8").splitlines() if path.exists() else []
    for line in old:
        try:
            if json.loads(line).get("run_key") == entry["run_key"]:
                return False
        except (ValueError, AttributeError):
            continue
    write_text(path, "\n".join([*old, json.dumps(entry, sort_keys=True)]) + "\n")
    return True
