"""Source queries: events as JSON Lines records, some of them broken on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugework.plans.scorers import load
from gaugework.sources import jsonl

#: What a record looks like, by event_id modulo 8; {} stands for props, # for event_id.
_SHAPES = ['{"input": {}, "output": "x", "id": #}', '{"input": {}, "example_id": " e# "}', '{"input": null}', '{bad', '["#"]', '{"output": {}}', '{"input": {}, "id": true}', '{"input": {}, "reference": {}, "metadata": {"e": #}}']


def _records(spark: SparkSession, sf: str) -> DataFrame:
    shape = F.element_at(F.array(*map(F.lit, _SHAPES)), (F.col("event_id") % 8 + 1).cast("int"))
    return load(spark, sf, "events").select(F.col("event_id").alias("line"), F.replace(F.replace(shape, F.lit("{}"), F.col("props")), F.lit("#"), F.col("event_id").cast("string")).alias("raw"))


def dataset_scan(spark: SparkSession, sf: str) -> DataFrame:
    got = jsonl.dataset(_records(spark, sf), "events")
    return got.select("line", "code", "example_id", "unit_id", *[F.try_variant_get(c, "$.k", "bigint").alias(f"{c}_k") for c in ("input", "reference")], F.col("output").cast("string").alias("output"))


def dataset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.dataset_manifest(jsonl.dataset(_records(spark, sf), "events"))


QUERIES = {"source_dataset_scan": dataset_scan, "source_dataset_manifest": dataset_manifest}
ORACLE = {
    "source_dataset_scan": """
SELECT event_id AS line, CASE WHEN m = 3 THEN 'dataset_invalid_json' WHEN m IN (4, 5, 6) THEN 'dataset_invalid_record' END AS code,
  CASE m WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN 'e' || event_id WHEN 2 THEN 'events#' || event_id WHEN 7 THEN 'events#' || event_id END AS example_id,
  CASE WHEN m NOT BETWEEN 3 AND 6 THEN 'events#' || event_id END AS unit_id,
  CASE WHEN m IN (0, 1, 7) THEN (props->>'$.k')::BIGINT END AS input_k, CASE WHEN m = 7 THEN (props->>'$.k')::BIGINT END AS reference_k, CASE WHEN m = 0 THEN 'x' END AS output
FROM (SELECT *, event_id % 8 AS m FROM events)""",
    "source_dataset_manifest": """
SELECT count(*) AS records_seen, count(*) FILTER (WHERE ok) AS units_emitted, count(*) FILTER (WHERE NOT ok) AS rejected, coalesce(bool_or(m = 0), false) AS has_output,
  coalesce(bool_or(m = 7), false) AS has_reference,
  CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'partial' ELSE 'complete_within_declared_scope' END AS completeness
FROM (SELECT event_id % 8 AS m, event_id % 8 NOT BETWEEN 3 AND 6 AS ok FROM events)""",
}
