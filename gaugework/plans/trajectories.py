"""Queries over trajectories: traces that hold a third of all calls, and every rung of their score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugework.operators import scorers as S
from gaugework.operators import trajectories as T
from gaugework.plans.scorers import load

SIZE = 500


def _calls(spark, sf) -> DataFrame:
    """Line items as calls of three traces, their return flags. Keys repeat, so units are named by more columns."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    output = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity"))
    unit = F.concat_ws("-", *[c.cast("bigint").cast("string") for c in (key, F.col("l_partkey"), F.round(F.col("l_extendedprice") * 100), F.round("l_quantity"))])
    return load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("trace_id"), unit.alias("unit_id"), key.alias("ordinal"), F.col("l_partkey").alias("input"), output.alias("output"), ((F.col("l_returnflag") != "N") | (F.col("l_linenumber") < 7)).alias("egress_ok"))


def trajectory_headers(spark, sf):
    return T.headers(_calls(spark, sf))


def trajectory_chunks(spark, sf):
    """Each chunk with the digest of its members and inputs and its outputs' number and sum."""
    joined = lambda c: F.md5(F.array_join(c, ",").cast("binary"))
    made = F.filter("outputs", lambda x: x.isNotNull())
    total = F.aggregate(made, F.lit(0.0), lambda a, x: a + x)
    return T.chunked(_calls(spark, sf), SIZE).select("trace_id", "chunk", "start", F.size("members").cast("bigint").alias("n"), joined("members").alias("members_md5"), joined("inputs").alias("inputs_md5"), F.size(made).cast("bigint").alias("made"), F.round(total, 4).alias("total"))


def trajectory_rungs(spark, sf):
    """Conversations as units: calls, units whose output is no list, and trajectories; nations as units without members."""
    c = load(spark, sf, "conversations")
    output = F.when((F.col("role") == "assistant") & (F.col("conv_id") % 7 != 2), F.col("text"))
    h = T.headers(c.select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("ordinal"), output.alias("output"), F.lit(True).alias("egress_ok")))
    k = F.col("trace_id") % 7
    declared = load(spark, sf, "nation").select((-1 - F.col("n_nationkey")).alias("trace_id"), F.lit("session").alias("kind"), F.lit("array").alias("shape"))
    units = h.select("trace_id", F.when(k == 0, "call").otherwise("trajectory").alias("kind"), F.when(k == 1, "object").otherwise("array").alias("shape")).unionByName(declared)
    rows = units.join(h, "trace_id", "left")
    score = S.shape_of_counts(F.col("made"), F.col("members"), F.col("kind") != "call", F.col("shape") == "array")
    return rows.select(F.col("trace_id").alias("unit"), F.inline(F.array(score))).withColumn("value", F.round("value", 9))


QUERIES = {f.__name__: f for f in (trajectory_headers, trajectory_chunks, trajectory_rungs)}

_CALLS = "(SELECT l_returnflag AS trace_id, l_orderkey * 10 + l_linenumber AS ordinal, concat_ws('-', (l_orderkey * 10 + l_linenumber)::BIGINT, l_partkey::BIGINT, round(l_extendedprice * 100)::BIGINT, round(l_quantity)::BIGINT) AS unit_id, l_partkey AS input, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS output, l_returnflag <> 'N' OR l_linenumber < 7 AS egress_ok FROM lineitem)"

ORACLE = {
    "trajectory_headers": f"SELECT trace_id, count(*) AS members, count(output) AS made, bool_and(egress_ok) AS egress_ok, min(ordinal) AS first FROM {_CALLS} GROUP BY trace_id",
    "trajectory_chunks": f"""SELECT trace_id, place // {SIZE} AS chunk, min(place) AS start, count(*) AS n, md5(string_agg(unit_id, ',' ORDER BY place)) AS members_md5, md5(string_agg(input::VARCHAR, ',' ORDER BY place)) AS inputs_md5,
      count(output) AS made, round(coalesce(sum(output), 0)::DOUBLE, 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ordinal, unit_id) - 1 AS place FROM {_CALLS}) GROUP BY trace_id, place // {SIZE}""",
    "trajectory_rungs": """SELECT unit, CASE WHEN code IS NULL THEN round(made / n::DOUBLE, 9) END AS value, CASE WHEN code IS NULL THEN 'scored' ELSE 'non_evaluable' END AS status, CASE WHEN code IS NULL THEN 'valid' ELSE 'not_applicable' END AS validity, code FROM (
      SELECT conv_id AS unit, made, n, CASE WHEN conv_id % 7 = 0 THEN 'trajectory_shape.not_aggregate' WHEN conv_id % 7 = 1 THEN 'trajectory_shape.output_not_sequence' WHEN made = 0 THEN 'trajectory_shape.output_all_null' END AS code
      FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'assistant' AND text IS NOT NULL AND conv_id % 7 <> 2) AS made FROM conversations GROUP BY conv_id)
      UNION ALL SELECT -1 - n_nationkey, 0, 0, 'trajectory_shape.no_members' FROM nation)""",
}
