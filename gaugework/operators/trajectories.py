"""Trajectories of any length: a header of counts for each trace, and its calls in chunks of a bounded size.

calls: trace_id, unit_id, ordinal, output, and for headers egress_ok, for chunks input. A header is one aggregation with
partial sums, so a trace that holds most calls costs a task no more than any other. Chunks get their calls by the number
in the trace, which is made over ranges of the order (operators/scan.py); no row and no task holds a whole trace.

Defined cases: calls of one ordinal follow in the order of their unit_id, NULL first in both; calls that are equal in both
stand in any order; a NULL trace_id is a trace; NULL outputs keep their places; no calls, no rows; other columns are unused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugework.operators.scan import numbered

#: Calls of a chunk.
CHUNK = 1024


def headers(calls: DataFrame) -> DataFrame:
    """(trace_id, members, made, egress_ok, first): a trace may leave the process only if each of its calls surely may, and
    traces are ordered by the place of their first call."""
    may = F.every(F.coalesce(F.col("egress_ok"), F.lit(False)))
    return calls.groupBy("trace_id").agg(F.count("*").alias("members"), F.count("output").alias("made"), may.alias("egress_ok"), F.min("ordinal").alias("first"))


def chunked(calls: DataFrame, size: int = CHUNK) -> DataFrame:
    """(trace_id, chunk, start, members, inputs, outputs): calls start to start + size of the trace, in their order."""
    own = numbered(calls.select("trace_id", "unit_id", "ordinal", "input", "output"), ("ordinal", "unit_id"), "place", ("trace_id",))
    chunk = F.floor(F.col("place") / size).cast("bigint").alias("chunk")
    a = own.groupBy("trace_id", chunk).agg(F.sort_array(F.collect_list(F.struct("place", "unit_id", "input", "output"))).alias("calls"))
    each = lambda c: F.transform("calls", lambda x: x[c])
    return a.select("trace_id", "chunk", (F.col("chunk") * size).alias("start"), each("unit_id").alias("members"), each("input").alias("inputs"), each("output").alias("outputs"))
