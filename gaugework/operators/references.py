"""References: drafting, lifecycle and validation; synthetic examples; annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gaugework.functions.values import folded_json
from gaugework.functions.words import stripped
from gaugework.operators.scan import numbered

#: Fixed value: words in the name of a tool, which may draft but never validate; a host adds the names of its own.
TOOL_MARKS = ("agent", "assistant", "plugin", "codex", "claude", "bot")
#: Fixed value: where a reference set may go from each status, and the standing of data it gives.
TRANSITIONS = {"draft": ("proposed", "retired"), "proposed": ("reviewed", "retired"), "reviewed": ("validated", "proposed", "retired"), "validated": ("retired", "reviewed"), "retired": ()}
STANDING = {"draft": "proposed", "proposed": "proposed", "reviewed": "proposed", "validated": "validated", "retired": "retired"}


def leaks(candidate: Column, reference: Column) -> Column:
    """Whether a reference (VARIANT) is the candidate's output but for case and white space; an absent candidate is null."""
    null = F.parse_json(F.lit("null"))
    return folded_json(F.coalesce(candidate, null)) == folded_json(F.coalesce(reference, null))


def drafted(rows: DataFrame) -> DataFrame:
    """rows: example_id, candidate and reference (VARIANT; SQL NULL where the row has none). Adds code (NULL: accepted) and
    status, which is never more than proposed."""
    code = F.when(F.coalesce(F.col("example_id").cast("string"), F.lit("")) == "", "reference_no_example_id").when(F.col("reference").isNull(), "reference_missing_value").when(leaks(F.col("candidate"), F.col("reference")), "reference_leakage")
    return rows.withColumn("code", code).withColumn("status", F.when(F.col("code").isNull(), "proposed"))


def is_tool(who: Column, marks: tuple[str, ...] = TOOL_MARKS) -> Column:
    low = F.lower(who)
    return reduce(lambda c, m: c | low.contains(m.lower()), marks, F.when(who.isNotNull(), F.lit(False)))


def promoted(current: Column, target: Column, author: Column, reviewer: Column, decision: Column, marks: tuple[str, ...] = TOOL_MARKS) -> Column:
    """NULL where a set may move to the target, else the reason: the move isn't allowed, or validation lacks a review by
    someone who is neither a tool nor the author."""
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, bs in TRANSITIONS.items() for b in bs])
    allowed = F.array_contains(pairs, F.concat_ws(">", current, target))
    checked = target == "validated"
    same = F.lower(stripped(reviewer)) == F.lower(stripped(author))
    return F.when(~allowed, "transition_not_allowed").when(checked & ~F.coalesce(decision == "validated", F.lit(False)), "review_missing").when(checked & F.coalesce(is_tool(reviewer, marks), F.lit(True)), "reviewer_is_a_tool").when(checked & same, "reviewer_is_the_author")


def standing(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in STANDING.items() for x in kv])[status]


def problems(items: DataFrame, available: DataFrame) -> DataFrame:
    """items: example_id, ordinal, refs (array); available: ref. One row for each repetition of an id after its first, and
    for each ref without evidence."""
    again = items.groupBy("example_id").agg(F.count("*").alias("n")).filter("n > 1").select("example_id", F.explode(F.sequence(F.lit(2), F.col("n"))).alias("x")).select("example_id", F.lit("reference_duplicate_id").alias("code"), F.lit(None).cast("string").alias("ref"))
    refs = items.select("example_id", F.explode("refs").alias("ref"))
    gone = refs.join(available.select("ref").distinct(), "ref", "left_anti").select("example_id", F.lit("reference_evidence_unresolved").alias("code"), "ref")
    return again.unionByName(gone)


def expanded(seeds: DataFrame, count: int, ordinal: str) -> DataFrame:
    """count examples, the i-th from seed i modulo their number in the order of ordinal; all of them only proposed."""
    n = max(1, seeds.count())
    drawn = numbered(seeds, (ordinal,), "seed")
    return seeds.sparkSession.range(count).select(F.col("id").alias("i"), (F.col("id") % n).alias("seed")).join(drawn, "seed").withColumn("status", F.lit("proposed"))


def authoritative(validation_record: Column) -> Column:
    """An annotation counts only with a record of its validation that isn't blank."""
    return F.coalesce(F.length(stripped(validation_record)) > 0, F.lit(False))
