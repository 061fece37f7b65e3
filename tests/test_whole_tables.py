"""Queries that read the whole of their tables."""

import math
import statistics

import pytest

from gaugework.functions import stats
from gaugework.operators import compare
from gaugework.plans import core, evidence, scorers
from pyspark.sql import functions as F


def test_intervals_read_every_customer(spark, tmp_path):
    rows = [(i, "ab"[i % 2], float(i * i % 17)) for i in range(200)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.metric: r for r in core.mean_interval(spark, str(tmp_path)).collect()}
    for k in "ab":
        v = [x for _, m, x in rows if m == k]
        half = 1.984217 * statistics.stdev(v) / math.sqrt(len(v))  # t(99)
        assert got[k].included == 100
        assert (got[k].lower, got[k].upper) == pytest.approx((statistics.mean(v) - half, statistics.mean(v) + half), abs=0.051)
    assert stats.t_value(99) == pytest.approx(1.984217, abs=1e-6)


def test_every_item_is_expanded(spark, tmp_path):
    spark.createDataFrame([(i, f"t{i}") for i in range(60)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = core.synthetic_expand(spark, str(tmp_path)).collect()
    assert len(got) == 187 and {r.item_id for r in got} == set(range(60)) and {r.status for r in got} == {"proposed"}


def test_leaks_and_partners_come_from_all_items(spark, tmp_path):
    spark.createDataFrame([(i, f"Item  text {i}") for i in range(60)] + [(None, "no id"), (70, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "item text 55"), (2, "item\ttext 2"), (3, "item text 555"), (None, "NO ID"), (50, "Item text 50"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = scorers.leakage_filter(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.leaks for r in got if r.doc_id is not None and r.doc_id >= 0} == {1: True, 2: True, 3: False, 50: True, 5: None}
    assert sum(r.leaks is True for r in got) == 4 + 61
    got = {r.doc_id: r.value for r in scorers.score_set_overlap(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[50] == 1.0


def test_few_pairs_need_the_wide_interval(spark):
    rows = [("few", 1.0, 0.0), ("few", 2.0, 0.0), ("few", 0.4, 0.0), ("sure", 5.0, 0.0), ("sure", 5.1, 0.0), ("sure", 5.2, 0.0), ("cost", 1.0, 0.0), ("cost", 1.1, 0.0), ("cost", 1.2, 0.0), ("one", 1.0, 0.0)]
    p = spark.createDataFrame(rows, "metric string, now double, then double")
    mean, sd = statistics.mean((1.0, 2.0, 0.4)), statistics.stdev((1.0, 2.0, 0.4))
    assert mean - 1.96 * sd / math.sqrt(3) > 0 > mean - 4.302653 * sd / math.sqrt(3)
    got = {r.metric: (r.n_paired, r.outcome) for r in compare.deltas(p, F.lit(False)).collect()}
    assert got == {"few": (3, "within_noise"), "sure": (3, "improvement"), "cost": (3, "improvement"), "one": (1, "unresolved")}


def test_values_of_zero_are_near_only_where_they_are_meant_to_be(spark, tmp_path):
    rows = [(i, v) for i, v in enumerate([0.0, 0.0, -0.0, -0.0, None, None, 1e-9, 1e-9, 5e8, 5e8])]
    events = spark.createDataFrame(rows, "event_id bigint, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = evidence.canonical_keys(spark, str(tmp_path)).collect()
    assert {r.event_id: r.close for r in got} == {i: i % 2 == 0 for i, _ in rows}
