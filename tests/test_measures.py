"""Ordered sums, order statistics, fingerprints and number forms at their edges."""

import hashlib
import math
import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from gaugework.functions import stats
from gaugework.functions.values import canonical, member, shown
from gaugework.operators import decide, digests, references, scan, select


def odd_doubles(n=2000):
    rng = random.Random(3)
    out = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.0, math.nextafter(1, 0), math.nextafter(1, 2), 2.0**1023, math.inf, -math.inf, 1e-310]
    return [v for v in out + [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(n)] if v == v]


def test_keys_are_the_bits_of_doubles(spark):
    values = odd_doubles()
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").transform(lambda d: select.keyed(d, "v", "k")).select("k").collect()]
    bits = [struct.unpack("<q", struct.pack("<d", abs(v)))[0] for v in values]
    assert got == [-b if v < 0 else b for v, b in zip(values, bits)]


@pytest.mark.parametrize("groups", [select.GROUPS, 1])
def test_order_statistics_equal_sorted_values(spark, monkeypatch, groups):
    monkeypatch.setattr(select, "GROUPS", groups)
    rng = random.Random(4)
    some = [v for v in odd_doubles() if abs(v) < 1e300]
    rows = [(g, rng.choice(some) if rng.random() < 0.5 else round(rng.gauss(0, 1), 2)) for g in "ab" for _ in range(401 if g == "a" else 300)] + [("c", 2.0), (None, 1.0), (None, 4.0), ("d", None)]
    df = spark.createDataFrame(rows, "metric string, value double")
    of = {g: sorted(v for m, v in rows if m == g and v is not None) for g in ("a", "b", "c", None)}
    assert {r.metric: r.median for r in select.median(df, "metric").collect()} == {g: statistics.median(v) for g, v in of.items()}
    got = {(r.metric, r.share): r.value for r in select.quantile(df, "metric", (0.0, 0.3, 1.0)).collect()}
    assert got == {(g, s): v[max(1, math.ceil(s * len(v))) - 1] for g, v in of.items() for s in (0.0, 0.3, 1.0)}
    assert select.median(df.limit(0), "metric").count() == 0


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_running_sums_of_a_hot_group(spark, ranges):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(40)]), i, rng.choice([None, 1, 2])) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, o long, i long, a long")
    got = {r.i: r.s for r in scan.running(df, ("o", "i"), {"s": F.col("a")}, ("g",), ranges).collect()}
    want, sums = {}, {}
    for g, o, i, a in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        want[i] = sums.get(g, 0)
        sums[g] = want[i] + (a or 0)
    assert got == want
    numbers = scan.numbered(df, ("o", "i"), "n", ranges=ranges).collect()
    assert [r.i for r in sorted(numbers, key=lambda r: r.n)] == [r[2] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))]
    assert scan.numbered(df.limit(0), ("o",), "n").count() == 0


def test_no_window_holds_the_hot_group(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), F.col("id").alias("o"))
    sizes = [r["count"] for r in scan.ranged(df, ("o",), 16).groupBy(scan._RANGE).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 4 * 20_000 / 16


def test_multiset_digests(spark):
    rows = [(i, f"t{i % 7}") for i in range(200)] + [(None, ""), (3, None)]
    df = spark.createDataFrame(rows, "i long, t string")
    text = lambda v: "-" if v is None else f"{len(str(v))}:{v}"
    want = sum(int(hashlib.sha256((text(i) + text(t)).encode()).hexdigest(), 16) for i, t in rows) % 2**256
    one = lambda d: digests.digest(d, ["i", "t"]).collect()[0]
    assert one(df).digest == f"{want:064x}" and one(df.repartition(7).sort(F.desc("t"))) == one(df)
    others = [df.union(df.filter("i = 5")), df.filter("i <> 5 OR i IS NULL"), df.withColumn("t", F.when(F.col("i") == 5, "x").otherwise(F.col("t"))), df.fillna({"t": "-"})]
    assert len({one(d).digest for d in [df, *others]}) == 5
    assert (one(df.limit(0)).n, one(df.limit(0)).digest) == (0, "0" * 64)


def test_numbers_are_shown_as_python_shows_them(spark):
    rng = random.Random(6)
    values = [0.0, 1.0, -1.5, 12345.6, 1e-5, 0.0001, 0.00012344, 9999.6, 99999.0, 1e300, -2e-300, 123456789.0, 0.5, 100.0, 1000.0, 10000.0, math.inf, -math.inf, math.nan, None] + [rng.gauss(0, 1) * 10 ** rng.randint(-12, 12) for _ in range(500)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(shown(F.col("v"))).collect()]
    assert got == ["none" if v is None else f"{v:.4g}" for v in values]


def test_t_column_equals_quantiles(spark):
    sizes = [0, 1, 2, 30, 199, 200, 201, 250, 1000, 5000, 10**7]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(stats.t_column(F.col("n"))).collect()]
    assert got[0] is None and got[1:] == pytest.approx([stats.t_value(n) for n in sizes[1:]], abs=1e-9)


def test_json_forms(spark):
    row = spark.range(1).select(canonical(F.parse_json(F.lit('{"b": [1.0, "1.0", "a\\\\\\" 2.0"], "a": -3.00}'))).alias("c"), F.try_variant_get(F.parse_json(F.lit('{"it\'s": {"x y": 1}}')), member("it's", "x y"), "int").alias("m")).first()
    assert row.c == '{"a":-3,"b":[1,"1.0","a\\\\\\" 2.0"]}' and row.m == 1


def test_verdict_lists_are_in_the_order_of_metrics(spark):
    gates = spark.createDataFrame([("z", 0, "fail", "below_threshold"), ("a", 1, "blocked", "policy_missing,dataset_retired"), ("m", 2, "pass", None), ("b", 3, "fail", None), ("i", 4, "informational", None)], "metric string, ordinal int, verdict string, reason string")
    r = decide.decide(gates, "ordinal").first()
    assert (r.verdict, r.fail_gates, r.blocked_gates, r.pass_gates, r.informational_metrics) == ("blocked", "z,b", "a", "m", "i")
    assert [(x.metric, x.reasons) for x in r.reasons] == [("z", ["below_threshold"]), ("a", ["policy_missing", "dataset_retired"]), ("b", ["gate_blocked"])]


def test_names_of_tools_are_no_patterns(spark):
    got = spark.createDataFrame([("An Agent",), ("a.b",), ("axb",), (None,)], "w string").select(references.is_tool(F.col("w"), ("agent", "a.b"))).collect()
    assert [r[0] for r in got] == [True, True, False, None]


@pytest.mark.parametrize("values", [list(range(5000)), [None, *range(3)] * 1200])
def test_a_range_is_found_by_halving(spark, values):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "o long, i long")
    got = scan.ranged(df, ("o", "i"), 16)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "filter(" not in plan and plan.count("aggregate(") == 1  # no bound after the other for every row
    rows = sorted(got.collect(), key=lambda r: (r.o is not None, r.o or 0, r.i))
    ranges = [r[scan._RANGE] for r in rows]
    assert ranges == sorted(ranges) and set(ranges) == set(range(16))
    assert max(map(ranges.count, range(16))) < 4 * len(rows) / 16


def test_numbers_are_joined_where_their_window_lies(spark):
    df = spark.createDataFrame([(g, i) for i, g in enumerate(["a", None] * 4000)], "g string, o long")
    plan = scan.numbered(df, ("o",), "n", ("g",), 8)._jdf.queryExecution().executedPlan().toString()
    wide, narrow = plan.count("Exchange hashpartitioning"), plan.count("HashAggregate")
    assert narrow and wide <= 4  # the rows once, the sums three times
