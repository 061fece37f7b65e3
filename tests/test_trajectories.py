import random

from gaugework.operators import scorers as S
from gaugework.operators import trajectories as T
from gaugework.plans import scorers

CALLS = "trace_id string, unit_id string, ordinal bigint, input int, output string, egress_ok boolean"


def calls(seed=3):
    r = random.Random(seed)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), f"u{i:05d}", r.choice([None, *range(400)]), i, r.choice([None, "x", ""]), r.random() > 0.0002) for i in range(6000)]
    return [*rows, ("one", "u", 1, 1, None, None), ("two", "u", 1, 1, "x", True)]


def by_trace(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_chunks_hold_each_call_once_in_order(spark):
    rows = calls()
    own = by_trace(rows)
    for size in (1, 7, 1000, 100_000):
        got = {}
        for c in sorted(T.chunked(spark.createDataFrame(rows, CALLS), size).collect(), key=lambda c: c.chunk):
            assert c.start == c.chunk * size and 0 < len(c.members) <= size
            got.setdefault(c.trace_id, []).extend(zip(c.members, c.inputs, c.outputs))
        assert got == {k: [(r[1], r[3], r[4]) for r in v] for k, v in own.items()}


def test_headers_equal_plain_counts_and_a_null_permission_forbids(spark):
    rows = calls()
    got = {h.trace_id: h[1:] for h in T.headers(spark.createDataFrame(rows, CALLS)).collect()}
    least = lambda v: min((r[2] for r in v if r[2] is not None), default=None)
    assert got == {k: (len(v), sum(r[4] is not None for r in v), all(r[5] is True for r in v), least(v)) for k, v in by_trace(rows).items()}
    assert got["one"][2] is False and got["two"][2] is True


def test_no_calls_no_rows(spark):
    none = spark.createDataFrame([], CALLS)
    assert T.headers(none).count() == T.chunked(none).count() == 0


def test_score_holds_no_list(spark):
    plan = scorers.score_trajectory_shape(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_unmeasured_scores_tell_why(spark):
    """A score that doesn't apply, one that is wrong and one that wasn't made are three things."""
    lit = S.F.lit
    one = spark.range(1)
    say = lambda s: one.select(s.alias("s")).first().s.validity
    assert say(S.exact_match(lit(None).cast("string"), lit("x"))) == "not_applicable"
    assert say(S.numeric_bounds(S.F.parse_json(lit('{"k": "x"}')), "k", 0, 1)) == "invalid"
    judged = lambda status, value: say(S.judge_score(lit(status).cast("string"), lit(value).cast("double")))
    assert [judged("timeout", None), judged("ok", None), judged("ok", 2.0), judged("ok", 0.5)] == ["not_measured"] * 3 + ["valid"]
    assert say(S.judge_score(lit(None).cast("string"), lit(None).cast("double"), required=False)) == "not_applicable"
