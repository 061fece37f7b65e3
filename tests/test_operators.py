import pytest
from pyspark.sql import functions as F

from gaugework.functions import stats
from gaugework.operators import aggregate as A, decide as D, scorers as S
from gaugework.operators.joins import assemble, paired


def test_quantiles_beyond_any_bracket():
    assert stats.t_value(1, 0.9999) == pytest.approx(6366.1976, rel=1e-6)


def test_textbook_quantiles():
    for df, t in {1: 12.706205, 2: 4.302653, 3: 3.182446, 4: 2.776445, 5: 2.570582, 10: 2.228139, 30: 2.042272, 100: 1.983972}.items():
        assert stats.t_value(df) == pytest.approx(t, abs=1e-6)
    assert stats.z_value(0.9) == pytest.approx(1.644854, abs=1e-6)


def test_wilson_textbook(spark):
    rows = spark.createDataFrame([(3, 3), (0, 3), (1, 1), (50, 100), (0, 0)], "k long, n long")
    got = [tuple(r) for r in rows.select(*stats.wilson(F.col("k"), F.col("n"))).collect()]
    for have, want in zip(got, [(0.438499, 1), (0, 0.561501), (0.206543, 1), (0.403832, 0.596168)]):
        assert have == pytest.approx(want, abs=1e-5)
    assert got[-1] == (None, None)


def scores(spark, rows):
    return spark.createDataFrame([("m", *r) for r in rows], "metric string, value double, status string, validity string")


def test_blocked_rows_are_counted_and_never_zero(spark):
    r = A.aggregated(scores(spark, [(None, "blocked", "not_measured"), (None, "blocked", "not_measured")]), median=True).first()
    assert r["mean"] is None and r["median"] is None and r.included == 0 and r.n_blocked == 2
    r = A.aggregated(scores(spark, [(1.0, "scored", "valid"), (2.0, "scored", "valid"), (4.0, "scored", "valid"), (10.0, "scored", "valid"), (99.0, "scored", "invalid")]), median=True).first()
    assert r["median"] == 3.0 and r.included == 4 and r.total == 5
    assert A.population(scores(spark, [(9.0, "scored", "invalid")])).first().n_error == 1


def test_medians_of_many_values(spark):
    import random
    import statistics

    rng = random.Random(4)
    for n, kinds in ((1, 5), (2, 5), (3001, 10**9), (4000, 7), (5000, 10**9)):
        v = [float(rng.randrange(kinds)) for _ in range(n)]
        got = A.medians(scores(spark, [(x, "scored", "valid") for x in v] + [(1e9, "scored", "invalid")])).first()
        assert got["median"] == statistics.median(v)


def test_payload_scorers(spark):
    rows = ['{"k": 5, "s": "3", "b": true, "n": null}', "[1]", None]
    d = spark.createDataFrame([(x,) for x in rows], "j string").withColumn("p", F.try_parse_json("j"))
    one = lambda c: [tuple(r[0]) for r in d.select(c).collect()]
    assert [x[0] for x in one(S.field_presence(F.col("p"), ["k", "n", "zz", "s"]))] == [0.75, None, None]
    assert [x[0] for x in one(S.structural_shape(F.col("p")))] == [1.0, 0.0, None]
    assert one(S.numeric_bounds(F.col("p"), "k", 5, 6))[0][0] == 1.0
    for field in ("s", "b", "n"):  # a text, a bool and a null are no numbers
        assert one(S.numeric_bounds(F.col("p"), field, 0, 6))[0] == (None, "error", "invalid", "numeric_bounds.not_numeric")
    assert one(S.numeric_bounds(F.col("p"), "zz", 0, 6))[0][3] == "numeric_bounds.field_absent"


def test_cardinalities_with_null_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "id int, k string")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "rk string, v int")
    miss, many = "assembly_join_missing", "assembly_join_ambiguous"
    got = {}
    for c in ("one_to_one", "one_to_many", "optional_one"):
        kept, gone = assemble(left, right, "k", "rk", c)
        got[c] = sorted((r.id, r.r and r.r.v) for r in kept.collect()), {r.id: r.diagnostic for r in gone.collect()}
    assert got["one_to_one"] == ([(1, 1), (3, 4)], {2: many, 4: miss})
    assert got["one_to_many"] == ([(1, 1), (2, 2), (2, 3), (3, 4)], {4: miss})
    assert got["optional_one"] == ([(1, 1), (3, 4), (4, None)], {2: many})


def test_last_usable_of_repeated_ids_counts(spark):
    kind = "metric string, example_id string, value double, status string, validity string, ordinal int"
    a = spark.createDataFrame([("m", "x", 1.0, "scored", "valid", 0), ("m", "x", 5.0, "scored", "valid", 1), ("m", "x", None, "blocked", "not_measured", 2), ("m", "", 1.0, "scored", "valid", 3)], kind)
    r = paired(a, a).collect()
    assert len(r) == 1 and r[0].now == 5.0


@pytest.mark.parametrize("verdicts, want", [([], "informational"), (["pass"], "pass"), (["pass", "fail"], "fail"), (["blocked", "fail"], "blocked")])
def test_verdict_precedence(spark, verdicts, want):
    g = spark.createDataFrame([(f"m{i}", v) for i, v in enumerate(verdicts)], "metric string, verdict string")
    assert D.decide(g).first().verdict == want
