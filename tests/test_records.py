"""Run records, series, text sinks, large JSON Lines files and pages."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gaugework.functions import values as V
from gaugework.operators import decide as D, judge as J, scoring as S
from gaugework.sinks import records as R, series, text
from gaugework.sources import jsonl, spans

RECORD, SUMMARY = {"run_id": "a b", "scores": [1.5]}, {"verdict": "pass"}


def test_records_are_whole_or_refused(spark, tmp_path):
    scores = spark.createDataFrame([("m", 1.0), ("n", 2.0)], "metric string, value double")
    folder = R.persist(tmp_path, "a b/../c", RECORD, SUMMARY, scores)
    assert folder.parent == tmp_path.resolve() and R.verified(folder) is None and R.load(folder) == RECORD
    assert oct(os.stat(folder / R.RECORD).st_mode)[-3:] == "600" and spark.read.parquet(str(folder / R.SCORES)).count() == 2
    with pytest.raises(R.SetupError):
        R.persist(tmp_path, "a b/../c", RECORD, SUMMARY)
    other = R.persist(tmp_path, "other", RECORD, SUMMARY)
    got = {r.run: r.ok for r in R.verified_many(spark, str(tmp_path)).collect()}
    assert got == {folder.name: True, "other": True}
    base = R.promote(folder, tmp_path / "base")
    assert R.load(base) == RECORD
    (other / R.SUMMARY).write_text("{}")
    assert R.verified(other) == R.SUMMARY
    with pytest.raises(R.SetupError):
        R.promote(other, tmp_path / "base")
    (other / R.MARKER).unlink()
    assert R.verified(other) == "incomplete" and R.load(base) == RECORD
    assert {r.run: r.ok for r in R.verified_many(spark, str(tmp_path)).collect()}["other"] is False


@pytest.mark.parametrize("parts", [("..", "x"), ("a", "..", "..", "x"), ("link", "x")])
def test_nothing_leaves_the_root(tmp_path, parts):
    root = tmp_path / "root"
    root.mkdir()
    (root / "link").symlink_to(tmp_path)
    with pytest.raises(R.SetupError):
        R.inside(root, *parts)
    with pytest.raises(R.SetupError):
        R.safe_name("..")


def test_series_grow_once_a_run(spark, tmp_path):
    folder = R.persist(tmp_path, "r1", RECORD, SUMMARY)
    entry = {"series_id": "s", "run_id": "r1", "run_key": series.run_key(RECORD), "verdict": "pass"}
    assert series.record_run(tmp_path, entry, folder) and not series.record_run(tmp_path, entry, folder)
    (tmp_path / series.INDEX).write_text((tmp_path / series.INDEX).read_text() + "broken\n")
    assert series.record_run(tmp_path, entry | {"run_key": "k2"}, folder)
    got = series.read_index(spark, str(tmp_path / series.INDEX)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.run_key) for r in got] == [(1, entry["run_key"]), (3, "k2")]
    (folder / R.MARKER).unlink()
    assert not series.record_run(tmp_path, entry | {"run_key": "k3"}, folder)


def test_hosted_sinks_ask_the_policy_and_redact():
    sent = []
    assert R.post("forbidden", "https://u:p@h.org/a?key=1", {}, lambda *a: sent.append(a)) == {"status": "blocked", "code": "lane_export_failed", "endpoint": "https://h.org/a"}
    assert R.post("redacted", "https://h.org/a#f", {"x": 1}, lambda *a: sent.append(a))["status"] == "ran" and sent == [("https://h.org/a#f", '{"x":1}')]

    def fault(*_):
        raise OSError("https://u:p@h.org")

    assert R.post("permitted", "https://u:p@h.org/a", {}, fault) == {"status": "blocked", "code": "lane_export_failed", "endpoint": "https://h.org/a", "cause": "OSError"}


def test_lines_are_written_sorted(spark, tmp_path):
    rows = spark.createDataFrame([("b", '{"z": 1, "a": null}', None), ("a", "[1]", "n")], "example_id string, j string, note string").select("example_id", F.parse_json("j").alias("output"), "note")
    assert text.write_one_file(rows, tmp_path / "x.jsonl") == 2
    assert [json.loads(x) for x in (tmp_path / "x.jsonl").read_text().splitlines()] == [{"example_id": "a", "note": "n", "output": [1]}, {"example_id": "b", "output": {"z": 1, "a": None}}]
    with pytest.raises(ValueError, match="write_lines"):
        text.write_one_file(rows, tmp_path / "y.jsonl", most=1)
    text.write_lines(rows, f"{tmp_path}/z")
    assert spark.read.text(f"{tmp_path}/z").count() == 2
    out = text.report({"verdict": "fail", "ci_should_fail": True}, [{"metric": "a|b", "verdict": "fail", "value": None}, {"metric": "c", "verdict": "pass", "value": 0.5, "lower": 0.25, "upper": 1.0, "n": 3}])
    assert "| a\\|b | fail | n/a | n/a | 0 |  |" in out and "| c | pass | 0.5 | [0.25, 1] | 3 |  |" in out


def test_split_files_keep_their_line_numbers(spark, tmp_path):
    every = [f'{{"input": {i}}}' if i % 7 else "" for i in range(20_000)]
    (tmp_path / "a.jsonl").write_text("\n".join(every) + "\n")
    (tmp_path / "b.jsonl").write_text("[1]\n\n[2]")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = jsonl.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    a = {r.line: r.raw for r in got if r.path.endswith("a.jsonl")}
    assert a == {i + 1: x for i, x in enumerate(every) if x}
    assert sorted((r.line, r.raw) for r in got if r.path.endswith("b.jsonl")) == [(1, "[1]"), (3, "[2]")]


def test_pages_stop_with_what_they_have():
    pages = {None: ([1], "a"), "a": ([2], "b"), "b": ([3], None)}
    assert spans.collect_pages(pages.__getitem__) == ([1, 2, 3], None)
    assert spans.collect_pages(pages.__getitem__, 2) == ([1, 2], "page_limit")
    assert spans.collect_pages({None: ([1], "a"), "a": ([2], "a")}.__getitem__) == ([1, 2], "cursor_repeated")
    assert spans.collect_pages({None: ([1], "a"), "a": ("x", None)}.__getitem__) == ([1], "page_malformed")
    assert spans.collect_pages({None: ([1], "a")}.__getitem__) == ([1], "fetch_failed")
    asked = []
    assert spans.connected("unknown", lambda: asked.append(1), lambda p: p, "x") == (None, "x_egress_forbidden") and not asked
    assert spans.connected("permitted", lambda: 1 / 0, lambda p: p, "x") == (None, "backend_unavailable")


def test_fences_tolerance_and_shown_numbers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(V.unfenced(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}' and one(V.unfenced(F.lit("x ``` y"))) == "x ``` y"
    for a, b, want in ((None, None, True), (None, 1.0, False), (1.0, 1.0 + 1e-10, True), (1.0, 1.00001, False), (0.0, 1e-13, True)):
        assert one(V.close(F.lit(a).cast("double"), F.lit(b).cast("double"))) is want
    for x in (0.0, 1.0, 0.123456, 12.34567, 1234.4, 1e-3, -0.5):
        assert one(V.shown(F.lit(x))) == f"{x:.4g}"
    assert [one(V.canonical(F.parse_json(F.lit(j)))) for j in ("1", "1.0", "1e0", '"1"', "true", "null", '{"b":1,"a":2}')] == ["1", "1", "1", '"1"', "true", "null", '{"a":2,"b":1}']


def test_ranges_and_undeclared_scores_end_the_run(spark):
    ex = spark.createDataFrame([("a", "a", 2.0)], "example_id string, unit_id string, x double")
    score = lambda: F.struct(F.col("x").alias("value"), F.lit("scored").alias("status"), F.lit("valid").alias("validity"), F.lit(None).cast("string").alias("code"))
    with pytest.raises(Exception, match="outside its declared range"):
        S.scored(ex, [S.Metric("m", score, low=0.0, high=1.0)]).collect()
    with pytest.raises(ValueError):
        S.scored(ex, [S.Metric("m", score), S.Metric("m", score)])
    b = spark.createDataFrame([("a", "m", ["r"], [("other", 1.0, "scored", "valid", None)])], "example_id string, metric string, refs array<string>, scores array<struct<metric:string,value:double,status:string,validity:string,refs:array<string>>>")
    with pytest.raises(Exception, match="undeclared score other"):
        S.flattened(b, {"m": ["m"]}).collect()
    with pytest.raises(Exception, match="cannot approve"):
        spark.range(1).select(D.supports_threshold(F.lit(True), F.lit(True))).collect()


def test_a_host_judge_is_tried_again_and_cached(spark):
    def call(row):
        if row["x"] == 1:
            raise RuntimeError
        return {"status": "ok", "value": row["x"] / 10}

    e = spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, x long")
    got = {r.key: (r.status, r.value, r.code, r.attempts) for r in J.external(e, call).collect()}
    assert got == {"k1": ("provider_error", None, "RuntimeError", 3), "k2": ("ok", 0.2, None, 1)}
    eff = spark.createDataFrame([("a", "m", "k1", True, True), ("b", "m", "k2", True, True), ("c", "m", "k3", False, True)], "example_id string, metric string, key string, permitted boolean, dispatched boolean")
    ok = J.result("ok", F.lit(0.5))
    first = J.answered(eff, None, ok)
    cache = J.to_cache(first, None)
    assert {r.key for r in cache.collect()} == {"k1", "k2"} and J.to_cache(first, cache).count() == 0
    again = {r.key: (r.result.value, r.cache_state) for r in J.answered(eff, cache, J.result("ok", F.lit(0.9))).collect()}
    assert again == {"k1": (0.5, "hit"), "k2": (0.5, "hit"), "k3": (None, None)}
    fresh = {r.key: r.result.value for r in J.answered(eff, cache, J.result("ok", F.lit(0.9)), "refresh").collect()}
    assert fresh["k1"] == 0.9
