"""Host evaluators and their faults, recorded pages, and score tables that were tampered with."""

import json
import os

import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from gaugework.operators import host
from gaugework.sinks import store
from gaugework.sinks.records import SetupError
from gaugework.sources import pages


def examples(spark):
    return spark.createDataFrame([(i, "ab" * i if i else None) for i in range(40)], "example_id long, text string").repartition(4)


def registered(**made):
    r = host.Registry()
    for name, (outputs, fn, bounds) in made.items():
        r.add(host.Evaluator(name, "1", ("text",), outputs, fn, **bounds))
    return r


def _crash(batch):
    raise KeyError("x" * 1000)


FAULTS = {
    "crash": (("m",), _crash, {}, "evaluator_crashed"),
    "kind": (("m",), lambda b: [1.0] * b.num_rows, {}, "evaluator_bad_return"),
    "number": (("m",), lambda b: {"m": ["high"] * b.num_rows}, {}, "evaluator_bad_return"),
    "truth": (("m",), lambda b: {"m": [True] * b.num_rows}, {}, "evaluator_bad_return"),
    "nan": (("m",), lambda b: {"m": [float("nan")] * b.num_rows}, {}, "evaluator_bad_return"),
    "scalar": (("m",), lambda b: {"m": 1.0}, {}, "evaluator_bad_return"),
    "short": (("m",), lambda b: {"m": [1.0]}, {}, "evaluator_bad_return"),
    "other": (("m",), lambda b: {"n": [1.0] * b.num_rows}, {}, "evaluator_undeclared"),
    "range": (("m",), lambda b: {"m": [2.0] * b.num_rows}, {"low": 0.0, "high": 1.0}, "evaluator_contract"),
}


@pytest.mark.parametrize("name", FAULTS)
def test_a_fault_is_no_score_and_ends_the_run(spark, name):
    outputs, fn, bounds, code = FAULTS[name]
    r = registered(**{name: (outputs, fn, bounds), "good": (("chars",), lambda b: {"chars": pc.utf8_length(b.column(0))}, {})})
    s = host.evaluated(examples(spark), r, [f"{name}@1", "good"])
    rows = s.collect()
    assert sum(x.metric == "chars" and x.fault is None for x in rows) == 40  # others are not touched
    bad = [x for x in rows if x.metric != "chars"]
    assert bad and all(x.value is None and x.status == "error" and x.code == code and len(x.fault) <= host.CAUSE_CHARS for x in bad)
    found = host.faults(s).collect()
    assert [(f.evaluator, f.code) for f in found] == [(f"{name}@1", code)]
    with pytest.raises(Exception, match="setup error"):
        host.checked(s).groupBy("metric").agg(F.avg("value"), F.count("status")).collect()


def test_versions_are_never_taken_for_each_other():
    r = registered(a=(("m",), _crash, {}))
    assert r.resolve("a").ref == r.resolve("a@1").ref == "a@1"
    for ref in ("a@2", "b", "b@1"):
        with pytest.raises(SetupError, match="evaluator_"):
            r.resolve(ref)
    with pytest.raises(SetupError, match="duplicate"):
        r.add(r.resolve("a"))
    r.add(host.Evaluator("a", "2", ("text",), ("m",), _crash))
    with pytest.raises(SetupError, match="version"):
        r.resolve("a")


def test_evaluators_of_a_file(spark, tmp_path):
    (tmp_path / "mine.py").write_text("import pyarrow.compute as pc\nN = 3\ndef score(batch):\n    return {'m': pc.add(pc.utf8_length(batch.column(0)), N)}\n")
    (tmp_path / "bad.py").write_text("1 / 0\n")
    r = host.Registry()
    e = r.load("mine.py:score", tmp_path, ("text",), ("m",))
    got = {x.example_id: x.value for x in host.checked(host.evaluated(examples(spark), r, [e.ref])).collect()}
    assert got["0"] is None and got["5"] == 13.0 and len(got) == 40
    for ref, code in (("gone.py:score", "file_not_found"), ("bad.py:score", "import_failed"), ("mine.py:none", "attr_missing"), ("mine.py:N", "not_callable")):
        with pytest.raises(SetupError, match=code):
            r.load(ref, tmp_path, ("text",), ("m",))
    with pytest.raises(SetupError, match="column_missing"):
        host.evaluated(examples(spark).drop("text"), r, [e.ref])


def recording(folder, name, made):
    os.makedirs(f"{folder}/{name}", exist_ok=True)
    with open(f"{folder}/{name}/part-0.txt", "w") as f:
        f.writelines(x if isinstance(x, str) else json.dumps(x) + "\n" for x in made)


def test_pages_are_followed_to_their_end_or_fault(spark, tmp_path):
    page = lambda c, n, items: {"cursor": c, "next": n, "items": items}
    recording(tmp_path, "fine", [page("b", None, [3]), page(None, "a", [{"z": 1, "a": "é\n"}, 1]), page("a", "b", [])])
    recording(tmp_path, "loop", [page(None, "a", [1]), page("a", "b", [2]), page("b", "a", [3])])
    recording(tmp_path, "gone", [page(None, "a", [1])])
    recording(tmp_path, "text", [page(None, "a", [1]), {"cursor": "a", "items": "x"}])
    recording(tmp_path, "broken", ['{"cursor": null, "items"\n'])
    recording(tmp_path, "long", [page(None if i == 0 else str(i), str(i + 1), [i]) for i in range(9)])
    rows = pages.recorded(spark, str(tmp_path), 5)
    of = {r.recording: (r.pages, r.items, r.rejected, r.codes, r.completeness) for r in pages.manifest(rows).collect()}
    assert of["fine"] == (3, 3, 0, "", "complete_within_declared_scope")
    assert of["loop"] == (3, 3, 1, "cursor_repeated", "partial") and of["gone"] == (1, 1, 1, "fetch_failed", "partial")
    assert of["text"] == (1, 1, 1, "page_malformed", "partial") and of["broken"] == (0, 0, 1, "fetch_failed", "blocked")
    assert of["long"] == (5, 5, 1, "page_limit", "partial")
    assert [json.loads(r.item) for r in rows.filter("recording = 'fine'").sort("page", "place").collect()] == [{"z": 1, "a": "é\n"}, 1, 3]
    assert rows.rdd.getNumPartitions() == 6
    os.makedirs(tmp_path / "none")
    assert pages.recorded(spark, str(tmp_path / "none")).count() == 0


def test_merkle_roots_differ_with_each_leaf():
    leaves = [f"{i:064x}" for i in range(7)]
    roots = {store.merkle(leaves[:n]) for n in range(8)} | {store.merkle([*leaves[:3], f"{99:064x}", *leaves[4:]])}
    assert len(roots) == 9


def test_one_changed_byte_is_named(spark, tmp_path):
    folder = str(tmp_path / "scores")
    scores = spark.range(1000).select(F.col("id").alias("example_id"), F.lit("m").alias("metric"), (F.col("id") / 7).alias("value")).repartition(3)
    root = store.put(scores, folder)
    made = store.manifest(folder)
    assert made["root"] == root and made["rows"] == 1000 and len(made["files"]) == 3
    assert sorted(map(tuple, store.get(spark, folder).collect())) == sorted(map(tuple, scores.collect()))
    with pytest.raises(SetupError, match="complete"):
        store.put(scores, folder)
    (tmp_path / "scores/part-stray.parquet").write_bytes(b"of a lost task")
    assert store.get(spark, folder).count() == 1000
    name = made["files"][1]["name"]
    data = bytearray((tmp_path / "scores" / name).read_bytes())
    data[len(data) // 2] ^= 1
    (tmp_path / "scores" / name).write_bytes(data)
    assert [tuple(r) for r in store.tampered(spark, folder).collect()] == [(name, "changed")]
    with pytest.raises(SetupError, match=f"{name} is changed"):
        store.get(spark, folder)
    (tmp_path / "scores" / name).unlink()
    assert [tuple(r) for r in store.tampered(spark, folder).collect()] == [(name, "missing")]
    text = (tmp_path / "scores/_manifest.json").read_text()
    (tmp_path / "scores/_manifest.json").write_text(text.replace("1000", "1001"))
    with pytest.raises(SetupError, match="mismatch"):
        store.manifest(folder)


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "scores")
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        store.put(bad, folder)
    with pytest.raises(SetupError, match="incomplete"):
        store.get(spark, folder)
    store.put(spark.range(10), folder)  # whatever a killed task may still leave is no part of the table
    assert store.get(spark, folder).count() == 10
