import pytest
from pyspark.sql import functions as F

from gaugework.functions import values
from gaugework.sources import jsonl, spans

BAD = ['{bad', "[1]", '{"output":1}', '{"input":1,"id":true}', '{"input":1,"id":"  "}', '{"input":1,"context":[]}', '{"input":NaN}', '{"input":1,"id":1.5}', '{"input":1,"id":null}']


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows, 1)), "line long, raw string")


def test_lines_count_blank_ones(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"input": 1}\r\n\n \t\n  [2]  {"x": 3}\n', encoding="utf-8")
    got = [(r.line, r.raw) for r in jsonl.lines(spark, str(tmp_path / "a.jsonl")).orderBy("line").collect()]
    assert got == [(1, '{"input": 1}'), (4, "[2]"), (5, '{"x": 3}')]


def test_dataset_records(spark):
    good = ['{"input":null}', '{"input":1,"output":{"a":2},"reference":null}', '{"example_id":"q1","input":"x"}', '{"id":7,"example_id":"q","input":"x"}']
    rows = jsonl.dataset(frame(spark, good + BAD), "d").orderBy("line").collect()
    assert [r.example_id for r in rows[:4]] == ["d#1", "d#2", "q1", "7"]
    assert [(r.output is None, r.reference is None) for r in rows[:4]] == [(True, True), (False, True), (True, True), (True, True)]
    assert all(r.code is None for r in rows[:4])
    assert [r.code == "dataset_invalid_json" for r in rows[4:]] == [True, False, False, False, False, False, True, False, False]
    assert all(r.code and r.example_id is None for r in rows[4:])


def test_trace_records(spark):
    rows = ['{"trace_id":"t","behavior":{"input":1}}', '{"trace_id":"t","behavior":{},"data_policy":"redacted","unit_id":5}', '{"trace_id":"t"}', '["x"]', '{"trace_id":"t","behavior":{},"data_policy":"odd"}', '{"trace_id":" ","behavior":{}}', "nope", '{"trace_id":"t","behavior":{},"provenance":1}']
    got = jsonl.traces(frame(spark, rows), "s").orderBy("line").collect()
    assert [(r.unit_id, r.data_policy) for r in got[:2]] == [("s#1", "missing"), ("5", "redacted")]
    assert [r.code for r in got] == [None, None, *["trace_invalid_record"] * 4, "trace_invalid_json", "trace_invalid_record"]


def test_annotations_fail_whole(spark):
    good = ['{"annotation_id":"a","value":null}', '{"annotation_id":"b","value":1,"validation_record":"v"}']
    got = jsonl.annotations(frame(spark, good)).orderBy("line").collect()
    assert [(r.annotation_id, r.validation_record) for r in got] == [("a", None), ("b", "v")]
    for bad in ("x", "[]", '{"annotation_id":" ","value":1}', '{"annotation_id":"a"}', '{"annotation_id":"a","value":1,"validation_record":2}'):
        with pytest.raises(Exception, match="annotations line 3"):
            jsonl.annotations(frame(spark, [*good, bad])).count()


def test_empty_read(spark):
    r = jsonl.dataset_manifest(jsonl.dataset(frame(spark, []), "d")).first()
    assert (r.records_seen, r.completeness) == (0, "empty")


def evaluated(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_a_kind_and_a_canonical_text_read_the_schema_once(spark):
    df = spark.createDataFrame([("1",), ("1.0",), ('{"a": 1.0}',), ("null",), (None,), ("[]",), ('"x"',), ("1.5",)], "raw string").select("raw", F.inline(F.array(F.struct(F.try_parse_json("raw").alias("v")))))
    kinds, texts = df.select("raw", jsonl.kind(F.col("v")).alias("k")), df.select("raw", values.canonical(F.col("v")).alias("k"))
    assert evaluated(kinds, "schema_of_variant") + evaluated(kinds, "schemaOfVariant") == 1
    assert evaluated(texts, "schema_of_variant") + evaluated(texts, "schemaOfVariant") == 1
    assert [r.k for r in kinds.collect()] == ["integer", "integer", "object", "null", None, "array", "string", "number"]
    assert [r.k for r in texts.collect()] == ["1", "1", '{"a":1}', "null", None, "[]", '"x"', "1.5"]


@pytest.mark.parametrize("read, key", [(spans.runs, "runs"), (spans.nested_observations, "data"), (spans.rebuilt_spans, "spans")])
def test_a_recording_is_parsed_once(spark, read, key):
    raws = [f'{{"{key}": [5, "x"]}}', f'{{"{key}": 1}}', f'{{"{key}": null}}', f'[{{"{key}": []}}]', f'{{"{key}": []}}', "null", "{bad", None]
    rows = spark.createDataFrame(list(enumerate(raws)), "recording long, raw string")
    _, bad = read(rows)
    assert sorted(r.recording for r in bad.collect() if r.recording) == [1, 2, 3, 5, 6, 7]
    lists, missing = spans._exploded(rows, key, "bad")
    assert [evaluated(d, "parse_json") + evaluated(d, "parseJson") for d in (lists, missing)] == [1, 1]


def test_a_providers_span_holds_values_not_their_text(spark):
    raws = ['{"data": [{"id": "t", "name": "f", "sessionId": null, "observations": [{"id": "o", "output": {"a": [1, null, 12e2]}, "input": null, "usage": {"n": 3}, "startTime": "s", "endTime": 5}, 7]}]}', '{"data": [{"id": "u", "output": "whole", "timestamp": "x"}]}']
    units, _ = spans.nested_observations(spark.createDataFrame(list(enumerate(raws)), "recording long, raw string"))
    got = units.select("trace_id", "unit_id", *[F.to_json(c) for c in ("output", "input", "metadata", "timing")]).collect()
    assert sorted(map(tuple, got)) == [("t", "o", '{"a":[1,null,1200.0]}', None, '{"trace_name":"f","usage":{"n":3}}', '{"start_time":"s"}'), ("u", "u", '"whole"', None, "{}", '{"start_time":"x"}')]
    assert (evaluated(units, "StructsToJson"), evaluated(units, "observations")) == (0, 1)
