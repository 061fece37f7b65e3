import json
import random

from pyspark.sql import functions as F

from gaugework.functions.pytext import python_text
from gaugework.operators.scorers import set_overlap_json
from gaugework.sources import jsonl

TEXTS = ["", "a b", "it's", 'say "x"', "it's \"both\"", "back\\slash", "tab\tline\n", "\x1c\x85\xa0　 wide", "é ☃ 😀", "null", "None"]


def value(r, depth=0):
    kind = r.randrange(8 if depth < 3 else 6)
    if kind == 0:
        return r.choice(TEXTS)
    if kind == 1:
        return r.choice([0, -1, 10**20, r.randrange(1000)])
    if kind == 2:
        return r.choice([1.0, -0.0, 1e5, 1e16, 1e-5, 2.5, r.random()])
    if kind in (3, 4):
        return r.choice([True, False, None])
    if kind == 5:
        return r.choice([[], {}])
    if kind == 6:
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice(TEXTS) + str(i): value(r, depth + 1) for i in range(r.randrange(4))}


def test_texts_and_overlaps_equal_pythons_own(spark):
    r = random.Random(5)
    pairs = [(value(r), value(r)) for _ in range(400)]
    pairs += [(a, a) for a, _ in pairs[:50]]
    rows = [(i, json.dumps(a, ensure_ascii=i % 2 == 0), json.dumps(b, indent=i % 3 or None)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = {x.i: x for x in df.select("i", python_text(F.col("a")).alias("t"), set_overlap_json(F.col("a"), F.col("b")).alias("s")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i].t == (None if a is None else str(a))
        if a is None or b is None:
            assert got[i].s.code == ("set_overlap.no_output" if a is None else "set_overlap.no_reference")
            continue
        x, y = set(str(a).split()), set(str(b).split())
        assert got[i].s.value == (len(x & y) / len(x | y) if x | y else 1.0)


def test_what_is_not_json_has_no_text(spark):
    bad = [None, "", "{", "NaN", '{"a": 1, "a": 2}', "[Infinity]", '"open', "[" * 100_000]
    df = spark.createDataFrame([(x,) for x in bad], "x string")
    assert [r.t for r in df.select(python_text(F.col("x")).alias("t")).collect()] == [None] * len(bad)
    assert spark.createDataFrame([], "x string").select(python_text(F.col("x"))).count() == 0


def test_member_text_keeps_the_order_of_keys(spark):
    raw = '{"output": {"z": 1, "a": [1.0, "x"]}, "reference": "t", "input": null}'
    df = jsonl.parsed(spark.createDataFrame([(raw,)], "raw string"))
    row = df.select(*[jsonl.member_text(F.col("raw"), F.col("doc"), c).alias(c) for c in ("output", "reference", "input", "absent")]).first()
    assert row.output == '{"z":1,"a":[1.0,"x"]}' and row.reference == '"t"' and row.input == "null" and row.absent is None
