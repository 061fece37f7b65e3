"""Ordered sums, order statistics, fingerprints, scorers over JSON values and authority from missing data."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.operators import aggregate as A, compare, decide as D, digests, joins, judge as J, plan, scorers as S, select
from gaugework.operators.scan import numbered
from gaugework.plans.scorers import _w, load
from gaugework.sources import jsonl


def quartiles(spark, sf):
    """Quartiles of the lines' prices by return flag, and of values with many ties."""
    li = load(spark, sf, "lineitem")
    rows = li.select("l_returnflag", F.col("l_extendedprice").alias("value")).union(li.select(F.concat(F.lit("q/"), "l_returnflag"), F.col("l_quantity")))
    got = select.quantile(rows.toDF("metric", "value"), "metric", (0.25, 0.5, 0.75, 0.99))
    return got.select("metric", "share", F.round("value", 6).alias("value"))


def run_budget(spark, sf):
    """All events are one run: what is still sent before its requests and costs reach their limits."""
    e = load(spark, sf, "events").select("event_id", "value", (F.col("event_id") % 7 != 0).alias("permitted"))
    out = J.within_budget(e, "event_id", {"requests": (F.when(F.col("permitted"), 1).otherwise(0), 6000), "cost": (J.cost(F.col("value"), F.lit(0.5)), 150.0)})
    return out.select("event_id", "dispatched")


def subject_numbers(spark, sf):
    """Subjects of a run in the order of language and id."""
    d = load(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    return plan.subjects(d, "lang", "doc_id").select("doc_id", "subject_id")


def _fingerprint(spark, sf, changed: bool):
    """Dimensions of a run; in the changed one a document differs, one is doubled and one line of an order is gone."""
    d, li = load(spark, sf, "documents").select("doc_id", "text"), load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    labels = load(spark, sf, "labels").select("doc_id", "quality")
    if changed:
        d = d.withColumn("text", F.when(F.col("doc_id") == 5, F.lit("other")).otherwise(F.col("text")))
        labels = labels.union(labels.groupBy().agg(F.min("doc_id").alias("doc_id"), F.lit(0).cast("long").alias("quality")))
        li = li.filter("NOT (l_orderkey = 1 AND l_linenumber = 1)")
    events = load(spark, sf, "events").select("event_id", "event_type")
    if changed:
        events = events.repartition(5).sort(F.desc("event_id"))
    return digests.dimensions({"dataset": (d, ["doc_id", "text"]), "metric": (li, ["l_orderkey", "l_linenumber"]), "authority": (labels, ["doc_id", "quality"]), "example": (events, ["event_id", "event_type"])})


def run_fingerprint(spark, sf):
    """The multiset digest of each dimension's rows."""
    return _fingerprint(spark, sf, False)


def fingerprint_compare(spark, sf):
    """Which dimensions of two runs differ, and the state of the comparison that follows."""
    now, then = _fingerprint(spark, sf, True), _fingerprint(spark, sf, False)
    c = compare.changed_dimensions(now, then, ("dataset", "metric", "authority", "example", "config"))
    any_ = c.agg(F.bool_or("changed").alias("any"))
    return c.crossJoin(F.broadcast(any_)).select("dimension", "changed", compare.baseline_state(F.lit(True), F.lit(True), F.col("any")).alias("state"))


def exact_match_objects(spark, sf):
    """Objects that are equal but for the order of members and the form of numbers, that differ, and absent ones."""
    k = F.col("event_id")
    text = lambda c: c.cast("string")
    out = F.concat(F.lit('{"a": '), text(k % 7), F.lit(', "b": ["x 1.0", '), text(k % 3), F.lit("]}"))
    ref = F.concat(F.lit('{"b": ["x 1.0", '), text(k % 3), F.lit('.0],  "a": '), text(k * k % 7), F.lit("}"))
    e = load(spark, sf, "events").select("event_id", F.parse_json(F.when(k % 11 == 0, "null").when(k % 13 != 0, out)).alias("o"), F.parse_json(F.when(k % 17 != 0, ref)).alias("r"))
    return e.select("event_id", F.inline(F.array(S.exact_match(F.col("o"), F.col("r"), json=True))))


def enum_objects(spark, sf):
    """A member of each event's properties against texts, numbers and null."""
    k = F.col("event_id")
    value = F.element_at(F.array(*map(F.lit, ("1", "1.0", '"1"', "null", "[1]", "2"))), (k % 6 + 1).cast("int"))
    doc = F.when(k % 7 == 0, F.lit("[1]")).when(k % 11 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"it\'s": '), value, F.lit("}")))
    e = load(spark, sf, "events").select("event_id", F.parse_json(doc).alias("p"))
    return e.select("event_id", F.inline(F.array(S.enum_field(F.col("p"), "it's", [1, None, [1]]))))


def authority_missing(spark, sf):
    """Every input of authority missing in turn: none of them may gate."""
    k = F.col("o_orderkey") % 8
    hide = lambda i, v: F.when(k != i, v)
    a = D.authority(hide(1, F.lit("gating")), hide(2, F.lit(True)), hide(3, F.lit("validated")), hide(4, F.lit("permitted")), hide(5, F.lit(False)), F.lit("matched"), F.lit("calibrated"), hide(6, F.lit(False)), hide(7, F.lit("comparable")))
    return load(spark, sf, "orders").select("o_orderkey", F.inline(F.array(a))).select("o_orderkey", "level", "can_gate", "blocked", F.array_join("reasons", ",").alias("reasons"))


def answer_nonempty(spark, sf):
    """Whether the answer of an object is a text with characters."""
    k = F.col("event_id")
    value = F.element_at(F.array(*map(F.lit, ('{"answer": "a"}', '{"answer": ""}', '{"answer": 1}', '{"other": 1}', "[]", '{"answer": null}'))), (k % 6 + 1).cast("int"))
    e = load(spark, sf, "events").select("event_id", F.try_parse_json(F.when(k % 7 != 0, value)).alias("p"))
    return e.select("event_id", F.inline(F.array(S.answer_nonempty(F.col("p")))))


def clusters_in_order(spark, sf):
    """Failure clusters of the events with their place in a report."""
    e = load(spark, sf, "events")
    d = e.select(F.col("event_type").alias("metric"), F.col("event_id").alias("score_id"), F.when(F.col("value") > 100, "high").when(F.col("value") > 50, "middle").alias("code"), F.when(F.col("value") > 100, "error").otherwise("warning").alias("severity"), F.lit("m").alias("message")).filter("code IS NOT NULL")
    found = A.clusters(d).select("*", F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2).alias("level"), (-F.col("n")).alias("fewer"))
    return numbered(found, ("level", "fewer", "metric", "code"), "place").select("metric", "code", "severity", "n", "place")


def source_counts(spark, sf):
    """What each source of a chain of joins gave: orders, their customers, and customers that no order names."""
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    kept, dropped = joins.assemble(o.select("o_orderkey", "o_custkey"), c.filter("c_custkey % 3 <> 0").select("c_custkey", "c_name"), "o_custkey", "c_custkey", joins.ONE)
    count = lambda df, n: df.agg(F.lit(n).alias("part"), F.count("*").alias("n"))
    return count(o, "orders").union(count(kept, "kept")).union(count(dropped, "dropped"))



def set_overlap_objects(spark, sf):
    """Records whose outputs and references are objects, lists, texts, numbers, booleans and nulls in turn."""
    e = load(spark, sf, "events").withColumns({"k": F.get_json_object("props", "$.k"), "i": F.col("event_id") % 7})
    k, kind, fill = F.col("k"), F.col("event_type"), F.format_string
    pairs = [
        (fill('{"k":%s, "kind": "%s", "at" : [1.50, null, true, {"who": "it\'s me"}]}', k, kind), fill('{"k": %s,"kind": "view", "at": [1.5, null, false, {"who": "it\'s you"}]}', k)),
        (fill('{"kind": "%s", "k": %s}', kind, k), fill('{"k": %s, "kind": "%s"}', k, kind)),
        (fill('["%s", 1e2, [], {}]', kind), F.lit('["click", 100.0, [], {}]')),
        (fill('"say  %s now"', kind), F.lit('"say click\\tnow"')),
        (k, fill('"%s"', k)),
        (F.when(k.cast("int") % 2 == 0, "true").otherwise("false"), F.lit('"True"')),
        (F.lit("null"), k),
    ]
    pick = lambda side: F.element_at(F.array(*[p[side] for p in pairs]), (F.col("i") + 1).cast("int"))
    raw = e.select("event_id", F.concat(F.lit('{"input": 1, "output": '), pick(0), F.lit(', "reference": '), pick(1), F.lit("}")).alias("raw"))
    doc = jsonl.parsed(raw)
    out, ref = (jsonl.member_text(F.col("raw"), F.col("doc"), c) for c in ("output", "reference"))
    return doc.select("event_id", F.inline(F.array(S.set_overlap_json(out, ref)))).withColumn("value", F.round("value", 9))

QUERIES = {f.__name__: f for f in (quartiles, run_budget, subject_numbers, run_fingerprint, fingerprint_compare, exact_match_objects, enum_objects, set_overlap_objects, authority_missing, answer_nonempty, clusters_in_order, source_counts)}


def _limb_digest(rows: str, text: str) -> str:
    """The sum of SHA-256 hashes modulo 2**256 by limbs of 32 bits, carries taken upwards."""
    sums = ", ".join(f"coalesce(sum(('0x' || substr(h, {57 - 8 * i}, 8))::UBIGINT::HUGEINT), 0) AS l{i}" for i in range(8))
    carry, limbs = "0::HUGEINT", []
    inner = f"(SELECT count(*) AS n, {sums} FROM (SELECT sha256({text}) AS h FROM {rows}))"
    for i in range(8):
        inner = f"(SELECT *, (l{i} + {carry}) % 4294967296 AS d{i}, (l{i} + {carry}) // 4294967296 AS c{i} FROM {inner})"
        carry = f"c{i}"
        limbs.append(f"lpad(lower(to_hex(d{i}::UBIGINT)), 8, '0')")
    return f"SELECT n, {' || '.join(reversed(limbs))} AS digest FROM {inner}"


_T = lambda *cols: " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE length({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in cols)
_PRINTS = " UNION ALL ".join(f"SELECT '{d}' AS dimension, n, digest FROM ({_limb_digest(t, _T(*c))})" for d, t, c in (("dataset", "documents", ("doc_id", "text")), ("metric", "lineitem", ("l_orderkey", "l_linenumber")), ("authority", "labels", ("doc_id", "quality")), ("example", "events", ("event_id", "event_type"))))
_AUTH = "o_orderkey % 8"

ORACLE = {
    "quartiles": """WITH r AS (SELECT l_returnflag AS metric, l_extendedprice AS value FROM lineitem UNION ALL SELECT 'q/' || l_returnflag, l_quantity FROM lineitem),
      s AS (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.99::DOUBLE]) AS share),
      o AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY value) AS i, count(*) OVER (PARTITION BY metric) AS n FROM r WHERE value IS NOT NULL)
      SELECT metric, share, round(value, 6) AS value FROM o, s WHERE i = greatest(1, ceil(share * n))""",
    "run_budget": "SELECT event_id, coalesce(sum((event_id % 7 <> 0)::INT) OVER w, 0) < 6000 AND coalesce(sum(round(value / 1000 * 0.5::DOUBLE, 12)::DECIMAL(28, 12)) OVER w, 0) < 150.0 AS dispatched FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "subject_numbers": "SELECT doc_id, 's' || (row_number() OVER (ORDER BY coalesce(lang, ''), doc_id) - 1) AS subject_id FROM documents",
    "run_fingerprint": _PRINTS,
    "fingerprint_compare": "SELECT unnest(['dataset', 'metric', 'authority', 'example', 'config']) AS dimension, unnest([(SELECT count(*) > 0 FROM documents WHERE doc_id = 5), (SELECT count(*) > 0 FROM lineitem WHERE l_orderkey = 1 AND l_linenumber = 1), true, false, true]) AS changed, 'not_comparable' AS state",
    "exact_match_objects": """SELECT event_id, CASE WHEN code IS NULL THEN (k % 7 = k * k % 7)::INT::DOUBLE END AS value, CASE WHEN code IS NULL THEN 'scored' ELSE 'non_evaluable' END AS status, CASE WHEN code IS NULL THEN 'valid' ELSE 'not_applicable' END AS validity, code FROM (
      SELECT event_id, event_id AS k, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 'exact_match.no_output' WHEN event_id % 17 = 0 THEN 'exact_match.no_reference' END AS code FROM events)""",
    "set_overlap_objects": f"""WITH t AS (SELECT event_id, event_id % 7 AS i, props->>'$.k' AS k, event_type AS e FROM events), v AS (SELECT event_id, i,
      CASE i WHEN 0 THEN '{{''k'': ' || k || ', ''kind'': ''' || e || ''', ''at'': [1.5, None, True, {{''who'': "it''s me"}}]}}' WHEN 1 THEN '{{''kind'': ''' || e || ''', ''k'': ' || k || '}}' WHEN 2 THEN '[''' || e || ''', 100.0, [], {{}}]'
        WHEN 3 THEN 'say  ' || e || ' now' WHEN 4 THEN k WHEN 5 THEN CASE WHEN k::INT % 2 = 0 THEN 'True' ELSE 'False' END END AS o,
      CASE i WHEN 0 THEN '{{''k'': ' || k || ', ''kind'': ''view'', ''at'': [1.5, None, False, {{''who'': "it''s you"}}]}}' WHEN 1 THEN '{{''k'': ' || k || ', ''kind'': ''' || e || '''}}' WHEN 2 THEN '[''click'', 100.0, [], {{}}]'
        WHEN 3 THEN 'say click' || chr(9) || 'now' WHEN 5 THEN 'True' ELSE k END AS r FROM t), w AS (SELECT event_id, i, list_distinct({_w('o')}) AS a, list_distinct({_w('r')}) AS b FROM v)
      SELECT event_id, CASE WHEN i < 6 THEN round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 9) END AS value, CASE WHEN i < 6 THEN 'scored' ELSE 'non_evaluable' END AS status,
      CASE WHEN i < 6 THEN 'valid' ELSE 'not_applicable' END AS validity, CASE WHEN i = 6 THEN 'set_overlap.no_output' END AS code FROM w""",
    "enum_objects": """SELECT event_id, CASE WHEN absent THEN NULL ELSE hit::INT::DOUBLE END AS value, CASE WHEN absent THEN 'non_evaluable' ELSE 'scored' END AS status, CASE WHEN absent THEN 'not_applicable' ELSE 'valid' END AS validity, CASE WHEN absent THEN 'enum_membership.field_absent' WHEN NOT hit THEN 'enum_membership.not_allowed' END AS code
      FROM (SELECT event_id, event_id % 7 = 0 OR event_id % 11 = 0 AS absent, event_id % 6 IN (0, 1, 3, 4) AS hit FROM events)""",
    "authority_missing": f"""SELECT o_orderkey, CASE WHEN {_AUTH} IN (1, 2, 3, 5) THEN 'informational' ELSE 'gating' END AS level, {_AUTH} IN (0, 6, 7) AS can_gate, {_AUTH} = 4 AS blocked,
      CASE {_AUTH} WHEN 1 THEN 'metric_status=missing' WHEN 2 THEN 'threshold_proposed' WHEN 3 THEN 'dataset_proposed' WHEN 4 THEN 'policy_missing' WHEN 5 THEN 'judge_fake_non_authoritative' ELSE '' END AS reasons FROM orders""",
    "answer_nonempty": "SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 6 IN (0, 2) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value, 'scored' AS status, 'valid' AS validity, NULL::VARCHAR AS code FROM events",
    "clusters_in_order": "WITH c AS (SELECT event_type AS metric, CASE WHEN value > 100 THEN 'high' ELSE 'middle' END AS code, CASE WHEN value > 100 THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM events WHERE value > 50 GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY severity, n DESC, metric, code) - 1 AS place FROM c",
    "source_counts": "SELECT 'orders' AS part, count(*) AS n FROM orders UNION ALL SELECT 'kept', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'dropped', count(*) FILTER (WHERE c_custkey IS NULL OR c_custkey % 3 = 0) FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
}
