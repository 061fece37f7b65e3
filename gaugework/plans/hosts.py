"""Host evaluators, recorded pages and stored scores, over the given tables."""

from __future__ import annotations

import sys

import pyarrow.compute as pc
from pyspark.sql import functions as F

from gaugework.operators import aggregate as A, dispatch, host, judge as J, replay
from gaugework.plans.core import line_scores
from gaugework.plans.scorers import load
from gaugework.sinks import store
from gaugework.sinks.shared import shared_folder
from gaugework.sources import pages

ITEMS, LIMIT = 50, 20


def _shape(batch):
    text = batch.column(0)
    return {"chars": pc.utf8_length(text), "lines": pc.add(pc.count_substring(text, "\n"), 1)}


def _share(text: str | None) -> float | None:
    return text.count(" ") / len(text) if text else None


def registry() -> host.Registry:
    r = host.Registry()
    r.add(host.Evaluator("shape", "2", ("text",), ("chars", "lines"), _shape, low=0))
    r.add(host.Evaluator("spaces", "1", ("text",), ("spaces",), host.by_row(_share, "spaces"), low=0, high=1))
    return r


def host_evaluators(spark, sf):
    """A batch evaluator of two outputs and a scalar one, over every document; texts that are missing have no value."""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("example_id"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("text"))
    s = host.checked(host.evaluated(d, registry(), ["shape@2", "spaces"]))
    return s.withColumn("value", F.round("value", 9))


def host_summary(spark, sf):
    """The same scores, aggregated like any other."""
    s = host_evaluators(spark, sf)
    a = A.aggregated(s.select("metric", "value", "status", "validity"))
    return a.select("metric", "included", "n_non_evaluable", "min", "max", F.round("mean", 6).alias("mean"))


def recorded_pages(spark, sf):
    """Six recordings of the events, of which three break off, read by pages: what each read reports."""
    k = F.col("event_id")
    e = load(spark, sf, "events").select((k % 6).alias("r"), F.floor(k / 6 / ITEMS).alias("p"), k.alias("item"))
    last = e.groupBy("r").agg(F.max("p").alias("last"))
    page = e.groupBy("r", "p").agg(F.array_sort(F.collect_list("item")).alias("items")).join(F.broadcast(last), "r")  # a page is ITEMS rows
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    broken = F.col("p") == 2
    after = F.when(broken & (F.col("r") == 1), "c1").when(broken & (F.col("r") == 3), "gone").when(F.col("p") < F.col("last"), name(F.col("p") + 1))
    body = F.when(broken & (F.col("r") == 2), F.lit('"none"')).otherwise(F.to_json("items"))
    line = F.concat(F.lit('{"cursor": '), F.coalesce(F.when(F.col("p") > 0, F.concat(F.lit('"'), name(F.col("p")), F.lit('"'))), F.lit("null")), F.lit(', "items": '), body, F.lit(', "next": '), F.coalesce(F.concat(F.lit('"'), after, F.lit('"')), F.lit("null")), F.lit("}"))
    folder = shared_folder(spark, "pages")
    pages.write_recordings(page.select(F.concat(F.lit("r"), F.col("r").cast("string")).alias("recording"), line.alias("value")), folder)
    return pages.manifest(pages.recorded(spark, folder, LIMIT)).withColumn("recording", F.replace("recording", F.lit("recording="), F.lit("")))


def stored_scores(spark, sf):
    """Scores of all lines, committed, verified and read again: their summary."""
    folder = shared_folder(spark, "scores")
    store.put(line_scores(spark, sf), folder)
    a = A.aggregated(store.get(spark, folder))
    return a.select("metric", "included", "total", "n_blocked", F.round("mean", 9).alias("mean"))


def _judge(row: dict) -> dict:
    k = row["event_id"]
    if k % 10 == 3:
        return {"status": "timeout", "code": "judge_timeout", "tokens": 5}
    return {"status": "ok", "value": k % 10 / 10, "tokens": 5 + k % 7}


def judge_waves(spark, sf):
    """Calls for the events of each user and type, equal ones once, under a budget of tokens that ends the run's calls."""
    e = load(spark, sf, "events")
    key = J.request_key(F.col("user_id"), F.col("event_type"))
    effects = e.select(F.col("event_id").cast("string").alias("example_id"), F.col("event_type").alias("metric"), key.alias("key"), F.col("event_id").alias("ordinal"), (F.col("event_id") % 9 != 0).alias("permitted"), "event_id")
    folder = shared_folder(spark, "judge-cache")
    got = dispatch.dispatched(effects, _judge, dispatch.Budget(tokens=1500, most_tokens=12), folder)
    return got.select("event_id", "status", F.round("value", 9).alias("value"), "code", "attempts", "cache_state")


_TASK = """
import json, sys
for line in sys.stdin:
    r = json.loads(line)
    text = (r["input"] or {}).get("text") or ""
    print(json.dumps({"output": {"letters": len(text)}} if len(text) % 5 else {"answer": 1}), flush=True)
"""


def replay_outputs(spark, sf):
    """The outputs that a host's process gives for the turns of the users, and the turns it gives none for."""
    c = load(spark, sf, "conversations").filter("role = 'user'")
    effects = c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("example_id"), (F.col("conv_id") % 7 != 0).alias("permitted"), F.to_json(F.struct("text")).alias("input"))
    got = replay.replayed(effects, [sys.executable, "-c", _TASK])
    return got.select("example_id", "output", "code")


QUERIES = {f.__name__: f for f in (host_evaluators, host_summary, recorded_pages, stored_scores, judge_waves, replay_outputs)}

_HOST = """(SELECT example_id, metric, CASE WHEN absent THEN NULL ELSE round(value, 9) END AS value, CASE WHEN absent THEN 'non_evaluable' ELSE 'scored' END AS status, CASE WHEN absent THEN 'not_measured' ELSE 'valid' END AS validity, CASE WHEN absent THEN e || '.not_evaluable' END AS code, ref AS evaluator FROM (
  SELECT example_id, 'chars' AS metric, length(text)::DOUBLE AS value, text IS NULL AS absent, 'shape' AS e, 'shape@2' AS ref FROM d
  UNION ALL SELECT example_id, 'lines', length(text) - length(replace(text, chr(10), '')) + 1, text IS NULL, 'shape', 'shape@2' FROM d
  UNION ALL SELECT example_id, 'spaces', (length(text) - length(replace(text, ' ', ''))) / length(text)::DOUBLE, coalesce(text, '') = '', 'spaces', 'spaces@1' FROM d))"""
_D = "WITH d AS (SELECT doc_id::VARCHAR AS example_id, CASE WHEN doc_id % 9 <> 0 THEN text END AS text FROM documents) "
ORACLE = {
    "host_evaluators": _D + f"SELECT * FROM {_HOST}",
    "host_summary": _D + f"SELECT metric, count(value) AS included, count(*) - count(value) AS n_non_evaluable, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean FROM {_HOST} GROUP BY metric",
    "recorded_pages": f"""WITH e AS (SELECT event_id % 6 AS r, event_id // 6 // {ITEMS} AS p FROM events), n AS (SELECT r, max(p) + 1 AS n FROM e GROUP BY r),
      s AS (SELECT r, CASE WHEN n > 2 AND r IN (1, 3) THEN 3 WHEN n > 2 AND r = 2 THEN 2 ELSE least(n, {LIMIT}) END AS pages,
        CASE WHEN n > 2 AND r = 1 THEN 'cursor_repeated' WHEN n > 2 AND r = 2 THEN 'page_malformed' WHEN n > 2 AND r = 3 THEN 'fetch_failed' WHEN n > {LIMIT} THEN 'page_limit' ELSE '' END AS codes FROM n)
      SELECT 'r' || r AS recording, pages, (SELECT count(*) FROM e WHERE e.r = s.r AND p < pages) AS items, (codes <> '')::INT::BIGINT AS rejected, codes, CASE WHEN codes = '' THEN 'complete_within_declared_scope' ELSE 'partial' END AS completeness FROM s""",
    "stored_scores": "SELECT metric, count(*) FILTER (WHERE status = 'scored' AND validity = 'valid') AS included, count(*) AS total, count(*) FILTER (WHERE status = 'blocked') AS n_blocked, round(avg(value) FILTER (WHERE status = 'scored' AND validity = 'valid'), 9) AS mean FROM (SELECT l_returnflag AS metric, CASE WHEN n % 7 <> 0 THEN l_discount * 10 END AS value, CASE WHEN n % 7 = 0 THEN 'blocked' ELSE 'scored' END AS status, CASE WHEN n % 7 = 0 THEN 'not_measured' WHEN n % 11 = 0 THEN 'invalid' ELSE 'valid' END AS validity FROM (SELECT *, l_orderkey + l_linenumber AS n FROM lineitem)) GROUP BY metric",
    "judge_waves": """WITH e AS (SELECT event_id, user_id, event_type, event_id % 9 <> 0 AS permitted FROM events), f AS (SELECT user_id, event_type, min(event_id) AS f FROM e WHERE permitted GROUP BY ALL),
      c AS (SELECT *, CASE WHEN f % 10 = 3 THEN 5 ELSE 5 + f % 7 END AS t, sum(CASE WHEN f % 10 = 3 THEN 5 ELSE 5 + f % 7 END) OVER (ORDER BY f) AS upto FROM f),
      last AS (SELECT min(f) AS l FROM c WHERE upto >= 1500),
      r AS (SELECT event_id, f, NOT permitted AS denied, coalesce(event_id > l, false) AS gone FROM e LEFT JOIN c USING (user_id, event_type), last)
      SELECT event_id, CASE WHEN denied OR gone THEN 'missing' WHEN f % 10 = 3 THEN 'timeout' ELSE 'ok' END AS status, CASE WHEN NOT denied AND NOT gone AND f % 10 <> 3 THEN round(f % 10 / 10.0::DOUBLE, 9) END AS value,
        CASE WHEN denied THEN 'judge_egress_forbidden' WHEN gone THEN 'judge_budget_exhausted' WHEN f % 10 = 3 THEN 'judge_timeout' END AS code, CASE WHEN denied OR gone OR event_id <> f THEN 0 WHEN f % 10 = 3 THEN 3 ELSE 1 END AS attempts,
        CASE WHEN denied OR gone THEN NULL WHEN event_id = f THEN 'miss' ELSE 'hit' END AS cache_state FROM r""",
    "replay_outputs": """SELECT conv_id || '/' || turn AS example_id, CASE WHEN conv_id % 7 <> 0 AND n % 5 <> 0 THEN '{"letters": ' || n || '}' END AS output, CASE WHEN conv_id % 7 = 0 THEN 'task_egress_forbidden' WHEN n % 5 = 0 THEN 'task_missing_output' END AS code
      FROM (SELECT *, coalesce(length(text), 0) AS n FROM conversations WHERE role = 'user')""",
}
