"""The flagship verdict and the decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions import stats
from gaugework.operators import aggregate as A, decide as D, scorers as S
from gaugework.functions.words import SPACE
from gaugework.operators import references, views
from gaugework.plans.scorers import load


def _gates(spark, sf):
    """One gate for each language: the share of texts of 20 to 800 words, by the Wilson lower bound against 0.85."""
    d = load(spark, sf, "documents").filter("lang IS NOT NULL")
    s = d.select(F.col("lang").alias("metric"), S.word_count_bounds(F.col("text"), 20, 800).alias("s")).select("metric", "s.*")
    a = A.aggregated(s)
    lo, hi = stats.wilson(F.col("successes"), F.col("included"))
    missing = (F.col("total") - F.col("included")) / F.col("total")
    g = a.withColumn("lower", lo).withColumn("upper", hi)
    gate = D.apply_policy(F.col("mean"), F.col("included"), missing, F.col("lower"), F.col("upper"), F.lit(0.85), F.lit(True))
    return g.withColumn("g", gate).select("metric", F.col("included").alias("n"), F.round("mean", 9).alias("point"), F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"), "g.verdict", "g.reason")


def flagship_verdict(spark, sf):
    return _gates(spark, sf)


def decide_verdict(spark, sf):
    """The run's verdict with the reasons of its gates, languages in their order."""
    out = D.decide(_gates(spark, sf))
    return out.withColumn("reasons", F.array_join(F.transform("reasons", lambda x: F.concat(x["metric"], F.lit(": "), F.array_join(x["reasons"], ", "))), "; "))


def resolve_authority(spark, sf):
    """Every reason, alone and together."""
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (k % n + 1).cast("int"))
    grant = F.when(k % 23 == 1, "missing").when(k % 23 == 2, "mismatched").when(k % 23 == 3, "expired").when(k % 23 == 4, "matched")
    judge = F.when(k % 2 == 0, pick(29, *["calibrated"] * 25, "uncalibrated", "calibrating", "drifted", "retired"))
    state = F.when(k % 37 == 0, "not_comparable").when(k % 37 == 1, None).otherwise("comparable")
    a = D.authority(F.when(k % 3 == 0, "draft").otherwise("gating"), k % 5 != 0, F.when(k % 7 == 0, "proposed").when(k % 11 == 0, "retired").otherwise("validated"), F.when(k % 13 == 0, "forbidden").otherwise("permitted"), k % 17 == 0, grant, judge, k % 4 == 1, state)
    return o.select("o_orderkey", F.inline(F.array(a))).select("o_orderkey", "level", "can_gate", "blocked", F.array_join("reasons", ",").alias("reasons"))


def verify_grant(spark, sf):
    """Grants that expired, match, or bind what the run lacks."""
    o, k = load(spark, sf, "orders"), F.col("o_orderkey")
    declared = [F.when(k % (n + 2) == 0, F.lit(f"d{n}")) for n in range(len(D.BINDINGS))]
    current = [F.when(k % (n + 5) == 0, "other").when(k % (n + 7) != 0, F.lit(f"d{n}")) for n in range(len(D.BINDINGS))]
    expires = F.when(k % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    now = F.when(k % 2 == 0, F.lit("1998-01-01T00:00:00"))
    g = D.grant(expires, now, {name: pair for name, pair in zip(D.BINDINGS, zip(declared, current))})
    return o.select("o_orderkey", F.inline(F.array(g))).select("o_orderkey", "status", F.array_join("mismatched", ",").alias("mismatched"))


def scoped_authority(spark, sf):
    """Policy and dataset status of metrics that are bound to sources, and of one that stands over all."""
    n = load(spark, sf, "nation")
    k = F.col("n_nationkey")
    sources = n.select(F.col("n_name").alias("source"), F.when(k % 4 == 0, "trace").otherwise("dataset").alias("kind"), F.when(k % 9 == 0, "missing").when(k % 5 == 0, "redacted").otherwise("permitted").alias("data_policy"), F.when(k % 11 == 0, "retired").otherwise("validated").alias("dataset_status"))
    bound = n.select(F.concat(F.lit("m"), (k % 7).cast("string")).alias("metric"), F.col("n_name").alias("source")).unionByName(load(spark, sf, "region").limit(1).select(F.lit("all").alias("metric"), F.lit(None).cast("string").alias("source")))
    return D.scoped(bound, sources)


def gate_classification(spark, sf):
    """Gates with a policy, without one, blocked ones and those that may not gate."""
    o, k = load(spark, sf, "orders"), F.col("o_orderkey")
    point = F.when(k % 7 != 0, (k % 100) / 100.0)
    n, excluded, higher = k % 9, F.when(k % 11 == 0, 3).otherwise(0), k % 2 == 0
    policy = D.apply_policy(point, n, excluded / F.greatest(excluded + n, F.lit(1)), F.when(k % 13 != 0, point - 0.1), F.when(k % 13 != 0, point + 0.1), F.lit(0.5), higher)
    plain = D.apply_threshold(point, excluded, F.when(k % 17 != 0, F.lit(0.5)), higher)
    resolved = F.struct((k % 19 == 0).alias("blocked"), (k % 5 != 0).alias("can_gate"), F.when(k % 19 == 0, F.array(F.lit("policy_forbidden"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    g = o.select("o_orderkey", F.inline(F.array(D.gate(resolved, F.when(k % 3 == 0, policy).otherwise(plain)))))
    return g.withColumn("exit", D.exit_code(F.col("verdict"))).select("o_orderkey", "verdict", "reason", F.col("exit.class").alias("exit_class"), F.col("exit.code").alias("exit_code"))


def calibration_status(spark, sf):
    """What studies of raters support, by nation."""
    c = load(spark, sf, "customer").groupBy("c_nationkey").agg(*A.confusion(F.col("c_acctbal") > 4000, F.col("c_acctbal") > 4000 + F.col("c_nationkey") * 60))
    po, kappa = A.kappa()
    k = F.col("c_nationkey")
    claim = F.when(k % 5 == 0, None).when(k % 5 == 1, "drifted").otherwise("calibrated")
    return c.select("c_nationkey", D.calibration(claim, F.when(k % 4 == 3, 1).otherwise(2), po, kappa).alias("status"))


def metric_state(spark, sf):
    """What a board shows of each three events: a value only where one was measured."""
    e = load(spark, sf, "events").withColumn("metric", F.floor(F.col("event_id") / 3))
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "signup", "blocked").when(kind == "view", "non_evaluable").when(kind == "click", "skipped").otherwise("scored")
    a = A.aggregated(e.select("metric", "value", status.alias("status"), F.when(F.col("value") > 250, "invalid").otherwise("valid").alias("validity")))
    p = A.population(e.select("metric", status.alias("status"), F.when(F.col("value") > 250, "invalid").otherwise("valid").alias("validity"))).withColumnsRenamed({f"n_{s}": f"p_{s}" for s in A.STATUSES})
    s = views.metric_state(F.col("mean"), F.col("included"), *[F.col(f"p_{x}") for x in ("error", "blocked", "non_evaluable", "skipped")])
    return a.join(p, "metric").select("metric", F.inline(F.array(s))).withColumn("value", F.round("value", 8))


def annotation_authority(spark, sf):
    """Annotations with a record of their validation, without one, and with one of white space of several kinds."""
    c = load(spark, sf, "conversations")
    blank = F.concat(F.lit(" \u00a0\u2003\t"), F.when(F.col("turn") % 2 == 0, F.lit("\u3000")).otherwise(""))
    record = F.when(F.col("role") == "system", blank).when(F.col("turn") % 3 != 0, F.col("text"))
    return c.select("conv_id", "turn", references.authoritative(record).alias("authoritative"))


QUERIES = {f.__name__: f for f in (flagship_verdict, decide_verdict, resolve_authority, verify_grant, scoped_authority, gate_classification, calibration_status, metric_state, annotation_authority)}

_Z = "1.959963984540054::DOUBLE"
_G = f"""(SELECT metric, n, round(p, 9) AS point, round(greatest(0, m - h), 9) AS lower, round(least(1, m + h), 9) AS upper,
  CASE WHEN n < 2 THEN 'blocked' WHEN round(greatest(0, m - h), 12) >= 0.85 THEN 'pass' ELSE 'fail' END AS verdict,
  CASE WHEN n < 2 THEN 'insufficient_samples' WHEN round(greatest(0, m - h), 12) >= 0.85 THEN NULL ELSE 'lower_confidence_bound_below_threshold' END AS reason
  FROM (SELECT *, (p + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) AS m, {_Z} / (1 + {_Z} * {_Z} / n) * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4.0::DOUBLE * n * n)) AS h
    FROM (SELECT lang AS metric, count(*) AS n, avg((len(list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '')) BETWEEN 20 AND 800)::INT::DOUBLE) AS p FROM documents WHERE lang IS NOT NULL GROUP BY lang)))"""
ORACLE = {
    "flagship_verdict": f"SELECT * FROM {_G}",
    "decide_verdict": f"SELECT coalesce(string_agg(metric || ': ' || reason, '; ' ORDER BY metric) FILTER (WHERE verdict IN ('fail', 'blocked')), '') AS reasons, coalesce(bool_or(verdict IN ('blocked', 'fail')), false) AS ci_should_fail, '' AS informational_metrics, CASE WHEN bool_or(verdict = 'blocked') THEN 'blocked' WHEN bool_or(verdict = 'fail') THEN 'fail' WHEN bool_or(verdict = 'pass') THEN 'pass' ELSE 'informational' END AS verdict, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE verdict = 'pass'), '') AS pass_gates, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE verdict = 'fail'), '') AS fail_gates, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE verdict = 'blocked'), '') AS blocked_gates FROM {_G}",
    "resolve_authority": """SELECT o_orderkey, CASE WHEN w = '' THEN 'gating' ELSE 'informational' END AS level, w = '' AND s = '' AS can_gate, w = '' AND s <> '' AS blocked, CASE WHEN w = '' THEN s ELSE w END AS reasons FROM (SELECT o_orderkey,
      concat_ws(',', CASE WHEN k % 17 = 0 THEN 'judge_fake_non_authoritative' END, CASE k % 23 WHEN 1 THEN 'grant_missing' WHEN 2 THEN 'grant_mismatched' END, CASE WHEN k % 3 = 0 THEN 'metric_status=draft' END, CASE WHEN k % 5 = 0 THEN 'threshold_proposed' END, CASE WHEN k % 7 = 0 THEN 'dataset_proposed' END, CASE WHEN k % 2 = 0 AND k % 29 = 25 THEN 'judge_uncalibrated' WHEN k % 2 = 0 AND k % 29 = 26 THEN 'judge_calibrating' END) AS w,
      concat_ws(',', CASE WHEN k % 13 = 0 THEN 'policy_forbidden' END, CASE WHEN k % 2 = 0 AND k % 29 = 27 THEN 'judge_drifted' WHEN k % 2 = 0 AND k % 29 = 28 THEN 'judge_retired' END, CASE WHEN k % 7 <> 0 AND k % 11 = 0 THEN 'dataset_retired' END, CASE WHEN k % 23 = 3 THEN 'grant_expired' END, CASE WHEN k % 4 = 1 AND k % 37 = 0 THEN 'baseline_not_comparable' WHEN k % 4 = 1 AND k % 37 = 1 THEN 'baseline_missing' END) AS s FROM (SELECT o_orderkey, o_orderkey AS k FROM orders))""",
    "verify_grant": """SELECT o_orderkey, CASE WHEN late THEN 'expired' WHEN m <> '' THEN 'mismatched' ELSE 'matched' END AS status, CASE WHEN late THEN '' ELSE m END AS mismatched FROM (SELECT o_orderkey, k % 2 = 0 AND k % 3 <> 0 AND strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') < '1998-01-01T00:00:00' AS late,
      concat_ws(',', CASE WHEN k % 2 = 0 AND (k % 5 = 0 OR k % 7 = 0) THEN 'decision_policy_sha256' END, CASE WHEN k % 3 = 0 AND (k % 6 = 0 OR k % 8 = 0) THEN 'dataset_validation_sha256' END, CASE WHEN k % 4 = 0 AND (k % 7 = 0 OR k % 9 = 0) THEN 'evaluator_capability_sha256' END, CASE WHEN k % 5 = 0 AND (k % 8 = 0 OR k % 10 = 0) THEN 'study_evidence_sha256' END) AS m FROM (SELECT *, o_orderkey AS k FROM orders))""",
    "scoped_authority": """WITH s AS (SELECT n_nationkey % 7 AS g, CASE WHEN n_nationkey % 9 = 0 THEN 4 WHEN n_nationkey % 5 = 0 THEN 2 ELSE 1 END AS p, CASE WHEN n_nationkey % 4 = 0 THEN 2 WHEN n_nationkey % 11 = 0 THEN 3 ELSE 1 END AS d FROM nation)
      SELECT metric, CASE p WHEN 4 THEN 'missing' WHEN 2 THEN 'redacted' ELSE 'permitted' END AS policy, CASE d WHEN 3 THEN 'retired' WHEN 2 THEN 'proposed' ELSE 'validated' END AS dataset_status FROM (SELECT 'm' || g AS metric, max(p) AS p, max(d) AS d FROM s GROUP BY g UNION ALL SELECT 'all', max(p), max(d) FROM s)""",
    "gate_classification": """SELECT o_orderkey, verdict, CASE WHEN verdict = 'informational' OR verdict = 'pass' THEN NULL ELSE reason END AS reason, CASE verdict WHEN 'fail' THEN 'nonzero_fail' WHEN 'blocked' THEN 'nonzero_blocked' ELSE 'zero' END AS exit_class, CASE WHEN verdict IN ('fail', 'blocked') THEN 1 ELSE 0 END AS exit_code FROM (
      SELECT o_orderkey, reason, CASE WHEN reason = 'policy_forbidden' THEN 'blocked' WHEN NOT can THEN 'informational' WHEN reason IS NULL THEN 'pass' WHEN reason LIKE '%threshold' AND reason <> 'no_approved_threshold' THEN 'fail' ELSE 'blocked' END AS verdict FROM (
      SELECT o_orderkey, k % 5 <> 0 AS can, CASE WHEN k % 19 = 0 THEN 'policy_forbidden' WHEN k % 7 = 0 THEN 'no_measured_value'
        WHEN k % 3 = 0 THEN CASE WHEN k % 9 < 2 THEN 'insufficient_samples' WHEN k % 11 = 0 THEN 'excessive_missing_evidence' WHEN k % 13 = 0 THEN 'decision_statistic_unavailable'
          WHEN k % 2 = 0 AND (k % 100) / 100.0::DOUBLE - 0.1::DOUBLE < 0.5 THEN 'lower_confidence_bound_below_threshold' WHEN k % 2 = 1 AND (k % 100) / 100.0::DOUBLE + 0.1::DOUBLE > 0.5 THEN 'upper_confidence_bound_above_threshold' END
        WHEN k % 11 = 0 THEN 'incomplete_measurement' WHEN k % 17 = 0 THEN 'no_approved_threshold' WHEN k % 2 = 0 AND k % 100 < 50 THEN 'below_threshold' WHEN k % 2 = 1 AND k % 100 > 50 THEN 'above_threshold' END AS reason FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)))""",
    "calibration_status": """SELECT c_nationkey, CASE c_nationkey % 5 WHEN 0 THEN 'uncalibrated' WHEN 1 THEN 'drifted' ELSE CASE WHEN c_nationkey % 4 <> 3 AND po >= 0.8 AND CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END >= 0.6 THEN 'calibrated' ELSE 'calibrating' END END AS status FROM (
      SELECT c_nationkey, (tp + tn) / n AS po, ((tp + fp) * (tp + f) + (f + tn) * (fp + tn))::DOUBLE / (n * n) AS pe FROM (SELECT c_nationkey, count(*)::DOUBLE AS n, count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE a AND NOT b) AS fp, count(*) FILTER (WHERE NOT a AND b) AS f, count(*) FILTER (WHERE NOT a AND NOT b) AS tn FROM (SELECT c_nationkey, c_acctbal > 4000 AS a, c_acctbal > 4000 + c_nationkey * 60 AS b FROM customer) GROUP BY c_nationkey))""",
    "metric_state": """SELECT metric, CASE WHEN v IS NOT NULL THEN 'scored' WHEN err > 0 THEN 'error' WHEN blk > 0 THEN 'blocked' WHEN non > 0 THEN 'non_evaluable' WHEN skip > 0 THEN 'skipped' ELSE 'non_evaluable' END AS status,
      CASE WHEN v IS NOT NULL THEN 'valid' WHEN err > 0 THEN 'invalid' WHEN blk > 0 OR non > 0 THEN 'not_measured' WHEN skip > 0 THEN 'not_applicable' ELSE 'not_measured' END AS validity, round(v, 8) AS value FROM (
      SELECT event_id // 3 AS metric, avg(value) FILTER (WHERE event_type = 'purchase' AND value <= 250) AS v, count(*) FILTER (WHERE event_type = 'error' OR (event_type = 'purchase' AND value > 250)) AS err, count(*) FILTER (WHERE event_type = 'signup') AS blk, count(*) FILTER (WHERE event_type = 'view') AS non, count(*) FILTER (WHERE event_type = 'click') AS skip FROM events GROUP BY 1)""",
    "annotation_authority": "SELECT conv_id, turn, role <> 'system' AND turn % 3 <> 0 AND length(trim(text)) > 0 AS authoritative FROM conversations",
}
