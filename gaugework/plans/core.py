"""Aggregation, interval, comparison, join and plan queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugework.functions import stats
from gaugework.functions.words import SPACE
from gaugework.operators import aggregate as A
from gaugework.operators import compare, joins, judge, plan, references, verify, views
from gaugework.operators.scoring import Metric
from gaugework.plans.scorers import load, score_word_count

_RND = 9


def line_scores(spark, sf) -> DataFrame:
    """lineitem as a score table: the metric is the return flag; one line in seven is blocked and one in eleven invalid."""
    li = load(spark, sf, "lineitem")
    n = F.col("l_orderkey") + F.col("l_linenumber")
    blocked = n % 7 == 0
    return li.select(F.col("l_returnflag").alias("metric"), F.when(~blocked, F.col("l_discount") * 10).alias("value"), F.when(blocked, "blocked").otherwise("scored").alias("status"), F.when(blocked, "not_measured").when(n % 11 == 0, "invalid").otherwise("valid").alias("validity"), n.alias("ordinal"))


_LS = "(SELECT l_returnflag AS metric, CASE WHEN n % 7 <> 0 THEN l_discount * 10 END AS value, CASE WHEN n % 7 = 0 THEN 'blocked' ELSE 'scored' END AS status, CASE WHEN n % 7 = 0 THEN 'not_measured' WHEN n % 11 = 0 THEN 'invalid' ELSE 'valid' END AS validity FROM (SELECT *, l_orderkey + l_linenumber AS n FROM lineitem))"
_OK = "FILTER (WHERE status = 'scored' AND validity = 'valid')"


def agg_family(spark, sf):
    a = A.aggregated(line_scores(spark, sf), median=True)
    return a.select("metric", *[F.round(c, _RND).alias(c) for c in ("mean", "median", "min", "max", "sd")], "included", "total", "n_scored", "n_blocked", (F.col("total") - F.col("included")).alias("excluded"))


def wilson_interval(spark, sf):
    a = A.aggregated(line_scores(spark, sf))
    lo, hi = stats.wilson(F.col("successes"), F.col("included"))
    return a.select("metric", "successes", "included", F.round(lo, 10).alias("lower"), F.round(hi, 10).alias("upper"))


def mean_interval(spark, sf):
    """Student-t over every customer, by market segment."""
    c = load(spark, sf, "customer").select(F.col("c_mktsegment").alias("metric"), F.col("c_acctbal").alias("value"), F.lit("scored").alias("status"), F.lit("valid").alias("validity"))
    m = A.mean_interval(A.aggregated(c))
    return m.select("metric", "included", F.round("lower", 1).alias("lower"), F.round("upper", 1).alias("upper"))


def estimate_methods(spark, sf):
    """Every kind of interval and note: shares of the lines, means clamped to a range, order statistics, empty metrics."""
    li = load(spark, sf, "lineitem")
    rows = li.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), F.when(v.isNull(), "blocked").otherwise("scored").alias("status")) for m, v in (("share", (F.col("l_quantity") > 25).cast("double")), ("always", F.lit(1.0)), ("clamped", F.when(F.col("l_linenumber") == 1, F.col("l_discount") * 10)), ("middle", F.col("l_quantity")), ("nothing", F.lit(None).cast("double")))])).alias("x")).select("x.*", F.lit("valid").alias("validity"))
    specs = spark.createDataFrame([("share", "rate", "binary", None, None), ("always", "mean", "binary", None, None), ("clamped", "mean", "continuous", 0.0, 0.501), ("middle", "median", "continuous", None, None), ("nothing", "mean", "continuous", None, None)], "metric string, aggregation string, score_type string, low double, high double")
    e = A.estimates(A.aggregated(rows, median=True), specs)
    return e.select("metric", F.round("point", 8).alias("point"), "n", "method", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "code", F.round("bound", 10).alias("bound"))


def rule_of_three(spark, sf):
    a = load(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return a.select("s_nationkey", "n", stats.rule_of_three(F.col("n")).alias("bound"))


def population_terminal(spark, sf):
    return A.population(line_scores(spark, sf))


def population_plan(spark, sf):
    """What a metric over two languages that needs a label finds before any effect, and one over all documents."""
    from gaugework.plans.scorers import examples

    return plan.ledger(examples(spark, sf), [Metric("labelled", lambda: F.lit(None), {"lang": ["en", "fr"]}, needs_reference=True), Metric("all", lambda: F.lit(None))])


def diagnostic_clusters(spark, sf):
    e = load(spark, sf, "events")
    d = e.select(F.col("event_type").alias("metric"), F.col("event_id").alias("score_id"), F.explode(F.array(F.when(F.col("value") > 100, F.struct(F.lit("high").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"))), F.when(F.col("value") > 300, F.struct(F.lit("high").alias("code"), F.lit("error").alias("severity"), F.lit("very high").alias("message"))))).alias("d")).filter("d IS NOT NULL").select("metric", "score_id", "d.*")
    return A.clusters(d)


def cohen_kappa(spark, sf):
    c = load(spark, sf, "labels").agg(*A.confusion(F.col("quality") == 1, F.col("toxic") == 0))
    po, k = A.kappa()
    return c.select("tp", "fp", "fn", "tn", F.round(po, _RND).alias("agreement"), F.round(k, _RND).alias("kappa"))


def _runs(spark, sf):
    """Even events as the current run, odd ones as the baseline. Views are a metric for each user, so that some have one
    pair or none; some rows of the current run are blocked, and repeated under the same id; scores of three metrics are
    shifted."""
    e = load(spark, sf, "events")
    metric = F.when(F.col("event_type") == "view", F.concat(F.lit("view/"), F.col("user_id").cast("string"))).otherwise(F.col("event_type"))
    shift = F.when(F.col("event_type").isin("click", "error"), 40.0).when(F.col("event_type") == "signup", -40.0).otherwise(0.0)
    even = e.filter("event_id % 2 = 0").select(metric.alias("metric"), F.col("event_id").alias("example_id"), (F.col("value") + shift).alias("value"), F.lit("scored").alias("status"), F.lit("valid").alias("validity"), F.col("event_id").alias("ordinal"))
    again = even.filter("example_id % 6 = 0").withColumns({"value": F.lit(None).cast("double"), "status": F.lit("blocked"), "ordinal": F.col("ordinal") + 1_000_000_000})
    odd = e.filter("event_id % 2 = 1").select((F.col("event_id") - 1).alias("example_id"), "value", F.col("event_id").alias("ordinal"))
    base = odd.join(even.select("metric", "example_id"), "example_id").withColumns({"status": F.lit("scored"), "validity": F.lit("valid")})
    return even.unionByName(again), base


def paired_delta(spark, sf):
    """Every outcome: improvements, regressions (one where less is better), noise, single pairs, a metric without direction."""
    now, then = _runs(spark, sf)
    named = now.select("metric").distinct().filter("metric <> 'purchase'").select("metric", (F.col("metric") == "error").alias("lower_is_better"))
    out = compare.compared(now, then, named)
    return out.select("metric", "skipped", "n_paired", F.round("delta", 6).alias("delta"), F.round("adjusted", 6).alias("adjusted"), "outcome")


def drift_report(spark, sf):
    """What a watcher says for each state of the baseline."""
    now, then = _runs(spark, sf)
    named = now.select("metric").distinct().filter("metric NOT LIKE 'view/%'").select("metric", (F.col("metric") == "error").alias("lower_is_better"))
    got = compare.regressions(compare.compared(now, then, named))
    cases = spark.createDataFrame([("off", False, False, False), ("none", True, False, False), ("other", True, True, True), ("same", True, True, False)], "case string, requested boolean, has boolean, changed boolean")
    state = cases.crossJoin(F.broadcast(got)).withColumn("state", compare.baseline_state(F.col("requested"), F.col("has"), F.col("changed")))
    d = state.withColumn("d", compare.drift(F.col("state"), F.col("regressed")))
    return d.select("case", "state", "shared", "d.code", "d.severity", F.array_join("d.metrics", ",").alias("metrics"))


def changed_dimensions(spark, sf):
    cur = load(spark, sf, "documents").groupBy(F.col("lang").alias("dimension")).agg(F.sum("n_chars").cast("string").alias("digest"))
    base = load(spark, sf, "documents").filter("source <> 'src3' AND lang <> 'de'").groupBy(F.col("lang").alias("dimension")).agg(F.sum("n_chars").cast("string").alias("digest"))
    return compare.changed_dimensions(cur, base)


def plan_reconcile(spark, sf):
    """Planned are all documents; executed the labelled ones, some under ids that no plan has."""
    ran = load(spark, sf, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 1_000_000_000).otherwise(0)).alias("doc_id"))
    return plan.reconcile(load(spark, sf, "documents").select("doc_id"), ran, "doc_id")


def selector_no_match(spark, sf):
    metrics = spark.createDataFrame([("answer", "en"), ("ghost", "xx"), ("other", "de")], "metric string, want string")
    return metrics.join(load(spark, sf, "documents").select(F.col("lang").alias("want")).distinct(), "want", "left_anti").select("metric", F.lit("non_evaluable").alias("status"), F.lit("selector.no_match").alias("code"))


def _customers(spark, sf):
    """Customers of which some are missing and some come twice."""
    c = load(spark, sf, "customer").filter("c_custkey % 7 <> 0").select("c_custkey", "c_name")
    return c.unionByName(c.filter("c_custkey % 11 = 0"))


def _assembled(spark, sf, cardinality):
    return joins.assemble(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), _customers(spark, sf), "o_custkey", "c_custkey", cardinality)


def assemble_one_to_one(spark, sf):
    return _assembled(spark, sf, joins.ONE)[0].select("o_orderkey", F.col("r.c_name").alias("c_name"))


def assemble_one_to_many(spark, sf):
    return _assembled(spark, sf, joins.MANY)[0].select("o_orderkey", F.col("r.c_name").alias("c_name"))


def assemble_optional_one(spark, sf):
    return _assembled(spark, sf, joins.OPTIONAL)[0].select("o_orderkey", F.col("r.c_name").alias("c_name"))


def assemble_dropped(spark, sf):
    """Every dropped row of the three cardinalities, with what was found for it."""
    every = [_assembled(spark, sf, c)[1].select(F.lit(c).alias("cardinality"), "o_orderkey", "n", "diagnostic") for c in (joins.ONE, joins.MANY, joins.OPTIONAL)]
    return every[0].unionByName(every[1]).unionByName(every[2])


def evaluability(spark, sf):
    return views.evaluability(A.aggregated(line_scores(spark, sf)))


def worst_policy(spark, sf):
    rank = F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    name = lambda r: F.when(r == 4, "forbidden").when(r == 2, "unknown").when(r == 1, "redacted").otherwise("permitted")
    a = load(spark, sf, "events").groupBy("user_id").agg(F.max(rank).alias("r"), F.every(rank <= 1).alias("egress_ok"))
    return a.select("user_id", name(F.col("r")).alias("policy"), "egress_ok")


def calls_top_200(spark, sf):
    """The first calls of each metric themselves, and how many were left out; ids of some are NULL."""
    e = load(spark, sf, "events").select(F.col("event_type").alias("metric"), F.when(F.col("event_id") % 10 != 0, F.col("event_id")).alias("example_id"), F.col("event_id").alias("ordinal"))
    shown, omitted = views.first_calls(e, "ordinal")
    return shown.join(omitted, "metric").select("metric", "example_id", "rank", "omitted")


def previous_verified_run(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("series_id"), F.col("o_orderkey").alias("run_key"), F.col("o_orderkey").alias("ordinal"), (F.col("o_orderstatus") == "F").alias("verified"))
    return views.series_points(o).select("series_id", "run_key", "previous")


def judge_budget_cutoff(spark, sf):
    """Effects stop before the next one once the user's running cost has reached the limit."""
    e = load(spark, sf, "events").select("event_id", "user_id", "value")
    return judge.within_budget(e, "event_id", {"cost": (F.ceil("value"), 2000)}, ("user_id",)).select("event_id", "dispatched")


def source_manifest(spark, sf):
    d = load(spark, sf, "documents")
    a = d.groupBy("source").agg(F.count("*").alias("seen"), F.count_if(F.length("text") >= 100).alias("imported"), F.bool_or(F.col("lang") == "en").alias("has_en"))
    return a.withColumn("completeness", F.when(F.col("seen") == 0, "empty").when(F.col("imported") == 0, "blocked").when(F.col("imported") < F.col("seen"), "partial").otherwise("complete_within_declared_scope"))


def synthetic_expand(spark, sf):
    """Proposals from every benchmark item, three rounds and a bit."""
    seeds = load(spark, sf, "benchmark").select("item_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return references.expanded(seeds, 3 * seeds.count() + 7, "item_id").select("i", "item_id", "digest", "status")


def _stored(spark, sf):
    """Summaries of the lines as a record would hold them, tampered with: a value of A, a count of N; those of R hold within the tolerance."""
    a = A.aggregated(line_scores(spark, sf))
    value = F.when(F.col("metric") == "A", F.col("mean") * (1 + 1e-6)).otherwise(F.col("mean") * (1 + 1e-12))
    return a.select("metric", F.lit("mean").alias("aggregation"), value.alias("value"), (F.col("included") + (F.col("metric") == "N").cast("int")).alias("included"), *verify.COUNTS)


def verify_aggregates(spark, sf):
    out = verify.aggregates(_stored(spark, sf), line_scores(spark, sf))
    return out.select("metric", F.round("stored", 8).alias("stored"), F.round("recomputed", 8).alias("recomputed"), "stored_included", "included")


def verify_estimates(spark, sf):
    s = _stored(spark, sf)
    point = F.when(F.col("metric") == "R", F.col("value") + 1).otherwise(F.col("value"))
    return verify.estimates(s.select("metric", point.alias("point"), F.col("included").alias("n")), s.select("metric", "value"), line_scores(spark, sf))


def verify_populations(spark, sf):
    p = A.population(line_scores(spark, sf))
    return verify.populations(p.select("metric", *[(F.col(c) + F.when((F.col("metric") == "A") & F.lit(c in ("n_error", "n_scored")), 1).otherwise(0)).alias(c) for c in verify.COUNTS]), line_scores(spark, sf))


def _event_diagnostics(spark, sf):
    e = load(spark, sf, "events")
    return e.select(F.col("event_type").alias("metric"), F.col("event_id").alias("score_id"), F.explode(F.array(F.when(F.col("value") > 100, F.struct(F.lit("high").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"))), F.when(F.col("value") > 300, F.struct(F.lit("high").alias("code"), F.lit("error").alias("severity"), F.lit("very high").alias("message"))))).alias("d")).filter("d IS NOT NULL").select("metric", "score_id", "d.*")


def verify_clusters(spark, sf):
    """Stored clusters of which one has a count too many."""
    c = A.clusters(_event_diagnostics(spark, sf)).withColumn("n", F.col("n") + (F.col("metric") == "click").cast("int"))
    return verify.clusters(c, _event_diagnostics(spark, sf)).select("metric", "code", "n", "side")


def verify_evidence_refs(spark, sf):
    """Scores of events refer to judge records by user; some users have none, and of two records the last one counts."""
    e = load(spark, sf, "events")
    ref = F.concat(F.lit("judge:"), F.col("user_id").cast("string"))
    scores = e.select(F.col("event_id").alias("score_id"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("value"), F.array(ref, F.lit("dataset:x")).alias("refs"))
    users = e.select("user_id").distinct().filter("user_id % 5 <> 0")
    ok = users.select(F.concat(F.lit("judge:"), F.col("user_id").cast("string")).alias("evidence_id"), F.lit("ok").alias("status"), F.lit(1).alias("ordinal"))
    late = users.filter("user_id % 3 = 0").select(F.concat(F.lit("judge:"), F.col("user_id").cast("string")).alias("evidence_id"), F.lit("timeout").alias("status"), F.lit(2).alias("ordinal"))
    return verify.evidence(scores, ok.unionByName(late))


def verify_verdicts(spark, sf):
    """Records whose verdict is not the one of their gate lists."""
    o = load(spark, sf, "orders")
    some = lambda k: F.when(F.col("o_orderkey") % k == 0, F.array(F.lit("m"))).otherwise(F.array().cast("array<string>"))
    verdict = F.when(F.col("o_orderkey") % 5 == 0, "blocked").when(F.col("o_orderkey") % 3 == 0, "fail").when(F.col("o_orderkey") % 2 == 0, "pass").otherwise("informational")
    r = o.select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 13 == 0, "pass").otherwise(verdict).alias("verdict"), verdict.isin("blocked", "fail").alias("ci_should_fail"), some(2).alias("passing"), some(3).alias("failing"), some(5).alias("blocked"))
    return verify.verdicts(r)


def verify_studies(spark, sf):
    """Rater studies by nation with the stored agreement of some moved."""
    c = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("metric")).agg(*A.confusion(F.col("c_acctbal") > 4000, F.col("c_mktsegment") < "G"))
    po, k = A.kappa()
    return verify.studies(c.withColumns({"agreement": po + F.when(F.col("metric") % 6 == 0, 0.001).otherwise(0.00001), "kappa": k}))


def explorer_by_call(spark, sf):
    """Calls with their scores, unmeasured ones without a value."""
    s = score_word_count(spark, sf).select(F.col("doc_id").alias("example_id"), F.lit("words").alias("metric"), F.lit(0).alias("ordinal"), "value", "status", "validity")
    t = load(spark, sf, "labels").select(F.col("doc_id").alias("example_id"), F.lit("quality").alias("metric"), F.lit(1).alias("ordinal"), F.col("quality").cast("double").alias("value"), F.when(F.col("toxic") == 1, "blocked").otherwise("scored").alias("status"), F.lit("valid").alias("validity"))
    calls, _ = views.explorer(s.unionByName(t).withColumn("unit_id", F.lit(None).cast("string")))
    row = F.transform("row", lambda x: F.concat(x["metric"], F.lit("="), F.coalesce(x["value"].cast("int").cast("string"), x["status"])))
    return calls.select(F.col("example_id").alias("doc_id"), F.array_join(row, ";").alias("row"))


def dashboard_metrics(spark, sf):
    """One row for each configured metric, in the order of the board."""
    a = A.aggregated(line_scores(spark, sf))
    lo, hi = stats.wilson(F.col("successes"), F.col("included"))
    config = spark.createDataFrame([("R", "returns", 2, None, False, "reference", None, 0.9), ("A", None, 1, "gold", False, "reference", 0.49, None), ("N", "open", None, None, True, "non_reference", 0.1, None), ("Z", "none", None, None, False, "non_reference", None, None)], "metric string, workflow string, place int, tier string, needs_judge boolean, lens string, below double, above double")
    est = a.select("metric", F.when(F.col("metric") != "N", F.col("mean")).alias("point"), F.col("included").alias("n"), lo.alias("lower"), hi.alias("upper"))
    d = spark.createDataFrame([("A", "improvement")], "metric string, outcome string")
    out = views.dashboard(config, est, A.population(line_scores(spark, sf)), d)
    return out.select("metric", "workflow", "tier", "status", "validity", F.round("value", 9).alias("value"), F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"), "outcome", "flagged")


QUERIES = {f.__name__: f for f in (agg_family, wilson_interval, mean_interval, estimate_methods, rule_of_three, population_terminal, population_plan, diagnostic_clusters, cohen_kappa, paired_delta, drift_report, changed_dimensions, plan_reconcile, selector_no_match, assemble_one_to_one, assemble_one_to_many, assemble_optional_one, assemble_dropped, evaluability, worst_policy, calls_top_200, previous_verified_run, judge_budget_cutoff, source_manifest, synthetic_expand, verify_aggregates, verify_estimates, verify_populations, verify_clusters, verify_evidence_refs, verify_verdicts, verify_studies, explorer_by_call, dashboard_metrics)}

_Z = "1.959963984540054::DOUBLE"
#: Expansion of the Student-t quantile in 1/f, independent of the bisection; below 1e-6 off from f = 20 on.
_T = "z + (z**3 + z) / (4 * f) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * f**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * f**3) + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / (92160 * f**4)"
_CUST = "(SELECT c_custkey, c_name FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 = 0)"
_JOINED = f"(SELECT o_orderkey, n, CASE WHEN n = 1 THEN c_name END AS c_name FROM (SELECT o_orderkey, o_custkey, coalesce(n, 0) AS n, c_name FROM orders LEFT JOIN (SELECT c_custkey, count(*) AS n, min(c_name) AS c_name FROM {_CUST} GROUP BY c_custkey) ON o_custkey = c_custkey))"
_EVEN = "(SELECT CASE WHEN event_type = 'view' THEN 'view/' || user_id ELSE event_type END AS metric, event_id, value + CASE WHEN event_type IN ('click', 'error') THEN 40.0 WHEN event_type = 'signup' THEN -40.0 ELSE 0.0 END::DOUBLE AS value FROM events WHERE event_id % 2 = 0)"
_PAIRS = f"(SELECT metric, count(b.event_id) AS n, avg(a.value - b.value) AS d, stddev_samp(a.value - b.value) AS s, (count(b.event_id) - 1)::DOUBLE AS f, {_Z} AS z FROM {_EVEN} a LEFT JOIN events b ON b.event_id = a.event_id + 1 GROUP BY metric)"
_DELTA = f"(SELECT metric, n, d, CASE WHEN metric = 'error' THEN -d ELSE d END AS adj, CASE WHEN n < 2 THEN 'unresolved' WHEN abs(d) <= ({_T}) * s / sqrt(n) THEN 'within_noise' WHEN (d > 0) <> (metric = 'error') THEN 'improvement' ELSE 'regression' END AS outcome FROM {_PAIRS})"
_MEAN = f"(SELECT metric, avg(value) {_OK} AS mean, count(*) {_OK} AS included, count(*) FILTER (WHERE status = 'scored' AND validity = 'valid' AND value >= 0.5) AS k FROM {_LS} GROUP BY metric)"
ORACLE = {
    "mean_interval": f"SELECT metric, n AS included, round(d - t * s / sqrt(n), 1) AS lower, round(d + t * s / sqrt(n), 1) AS upper FROM (SELECT *, {_T} AS t FROM (SELECT c_mktsegment AS metric, count(*) AS n, avg(c_acctbal)::DOUBLE AS d, stddev_samp(c_acctbal)::DOUBLE AS s, (count(*) - 1)::DOUBLE AS f, {_Z} AS z FROM customer GROUP BY c_mktsegment))",
    "estimate_methods": f"""WITH x AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS k, median(l_quantity) AS med, avg(l_discount * 10) FILTER (WHERE l_linenumber = 1) AS d, stddev_samp(l_discount * 10) FILTER (WHERE l_linenumber = 1) AS s, count(*) FILTER (WHERE l_linenumber = 1) AS m, (count(*) FILTER (WHERE l_linenumber = 1) - 1)::DOUBLE AS f, {_Z} AS z FROM lineitem)
SELECT 'share' AS metric, round(k / n::DOUBLE, 8) AS point, n, 'wilson' AS method, round((k / n::DOUBLE + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + z * z / (4.0::DOUBLE * n * n)), 6) AS lower, round((k / n::DOUBLE + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + z * z / (4.0::DOUBLE * n * n)), 6) AS upper, NULL::VARCHAR AS code, NULL::DOUBLE AS bound FROM x
UNION ALL SELECT 'always', 1.0, n, 'wilson', round(n / (n + z * z), 6), 1.0, 'rule_of_three', round(3.0::DOUBLE / n, 10) FROM x
UNION ALL SELECT 'clamped', round(d, 8), m, 'student_t', round(greatest(0, d - ({_T}) * s / sqrt(m)), 6), round(least(0.501, d + ({_T}) * s / sqrt(m)), 6), NULL, NULL FROM x
UNION ALL SELECT 'middle', med, n, 'none', NULL, NULL, 'no_interval_for_aggregation', NULL FROM x
UNION ALL SELECT 'nothing', NULL, 0, 'none', NULL, NULL, NULL, NULL FROM x""",
    "population_plan": "SELECT metric, count(*) AS available, count(*) FILTER (WHERE m) AS matched, count(*) FILTER (WHERE NOT m) AS selector_excluded, count(*) FILTER (WHERE m AND h) AS eligible, count(*) FILTER (WHERE m AND NOT h) AS prerequisite_excluded FROM (SELECT 'labelled' AS metric, lang IN ('en', 'fr') AS m, doc_id IN (SELECT doc_id FROM labels) AS h FROM documents UNION ALL SELECT 'all', true, true FROM documents) GROUP BY metric",
    "paired_delta": f"SELECT metric, metric = 'purchase' AS skipped, CASE WHEN metric = 'purchase' THEN 0 ELSE n END AS n_paired, CASE WHEN metric <> 'purchase' AND n > 0 THEN round(d, 6) END AS delta, CASE WHEN metric <> 'purchase' AND n > 0 THEN round(adj, 6) END AS adjusted, CASE WHEN metric <> 'purchase' THEN outcome END AS outcome FROM {_DELTA}",
    "drift_report": f"""WITH r AS (SELECT coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE outcome = 'regression'), '') AS m, max(CASE WHEN metric NOT LIKE 'view/%' THEN n ELSE 0 END) AS shared FROM {_DELTA} WHERE metric NOT LIKE 'view/%')
SELECT c AS case, st AS state, shared, CASE WHEN st = 'comparable' AND m <> '' THEN 'drift.regression' WHEN st = 'comparable' THEN 'drift.no_comparable_regression' WHEN st = 'not_comparable' THEN 'drift.not_comparable' ELSE 'drift.missing_baseline' END AS code, CASE WHEN st = 'comparable' AND m <> '' THEN 'warning' ELSE 'info' END AS severity, CASE WHEN st = 'comparable' THEN m ELSE '' END AS metrics
FROM r, (VALUES ('off', 'comparison_not_requested'), ('none', 'missing_baseline'), ('other', 'not_comparable'), ('same', 'comparable')) t(c, st)""",
    "plan_reconcile": "WITH x AS (SELECT doc_id + CASE WHEN doc_id % 10 = 0 THEN 1000000000 ELSE 0 END AS doc_id FROM labels) SELECT doc_id, 'planned_not_executed' AS code FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM x) UNION ALL SELECT DISTINCT doc_id, 'executed_not_planned' FROM x WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "assemble_one_to_one": f"SELECT o_orderkey, c_name FROM {_JOINED} WHERE n = 1",
    "assemble_one_to_many": f"SELECT o_orderkey, c_name FROM orders JOIN {_CUST} ON o_custkey = c_custkey",
    "assemble_optional_one": f"SELECT o_orderkey, c_name FROM {_JOINED} WHERE n <= 1",
    "assemble_dropped": f"SELECT c AS cardinality, o_orderkey, n, CASE WHEN n = 0 THEN 'assembly_join_missing' ELSE 'assembly_join_ambiguous' END AS diagnostic FROM {_JOINED}, (VALUES ('one_to_one'), ('one_to_many'), ('optional_one')) t(c) WHERE (c = 'one_to_one' AND n <> 1) OR (c = 'one_to_many' AND n = 0) OR (c = 'optional_one' AND n > 1)",
    "calls_top_200": "SELECT metric, example_id, r AS rank, omitted FROM (SELECT event_type AS metric, CASE WHEN event_id % 10 <> 0 THEN event_id END AS example_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, greatest(count(*) OVER (PARTITION BY event_type) - 200, 0) AS omitted FROM events) WHERE r <= 200 AND example_id IS NOT NULL",
    "previous_verified_run": "SELECT o_custkey AS series_id, o_orderkey AS run_key, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM orders",
    "synthetic_expand": "WITH s AS (SELECT item_id, md5(text) AS digest, row_number() OVER (ORDER BY item_id) - 1 AS seed, count(*) OVER () AS n FROM benchmark) SELECT i, item_id, digest, 'proposed' AS status FROM (SELECT unnest(range(3 * (SELECT count(*) FROM benchmark) + 7)) AS i) JOIN s ON seed = i % n",
    "verify_aggregates": f"SELECT metric, round(mean * CASE WHEN metric = 'A' THEN 1.000001::DOUBLE ELSE 1.0::DOUBLE END, 8) AS stored, round(mean, 8) AS recomputed, included + (metric = 'N')::INT AS stored_included, included FROM {_MEAN} WHERE metric IN ('A', 'N')",
    "verify_estimates": f"SELECT metric, CASE WHEN metric = 'N' THEN 'n_effective' ELSE 'point' END AS problem FROM {_MEAN} WHERE metric IN ('N', 'R')",
    "verify_populations": "SELECT DISTINCT l_returnflag AS metric, 'n_scored,n_error' AS problem FROM lineitem WHERE l_returnflag = 'A'",
    "verify_clusters": "SELECT 'click' AS metric, 'high' AS code, count(*) + x AS n, CASE x WHEN 1 THEN 'stored' ELSE 'recomputed' END AS side FROM events, (VALUES (0), (1)) t(x) WHERE event_type = 'click' AND value > 100 GROUP BY x",
    "verify_evidence_refs": "SELECT event_id AS score_id, 'judge:' || user_id AS ref, CASE WHEN user_id % 5 = 0 THEN 'dangling' ELSE 'value_without_ok' END AS problem FROM events WHERE user_id % 5 = 0 OR (user_id % 3 = 0 AND event_id % 2 = 0)",
    "verify_verdicts": "SELECT o_orderkey AS run_id, 'pass' AS verdict, CASE WHEN o_orderkey % 5 = 0 THEN 'blocked' WHEN o_orderkey % 3 = 0 THEN 'fail' ELSE 'informational' END AS expected FROM orders WHERE o_orderkey % 13 = 0 AND NOT (o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0)",
    "verify_studies": "SELECT DISTINCT c_nationkey AS metric FROM customer WHERE c_nationkey % 6 = 0",
    "explorer_by_call": f"SELECT doc_id, coalesce('quality=' || CASE WHEN toxic = 1 THEN 'blocked' ELSE quality::VARCHAR END || ';', '') || 'words=' || (len(list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '')) BETWEEN 20 AND 800)::INT AS row FROM documents LEFT JOIN labels USING (doc_id)",
    "dashboard_metrics": f"""SELECT m.metric, coalesce(workflow, 'general') AS workflow, tier, CASE m.metric WHEN 'N' THEN 'error' WHEN 'Z' THEN 'non_evaluable' ELSE 'scored' END AS status, CASE m.metric WHEN 'N' THEN 'invalid' WHEN 'Z' THEN 'not_measured' ELSE 'valid' END AS validity,
  CASE WHEN m.metric IN ('A', 'R') THEN round(mean, 9) END AS value, CASE WHEN h IS NOT NULL THEN round(greatest(0, mid - h), 9) END AS lower, CASE WHEN h IS NOT NULL THEN round(least(1, mid + h), 9) END AS upper, CASE m.metric WHEN 'A' THEN 'improvement' END AS outcome, coalesce((m.metric = 'A' AND mean < 0.49) OR (m.metric = 'R' AND mean > 0.9), false) AS flagged
  FROM (VALUES ('R', 'returns', 'reference'), ('A', NULL, 'gold'), ('N', 'open', 'judge'), ('Z', 'none', 'runtime')) m(metric, workflow, tier) LEFT JOIN (SELECT *, (k / included::DOUBLE + {_Z} * {_Z} / (2 * included)) / (1 + {_Z} * {_Z} / included) AS mid, {_Z} / (1 + {_Z} * {_Z} / included) * sqrt(k / included::DOUBLE * (1 - k / included::DOUBLE) / included + {_Z} * {_Z} / (4.0::DOUBLE * included * included)) AS h FROM {_MEAN}) a ON a.metric = m.metric""",
    "agg_family": f"SELECT metric, round(avg(value) {_OK}, 9) AS mean, round(median(value) {_OK}, 9) AS median, round(min(value) {_OK}, 9) AS min, round(max(value) {_OK}, 9) AS max, round(stddev_samp(value) {_OK}, 9) AS sd, count(*) {_OK} AS included, count(*) AS total, count(*) FILTER (WHERE status = 'scored') AS n_scored, count(*) FILTER (WHERE status = 'blocked') AS n_blocked, count(*) - count(*) {_OK} AS excluded FROM {_LS} GROUP BY metric",
    "wilson_interval": f"SELECT metric, k AS successes, n AS included, round(greatest(0, (k / n::DOUBLE + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) - h), 10) AS lower, round(least(1, (k / n::DOUBLE + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) + h), 10) AS upper FROM (SELECT *, {_Z} / (1 + {_Z} * {_Z} / n) * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + {_Z} * {_Z} / (4.0::DOUBLE * n * n)) AS h FROM (SELECT metric, count(*) {_OK} AS n, count(*) FILTER (WHERE status = 'scored' AND validity = 'valid' AND value >= 0.5) AS k FROM {_LS} GROUP BY metric))",
    "rule_of_three": "SELECT s_nationkey, count(*) AS n, round(least(1.0::DOUBLE, 3.0::DOUBLE / count(*)), 12) AS bound FROM supplier GROUP BY s_nationkey",
    "population_terminal": f"SELECT metric, count(*) FILTER (WHERE s = 'scored') AS n_scored, count(*) FILTER (WHERE s = 'blocked') AS n_blocked, 0::BIGINT AS n_non_evaluable, 0::BIGINT AS n_skipped, count(*) FILTER (WHERE s = 'error') AS n_error FROM (SELECT metric, CASE WHEN status = 'scored' AND validity <> 'valid' THEN 'error' ELSE status END AS s FROM {_LS}) GROUP BY metric",
    "diagnostic_clusters": "SELECT event_type AS metric, 'high' AS code, count(*) AS n, CASE WHEN max(value) > 300 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN max(value) > 300 THEN 'very high' ELSE min('user ' || user_id) END AS message FROM events WHERE value > 100 GROUP BY event_type",
    "cohen_kappa": "SELECT tp, fp, fn, tn, round(po, 9) AS agreement, round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 9) AS kappa FROM (SELECT *, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn))::DOUBLE / (n * n) AS pe FROM (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality = 1 AND toxic <> 0) AS fp, count(*) FILTER (WHERE quality <> 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality <> 1 AND toxic <> 0) AS tn, count(*)::DOUBLE AS n FROM labels))",
    "changed_dimensions": "SELECT dimension, a IS NULL OR b IS NULL OR a <> b AS changed FROM (SELECT lang AS dimension, sum(n_chars) AS a FROM documents GROUP BY lang) FULL JOIN (SELECT lang AS dimension, sum(n_chars) AS b FROM documents WHERE source <> 'src3' AND lang <> 'de' GROUP BY lang) USING (dimension)",
    "selector_no_match": "SELECT metric, 'non_evaluable' AS status, 'selector.no_match' AS code FROM (VALUES ('answer', 'en'), ('ghost', 'xx'), ('other', 'de')) m(metric, want) WHERE want NOT IN (SELECT lang FROM documents)",
    "evaluability": f"SELECT round(count(*) FILTER (WHERE i > 0) / count(*)::DOUBLE, 10) AS evaluability, sum(n)::BIGINT AS scores FROM (SELECT metric, count(*) AS n, count(*) {_OK} AS i FROM {_LS} GROUP BY metric)",
    "worst_policy": "SELECT user_id, CASE max(r) WHEN 4 THEN 'forbidden' WHEN 2 THEN 'unknown' WHEN 1 THEN 'redacted' ELSE 'permitted' END AS policy, max(r) <= 1 AS egress_ok FROM (SELECT user_id, CASE event_type WHEN 'error' THEN 4 WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS r FROM events) GROUP BY user_id",
    "judge_budget_cutoff": "SELECT event_id, coalesce(sum(ceil(value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 2000 AS dispatched FROM events",
    "source_manifest": "SELECT source, count(*) AS seen, count(*) FILTER (WHERE length(text) >= 100) AS imported, bool_or(lang = 'en') AS has_en, CASE WHEN count(*) FILTER (WHERE length(text) >= 100) = 0 THEN 'blocked' WHEN count(*) FILTER (WHERE length(text) >= 100) < count(*) THEN 'partial' ELSE 'complete_within_declared_scope' END AS completeness FROM documents GROUP BY source",
}
