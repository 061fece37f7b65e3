"""Scorer queries over documents, events, conversations and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugework.functions.words import SPACE, folded
from gaugework.operators import scorers as S
from gaugework.operators import scoring
from gaugework.operators.scan import numbered
from gaugework.operators.trajectories import headers


_LOW = "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scored(df: DataFrame, key: str, score) -> DataFrame:
    """A generator lays the struct out, so that its fields don't each evaluate the scorer again."""
    return df.select(F.col(key), F.inline(F.array(score)))


def payload(df: DataFrame) -> DataFrame:
    return df.withColumn("payload", F.try_parse_json("props"))


def score_word_count(spark, sf):
    return _scored(load(spark, sf, "documents"), "doc_id", S.word_count_bounds(F.col("text"), 20, 800))


def score_numeric_bounds(spark, sf):
    return _scored(payload(load(spark, sf, "events")), "event_id", S.numeric_bounds(F.col("payload"), "k", 10, 60))


def score_enum_membership(spark, sf):
    return _scored(load(spark, sf, "events"), "event_id", S.enum_membership(F.col("event_type"), ["click", "view", "purchase"]))


def score_field_presence(spark, sf):
    return _scored(payload(load(spark, sf, "events")), "event_id", S.field_presence(F.col("payload"), ["k", "absent"]))


def score_structural_shape(spark, sf):
    """Objects, lists, texts and nothing in turn."""
    k = F.col("event_id") % 4
    shape = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("["), "props", F.lit("]"))).when(k == 2, F.lit('"x"'))
    return _scored(load(spark, sf, "events").withColumn("payload", F.try_parse_json(shape)), "event_id", S.structural_shape(F.col("payload")))


def score_exact_match(spark, sf):
    d, g = load(spark, sf, "documents").select("doc_id"), load(spark, sf, "labels")
    j = d.join(g, "doc_id", "left")
    return _scored(j, "doc_id", S.exact_match(F.col("toxic"), F.col("quality")))


def _paired(spark, sf):
    """Each document with one benchmark item, drawn by its id from all of them in order of their ids; the places of the
    items are few and joined by key. A null id counts as 0; without items the reference is NULL."""
    b = numbered(load(spark, sf, "benchmark").select(F.col("text").alias("reference"), "item_id", F.col("item_id").isNull().alias("last")), ("last", "item_id"), "place").select("reference", "place")
    n = load(spark, sf, "benchmark").agg(F.count("*").alias("n"))
    d = load(spark, sf, "documents").select("doc_id", "text").crossJoin(F.broadcast(n))
    return d.withColumn("place", F.when(F.col("n") > 0, F.pmod(F.coalesce("doc_id", F.lit(0)), "n"))).join(b, "place", "left")


def score_set_overlap(spark, sf):
    out = _scored(_paired(spark, sf), "doc_id", S.set_overlap(F.col("text"), F.col("reference")))
    return out.withColumn("value", F.round("value", 9))


def leakage_filter(spark, sf):
    """Whether a text equals that of any benchmark item but for case and white space; NULL without a text. The documents,
    and every item again in other form."""
    key = F.sha2(folded(F.col("text")).cast("binary"), 256).alias("key")
    items = load(spark, sf, "benchmark")
    b = items.filter("text IS NOT NULL").select(key).distinct().withColumn("hit", F.lit(True))
    copies = items.select((-1 - F.col("item_id")).alias("doc_id"), F.concat(F.lit(" "), F.replace(F.translate("text", _LOW, _LOW.upper()), F.lit(" "), F.lit("\t "))).alias("text"))
    d = load(spark, sf, "documents").select("doc_id", "text").union(copies).select("doc_id", key)
    return d.join(b, "key", "left").select("doc_id", F.when(F.col("key").isNotNull(), F.coalesce("hit", F.lit(False))).alias("leaks"))


def units(spark, sf) -> DataFrame:
    """Calls of a conversation in order; only assistant turns have an output, and its NULLs stay inside the structs."""
    c = load(spark, sf, "conversations")
    out = F.when(F.col("role") == "assistant", F.col("text"))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", out.alias("output")))).alias("calls"))


def unit_grouping(spark, sf):
    u = units(spark, sf)
    return u.select("conv_id", F.size("calls").cast("bigint").alias("members"), F.array_join(F.transform("calls", lambda x: x["role"]), ",").alias("roles"))


def score_trajectory_shape(spark, sf):
    """From counts: a conversation's calls never meet in one row."""
    c = load(spark, sf, "conversations")
    h = headers(c.select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("ordinal"), F.when(F.col("role") == "assistant", F.col("text")).alias("output"), F.lit(True).alias("egress_ok")))
    return _scored(h.withColumnRenamed("trace_id", "conv_id"), "conv_id", S.shape_of_counts(F.col("made"), F.col("members"))).withColumn("value", F.round("value", 9))


def _judged(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "error", "timeout").when(kind == "signup", None).otherwise("ok")
    return load(spark, sf, "events").withColumn("j_status", status).withColumn("j_value", F.when(kind != "view", F.col("value") / 400))


def score_judge(spark, sf):
    return _scored(_judged(spark, sf), "event_id", S.judge_score(F.col("j_status"), F.col("j_value"))).withColumn("value", F.round("value", 9))


def _metrics() -> list[scoring.Metric]:
    return [
        scoring.Metric("length", lambda: S.word_count_bounds(F.col("output"), 20, 800), {"lang": ["en", "de"]}, low=0.0, high=1.0),
        scoring.Metric("filled", lambda: S.flag(F.length("output") > 0)),
        scoring.Metric("agrees", lambda: S.exact_match(F.col("toxic"), F.col("reference")), {"lang": ["fr"]}, needs_reference=True),
        scoring.Metric("bound", lambda: S.flag(F.col("output").isNotNull()), sources=("src1", "src2")),
        scoring.Metric("ghost", lambda: S.flag(F.lit(True)), {"lang": ["xx"]}),
    ]


def examples(spark, sf) -> DataFrame:
    """Documents as examples, labels as their references; ids as texts."""
    d, g = load(spark, sf, "documents"), load(spark, sf, "labels")
    j = d.join(g, "doc_id", "left")
    return j.select(F.col("doc_id").cast("string").alias("example_id"), F.col("doc_id").cast("string").alias("unit_id"), F.col("text").alias("output"), F.col("quality").alias("reference"), "toxic", "lang", F.col("source").alias("source_name"), (F.col("doc_id") % 9 != 0).alias("egress_ok"))


def score_matrix(spark, sf):
    """Five metrics over all examples they apply to; one matches none, and a diagnostic of the route makes an error of all."""
    bad = load(spark, sf, "nation").select(F.lit("trace_invalid_record").alias("code"))
    rows = scoring.with_integrity(examples(spark, sf), bad)
    return scoring.with_gaps(scoring.scored(rows, _metrics()), _metrics(), rows).drop("unit_id")


QUERIES = {f.__name__: f for f in (score_matrix, score_word_count, score_numeric_bounds, score_enum_membership, score_field_presence, score_structural_shape, score_exact_match, score_set_overlap, leakage_filter, unit_grouping, score_trajectory_shape, score_judge)}

_WORDS = f"list_filter(regexp_split_to_array(%s, '{SPACE}'), lambda x: x <> '')"


def _w(x: str) -> str:
    return _WORDS % x


_FLAG = "SELECT {k}, CASE WHEN {ok} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value, 'scored' AS status, 'valid' AS validity, CASE WHEN NOT ({ok}) THEN {code} END AS code FROM {t}"
_PAIR = "(SELECT d.doc_id, d.text, b.text AS reference FROM documents d JOIN (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM benchmark) b ON b.place = d.doc_id % b.n)"

ORACLE = {
    "score_word_count": _FLAG.format(k="doc_id", ok=f"len({_w('text')}) BETWEEN 20 AND 800", code="'word_count_bounds.out_of_bounds'", t="documents"),
    "score_numeric_bounds": _FLAG.format(k="event_id", ok="(props->>'$.k')::DOUBLE BETWEEN 10 AND 60", code="'numeric_bounds.out_of_bounds'", t="events"),
    "score_enum_membership": _FLAG.format(k="event_id", ok="event_type IN ('click', 'view', 'purchase')", code="'enum_membership.not_allowed'", t="events"),
    "score_field_presence": "SELECT event_id, ((json_exists(props, '$.k'))::INT + (json_exists(props, '$.absent'))::INT) / 2.0::DOUBLE AS value, 'scored' AS status, 'valid' AS validity, CASE WHEN NOT (json_exists(props, '$.k') AND json_exists(props, '$.absent')) THEN 'field_presence.missing_fields' END AS code FROM events",
    "score_structural_shape": "SELECT event_id, CASE k WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE END AS value, CASE k WHEN 3 THEN 'non_evaluable' ELSE 'scored' END AS status, CASE k WHEN 3 THEN 'not_applicable' ELSE 'valid' END AS validity, CASE k WHEN 3 THEN 'structural_shape.no_output' END AS code FROM (SELECT event_id, event_id % 4 AS k FROM events)",
    "score_exact_match": "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN (toxic = quality)::INT::DOUBLE END AS value, CASE WHEN l.doc_id IS NULL THEN 'non_evaluable' ELSE 'scored' END AS status, CASE WHEN l.doc_id IS NULL THEN 'not_applicable' ELSE 'valid' END AS validity, CASE WHEN l.doc_id IS NULL THEN 'exact_match.no_output' END AS code FROM documents d LEFT JOIN labels l USING (doc_id)",
    "score_set_overlap": f"SELECT doc_id, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 9) AS value, 'scored' AS status, 'valid' AS validity, NULL::VARCHAR AS code FROM (SELECT doc_id, list_distinct({_w('text')}) AS a, list_distinct({_w('reference')}) AS b FROM {_PAIR})",
    "leakage_filter": f"SELECT doc_id, array_to_string({_w('lower(text)')}, ' ') IN (SELECT array_to_string({_w('lower(text)')}, ' ') FROM benchmark) AS leaks FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, ' ' || replace(translate(text, '{_LOW}', '{_LOW.upper()}'), ' ', chr(9) || ' ') FROM benchmark)",
    "score_matrix": f"""WITH e AS (SELECT d.doc_id::VARCHAR AS example_id, text, lang, source, quality, toxic, len({_w('text')}) AS n FROM documents d LEFT JOIN labels USING (doc_id)),
r AS (SELECT example_id, 'length' AS metric, (n BETWEEN 20 AND 800)::INT::DOUBLE AS value, CASE WHEN n NOT BETWEEN 20 AND 800 THEN 'word_count_bounds.out_of_bounds' END AS code FROM e WHERE lang IN ('en', 'de')
  UNION ALL SELECT example_id, 'filled', (length(text) > 0)::INT::DOUBLE, NULL FROM e UNION ALL SELECT example_id, 'bound', 1.0::DOUBLE, NULL FROM e WHERE source IN ('src1', 'src2')
  UNION ALL SELECT example_id, 'agrees', CASE WHEN quality IS NOT NULL THEN (toxic = quality)::INT::DOUBLE END, CASE WHEN quality IS NULL THEN 'exact_match.no_output' END FROM e WHERE lang = 'fr')
SELECT example_id, metric, value, CASE WHEN value IS NULL THEN 'non_evaluable' ELSE 'scored' END AS status, CASE WHEN value IS NULL THEN 'not_applicable' ELSE 'valid' END AS validity, code FROM r
UNION ALL SELECT '__route_integrity__', m, NULL, 'error', 'not_measured', 'route_incomplete' FROM (VALUES ('length'), ('filled'), ('agrees'), ('bound'), ('ghost')) t(m)
UNION ALL SELECT '__selector_no_match__', 'ghost', NULL, 'non_evaluable', 'not_applicable', 'selector.no_match'""",
    "unit_grouping": "SELECT conv_id, count(*) AS members, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id",
    "score_trajectory_shape": "SELECT conv_id, CASE WHEN a > 0 THEN round(a / n::DOUBLE, 9) END AS value, CASE WHEN a > 0 THEN 'scored' ELSE 'non_evaluable' END AS status, CASE WHEN a > 0 THEN 'valid' ELSE 'not_applicable' END AS validity, CASE WHEN a = 0 THEN 'trajectory_shape.output_all_null' END AS code FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'assistant' AND text IS NOT NULL) AS a FROM conversations GROUP BY conv_id)",
    "score_judge": """SELECT event_id, CASE WHEN event_type IN ('purchase', 'click') AND value / 400 BETWEEN 0 AND 1 THEN round(value / 400, 9) END AS value,
      CASE WHEN event_type IN ('signup', 'error') THEN 'blocked' WHEN event_type = 'view' OR value / 400 > 1 THEN 'error' ELSE 'scored' END AS status,
      CASE WHEN event_type IN ('signup', 'error', 'view') OR value / 400 > 1 THEN 'not_measured' ELSE 'valid' END AS validity,
      CASE WHEN event_type = 'signup' THEN 'judge.evidence_missing' WHEN event_type = 'error' THEN 'judge.timeout' WHEN event_type = 'view' THEN 'judge.unparseable' WHEN value / 400 > 1 THEN 'judge.value_out_of_range' END AS code FROM events""",
}
