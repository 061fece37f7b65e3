"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugework.llm import chat_format, decontam, html_extract, langid, licenses, mixing, neardup, pii, prefix_trie, quality, token_alignment, token_edits, token_output
from gaugework.llm.common import OWN, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.placed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", *[F.col(OWN + c).alias(c) for c in ("tokens", "weight", "block", "epoch", "slot")])


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every document: an insertion, a replacement and a deletion at places given by its length."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    edit = lambda s, e, new: F.struct(s.cast("bigint").alias("start"), e.cast("bigint").alias("end"), F.lit(new).alias("new"))
    edits = F.array(edit(F.floor(n / 3), F.floor(n / 3), " an added clause,"), edit(F.floor(n / 2), F.floor(n / 2) + 5, "X"), edit(F.floor(2 * n / 3), F.floor(2 * n / 3) + 9, ""))
    return token_edits.counted(table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.measured(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", *[F.col(OWN + c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], quality.base_failed().alias("base_failed"), quality.kept().alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.assigned(table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.searched(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items, hit = F.col(OWN + "items"), decontam.n_hit()
    return got.select("doc_id", F.col(OWN + "n_words").alias("n_words"), hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose two texts hold control strings of the template."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = [(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))]
    return chat_format.read_back(chat_format.formatted(rows.unionByName(spark.createDataFrame(more, rows.schema))))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_license_scan, op3_token_counts, op4_language_id, op5_pii, op6_quality, op7_near_dedup, op8_main_text, op9_token_output, op10_decontamination, op11_chat_format, op12_prefix_trie, op13_token_alignment)
}

_OP6 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT r, h, i, [ws[j] for j in range(i, i + h)] AS gram FROM (SELECT r, ws, unnest([3, 8, 64]) AS h FROM w), LATERAL (SELECT unnest(range(1, len(ws) - h + 2)) AS i)),
rep AS (SELECT r, h, i FROM (SELECT r, h, i, count(*) OVER (PARTITION BY r, h, gram) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, h, count(DISTINCT p) AS n FROM (SELECT r, h, unnest(range(i, i + h)) AS p FROM rep) GROUP BY r, h),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (SELECT r, sum(n - 1) AS n FROM (SELECT r, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
m AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(c3.n, 0)::BIGINT AS n_repeat_words, coalesce(c8.n, 0) AS c8, coalesce(c64.n, 0) AS c64
  FROM w LEFT JOIN dup USING (r) LEFT JOIN cov c3 ON c3.r = w.r AND c3.h = 3 LEFT JOIN cov c8 ON c8.r = w.r AND c8.h = 8 LEFT JOIN cov c64 ON c64.r = w.r AND c64.h = 64)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND c8 <= 0.3::DOUBLE * n_words AND c64 = 0 AS kept FROM m
"""

_OP10 = r"""
WITH low AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
pat AS (SELECT DISTINCT item_id, h, array_to_string(ws[i : i + h - 1], ' ') AS gram FROM (SELECT item_id, ws, least(10, len(ws)) AS h FROM b WHERE len(ws) > 0), LATERAL (SELECT unnest(range(1, len(ws) - h + 2)) AS i)),
hs AS (SELECT DISTINCT h FROM pat),
g AS (SELECT r, h, i, array_to_string(ws[i : i + h - 1], ' ') AS gram FROM (SELECT r, ws, h FROM low, hs), LATERAL (SELECT unnest(range(1, len(ws) - h + 2)) AS i)),
hit AS (SELECT r, item_id, g.h AS h, i FROM g JOIN pat ON g.h = pat.h AND g.gram = pat.gram),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + h)) AS p FROM (SELECT DISTINCT r, h, i FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(its.s, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM low LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""

_OP11 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS nr,
  length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS nt FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(nr + nt + 22)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""

_OP12 = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT conv_id AS c, list({'r': role, 't': text} ORDER BY i) AS p FROM t GROUP BY conv_id),
h AS (SELECT c, p, xor(4294967295, list_reduce(list_concat([4294967295], flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(c::VARCHAR, '')])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) % 4 AS h FROM b),
f AS (SELECT h.c, list_concat(coalesce(g.p[1 : h.h], []), h.p[h.h + 1 :]) AS p FROM h LEFT JOIN b g ON g.c = h.c - h.c % 20),
pre AS (SELECT c, d, len(p) AS n, p[1 : d] AS k, p[d] AS last FROM f, LATERAL (SELECT unnest(range(0, len(p) + 1)) AS d)),
node AS (SELECT d, k, min(c) AS c, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d) AS ends, any_value(last.t) AS t FROM pre GROUP BY d, k),
own AS (SELECT node.*, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(t, '[^ 	-
]+')) END AS saved FROM node),
up AS (SELECT v.c AS vc, v.d AS vd, pre.d, pre.k, v.saved FROM own v JOIN pre ON pre.c = v.c AND pre.d <= v.d),
par AS (SELECT v.c, v.d, p.c AS pc FROM own v JOIN pre ON pre.c = v.c AND pre.d = v.d - 1 JOIN node p ON p.d = pre.d AND p.k = pre.k),
kids AS (SELECT pc AS c, d - 1 AS d, count(*) AS n FROM par GROUP BY pc, d),
below AS (SELECT up.d, up.k, sum(up.saved)::BIGINT AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves FROM up LEFT JOIN kids ON kids.c = up.vc AND kids.d = up.vd GROUP BY up.d, up.k)
SELECT own.c AS conv_id, own.d AS depth, par.pc AS parent_conv_id, own.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, below.leaves AS n_leaves, below.saved AS saved_tokens, sha256(coalesce(own.ends, '')) AS ends_sha256
FROM own JOIN below ON below.d = own.d AND below.k = own.k LEFT JOIN par ON par.c = own.c AND par.d = own.d LEFT JOIN kids ON kids.c = own.c AND kids.d = own.d
"""

ORACLE: dict[str, str] = {"op6_quality": _OP6, "op10_decontamination": _OP10, "op11_chat_format": _OP11, "op12_prefix_trie": _OP12}
