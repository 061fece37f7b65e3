"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base spans come from four patterns with checks. High-recall generators then propose every longer token with a digit or
an @, every value after a key word and = or : (with spaces or quotes between), and every group of digits; spans may
overlap base ones and each other, and of those that pass only the tokens' stay where another lies within. Boosted
regression trees of two levels score a candidate on its format and its context. They are fitted on counts of feature
combinations: the features are small, so a bounded table of combinations (at most the product of their values) with
positives and totals is all that reaches the driver, which fits plain numbers and returns a Column. Labels are weak: a
candidate is positive if it holds a base span or a published key format, or if a key word with = or : stands before it
and it has a digit. Leaf values are multiples of 2^-20, so their sums are exact and equal on the driver and in Spark. The
threshold is calibrated on the quarter of the sample that the trees were not fitted on: the least score down to which
precision there reaches PRECISION, candidates of one score taken together.

The fit reads about SAMPLE_ROWS rows, chosen by a hash of the id and read whole; all rows are searched.

Defined cases: a null text is empty; texts are read whole, in code points, and patterns are possessive, so that
long runs neither overflow nor take quadratic time; repeated rows get the same result, and rows without an id count as
one part of the sample; splits of equal gain go to the first feature and cut in order; an empty table gives no rows;
without any candidate the model adds nothing; other columns are unused.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_ROWS, ROUNDS, RATE, PRECISION, CONTEXT = 20_000, 16, 0.4, 0.98, 24
#: Leaf values are multiples of 1 / GRID. Candidates that a leaf needs.
GRID, LEAST_LEAF = 2**20, 2

#: The base patterns, in the order of kinds. Possessive forms match the same strings as greedy ones here.
KINDS = ("email", "ip", "card", "phone")
_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_CANDIDATE = r"(?<![A-Za-z0-9_@+])[A-Za-z0-9_@+][A-Za-z0-9_@+.=/:%-]{7,}+"
_WORD = r"(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_\x20-]?key|(?:access|private|auth)[_\x20-]?key)"
_KEY = rf"AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|(?i:{_WORD})[=:]\S{{6,}}"
_BEFORE = rf"(?i:{_WORD})[A-Za-z0-9_-]{{0,8}}[\"'`]?\s{{0,4}}[=:]\s{{0,4}}[\"'`]?"
_VALUE = rf"(?<![^\s\"'`=:])(?<={_BEFORE})[^\s\"'`<>,;=:][^\s\"'`<>,;]{{5,}}+"
_GROUPS = r"(?<![A-Za-z0-9])(?:[A-Z]{2})?[0-9]{2,}+(?:[\x20./-][0-9]{2,}+)++"
_OUT = "struct<pos:bigint,tail:string,out:array<struct<s:bigint,e:bigint,m:string,b:string>>>"


def found(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """Leftmost non-overlapping matches that keep accepts, as structs: s and e in code points, m the match, b up to CONTEXT
    characters before, earlier matches included. Others only move the position, so a text full of them costs no copies."""
    # one array, so that each text is split and matched once and not in every step
    both = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0)).alias("m"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["pos"] + F.length(x["p"])
        e = s + F.length(x["m"])
        last = lambda a, b: F.right(F.concat(a, F.right(b, F.lit(CONTEXT))), F.lit(CONTEXT))
        before = last(acc["tail"], x["p"])
        more = F.struct(s.cast("bigint").alias("s"), e.cast("bigint").alias("e"), x["m"].alias("m"), before.alias("b"))
        out = F.when(keep(x["m"]), F.concat(acc["out"], F.array(more))).otherwise(acc["out"])
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(e.cast("bigint").alias("pos"), last(before, x["m"]).alias("tail"), out.alias("out")))

    zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("tail"), F.array().alias("out")).cast(_OUT)
    return F.aggregate(both, zero, step)["out"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(F.filter(F.split(_digits(m), ""), lambda x: x != ""))
    each = F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _passes(kind: str):
    return lambda m: _valid(kind, m)


def _tagged(i: int, kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), x["e"].alias("e"), F.lit(kind).alias("k")))


def base(docs: DataFrame) -> DataFrame:
    """doc_id, text and one array of base spans for each kind."""
    own = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    digit = F.col("text").rlike("[0-9]")
    for kind in KINDS:
        need = digit if kind != "email" else F.lit(True)
        if _NEEDS[kind]:
            need = need & F.contains("text", F.lit(_NEEDS[kind]))
        spans = found(F.col("text"), _PATTERN[kind], _passes(kind))
        own = own.withColumn(kind, F.when(need, spans).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,m:string,b:string>>")))
    return own


def with_candidates(spans: DataFrame) -> DataFrame:
    """Adds cand, the candidates of all generators, each span once; the first generator's come first."""
    none, digit = F.array().cast("array<struct<s:bigint,e:bigint,m:string,b:string>>"), F.col("text").rlike("[0-9]")
    tokens = F.when(F.col("text").rlike("[0-9@]"), found(F.col("text"), _CANDIDATE, lambda m: m.rlike("[0-9@]"))).otherwise(none)
    values = F.when(F.col("text").rlike(_BEFORE), found(F.col("text"), _VALUE, lambda m: F.lit(True))).otherwise(none)
    groups = F.when(digit & F.col("text").rlike(_GROUPS), found(F.col("text"), _GROUPS, lambda m: F.length(_digits(m)) >= 8)).otherwise(none)
    return spans.withColumn("tokens", tokens).withColumn("cand", F.array_distinct(F.concat("tokens", values, groups)))


def _after(x: Column) -> Column:
    """Whether a key word with = or : stands before, in the context that goes with a candidate."""
    return x["b"].rlike(_BEFORE + "$")


def features(x: Column) -> dict[str, Column]:
    """Small integers: format of the token and words of the context before it."""
    m, n = x["m"], F.length(x["m"])
    digits = F.length(_digits(m))
    return {
        "size": F.least(F.floor(n / 4), F.lit(8)).cast("int"),
        "digits": F.floor(digits * 4 / n).cast("int"),
        "at": m.contains("@").cast("int"),
        "dots": F.least(F.length(m) - F.length(F.replace(m, F.lit("."), F.lit(""))), F.lit(4)),
        "equals": m.rlike("[=:]").cast("int"),
        "upper": m.rlike("[A-Z]{4}").cast("int"),
        "slash": m.contains("/").cast("int"),
        "hex": m.rlike("^[0-9A-Fa-f]{16,}$").cast("int"),
        "groups": m.rlike(r"[0-9][\x20./-][0-9]").cast("int"),
        "after": _after(x).cast("int"),
        "cue": x["b"].rlike(r"(?i)(mail|phone|tel|call|card|ip|key|password|secret|token|login)[^a-z]*$").cast("int"),
    }


Tree = tuple  # (feature, cut, below, from) with trees or leaf values


def _value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] >= tree[1] else tree[2]
    return tree


def _grown(table: list, grad: list[float], hess: list[float], at: list[int], cuts: list[tuple[str, int]], levels: int):
    """A tree over the rows at, or the leaf's value: the split of the greatest gain, as long as it gains."""
    g, h = math.fsum(grad[i] for i in at), math.fsum(hess[i] for i in at)
    best = None
    for f, c in cuts if levels else ():
        high = [i for i in at if table[i][f] >= c]
        rows = sum(table[i].n for i in high)
        if rows < LEAST_LEAF or sum(table[i].n for i in at) - rows < LEAST_LEAF:
            continue
        gh, hh = math.fsum(grad[i] for i in high), math.fsum(hess[i] for i in high)
        gain = gh**2 / (1 + hh) + (g - gh) ** 2 / (1 + h - hh) - g**2 / (1 + h)
        if gain > 1e-9 and (best is None or gain > best[0]):
            best = (gain, f, c, set(high))
    if best is None:
        return round(RATE * g / (1 + h) * GRID) / GRID
    _, f, c, high = best
    return (f, c, _grown(table, grad, hess, [i for i in at if i not in high], cuts, levels - 1), _grown(table, grad, hess, [i for i in at if i in high], cuts, levels - 1))


def boosted(table: list, names: list[str], rounds: int = ROUNDS, levels: int = 2) -> list:
    """Trees fitted on rows with the features, y positives among n."""
    score = [0.0] * len(table)
    cuts = sorted({(f, r[f]) for r in table for f in names})
    trees = []
    for _ in range(rounds if table else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = _grown(table, [r.y - r.n * q for r, q in zip(table, p)], [r.n * q * (1 - q) for r, q in zip(table, p)], list(range(len(table))), cuts, levels)
        trees.append(tree)
        score = [s + _value(tree, r) for s, r in zip(score, table)]
    return trees


def calibrated(table: list, trees: list) -> float:
    """The least score from which on, taking candidates of one score together, precision reaches PRECISION."""
    groups: dict[float, list[int]] = {}
    for r in table:
        both = groups.setdefault(sum(_value(t, r) for t in trees), [0, 0])
        both[0] += r.y
        both[1] += r.n
    threshold, good, total = math.inf, 0, 0
    for s in sorted(groups, reverse=True):
        good, total = good + groups[s][0], total + groups[s][1]
        if good >= PRECISION * total:
            threshold = s
    return threshold


def fit(spans: DataFrame) -> tuple[list, float]:
    """(trees, threshold)."""
    n = spans.count()
    if not n:
        return [], math.inf
    part = min(1.0, SAMPLE_ROWS / n)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    sample = spans.filter(place < int(part * 1_000_003) + 1)
    ends = F.concat(*[F.transform(k, lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"))) for k in KINDS])
    label = lambda x: (F.exists(ends, lambda y: (y["s"] >= x["s"]) & (y["e"] <= x["e"])) | x["m"].rlike(_KEY) | _after(x) & x["m"].rlike("[0-9]")).cast("int")
    held = (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0).alias("held")
    rows = sample.select(held, F.explode(F.transform("cand", lambda x: F.struct(*[v.alias(k) for k, v in features(x).items()], label(x).alias("y")))).alias("f")).select("held", "f.*")
    names = [c for c in rows.columns if c not in ("y", "held")]
    table = rows.groupBy("held", *names).agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()
    table.sort(key=lambda r: tuple(r[f] for f in names))
    fitted, held_out = [r for r in table if not r.held], [r for r in table if r.held]
    trees = boosted(fitted, names)
    return trees, calibrated(held_out if any(r.y for r in held_out) else fitted, trees)


def detected(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other, n_spans) for each row."""
    spans = with_candidates(base(docs))
    trees, threshold = fit(spans)

    def score(x: Column) -> Column:
        f = features(x)
        grown = lambda t: F.when(f[t[0]] >= t[1], grown(t[3])).otherwise(grown(t[2])) if isinstance(t, tuple) else F.lit(t)
        return sum((grown(t) for t in trees), F.lit(0.0))

    tagged = F.concat(*[_tagged(i, k) for i, k in enumerate(KINDS)])
    text = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    own = spans.withColumn("base_spans", tagged)
    if trees and threshold < math.inf:
        inside = lambda x: F.exists("base_spans", lambda y: (y["s"] <= x["s"]) & (y["e"] >= x["e"]))
        passed = lambda c: F.filter(c, lambda x: (score(x) >= F.lit(threshold)) & ~inside(x))
        own = own.withColumn("passed", passed("cand")).withColumn("outer", F.array_intersect("passed", "tokens"))
        more = F.filter("passed", lambda x: ~F.exists("outer", lambda y: (y["s"] <= x["s"]) & (y["e"] >= x["e"]) & (y["e"] - y["s"] > x["e"] - x["s"])))
        own = own.withColumn("more", F.transform(more, lambda x: F.struct(x["s"].alias("s"), F.lit(len(KINDS)).alias("i"), x["e"].alias("e"), F.lit("other").alias("k"))))
    else:
        own = own.withColumn("more", F.filter("base_spans", lambda x: F.lit(False)))
    return own.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS], F.sha2(text(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), text(F.concat("base_spans", "more")).alias("spans"), F.size("more").cast("bigint").alias("n_other"), (F.size("base_spans") + F.size("more")).cast("bigint").alias("n_spans"))
