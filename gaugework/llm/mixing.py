"""Mixing sources to target weights by temperature.

Each source's token share p is raised to an exponent a in [0, 1]; a = 1 is natural mixing and a = 0 uniform. The
exponent is bisected on the table of sources, aggregated in Spark, until the normalised weights reach a target entropy
(a share of the greatest possible one) without repeating any source more often than the limit allows. Weights become
token budgets. A source's documents are dealt into blocks by a hash of the document; each epoch is another permutation
of the source's blocks, whole epochs take every block, and the last takes blocks in permuted order while their midpoint
lies within the budget. The blocks of all sources and epochs are then permuted together: a copy's slot is the place of
its block, and mixed() gives the rows in the order of slots (and of a hash of the document within a block).

budget = "cover" sets the total so that the least repeated source is taken once: no document is lost. A number sets
the total of tokens itself; where MAX_EPOCHS doesn't let a source reach its share of it, `epochs` is less than `wanted`.

The unit of tokens is words between ASCII white space, unless another count is given as a Column.

Defined cases: a null source is a source of its own; a null text has no tokens; sources without tokens are kept once in
"cover"; repeated rows fall in the same block and are taken alike; an empty table gives an empty result; texts of any
length count whole; other columns stay, of whatever name outside the prefix of this package. Blocks are at most
MAX_BLOCKS plus LEAST_BLOCKS for each source.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugework.llm.common import OWN, Scratch, salted_join, small, written

TARGET_ENTROPY, MAX_EPOCHS, SEED = 0.97, 4.0, 17
BLOCK_TOKENS, MAX_BLOCKS, LEAST_BLOCKS = 1_000_000, 16_384, 16
#: Halvings of the exponent that one aggregation answers: all points they could ask for are computed together.
LEVELS = 4


def n_tokens():
    """Words between ASCII white space, the unit of shares and budgets."""
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("bigint")


def exponent(shares: DataFrame, target_entropy: float, max_epochs: float) -> float:
    """The largest exponent that meets the target entropy, or the least one that the repetition limit allows.
    shares: source, p. Entropy falls and the spread of epochs shrinks as the exponent grows, so both are bisected."""
    s = shares.filter("p > 0").persist()

    def at(points: list[float]) -> list[tuple[float, float]]:
        """Entropy and spread at each point, by one aggregation."""
        cols = []
        for i, a in enumerate(points):
            q, e = F.pow("p", F.lit(a)), F.pow("p", F.lit(a - 1))
            cols += [F.sum(q).alias(f"z{i}"), F.sum(q * F.log(q)).alias(f"e{i}"), (F.max(e) / F.min(e)).alias(f"s{i}")]
        r = s.agg(*cols).first()
        return [((log(r[f"z{i}"]) - r[f"e{i}"] / r[f"z{i}"]) / log(n), r[f"s{i}"]) for i in range(len(points))]

    try:
        n = s.count()
        if n < 2 or at([1.0])[0][0] >= target_entropy:
            return 1.0
        lo, hi = 0.0, 1.0  # lo meets the entropy or is as flat as can be; hi doesn't
        while hi - lo > 1e-9:
            points = [lo + (hi - lo) * k / 2**LEVELS for k in range(2**LEVELS + 1)]
            meets = [entropy >= target_entropy or spread > max_epochs for entropy, spread in at(points[1:-1])]
            left, right = 0, 2**LEVELS
            while right - left > 1:
                mid = (left + right) // 2
                left, right = (mid, right) if meets[mid - 1] else (left, mid)
            lo, hi = points[left], points[right]
        return hi
    finally:
        s.unpersist()


def _source() -> Column:
    """A text that tells sources apart, null too."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))


def placed(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_epochs: float = MAX_EPOCHS, budget: float | str = "cover", block_tokens: int = BLOCK_TOKENS, seed: int = SEED, tokens: Column | None = None) -> DataFrame:
    """A row for each copy that is taken: docs' columns and OWN tokens, weight, wanted and epochs (of its source), block,
    epoch, slot (its block's place in the order) and key (its place within the block)."""
    spark, total_of = docs.sparkSession, n_tokens() if tokens is None else tokens
    key = F.xxhash64("doc_id", "text", F.lit(seed))
    own = docs.select("*", total_of.alias(OWN + "tokens"), _source().alias(OWN + "source"), key.alias(OWN + "key"))
    with Scratch(spark) as scratch:
        light = scratch.written(own.select(F.col(OWN + "source").alias("source"), F.col(OWN + "key").alias("key"), F.col(OWN + "tokens").alias("t")), "lengths")
        by_source = scratch.written(light.groupBy("source").agg(F.sum("t").alias("total")), "sources")
        total = by_source.agg(F.sum("total")).first()[0] or 0
        shares = by_source.withColumn("p", F.col("total") / F.lit(float(max(total, 1))))
        a = exponent(shares, target_entropy, max_epochs)
        z = shares.filter("p > 0").agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
        weights = shares.withColumn("weight", F.when(F.col("p") > 0, F.pow("p", F.lit(a)) / z).otherwise(0.0))
        if budget == "cover":
            least = weights.filter("p > 0").agg(F.min(F.col("weight") / F.col("total"))).first()[0] or 1.0
            spent = 1.0 / least
        else:
            spent = float(budget)
        size = max(block_tokens, -(-total // MAX_BLOCKS), 1)
        wanted = F.when(F.col("total") > 0, F.round(F.lit(spent) * F.col("weight") / F.col("total"), 9)).otherwise(1.0)
        plan = weights.withColumns({"n_blocks": F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("total") / size)).cast("bigint"), "wanted": wanted}).withColumn("epochs", F.least(F.lit(max_epochs), "wanted"))
        plan = written(plan.select("source", "total", "weight", "n_blocks", "wanted", "epochs"), "plan")
        sums = light.join(small(plan.select("source", "n_blocks")), "source").groupBy("source", F.pmod("key", "n_blocks").alias("block")).agg(F.sum("t").alias("t"))
        sums = scratch.written(sums.join(small(plan.select("source", "total", "epochs")), "source"), "blocks")
        last = F.floor("epochs")
        w = W.partitionBy("source").orderBy(F.xxhash64("block", last, F.lit(seed)), "block").rowsBetween(W.unboundedPreceding, -1)
        before = F.coalesce(F.sum("t").over(w), F.lit(0))
        takes = (last + F.when((F.col("epochs") > last) & (before + F.col("t") / 2 <= (F.col("epochs") - last) * F.col("total")), 1).otherwise(0)).cast("int")
        takes = written(sums.select(F.concat_ws("/", "block", "source").alias(OWN + "place"), takes.alias(OWN + "takes")).filter(F.col(OWN + "takes") > 0), "takes")
    names = {c: OWN + c for c in ("weight", "n_blocks", "wanted", "epochs")}
    sources = plan.select(F.col("source").alias(OWN + "source"), *[F.col(c).alias(o) for c, o in names.items()])
    tagged = own.join(F.broadcast(sources), OWN + "source") if plan.limit(10_001).count() <= 10_000 else salted_join(own, sources, OWN + "source", F.col(OWN + "key"))
    tagged = tagged.withColumn(OWN + "block", F.pmod(OWN + "key", OWN + "n_blocks")).withColumn(OWN + "place", F.concat_ws("/", OWN + "block", OWN + "source"))
    hit = tagged.join(small(takes), OWN + "place").withColumn(OWN + "epoch", F.explode(F.sequence(F.lit(0), F.col(OWN + "takes") - 1)))
    slot = F.xxhash64(OWN + "source", OWN + "block", OWN + "epoch", F.lit(seed))
    return hit.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(OWN + c) for c in ("tokens", "weight", "wanted", "epochs", "block", "epoch", "key")], slot.alias(OWN + "slot"))


def mixed(docs: DataFrame, **kind) -> DataFrame:
    """The copies taken, with the documents' own columns, in the permuted order of their blocks: partitions are ranges of
    slots and rows are sorted in them, so that files written from it hold the order by name and row."""
    rows = placed(docs, **kind)
    order = [OWN + "slot", OWN + "key"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in docs.columns])
