"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the item windows (ten words, or a whole shorter item). For each pattern length a shift table tells, for
the block of the last two words under the search window, how far the window may move; where it may not move, the block
picks the bucket of patterns that are compared directly. Items are searched in passes of a bounded size, so what a pass
broadcasts never grows with the benchmark; passes are narrow and follow each other without a shuffle, a few of them in
one plan, so that a task has as many Python workers and tables at most.

Defined cases: a null text has no words and no hits; an item without words has no window; repeated items count once by
id; an item with a null id counts for spans and is left out of the item list; null texts are left out; an empty
benchmark hits nothing; texts are searched whole; other columns stay.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugework.llm.common import OWN, claim, written

WINDOW = 10
#: Bytes of benchmark text in one pass, and passes that run in one plan before their result is written.
PASS_BYTES, CHAINED = 8_000_000, 4

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


class Matcher:
    """Shift tables and buckets of one pass, one pair for each pattern length."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> None:
        patterns: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            w = words_of(text)
            n = min(len(w), window)
            for i in range(len(w) - n + 1 if n else 0):
                known = patterns[n][tuple(w[i : i + n])]
                if item is not None:
                    known.add(item)
        self.tables = [(n, *self._build(n, p)) for n, p in sorted(patterns.items())]

    @staticmethod
    def _build(n: int, patterns: dict[tuple[bytes, ...], set[str]]):
        size = min(2, n)
        shift: dict[tuple[bytes, ...], int] = {}
        bucket: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = defaultdict(list)
        for p in patterns:
            for end in range(size, n + 1):
                block = p[end - size : end]
                shift[block] = min(shift.get(block, n), n - end)
            bucket[p[n - size :]].append(p)
        return size, shift, {k: {p: patterns[p] for p in v} for k, v in bucket.items()}

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (start, end) of all occurrences, and the items they belong to."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for n, size, shift, bucket in self.tables:
            end, far, last = n, n - size + 1, len(words)
            while end <= last:
                block = tuple(words[end - size : end])
                move = shift.get(block, far)
                if not move:
                    found = bucket[block].get(tuple(words[end - n : end]))
                    if found is not None:
                        spans.append((end - n, end))
                        items |= found
                    move = 1
                end += move
        return spans, items


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS, _ITEMS = pa.list_(pa.int64()), pa.list_(pa.string())


def _pass(batches: Iterator[pa.RecordBatch], items: list[tuple[str | None, bytes]], window: int) -> Iterator[pa.RecordBatch]:
    claim("decontam")
    matcher = Matcher(items, window)
    for batch in batches:
        col = dict(zip(batch.schema.names, batch.columns))
        n, spans, hits = [], [], []
        for text, old, known in zip(col[OWN + "text"].to_pylist(), col[OWN + "spans"].to_pylist(), col[OWN + "items"].to_pylist()):
            words = words_of(text)
            got, found = matcher.search(words)
            flat = iter(old)
            n.append(len(words))
            spans.append([x for s in _union(got + list(zip(flat, flat))) for x in s])
            hits.append(sorted(found | set(known)))
        col |= {OWN + "n_words": pa.array(n, pa.int64()), OWN + "spans": pa.array(spans, _SPANS), OWN + "items": pa.array(hits, _ITEMS)}
        yield pa.RecordBatch.from_arrays(list(col.values()), names=list(col))


def _passes(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in lists of about limit bytes; the driver holds one at a time."""
    now, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).dropna(subset=["text"]).toLocalIterator():
        now.append((r[0], bytes(r[1])))
        size += len(r[1])
        if size >= limit:
            yield now
            now, size = [], 0
    if now:
        yield now


def searched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs with OWN n_words, spans (flat list of start, end in words) and items (ids with an occurring window)."""
    own = docs.select("*", F.col("text").cast("binary").alias(OWN + "text"), F.lit(0).cast("bigint").alias(OWN + "n_words"), F.array().cast("array<bigint>").alias(OWN + "spans"), F.array().cast("array<string>").alias(OWN + "items"))
    schema, any_pass = own.schema, False
    for i, items in enumerate(_passes(benchmark, pass_bytes)):
        if i and i % CHAINED == 0:
            own = written(own, "passes")
        own, any_pass = own.mapInArrow(lambda it, items=items: _pass(it, items, window), schema), True
    if not any_pass:
        own = own.mapInArrow(lambda it: _pass(it, [], window), schema)
    return own.drop(OWN + "text")


def n_hit():
    s = F.col(OWN + "spans")
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(s), F.lit(1)) - 1), F.lit(0).cast("bigint"), lambda a, i: a + F.when(i % 2 == 1, F.coalesce(F.get(s, i), F.lit(0))).otherwise(-F.coalesce(F.get(s, i), F.lit(0))))


def filtered(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents in which no benchmark window occurs, with their own columns."""
    return searched(docs, benchmark).filter(n_hit() == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
