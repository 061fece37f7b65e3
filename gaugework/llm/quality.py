"""Quality rules by suffix-array repetition.

The words of many documents are put into one integer sequence, each document closed by a separator of its own, and its
suffix array is built by prefix doubling, of which every round sorts only the suffixes that are not yet told apart.
Neighbours in the array whose longest common prefix reaches a length are one LCP interval: a repeated substring of
that document (separators keep substrings within a document). The union of the intervals' spans gives the covered
fraction, and an interval at the longer limit gives the longest-repeat rule.

Defined cases: a null text has no words and is rejected by the base rule; an empty table gives an empty result;
repeated rows each get their own result; texts of any length are read whole; extra columns are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugework.llm.common import OWN, claim

#: Production limits. A repeat counts from MIN_REPEAT words; a document may be covered by repeats up to MAX_COVERED of
#: its words, and no single repeat may reach LONG_REPEAT words.
MIN_REPEAT, MAX_COVERED, LONG_REPEAT = 8, 0.3, 64
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Words whose suffix array is built at once; a longer document is a block of its own.
BLOCK_WORDS = 400_000

_SYMBOLS = bytes(range(256)).translate(None, b"#*$%&|<>")
_RESULT = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("covered_words", pa.int64()), ("long_repeats", pa.int64())]


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def repeats(ids: np.ndarray, bounds: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each length, flags of the positions at which a substring of that length starts that its document holds
    twice or more.

    ids: words as integers; bounds: first position of each document, and the end. After the round for h, suffixes with a
    common prefix of h words share a rank: the classes of two or more are the LCP intervals of the suffix array at h.
    """
    n, n_docs = len(ids), len(bounds) - 1
    owner = np.repeat(np.arange(n_docs), np.diff(bounds))
    left = bounds[1:][owner] - np.arange(n)
    flags = {h: np.zeros(n, dtype=bool) for h in lengths}
    if not n:
        return flags
    rank = _dense(ids * np.int64(n_docs) + owner)
    _flag(flags, 1, np.arange(n), rank)
    twice = _twice(rank)
    rank[~twice] = n + np.flatnonzero(~twice)
    alive, h = np.flatnonzero(twice), 1
    while len(alive) and h < max(lengths):
        for t in (t for t in lengths if h < t < 2 * h):
            step = alive[left[alive] >= t]
            _flag(flags, t, step, _dense(rank[step] * np.int64(2 * n) + rank[step + t - h]))
        step = alive[left[alive] >= 2 * h]
        pair = _dense(rank[step] * np.int64(2 * n) + rank[step + h])
        h *= 2
        _flag(flags, h, step, pair)
        twice = _twice(pair)
        rank[alive] = n + alive  # told apart from all others
        rank[step[twice]] = pair[twice]
        alive = step[twice]
    return flags


def _twice(keys: np.ndarray) -> np.ndarray:
    return np.bincount(keys)[keys] > 1 if len(keys) else np.zeros(0, dtype=bool)


def _flag(flags: dict[int, np.ndarray], h: int, at: np.ndarray, keys: np.ndarray) -> None:
    if h in flags and len(at):
        flags[h][at[_twice(keys)]] = True


def _covered(flag: np.ndarray, h: int) -> np.ndarray:
    """Positions inside any flagged window of h positions (windows never leave their document)."""
    edge = np.zeros(len(flag) + 1, dtype=np.int64)
    at = np.flatnonzero(flag)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + h, -1)
    return np.cumsum(edge[:-1]) > 0


def _lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    if b"\n" not in text:
        return 0
    seen = Counter(text.split(b"\n"))
    return sum(n - 1 for line, n in seen.items() if n > 1 and line.strip(b" \t\n\r\x0b\x0c"))


def measure(texts: list[bytes], min_repeat: int = MIN_REPEAT, long_repeat: int = LONG_REPEAT, *, block_words: int = BLOCK_WORDS) -> list[list[int]]:
    """A list for each column of _RESULT, over whole texts."""
    out: list[list[int]] = [[] for _ in _RESULT]
    block, size = [], 0

    def close() -> None:
        nonlocal block, size
        counts = np.array([len(w) for w in block], dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(x, len(known)) for w in block for x in w), dtype=np.int64, count=int(bounds[-1]))
        flags = repeats(ids, bounds, (3, min_repeat, long_repeat))
        for h, col in ((3, 4), (min_repeat, 5), (long_repeat, 6)):
            total = np.concatenate([[0], np.cumsum(_covered(flags[h], h))])
            out[col] += (total[bounds[1:]] - total[bounds[:-1]]).tolist()
        block, size = [], 0

    for text in texts:
        words = text.split()
        if block and size + len(words) > block_words:
            close()
        block.append(words)
        size += len(words)
        out[0].append(len(words))
        if text.isascii():
            out[1].append(sum(map(len, words)))
        else:
            joined = b"".join(words)
            out[1].append(len(joined.decode()))
        out[2].append(len(text.translate(None, _SYMBOLS)))
        out[3].append(_lines(text))
    if block:
        close()
    return out


def _stream(batches: Iterator[pa.RecordBatch], min_repeat: int, long_repeat: int) -> Iterator[pa.RecordBatch]:
    claim("quality")
    for batch in batches:
        texts = [x or b"" for x in batch.column(batch.schema.get_field_index(OWN + "text")).to_pylist()]
        keep = [i for i, f in enumerate(batch.schema) if f.name != OWN + "text"]
        found = measure(texts, min_repeat, long_repeat)
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in keep] + [pa.array(v, type=t) for v, (_, t) in zip(found, _RESULT)],
            names=[batch.schema.field(i).name for i in keep] + [OWN + n for n, _ in _RESULT],
        )


def measured(docs: DataFrame, min_repeat: int = MIN_REPEAT, long_repeat: int = LONG_REPEAT) -> DataFrame:
    """docs with the measures of _RESULT as columns prefixed OWN; one narrow pass, no shuffle."""
    own = docs.withColumn(OWN + "text", F.col("text").cast("binary"))
    kept = [f for f in own.schema.fields if f.name != OWN + "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{OWN}{n} bigint" for n, _ in _RESULT])
    return own.mapInArrow(lambda it: _stream(it, min_repeat, long_repeat), schema)


def base_failed():
    n, r = F.col(OWN + "n_words"), F.col(OWN + "n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def kept(max_covered: float = MAX_COVERED):
    """Not failed by the base rules, covered by repeats up to the limit, and without a repeat as long as the limit."""
    n = F.col(OWN + "n_words")
    return ~base_failed() & (F.col(OWN + "covered_words") <= F.lit(max_covered) * n) & (F.col(OWN + "long_repeats") == 0)


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns and nothing else."""
    return measured(docs).filter(kept()).select(*[F.col(f"`{c}`") for c in docs.columns])
