"""Near-duplicate detection by Order MinHash.

Each different text is a sequence of five-word shingles labelled with their occurrence number. A sketch takes the minima
of a text under one random order and keeps them in text order; its hash is the band key. Texts that share a band key are
candidates, verified by a banded alignment of their shingle sequences: matches off the band are dropped and the longest
increasing chain of the rest is the common subsequence k. Similarity is k / (n + m - k), of which one minus is a metric.
Classes are the components of the links.

No bucket is expanded into pairs. Every bucket has a leader, its least text. First the members of a few bands are held
against their leaders, then those of more bands, and each time only members that are not in their leader's class yet: a
group of copies is one class after about one pair a member. Then a bucket's largest class is settled by name, and the
members of its other classes, the seekers, go on: in each round they are held against further members of other classes,
a window of the bucket that grows fourfold, until they join the largest class or the bucket is used up. A pair in
different classes has a seeker at least, so no candidate link is lost, and members of the largest class cost nothing.
Nor do copies with many edits meet their whole group: shingles that no other of these texts holds can never be common,
nor can those whose bit the other text's bitmap lacks, which bounds a pair's similarity before anything is aligned.

A sketch holds five minima, or two for texts of under ten shingles, which could not share five after one edit; texts
near the limit have both. With similarity s a sketch is shared with a chance near s^5, so at exactly 0.8 one of BANDS
sketches is shared but for a chance near 1e-4 (up to 3e-3 for texts of ten shingles).

Defined cases: null texts and texts without words are each a class of their own if their text is the same (all null texts
are one class, all empty ones another); shorter texts than five words are one shingle; repeated rows are copies; doc_id
keeps its type, null ones count last and a class without any other id has a null class_id; an empty table gives no rows;
texts are read whole; copies of a text within a task are sketched once; other columns are unused.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from gaugework.llm.common import BROADCAST_ROWS, OWN, Scratch, claim, salted_join, small, written

SHINGLE, SIMILARITY, BANDS = 5, 0.8, 24
#: Bands whose members meet their leaders in the first two rounds.
STEPS = ((0, 2), (2, BANDS))
#: The first window of members that seekers meet, and how it grows.
WINDOW, GROWTH = 4, 4
#: Minima a sketch holds, by least number of shingles. Texts near the limit are sketched on both sides of it.
MINIMA = ((0, 2), (10, 5))
#: Words of 64 bits in a text's bitmap.
BITMAP = 8
_BITS = [f"q{j}" for j in range(BITMAP)]
#: Bytes of the words of texts that are broadcast to be tested, and rows of seekers (under 256 bytes) that are.
BROADCAST_BYTES, SEEKERS = 8_000_000, 50_000
#: Texts whose sketch a task remembers, so that their copies need none.
REMEMBERED = 20_000

_RNG = np.random.Generator(np.random.PCG64(20240607))
_A = _RNG.integers(1, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS, dtype=np.uint64)
_C = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, (text or "").lower().encode().split()), dtype=np.uint32)


def shingles(words: np.ndarray) -> np.ndarray:
    """Labelled shingles in text order: distinct 64-bit values."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    w = words.astype(np.uint64)
    k = min(SHINGLE, len(w))
    x = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for i in range(k):
        x = _mix(x + w[i : len(w) - k + 1 + i] * _C[i])
    order = np.argsort(x, kind="stable")
    s = x[order]
    first = np.r_[True, s[1:] != s[:-1]]
    if not first.all():
        at = np.arange(len(s))
        x[order] += (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64) * _C[9]
    return x


def sketch(x: np.ndarray) -> list[int]:
    """Band keys, BANDS for each sketch size; none for a text without words."""
    n, keys = len(x), []
    if not n:
        return keys
    sizes = [size for i, (least, size) in enumerate(MINIMA) if n / SIMILARITY >= least and (i + 1 == len(MINIMA) or n * SIMILARITY < MINIMA[i + 1][0])]
    step = max(1, 2_000_000 // n)
    parts: dict[int, list[int]] = {size: [] for size in sizes}
    for lo in range(0, BANDS, step):
        h = x[None, :] * _A[lo : lo + step, None] + _B[lo : lo + step, None]
        h ^= h >> np.uint64(32)
        for size in sizes:
            k = min(size, n)
            at = np.sort(np.argpartition(h, k - 1, axis=1)[:, :k], axis=1)
            key = _mix((x[at] * _C[:k][None, :]).sum(axis=1, dtype=np.uint64) + np.uint64(k))
            parts[size] += (_mix(key + np.arange(lo, lo + len(key)).astype(np.uint64) * _C[10])).view(np.int64).tolist()
    return [k for p in parts.values() for k in p]


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """One minus the similarity; a lower bound above the limit where the common shingles alone rule a link out."""
    n, m = len(a), len(b)
    common, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    k, total = len(common), n + m
    if k < SIMILARITY * (total - k):
        return 1 - k / (total - k)
    band = total - 2 * SIMILARITY * total / (1 + SIMILARITY)
    near = np.abs(at_a - at_b) <= band
    way = at_b[near][np.argsort(at_a[near])]
    if len(way) and not (np.diff(way) > 0).all():
        tails: list[int] = []
        for v in way.tolist():
            i = bisect_left(tails, v)
            tails[i : i + 1] = [v]
        k = len(tails)
    else:
        k = len(way)
    return 1 - k / (total - k)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("neardup")
    known: dict[bytes, tuple[int, list[int]]] = {}
    for b in batches:
        got = []
        for tk, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            one = known.get(tk)
            if one is None:
                x = shingles(word_hashes(t))
                one = len(x), sketch(x)
                if len(known) >= REMEMBERED:
                    known.clear()
                known[tk] = one
            got.append(one)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], names=["tk", "doc_id", "n", "keys"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([word_hashes(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["tk", "w"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("neardup")
    last, lead = None, None
    for b in batches:
        out = []
        for wa, wb in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            if wa != last:
                last, lead = wa, shingles(np.frombuffer(wa, dtype=np.uint32))
            out.append(distance(lead, shingles(np.frombuffer(wb, dtype=np.uint32))))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["a", "b", "d"])


def _few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def _named(df: DataFrame, key: str, names: DataFrame, few: bool) -> DataFrame:
    """df with column key replaced by c where names (v, c) lists it as v. few: names may be broadcast."""
    names = names.select(F.col("v").alias(key), F.col("c").alias(OWN + "c"))
    return df.join(F.broadcast(names) if few else names, key, "left").withColumn(key, F.coalesce(OWN + "c", key)).drop(OWN + "c")


def merged(links: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame | None:
    """(v, c): c is the least member of v's component, itself not listed. labels: such a table, or None; links: a, b, further
    links between the components' least members, so that what is known is not dealt out again. In each round every name
    with a lesser neighbour goes to its least one, names on the way to another go to the way's end, and the links are
    renamed; those within a component go. A round shuffles the links left once, as partial minima, and nothing is gathered
    on the driver."""
    edges = scratch.written(links.filter("a != b"), "edges")
    first = labels
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("c")).union(edges.select("b", "a"))
        to = scratch.written(both.groupBy("v").agg(F.min("c").alias("c")).filter("c < v"), "names")
        few = _few(to)
        while True:
            on = scratch.written(_named(to.select("v", "c", F.col("c").alias("was")), "c", to, few).select("v", "c", (F.col("c") != F.col("was")).alias("moved")), "names")
            scratch.drop(to)
            to = on
            if on.filter("moved").isEmpty():
                break
        names = to.select("v", "c")
        now = scratch.written(names if labels is None else _named(labels, "c", names, few).select("v", "c").unionByName(names), "labels")
        left = scratch.written(_named(_named(edges, "a", names, few), "b", names, few).filter("a != b").select("a", "b"), "edges")
        scratch.drop(to, edges, *([] if labels is first else [labels]))
        labels, edges = now, left
    scratch.drop(edges)
    return labels


class _Linker:
    """Tests candidate pairs, keeps the classes they make and the pairs that failed."""

    def __init__(self, words: DataFrame, scratch: Scratch) -> None:
        self.words, self.scratch, self.labels, self.failed, self.few = words, scratch, None, None, True

    def class_of(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """df with the class of the text in column key; a text without links is its own."""
        df = df.withColumn(name, F.col(key))
        return df if self.labels is None else _named(df, name, self.labels, self.few)

    def test(self, pairs: DataFrame) -> None:
        """pairs: a, b, of texts in different classes. Rows of one a follow each other, so that its shingles are made once."""
        pairs = pairs.distinct()
        if self.failed is not None:
            pairs = pairs.join(small(self.failed), ["a", "b"], "left_anti")
        pairs = self.scratch.written(pairs, "pairs")
        n = pairs.count()
        if not n:
            return self.scratch.drop(pairs)
        used = pairs.select(F.col("a").alias("tk")).union(pairs.select("b"))
        few = 2 * n <= BROADCAST_ROWS
        words = self.words.join(F.broadcast(used) if few else small(used.distinct()), "tk", "left_semi")
        if few and words.agg(F.sum(F.octet_length("w"))).first()[0] <= BROADCAST_BYTES:
            words = F.broadcast(words)
        both = pairs.join(words.toDF("b", "wb"), "b").join(words.toDF("a", "wa"), "a").select("a", "b", "wa", "wb").sortWithinPartitions("a")
        tested = self.scratch.written(both.mapInArrow(_verify, "a binary, b binary, d double"), "tested")
        limit = 1 - SIMILARITY + 1e-12
        good, bad = tested.filter(F.col("d") <= limit), tested.filter(F.col("d") > limit).select("a", "b")
        links = self.class_of(self.class_of(good, "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        old = [t for t in (self.failed, self.labels) if t is not None]
        self.labels = merged(links, self.labels, self.scratch)
        self.few = self.labels is None or _few(self.labels)
        self.failed = self.scratch.written(bad if self.failed is None else self.failed.union(bad), "failed")
        self.scratch.drop(pairs, tested, *[t for t in old if t is not self.labels])


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _fits(n: str, m: str, shared=None):
    """Whether lengths n and m allow a link, or shared shingles where a better bound of them is known."""
    k = F.least(n, m) if shared is None else shared
    return k >= SIMILARITY * (F.col(n) + F.col(m) - k) - 1e-6


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit for each shingle, in BITMAP words of 64 bits."""
    for b in batches:
        got = np.zeros((b.num_rows, BITMAP), dtype=np.uint64)
        for i, w in enumerate(b.column(1).to_pylist()):
            x = _mix(shingles(np.frombuffer(w, dtype=np.uint32)))
            np.bitwise_or.at(got[i], (x >> np.uint64(40)) % np.uint64(BITMAP), np.uint64(1) << (x >> np.uint64(8)) % np.uint64(64))
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(got[:, j]).view(np.int64)) for j in range(BITMAP)]], names=["tk", *_BITS])


def _shared(other: str):
    """Upper bound of the common shingles of a row (top, bits) and the one whose columns start with other."""
    lacks = lambda a, b: sum((F.bit_count(F.col(f"{a}{q}").bitwiseAND(F.bitwise_not(F.col(f"{b}{q}")))) for q in _BITS), F.lit(0))
    return F.least(F.col("top"), F.col(other + "top"), F.col("n") - lacks("", other), F.col(other + "n") - lacks(other, ""))


def _shingle_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [shingles(np.frombuffer(w, dtype=np.uint32)).view(np.int64) for w in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.int64()))], names=["h", "g", "s"])


def _common(rows: DataFrame, words: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (tk, n, ...) with the bitmap and with top, the number of a text's shingles that another text of rows holds too:
    no link can have more common ones. Texts that cannot link at all go."""
    h, g = F.xxhash64("tk"), F.xxhash64("tk", F.lit(1))
    lists = words.join(small(rows.select("tk").distinct()), "tk", "left_semi").select(h.alias("h"), g.alias("g"), "w").mapInArrow(_shingle_lists, "h bigint, g bigint, s array<bigint>")
    alone = lists.select("h", "g", F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("texts"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g")).filter("texts = 1")
    own = scratch.written(alone.groupBy("h", "g").agg(F.count("*").alias("own")), "own")
    out = rows.withColumns({"h": h, "g": g}).join(small(own), ["h", "g"], "left").withColumn("top", F.col("n") - F.coalesce("own", F.lit(0)))
    out = out.filter(F.col("top") >= SIMILARITY * F.col("n") - 1e-6).drop("h", "g", "own")
    bits = words.join(small(out.select("tk").distinct()), "tk", "left_semi").mapInArrow(_bitmaps, "tk binary, " + ", ".join(f"{q} bigint" for q in _BITS))
    return out.join(bits, "tk")


def text_key():
    """128 bits of a text; null texts share a key that no text has."""
    return F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), F.lit(b"null"))


def classes(docs: DataFrame) -> DataFrame:
    """(tk, doc_id, root): for each different text its key, its least doc_id and its component's root text."""
    own = docs.select(text_key().alias("tk"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    with Scratch(docs.sparkSession) as scratch:
        sk = own.mapInArrow(_sketches, f"tk binary, doc_id {kind}, n bigint, keys array<bigint>")
        reps = scratch.written(sk.groupBy("tk").agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys")), "reps")
        rows = reps.select("tk", "n", F.posexplode("keys").alias("band", "key")).withColumn("band", (F.col("band") % BANDS).cast("tinyint"))
        leads = rows.groupBy("key").agg(F.min(F.struct("tk", "n")).alias("l"), F.count("*").alias("size")).filter("size > 1")
        state = scratch.written(rows.join(leads.select("key", "size", F.col("l.tk").alias("a"), F.col("l.n").alias("an")), "key"), "buckets")
        wanted = state.select("tk").distinct()
        texts = own.select("tk", "text").join(small(wanted), "tk", "left_semi").groupBy("tk").agg(F.any_value("text").alias("text"))
        words = scratch.written(texts.mapInArrow(_hashes, "tk binary, w binary"), "words")
        link = _Linker(words, scratch)
        for lo, hi in STEPS:
            met = state.filter(F.col("band").between(lo, hi - 1) & (F.col("tk") != F.col("a")) & _fits("n", "an")).select("a", "tk").distinct()
            link.test(link.class_of(link.class_of(met, "a", "ca"), "tk", "cb").filter("ca != cb").select(*_pair("a", "tk")))
        sizes = link.class_of(state.select("key", "tk"), "tk", "c").groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "c")).alias("most"), F.count("*").alias("k")).filter("k > 1")
        # the least text of a bucket's largest class stands for that class from here on, however classes grow
        left = scratch.written(state.select("key", "tk", "n", "size").join(sizes.select("key", F.col("most.c").alias("main")), "key"), "mixed")
        scratch.drop(state)
        left = scratch.written(_common(left, words, scratch), "mixed")
        lo, hi = 0, WINDOW
        place = F.shiftrightunsigned(F.xxhash64("tk"), 11) / F.lit(float(2**53)) * F.col("size")
        while True:
            named = link.class_of(link.class_of(left, "tk", "c"), "main", "cm")
            named = scratch.written(named.withColumn("seeks", F.col("c") != F.col("cm")), "named")
            seekers = named.filter("seeks").select("key", *[F.col(x).alias("s_" + x) for x in ("tk", "n", "top", "c", *_BITS)])
            on = scratch.written(seekers.select("key").distinct(), "on")
            if on.isEmpty():
                break
            on = small(on)
            goals = named.filter((place >= lo) & (place < hi)).join(on, "key", "left_semi")
            if _few(seekers, SEEKERS):
                seekers = F.broadcast(seekers)
            link.test(goals.join(seekers, "key").filter("c != s_c").filter(_fits("n", "s_n", _shared("s_"))).select(*_pair("s_tk", "tk")))
            after = scratch.written(named.select("key", "tk", "n", "top", "size", "main", *_BITS).filter(F.col("size") > hi).join(on, "key", "left_semi"), "mixed")
            scratch.drop(left, named)
            left, lo, hi = after, hi, hi + (hi - lo) * GROWTH
        return written(link.class_of(reps.select("tk", "doc_id"), "tk", "root"), "classes")


def assigned(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, is_kept) for each row: class_id is the least doc_id of the class."""
    cls = classes(docs)
    ids = cls.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    by_text = salted_join(cls.select("tk", "root"), ids, "root", F.col("tk")).select("tk", "class_id")
    own = docs.select("doc_id", text_key().alias("tk"))
    return salted_join(own, by_text, "tk", F.col("doc_id")).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_kept"))


def row_key():
    """128 bits of a row's text and doc_id."""
    of_id = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null"))
    return F.unhex(F.md5(F.concat(F.hex(text_key()), F.lit(":"), of_id).cast("binary")))


def filtered(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least doc_id (and the least text), with its own columns. Texts are not
    shuffled while the rows that go, as keys, are few enough to be broadcast; of repeated rows any one stays."""
    cls = classes(docs)
    best = cls.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("k")).select(F.col("k.doc_id").alias("doc_id"), F.col("k.tk").alias(OWN + "tk"))
    of_id = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null"))
    best = best.select(F.unhex(F.md5(F.concat(F.hex(OWN + "tk"), F.lit(":"), of_id).cast("binary"))).alias(OWN + "row"), F.lit(True).alias("best"))
    rows = docs.select(row_key().alias(OWN + "row")).groupBy(OWN + "row").agg(F.count("*").alias("rows")).join(best, OWN + "row", "left")
    rows = written(rows.filter("best IS NULL OR rows > 1").withColumn("best", F.col("best").isNotNull()), "gone")
    own = docs.withColumn(OWN + "row", row_key())
    names = [F.col(f"`{c}`") for c in docs.columns]
    out = own.join(small(rows.select(OWN + "row")), OWN + "row", "left_anti").select(*names)
    again = rows.filter("best").select(OWN + "row")
    if again.isEmpty():
        return out
    many = own.join(small(again), OWN + "row", "left_semi").withColumn(OWN + "n", F.row_number().over(W.partitionBy(OWN + "row").orderBy(OWN + "row")))
    return out.unionByName(many.filter(F.col(OWN + "n") == 1).select(*names))
