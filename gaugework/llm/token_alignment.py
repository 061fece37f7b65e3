"""Cross-tokenizer alignment by a dictionary of groups.

Both tokenizers cut a text at each space between two characters that are no white space, so a text is a sequence of
units whose alignment does not depend on their neighbours. A worker aligns each distinct unit once (in bounded tables)
and interns its groups: the tokens of A and of B between two neighbouring byte offsets at which tokens of both end. A
text then is a bag of interned groups, found by numpy for many texts at once.

The corpus-wide dictionary of distinct groups, with their frequencies, is a Spark aggregation. Links are expanded once
a distinct group and multiplied by its frequency; their sums give the count of each id pair, the highest count of each
B id, and for each group its links, best links and sum of counts. These results are joined back to the documents' bags
by group key: the most frequent groups, at most HEAD_ROWS of them and HEAD_BYTES of keys, are broadcast, and what is
left of the bags, rare groups, is shuffled.

Special tokens' strings in texts are plain text. Defined cases: a null or empty text has no tokens, and no more has one
whose joined token bytes differ from the text behind a space: its counts are zero and its column is the empty string;
null and repeated doc_ids and repeated rows keep a row each; an empty table gives no rows; texts of any length are
encoded whole; other columns are unused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gaugework.llm.common import Scratch, claim, small, written
from gaugework.llm.token_output import Encoder, slices

#: Groups that are broadcast at most, and the bytes of their keys.
HEAD_ROWS, HEAD_BYTES = 500_000, 16_000_000
#: Memory of a worker's tables of units and groups, about; they start anew beyond it. Bytes of an entry besides its text.
CACHE_BYTES, ENTRY = 150_000_000, 200
#: Units that are aligned together.
LOT = 20_000

#: Where a unit begins: a space behind a character other than a space and before one other than white space.
_CUT = re.compile(r"(?<=[^ ])(?= \S)")
_ODD = r"^(?:$|[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others in
    order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Aligner:
    def __init__(self, a_path: str, b_path: str, cache_bytes: int = CACHE_BYTES) -> None:
        import sentencepiece

        self.a = Encoder(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        self.a_bytes = [self._a_token(self.a.tok.id_to_token(i), alphabet) for i in range(self.a.tok.get_vocab_size())]
        self.b_bytes = [self._b_token(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.limit = cache_bytes
        self.clear()

    @staticmethod
    def _a_token(token: str, alphabet: dict[str, int]) -> bytes:
        return bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()

    def _b_token(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.good = np.zeros(0, dtype=bool)  # by entry: token bytes equal the unit
        self.counts = np.zeros((0, 4), dtype=np.int64)  # by entry: tokens of A, of B, groups, first group
        self.groups = np.zeros(0, dtype=np.int32)
        self.names: list[str] = []  # of groups
        self.single: dict[int, int] = {}  # groups of one token each, by both ids as one number
        self.longer: dict[tuple[bytes, bytes], int] = {}
        self.held = 0

    def _new(self, a: np.ndarray, b: np.ndarray) -> int:
        self.names.append(",".join(map(str, a.tolist())) + "|" + ",".join(map(str, b.tolist())))
        self.held += 2 * len(self.names[-1]) + ENTRY
        return len(self.names) - 1

    def _interned(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
        """The numbers of the groups a[a_ends[i-1]:a_ends[i]], b[b_ends[i-1]:b_ends[i]]."""
        a_from, b_from = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
        out = np.empty(len(a_ends), dtype=np.int32)
        one = (a_ends - a_from == 1) & (b_ends - b_from == 1)
        pairs, place = np.unique(a[a_from[one]].astype(np.int64) << 32 | b[b_from[one]], return_inverse=True)
        for k in [k for k in pairs.tolist() if k not in self.single]:
            self.single[k] = self._new(np.array([k >> 32]), np.array([k & 0xFFFFFFFF]))
        out[one] = np.fromiter(map(self.single.__getitem__, pairs.tolist()), dtype=np.int32, count=len(pairs))[place]
        for i in np.flatnonzero(~one).tolist():
            x, y = a[a_from[i] : a_ends[i]], b[b_from[i] : b_ends[i]]
            k = (x.tobytes(), y.tobytes())
            if k not in self.longer:
                self.longer[k] = self._new(x, y)
            out[i] = self.longer[k]
        return out

    def learn(self, units: list[str]) -> None:
        """Align units, many at a time: their tokens are one sequence, in which the ends of units are ends of groups."""
        for lo in range(0, len(units), LOT):
            some = units[lo : lo + LOT]
            behind = [u for u in some if u[1:].split() == [u[1:]]]
            ids = dict(zip(behind, self.a.behind_space([u[1:] for u in behind])))
            rest = [u for u in some if u not in ids]
            ids.update(zip(rest, self.a.cut(rest)))
            self.a.known.clear()
            a_lists, b_lists = [ids[u] for u in some], self.b.encode([u[1:] for u in some], num_threads=1)
            raw = [u.encode() for u in some]
            good = np.ones(len(some), dtype=bool)
            a, b, same = self._tokens(a_lists, b_lists, raw)
            if not same:
                for i, (x, y, r) in enumerate(zip(a_lists, b_lists, raw)):
                    good[i] = self._tokens([x], [y], [r])[2]
                    if not good[i]:
                        a_lists[i], b_lists[i], raw[i] = b"", [], b""
                a, b, _ = self._tokens(a_lists, b_lists, raw)
            a_to, b_to = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
            both = np.intersect1d(a_to, b_to, assume_unique=True)
            found = self._interned(a, b, np.searchsorted(a_to, both) + 1, np.searchsorted(b_to, both) + 1)
            ends = np.searchsorted(both, np.cumsum(list(map(len, raw))), side="right")
            first = np.concatenate([[0], ends[:-1]])
            n_a = np.fromiter(map(len, a_lists), dtype=np.int64, count=len(some)) // self.a.kind.itemsize
            rows = np.stack([n_a, np.fromiter(map(len, b_lists), dtype=np.int64, count=len(some)), ends - first, len(self.groups) + first], axis=1)
            self.known.update(zip(some, range(len(self.good), len(self.good) + len(some))))
            self.good, self.groups, self.counts = np.concatenate([self.good, good]), np.concatenate([self.groups, found]), np.concatenate([self.counts, rows])
            self.held += sum(map(len, raw)) + 4 * len(found) + ENTRY * len(some)

    def _tokens(self, a_lists: list[bytes], b_lists: list[list[int]], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, bool]:
        """(ids of A, ids of B, whether the bytes of each list's tokens equal its unit)."""
        a = np.frombuffer(b"".join(a_lists), dtype=self.a.kind)
        b = np.fromiter(chain.from_iterable(b_lists), dtype=np.int32)
        sizes, whole = np.cumsum([len(r) for r in raw]), b"".join(raw)
        same = True
        for ids, table, lengths, counts in ((a, self.a_bytes, self.a_sizes, [len(x) // self.a.kind.itemsize for x in a_lists]), (b, self.b_bytes, self.b_sizes, [len(y) for y in b_lists])):
            ends = np.concatenate([[0], np.cumsum(lengths[ids])])[np.cumsum(counts)]
            same = same and np.array_equal(ends, sizes) and b"".join(map(table.__getitem__, ids.tolist())) == whole
        return a, b, same

    def entries(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(entries of all texts, offsets of each): the units of a space and the text."""
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary
        odd = pc.match_substring_regex(words, _ODD).to_numpy(zero_copy_only=False)
        rows = np.unique(np.searchsorted(offsets, np.flatnonzero(odd[codes]), side="right") - 1).tolist()
        used = np.zeros(len(words), dtype=bool)
        plain = np.ones(len(texts), dtype=bool)
        plain[rows] = False
        used[codes[np.repeat(plain, np.diff(offsets))]] = True
        at = np.flatnonzero(used)
        units = [" " + w for w in words.take(pa.array(at)).to_pylist()]
        whole = {i: _CUT.split(" " + texts[i].as_py()) for i in rows}
        more = list(dict.fromkeys(u for us in whole.values() for u in us))
        self.learn([u for u in dict.fromkeys(units + more) if u not in self.known])
        entry = np.zeros(len(words), dtype=np.int64)
        entry[at] = [self.known[u] for u in units]
        found = entry[codes]
        if not rows:
            return found, offsets
        pieces, sizes = [], np.diff(offsets)
        done = 0
        for i in rows:
            pieces += [found[offsets[done] : offsets[i]], np.array([self.known[u] for u in whole[i]], dtype=np.int64)]
            sizes[i], done = len(whole[i]), i + 1
        pieces.append(found[offsets[done] :])
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum(sizes)])

    def bags(self, texts: pa.Array) -> tuple[list[np.ndarray], list[str], pa.Array, pa.Array]:
        """([tokens of A, of B, groups], digest of the groups, distinct groups, how often each) of each text."""
        if self.held > self.limit:
            self.clear()
        codes, offsets = self.entries(texts)
        n = len(texts)
        fine = np.diff(np.concatenate([[0], np.cumsum(~self.good[codes])])[offsets]) == 0
        fine &= pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        owner = np.repeat(np.arange(n), np.diff(offsets))
        keep = fine[owner]
        own = self.counts[codes]
        sums = [np.bincount(owner, weights=own[:, k] * keep, minlength=n).astype(np.int64) for k in range(3)]
        count, start = own[keep, 2], own[keep, 3]
        ends = np.cumsum(count)
        at = np.repeat(start - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)
        size = len(self.names) or 1
        pairs, often = np.unique(np.repeat(owner[keep], count) * size + self.groups[at], return_counts=True)
        bounds = pa.array(np.searchsorted(pairs, np.arange(n + 1) * size), pa.int32())
        names = pa.array(self.names, pa.string())
        ends, shown = np.concatenate([[0], np.cumsum(sums[2])]).tolist(), self.groups[at].tolist()
        digests = [hashlib.sha256(";".join(map(self.names.__getitem__, shown[ends[i] : ends[i + 1]])).encode()).hexdigest() if f else "" for i, f in enumerate(fine.tolist())]
        return sums, digests, pa.ListArray.from_arrays(bounds, names.take(pa.array(pairs % size))), pa.ListArray.from_arrays(bounds, pa.array(often, pa.int32()))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _encode(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, cache_bytes: int) -> Iterator[pa.RecordBatch]:
    claim("token_alignment", _ALIGNERS.clear)
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path, cache_bytes)
    aligner = _ALIGNERS[a_path, b_path]
    aligner.limit = cache_bytes
    for batch in batches:
        for lo, texts in slices(batch.column(1)):
            sums, digests, names, often = aligner.bags(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), *[pa.array(s) for s in sums], pa.array(digests, pa.string()), names, often], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "names", "often"])


def bags(docs: DataFrame, a_path: str, b_path: str, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """A row for each document: counts, the digest of its groups, and its bag of groups."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda it: _encode(it, a_path, b_path, cache_bytes), f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, names array<string>, often array<int>")


def links(name: str, a_bytes: list[int], b_bytes: list[int]) -> list[tuple[int, int]]:
    """The pairs of tokens of a group whose byte ranges overlap; a_bytes, b_bytes: lengths by id."""
    a, b = ([int(i) for i in side.split(",")] for side in name.split("|"))
    out, i, j, at, to = [], 0, 0, a_bytes[a[0]], b_bytes[b[0]]
    while True:
        out.append((a[i], b[j]))
        if at == to:
            return out  # offsets are only equal at a group's end
        if at < to:
            i += 1
            at += a_bytes[a[i]]
        else:
            j += 1
            to += b_bytes[b[j]]


def _expand(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    """A row for each distinct link of a group, with how often the group holds it."""
    from collections import Counter

    aligner = Aligner(a_path, b_path)
    a, b = [len(x) for x in aligner.a_bytes], [len(x) for x in aligner.b_bytes]
    for batch in batches:
        for lo in range(0, batch.num_rows, 20_000):
            rows = [(n, f, *k, m) for n, f in zip(batch.column(0).slice(lo, 20_000).to_pylist(), batch.column(1).slice(lo, 20_000).to_pylist()) for k, m in Counter(links(n, a, b)).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["name", "freq", "a", "b", "times"])


def _head(groups: DataFrame, rows: int, size: int) -> int:
    """The least frequency such that groups of at least it are at most so many rows and bytes; from their counts by the
    power of two of the frequency."""
    steps = groups.groupBy(F.floor(F.log2("freq")).alias("p")).agg(F.count("*").alias("n"), F.sum(F.octet_length("name")).alias("b")).collect()
    n = b = 0
    least = 1 << 62
    for r in sorted(steps, key=lambda r: -r.p):
        n, b = n + r.n, b + r.b
        if n > rows or b > size:
            break
        least = 1 << r.p
    return least


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, *, head_rows: int = HEAD_ROWS, head_bytes: int = HEAD_BYTES, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document, as a table in the shared
    folder. head_rows and head_bytes bound what is broadcast and change nothing else."""
    import public_tokenizers

    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        found = scratch.written(bags(docs, a_path, b_path, cache_bytes).withColumn("row", F.monotonically_increasing_id()), "bags")
        each = found.select("row", F.explode(F.arrays_zip("names", "often")).alias("g")).select("row", F.col("g.names").alias("name"), F.col("g.often").cast("bigint").alias("often"))
        groups = scratch.written(each.groupBy("name").agg(F.sum("often").alias("freq")), "groups")
        expanded = scratch.written(groups.mapInArrow(lambda it: _expand(it, a_path, b_path), "name string, freq bigint, a int, b int, times int"), "links")
        pairs = scratch.written(expanded.groupBy("a", "b").agg(F.sum(F.col("freq") * F.col("times")).alias("n")), "pairs")
        best = pairs.groupBy("b").agg(F.max("n").alias("best"))
        judged = pairs.join(F.broadcast(best), "b").select("a", "b", "n", (F.col("n") == F.col("best")).cast("bigint").alias("is_best"))  # a row for a B id
        values = expanded.join(small(judged), ["a", "b"]).groupBy("name").agg(F.max("freq").alias("freq"), F.sum("times").cast("bigint").alias("n_links"), F.sum(F.col("times") * F.col("is_best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        valued = scratch.written(values, "values")
        scratch.drop(expanded, pairs, groups)
        least = _head(valued, head_rows, head_bytes)
        head = F.broadcast(valued.filter(F.col("freq") >= least).drop("freq"))
        sums = [F.sum(F.col("often") * F.col(c)).alias(c) for c in ("n_links", "n_best", "count_sum")]
        joined = each.join(head, "name", "left")
        part = joined.filter("n_links IS NOT NULL").groupBy("row").agg(*sums)
        if valued.filter(F.col("freq") < least).limit(1).count():
            rare = joined.filter("n_links IS NULL").select("row", "name", "often").join(valued.filter(F.col("freq") < least).drop("freq"), "name")
            part = part.unionByName(rare.groupBy("row").agg(*sums)).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
        counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_links", "n_best", "count_sum")]
        out = found.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(part, "row", "left")
        return written(out.select("doc_id", "n_a", "n_b", "n_groups", *counts, "groups_sha256"), "aligned")
