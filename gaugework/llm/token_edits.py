"""Token counts that follow edits.

A document is a segment tree. Its leaves are stretches of whole pre-tokens, at first the ones that begin at a space, and
later the single pre-tokens an edit leaves behind; each knows its characters and its ids. Leaves lie in blocks of FANOUT,
and above the blocks stands a binary tree of sums of both in a heap: node i holds the sums of nodes 2i and 2i+1. The
root is the document's count. An edit finds its place by descending the character sums from the root, takes the leaves
it touches and CONTEXT more on either side, and cuts that stretch into pre-tokens again. The cut is right if a pre-token
begins where the last leaf of the stretch does, as cutting only looks ahead of where it stands; otherwise the stretch
grows on its right. Only pre-tokens before that leaf are encoded, and only the sums above the blocks they lie in change.

Defined cases: a null text is empty; edits beyond the end act at the end, and those that end before they start insert; a
null edit list is empty and a null insertion empty; edits of a document apply in order, each on the text the one before
left; documents without edits keep their count; texts that hold the string of a special token, before or after an edit,
are encoded whole each time; texts of any length are read whole; repeated rows alike; other columns are unused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gaugework.llm.token_output import Encoder, encoder, slices

CONTEXT = 2
#: Leaves of a block, and how many times that a block may grow before the tree is built anew.
FANOUT, GROWN = 32, 16


class Tree:
    """The segment tree of one document. chars and ids: arrays of its leaves, by which text is cut."""

    def __init__(self, text: str, enc: Encoder, chars: np.ndarray | None = None, ids: np.ndarray | None = None) -> None:
        self.enc, self.reencoded = enc, 0
        if chars is None:
            u = enc.units(pa.array([text]))
            chars, ids = u.chars[u.codes], u.counts[u.codes]
        self.build(text, chars, ids)

    def build(self, text: str, chars: np.ndarray, ids: np.ndarray) -> None:
        if not chars.all():  # no leaf is empty
            chars, ids = chars[chars > 0], ids[chars > 0]
        n = max(1, -(-len(chars) // FANOUT))
        size = 1 << (n - 1).bit_length()
        at = np.arange(0, len(chars), FANOUT)
        self.size = size
        # a block is (text, first, characters of its leaves, ids of its leaves); text starts at the place first
        ends = np.cumsum(chars)
        starts = (ends[at] - chars[at]).tolist()
        self.blocks: list[tuple] = [(text, s, i) for s, i in zip(starts, at.tolist())]
        self.blocks += [("", 0, len(chars))] * (size - len(self.blocks))
        self.leaves: dict[int, tuple[list[int], list[int]]] = {}
        self.all = chars, ids
        self.chars, self.count_ = (self._heap(np.add.reduceat(x, at) if len(at) else [], size) for x in (chars, ids))

    @staticmethod
    def _heap(sums, size: int) -> list[int]:
        level = [*map(int, sums)] + [0] * (size - len(sums))
        levels = [level]
        while len(level) > 1:
            level = [a + b for a, b in zip(level[::2], level[1::2])]
            levels.append(level)
        return [0, *(x for lv in reversed(levels) for x in lv)]

    @property
    def count(self) -> int:
        return self.count_[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def find(self, place: int) -> tuple[int, int]:
        """(block, characters before it): the block that holds the place, the last one for the end."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if place >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def block(self, b: int) -> tuple[list[str], list[int]]:
        """(texts, ids) of a block's leaves."""
        if b not in self.leaves:
            text, at, i = self.blocks[b]
            chars, ids = (x[i : i + FANOUT].tolist() for x in self.all)
            out = []
            for n in chars:
                out.append(text[at : at + n])
                at += n
            self.leaves[b] = out, ids
        return self.leaves[b]

    def put(self, b: int, texts: list[str], ids: list[int]) -> None:
        """New leaves of a block, and the sums of the nodes above it."""
        self.leaves[b] = texts, ids
        i = b + self.size
        self.chars[i], self.count_[i] = sum(map(len, texts)), sum(ids)
        while i > 1:
            i //= 2
            self.chars[i], self.count_[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.count_[2 * i] + self.count_[2 * i + 1]

    def text(self) -> str:
        return "".join(t for b in range(self.size) for t in self.block(b)[0])

    def edit(self, start: int, end: int, new: str) -> None:
        n = self.length
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        lo, before = self.find(start)
        hi, _ = self.find(end)
        # leaves of the blocks that the edit touches, and of neighbours until the context is there
        texts, ids = map(list, self.block(lo))
        for b in range(lo + 1, hi + 1):
            t, k = self.block(b)
            texts += t
            ids += k
        first, at = 0, before
        while first < len(texts) and at + len(texts[first]) <= start:
            at += len(texts[first])
            first += 1
        last, stop = first, at
        while last < len(texts) and stop < end:
            stop += len(texts[last])
            last += 1
        for _ in range(CONTEXT):
            while not first and lo:
                lo -= 1
                t, k = self.block(lo)
                texts, ids, first, last = t + texts, k + ids, first + len(t), last + len(t)
            if first:
                first -= 1
                at -= len(texts[first])
        more = CONTEXT
        while True:
            while last + more > len(texts) and hi + 1 < self.size:
                hi += 1
                t, k = self.block(hi)
                texts, ids = texts + t, ids + k
            right = min(last + more, len(texts))
            old = "".join(texts[first:right])
            fresh = self.enc.pieces.findall(old[: start - at] + new + old[end - at :])
            if last + more > len(texts):  # up to the document's end
                break
            # a pre-token must begin where the stretch's last leaf does, which then stays
            sync, have = len(texts[right - 1]), 0
            keep = len(fresh)
            while keep and have < sync:
                keep -= 1
                have += len(fresh[keep])
            if have == sync:
                fresh, right = fresh[:keep], right - 1
                break
            more *= 2
        self.enc.learn(fresh)
        size = self.enc.kind.itemsize
        texts[first:right], ids[first:right] = fresh, [len(self.enc.known[p]) // size for p in fresh]
        self.reencoded += len(fresh)
        # the leaves go back into their blocks in equal parts
        part = -(-len(texts) // (hi - lo + 1))
        for b in range(lo, hi + 1):
            i = (b - lo) * part
            self.put(b, texts[i : i + part], ids[i : i + part])
        if part > FANOUT * GROWN:
            every = [self.block(b) for b in range(self.size)]
            words = [t for ts, _ in every for t in ts]
            self.build("".join(words), np.array([len(t) for t in words], dtype=np.int64), np.array([n for _, ns in every for n in ns], dtype=np.int64))


def _whole(enc: Encoder, text: str, edits: list) -> tuple[int, int, int]:
    """Counts where a special token's string takes part: each time of the whole text."""
    size = enc.kind.itemsize
    n = work = len(enc.whole(text)) // size
    work = 0
    for e in edits:
        a = min(max(e["start"], 0), len(text))
        text = text[:a] + (e["new"] or "") + text[min(max(e["end"], a), len(text)) :]
        work += len(enc.whole(text)) // size
    return n, len(enc.whole(text)) // size, work


def _apply(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    marks = {c for s in enc.special for c in s}
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        filled = pc.fill_null(batch.column(1), "")
        for lo, texts in slices(filled):
            u = enc.units(texts)
            chars, ids = u.chars[u.codes], u.counts[u.codes]
            every = batch.column(2).slice(lo, len(texts)).to_pylist()
            for i, (text, edits) in enumerate(zip(texts.to_pylist(), every)):
                edits = edits or []
                # an insertion could complete a special token's string only with one of its characters at hand
                if enc.is_special(text) or any(marks & set(e["new"] or "") or not e["new"] for e in edits) and marks <= set(text + "".join(e["new"] or "" for e in edits)):
                    out.append(_whole(enc, text, edits))
                    continue
                span = slice(u.offsets[i], u.offsets[i + 1])
                tree = Tree(text, enc, chars[span], ids[span])
                before = tree.count
                for e in edits:
                    tree.edit(e["start"], e["end"], e["new"] or "")
                out.append((before, tree.count, tree.reencoded))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[k] for x in out], pa.int64()) for k in range(3)]], names=["doc_id", "n_tokens", "n_tokens_edited", "n_reencoded"])


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs: doc_id, text, edits (array of start, end, new, in code points). (doc_id, n_tokens, n_tokens_edited, n_reencoded)."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "edits").mapInArrow(lambda it: _apply(it, path), f"doc_id {kind}, n_tokens bigint, n_tokens_edited bigint, n_reencoded bigint")
