"""Conversation prefix trie by Patricia construction.

A conversation is a path of turn digests, 16 bytes a turn; texts are hashed where they are read and are not grouped.
Paths are sorted over all tasks by ranges of (path, conv_id), so members of a node are neighbours. Each task reads its
rows in order and creates only the points of a compressed tree: where conversations branch (the common prefix with the
row before), where one ends, and leaves. Points in progress are a stack, never longer than a path. When a point is
finished, its members, leaves, children and saved tokens are known; the unary nodes on the edge above it are expanded
then, their saved tokens being suffix sums along the edge.

A node's rows may lie in several tasks, but only nodes on the first or the last path of a task can. Their parts are
added up by key, and so is a correction for each boundary between tasks, which follows from the two rows beside it
alone: for every node of their common prefix the turn's tokens are saved once more, a child was counted twice, and a
leaf too where the left row ends there. Ids of a run of equal paths at a task's edge are handed on as text and hashed
in order, a piece at a time.

Defined cases: a null role or text is empty; a null turn comes first, ties of it are ordered by role, then by the
digest, and repeated rows are turns of their own; rows with a null conv_id belong to no conversation and are left out;
conv_id % 20 has the sign of conv_id; a conversation that keeps no turn ends at the root; an empty table gives no nodes;
texts of any length are hashed whole; other columns are unused. A path is one row, so a conversation may have as many
turns as a row may have times 40 bytes (fifty million).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugework.llm.common import Scratch, claim, small, written

WIDTH = 16
GROUP, HEADS = 20, 4
#: Bytes of the ids of a run at a task's edge that are handed on together, and nodes in a batch of results.
PIECE_BYTES, BATCH = 1_000_000, 20_000

NODE, EDGE, BOUND, IDS = 0, 1, 2, 3  # kinds of row: a finished node, part of one, a task's edge rows, ids of a run
_NO_IDS = hashlib.sha256(b"").hexdigest()
_COLS = [
    ("kind", pa.int8()), ("part", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("ids", pa.string()), ("path", pa.binary()), ("last", pa.binary()), ("words", pa.list_(pa.int64())),
]
_SCHEMA = pa.schema(_COLS)
ROWS = "kind tinyint, part bigint, conv_id bigint, depth bigint, parent_conv_id bigint, node binary, parent binary, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, ids string, path binary, last binary, words array<bigint>"


def turn_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path: array of (digest, words) in turn order): only digests are grouped."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    ordered = F.array_sort(F.collect_list("t"))
    return conversations.filter("conv_id IS NOT NULL").select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("path"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path binary, words array) of the rebuilt conversations: each takes its first turns from the first
    conversation of its group of GROUP ids, at most HEADS - 1 of them. A group's first turns go to GROUP rows at most."""
    own = turn_paths(conversations).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int"))
    heads = turn_paths(conversations.filter(F.col("conv_id") % GROUP == 0)).select(F.col("conv_id").alias("base"), F.slice("path", 1, HEADS - 1).alias("head"))
    joined = own.join(heads, "base", "left")
    head = F.when(F.col("head").isNull(), F.slice("path", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    tail = F.slice("path", F.col("h") + 1, F.greatest(F.size("path") - F.col("h"), F.lit(0)))
    path = joined.select("conv_id", F.concat(head, tail).alias("p"))
    return path.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.unhex(F.array_join(F.transform("p", lambda t: F.hex(t["digest"])), "")).alias("path"), F.transform("p", lambda t: t["words"]).alias("words"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their beginning."""
    n = min(len(a), len(b)) // WIDTH * WIDTH
    if a[:n] == b[:n]:
        return n // WIDTH
    x, y = np.frombuffer(a, dtype=np.uint8, count=n), np.frombuffer(b, dtype=np.uint8, count=n)
    return int(np.flatnonzero(x != y)[0]) // WIDTH


def keys(path: bytes) -> list[bytes]:
    """The key of the node at each depth of a path."""
    h = hashlib.blake2b(digest_size=WIDTH)
    out = [h.digest()]
    for i in range(0, len(path), WIDTH):
        h.update(path[i : i + WIDTH])
        out.append(h.copy().digest())
    return out


class _Point:
    """A branch, end or leaf of the compressed tree, with what is known of its subtree so far."""

    __slots__ = ("children", "depth", "ends", "first", "leaves", "least", "members", "pending", "saved")

    def __init__(self, depth: int, first: bool) -> None:
        self.depth, self.first = depth, first  # first: it lies on the task's first path
        self.members = self.leaves = self.children = self.saved = 0
        self.least: int | None = None
        self.ends = _NO_IDS
        self.pending: list[list] = []  # rows of its child nodes, which lack the parent's conv_id


class Builder:
    """Patricia tree of the rows of one task, which come sorted by (path, conv_id)."""

    def __init__(self, part: int) -> None:
        self.part, self.rows, self.stack = part, [], [_Point(0, True)]
        self.path: bytes | None = None
        self.words: np.ndarray = np.zeros(0, dtype=np.int64)
        self.first: tuple[bytes, np.ndarray] | None = None
        self.first_keys: list[bytes] = []
        self.run: list[bytes] = []  # ids of the run of equal paths that is read
        self.held: list[bytes] = []  # those of its pieces, in case it is the task's last run
        self.run_bytes = self.pieces = 0
        self.hash, self.edge = hashlib.sha256(), True  # edge: the run is the task's first

    def add(self, conv: int, path: bytes, words: list[int]) -> None:
        if path != self.path:
            self._close_run(False)
            depth = len(path) // WIDTH
            if self.path is None:
                self.first, self.first_keys = (path, np.array(words, dtype=np.int64)), keys(path)
            else:
                self._climb(common(self.path, path))
            self.edge = self.path is None
            self.path, self.words = path, np.array(words, dtype=np.int64)
            if self.stack[-1].depth < depth:
                self.stack.append(_Point(depth, self.edge))
        p = self.stack[-1]
        p.members += 1
        p.least = conv if p.least is None else min(p.least, conv)
        self.run.append(str(conv).encode())
        self.run_bytes += len(self.run[-1]) + 1
        if self.run_bytes >= PIECE_BYTES:
            self._flush_run()

    def _flush_run(self) -> None:
        """Ids so far go into the hash, and are handed on as text while the run may lie in another task too."""
        text = b",".join(self.run)
        if self.pieces:
            text = b"," + text
        self.hash.update(text)
        if self.edge:
            self._ids(text)
        elif self.run:
            self.held.append(text)
        self.run, self.run_bytes, self.pieces = [], 0, self.pieces + 1

    def _ids(self, text: bytes) -> None:
        self._row(IDS, node=keys(self.path)[-1], ids=text.decode())

    def _close_run(self, last: bool) -> None:
        """The run of equal paths is read to its end in this task."""
        if self.path is not None:
            if self.run:
                self._flush_run()
            if last and not self.edge:
                for text in self.held:
                    self._ids(text)
            if not (last or self.edge):
                self.stack[-1].ends = self.hash.hexdigest()
            else:
                self.stack[-1].ends = None
        self.run, self.run_bytes, self.pieces, self.hash, self.held = [], 0, 0, hashlib.sha256(), []

    def _climb(self, depth: int, last: bool = False) -> None:
        """Finish the points below depth; a point is created there if the edge above the last one passes it."""
        while self.stack[-1].depth > depth:
            q = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(_Point(depth, q.first))
            self._finish(q, self.stack[-1], last)

    def _finish(self, q: _Point, p: _Point, last: bool) -> None:
        """Emit q and the unary nodes between it and p, and add q to p."""
        partial = q.first or last
        leaves = q.leaves if q.children else 1
        edge = self.words[p.depth : q.depth] * (q.members - 1)  # by turn, of depths p.depth + 1 to q.depth
        saved = q.saved + np.cumsum(edge[::-1])[::-1]
        names: list = []
        if partial:
            names = self.first_keys if q.first else self.last_keys
        elif p.first:
            names = {p.depth: self.first_keys[p.depth]}
        for k, depth in enumerate(range(p.depth + 1, q.depth + 1)):
            own, top = depth == q.depth, k == 0
            row = [EDGE if partial else NODE, self.part, q.least, depth, None if top or partial else q.least, names[depth] if partial else None, names[depth - 1] if partial or (top and p.first) else None, q.members, q.children if own else 1, leaves, int(saved[k]), q.ends if own else _NO_IDS, None, None, None, None]
            if top and not partial and not p.first:
                p.pending.append(row)
            else:
                self.rows.append(row)
        if q.pending:
            if partial:  # on the last path: its key is known only now
                for row in q.pending:
                    row[6] = names[q.depth]
            else:
                for row in q.pending:
                    row[4] = q.least
            self.rows += q.pending
        p.members += q.members
        p.children += 1
        p.leaves += leaves
        p.saved += int(saved[0])
        p.least = q.least if p.least is None else min(p.least, q.least)

    def _row(self, kind: int, **cols) -> None:
        self.rows.append([kind, self.part, *[cols.get(n) for n, _ in _COLS[2:]]])

    def end(self) -> None:
        if self.path is None:
            return
        self._close_run(True)
        self.last_keys = keys(self.path)
        self._climb(0, True)
        root = self.stack[0]
        leaves = root.leaves if root.children else 1
        self._row(EDGE, conv_id=root.least, depth=0, node=self.first_keys[0], n_convs=root.members, n_children=root.children, n_leaves=leaves, saved_tokens=root.saved, ends_sha256=root.ends)
        self._row(BOUND, path=self.first[0], last=self.path, words=self.first[1].tolist())


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches: conv_id, path, words, sorted by path and conv_id."""
    from pyspark import TaskContext

    claim("prefix_trie")
    tree = Builder(TaskContext.get().partitionId())

    def out() -> pa.RecordBatch:
        rows, tree.rows = tree.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _COLS)], schema=_SCHEMA)

    for batch in batches:
        for conv, path, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            tree.add(conv, path, words)
            if len(tree.rows) >= BATCH:
                yield out()
    tree.end()
    if tree.rows:
        yield out()


def _correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches: last path of a task, first path and words of the next. A row for each node of their common prefix, with
    what the parts of both tasks have counted wrongly together."""
    for batch in batches:
        for last, path, words in zip(*[c.to_pylist() for c in batch.columns]):
            n = common(last, path)
            after = np.cumsum(np.array(words[:n], dtype=np.int64)[::-1])[::-1]  # of the turns of depths 1 to n
            saved = np.concatenate([after[:1] if n else [0], after])
            rows = [(k, -1 if d < n else 0, -1 if len(last) == n * WIDTH else 0, int(saved[d])) for d, k in enumerate(keys(path[: n * WIDTH]))]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["node", "n_children", "n_leaves", "saved_tokens"])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches: node, ids, sorted by node, part and place; a hash at a time is open."""
    now, h, any_ids = None, None, False

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["node", "sha"])

    for batch in batches:
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node != now:
                if now is not None:
                    yield close()
                now, h, any_ids = node, hashlib.sha256(), False
            if any_ids and not ids.startswith(","):
                ids = "," + ids
            h.update(ids.encode())
            any_ids = True
    if now is not None:
        yield close()


def _nodes(found: DataFrame, ends: Column) -> DataFrame:
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id bigint, path binary, words array<bigint>), as a table in the shared folder."""
    spark = paths.sparkSession
    with Scratch(spark) as scratch:
        ordered = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
        built = scratch.written(ordered.mapInArrow(_build, ROWS), "trie")
        # the tasks that had rows, in order: as many numbers as there are tasks
        tasks = sorted(r.part for r in built.filter(F.col("kind") == BOUND).select("part").collect())
        beside = spark.createDataFrame(list(zip(tasks, tasks[1:])), "part bigint, next bigint")
        bounds = built.filter(F.col("kind") == BOUND)
        pairs = bounds.select("part", "last").join(F.broadcast(beside), "part").join(bounds.select(F.col("part").alias("next"), "path", "words"), "next")
        wrong = pairs.select("last", "path", "words").mapInArrow(_correct, "node binary, n_children bigint, n_leaves bigint, saved_tokens bigint")
        parts = built.filter(F.col("kind") == EDGE).select("node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
        none = {"parent": "binary", "conv_id": "bigint", "depth": "bigint", "ends_sha256": "string"}
        fixed = wrong.select("node", *[F.lit(None).cast(t).alias(c) for c, t in none.items() if c != "ends_sha256"], F.lit(0).cast("bigint").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"))
        sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
        known = F.max(F.when(F.col("ends_sha256") != _NO_IDS, F.col("ends_sha256"))).alias("known")  # hashed within a task
        merged = parts.unionByName(fixed).groupBy("node").agg(F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, known)
        ids = built.filter(F.col("kind") == IDS).select("node", "part", F.monotonically_increasing_id().alias("at"), "ids")
        hashed = ids.repartition("node").sortWithinPartitions("node", "part", "at").select("node", "ids").mapInArrow(_hash, "node binary, sha string")
        edges = scratch.written(merged.join(hashed, "node", "left"), "edges")
        named = small(edges.select(F.col("node").alias("parent"), F.col("conv_id").alias("of")))
        kept = built.filter(F.col("kind") == NODE)
        done = kept.filter("parent IS NULL")
        below = kept.filter("parent IS NOT NULL").drop("parent_conv_id").join(named, "parent").withColumnRenamed("of", "parent_conv_id")
        upper = edges.join(named, "parent", "left").withColumnRenamed("of", "parent_conv_id")
        out = _nodes(done, F.col("ends_sha256")).unionByName(_nodes(below, F.col("ends_sha256"))).unionByName(_nodes(upper, F.coalesce("sha", "known", F.lit(_NO_IDS))))
        return written(out, "prefix-trie")


def nodes(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(conversations))
