"""Token ids in Arrow stream files of fixed-size-list batches.

Each shard is a stream of record batches whose columns `ids` (fixed_size_list<uint16 or uint32>[length]) and `mask`
(fixed_size_list<bool>[length], false on the padding that ends a shard) hold equal-length rows. All batches but the last
have the same rows and so the same bytes, so that a memory-mapped reader finds any row by arithmetic and maps it without
copying (Shard). A second stream beside it, `.index`, holds doc_id and n_tokens in file order.

Documents come in ascending doc_id order, by a range partitioning of which each partition is a shard; or, with
order="files", in the order of the rows of the Parquet files docs is read from (names, then rows), without a shuffle:
each stretch of a file that a task reads is a shard.

A shard's name is its own for each attempt and the driver gets only the names that succeeded, so lost executors and
repeated tasks leave no wrong rows. The words' ids are kept in a bounded table for each Python worker.

Ids are those of the library with add_special_tokens=False: a special token's string in a text is that token.

Defined cases: a null text is empty and gives the end id alone; repeated doc_ids follow each other in the order of
their text's hash; null doc_ids come first; doc_id keeps its type; an empty table writes no shard and gives no rows;
order="files" for a table that isn't read from files means doc_id order; texts of any length are encoded whole; other
columns are unused.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import filterfalse
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugework.llm.common import claim, fresh_path, trim

LENGTH, END_ID, BATCH_ROWS = 2048, 0, 256
#: Memory of a worker's tables of words and pieces, about; they start anew beyond it. Bytes of a pre-token's entry and of
#: a word's besides the text, with the hash table that a lookup builds.
CACHE_BYTES, ENTRY, WORD = 200_000_000, 190, 100
#: Bytes of text that are encoded together (a longer text by itself).
SLICE_BYTES = 4_000_000

#: Words before which a text is not cut: empty, or white space first.
_ODD = r"^(?:$|[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])"

_ENCODERS: dict[str, "Encoder"] = {}


class Units(NamedTuple):
    """Texts as sequences of entries: text i has codes[offsets[i]:offsets[i+1]]; entry c has the ids
    ids[starts[c]:starts[c]+counts[c]] and chars[c] code points."""

    offsets: np.ndarray
    codes: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    chars: np.ndarray


class Encoder:
    """Exact ids of whole texts. A text is cut before each space that a character other than white space follows, where
    a pre-token always begins. The units between are encoded once each by the tokenizers library and looked up
    afterwards, many at a time; ids of a pre-token don't depend on its neighbours, as merges never cross its end. Texts
    that hold a space before white space or at their end are cut into pre-tokens by the pattern, and those with the
    string of a special token go to the library whole."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.special]
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.kind = np.dtype("<u4" if self.tok.get_vocab_size() > 65_536 else "<u2")
        self.code = "I" if self.kind.itemsize == 4 else "H"
        self.limit = CACHE_BYTES
        self.line = self.tok.encode("\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, bytes] = {}
        #: Entries: the empty one, words behind a space (words, and places of them) and first words (heads).
        self.words, self.places, self.heads = pa.array([], pa.string()), np.zeros(0, dtype=np.int64), {}
        self.ids, self.starts, self.counts, self.chars = np.zeros(0, dtype=self.kind), *(np.zeros(1, dtype=np.int64) for _ in range(3))
        self.held = 0

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, texts: list[str]) -> list:
        """Encodings in which the strings of special tokens are ordinary text."""
        self.tok.encode_special_tokens = True
        try:
            return self.tok.encode_batch_fast(texts, add_special_tokens=False)
        finally:
            self.tok.encode_special_tokens = False

    def is_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode the pre-tokens that are not known yet."""
        miss = list(set(filterfalse(self.known.__contains__, pieces)))
        for i in range(0, len(miss), 5_000):
            some = miss[i : i + 5_000]
            for p, e in zip(some, self.plain(some)):
                self.known[p] = array(self.code, e.ids).tobytes()
        self.held += sum(map(len, miss)) + len(miss) * ENTRY

    def cut(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, cut into pre-tokens by the pattern."""
        found = [self.pieces.findall(t) for t in texts]
        self.learn(p for ps in found for p in ps)
        return [b"".join(map(self.known.__getitem__, ps)) for ps in found]

    def behind_space(self, words: list[str]) -> list[bytes]:
        """Ids of words, each behind a space. A line feed before a space is a piece of its own, so many words without
        white space are one text, whose ids fall apart at the line feed's id; all others are cut by the pattern."""
        got: dict[str, bytes] = {}
        plain = [w for w in words if w.split() == [w]] if len(self.line) == 1 else []
        for lo in range(0, len(plain), 16_000):  # the library's results take much more room than ids
            some = [plain[i : i + 400] for i in range(lo, min(lo + 16_000, len(plain)), 400)]
            for ws, e in zip(some, self.plain([" " + "\n ".join(ws) for ws in some])):
                ids = np.array(e.ids, dtype=self.kind)
                at = np.flatnonzero(ids == self.line[0])
                if len(at) == len(ws) - 1:
                    raw, size = ids.tobytes(), self.kind.itemsize
                    ends = (at * size).tolist() + [len(raw)]
                    starts = [0, *(at * size + size).tolist()]
                    got.update(zip(ws, [raw[i:j] for i, j in zip(starts, ends)]))
        rest = [w for w in words if w not in got]
        got.update(zip(rest, self.cut([" " + w for w in rest])))
        return [got[w] for w in words]

    def add(self, raws: list[bytes], chars: list[int]) -> np.ndarray:
        """Places of new entries."""
        n = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws)) // self.kind.itemsize
        at = np.arange(len(self.starts), len(self.starts) + len(raws))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(n) - n])
        self.counts, self.chars = np.concatenate([self.counts, n]), np.concatenate([self.chars, np.array(chars, dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(raws), dtype=self.kind)])
        self.held += int(n.sum()) * self.kind.itemsize + 24 * len(raws)
        return at

    def units(self, texts: pa.Array) -> Units:
        if self.held > self.limit:
            self.clear()
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary
        first = offsets[:-1]
        tail = np.ones(len(codes), dtype=bool)
        tail[first] = False
        odd = pc.match_substring_regex(words, _ODD).to_numpy(zero_copy_only=False)
        rows = set((np.searchsorted(offsets, np.flatnonzero(odd[codes] & tail), side="right") - 1).tolist())
        special = {i for s in self.special for i in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)).tolist()}
        used = np.zeros(len(words), dtype=bool)
        used[codes[tail]] = True
        used &= ~odd
        found = pc.index_in(words, value_set=self.words)
        entry = np.zeros(len(words), dtype=np.int64)
        have = found.is_valid().to_numpy(zero_copy_only=False)
        entry[have] = self.places[found.drop_null().to_numpy()]
        if (miss := np.flatnonzero(used & ~have)).size:
            new = words.take(pa.array(miss))
            texts_ = new.to_pylist()
            entry[miss] = self.add(self.behind_space(texts_), [len(w) + 1 for w in texts_])
            self.words, self.places = pa.concat_arrays([self.words, new]), np.concatenate([self.places, entry[miss]])
            self.held += new.nbytes + WORD * len(new)
        starts = words.take(coded.indices.take(pa.array(first))).to_pylist()
        codes = entry[codes]
        if heads := [w for w in dict.fromkeys(starts) if w not in self.heads]:
            self.heads.update(zip(heads, self.add(self.cut(heads), [len(w) for w in heads]).tolist()))
            self.held += sum(map(len, heads)) + len(heads) * ENTRY
        codes[first] = [self.heads[w] for w in starts]
        for i in sorted(rows | special):
            text = texts[i].as_py()
            codes[offsets[i] : offsets[i + 1]] = 0
            codes[offsets[i]] = self.add([self.whole(text) if i in special else self.cut([text])[0]], [len(text)])[0]
        return Units(offsets, codes, self.ids, self.starts, self.counts, self.chars)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text), the end id behind each text if there is one."""
        u = self.units(texts)
        codes, offsets, ids, starts, counts = u.codes, u.offsets, u.ids, u.starts, u.counts
        if end is not None:
            more = np.full(len(codes) + len(texts), len(starts), dtype=np.int64)
            keep = np.ones(len(more), dtype=bool)
            keep[offsets[1:] + np.arange(len(texts))] = False
            more[keep] = codes
            codes, offsets = more, offsets + np.arange(len(offsets))
            starts, counts, ids = np.append(starts, len(ids)), np.append(counts, 1), np.append(ids, np.array([end], dtype=ids.dtype))
        n = counts[codes]
        ends = np.cumsum(n)
        size = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(size, len(ids)) < 2**31 else np.int64
        at = np.repeat((starts[codes] - ends + n).astype(kind), n)
        at += np.arange(size, dtype=kind)
        total = np.concatenate([[0], ends])
        return ids[at], total[offsets[1:]] - total[offsets[:-1]]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) in stretches of about limit bytes."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(size), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + limit, side="right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def encoder(path: str, cache_bytes: int = CACHE_BYTES) -> Encoder:
    claim("token_output", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].limit = cache_bytes
    return _ENCODERS[path]


def _schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(kind)), length)), ("mask", pa.list_(pa.field("item", pa.bool_()), length))])


class _Writer:
    """One shard: its two streams, and the ids that don't fill a batch yet."""

    def __init__(self, folder: str, name: str, enc: Encoder, length: int, kind: pa.DataType) -> None:
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        self.name, self.length, self.schema = f"{folder}/{name}", length, _schema(enc.kind, length)
        self.index_schema = pa.schema([("doc_id", kind), ("n_tokens", pa.int64())])
        self.data = pa.ipc.new_stream(fs.open_output_stream(f"{at}/{name}.arrows"), self.schema)
        self.index = pa.ipc.new_stream(fs.open_output_stream(f"{at}/{name}.index"), self.index_schema)
        self.held, self.total = np.zeros(0, dtype=enc.kind), 0

    def _put(self, ids: np.ndarray, rows: int, real: int) -> None:
        types = [f.type for f in self.schema]
        mask = pa.array(np.arange(rows * self.length) < real)
        self.data.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), type=types[0]), pa.FixedSizeListArray.from_arrays(mask, type=types[1])], schema=self.schema))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        step = self.length * BATCH_ROWS
        held = np.concatenate([self.held, ids])
        full = len(held) // step * step
        for i in range(0, full, step):
            self._put(held[i : i + step], BATCH_ROWS, step)
        self.held = held[full:].copy()
        self.total += len(ids)
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.int64())], schema=self.index_schema))

    def close(self) -> None:
        if real := len(self.held):
            rows = -(-real // self.length)
            self._put(np.concatenate([self.held, np.zeros(rows * self.length - real, dtype=self.held.dtype)]), rows, real)
        self.data.close()
        self.index.close()


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, length: int, cache_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches: doc_id, text, and for file order the file and the row. A shard for the task, or for each file it reads."""
    from pyspark import TaskContext

    # a task has one core: the library's threads for each worker take memory of their own and no work off it
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    enc, part = encoder(path, cache_bytes), TaskContext.get().partitionId()
    out: list[tuple[str, int, str, int]] = []
    writer, place = None, ("", 0)

    def close() -> None:
        nonlocal writer
        if writer is not None:
            writer.close()
            out.append((*place, writer.name, writer.total))
        writer = None

    for batch in batches:
        files = batch.column(2).to_numpy(zero_copy_only=False) if batch.num_columns > 2 else None
        edges = [0, batch.num_rows] if files is None else [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), batch.num_rows]
        for i, j in zip(edges, edges[1:]):
            if i == j:
                continue
            if files is not None and writer is not None and files[i] != place[0]:
                close()
            if writer is None:
                place = ("", part) if files is None else (files[i], batch.column(3)[i].as_py())
                writer = _Writer(folder, f"shard-{part:06d}-{uuid.uuid4().hex}", enc, length, batch.column(0).type)
            for lo, texts in slices(batch.column(1).slice(i, j - i)):
                ids, counts = enc.encode(texts, END_ID)
                writer.add(batch.column(0).slice(i + lo, len(texts)), ids, counts)
        trim()
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["file", "row", "shard", "n_tokens"])


def write(docs: DataFrame, folder: str, path: str, length: int = LENGTH, order: str = "doc_id", cache_bytes: int = CACHE_BYTES) -> list[tuple[str, int, int]]:
    """Write the shards; (shard, ids before it, ids in it) for each, in order. One row a shard reaches the driver."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    own = None
    if order == "files":
        try:
            own = docs.select("doc_id", text, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        except AnalysisException:  # not read from files
            own = None
    if own is None:
        own = docs.select("doc_id", text, F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    rows = own.mapInArrow(lambda it: _write(it, folder, path, length, cache_bytes), "file string, row bigint, shard string, n_tokens bigint").collect()
    out, before = [], 0
    for r in sorted(rows):
        out.append((r.shard, before, r.n_tokens))
        before += r.n_tokens
    return out


def _open(uri: str):
    fs, at = pafs.FileSystem.from_uri(uri)
    return pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at)


class Shard:
    """Random access to a shard's rows: only the schema, one header and the batch that holds the row are read."""

    def __init__(self, uri: str) -> None:
        self.file = _open(uri + ".arrows")
        self.schema = pa.ipc.read_schema(self.file)
        self.base = self.file.tell()
        pa.ipc.read_message(self.file)
        self.size = self.file.tell() - self.base

    def row(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of row r; the ids are a view of the mapped file."""
        self.file.seek(self.base + r // BATCH_ROWS * self.size)
        batch = pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)
        n, i = self.schema.field(0).type.list_size, r % BATCH_ROWS
        ids, mask = (batch.column(c).flatten().slice(i * n, n) for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = iter(pa.ipc.open_stream(_open(shard + ".arrows")))
            held, n = np.zeros(0, dtype="<u4"), before
            for part in pa.ipc.open_stream(_open(shard + ".index")):
                counts, crcs, starts, at = part.column(1).to_pylist(), [], [], 0
                for c in counts:
                    if len(held) - at < c:
                        got, have = [held[at:]], len(held) - at
                        while have < c:
                            b = next(rows)
                            real = b.column(0).flatten().to_numpy()[b.column(1).flatten().to_numpy(zero_copy_only=False)]
                            got.append(real.astype("<u4"))
                            have += len(real)
                        held, at = np.concatenate(got), 0
                    crcs.append(zlib.crc32(held[at : at + c]))
                    starts.append(n)
                    at, n = at + c, n + c
                held = held[at:]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(starts, pa.int64()), part.column(1), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, shards: list[tuple[str, int, int]], kind: str = "bigint") -> DataFrame:
    """A row for each document, from the files alone."""
    schema = f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
    table = spark.createDataFrame([(s, b) for s, b, _ in shards], "shard string, before bigint")
    return table.repartition(max(1, min(len(shards), 10_000))).mapInArrow(_read, schema)


def round_trip(docs: DataFrame, path: str | None = None, length: int = LENGTH, order: str = "doc_id", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Write docs as shards in the shared folder and return what the files hold of each document. cache_bytes bounds a
    worker's tables; it changes the time taken and nothing else."""
    import public_tokenizers

    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    shards = write(docs, folder, path or public_tokenizers.path("byte_bpe_50k.json"), length, order, cache_bytes)
    return read(spark, shards, docs.schema["doc_id"].dataType.simpleString())
