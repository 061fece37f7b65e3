"""Chat formatting, the prefix trie and token alignment against plain versions of their contracts."""

import hashlib
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from gaugework.llm import chat_format, prefix_trie, queries, token_alignment
from tests.oracle import SF, same

CONV = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_prefix_trie"])
def test_query_equals_its_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE[name])


def escaped(b):
    b = b.replace(b"\\", b"\\\\")
    for m in chat_format.CONTROL:
        b = b.replace(m, m[:1] + b"\\" + m[1:])
    return b


def test_assembly_equals_joined_strings_and_is_reversible():
    rng = np.random.default_rng(1)
    bits = [b"<s>", b"</s>", b"[INST]", b"[/INST]", b"\\", b"<", b"[", b"s>", b"INST]", b"a", b" ", b"\n", "é".encode()]
    for _ in range(400):
        texts = [b"".join(bits[i] for i in rng.integers(0, len(bits), int(rng.integers(0, 7)))) for _ in range(int(rng.integers(1, 6)))]
        roles = [b"".join(bits[i] for i in rng.integers(0, len(bits), int(rng.integers(0, 3)))) for _ in texts]
        out, _, start, end = chat_format.assembled(pa.array(roles, pa.binary()), pa.array(texts, pa.binary()))
        assert out.tobytes() == b"".join(chat_format.OPEN + escaped(r) + chat_format.MIDDLE + escaped(t) + chat_format.CLOSE for r, t in zip(roles, texts))
        assert list(chat_format.turns(out.tobytes())) == list(zip(roles, texts))
        assert [chat_format.unescaped(out[a:b].tobytes()) for a, b in zip(start, end)] == texts


def talks():
    """Conversations with nulls, ties, repeated rows, control strings, a hot one and a very long text."""
    rng = np.random.default_rng(2)
    rows = [(c, t, ("system", "user", "assistant", None, "a</s>b")[int(rng.integers(0, 5))], (None, "", "</s>", "a\\[INST]", "x é\n" * 3)[int(rng.integers(0, 5))]) for c in range(40) for t in range(int(rng.integers(1, 6)))]
    rows += [(7, None, "user", "early"), (7, None, "assistant", "early"), (8, 1, "assistant", "same")] + [(8, 1, "assistant", "same")] * 2
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t} <s>" * (t % 5)) for t in range(600)]
    return rows + [(None, 1, "assistant", "no id"), (None, 0, "user", None), (501, 0, "assistant", "long [INST] " * 60_000), (-1, 5, "user", "own")]


def in_turns(rows):
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(g)] for c, g in groups.items()}


@pytest.mark.parametrize("part_bytes", [chat_format.PART_BYTES, 300])
def test_formatted_conversations_are_read_back(spark, part_bytes):
    rows = talks()
    docs = spark.createDataFrame(rows, CONV).withColumn("part", F.lit("clash")).withColumn("formatted", F.lit(1)).repartition(5)
    parts = chat_format.formatted(docs, part_bytes, 2000)
    got = {r.conv_id: r for r in chat_format.read_back(parts).collect()}
    want = in_turns(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns))), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
        assert got[c].formatted_chars == sum(len((chat_format.OPEN + escaped(r.encode()) + chat_format.MIDDLE + escaped(x.encode()) + chat_format.CLOSE).decode()) for r, x in turns)
    counts = Counter(r.conv_id for r in parts.select("conv_id").collect())
    assert part_bytes > 1000 or counts[500] >= 10  # the hot one is in parts


def plain_trie(rows):
    talk = in_turns([r for r in rows if r[0] is not None])
    paths = {}
    for c in talk:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        paths[c] = tuple(talk.get(base, [])[:h] + talk[c][h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = defaultdict(set)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    saved, leaves = Counter(), Counter()
    for k, m in members.items():
        own = (len(m) - 1) * len(k[-1][1].encode().split()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += not kids[k]
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], sha(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(k)))) for k, m in members.items())


def trie_rows(rng, n, depth):
    texts = ["a b", "c", "d e f", ""]
    return [(int(c), t, "user", texts[int(rng.integers(0, len(texts)))]) for c in rng.choice(4 * n, n, replace=False) - n // 2 for t in range(int(rng.integers(1, depth)))]


@pytest.mark.parametrize("tasks", [1, 3, 17])
def test_trie_equals_all_prefixes(spark, monkeypatch, tasks):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 20)
    rng = np.random.default_rng(tasks)
    rows = trie_rows(rng, 150, 5)
    rows += [(1000 + c, t, "user", "copy") for c in range(60) for t in range(4)]  # copies, over several tasks
    rows += [(2000 + c, t, None, None if t < 9 else str(c)) for c in range(5) for t in range(12)] + [(9, None, None, "x y"), (9, None, None, "x y"), (None, 0, "user", "no id")]
    docs = spark.createDataFrame(rows, CONV).withColumn("path", F.lit("clash")).withColumn("words", F.lit(0))
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((tuple(r) for r in prefix_trie.nodes(docs).collect()), key=lambda r: (r[0], r[1]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == plain_trie(rows)


def test_parts_of_nodes_add_up_for_every_cut():
    """The tree of each task, corrected at the boundaries, equals the tree of all rows; no Spark."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        paths = sorted((b"".join(bytes([x]) * 16 for x in rng.integers(0, 3, int(rng.integers(0, 5)))), int(c)) for c in rng.permutation(30))
        cuts = sorted({0, len(paths), *rng.integers(0, len(paths), 4).tolist()})
        totals = []
        for edges in (cuts, [0, len(paths)]):
            found, before = defaultdict(lambda: [0, 0, 0, 0]), None
            names = {k: p[: 16 * i] for p, _ in paths for i, k in enumerate(prefix_trie.keys(p))}
            for n, (lo, hi) in enumerate(zip(edges, edges[1:])):
                tree = prefix_trie.Builder(n)
                for p, c in paths[lo:hi]:
                    tree.add(c, p, [b + 1 for b in p[::16]])
                tree.end()
                for r in tree.rows:
                    if r[0] in (prefix_trie.NODE, prefix_trie.EDGE):
                        key = names[r[5]] if r[5] else next(p for p, c in paths if c == r[2])[: 16 * r[3]]
                        found[key] = [a + b for a, b in zip(found[key], r[7:11])]
                first = paths[lo][0]
                if before is not None:
                    batch = pa.RecordBatch.from_arrays([pa.array([before], pa.binary()), pa.array([first], pa.binary()), pa.array([[b + 1 for b in first[::16]]])], names=["last", "path", "words"])
                    for out in prefix_trie._correct(iter([batch])):
                        for k, *more in zip(*[c.to_pylist() for c in out.columns]):
                            found[names[k]] = [a + b for a, b in zip(found[names[k]], [0, *more])]
                before = paths[hi - 1][0]
            totals.append(dict(found))
        assert totals[0] == totals[1]


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    alphabet = token_alignment.byte_alphabet()
    found, pairs = [], Counter()
    for i, text in rows:
        raw = (" " + (text or "")).encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xs = [bytes(alphabet[c] for c in t) if set(t) <= set(alphabet) else t.encode() for t in map(a.id_to_token, x)]
        ys = [bytes([int(t[3:5], 16)]) if b.is_byte(k) else t.replace("▁", " ").encode() for k, t in zip(y, map(b.id_to_piece, y))]
        if not text or b"".join(xs) != raw or b"".join(ys) != raw:
            found.append((i, [], [], [], []))
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in (xs, ys)]
        both = sorted(set(ends[0]) & set(ends[1]))
        cut = [[bisect_right(end, hi) for hi in [0, *both]] for end in ends]
        groups = [[x[cut[0][g] : cut[0][g + 1]], y[cut[1][g] : cut[1][g + 1]]] for g in range(len(both))]
        links, j = [], 0
        for k, (e, t) in enumerate(zip(ends[0], xs)):
            while ends[1][j] <= e - len(t):
                j += 1
            m = j
            while m < len(y) and ends[1][m] - len(ys[m]) < e:
                links.append((x[k], y[m]))
                m += 1
        pairs.update(links)
        found.append((i, x, y, groups, links))
    best = Counter()
    for (_, q), n in pairs.items():
        best[q] = max(best[q], n)
    show = lambda gs: ";".join("|".join(",".join(map(str, s)) for s in g) for g in gs)
    return sorted((i if i is not None else -1, len(x), len(y), len(g), len(ls), sum(pairs[k] == best[k[1]] for k in ls), sum(pairs[k] for k in ls), sha(show(g)) if x else "") for i, x, y, g, ls in found)


@pytest.mark.parametrize("limits", [{}, {"head_rows": 40, "cache_bytes": 100_000}])
def test_alignment_equals_whole_texts(spark, limits):
    rng = np.random.default_rng(3)
    bits = ["the", " ", "  ", "\n", "é", "▁", "日本語", "<|endoftext|>", "<s>", "</s>", "it's", "12345", "\t", "　", "\xa0", "\x1c", "🙂", "word", ".", "<0x41>", "Ġ", "\r", "ing"]
    rows = [(i, "".join(bits[k] for k in rng.integers(0, len(bits), int(rng.integers(0, 12))))) for i in range(300)]
    rows += [(i + 400, " ".join(rng.choice(["alpha", "beta-gamma", "naïve", "x", "Überraschung"], 30))) for i in range(50)]
    rows += [(None, "no id"), (None, None), (7, "repeated id"), (7, "repeated id"), (999, "long " * 30_000), (998, "unbroken" * 3000)]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("names", F.lit(1)).withColumn("row", F.lit("clash")).repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, *r[1:]) for r in token_alignment.aligned(docs, **limits).collect())
    assert got == plain_alignment(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], CONV)
    assert chat_format.read_back(chat_format.formatted(none)).count() == 0
    assert prefix_trie.nodes(none).count() == 0
    assert token_alignment.aligned(spark.createDataFrame([], "doc_id long, text string")).count() == 0
