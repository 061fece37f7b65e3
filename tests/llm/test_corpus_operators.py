"""The corpus operators against brute force, and their defined cases."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from tokenizers import Tokenizer

from gaugework.llm import decontam, html_extract, langid, licenses, mixing, neardup, pii, quality, queries, token_edits, token_output
from gaugework.llm.common import OWN
from tests.oracle import SF, same

BASE = "the quick onen thes brown fox jumps over lazy dogs and then some more words follow to make this text longer than most others are "
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [(1, BASE * 4), (2, None), (3, ""), (4, "   \n\t "), (5, "Ünïcode ★ text"), (6, BASE * 4), (6, BASE * 4), (7, LONG), (8, LONG + " tail"), (9, "a+b@c.de 1.2.3.4 999.1.1.1 x 4111 1111 1111 1111 +1 (555) 123-4567"), (None, "no id"), (10, "12" * 20_000), (11, "a" * 60_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in ROWS], f"doc_id long, text string, lang string, source string, n_chars long, `{'n_words'}` string")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE[name])


def naive(words, h):
    seen = {}
    for i in range(len(words) - h + 1):
        seen.setdefault(tuple(words[i : i + h]), []).append(i)
    return len({p for v in seen.values() if len(v) > 1 for i in v for p in range(i, i + h)})


def test_repeats_equal_brute_force():
    rng = np.random.default_rng(3)
    texts = [bytes(" ".join(map(str, rng.integers(0, k, n))), "ascii") for k, n in ((2, 90), (3, 200), (9, 300), (1, 150), (50, 10), (1, 1))] + [b""]
    for block in (10**6, 1):
        got = quality.measure(texts, 8, 64, block_words=block)
        assert got[4] == [naive(t.split(), 3) for t in texts]
        assert got[5] == [naive(t.split(), 8) for t in texts]
        assert [x > 0 for x in got[6]] == [naive(t.split(), 64) > 0 for t in texts]


def test_wu_manber_equals_direct_search():
    rng = np.random.default_rng(5)
    items = [(str(k), bytes(" ".join(map(str, rng.integers(0, 3, n))), "ascii")) for k, n in enumerate((12, 4, 1, 10, 15))]
    m = decontam.Matcher(items)
    for _ in range(30):
        w = decontam.words_of(bytes(" ".join(map(str, rng.integers(0, 3, 80))), "ascii"))
        want, who = set(), set()
        for item, t in items:
            x = decontam.words_of(t)
            n = min(10, len(x))
            for i in range(len(x) - n + 1):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == x[i : i + n]:
                        want |= set(range(j, j + n))
                        who.add(item)
        spans, got = m.search(w)
        assert {p for a, b in spans for p in range(a, b)} == want and got == who


def test_every_operator_takes_odd_rows(spark, docs):
    bench = spark.createDataFrame([(1, "no id"), (2, None), (None, "x"), (3, "")], "item_id long, text string")
    n = len(ROWS)
    for frame, rows in ((docs, n), (docs.limit(0), 0)):
        assert quality.measured(frame).count() == rows
        assert decontam.searched(frame, bench).filter("doc_id IS NULL").select(F.size(OWN + "items")).collect() == ([(1,)] if rows else [])
        assert langid.identified(frame).count() == rows
        assert pii.detected(frame).count() == rows
        assert licenses.scanned(frame).count() == rows
        assert neardup.assigned(frame).count() == rows
        assert token_output.round_trip(frame).count() == rows
        assert mixing.mixed(frame).count() == rows
        assert token_edits.counted(frame.select("doc_id", "text", F.expr("array(struct(0L AS start, 999999999L AS end, 'new' AS new))").alias("edits"))).count() == rows
    assert quality.filtered(docs).columns == docs.columns
    assert decontam.filtered(docs, bench).columns == docs.columns
    got = {r.doc_id: r.lang_pred for r in langid.identified(docs).collect()}
    assert got[2] == got[3] == got[10] == "und" and got[1] == "en"


def test_one_row_of_each_near_duplicate_class_stays(docs):
    kept = sorted((r.doc_id for r in neardup.filtered(docs).collect()), key=str)
    assert kept == sorted([1, 2, 3, 4, 5, 7, 9, 10, 11, None], key=str)
    cls = {r.doc_id: r.class_id for r in neardup.assigned(docs).collect()}
    assert cls[6] == 1 and cls[8] == 7


def test_base_spans(docs):
    r = pii.detected(docs).filter("doc_id = 9").first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    t = dict(ROWS)[9]
    want = [f"{k}:{t.index(s)}:{t.index(s) + len(s)}" for k, s in (("email", "a+b@c.de"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567"))]
    assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()


def test_files_hold_the_exact_ids(spark):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got, n = {r.doc_id: r for r in queries.op9_token_output(spark, SF).collect()}, 0
    for d in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = np.array(tok.encode(d.text, add_special_tokens=False).ids + [0], dtype="<u4")
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (n, len(ids), zlib.crc32(ids.tobytes()))
        n += len(ids)


TEXTS = ["a  b", " a\n \nb ", "x y z", "it's  \n\n ok", "", "é ü\t\tq", "a <|endoftext|> b", "x<|endoftext|>", "\n x", "a\n\n b c", "a\x1c b", "a \x1cb", "a\u2003 b c", "tail ", "  lead", "don't we'll '", " ", "\n\n", "x y z", "no spaces"]


def test_units_give_the_ids_of_the_whole_text():
    enc, tok = token_output.Encoder(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(2)
    more = ["".join(rng.choice(list("ab '\n\t.1é\u3000"), 60)) for _ in range(200)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in TEXTS + more]
    for _ in range(2):
        ids, n = enc.encode(pa.array(TEXTS + more))
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    ids, n = enc.encode(pa.array(TEXTS), 0)
    assert ids.tolist() == [i for w in want[: len(TEXTS)] for i in [*w, 0]] and n.sum() == len(ids)
    assert enc.encode(pa.array([], pa.string()), 0)[0].tolist() == []


def test_a_row_is_read_without_those_before_it(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j}" for j in range(400))) for i in range(300)], "doc_id long, text string").coalesce(1)
    shards = token_output.write(docs, f"file://{tmp_path}", P.path("byte_bpe_50k.json"), length=64)
    tok, every = Tokenizer.from_file(P.path("byte_bpe_50k.json")), []
    for r in docs.orderBy("doc_id").collect():
        every += [*tok.encode(r.text, add_special_tokens=False).ids, 0]
    assert sum(n for _, _, n in shards) == len(every)
    for name, before, n in shards:
        shard = token_output.Shard(name)
        rows = -(-n // 64)
        for r in sorted({0, 1, rows // 2, 255, 256, 257, rows - 1} & set(range(rows))):
            ids, mask = shard.row(r)
            want = every[before : before + n][r * 64 : r * 64 + 64]
            assert ids[mask].tolist() == want and mask.sum() == len(want)


def test_edited_counts_equal_counts_of_the_edited_text():
    enc, tok = token_output.Encoder(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    for base in ((BASE + "it's\n\n  Wide 123 ") * 40, "", "a b  c\n\n\nd " * 3, "x" * 500 + " " + "y" * 300, "word " * 3000, "\n\n  \n" * 30):
        text, tree = base, token_edits.Tree(base, enc)
        for k in range(60):
            a = int(rng.integers(0, len(text) + 5))
            b = a + int(rng.integers(0, (3, 12, 200)[k % 3]))
            new = ["", " ", "xyz", "'s", "\n\n", "12 ", " many more words " * 20][int(rng.integers(0, 7))]
            tree.edit(a, b, new)
            a = min(a, len(text))
            text = text[:a] + new + text[max(min(b, len(text)), a) :]
            assert tree.text() == text and tree.length == len(text)
            assert tree.count == len(tok.encode(text, add_special_tokens=False).ids)


def test_an_edit_touches_few_leaves_and_the_sums_above_them():
    enc = token_output.Encoder(P.path("byte_bpe_50k.json"))
    tree = token_edits.Tree("word " * 50_000 + "end", enc)
    old, blocks = list(tree.count_), set()
    put = tree.put
    tree.put = lambda b, *x: (blocks.add(b), put(b, *x))[1]
    tree.edit(100_000, 100_003, "new")
    assert tree.reencoded < 10 and len(blocks) <= 2
    changed = [i for i, (x, y) in enumerate(zip(old, tree.count_)) if x != y]
    assert len(changed) <= 2 * tree.size.bit_length() and tree.count == sum(tree.count_[tree.size :])


def test_edits_with_special_strings(spark):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(1, "a <|endoftext|> b", [(2, 3, "")]), (2, "a <|endoft b", [(10, 10, "ext|>")]), (3, "a <|endoXXftext|> b", [(7, 9, "")]), (4, None, [(0, 0, "<|endoftext|>")]), (5, "plain", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:bigint,end:bigint,new:string>>")
    got = {r.doc_id: (r.n_tokens, r.n_tokens_edited) for r in token_edits.counted(docs).collect()}
    for i, text, edits in rows:
        after = text or ""
        for a, b, new in edits or ():
            after = after[:a] + new + after[b:]
        assert got[i] == tuple(len(tok.encode(t, add_special_tokens=False).ids) for t in (text or "", after))


def test_alignment_finds_repeated_notices():
    s = licenses.Scanner()
    got = s.scan("words the of " * 50 + licenses.TEMPLATES["Apache-2.0"] + " the of is " * 30 + licenses.TEMPLATES["Apache-2.0"])
    assert [g[0] for g in got] == ["Apache-2.0"] * 2
    assert s.scan(None) == [] and s.scan("the of under is") == []


def test_forward_sums_all_segmentations():
    vocab = langid.vocabulary([b"a", b"b", b"ab", b"aba"])
    prob = np.array([[0.2, 0.1], [0.3, 0.2], [0.1, 0.6], [0.4, 0.1]])
    want = np.log(prob[0] * prob[1] * prob[0] + prob[2] * prob[0] + prob[3])
    assert langid.forward(b"aba", vocab, prob) == pytest.approx(want)
    assert langid.forward_many([b"aba"], vocab, prob)[0] == pytest.approx(want)
    long = [b"ab" * 30, b"ba" * 400]
    assert np.isfinite(langid.forward_many(long, vocab, prob)).all()
    many = [b"abab", b"babaab", b"ab" * 15]
    assert langid.forward_many(many, vocab, prob) == pytest.approx(np.array([langid.forward(w, vocab, prob) for w in many]))


def test_expectations_equal_those_over_all_segmentations(monkeypatch):
    vocab = langid.vocabulary([b"a", b"b", b"ab", b"ba", b"abb"])
    words = {b"abba": 3, b"abab": 2, b"b": 5, b"abb": 4}

    def cuts(w):
        return [[]] if not w else [[p, *rest] for p in vocab if w.startswith(p) for rest in cuts(w[len(p) :])]

    prob = dict.fromkeys(vocab, 1 / len(vocab))
    for _ in range(2):
        expected = dict.fromkeys(vocab, 0.01)
        for w, k in words.items():
            every = [(c, np.prod([prob[p] for p in c])) for c in cuts(w)]
            for c, x in every:
                for p in c:
                    expected[p] += k * x / sum(y for _, y in every)
        prob = {p: x / sum(expected.values()) for p, x in expected.items()}
    for together in (32, 0):
        monkeypatch.setattr(langid, "TOGETHER", together)
        got = langid.fit([langid.Counter(words)], vocab, 2)[:, 0]
        assert got == pytest.approx([prob[p] for p in vocab])


def test_number_characters_are_no_letters(spark):
    rows = [(i, "la de el que" if i % 2 else "the of and that", "es" if i % 2 else "en") for i in range(60)] + [(100, "½ ² ³ 12", None), (101, "the½of", None), (102, "the " + "of" * 3000, None)]
    got = {r.doc_id: r for r in langid.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[100].lang_pred, got[100].score) == ("und", 0.0) and got[101].lang_pred == "en" and got[102].lang_pred in ("en", "es")


def test_held_out_languages(spark):
    got = langid.identified(spark.read.parquet(f"{SF}/documents.parquet")).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_main_text_by_markup_and_by_repetition(spark):
    def page(i, body):
        return (i, f"https://h.example.com/{i}", body)

    foot = "<div><p>All prices in euro plus shipping and handling fees apply here</p></div>"
    rows = [page(i, f"<html><body><nav>Menu here</nav><div><p>Unique&nbsp;story   number {i} &amp; more</p></div>{foot}</body></html>") for i in range(5)]
    rows += [page(9, "<body><article><h1>T</h1><p>One<p>Two <b>b</b></article><div class='comments'>nice</div><footer>f</footer>"), page(10, None), page(10, "")]
    got = sorted((r.page_id, r.text) for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got[:5] == [(i, f"Unique story number {i} & more") for i in range(5)]
    assert got[5:] == [(9, "T One Two b"), (10, ""), (10, "")]


def test_flattened_mixing_covers_every_document(spark):
    rows = [(i, "w " * 20, "big" if i < 180 else "small") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.placed(d, target_entropy=0.9, max_epochs=4.0)
    n = {r.source: (r.n, r.d) for r in out.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).collect()}
    assert n["big"] == (180, 180) and n["small"][1] == 20 and 40 < n["small"][0] <= 80


def test_shares_meet_the_weights_and_the_order_is_of_blocks(spark, tmp_path):
    rows = [(i, "w " * (5 + i % 30), [None, "a", "b", "b", "b", "b", "b", "b"][i % 8], 1, "x", 2) for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, takes int, place string, `__gwx` int")
    out = mixing.placed(d, target_entropy=0.95).persist()
    by = out.groupBy("source").agg(F.sum(OWN + "tokens").alias("t"), F.first(OWN + "weight").alias("w"), F.first(OWN + "epochs").alias("e")).collect()
    total = sum(r.t for r in by)
    assert len(by) == 3 and all(abs(r.t / total - r.w) < 0.02 for r in by) and max(r.e for r in by) > 1.2
    h = -sum(r.w * np.log(r.w) for r in by) / np.log(3)
    assert h == pytest.approx(0.95, abs=0.01)
    # files hold the slots in ascending order, epochs of a block apart
    mixing.mixed(d, target_entropy=0.95).write.parquet(f"{tmp_path}/m")
    m = spark.read.parquet(f"{tmp_path}/m")
    assert m.columns == d.columns and m.count() == out.count()
    got = token_output.round_trip(m, order="files").orderBy("start").collect()
    want = out.orderBy(OWN + "slot", OWN + "key").select("doc_id").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    capped = mixing.placed(d, max_epochs=1.0, budget=10**9).select(OWN + "wanted", OWN + "epochs").first()
    assert capped[0] > capped[1] == 1.0
