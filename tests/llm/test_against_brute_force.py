"""Operators without SQL against plain versions of their contracts."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from tokenizers import Tokenizer

from gaugework.llm import html_extract, licenses, pii
from tests.llm.test_near_duplicates import components, shingle_list, similarity
from tests.oracle import SF

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        return 14 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base_spans(text):
    out = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if good(k, m[0])]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def test_base_spans_equal_the_patterns(spark):
    rng = np.random.default_rng(8)
    bits = ["a.b+c@d-e.co.uk", "x@y", "@", "1.2.3.4", "256.1.1.1", "10.20.30.40.50", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "12 34", "é", "token = \"0f\"", ".", " ", "-", "99", "a1"]
    rows = [(i, "".join(rng.choice(bits, int(rng.integers(0, 14))))) for i in range(600)] + [(1000, None), (1001, ""), (1002, "1" * 5000), (1003, "1.2." * 3000)]
    more = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(more)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.detected(docs).collect():
        want = base_spans(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), (text[r.doc_id], want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in PATTERNS]
        spans = r.spans.split(",") if r.spans else []
        assert set(f"{k}:{s}:{e}" for k, s, e in want) <= set(spans) and r.n_spans == len(spans) == len(want) + r.n_other


def row(**kw):
    return type("Row", (dict,), {"__getattr__": dict.__getitem__})(kw)


def test_trees_split_twice_and_thresholds_take_ties_together():
    table = [row(a=a, b=b, y=(10 + 5 * a) * (a != b), n=10 + 5 * a) for a in (0, 1) for b in (0, 1)]
    trees = pii.boosted(table, ["a", "b"], rounds=30)
    score = {(r["a"], r["b"]): sum(pii._value(t, r) for t in trees) for r in table}
    assert min(score[0, 1], score[1, 0]) > 1 > -1 > max(score[0, 0], score[1, 1])  # no sum of one-feature splits does that
    tied = [row(a=0, b=0, y=9, n=9), row(a=0, b=1, y=0, n=5), row(a=1, b=0, y=40, n=40)]
    assert pii.calibrated(tied, [("a", 1, 0.0, 1.0)]) == 1.0  # the two candidates at 0 are below 0.98 together
    assert pii.calibrated([row(a=0, b=0, y=0, n=3)], [("a", 1, 0.0, 1.0)]) == float("inf")


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_notices_with_words_removed_are_found(name):
    s, w, rng = licenses.Scanner(), licenses.words_of(licenses.TEMPLATES[name]), np.random.default_rng(3)
    if len(w) > 500:
        s = licenses.Scanner({name: licenses.TEMPLATES[name]})
    spare = len(w) - s.least[name]
    for k in range(6 if len(w) < 500 else 1):
        drop = set(rng.choice(len(w), spare, replace=False).tolist())
        text = [x for i, x in enumerate(w) if i not in drop]
        got = [g for g in s.scan(" ".join(["foo", *text, "bar"])) if g[0] == name]
        # the alignment may miss words that a full one finds; with no repeated word among the gaps it is exact
        pairs = licenses.aligned(["foo", *text, "bar"], w)
        assert bool(got) == (len(pairs) >= s.least[name]), (k, len(pairs), s.least[name])
        if spare < len(w):
            assert len(pairs) >= 0.95 * len(text)
    assert not [g for g in s.scan(" ".join(w[: max(0, s.least[name] - 1)])) if g[0] == name]


def test_alignment_equals_the_longest_one_on_unique_words():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = [f"w{x}" for x in rng.permutation(30)[:20]], [f"w{x}" for x in rng.permutation(30)[:20]]
        table = np.zeros((21, 21), dtype=int)
        for i in range(20):
            for j in range(20):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + (a[i] == b[j]))
        pairs = licenses.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(set(pairs)) and all(x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert len(pairs) == table[20, 20] or len(pairs) >= table[20, 20] - 2


PAGES = {
    "one <a title=\"x>link two": "one link two",
    "<p class=\"notice\">n<div>real</div>": "real",
    "<article><p>a</p><section class=\"share-price\"><p>b</p></section><div class='related-work'>c</div></article>": "a b c",
    "<article>x <math><mi>y</mi></math><select><option>z</select></article>": "x y",
    "<p>a < b &amp; c</p><!-- gone <p>x</p> --><p>d": "a < b & c d",
    "<body><nav>m</nav><div hidden>h</div><ul><li>a<li class=ad>b<li>c</ul><form>f</form>": "a c",
    "tail <a href='x": "tail",
    "<header>top</header><main><header>title</header><p>t</p><aside>s</aside></main><div id=comments>r</div>": "title t",
    "": "",
}


def test_markup(spark):
    rows = [(i, f"http://h{i}.org/", h) for i, h in enumerate(PAGES)] + [(99, None, None), (100, "http://h0.org/", "<a '" * 50_000), (101, "x", "<!-- x>" * 50_000 + "<p>end</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("runs", F.lit(1))
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extracted(frame).collect()}
    assert [got[i][0] for i in range(len(PAGES))] == list(PAGES.values())
    assert got[99] == ("", 0) and got[100][0] == "" and got[101][0] == "end"
    assert html_extract.extracted(frame.filter(F.lit(False))).count() == 0


def test_runs_equal_brute_force():
    rng = np.random.default_rng(6)
    pages = [" ".join(map(str, rng.integers(0, 3, int(n)))) for n in rng.integers(0, 60, 12)]
    import pandas as pd

    got = html_extract._classes(pd.DataFrame({"host": "h", "least": 1, "content": [str(i) for i in range(12)], "open": [[p] if p else [] for p in pages], "chrome": [[] for _ in pages], "inside": [[7, 7] if i % 3 == 0 else [] for i in range(12)]}))
    want = {}
    for i, p in enumerate(pages):
        w = p.split()
        for j in range(len(w) - html_extract.RUN + 1):
            want.setdefault(html_extract._run(w[j : j + html_extract.RUN]), set()).add(i)
        if html_extract.SHORT <= len(w) < html_extract.RUN:
            want.setdefault(html_extract._block(p), set()).add(i)
    want = {k: len(v) for k, v in want.items()} | {7: 4}
    assert dict(zip(got.run, got.pages)) == want


def test_repeated_blocks_of_articles_need_most_pages(spark):
    share = "Tell your friends about this"
    rows = [(i, "http://h.org/", f"<article><p>{' '.join(f'w{x}' for x in np.random.default_rng(i).integers(0, 9000, 40))}</p><p>{share}</p><p>{'Part of a series' if i < 4 else f'x{i}'}</p></article>") for i in range(12)]
    got = [r.text for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert not any(share in t for t in got) and sum("Part of a series" in t for t in got) == 4 and all(len(t.split()) > 40 for t in got)


def test_stages_equal_plain_versions(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("takes", F.lit(1)).withColumn("row", F.lit("x"))
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint"))).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(9999).cast("bigint")))
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "token output":
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{len(frames)}")
            out = spark.read.parquet(f"{tmp_path}/{len(frames)}")
        frames.append((docs.collect(), out.collect()))
        docs = out

    def repeated(w, h):
        seen = {}
        for i in range(len(w) - h + 1):
            seen.setdefault(tuple(w[i : i + h]), []).append(i)
        return len({p for v in seen.values() if len(v) > 1 for i in v for p in range(i, i + h)})

    def quality(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return len(w) >= 50 and 100 * repeated(w, 3) <= 50 * len(w) and repeated(w, 8) <= 0.3 * len(w) and not repeated(w, 64)

    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    before, after = frames[0]
    assert sorted(map(key, after)) == sorted(key(r) for r in before if quality(r.text)) and len(after) < len(before)
    before, after = frames[1]
    sh = [shingle_list(r.text) for r in before]
    cls = components(len(before), [(i, j) for i in range(len(sh)) for j in range(i) if similarity(sh[i], sh[j]) >= 0.8])
    assert sorted(map(key, after)) == sorted(min(key(before[i]) for i in range(len(cls)) if cls[i] == c) for c in set(cls))
    before, after = frames[2]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    wins = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        wins |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    sizes = {len(x) for x in wins}
    clean = [r for r in before if not any(tuple(w[i : i + n]) in wins for w in [words(r.text)] for n in sizes for i in range(len(w) - n + 1))]
    assert sorted(map(key, after)) == sorted(map(key, clean)) and len(clean) < len(before)
    before, after = frames[3]
    assert {key(r) for r in after} == {key(r) for r in before}
    tok, n = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    text = {r.doc_id: r.text for r in frames[4][0]}
    rows = sorted(frames[4][1], key=lambda r: r.start)
    assert len(rows) == len(frames[4][0]) and [r.doc_id for r in rows] != sorted(text, key=str)
    for r in rows:
        ids = np.array([*tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (n, len(ids), zlib.crc32(ids.tobytes()))
        n += len(ids)
