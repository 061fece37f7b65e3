"""Corpus operators on the cases a reduced job would miss."""

import numpy as np
import pytest

from gaugework.llm import decontam, html_extract, licenses, pii
from gaugework.llm.common import OWN


@pytest.mark.parametrize("name, end", [("MIT-text", "dealings in the software"), ("BSD", "possibility of such damage"), ("ISC", "performance of this software"), ("Apache-2.0-text", "limitations under the license"), ("GPL-3.0-text", "licenses why not lgpl html")])
def test_coverage_is_of_the_whole_license(name, end):
    t = licenses.words_of(licenses.TEMPLATES[name])
    assert end in " ".join(t[-12:])
    s = licenses.Scanner()
    got = {x[0]: x for x in s.scan("some words before " + licenses.TEMPLATES[name] + " and after")}
    assert got[name][1:] == (3, 3 + len(t), 1.0)
    assert name not in {x[0] for x in s.scan(" ".join(t[: len(t) // 2]))}


def test_every_notice_line_is_found(spark):
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "All rights reserved."]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: (r.text or "").lower() for r in docs.collect()}
    got = {r.doc_id: r.n_notices for r in licenses.scanned(docs).collect()}
    want = {k: any(x.lower().rstrip(".") in t for x in lines) for k, t in text.items()}
    assert {k: n > 0 for k, n in got.items()} == want and sum(lines[4].lower() in t for t in text.values()) == 7


def pages_of(spark, bodies):
    rows = [(i, f"https://h.example.com/{i}", f"<body>{b}</body>") for i, b in enumerate(bodies)]
    got = html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [t for _, t in sorted((r.page_id, r.text) for r in got)]


def prose(seed, n):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5_000, n))


def test_copies_of_a_page_keep_their_text(spark):
    foot = "<div>All prices in euro plus shipping and handling fees apply here</div>"
    same, near = prose(1, 80), [prose(2, 80).split() for _ in range(4)]
    for k, w in enumerate(near):
        w[20 * k] = f"edit{k}"
    texts = [same] * 5 + [" ".join(w) for w in near] + [prose(10 + k, 80) for k in range(4)]
    assert pages_of(spark, [f"<div>{t}</div>{foot}" for t in texts]) == texts
    assert pages_of(spark, [f"<div>{same}</div>"] * 3) == [same] * 3


def test_a_phrase_needs_a_share_of_the_host(spark):
    foot, menu = "<div>All prices in euro plus shipping and handling fees apply here</div>", "<div>Read all about our many terms</div>"
    phrase = "as we said at the very start of this long report"
    texts = [f"{prose(100 + k, 30)} {phrase if k < 6 else prose(200 + k, 11)} {prose(300 + k, 30)}" for k in range(60)]
    assert pages_of(spark, [f"{menu}<div>{t}</div>{foot}" for t in texts]) == texts


def test_secrets_after_a_key_word_are_found(spark):
    rng = np.random.default_rng(4)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(60)]
    form = ['token = "%s"', "TOKEN = %s", "api_key: '%s'", "secret=%s", 'password : "%s"']
    rows = [(i, f"some words here {form[i % 5] % h} and more") for i, h in enumerate(hexes)]
    rows += [(100 + i, f"plain words of model number{i}x{i * 7919}abc and part {i}-word-list-{i}, nothing else") for i in range(300)]
    got = {r.doc_id: r.spans for r in pii.detected(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, h in enumerate(hexes):
        at, t = rows[i][1].index(h), rows[i][1]
        start = t.index("secret=") if "secret=" in t else at
        assert got[i] == f"other:{start}:{at + 40}", (t, got[i])
    assert not any(got[100 + i] for i in range(300))


def test_token_lines_of_the_documents_are_found(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: set(r.spans.split(",")) for r in pii.detected(docs).collect()}
    want = [(r.doc_id, f"other:{m.start(1)}:{m.end(1)}") for r in docs.collect() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text or "")]
    assert want and all(s in got[i] for i, s in want)


def test_items_without_an_id_still_hit(spark):
    bench = spark.createDataFrame([(None, "one two three four"), (7, "five six"), (8, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a one two three four b"), (2, "five six seven"), (3, "clean text")], "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in decontam.searched(docs, bench).select("doc_id", decontam.n_hit(), OWN + "items").collect()}
    assert got == {1: (4, []), 2: (2, ["7"]), 3: (0, [])}
    assert [r.doc_id for r in decontam.filtered(docs, bench).collect()] == [3]
