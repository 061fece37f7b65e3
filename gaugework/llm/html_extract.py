"""Main-text extraction with a host suffix array.

A page becomes blocks in page order, each of one kind: chrome (within a menu, header, footer, sidebar, form, notice,
advert or comment section, as the markup names it), article (within an article or main element), or open. The token
streams of a host's pages (chrome and open blocks, and article blocks as one symbol each, the hash of the block) are
concatenated in shards; a shard's suffix array, built by prefix doubling to RUN tokens, groups the positions that start
the same run. Shards send one row for each run class, with its number of pages, so a hot host is split over shards and a
common run costs a row a shard. Runs on a share of the host's distinct pages (SHARE, at least MIN_PAGES) are boilerplate,
and so are blocks of SHORT to RUN - 1 tokens as a whole: the tokens they cover are removed and unique runs stay. A block
of an article goes only as a whole, and only where INSIDE_SHARE of the host's pages (at least INSIDE_PAGES) hold it.
Markup settles what repetition leaves: unique runs of chrome go, all others stay.

Distinct pages are what counts: pages with the same open and article blocks are one, and so are near copies, of which
only the one with the least content hash enters the suffix arrays. Near copies have a Jaccard similarity of COPY or more
of their word pairs (exact up to SKETCH pairs, estimated beyond); they are looked for under the least content of each of
BANDS sketch buckets, so a pair at 0.85 is missed with a chance near 0.003, and more often where bucket mates are no
copies. As a run needs a share of the host's pages, a host has at most 1 / SHARE times as many as a mean page.

Tags are read in one pass that goes back nowhere: an unclosed quote or comment ends at the next >, a tag that never ends
is dropped with what follows.

Defined cases: null html is empty; a null url is a host of its own; pages without body text give an empty text; repeated
rows each give a row and count as one page; a run that only other near copies hold isn't counted; pages of any length are
read whole; page_id keeps its type; an empty table gives no rows; other columns are unused.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gaugework.llm.common import Scratch, salted_join, small, written

RUN, SHORT, MIN_PAGES, SHARE = 8, 2, 3, 0.2
INSIDE_PAGES, INSIDE_SHARE = 5, 0.5
COPY, SKETCH, BANDS, ROWS = 0.85, 256, 10, 5
SHARD_PAGES = 1_000
#: Runs up to which the hosts' lists are broadcast, 8 MB. Pages whose content a task remembers.
BROADCAST_RUNS, REMEMBERED = 1_000_000, 50_000
CHROME, OPEN, ARTICLE = 0, 1, 2

#: Elements of HTML.
_DROP = frozenset("script style template noscript svg iframe object select textarea button head title audio video canvas".split())
_RAW = frozenset("script style textarea title noscript template iframe".split())
_ASIDE = frozenset("nav header footer aside form dialog menu".split())
_BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert form".split())
#: What an opening tag closes, up to the elements that bound it.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NO_P = frozenset("br body html td th tr tbody thead tfoot".split())
#: Class names that markup uses for chrome: every part of the name is a word of one of the lists, one of the first.
_CHROME_WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice newsletter subscribe signup popup modal sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments replies disqus share sharing social related login pagination pager".split())
_PLACE_WORDS = frozenset("site page main global top bottom left right side box bar area section list item items block wrapper wrap container inner outer slot link links post posts thread form buttons row text".split())
_OPENING = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))|(?=[\s/]|$))", re.I)
_ENDS = {tag: re.compile(f"</{tag}[\\s/>]", re.I) for tag in _RAW}


def _named(name: str) -> bool:
    parts = re.split("[-_]+", name.strip("-_").lower())
    return any(p in _CHROME_WORDS for p in parts) and all(p in _CHROME_WORDS or p in _PLACE_WORDS for p in parts)


def _is_chrome(attrs: str) -> bool:
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key == "role" and value.lower() in _ROLE or key == "hidden" or key == "aria-hidden" and value == "true" or key in ("class", "id") and any(map(_named, value.split())):
            return True
    return False


def _tags(html: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag, closing, attributes) of each tag, and at last the rest with an empty tag."""
    at, n, start = 0, len(html), 0
    none_after: set[str] = set()  # marks that the rest of the page doesn't hold, so that each is sought to the end once

    def end_of(mark: str, pos: int) -> int:
        found = -1 if mark in none_after else html.find(mark, pos)
        if found < 0:
            none_after.add(mark)
        return found + len(mark) if found >= 0 else 0

    while (lt := html.find("<", at)) >= 0:
        nxt = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            end = end_of("-->", lt + 4) or end_of(">", lt) or n
        elif nxt in ("!", "?"):
            end = html.startswith("<![CDATA[", lt) and end_of("]]>", lt) or end_of(">", lt) or n
        else:
            m = _OPENING.match(html, lt)
            if not m:  # a < of the text
                at = lt + 1
                continue
            pos = m.end()
            while True:
                stop = _STOP.search(html, pos)
                if not stop:
                    yield html[start:lt], "", False, ""
                    return
                q = stop[0]
                if q == ">":
                    break
                pos = stop.end()
                if html[stop.start() - 1 : stop.start()] in ("=", " ", "\n", "\t"):
                    pos = end_of(q, pos) or pos
            tag = m[1].lower()
            closing = nxt == "/"
            yield html[start:lt], tag, closing, html[m.end() : stop.start()]
            at = start = stop.end()
            if tag in _RAW and not closing:
                end_tag = _ENDS[tag].search(html, at)
                at = start = end_tag.start() if end_tag else n
            continue
        yield html[start:lt], "!", False, ""
        at = start = end
    yield html[start:], "", False, ""


def blocks(html: str) -> list[tuple[int, str]]:
    """(kind, text) of each block, in page order; a block's text has single spaces."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, dropped, chrome, article
    depth = [0, 0, 0]
    text: list[str] = []

    def close() -> None:
        nonlocal text
        if text:
            t = " ".join(unescape("".join(text)).split())
            if t:
                out.append((CHROME if depth[1] else ARTICLE if depth[2] else OPEN, t))
            text = []

    def pop(i: int) -> None:
        for x in stack[i:]:
            for k in range(3):
                depth[k] -= x[k + 1]
        del stack[i:]

    def shut(tags: set | frozenset, bounds: set | frozenset) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in bounds:
                return
            if stack[i][0] in tags:
                pop(i)
                return

    for before, tag, closing, attrs in _tags(html):
        if before and not depth[0]:
            text.append(before)
        if tag == "!":
            continue
        if not tag:
            break
        if tag in _BLOCK:
            close()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if (depth[1] or depth[2]) and any(x[2] or x[3] for x in stack[i:]):
                        close()
                    pop(i)
                    break
            continue
        if tag in _BLOCK and tag not in _NO_P:
            shut({"p"}, {"table", "td", "th", "body", "article", "main", "section", "div"})
        if tag in _CLOSES:
            shut(*_CLOSES[tag])
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            continue
        article = tag in ("article", "main") or bool(attrs) and re.search(r"""role\s*=\s*["']?main\b""", attrs) is not None
        # a header inside an article holds its title
        chrome = tag in _ASIDE and not (tag == "header" and depth[2]) or bool(attrs) and not article and tag not in ("body", "html") and _is_chrome(attrs)
        if chrome or article:
            close()
        x = (tag, tag in _DROP, chrome, article)
        stack.append(x)
        for k in range(3):
            depth[k] += x[k + 1]
    close()
    return out


_ODD = np.random.default_rng(7).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def _pairs(words: list[str]) -> np.ndarray:
    """Hashes of the different word pairs."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(h) < 2:
        return np.unique(h)
    return np.unique((h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ ((h[1:] << np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)))


def bands(words: list[str]) -> list[int]:
    """A hash of each band of minima."""
    h = _pairs(words)
    # the upper halves of multiplied hashes, so that each minimum has an order of its own
    least = np.array([((h * a + b) >> np.uint64(16)).min() for a, b in _ODD.T] if len(h) else np.zeros(BANDS * ROWS), dtype=np.uint64)
    return [xxhash.xxh64_intdigest(least[i : i + ROWS].tobytes()) - 2**63 for i in range(0, len(least), ROWS)]


def sketched(words: list[str]) -> list[int]:
    """The least SKETCH hashes of word pairs."""
    return (_pairs(words)[:SKETCH] ^ np.uint64(2**63)).view(np.int64).tolist()


def _text_of(found: list[tuple[int, str]]) -> list[str]:
    return [t for k, t in found if k != CHROME]


def _content(found: list[tuple[int, str]]) -> bytes:
    return xxhash.xxh3_128_digest("\n".join(_text_of(found)))


def _words(found: list[tuple[int, str]]) -> list[str]:
    return [w for t in _text_of(found) for w in t.split()]


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a page sends to its host's suffix array, with the hash of its content and its bands. A page whose content
    the task has seen on the host sends nothing."""
    ints, texts = pa.list_(pa.int64()), pa.list_(pa.string())
    seen: set[tuple[str, bytes]] = set()
    for b in batches:
        rows = []
        for i, (host, html) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
            found = blocks(html or "")
            key = host, _content(found)
            if key in seen:
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(key)
            rows.append((i, key[1], bands(_words(found)), *([t for k, t in found if k == kind] for kind in (OPEN, CHROME)), [_block(t) for k, t in found if k == ARTICLE]))
        at, *cols = zip(*rows) if rows else [[]] * 6
        own = b.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *[pa.array(c, t) for c, t in zip(cols, (pa.binary(), ints, texts, texts, ints))]], names=["page_id", "host", "content", "bands", "open", "chrome", "inside"])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [blocks(h or "") for h in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_content, got), pa.binary()), pa.array([sketched(_words(g)) for g in got], pa.list_(pa.int64()))], names=["host", "content", "sketch"])


def _similar(a, b):
    """Jaccard similarity of two sets by their least hashes: the share in both of the least SKETCH of the union."""
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both)


def representatives(sent: DataFrame, pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, content) of the distinct pages; of near copies, those with no copy of a lesser content. Sketches are made
    of pages that share a band with another page of the host alone. pages: page_id, host, html."""
    one = sent.groupBy("host", "content").agg(F.first("bands").alias("bands"))
    many = one.select("host", "content", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("host", "band", "value").alias("bucket"), "content", F.xxhash64("host").alias("of"))
    lead = many.groupBy("bucket").agg(F.min("content").alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = scratch.written(many.join(small(lead), "bucket").filter("lead < content").select("of", "lead", "content").distinct(), "met")
    ends = met.select("of", "content").union(met.select("of", "lead")).distinct()
    ids = sent.withColumn("of", F.xxhash64("host")).join(small(ends), ["of", "content"], "left_semi").select("page_id").distinct()
    some = pages.join(small(ids), "page_id", "left_semi").select("host", "html")
    sk = some.mapInArrow(_sketch, "host string, content binary, sketch array<bigint>").withColumn("of", F.xxhash64("host"))
    sk = scratch.written(sk.groupBy("of", "content").agg(F.first("host").alias("host"), F.first("sketch").alias("sketch")), "sketches")
    both = met.join(sk, ["of", "content"]).join(sk.select("of", F.col("content").alias("lead"), F.col("host").alias("other_host"), F.col("sketch").alias("other")), ["of", "lead"]).filter("host = other_host")
    copies = both.filter(_similar(F.col("sketch"), F.col("other")) >= COPY).select("host", "content").distinct()
    return one.select("host", "content").join(small(copies), ["host", "content"], "left_anti")


def suffix_classes(ids: np.ndarray, left: np.ndarray, run: int) -> np.ndarray:
    """Rank of each position's prefix of run tokens in the suffix array (-1 where the page ends before)."""
    rank, h = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    n = len(ids)
    while h < run:
        step = min(h, run - h)
        ok = np.flatnonzero(left >= h + step)
        key = np.full(n, -1, dtype=np.int64)
        key[ok] = np.unique(rank[ok] * np.int64(n + 1) + rank[ok + step], return_inverse=True)[1]
        rank, h = key, h + step
    return np.where(left >= run, rank, -1)


def _run(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) - 2**63


def _block(text: str) -> int:
    """Key of a block as a whole, apart from those of runs."""
    return xxhash.xxh64_intdigest("\n" + text) - 2**63


def _classes(pdf):
    """One shard of a host: (host, run, pages) of each class of runs and of each whole block, by distinct pages. Where the
    shard is the whole host, only of those on as many pages as least."""
    import pandas as pd

    pdf = pdf.drop_duplicates("content")
    words, owner, whole = [], [], Counter()
    for k, (open_, chrome, inside) in enumerate(zip(pdf.open, pdf.chrome, pdf.inside)):
        keys = set(inside)
        for t in (*open_, *chrome):
            w = t.split()
            words += w
            owner += [k] * len(w)
            if SHORT <= len(w) < RUN:
                keys.add(_block(t))
        whole.update(keys)
    runs, pages = [], []
    if words:
        known: dict[str, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
        own = np.array(owner)
        ends = np.searchsorted(own, own, side="right")
        cls = suffix_classes(ids, ends - np.arange(len(ids)), RUN)
        at = np.flatnonzero(cls >= 0)
        both = np.unique(np.stack([cls[at], own[at]]), axis=1)
        kinds, first = np.unique(cls[at], return_index=True)
        pages = np.bincount(np.searchsorted(kinds, both[0]), minlength=len(kinds)).tolist()
        runs = [_run(words[at[i] : at[i] + RUN]) for i in first]
    out = pd.DataFrame({"host": pdf.host.iloc[0], "run": [*runs, *whole], "pages": [*pages, *whole.values()]}).astype({"run": "int64", "pages": "int64"})
    return out[out.pages >= pdf.least.iloc[0]]


def _rest(words: list[str], gone: bytearray) -> list[str]:
    """The words left of a block. A run that only reaches into the block from a neighbour takes nothing of it: covered
    stretches go if they are RUN long or the whole block."""
    out, i = [], 0
    while i < len(words):
        j = i
        while j < len(words) and gone[j] == gone[i]:
            j += 1
        if not gone[i] or j - i < min(RUN, len(words)):
            out += words[i:j]
        i = j
    return out


def cleaned(kinds: list[int], texts: list[str], outer: set[int], inner: set[int]) -> str:
    """The page's open and article blocks without what the runs cover."""
    stream = [w for k, t in zip(kinds, texts) if k == OPEN for w in t.split()] if outer else []
    gone = bytearray(len(stream))
    for i in range(len(stream) - RUN + 1):
        if _run(stream[i : i + RUN]) in outer:
            gone[i : i + RUN] = b"\x01" * RUN
    out, at = [], 0
    for k, t in zip(kinds, texts):
        if k == ARTICLE:
            if not inner or _block(t) not in inner:
                out.append(t)
            continue
        if not outer:
            out.append(t)
            continue
        w = t.split()
        rest = [] if SHORT <= len(w) < RUN and _block(t) in outer else _rest(w, gone[at : at + len(w)])
        at += len(w)
        if rest:
            out.append(" ".join(rest))
    return " ".join(out)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for html, outer, inner in zip(*(b.column(c).to_pylist() for c in (2, 3, 4))):
            found = [x for x in blocks(html or "") if x[0] != CHROME]
            texts.append(cleaned([k for k, _ in found], [t for _, t in found], set(outer or ()), set(inner or ())))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, run_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) for each page. Texts of articles are never shuffled: hosts get the open and chrome
    blocks, a third read of the pages cleans them."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    kind = pages.schema["page_id"].dataType.simpleString()
    own = pages.select("page_id", "url", host.alias("host"), "html")
    with Scratch(pages.sparkSession) as scratch:
        sent = scratch.written(own.select("page_id", "host", "html").mapInArrow(_streams, f"page_id {kind}, host string, content binary, bands array<bigint>, open array<string>, chrome array<string>, inside array<bigint>"), "streams")
        reps = scratch.written(representatives(sent, own.select("page_id", "host", "html"), scratch), "pages")
        n = scratch.written(reps.groupBy("host").agg(F.count("*").alias("n")), "hosts")
        least = F.greatest(F.lit(run_pages), F.ceil(F.col("n") * share))
        shards = F.ceil(F.col("n") / SHARD_PAGES).cast("bigint")
        part = sent.drop("page_id", "bands").join(small(reps), ["host", "content"], "left_semi").join(small(n), "host")
        part = part.select("host", "content", F.pmod(F.xxhash64("content"), shards).alias("shard"), F.when(shards > 1, 1).otherwise(least).cast("bigint").alias("least"), "open", "chrome", "inside")
        classes = part.groupBy("host", "shard").applyInPandas(_classes, "host string, run bigint, pages bigint")
        # whole blocks of articles count against the higher limit wherever they stand
        found = classes.groupBy("host", "run").agg(F.sum("pages").alias("pages")).join(small(n), "host").filter(F.col("pages") >= least)
        inner = F.col("pages") >= F.greatest(F.lit(INSIDE_PAGES), F.ceil(F.col("n") * INSIDE_SHARE))
        common = written(found.groupBy("host").agg(F.collect_list("run").alias("outer"), F.collect_list(F.when(inner, F.col("run"))).alias("inner")), "runs")
    bound = common.agg(F.coalesce(F.sum(F.size("outer") + F.size("inner") + 8), F.lit(0))).first()[0] <= BROADCAST_RUNS
    join = own.join(F.broadcast(common), "host", "left") if bound else salted_join(own, common, "host", F.col("page_id"), "left")
    return join.select("page_id", "url", "html", "outer", "inner").mapInArrow(_clean, f"page_id {kind}, url string, text string, n_chars bigint")
