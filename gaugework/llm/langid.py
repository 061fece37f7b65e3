"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces, by a forward pass over its UTF-8 bytes (the word with the space before it); a text's is
the product over its words. Probabilities come from expectation-maximisation on word counts. Words are runs of letters
(Unicode category L) of the lower-cased text, by the same function in training and prediction; pieces that hold ASCII
characters other than letters and a first space are in no word, so all segmentations of a word are summed.

The training sample is bounded: about SAMPLE_DOCS labelled documents a language, chosen by a hash of the id and read
whole. Every text is scored whole; score is the share of the predicted language in the sum of all languages'
likelihoods.

Defined cases: texts that are null or have no letters get `und` with score 0; of equal likelihoods the first language by
name wins; null doc_ids count as the empty text where rows are dealt; words repeat, so each worker keeps a bounded table
of word scores; repeated rows alike; no labelled row at all gives `und` everywhere; an empty table gives no rows; other
columns are unused.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from gaugework.llm.common import claim, doc_bucket

SAMPLE_DOCS, ROUNDS = 600, 3
CACHE_WORDS = 400_000
#: Bytes up to which words of one length are scored together without logarithms, within the range of a double.
TOGETHER = 32
_WORDS, _LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
_OTHER = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
_KNOWN: dict[bytes, np.ndarray] = {}


class Vocabulary(dict):
    """Pieces by their number, and the bytes of the longest."""

    longest = 1


def vocabulary(pieces_: list[bytes]) -> Vocabulary:
    """All pieces that can stand in a word behind a space; single bytes are always among them."""
    kept = Vocabulary((p, i) for i, p in enumerate(p for p in pieces_ if not _OTHER.search(p.removeprefix(b" "))))
    kept.longest = max(map(len, kept), default=1)
    return kept


def pieces(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return vocabulary(sorted(ranks, key=ranks.__getitem__))


def forward(word: bytes, vocab: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """Log probability of the word in each language, summed over all segmentations; prob: piece x language. In
    logarithms, so that words of any length keep their value."""
    get, n = vocab.get, len(word)
    alpha = np.full((n + 1, prob.shape[1]), -np.inf)
    alpha[0] = 0.0
    for e in range(1, n + 1):
        hit = [(s, p) for s in range(max(0, e - vocab.longest), e) if (p := get(word[s:e])) is not None]
        if hit:
            ss, ps = zip(*hit)
            alpha[e] = np.logaddexp.reduce(alpha[list(ss)] + np.log(prob[list(ps)]), axis=0)
    return alpha[n]


def _spans(words: list[bytes], n: int, vocab: Vocabulary) -> list[tuple[int, int, np.ndarray]]:
    """(start, end, piece of each word) of the places in words of n bytes where any has a piece; len(vocab): none."""
    get, none, out = vocab.get, len(vocab), []
    for e in range(1, n + 1):
        for s in range(max(0, e - vocab.longest), e):
            ids = np.fromiter((get(w[s:e], none) for w in words), dtype=np.int64, count=len(words))
            if (ids != none).any():
                out.append((s, e, ids))
    return out


def _by_length(words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
    """(length, places) of words of one length, a few thousand at a time."""
    every: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        every.setdefault(len(w), []).append(i)
    for n, at in every.items():
        for lo in range(0, len(at), 4000):
            yield n, at[lo : lo + 4000]


def forward_many(words: list[bytes], vocab: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """forward() of many words at once: words of one length share each step over their positions."""
    out = np.zeros((len(words), prob.shape[1]))
    padded = np.vstack([prob, np.zeros((1, prob.shape[1]))])
    for n, at in _by_length(words):
        if n > TOGETHER:
            for i in at:
                out[i] = forward(words[i], vocab, prob)
            continue
        alpha = np.zeros((n + 1, len(at), prob.shape[1]))
        alpha[0] = 1.0
        for s, e, ids in _spans([words[i] for i in at], n, vocab):
            alpha[e] += alpha[s] * padded[ids]
        out[at] = np.log(np.maximum(alpha[n], 1e-300))
    return out


def fit(counts: list[Counter], vocab: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of each language from its word counts, by forward-backward expectation over all languages and
    words of one length at once; in logarithms where words are longer than TOGETHER."""
    words = sorted({w for c in counts for w in c})
    times = np.array([[c[w] for c in counts] for w in words], dtype=np.float64).reshape(len(words), len(counts))
    prob = np.full((len(vocab), len(counts)), 1.0 / max(len(vocab), 1))
    groups = [(n, np.array(at), _spans([words[i] for i in at], n, vocab)) for n, at in _by_length(words)]
    for _ in range(rounds):
        expected = np.full((len(vocab) + 1, len(counts)), 0.01)
        padded = np.vstack([prob, np.zeros((1, len(counts)))])
        with np.errstate(divide="ignore"):
            logs = np.log(padded)
        for n, at, spans in groups:
            if n > TOGETHER:
                a, b = np.full((n + 1, len(at), len(counts)), -np.inf), np.full((n + 1, len(at), len(counts)), -np.inf)
                a[0] = b[n] = 0.0
                for s, e, ids in spans:
                    a[e] = np.logaddexp(a[e], a[s] + logs[ids])
                for s, e, ids in reversed(spans):
                    b[s] = np.logaddexp(b[s], b[e] + logs[ids])
                for s, e, ids in spans:
                    np.add.at(expected, ids, np.exp(a[s] + logs[ids] + b[e] - a[n]) * times[at])
                continue
            a, b = np.zeros((n + 1, len(at), len(counts))), np.zeros((n + 1, len(at), len(counts)))
            a[0] = b[n] = 1.0
            for s, e, ids in spans:
                a[e] += a[s] * padded[ids]
            for s, e, ids in reversed(spans):
                b[s] += b[e] * padded[ids]
            weight = times[at] / np.where(a[n] > 0, a[n], np.inf)
            for s, e, ids in spans:
                np.add.at(expected, ids, a[s] * padded[ids] * b[e] * weight)
        prob = expected[:-1] / expected[:-1].sum(axis=0)
    return prob


def words_of(text: str) -> Counter:
    """Words with the space before them, and how often they occur."""
    out: Counter = Counter()
    for w, k in Counter(_WORDS.findall(text.lower())).items():
        if w.isalpha():
            out[b" " + w.encode()] += k
        else:  # number characters that are no digits
            for x in _LETTERS.findall(w):
                out[b" " + x.encode()] += k
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(lang, w, k) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w, k in words_of(t or "").items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64()))], names=["lang", "w", "k"])


def train(docs: DataFrame, vocab: Vocabulary) -> tuple[list[str], np.ndarray]:
    own = docs.filter(doc_bucket() != 2).filter("lang IS NOT NULL").select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)).alias("h"))
    have = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not have:
        return [], np.zeros((len(vocab), 0))
    limit = F.create_map(*[F.lit(x) for k, n in have.items() for x in (k, int(min(1.0, SAMPLE_DOCS / n) * 1_000_003) + 1)])
    sample = own.filter(F.col("h") < limit[F.col("lang")])
    words = sample.select("lang", "text").mapInArrow(_counts, "lang string, w binary, k bigint").groupBy("lang", "w").agg(F.sum("k").alias("k"))
    langs = sorted(have)
    counts: dict[str, Counter] = {k: Counter() for k in langs}
    for r in words.collect():
        counts[r.lang][bytes(r.w)] = r.k
    return langs, fit([counts[k] for k in langs], vocab)


def _score(batches: Iterator[pa.RecordBatch], langs: list[str], model: np.ndarray, path: str) -> Iterator[pa.RecordBatch]:
    vocab = pieces(path)
    prob = model.astype(np.float64)
    claim("langid", _KNOWN.clear)
    _KNOWN.clear()
    for batch in batches:
        texts = batch.column(2).to_pylist()
        out_lang: list[str] = []
        out_score: list[float] = []
        for lo in range(0, len(texts), 400):
            bags = [words_of(t or "") for t in texts[lo : lo + 400]]
            if len(_KNOWN) > CACHE_WORDS:
                _KNOWN.clear()
            miss = list({w for b in bags for w in b if w not in _KNOWN})
            if miss and langs:
                _KNOWN.update(zip(miss, forward_many(miss, vocab, prob)))
            for bag in bags:
                if not bag or not langs:
                    out_lang.append("und")
                    out_score.append(0.0)
                    continue
                ll = np.array([_KNOWN[w] for w in bag]).T @ np.fromiter(bag.values(), dtype=np.float64)
                best = int(ll.argmax())
                out_lang.append(langs[best])
                out_score.append(1.0 / math.fsum(np.exp(np.maximum(ll - ll[best], -700.0))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out_lang, pa.string()), pa.array(out_score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def identified(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    langs, model = train(docs, pieces(path))
    small = model.astype(np.float32)
    own = docs.select("doc_id", (doc_bucket() == 2).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(lambda it: _score(it, langs, small, path), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
