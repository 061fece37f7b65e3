"""License scans by patience alignment.

Templates are whole license texts (license_texts/) and the one-line notices that stand for them.

A template is aligned with the stretch of words around each place that could hold it. Words that occur once in both are
anchors; the longest increasing run of their positions is kept, and the gaps between anchors are aligned in the same way,
after equal words at their ends. Coverage is the share of the template's words that are aligned.

A place is looked for wherever a text has enough of the template's words: as at most a known number of them may be
missing, one of the rarest few words is aligned, and the stretch of the template's length around each of its places (and
as many words more as may be missing) is aligned. Places of one template don't overlap: of those that could, the first
counts. Places of different templates may.

Defined cases: a null or empty text holds no license; a notice inside a whole text counts beside it; repeated rows and
repeated notices each count; spans that start together come in the order of their names; texts are read whole; a
template without words is never found; an empty table gives no rows; other columns are unused.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

COVERAGE = 0.8

#: Public license notices, and the public license texts in whole.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Reserved": "All rights reserved.",
    "MIT-opening": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-opening": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-opening": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
} | {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of equal words, increasing in both, by patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        na, nb = Counter(a[i:j]), Counter(b[k:m])
        where = {w: p for p, w in enumerate(b[k:m], k) if nb[w] == 1}
        anchors = [(p, where[w]) for p, w in enumerate(a[i:j], i) if na[w] == 1 and w in where]
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for x, (_, q) in enumerate(anchors):
            at = bisect_left(tails, q)
            back.append(ends[at - 1] if at else -1)
            tails[at : at + 1] = [q]
            ends[at : at + 1] = [x]
        chain, x = [], ends[-1] if ends else -1
        while x >= 0:
            chain.append(anchors[x])
            x = back[x]
        if not chain:
            continue
        out += chain
        chain = [(i - 1, k - 1), *chain[::-1], (j, m)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(chain, chain[1:])]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> None:
        self.templates = {k: words_of(v) for k, v in templates.items()}
        self.coverage = coverage
        self.kinds = {k: set(t) for k, t in self.templates.items()}
        self.counts = {k: Counter(t) for k, t in self.templates.items()}
        self.wanted = set().union(*self.kinds.values())
        #: Words of a template that must be aligned, at least.
        self.least = {k: math.ceil(coverage * len(t) - 1e-9) for k, t in self.templates.items()}

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(license, first word, end word, coverage) of each place that reaches the coverage."""
        words = words_of(text or "")
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.wanted:
                at.setdefault(w, []).append(i)
        out = []
        sizes = {w: len(p) for w, p in at.items()}
        n_wanted = sum(sizes.values())
        for name, t in self.templates.items():
            counts, least = self.counts[name], self.least[name]
            if not t or n_wanted < least or sum([min(n, sizes.get(w, 0)) for w, n in counts.items()]) < least:
                continue
            # so many words must be aligned that one of the rarest few is among them
            spare = len(t) - least + 1
            rare = sorted(self.kinds[name], key=lambda w: (sizes.get(w, 0), w))
            picked: Counter = Counter()
            for w in rare:
                picked[w] = counts[w]
                if sum(picked.values()) >= spare:
                    break
            seen = -1
            for p in sorted({i for w in picked for i in at.get(w, ())}):
                if p < seen:
                    continue
                lo = max(0, seen, p - len(t) - spare)
                have = Counter(words[lo : p + len(t) + spare])
                if sum(min(n, have[w]) for w, n in counts.items()) < least:
                    continue
                pairs = aligned(words[lo : p + len(t) + spare], t)
                if len(pairs) >= least:
                    out.append((name, lo + pairs[0][0], lo + pairs[-1][0] + 1, len(pairs) / len(t)))
                    seen = lo + pairs[-1][0] + 1
        return sorted(out, key=lambda x: (x[1], x[0]))


def _scan(batches: Iterator[pa.RecordBatch], coverage: float, templates: dict[str, str]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(templates, coverage)
    for b in batches:
        got = [scanner.scan(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(g) for g in got], pa.int64()), pa.array([",".join(sorted({x[0] for x in g})) for g in got], pa.string()), pa.array([",".join(f"{n}:{s}:{e}" for n, s, e, _ in g) for g in got], pa.string()), pa.array([max((x[3] for x in g), default=0.0) for g in got], pa.float64())],
            names=["doc_id", "n_notices", "licenses", "spans", "best_coverage"],
        )


def scanned(docs: DataFrame, coverage: float = COVERAGE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, n_notices, licenses, spans in words, best_coverage) for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _scan(it, coverage, templates), f"doc_id {kind}, n_notices bigint, licenses string, spans string, best_coverage double")
