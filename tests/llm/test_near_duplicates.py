"""Near-duplicate classes against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.llm import neardup


def shingle_list(text):
    w = text.lower().split()
    k = min(5, len(w))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []


def similarity(a, b):
    """By the whole table of common subsequences; 0 where even the common shingles rule a link out."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < 0.8 * max(n, m) or len(set(a) & set(b)) < 0.6 * len(set(a)):
        return 0.0
    row = np.zeros(m + 1, dtype=int)
    ids = {}
    x = [ids.setdefault(s, len(ids)) for s in a]
    y = np.array([ids.setdefault(s, len(ids)) for s in b])
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == v)))
    return row[-1] / (n + m - row[-1])


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def texts():
    rng, out = np.random.default_rng(11), []
    for size in (6, 9, 12, 14, 20, 40, 90, 200, 400):
        for group in range(5):
            base = [f"w{x}" for x in rng.integers(0, 30_000, size)]
            out.append(" ".join(base))
            for k in range(14):
                w, at = list(base), rng.integers(0, size, 1 + int(k * size / 400))
                for i in at:
                    kind, i = int(rng.integers(0, 4)), min(i, len(w) - 1)
                    if kind == 0:
                        w[i] = f"e{rng.integers(0, 10**9)}"
                    elif kind == 1:
                        w.insert(i, f"e{rng.integers(0, 40)}")
                    elif kind == 2 and len(w) > 1:
                        del w[i]
                    else:
                        w.append(f"e{rng.integers(0, 10**9)}")
                out.append(" ".join(w))
    return out


def test_classes_equal_the_components_of_all_pairs(spark):
    ts = texts()
    sh = [shingle_list(t) for t in ts]
    sims = {(i, j): similarity(sh[i], sh[j]) for i in range(len(ts)) for j in range(i) if abs(i - j) < 15}
    links = [p for p, s in sims.items() if s >= 0.8]
    spread = np.histogram([sims[p] for p in links], bins=[0.8, 0.85, 0.9, 0.95, 1.01])[0]
    assert len(links) >= 500 and (spread > 25).all()
    want = components(len(ts), links)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in neardup.assigned(docs).collect()}
    joined = sum(got[a] == got[b] for a, b in links)
    assert joined >= 0.99 * len(links), (joined, len(links))
    # no class holds texts that all pairs keep apart
    assert all(want[i] == want[got[i]] for i in got)


def test_strangers_in_a_large_group_of_copies(spark):
    """Copies with many edits share buckets with their group but are similar to none or few of it."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 500, 80)]
    ts = []
    for k in range(300):
        w = list(base)
        for i in rng.choice(80, 1 + k % 5, replace=False):
            w[i] = f"e{rng.integers(0, 60)}"
        ts.append(" ".join(w))
    ts = list(dict.fromkeys(ts))
    sh = [shingle_list(t) for t in ts]
    links = [(i, j) for i in range(len(ts)) for j in range(i) if similarity(sh[i], sh[j]) >= 0.8]
    want = components(len(ts), links)
    got = {r.doc_id: r.class_id for r in neardup.assigned(spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "doc_id long, text string")).collect()}
    assert 1 < len(set(want)) < len(ts)
    assert sum(got[a] == got[b] for a, b in links) >= 0.995 * len(links)
    assert all(want[i] == want[got[i]] for i in got)


def test_classes_of_further_links_deal_out_only_what_is_new(spark):
    """A large class, chains of classes and pairs that fail, found in three steps of links."""
    from gaugework.llm.common import Scratch

    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in range(60)]
    same, other = " ".join(base), " ".join(f"o{x}" for x in range(60))
    keys = [bytes(rng.integers(0, 256, 16, dtype=np.uint8)) for _ in range(400)]
    rows = [(k, neardup.word_hashes(f"{other if i % 10 == 9 else same} {'e' * (i % 3)}").tobytes()) for i, k in enumerate(keys)]
    pick = lambda few: [tuple(sorted((keys[i], keys[j]))) for i, j in few if i != j]
    steps = [pick((min(range(200), key=lambda i: keys[i]), j) for j in range(200)), pick((i, i + 1) for i in range(200, 399)), pick(rng.integers(0, 400, (150, 2)).tolist())]
    like = {k: i % 10 == 9 for i, k in enumerate(keys)}
    place = {k: i for i, k in enumerate(keys)}
    sc, held = spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sc.setJobGroup("merged", "merged")
        with Scratch(spark) as scratch:
            link, every = neardup._Linker(scratch.written(spark.createDataFrame(rows, "tk binary, w binary"), "words"), scratch), []
            for few in steps:
                every += [(place[a], place[b]) for a, b in few if like[a] == like[b]]
                link.test(spark.createDataFrame(few, "a binary, b binary"))
                want = components(400, every)
                got = {bytes(r.v): bytes(r.c) for r in link.labels.collect()}
                assert len(got) == link.labels.count()
                least = {}
                for i, c in enumerate(want):
                    least[c] = min(least.get(c, keys[i]), keys[i])
                assert got == {keys[i]: least[c] for i, c in enumerate(want) if least[c] != keys[i]}
        status = sc.statusTracker()
        stages = {s for j in status.getJobIdsForGroup("merged") for s in status.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(status.getStageInfo, stages) if i)
        assert tasks < 2000, tasks
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("kind, ids", [("string", ["b", "a", None, "c"]), ("long", [2, 1, None, 3])])
def test_ids_of_any_type_nulls_and_clashing_columns(spark, kind, ids):
    text = "one two three four five six seven eight nine ten"
    rows = [(i, t, 1, 2, 3) for i, t in zip([*ids, ids[0], ids[0], None], [text, text + " ", text, None, "", "", None])]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, tk int, root int, best int")
    got = sorted((str(r.doc_id), str(r.class_id)) for r in neardup.assigned(docs).collect())
    least = str(ids[1])
    assert got.count((str(ids[0]), least)) == 1 and got.count((least, least)) == 1 and ("None", least) in got
    kept = neardup.filtered(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted([least, str(ids[3]), str(ids[0])])
    assert neardup.filtered(docs.filter(F.lit(False))).count() == 0


def test_scratch_tables_go_after_failures_too(spark, tmp_path):
    from gaugework.llm.common import Scratch, shared_dir

    import os

    root = shared_dir(spark).removeprefix("file://") + "/gaugework"
    os.makedirs(root, exist_ok=True)
    before = set(os.listdir(root))
    with pytest.raises(ZeroDivisionError):
        with Scratch(spark) as scratch:
            scratch.written(spark.range(3), "x")
            1 / 0  # noqa: B018
    assert set(os.listdir(root)) == before
    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine {i % 3}") for i in range(9)], "doc_id long, text string")
    neardup.assigned(docs).count()
    left = set(os.listdir(root)) - before
    assert {x.split("-")[0] for x in left} == {"classes"}
