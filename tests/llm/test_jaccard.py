import itertools
import re
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

from convolake.llm import jaccard
from convolake.llm.common import shared_dir
from convolake.llm.kernels import texts


def sets_of(rows, words):
    out = {}
    for doc, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[doc] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    return out


def brute(rows, words, percent):
    sets = sets_of(rows, words)
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            label[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (1, 80)])
def test_brute_force(docs, doc_rows, words, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, words=words, percent=percent).collect()}
    assert got == brute([(r[0], r[1]) for r in doc_rows], words, percent)


def test_chains_link(spark):
    """Each text differs a little from the one before, so the ends link only through the others."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(12):
        rows.append((100 - k, " ".join(words)))
        words[17 * k % 200] = f"new{k}"
        words[(17 * k + 60) % 200] = f"also{k}"
    rows += [(500, " ".join(f"z{i}" for i in range(200))), (None, rows[0][1]), (7, rows[3][1]), (7, rows[3][1])]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = brute([r for r in rows if r[0] is not None], 3, 90)
    for r in got:
        assert r.component_id == (want[r.doc_id][1] if r.doc_id is not None else 7)


def test_no_link_is_lost():
    """Pairs at the bound of any size share a key."""
    rng = np.random.default_rng(2)
    for percent in (90, 80):
        for n in [*range(5, 60), 75, 100, 240, 600, 2000]:
            base = [f"{rng.integers(1 << 40)}" for _ in range(n)]
            drop = n - -(-n * percent // 100)  # J = (n - drop) / n
            other = base[: n - drop]
            swap = max(0, int(Fraction(100 - percent, 100 + percent) * n))
            third = base[: n - swap] + [f"x{rng.integers(1 << 40)}" for _ in range(swap)]
            import pyarrow as pa

            (_, _, t), = texts(pa.array([" ".join(x) for x in (base, other, third)]))
            s, offsets = jaccard.shingle_sets(t, 1)
            keys, owner = jaccard.block_keys(s, offsets, percent)
            own = [set(keys[owner == i].tolist()) for i in range(3)]
            for k, x in ((1, other), (2, third)):
                if x != base and 100 * len(set(base) & set(x)) >= percent * len(set(base) | set(x)):
                    assert own[0] & own[k], (percent, n, k)


def test_empty(no_docs):
    assert jaccard.jaccard_components(no_docs).count() == 0


def test_short_sets_make_no_hot_keys():
    """Unrelated sets of a few shingles share next to no keys, and sets whose shingles fall into one block still link."""
    rng = np.random.default_rng(4)
    for n in (4, 5, 8, 12, 20):
        s = np.sort(rng.integers(0, 1 << 63, (20_000, n)).astype(np.uint64), axis=1)
        keys, _ = jaccard.block_keys(s.ravel(), np.arange(20_001) * n, 80)
        assert np.unique(keys, return_counts=True)[1].max() <= 3
    low = np.arange(1, 6, dtype=np.uint64)  # upper halves are 0, so the first deal puts all into one block
    keys, owner = jaccard.block_keys(np.concatenate([low[:4], low]), np.array([0, 4, 9]), 80)
    assert set(keys[owner == 0]) & set(keys[owner == 1])


def test_scan_of_keys_gives_each_group_once():
    """Groups within and across batches, and rows that are grouped already."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    p = np.sort(rng.integers(0, 300, 1000))
    p[400:700] = p[400]  # over many batches
    p.sort()
    ids = np.arange(1000)
    done = rng.random(1000) < 0.2
    has = ~done & (rng.random(1000) < 0.1)
    table = pa.RecordBatch.from_arrays([pa.array(p), pa.array(ids), pa.array(ids, mask=~done), pa.array(np.where(done, ids, p), mask=~(done | has))], names=["p", "id", "lo", "key"])
    for size in (1, 3, 64, 2000):
        out = [r for b in jaccard.shared_keys(table.slice(i, size) for i in range(0, 1000, size)) for r in b.to_pylist()]
        assert sorted(r["id"] for r in out if r["key"] == r["id"] == r["lo"] and done[r["id"]]) == ids[done].tolist()
        rest = [r for r in out if not done[r["id"]]]
        want = {k: set(ids[(p == k) & ~done].tolist()) for k in np.unique(p)}
        got = {}
        for r in rest:
            got.setdefault(r["key"], []).append(r)
        assert {k: {r["id"] for r in v} for k, v in got.items()} == {k: v for k, v in want.items() if len(v) > 1 or has[list(v)].any()}
        assert all(len(v) == len(want[k]) and {r["lo"] for r in v} == {min(want[k])} for k, v in got.items())


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_large_groups_of_near_copies(spark, words, percent):
    """Near copies of one text, some too far apart to link, over many runs of documents; extra columns clash."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for k in range(400):
        own = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            own[rng.randrange(80)] = f"n{rng.randrange(30)}"
        rows.append((k * 3 % 401, " ".join(own), 1, "k"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep int, key string").repartition(37)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, words=words, percent=percent).collect()}
    assert got == brute([r[:2] for r in rows], words, percent)
    kept = jaccard.keep_one(docs, words=words, percent=percent)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()})


def test_a_cluster_without_a_shared_folder_fails():
    from unittest.mock import MagicMock

    from convolake.llm import common

    spark = MagicMock()
    spark.conf.get.return_value = None
    spark.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    spark.sparkContext.master = "yarn"
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(spark)


def test_tables_that_are_read_no_more_leave_the_disk(spark, monkeypatch):
    there, made = {}, jaccard.materialize

    def materialize(df, name):
        out = made(df, name)
        there[name] = {x.name.rsplit("-", 1)[0] for x in Path(out._table.removeprefix("file://")).parent.iterdir() if x.name not in start}
        return out

    start = {x.name for x in Path(jaccard_dir(spark)).iterdir()}
    monkeypatch.setattr(jaccard, "materialize", materialize)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 3) * 7 + k}" for k in range(40)) + f" x{i}") for i in range(120)], "doc_id long, text string")
    _, links = jaccard.jaccard_links(docs)
    assert links.count() >= 80
    assert "signs" in there["members"] and "signs" not in there["shared"]
    assert "shared" in there["labelled"] and "shared" not in there["several"]


def jaccard_dir(spark):
    return shared_dir(spark).removeprefix("file://")
