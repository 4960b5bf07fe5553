import math
import re
from collections import Counter

import numpy as np
import pytest

from convolake.llm import lm_scoring


def brute(rows, discount=0.4):
    split = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    pairs = [Counter(zip([None, *words], words, strict=False)) for words in split]
    one, two = Counter(), Counter()
    for words, own in zip(split, pairs, strict=True):
        one.update(words)
        two.update(own)
    total, begins = sum(one.values()), sum(1 for w in split if w)
    out = []
    for (doc, _), words, own in zip(rows, split, pairs, strict=True):
        score, back = 0.0, 0
        for (a, b), n in own.items():
            if two[(a, b)] > n:
                score += n * math.log10(two[(a, b)] / (begins if a is None else one[a]))
            else:
                score += n * math.log10(discount * one[b] / total)
                back += n
        out.append((doc, len(words), back, score))
    return out


@pytest.mark.parametrize(("flush", "hot_share"), [(10**9, 0.01), (300, 0.01), (300, 1.0), (2000, 1e-9)])
def test_brute_force(docs, doc_rows, monkeypatch, flush, hot_share):
    monkeypatch.setattr(lm_scoring, "FLUSH_WORDS", flush)
    monkeypatch.setattr(lm_scoring, "BLOCK_WORDS", 500)
    rows = [(r[0], r[1]) for r in doc_rows] + [(None, "null id here"), (5, "ONE two three"), (None, "null id here"), (7000, "hm hm hm hm " * 400)]
    spark = docs.sparkSession
    own = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    own.count()
    got = sorted(((r.doc_id, r.n_words, r.n_backoff, r.score) for r in lm_scoring.lm_scores(own, hot_share=hot_share).collect()), key=str)
    own.unpersist()
    want = sorted(brute(rows), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-5)
    copy = [g for g in got if g[0] is None]
    assert copy[0] == copy[1] and copy[0][2] == 0 and copy[0][1] == 3


def test_a_pair_that_most_texts_hold(spark):
    rows = [(i, f"very common w{i % 97} tail{i}") for i in range(600)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_backoff, round(r.score, 4)) for r in lm_scoring.lm_scores(own, hot_share=0.05).collect())
    assert got == sorted((d, n, b, round(s, 4)) for d, n, b, s in brute(rows))


def test_empty(no_docs):
    assert lm_scoring.lm_scores(no_docs).count() == 0


def test_clashing_columns(spark):
    rows = [(1, "a b c", 1, 2), (2, "a b d", 3, 4), (3, None, None, None)]
    got = {r.doc_id: r for r in lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string, w1 long, n long")).collect()}
    assert got[1].n_backoff == 1 and got[3].score == 0 and got[3].n_words == 0


def test_arrays_travel():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert (lm_scoring.unpack_array(lm_scoring.pack_array(x)) == x).all()
        assert (lm_scoring.unpack_array(lm_scoring.pack_array(np.sort(x), True)) == np.sort(x)).all()
