import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convolake.llm import embed_dedup, langid, quality_model

RNG = random.Random(9)


def prose(letters, n):
    return " ".join("".join(RNG.choice(letters) for _ in range(RNG.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        word = prose("qrs", 1)
        bad = RNG.choice([prose("#*$&xyz", 50), " ".join([word] * 50)])
        rows.append((i, prose("abcdefgh", 50) if good else bad, "clash", 1.0))
        if i < 300:
            labels.append((i, int(good) if i != 7 else None, 0))
    rows += [(900, None, None, None), (901, "", None, None), (None, prose("abcdefgh", 30), None, None), (5, rows[5][1], None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_learns_and_holds_out(labelled):
    docs, labels = labelled
    rows = quality_model.classify_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r for r in rows}
    import zlib

    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    unseen = [r for r in rows if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in unseen]) > 0.9
    assert got[900].score == got[901].score


def test_quality_scores_whole_texts_alike_in_any_batching(labelled):
    docs, labels = labelled
    model = quality_model.fit(quality_model.training_sample(docs, labels, 300))
    a = {r.doc_id: r.score for r in quality_model.score_quality(docs.repartition(1), model).collect()}
    b = {r.doc_id: r.score for r in quality_model.score_quality(docs.repartition(7), model).collect()}
    assert a == pytest.approx(b, abs=1e-9)


def test_quality_scores_against_brute_force(labelled):
    """Every score from the definition: hashes of words and code point n-grams, one by one."""
    import math
    import re

    docs, labels = labelled
    model = quality_model.fit(quality_model.training_sample(docs, labels, 300), buckets=4096)
    mask, p = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def bucket(text):
        x = sum((b + 1) * pow(p, i, 1 << 64) for i, b in enumerate(text.encode())) & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return ((x ^ x >> 31) >> 20) % 4096

    extra = [(2000, "é ßß naïve naïve\t漢字かな交じり文 😀😀😀 a\x85b", None, None), (2001, "z" * 3000, None, None)]
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id < 60 or doc_id >= 900").collect()] + [e[:2] for e in extra]
    got = quality_model.score_quality(docs.where("doc_id < 60 or doc_id >= 900").union(docs.sparkSession.createDataFrame(extra, docs.schema)), model).collect()
    want = []
    for doc, text in rows:
        found = []
        for w in re.findall("[^\x20\x09-\x0d]+", text or ""):
            own = f"<{w}>"
            found += [bucket(w), *(bucket(own[i : i + n]) for n in range(model.lo, model.hi + 1) for i in range(len(own) - n + 1))]
        x = [sum(float(model.vectors[f, d]) for f in found) / max(1, len(found)) / model.spread[d] for d in range(8)]
        logit = model.bias + sum(model.out[d] * v + model.out[8 + d] * math.log1p(v * v) for d, v in enumerate(x))
        want.append((doc, 1 / (1 + math.exp(-logit))))
    key = lambda r: (r[0], round(r[1], 6))
    assert [r[0] for r in sorted(got, key=key)] == [r[0] for r in sorted(want, key=key)]
    assert [r[1] for r in sorted(got, key=key)] == pytest.approx([r[1] for r in sorted(want, key=key)], abs=1e-9)


def test_quality_without_labels_or_rows(labelled, no_docs):
    docs, labels = labelled
    none = labels.where("false")
    assert {r.score for r in quality_model.classify_quality(docs, none).collect()} == {0.5}
    assert quality_model.classify_quality(no_docs, labels).count() == 0


@pytest.fixture(scope="module")
def spoken(spark):
    kinds = {"aa": "abcde", "bb": "cdefg", "çc": "éèfgh"}
    rows = []
    for i in range(300):
        lang = list(kinds)[i % 3]
        rows.append((i, prose(kinds[lang], RNG.choice([20, 80])), lang if i % 11 else None, "s"))
    rows += [(500, None, "aa", "s"), (501, "", "bb", "s"), (502, "12 34 !! ²", "aa", "s"), (503, prose("abcde", 100) + " " + prose("éèfgh", 100), None, "s"), (None, prose("abcde", 30), "aa", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_languages(spoken):
    rows = langid.identify_languages(spoken).collect()
    assert len(rows) == 305
    got = {r.doc_id: r for r in rows}
    held = [got[i] for i in range(300) if got[i].held_out]
    assert len(held) > 40 and np.mean([r.lang_pred == ["aa", "bb", "çc"][r.doc_id % 3] for r in held]) > 0.97
    for i in (500, 501, 502):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert set(got[503].lang_set) == {"aa", "çc"} and 0.4 < got[503].score < 0.6
    assert got[None].lang_pred == "aa" and got[None].held_out is False


def test_mixture_is_a_maximum(spoken):
    """The proportions found beat all on a grid, for documents of two languages."""
    model = langid.fit(langid.training_sample(spoken, 100))
    import pyarrow as pa

    from convolake.llm.kernels import texts

    text = prose("abcde", 60) + " " + prose("éèfgh", 30)
    ((_, _, t),) = texts(pa.array([text]))
    pi = model.proportions(t)[0]
    bucket, word, which, _, n = langid._word_grams(t, len(model.logp), model.lo, model.hi)
    each = np.stack([np.bincount(word, model.logp[bucket, j], n) for j in range(3)], 1) * model.temper
    like = np.exp(each - each.max(1, keepdims=True))[which]
    score = lambda p: np.log(like @ p).sum()
    grid = [np.array([a, 0, 1 - a]) for a in np.linspace(0.01, 0.99, 50)]
    assert score(pi) >= max(map(score, grid)) - 0.05


def test_languages_without_rows(no_docs):
    assert langid.identify_languages(no_docs).count() == 0
    assert langid.keep_identified(no_docs).count() == 0


def vectors(n=600, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(n // 3, n):
        x[i] = x[rng.integers(0, n // 6)] + rng.normal(size=dim) * 0.08
    return x.astype(np.float32)


@pytest.fixture(scope="module")
def vector_rows():
    x = vectors()
    rows = [(i, [float(v) for v in e], i % 4) for i, e in enumerate(x)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, [None] + [1.0] * 23, 1), (2004, [float("inf")] + [1.0] * 23, 1), (2005, [1.0], 1), (2006, [2 * v for v in rows[3][1]], 0), (2007, [-v for v in rows[3][1]], 0)]
    return rows


def brute_links(rows, threshold=0.95):
    good = {i: np.array(e, float) for i, e, _ in rows if e is not None and len(e) == 24 and None not in e and np.isfinite(np.array(e, float)).all() and any(e)}
    ids = sorted(good)
    x = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    return ids, near


@pytest.mark.parametrize("options", [{}, {"tables": 3, "radius": 2}, {"exact": True}])
def test_near_dedup_recall_and_counts(spark, vector_rows, options):
    rows = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(vector_rows, "vec_id long, embedding array<float>, label int"), **options).collect()}
    assert len(rows) == len(vector_rows)
    ids, near = brute_links(vector_rows)
    want = dict(zip(ids, near.sum(1), strict=True))
    got = {i: rows[i].n_links for i in ids}
    assert all(got[i] <= want[i] for i in ids)
    assert sum(got.values()) >= 0.9 * sum(want.values())
    if "exact" in options:
        assert got == want
    assert got[3] >= 41  # its copies, and the vector twice as long
    for i in (2000, 2001, 2002, 2003, 2004, 2005):
        assert (rows[i].n_links, rows[i].component_id, rows[i].kept) == (0, i, True)
    for r in rows.values():
        assert r.kept == (r.component_id == r.vec_id) and r.component_id <= r.vec_id
        assert (r.component_id == r.vec_id and r.n_links == 0) or rows[r.component_id].n_links > 0


def test_near_dedup_empty(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_four_languages_are_found_and_the_share_counts(spark):
    kinds = {"aa": "abcd", "bb": "efgh", "cc": "ijkl", "dd": "mnop", "ee": "qrst"}
    rows = [(i, prose(kinds[lang], 60), lang) for i, lang in enumerate(list(kinds) * 30)]
    even = " ".join(prose(kinds[lang], 100) for lang in ("aa", "bb", "cc", "dd"))
    every = " ".join(prose(letters, 100) for letters in kinds.values())
    most = prose(kinds["ee"], 200) + " " + " ".join(prose(kinds[lang], 60) for lang in ("aa", "bb", "cc"))
    three = " ".join(prose(kinds[lang], 100) for lang in ("aa", "bb")) + " " + prose(kinds["cc"], 110)
    rows += [(900, even, None), (901, every, None), (902, most, None), (903, three, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify_languages(docs).collect()}
    assert set(got[900].lang_set) == {"aa", "bb", "cc", "dd"} and 0.2 < got[900].score < 0.3
    assert set(got[901].lang_set) == set(kinds) and 0.15 < got[901].score < 0.25
    assert set(got[902].lang_set) == {"aa", "bb", "cc", "ee"} and got[902].lang_pred == "ee" and 0.45 < got[902].score < 0.6
    assert set(got[903].lang_set) == {"aa", "bb", "cc"}
    kept = {r.doc_id for r in langid.keep_identified(docs).collect()}
    assert {900, 901}.isdisjoint(kept) and {902, 903} <= kept and len(kept) == len(rows) - 2


def test_texts_of_no_learned_language_go(spark):
    """Another script and noise are likelier by chance; a document keeps its place and gets the language found."""
    kinds = {"aa": "abcd", "bb": "efgh"}
    rows = [(i, prose(kinds[lang], 60), lang if i % 5 else None, "s") for i, lang in enumerate(list(kinds) * 60)]
    rows += [(900, prose("иклмнопрст", 60), None, "s"), (901, prose("uvwxyz#0987", 80), None, "s"), (902, prose("abcd", 90) + " " + prose("uvwxyz", 9), None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    kept = {r.doc_id: r for r in langid.keep_identified(docs).collect()}
    assert {900, 901}.isdisjoint(kept) and len(kept) == len(rows) - 2
    assert kept[902].lang == "aa" and all(kept[i].lang == ("aa", "bb")[i % 2] for i in range(120))
    assert all(kept[i].text == t and kept[i].score == "s" for i, t, _, _ in rows if i in kept)


def plain_proportions(model, text):
    """The language model's prediction for one text, word by word and without arrays of n-grams."""
    import math
    import re

    mask, p, buckets = (1 << 64) - 1, 0x9E3779B97F4A7C15, len(model.logp)

    def bucket(raw):
        x = sum((b + 1) * pow(p, i, 1 << 64) for i, b in enumerate(raw)) & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return ((x ^ x >> 31) >> 20) % buckets

    k = len(model.languages)
    rows, grams = [], 0
    for w in re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
        raw = w.encode()
        if not any(65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in raw):
            continue
        own = b"<" + raw + b">"
        found = [bucket(own[i : i + n]) for n in range(model.lo, model.hi + 1) for i in range(len(own) - n + 1)]
        rows.append([sum(model.logp[f][j] for f in found) for j in range(k)])
        grams += len(found)
    above = sum(max(r) for r in rows) + grams * math.log(buckets)
    rows = [[v * model.temper for v in r] for r in rows]
    like = [[math.exp(max(v - max(r), -60)) for v in r] for r in rows]

    def em(allowed):
        pi = [1 / len(allowed) if j in allowed else 0.0 for j in range(k)]
        for _ in range(model.rounds):
            total = [0.0] * k
            for r in like:
                s = sum(a * b for a, b in zip(r, pi, strict=True))
                for j in range(k):
                    total[j] += r[j] * pi[j] / s
            pi = [t / len(like) for t in total]
        return pi, sum(math.log(max(sum(a * b for a, b in zip(r, pi, strict=True)), 1e-300)) for r in like)

    alone = [sum(math.log(r[j]) for r in like) for j in range(k)]
    first = max(range(k), key=lambda j: (alone[j], -j))
    best, value = [float(j == first) for j in range(k)], alone[first]
    order = sorted(range(k), key=lambda j, pi=em(range(k))[0]: (-pi[j], j))
    for size in range(2, k + 1):
        pi, score = em(order[:size])
        score -= model.penalty * (size - 1) * math.log(len(like) + 1)
        if score > value:
            best, value = pi, score
    return best, above


def test_predictions_against_a_plain_version(spoken):
    import pyarrow as pa

    from convolake.llm.kernels import texts

    model = langid.fit(langid.training_sample(spoken, 60), buckets=2048)
    rows = ["abc", "ÉÈ fgh 12 abcde", prose("abcde", 30) + " " + prose("éèfgh", 25), prose("cdefg", 40) + "\n\t" + prose("abcde", 20) + " " + prose("éèfgh", 20), "漢字 xyz " * 5, prose("cde", 9)]
    ((_, _, t),) = texts(pa.array(rows))
    pi, above = model.judge(t)
    for text, got, excess in zip(rows, pi, above, strict=True):
        want, chance = plain_proportions(model, text)
        assert got == pytest.approx(want, abs=1e-9) and excess == pytest.approx(chance, abs=1e-6)


def test_very_long_texts_are_judged_whole(spoken, labelled):
    """A text said two thousand times scores as once, and a language in its last part is found."""
    import pyarrow as pa

    from convolake.llm.kernels import texts

    docs, labels = labelled
    model = quality_model.fit(quality_model.training_sample(docs, labels, 300))
    base = prose("abcdefgh", 100) + " "
    scores = [float(model.score(t)[0]) for x in (base, base * 2000) for _, _, t in texts(pa.array([x]))]
    assert scores[0] == pytest.approx(scores[1], abs=1e-6)
    lang = langid.fit(langid.training_sample(spoken, 100))
    long = prose("abcde", 3000) + (" " + prose("abcde", 500)) * 200 + (" " + prose("éèfgh", 500)) * 100
    ((_, _, t),) = texts(pa.array([long]))
    pi = dict(zip(lang.languages, lang.proportions(t)[0], strict=True))
    assert 0.6 < pi["aa"] < 0.75 and 0.25 < pi["çc"] < 0.4


def test_near_dedup_with_clashing_columns_and_one_id_for_two_vectors(spark, vector_rows):
    plain = spark.createDataFrame(vector_rows, "vec_id long, embedding array<float>, label int")
    clash = spark.createDataFrame([(*r, 1, 2, 3, 4.0) for r in vector_rows], "vec_id long, embedding array<float>, label int, rep int, code int, n int, unit double")
    own = lambda df: sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect())
    assert own(plain) == own(clash)
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [-1.0, 0.0], 0), (None, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    got = embed_dedup.near_duplicates(twice, exact=True).collect()
    assert len(got) == 5
    by = {r.vec_id: (r.n_links, r.component_id) for r in got}
    assert by[1] == (1, 1) and by[2][1] == 1 and by[3] == (0, 3) and by[None][1] is None


def test_no_task_sends_a_sample_of_its_own(spark):
    v = spark.range(-100, 60_000, numPartitions=9).select(F.col("id").alias("vec_id"))
    near = embed_dedup.hashed_first(v, 60_100, 2000)
    assert 2000 <= near.count() < 2600  # of 9 x 2000 that nine partitions would send
    first = lambda d: [r.vec_id for r in d.orderBy(F.xxhash64("vec_id"), "vec_id").limit(2000).collect()]
    assert first(near) == first(v)
    assert embed_dedup.hashed_first(v, 60_100, 60_000).count() == 60_100


def test_joins_of_vectors_broadcast_nothing(spark):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<float>")
    assert "Broadcast" not in embed_dedup.near_duplicates(v)._jdf.queryExecution().executedPlan().toString()
    few = v.withColumn("vec_id", F.col("vec_id") % 2)  # two ids of many rows
    assert embed_dedup.near_duplicates(few, sample_rows=3).count() == 60
