"""Every stage of the pipeline, each on the rows its predecessor kept, against a plain version."""

import re

import pytest
from test_jaccard import brute
from test_pii import base_spans
from test_sql_oracles import run as run_sql

import corpus_pipeline
from convolake.llm import langid, mixing
from convolake.llm.queries import PACK_TOKENIZER, tokenizer_path

DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, doc_rows, tmp_path_factory):
    """(rows in, rows out) of each stage."""
    extra = [(2000, "reach me at jo@site.example or +1 (212) 555-0187 today or tomorrow", "en", "s1", 9), (2001, "1234 5678", "en", "s2", 9)]
    rows = [r[:5] for r in doc_rows] + extra
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out, before = {}, [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, "")
        path = str(tmp_path_factory.mktemp(name) / "t")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        after = [tuple(r) for r in docs.collect()]
        out[name] = (before, after, docs.columns)
        before = after
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    for name in list(stages)[:-1]:
        assert stages[name][2] == DOCS


def test_language(stages, spark):
    before, after, _ = stages["language_id"]
    model = langid.fit(sorted_sample(before))
    keep = []
    for r in before:
        if r[1] and re.search(r"[^\W\d_]", r[1]):
            pi, above = model.judge(one_text(r[1]))
            if pi[0].max() >= langid.LEAST_SHARE and above[0] >= 0:
                keep.append((*r[:2], model.languages[pi[0].argmax()], *r[3:]))
    assert sorted(after) == sorted(keep)
    assert 2001 not in {r[0] for r in after} and 2000 in {r[0] for r in after}


def one_text(text):
    import pyarrow as pa

    from convolake.llm.kernels import texts

    ((_, _, t),) = texts(pa.array([text]))
    return t


def sorted_sample(rows):
    import zlib

    own = [r for r in rows if r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    return [(r[1], r[2]) for r in sorted(own, key=lambda r: (r[0], r[1], r[2]))]


def test_near_duplicates(stages):
    before, after, _ = stages["near_duplicates"]
    want = brute([(r[0], r[1]) for r in before], 5, 80)
    assert sorted(after) == sorted(r for r in before if want[r[0]][1] == r[0])


def test_pii(stages):
    before, after, _ = stages["pii"]
    got = {r[0]: r for r in after}
    assert len(after) == len(before)
    for r in before:
        text, want = r[1], r[1]
        for span in reversed(base_spans(text)):
            kind, a, b = span.split(":")
            want = want[: int(a)] + f"<{kind.upper()}>" + want[int(b) :]
        assert got[r[0]][1] == want and got[r[0]][4] == len(want) and got[r[0]][2:4] == r[2:4]


def test_mixing(stages):
    before, after, _ = stages["mixing"]
    plan = run_sql(mixing.ORACLE_SQL, [(*r, None, None, None) for r in before])
    own = {r[0]: r for r in before}
    want = sorted(own[p["doc_id"]] for p in plan for _ in range(p["epochs"]))
    assert sorted(after, key=str) == sorted(want, key=str)


def test_packing(stages):
    from collections import Counter, defaultdict

    from tokenizers import Tokenizer

    before, after, columns = stages["packing"]
    tokenizer = Tokenizer.from_file(tokenizer_path(PACK_TOKENIZER))
    want = Counter()
    for r in before:
        want[r[0]] += len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1
    rows = [dict(zip(columns, r, strict=True)) for r in after]
    got, ends = Counter(), defaultdict(list)
    for r in rows:
        got[r["doc_id"]] += r["length"]
        ends[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    assert got == want
    for own in ends.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
