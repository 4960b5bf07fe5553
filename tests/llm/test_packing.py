import zlib
from collections import defaultdict

import numpy as np
import pytest

from convolake.llm import packing
from convolake.llm.kernels import texts
from convolake.llm.queries import PACK_TOKENIZER, tokenizer_path

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def encoded(encoder, rows):
    import pyarrow as pa

    out = []
    for _, _, t in texts(pa.array(rows, pa.string()), 100_000):
        ids, offsets = encoder.encode(t)
        out += [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]
    return out


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(PACK_TOKENIZER))


def test_round_trip(docs, doc_rows, tokenizer):
    extra = docs.selectExpr("cast(null as long) as doc_id", "'null id' as text").limit(1)
    out = packing.pack(docs.select("doc_id", "text").union(docs.select("doc_id", "text").where("doc_id < 20")).union(extra), tokenizer_path(PACK_TOKENIZER), with_ids=True)
    assert set(COLUMNS) <= set(out.columns)
    rows = out.collect()
    texts = dict((r[0], r[1] or "") for r in doc_rows) | {None: "null id"}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert 1 <= r.length <= 2048
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
    for doc, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        own = sorted(pieces[doc], key=lambda r: r.start)
        times = 2 if doc is not None and doc < 20 else 1
        assert sum(r.length for r in own) == times * len(ids)
        assert {r.doc_tokens for r in own} == {len(ids)}
        for r in own:
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids[r.start : r.start + r.length]
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    lengths = [sum(r.length for r in own) for own in sequences.values()]
    assert len(lengths) <= sum(lengths) / 2048 * 1.05 + 2


def test_empty_table(no_docs):
    out = packing.pack(no_docs, tokenizer_path(PACK_TOKENIZER))
    assert out.count() == 0 and out.columns == COLUMNS


@pytest.mark.parametrize("seed", range(6))
def test_patterns_cover_exactly_and_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    # small pieces are many, so the sum of the sizes is a bound that patterns can nearly reach
    counts = {int(s): int(n) for s, n in zip(rng.choice(np.arange(1, 257), 60, replace=False), rng.integers(1, 4000, 60), strict=True)}
    counts = {s: n if s <= 128 else n // 20 + 1 for s, n in counts.items()}
    got = packing.solve_patterns(counts, 256)
    cover = defaultdict(int)
    for times, pattern in got:
        assert sum(s * a for s, a in pattern.items()) <= 256
        for s, a in pattern.items():
            cover[s] += a * times
    assert dict(cover) == counts
    big = sum(n for s, n in counts.items() if s > 128)
    least = max(sum(s * n for s, n in counts.items()) / 256, big)
    assert sum(t for t, _ in got) <= least * 1.02 + 40


def test_chunks_encode_like_whole_texts(tokenizer, doc_rows):
    encoder = packing.ChunkEncoder(tokenizer_path(PACK_TOKENIZER), cached=50)
    rows = [r[1] or "" for r in doc_rows] + ["tab\tand\r\nbreak  double", "é ́x", "don't I'LL we're", "\x1c\x1d a\x85b", "İstanbul ΑΣ ΑΣ.", "GAZETESİ.", "x\x0by\x0c.", "'s's''d 'll'", "a<|b <|ENDOFTEXT|> AB<|endoftext|>cd"]
    for t, ids in zip(rows, encoded(encoder, rows), strict=True):
        assert ids == tokenizer.encode(t, add_special_tokens=False).ids


def test_random_strings_of_all_scripts_encode_like_the_tokenizer(tokenizer):
    rng = np.random.default_rng(5)
    scripts = [(0x20, 0x7F), (0x00, 0x20), (0x7F, 0x250), (0xC0, 0x180), (0x250, 0x2000), (0x300, 0x370), (0x370, 0x530), (0x600, 0x700), (0x900, 0xE00), (0x1E00, 0x2100), (0x3040, 0x3400), (0xAC00, 0xAD00), (0x1F600, 0x1F650)]
    encoder = packing.ChunkEncoder(tokenizer_path(PACK_TOKENIZER), cached=1000)
    rows = []
    for _ in range(100_000):
        own = [scripts[i] for i in rng.integers(0, len(scripts), 2)] + [scripts[0]]
        n = int(rng.integers(1, 14))
        pick = rng.integers(0, 3, n)
        rows.append("".join(rng.choice(list(".,!'# sStTİßé")) if rng.random() < 0.3 else chr(int(rng.integers(*own[k]))) for k in pick))
    got = encoded(encoder, rows)
    for t, ids, want in zip(rows, got, tokenizer.encode_batch(rows, add_special_tokens=False), strict=True):
        assert ids == want.ids, (t, [hex(ord(c)) for c in t])


@pytest.mark.parametrize("kind", ["empty", "short", "middling"])
def test_little_padding_for_short_texts(spark, kind):
    rng = np.random.default_rng(8)
    most = {"empty": 1, "short": 30, "middling": 300}[kind]
    rows = [(i, "" if kind == "empty" else " ".join(["word"] * int(rng.integers(0, most)))) for i in range(20_000)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tokenizer_path(PACK_TOKENIZER)).toPandas()
    per = out.groupby("sequence_id")
    assert (per["length"].sum() <= 2048).all() and (per["offset"].max() + 0 <= 2047).all()
    used = per.ngroups * 2048
    assert used <= out["length"].sum() * 1.02 + 2048
