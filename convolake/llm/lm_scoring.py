"""Language-model scores by stupid backoff over corpus counts, computed relationally in blocks.

The model is the corpus' own, of order two. A word b after its predecessor a scores count(a, b) /
count(a) if the pair also occurs outside the document itself, else `discount` * count(b) / (all
words); the first word of a text follows a mark of its own. Counts cover all documents; a
document's pairs only don't vouch for themselves.

The relations are exploded n-grams (pair, document, n), count tables dealt by hashes, and sums per
document. Rows travel packed: a map task gathers runs of documents (a flush, about `FLUSH_WORDS`
words), counts pairs per document, and sends the pairs of each block of the hashed predecessor as
sorted, delta-coded and compressed arrays. A block holds all pairs of its predecessors, so it counts
them and joins the counts to the documents at once. Pairs that back off are asked of the blocks of
the unigram table, with the document they belong to. Each block returns sums of the documents that it
met, and the sums of a flush are added up. A pair of a document is packed twice at most and no list
of all documents or flushes travels, so volume is in proportion to the pairs at any size; rows
are as many as pairs at most. Words above a thousandth of the corpus (a thousand at most, which
bounds what is broadcast) are dealt by pair instead, so no word makes a block large.

Order three would pack each word's pair as well as its triple: twice the volume, beyond four times
the input that two orders nearly reach.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, known by 48-bit hashes.

Defined results: null text and text without words have n_words 0 and score 0; repeated rows count as
often as they occur, so their pairs are seen, and score alike; an empty table gives an empty result;
other columns are ignored. docs should read alike each time, as tables do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolake.llm.common import WORD, materialize
from convolake.llm.kernels import mix, texts, trimming

FLUSH_WORDS = 600_000
BLOCK_WORDS = 1_500_000
LEAST_BLOCKS = 48
BEGIN, END = np.uint64((1 << 48) - 1), np.uint64((1 << 48) - 2)
#: Words are known by the upper 48 bits of their hashes.
_SHIFT = np.uint64(16)
_Z = "zstd"


#: Sums of log10 scores travel as whole numbers of this unit, so they add up alike in any order.
UNIT = 2.0**-26


def pack_array(x: np.ndarray, sorted_values: bool = False) -> bytes:
    """Unsigned integers as compressed byte planes, of differences if sorted; only planes in use."""
    x = x.astype(np.uint64)
    if sorted_values and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return np.array([len(x), width, sorted_values], "<u4").tobytes() + pa.compress(planes.tobytes(), codec=_Z, asbytes=True)


def unpack_array(raw: bytes) -> np.ndarray:
    """The integers, in the narrowest type that holds them."""
    n, width, is_sorted = (int(v) for v in np.frombuffer(raw[:12], "<u4"))
    room = 8 if is_sorted else next(w for w in (1, 2, 4, 8) if w >= width)
    if not n:
        return np.zeros(0, f"<u{room}")
    planes = np.frombuffer(pa.decompress(raw[12:], decompressed_size=n * width, codec=_Z, asbytes=True), np.uint8).reshape(width, n)
    x = np.zeros((n, room), np.uint8)
    x[:, :width] = planes.T
    x = x.view(f"<u{room}").ravel()
    return np.cumsum(x, dtype=np.uint64) if is_sorted else x


def _block(key: np.ndarray, blocks: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _flushes(batches: Iterator[pa.RecordBatch]):
    """Runs of documents: ids, the words' hashes and each word's document within the run."""
    ids, codes, owners, docs, words = [], [], [], 0, 0
    for batch in trimming(batches):
        for lo, hi, t in texts(batch.column(1)):
            t = t.lowered()
            starts, ends, where = t.words()
            ids.append(batch.column(0).slice(lo, hi - lo))
            codes.append(t.hashes(starts, ends) >> _SHIFT)
            owners.append(where + docs)
            docs += hi - lo
            words += len(starts)
            if words >= FLUSH_WORDS or docs >= 60_000:
                yield pa.chunked_array(ids).combine_chunks(), np.concatenate(codes), np.concatenate(owners)
                ids, codes, owners, docs, words = [], [], [], 0, 0
    if docs:
        yield pa.chunked_array(ids).combine_chunks(), np.concatenate(codes), np.concatenate(owners)


def unigram_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n: over the whole corpus; pre-aggregated per flush."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, codes, _ in _flushes(batches):
            word, n = np.unique(codes, return_counts=True)
            for lo in range(0, len(word), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(word[lo : lo + 100_000].view(np.int64)), pa.array(n[lo : lo + 100_000])], names=["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def lm_scores(docs: DataFrame, *, discount: float = 0.4, hot_share: float = 1e-3) -> DataFrame:
    """doc_id, n_words, n_backoff and score (sum of log10 scores) of every row."""
    id_type = docs.schema["doc_id"].dataType
    unigrams = materialize(unigram_counts(docs), "unigrams")
    total = unigrams.agg(F.sum("n")).first()[0] or 0
    hot_rows = unigrams.where(F.col("n") >= max(1.0, hot_share * total)).collect()  # 1 / hot_share rows at most
    hot = np.array(sorted(int(np.int64(r[0]).view(np.uint64)) for r in hot_rows), np.uint64)
    by_word = {int(np.int64(r[0]).view(np.uint64)): r[1] for r in hot_rows}
    hot_n = np.array([by_word[int(w)] for w in hot], float)
    blocks = max(LEAST_BLOCKS, -(-total // BLOCK_WORDS))
    id_arrow = T.ArrayType(id_type)

    def is_hot(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(hot):
            return np.zeros(len(word), bool), np.zeros(len(word), np.int64)
        at = np.minimum(np.searchsorted(hot, word), len(hot) - 1)
        return (hot[at] == word), at

    flush_schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("flush", T.LongType()), T.StructField("docs", T.LongType()), T.StructField("w1", T.BinaryType()), T.StructField("w2", T.BinaryType()), T.StructField("many", T.BinaryType()), T.StructField("doc", T.BinaryType()), T.StructField("n", T.BinaryType()), T.StructField("ids", id_arrow), T.StructField("size", T.ArrayType(T.LongType()))])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 20  # flushes a task; a document is its flush and a number below 2 ** 16
        for k, (ids, codes, owners) in enumerate(_flushes(batches)):
            size = np.bincount(owners, minlength=len(ids))
            some = np.flatnonzero(size)
            # (begin, first), (word, next) ... (last, end)
            first = np.cumsum(size) - size
            place = np.arange(len(codes)) + np.searchsorted(some, owners) + 1
            line = np.full(len(codes) + len(some), BEGIN, np.uint64)
            line[place] = codes
            follow = np.append(line[1:], END)
            follow[first[some] + np.arange(len(some)) + size[some]] = END
            owner = np.repeat(some, size[some] + 1)
            keep = ~((line == BEGIN) & (follow == END))
            w1, w2, owner = line[keep], follow[keep], owner[keep]
            warm, _ = is_hot(w1)
            key = np.where(warm | (w1 == BEGIN), mix(w1 ^ mix(w2)), w1)
            block = _block(mix(key), blocks)
            pair = mix(w1 * np.uint64(0x9E3779B97F4A7C15) + w2)  # orders equal pairs together
            order = np.lexsort((owner, pair, w1, block))
            w1, w2, owner, block = w1[order], w2[order], owner[order], block[order]
            new = np.ones(len(w1), bool)
            new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            cell = new.copy()
            cell[1:] |= owner[1:] != owner[:-1]
            begin = np.flatnonzero(cell)
            times = np.diff(np.append(begin, len(w1)))
            w1, w2, owner, block, new = w1[begin], w2[begin], owner[begin], block[begin], new[begin]
            heads = np.flatnonzero(new)
            many = np.diff(np.append(heads, len(w1)))
            cut, head_cut = np.searchsorted(block, np.arange(blocks + 1)), np.searchsorted(block[heads], np.arange(blocks + 1))
            flush = base + k
            home = flush % blocks  # the block that also carries the documents' ids
            out = []
            for b in sorted({home, *np.flatnonzero(np.diff(cut)).tolist()}):
                h = heads[head_cut[b] : head_cut[b + 1]]
                own = slice(cut[b], cut[b + 1])
                lists = (ids.to_pylist(), size.tolist()) if b == home else (None, None)
                out.append((int(b), flush, len(ids), pack_array(w1[h], True), pack_array(w2[h]), pack_array(many[head_cut[b] : head_cut[b + 1]]), pack_array(owner[own]), pack_array(times[own]), *lists))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=ty) for c, ty in zip(zip(*out, strict=True), arrow_types, strict=True)], names=flush_schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_types = [to_arrow_type(f.dataType) for f in flush_schema]
    sent = docs.select("doc_id", "text").mapInArrow(pairs, flush_schema)
    begins = float(docs.where(F.col("text").rlike(WORD)).count())

    log_discount = float(np.log10(discount))
    part_schema = T.StructType([T.StructField(c, T.LongType()) for c in ("block", "flush", "docs")] + [T.StructField(c, T.BinaryType()) for c in ("w2", "doc", "n", "part")] + [T.StructField("ids", id_arrow), T.StructField("size", T.ArrayType(T.LongType()))])
    part_types = [to_arrow_type(f.dataType) for f in part_schema]

    def counted(table: pa.Table) -> pa.Table:
        rows = table.select(["flush", "docs", "w1", "w2", "many", "doc", "n"]).to_pylist()
        lists = list(zip(table.column("ids").to_pylist(), table.column("size").to_pylist(), strict=True))
        w1, w2, many, doc, n = ([unpack_array(r[c]) for r in rows] for c in ("w1", "w2", "many", "doc", "n"))
        heads = [len(x) for x in w1]
        w1, w2 = np.concatenate(w1), np.concatenate(w2)
        mass = []
        for m, k in zip(many, n, strict=True):
            mass.append(np.add.reduceat(k.astype(np.int64), np.cumsum(m.astype(np.int64)) - m.astype(np.int64)) if len(m) else m.astype(np.int64))
        mass = np.concatenate(mass)
        order = np.lexsort((w2, w1))
        a, b = w1[order], w2[order]
        new1 = np.ones(len(a), bool)
        new1[1:] = a[1:] != a[:-1]
        new = new1.copy()
        new[1:] |= b[1:] != b[:-1]
        which, which1 = np.cumsum(new) - 1, np.cumsum(new1) - 1
        pair_n = np.bincount(which, mass[order])[which]
        word_n = np.bincount(which1, mass[order])[which1]
        warm, at = is_hot(a)
        if len(hot):
            word_n = np.where(warm, hot_n[at], word_n)
        word_n = np.where(a == BEGIN, begins, word_n)
        value = np.empty(len(a))
        value[order] = np.where(b == END, 0.0, np.log10(pair_n / word_n))
        times = np.empty(len(a), np.int64)
        times[order] = np.where(b == END, 2.0**53, pair_n)
        del order, a, b, new, new1, which, which1, pair_n, word_n, mass, w1
        out, lo, rest_of = [], 0, []
        for r, own_lists, h, m, d, k in zip(rows, lists, heads, many, doc, n, strict=True):
            own = np.repeat(np.arange(lo, lo + h, dtype=np.int32), m)
            seen = times[own] > k  # somewhere else too
            part = np.bincount(d[seen], value[own[seen]] * k[seen], r["docs"])
            met = np.flatnonzero(part) if own_lists[0] is None else np.arange(r["docs"])
            out.append((r["flush"] % blocks, r["flush"], r["docs"], None, pack_array(met, True), None, pack_array(np.round(-part[met] / UNIT)), *own_lists))
            rest = np.flatnonzero(~seen)
            rest_of.append((w2[own[rest]], np.uint64(r["flush"] << 16) + d[rest].astype(np.uint64), k[rest]))
            lo += h
        word, d, k = (np.concatenate([x[i] for x in rest_of]) for i in range(3))
        target = _block(mix(word), blocks).astype(np.int32)
        by = np.lexsort((d, word, target))
        cut = np.searchsorted(target[by], np.arange(blocks + 1))
        for t in np.flatnonzero(np.diff(cut)):
            s = by[cut[t] : cut[t + 1]]
            out.append((int(t), None, None, pack_array(word[s], True), pack_array(d[s]), pack_array(k[s]), None, None, None))
        return pa.Table.from_arrays([pa.array(list(c), type=ty) for c, ty in zip(zip(*out, strict=True), part_types, strict=True)], names=part_schema.names)

    parts = sent.groupBy("block").applyInArrow(counted, part_schema)
    result_schema = T.StructType([T.StructField("flush", T.LongType()), T.StructField("docs", T.LongType()), T.StructField("doc", T.BinaryType()), T.StructField("part", T.BinaryType()), T.StructField("back", T.BinaryType()), part_schema["ids"], part_schema["size"]])
    result_types = [to_arrow_type(f.dataType) for f in result_schema]

    def backed(left: pa.Table, right: pa.Table) -> pa.Table:
        word = right.column("word").to_numpy().view(np.uint64)
        count = right.column("n").to_numpy()
        order = np.argsort(word)
        word, count = word[order], count[order]
        out, asked = [], []
        for batch in left.to_batches(max_chunksize=64):
            for r in batch.to_pylist():
                if r["part"] is not None:  # already scored, on its way to its flush
                    out.append((r["flush"], r["docs"], r["doc"], r["part"], None, r["ids"], r["size"]))
                    continue
                w, d, k = (unpack_array(r[c]) for c in ("w2", "doc", "n"))
                value = np.round(-(log_discount + np.log10(count[np.searchsorted(word, w)] / total)) * k / UNIT)
                own, which = np.unique(d.astype(np.uint64), return_inverse=True)
                asked.append((own, np.bincount(which, value, len(own)), np.bincount(which, k, len(own))))
        if asked:
            own, which = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
            part, back = (np.bincount(which, np.concatenate([x[i] for x in asked]), len(own)) for i in (1, 2))
            flush = (own >> np.uint64(16)).astype(np.int64)
            cut = np.append(np.flatnonzero(np.diff(flush, prepend=-1)), len(own))
            for lo, hi in zip(cut, cut[1:], strict=False):
                out.append((int(flush[lo]), None, pack_array(own[lo:hi] & np.uint64(0xFFFF), True), pack_array(part[lo:hi]), pack_array(back[lo:hi]), None, None))
        return pa.Table.from_arrays([pa.array([o[i] for o in out], type=ty) for i, ty in enumerate(result_types)], names=result_schema.names)

    def table_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimming(batches):
            block = _block(mix(batch.column(0).to_numpy().view(np.uint64)), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), batch.column(0), batch.column(1)], names=["block", "word", "n"])

    table = unigrams.mapInArrow(table_block, "block long, word long, n long")
    scored = parts.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(backed, result_schema)

    def summed(table: pa.Table) -> pa.Table:
        rows = table.select(["doc", "part", "back"]).to_pylist()
        ids, size = table.column("ids").combine_chunks().flatten(), table.column("size").combine_chunks().flatten()
        score, back = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
        for r in rows:
            own = unpack_array(r["doc"]).astype(np.int64)
            score[own] += unpack_array(r["part"]).astype(np.uint64)
            if r["back"] is not None:
                back[own] += unpack_array(r["back"]).astype(np.uint64)
        return pa.Table.from_arrays([ids, size, pa.array(back.astype(np.int64)), pa.array(score * -UNIT + 0.0)], names=["doc_id", "n_words", "n_backoff", "score"])

    out_schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_words", T.LongType()), T.StructField("n_backoff", T.LongType()), T.StructField("score", T.DoubleType())])
    return scored.groupBy("flush").applyInArrow(summed, out_schema)
