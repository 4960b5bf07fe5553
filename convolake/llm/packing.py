"""Packing of token sequences by cutting-stock column generation.

Documents become ids, are cut into pieces of at most `seq_len`, and the pieces are packed so that
sequences of `seq_len` need little padding. Full pieces are sequences already. The others are counted
in a histogram of length classes (exact for short pieces, wider for long ones, some 250 whatever the
corpus), over which a linear program chooses patterns: how many pieces of each class share a
sequence. Columns are generated by pricing patterns with a knapsack dynamic program. The rounded
patterns say which ranks of each class go to which sequence; ranks are assigned to the pieces on the
executors, so the driver only sees the histogram.

Defined results: null text is empty; an empty document is the one end id; repeated rows are packed
as often as they occur; an empty table gives an empty result; other columns are ignored, unless
named in `keep`. Texts of any length are cut, never dropped.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from convolake.llm.common import materialize
from convolake.llm.kernels import LOWER, SPACE, Texts, texts, trimming

#: Chunks of text of which a worker remembers the ids.
CACHED_CHUNKS = 150_000


#: Symbols that the tokenizer splits from a word before them.
_SYMBOLS = ".,;:!?|#$%&*"
#: Kinds of ASCII bytes: letters, which stay together, digits, which don't, and others, which do.
_KIND = np.full(256, 3, np.uint8)
_KIND[97:123], _KIND[48:58] = 1, 2


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class ChunkEncoder(dict):
    """Ids of texts, equal to the tokenizer's own on the whole text.

    The tokenizer splits at white space before anything can cross it, so a text's ids are those of
    its chunks between spaces. A chunk of ASCII without apostrophe is split where the tokenizer splits it: runs of
    letters, lower-cased, single digits, and runs of symbols. Any other chunk, and one that may hold a special
    token, is looked up whole, in its own case, as letters are composed with marks before they are lower-cased. A
    run of texts looks each of its distinct pieces up once. It is a dictionary of the pieces met so far, up to `cached`.
    """

    def __init__(self, path: str, cached: int = CACHED_CHUNKS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(_byte_letters()))
        self.cached = cached

    def _piece(self, piece: str) -> bytes:
        """Ids of what the tokenizer does not split any further."""
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def __missing__(self, raw: bytes) -> bytes:
        chunk = raw.decode()
        if raw.isascii() and "'" not in chunk and "<|" not in chunk:
            ids = array("I", [t.id for t in self.model.tokenize(chunk)]).tobytes() if chunk.isalpha() else self._piece(chunk)
        else:
            core = chunk.rstrip(_SYMBOLS)
            low = core.lower()
            if core.isalpha() and max(core) < "\u0250" and len(low) == len(core) and unicodedata.is_normalized("NFC", core):
                # a word in Latin letters, composed as they are, and what the tokenizer splits from it
                ids = self._piece(low) if core is chunk else self[low.encode()] + self[chunk[len(core) :].encode()]
            else:
                ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(raw) < 64 and len(self) < self.cached:
            self[raw] = ids
        return ids

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the offsets of each."""
        starts, ends, where = t.words()
        n = len(t.data)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(t) + 1, np.int64)
        odd = (t.data >= 128) | (t.data == 39)
        odd[:-1] |= (t.data[:-1] == 60) & (t.data[1:] == 124)
        whole = np.add.reduceat(odd, np.stack([starts, np.minimum(ends, n - 1)], 1).ravel())[::2] > 0
        whole |= (ends == n) & odd[n - 1]  # reduceat takes no end beyond the last place
        edge = np.zeros(n + 1, np.int8)
        edge[starts[whole]] += 1
        edge[ends[whole]] -= 1
        in_whole = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        data = np.where(in_whole, t.data, LOWER[t.data])
        kind = _KIND[data]
        begin = np.zeros(n, bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begin &= ~in_whole & ~SPACE[data]
        opens = np.zeros(n, bool)
        opens[starts] = True
        first = np.flatnonzero(begin | opens)
        chunk = np.cumsum(opens[first]) - 1
        last = np.minimum(np.append(first[1:], n), ends[chunk])
        own = Texts(data, t.offsets)
        _, one, which = np.unique(own.hashes(first, last), return_index=True, return_inverse=True)
        raw = data.tobytes()
        found = [self[raw[a:b]] for a, b in zip(first[one].tolist(), last[one].tolist(), strict=True)]
        ids = np.frombuffer(b"".join(found), "<u4")
        many = np.fromiter(map(len, found), np.int64, len(found)) // 4
        size = many[which]
        at = np.repeat((np.cumsum(many) - many)[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return ids[at], np.concatenate([[0], np.cumsum(np.bincount(where[chunk], size, len(t)).astype(np.int64))])


@lru_cache(maxsize=1)
def encoder_for(path: str, cached: int = CACHED_CHUNKS) -> ChunkEncoder:
    """One encoder for all tasks of a worker process, so that what one task has learned serves the next."""
    return ChunkEncoder(path, cached)


def tokenize_pieces(docs: DataFrame, tokenizer: str, *, seq_len: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of at most seq_len ids: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    names = [f.name for f in fields]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_for(tokenizer)
        for batch in trimming(batches):
            for lo, hi, t in texts(batch.column(1), 1 << 20):
                ids, offsets = encoder.encode(t)
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                offsets = offsets + np.arange(hi - lo + 1)
                total = np.diff(offsets)
                cuts = -(-total // seq_len)
                row = np.repeat(np.arange(hi - lo), cuts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * seq_len
                length = np.minimum(seq_len, total[row] - start)
                raw = memoryview(ids.tobytes())
                parts = [raw[4 * a : 4 * b] for a, b in zip((offsets[row] + start).tolist(), (offsets[row] + start + length).tolist(), strict=True)]
                out = [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), *[pa.array(x, pa.int64()) for x in (start, length, [zlib.crc32(p) for p in parts], total[row])]]
                if with_ids:
                    out.append(pa.array([bytes(p) for p in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select("doc_id", "text").mapInArrow(pieces, T.StructType(fields))


def solve_patterns(counts: dict[int, int], capacity: int, *, gap: float = 5e-4, rounds: int = 4000) -> list[tuple[int, dict[int, int]]]:
    """Cutting stock: (times, {size: pieces}) covering counts[size] pieces of each size exactly.

    A revised simplex over the patterns generated so far; the dual prices go to an unbounded
    knapsack, whose best pattern enters until none prices above 1 + gap. What rounding down leaves is
    packed greedily, largest first.
    """
    sizes = np.array(sorted(s for s, n in counts.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    m = len(sizes)
    need = np.array([counts[int(s)] for s in sizes], float)
    patterns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(patterns))
    x = inverse @ need
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        best = np.zeros(capacity + 1)
        took = np.full(capacity + 1, -1)
        for c in range(int(sizes[0]), capacity + 1):
            fit = int(np.searchsorted(sizes, c, side="right"))
            value = best[c - sizes[:fit]] + price[:fit]
            i = int(value.argmax())
            if value[i] > best[c - 1] + 1e-12:
                best[c], took[c] = value[i], i
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + gap:
            break
        column, c = np.zeros(m), capacity
        while c > 0:
            if took[c] < 0:
                c -= 1
                continue
            column[took[c]] += 1
            c -= int(sizes[took[c]])
        step = inverse @ column
        ratio = np.full(m, np.inf)
        up = step > 1e-9
        ratio[up] = np.maximum(x[up], 0) / step[up]
        out = int(ratio.argmin())
        theta = ratio[out]
        x -= theta * step
        x[out] = theta
        patterns[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    left = need.astype(np.int64)
    chosen: list[tuple[int, dict[int, int]]] = []
    for j in range(m):
        a = patterns[:, j].astype(np.int64)
        times = int(min([np.floor(max(x[j], 0) + 1e-9)] + [left[i] // a[i] for i in np.flatnonzero(a)]))
        if times > 0:
            left -= times * a
            chosen.append((times, {int(sizes[i]): int(a[i]) for i in np.flatnonzero(a)}))
    return chosen + fill({int(z): int(n) for z, n in zip(sizes, left, strict=True)}, capacity)


def fill(left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: pieces}) of what is left, largest first."""
    chosen, left = [], {z: n for z, n in sorted(left.items(), reverse=True) if n > 0}
    while left:
        pattern, room = {}, capacity
        for z, n in left.items():
            a = min(n, room // z)
            if a:
                pattern[z] = a
                room -= a * z
        times = min(left[z] // a for z, a in pattern.items())
        chosen.append((times, pattern))
        left = {z: n - times * pattern.get(z, 0) for z, n in left.items() if n > times * pattern.get(z, 0)}
    return chosen


def solve_lengths(counts: dict[int, int], seq_len: int) -> list[tuple[int, dict[int, int]]]:
    """The same for length classes: patterns of pieces that aren't short, whose room short pieces fill, and sequences of the short ones left."""
    short = {z: n for z, n in sorted(counts.items(), reverse=True) if z <= seq_len // 32}
    unit = max(1, seq_len // 1024)
    out = []
    for times, pattern in solve_patterns({z // unit: n for z, n in counts.items() if z not in short}, seq_len // unit):
        pattern = {z * unit: a for z, a in pattern.items()}
        room = seq_len - sum(z * a for z, a in pattern.items())
        for z, n in short.items():
            a = min(n // times, room // z)
            if a:
                pattern[z] = a
                short[z] -= a * times
                room -= a * z
        out.append((times, pattern))
    return out + fill(short, seq_len)


def _steps(seq_len: int) -> list[tuple[int, int]]:
    """(up to this length, width of a class): exact classes for short pieces, and about 1 % of the length beyond."""
    return [(seq_len // 32, 1), *[(seq_len >> k, max(1, seq_len >> (k + 6))) for k in (4, 3, 2)], (seq_len, max(1, seq_len // 128))]


def pack_pieces(pieces: DataFrame, *, seq_len: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces, a table that can be read again with the same rows.

    Ranks within a length class come from counts per (class, input partition) and a row number inside
    each, so a class that holds most pieces is still spread over as many tasks as its input was.
    """
    spark = pieces.sparkSession
    size = F.col("length")
    for most, width in reversed(_steps(seq_len)):
        size = F.when(F.col("length") <= most, F.expr(f"int((length + {width - 1}) div {width}) * {width}")).otherwise(size)
    p = pieces.withColumn("_pid", F.monotonically_increasing_id()).withColumn("_class", F.least(size, F.lit(seq_len)).cast("int"))
    p = p.withColumn("_bucket", F.shiftright("_pid", 13))  # runs of at most 8192 rows of one input partition
    full, rest = p.where(F.col("length") == seq_len), p.where(F.col("length") < seq_len)
    per = rest.groupBy("_class", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_class", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    histogram = {r[0]: r[1] for r in rest.groupBy("_class").count().collect()}  # a row a class
    used: dict[int, int] = {}
    spans, base = [], 0
    for times, pattern in solve_lengths(histogram, seq_len):
        slot = 0
        for size, each in pattern.items():
            at = used.get(size, 0)
            spans.append((size, at, at + each * times, each, base, slot))
            used[size] = at + each * times
            slot += each
        base += times
    table = spark.createDataFrame(spans, "_class int, _from long, _to long, _each long, _base long, _slot long")
    # patterns x classes in a pattern: bounded by the classes, whatever the corpus
    rank = F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy("_pid")) - 1
    ranked = rest.withColumn("_r", rank).join(per, ["_class", "_bucket"]).withColumn("_rank", F.col("_r") + F.col("_before"))
    placed = ranked.join(F.broadcast(table), (ranked["_class"] == table["_class"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    i = F.col("_rank") - F.col("_from")
    placed = placed.withColumn("sequence_id", F.col("_base") + F.floor(i / F.col("_each")).cast("long")).withColumn("_slot", F.col("_slot") + i % F.col("_each"))
    within = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long"))
    full = full.withColumn("sequence_id", F.lit(base).cast("long") + F.col("_pid")).withColumn("offset", F.lit(0).cast("long"))
    names = [*pieces.columns, "sequence_id", "offset"]
    return full.select(names).unionByName(placed.select(names))


def pack(docs: DataFrame, tokenizer: str, *, seq_len: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs docs (doc_id, text); a row per piece."""
    return pack_pieces(materialize(tokenize_pieces(docs, tokenizer, seq_len=seq_len, end_id=end_id, with_ids=with_ids), "pieces"), seq_len=seq_len)
