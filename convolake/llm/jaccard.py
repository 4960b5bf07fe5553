"""N-gram Jaccard join: links of documents whose word-shingle sets are alike, and their components.

The overlap matrix is the product of the sparse document by shingle incidence matrix with its
transpose. Only blocks of it can hold links. Sizes bound which documents may link at all: with
threshold t their sizes differ by 1/t at most and their sets by d = (n1 + n2)(1 - t)/(1 + t) shingles.
The shingles are dealt into m > d column blocks by their hashes, so two linked documents agree on
whole blocks - all but d of those in which the smaller one has shingles. A document's part of a block
(of two blocks, where d is small) is hashed to a key; documents that share no key can't link. Block
keys span several shingles and empty blocks make none, so frequent words, lines and passages alone
make no candidates, whatever their counts. A parity sketch of each set (bit h is the parity of its
shingles that hash to h) differs in no more bits than the sets differ in shingles, so pairs whose
sketches differ in more than d bits are discarded before any set moves. The overlap counts of the
remaining pairs are then accumulated over all shingles, and pairs under the bound are discarded.

So the product is formed only where a block's rows are equal; overlaps are counted per candidate pair
and not summed over all columns, whose frequent ones would make pairs with the square of their counts.

Documents with equal sets are one node. Each run of documents groups its own keys first and sends one
row a key, so a key of many documents is a row a run; the keys are shuffled once, and scanned in order
with one row of memory. Within a group, members are first compared with one of them; only groups that
still hold several components are compared pair by pair, across components alone. No link is lost:
pairs skipped are in one component already.

Defined results: null text, or text without words, has no shingles and links with nothing; fewer
words than `words` are one shingle; repeated rows are copies; a row whose id is null belongs to its
copies' component but never names one; an empty table gives an empty result; other columns are
ignored. Ids are expected to belong to one text each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolake.llm.common import connected_components, materialize, release
from convolake.llm.kernels import Texts, mix, texts, trimming

_K = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0x9FB21C651E98DF25)]
#: Up to this many differing shingles, keys span two blocks.
PAIRED = 3
#: A set whose shingles fall into too few blocks is dealt anew up to this often.
DEALS = 6
#: Ids of documents to read again are broadcast up to this many (8 bytes each), else joined by shuffle.
BROADCAST_IDS = 1_000_000
SKETCH_LONGS = 8


@lru_cache
def size_classes(percent: int) -> tuple[tuple[int, int, int], ...]:
    """(least size, blocks m, most differing shingles d) of each size class.

    The larger document of a linked pair is in the smaller one's class or the next; d is that of the
    largest pair whose smaller document is in the class. Wider classes would make fewer keys of smaller
    blocks, which unrelated documents share more often.
    """
    out, least = [], 1
    while least < 1 << 40:
        after = least * 100 // percent + 1
        small = after - 1
        d = (small + small * 100 // percent) * (100 - percent) // (100 + percent)
        need = d + (2 if d <= PAIRED else 1)
        m = need
        for _ in range(30):  # room for blocks that are empty by chance, up to two deviations
            empty = m * math.exp(-least / m)
            m = min(need + math.ceil(empty + 2 * math.sqrt(empty)), max(need, 16 if d <= PAIRED else 4 * least))
        out.append((least, m, d))
        least = after
    return tuple(out)


def shingle_sets(t: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and offsets of length len(t) + 1."""
    t = t.lowered()
    starts, ends, where = t.words()
    h = t.hashes(starts, ends)
    many = np.bincount(where, minlength=len(t))
    first = np.cumsum(many) - many
    n = len(h)
    if n >= words:
        s = h[: n - words + 1].copy()
        for k in range(1, words):
            s = mix(s * _K[0] + h[k : n - words + 1 + k])
        whole = where[: n - words + 1] == where[words - 1 :]
        s, owner = s[whole], where[: n - words + 1][whole]
    else:
        s, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((many > 0) & (many < words))
    if len(short):
        own = np.array([_short(h[first[i] : first[i] + many[i]]) for i in short], np.uint64)
        s, owner = np.concatenate([s, own]), np.concatenate([owner, short])
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    return s, np.searchsorted(owner, np.arange(len(t) + 1))


def _short(h: np.ndarray) -> np.uint64:
    code = np.array([len(h)], np.uint64)
    for x in h:
        code = mix(code * _K[1] + x)
    return code[0]


def parity_sketch(s: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """sets x SKETCH_LONGS: the sketches' bits. Two differ in at most as many bits as the sets have different shingles."""
    bits = 64 * SKETCH_LONGS
    place = (mix(s ^ _K[1]) >> np.uint64(40)).astype(np.int64) % bits
    out = np.empty((len(offsets) - 1, SKETCH_LONGS), np.int64)
    for lo in range(0, len(out), 2048):
        hi = min(lo + 2048, len(out))
        own = slice(offsets[lo], offsets[hi])
        row = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
        odd = (np.bincount(row * bits + place[own], minlength=(hi - lo) * bits) & 1).astype(np.uint8)
        out[lo:hi] = np.packbits(odd.reshape(hi - lo, bits), axis=1).view(np.int64)
    return out


def _times(i: int, k: int) -> np.uint64:
    """i times a constant, modulo 2^64."""
    return np.uint64(int(i) * int(_K[k]) & (1 << 64) - 1)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def block_keys(s: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each set's blocks, and the set of each key.

    Only blocks that hold shingles make keys. A set that has some in more than d blocks (d + 1 where keys span
    two) shares a key with every set it may link with, as a differing shingle changes one block. Other sets are
    dealt anew, so of two sets the one that is done first settles the pair; sets that are never done share a key.
    """
    classes = size_classes(percent)
    least = np.array([c[0] for c in classes])
    sizes = np.diff(offsets)
    own = np.searchsorted(least, sizes, side="right") - 1
    below = (own > 0) & (-(-sizes * percent // 100) < least[np.maximum(own, 0)])  # partners in the class before
    code = mix(s ^ _K[2])
    keys, owners = [], []
    for c in np.unique(np.concatenate([own[sizes > 0], own[below] - 1])):
        _, m, d = classes[c]
        if d == 0:  # these link only when equal
            continue
        docs = np.flatnonzero((sizes > 0) & ((own == c) | (below & (own == c + 1))))
        for deal in range(DEALS):
            size = sizes[docs]
            row = np.repeat(np.arange(len(docs)), size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offsets[docs], size)
            high = s[at] >> np.uint64(32) if deal == 0 else mix(s[at] ^ _times(deal, 2)) >> np.uint64(32)
            cell = row * m + ((high * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
            if deal:
                order = np.argsort(cell, kind="stable")
                at, cell = at[order], cell[order]
            begin = np.flatnonzero(np.diff(cell, prepend=-1))  # ascends in the first deal, as s does
            block = cell[begin]
            who, block = block // m, block % m
            part = mix(np.add.reduceat(code[at], begin) + (block.astype(np.uint64) + np.uint64(1)) * _K[4] + _times(c * DEALS + deal + 1, 3))
            many = np.bincount(who, minlength=len(docs))
            if d <= PAIRED:
                first = np.cumsum(many) - many
                for i in range(1, int(many.max())):  # a block and the i-th after it
                    x = np.flatnonzero(np.arange(len(who)) - first[who] + i < many[who])
                    keys.append(mix(part[x] * _K[0] + part[x + i]))
                    owners.append(docs[who[x]])
            else:
                keys.append(part)
                owners.append(docs[who])
            docs = docs[many < d + (2 if d <= PAIRED else 1)]
            if not len(docs):
                break
        else:
            keys.append(np.full(len(docs), mix(np.array([_times(c + 1, 1)]))[0]))
            owners.append(docs)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def local_groups(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, smallest id, whether it has others) of every key, and where in (keys, ids) the others are, with the smallest id."""
    order = np.lexsort((ids, keys))
    k, i = keys[order], ids[order]
    begin = np.flatnonzero(np.diff(k, prepend=~k[:1]) != 0) if len(k) else np.zeros(0, np.int64)
    run = np.diff(np.append(begin, len(k)))
    low = np.repeat(i[begin], run)
    others = i != low
    return k[begin], i[begin], i[begin] != i[begin + run - 1], order[others], low[others]


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (p, id, lo, key) in the order of p; gives (key, id, lo), lo one member of the key's group.

    Rows with lo are in a group already. The others are grouped by p, without those that are alone, unless they
    have a key, which says that a group of their own has been given. Only the last row is remembered from one batch
    to the next, so groups of any size stream through; lo is the smallest id of a group that ends where it begins,
    so the keys of the same documents agree on it.
    """
    before_p = before_id = np.zeros(0, np.int64)
    before_has = np.zeros(0, bool)
    lo_now, told = 0, False
    for batch in batches:
        p, ids = (batch.column(i).to_numpy() for i in (0, 1))
        done, has = (batch.column(i).is_valid().to_numpy(zero_copy_only=False) for i in (2, 3))
        grouped = [batch.column(i).filter(pa.array(done)) for i in (3, 1, 2)]
        p, ids, has = p[~done], ids[~done], has[~done]
        key, member, lo = (np.zeros(0, np.int64),) * 3
        if len(p):
            p, ids, has = np.concatenate([before_p, p]), np.concatenate([before_id, ids]), np.concatenate([before_has, has])
            begin = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            size = np.diff(np.append(begin, len(p)))
            first = np.minimum.reduceat(ids, begin)
            if len(before_p) and told:
                first[0] = lo_now  # the group goes on
            low = np.repeat(first, size)
            give = np.repeat(size > 1, size) | has
            last = bool(give[-1])
            if len(before_p) and told:
                give[0] = False  # has been given
            key, member, lo = p[give], ids[give], low[give]
            told = last or (len(p) == 1 and told)
            lo_now, before_p, before_id, before_has = first[-1], p[-1:], ids[-1:], has[-1:]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([x, pa.array(y)]) for x, y in zip(grouped, (key, member, lo), strict=True)], names=["key", "id", "lo"])


def _rows(docs: DataFrame, make, schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimming(batches):
            for lo, hi, t in texts(batch.column(1)):
                yield pa.RecordBatch.from_arrays(make(batch.column(0).slice(lo, hi - lo), t), names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _only(docs: DataFrame, ids: DataFrame, n: int, how: str) -> DataFrame:
    """docs whose id is (left_semi) or is not (left_anti) among the n ids."""
    ids = ids.select("doc_id")
    return docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("shuffle_merge"), "doc_id", how).select(docs.columns)


def jaccard_links(docs: DataFrame, *, words: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(membership, links): doc_id, n_shingles, rep of each row, and linked pairs of representatives.

    rep is the smallest id with an equal set; null for a row that has no set. links: a, b, overlap,
    enough of them to connect each component.
    """
    docs = docs.select("doc_id", "text")

    def signed(ids: pa.Array, t: Texts) -> list[pa.Array]:
        s, offsets = shingle_sets(t, words)
        sketch = pa.FixedSizeListArray.from_arrays(pa.array(parity_sketch(s, offsets).ravel()), SKETCH_LONGS).cast(pa.list_(pa.int64()))
        return [ids, pa.array(np.diff(offsets)), *[pa.array(_sums(mix(s ^ k), offsets).view(np.int64)) for k in (_K[3], _K[4])], sketch]

    id_field = T.StructField("doc_id", T.LongType())
    schema = T.StructType([id_field, T.StructField("n_shingles", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType(), False))])
    signs = materialize(_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), signed, schema), "signs")
    reps = signs.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    sketches = signs.select(F.col("doc_id").alias("rep"), "s1", "s2", *[F.get("sketch", F.lit(i)).alias(f"q{i}") for i in range(SKETCH_LONGS)]).dropDuplicates(["rep", "s1", "s2"])
    reps = materialize(reps.where("rep is not null").join(sketches, ["rep", "s1", "s2"]), "reps")
    members = signs.join(reps.select("s1", "s2", "rep"), ["s1", "s2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep"))
    members = materialize(members, "members")
    release(signs)

    copies = members.where("rep is not null and doc_id <> rep").select("doc_id").distinct()
    single = _only(docs.where("doc_id is not null"), copies, copies.count(), "left_anti")

    def keyed(ids: pa.Array, t: Texts) -> list[pa.Array]:
        keys, owners = block_keys(*shingle_sets(t, words), percent)
        own = ids.to_numpy()[owners]
        key, low, has, at, lo = local_groups(keys, own)
        none = pa.nulls(len(key), pa.int64())
        # what a run of documents groups by itself needs no other: it is dealt by key and id, so a hot key's rows are spread
        alone = mix(keys[at].view(np.uint64) ^ mix(own[at].view(np.uint64))).view(np.int64)
        return [pa.array(np.concatenate([key, alone])), pa.array(np.concatenate([low, own[at]])), pa.concat_arrays([none, pa.array(lo)]), pa.concat_arrays([pa.array(key, mask=~has), pa.array(keys[at])])]

    key_schema = T.StructType([T.StructField(c, T.LongType()) for c in ("p", "id", "lo", "key")])
    keys = _rows(single.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), keyed, key_schema)
    # a hot key has one row for each run of documents here, and the scan holds one row at a time
    shared = materialize(keys.repartition("p").sortWithinPartitions("p").mapInArrow(shared_keys, "key long, id long, lo long"), "shared")

    def side(name: str) -> DataFrame:
        return reps.select(F.col("rep").alias(name), F.col("n").alias(f"n{name}"), *[F.col(f"q{i}").alias(f"{name}{i}") for i in range(SKETCH_LONGS)])

    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, SKETCH_LONGS)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    alike = fits & (differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))

    def sets(ids: pa.Array, t: Texts) -> list[pa.Array]:
        s, offsets = shingle_sets(t, words)
        return [ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(s.view(np.int64)))]

    set_schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("set", T.ArrayType(T.LongType(), False))])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = materialize(pairs, f"{name}-pairs")
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
        own = _only(docs, ids, ids.count(), "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        incidence = materialize(_rows(own, sets, set_schema), f"{name}-sets")
        found = pairs.join(incidence.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").join(incidence.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
        found = found.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("overlap"))
        linked = found.where(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * percent).select("a", "b", "overlap")
        linked = materialize(linked, f"{name}-links")
        release(pairs, incidence)
        # repeated rows of one id repeat links; distinct follows the table, as within its plan it would keep a hot id's join from being split
        return linked.distinct()

    star = shared.where("id <> lo").select(F.least("lo", "id").alias("a"), F.greatest("lo", "id").alias("b")).distinct()
    star = star.join(side("a"), "a").join(side("b"), "b").where(alike).select("a", "b", "na", "nb")
    links = verified(star, "star")
    comp = connected_components(links.select("a", "b"), "first")
    labelled = shared.join(comp, shared["id"] == comp["node"], "left").select("key", "id", "lo", F.coalesce("component", "id").alias("component"))
    labelled_all = materialize(labelled, "labelled")
    release(shared)
    # a key's member is one row, so groups of two have been compared
    groups = labelled_all.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    several = materialize(groups.where("n > 2 and c0 <> c1").select("key"), "several")
    labelled = labelled_all.join(several, "key", "left_semi")
    x = labelled.select("key", F.col("id").alias("a"), F.col("lo").alias("la"), F.col("component").alias("ca")).join(side("a"), "a")
    y = labelled.select("key", F.col("id").alias("b"), F.col("lo").alias("lb"), F.col("component").alias("cb")).join(side("b"), "b")
    compared = (F.col("la") == F.col("b")) | (F.col("lb") == F.col("a"))
    across = x.join(y, ["key"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & ~compared & alike)
    links = links.unionByName(verified(across.select("a", "b", "na", "nb").distinct(), "across"))
    release(reps, labelled_all, several)
    return members, links


def jaccard_components(docs: DataFrame, *, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links, itself included) of every row."""
    members, links = jaccard_links(docs, words=words, percent=percent)
    comp = connected_components(links.select("a", "b"), "linked")
    out = members.join(comp, members["rep"] == comp["node"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """docs' rows and columns, of each component the row with the smallest id; rows without an id or a shingle stay.

    Rows repeated under one id are one document, of which one row stays.
    """
    found = jaccard_components(docs, words=words, percent=percent)
    found = materialize(found.where("n_shingles > 0 and doc_id is not null"), "components")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = _only(docs, gone, gone.count(), "left_anti")
    again = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    n = again.count()
    if not n:
        return kept
    return _only(kept, again, n, "left_anti").unionByName(_only(kept, again, n, "left_semi").dropDuplicates(["doc_id"])).select(docs.columns)
