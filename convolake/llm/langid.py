"""Language ID by multilingual mixture inference.

Each language has smoothed frequencies of hashed byte n-grams inside words, learned from a bounded,
documented sample (`most_per_language` documents each). A document is a mixture of languages: by
expectation-maximisation over its words, whose likelihoods come from their n-grams, it gets language
proportions. Candidate sets are the best single language and those of the 2, 3, ... largest
proportions, up to all languages; the set with the best log likelihood less a penalty per language
is chosen, and its largest proportion is the prediction.

`keep_identified` is the filter: it keeps documents in which one language has a share of their words,
and whose n-grams some language makes likelier than chance does (every n-gram bucket alike); text in
a language that was not learned, or noise, is not. What it keeps carries the predicted language.

Defined results: null text and text without a letter is `und` with score 0; without any learned
language everything is `und`; ties go to the language first by code point; null languages are not
learned from; repeated rows are predicted alike; only doc_id and text are read for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolake.llm.common import held_out
from convolake.llm.kernels import Texts, bracketed, ngrams, texts, trimming

UNKNOWN = "und"
#: A document whose languages all have less of its words than this is not identified: it is in four languages or more, as one of three has a third at least.
LEAST_SHARE = 1 / 3
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _word_grams(t: Texts, buckets: int, lo: int, hi: int):
    """n-gram buckets and words of the distinct words with letters; their occurrences and texts."""
    starts, ends, where = t.words()
    letters = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(_LETTER[t.data], out=letters[1:])
    good = letters[ends] > letters[starts]
    starts, ends, where = starts[good], ends[good], where[good]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, 0
    _, first, which = np.unique(t.hashes(starts, ends), return_index=True, return_inverse=True)
    bucket, word = ngrams(bracketed(t, starts[first], ends[first]), lo, hi, buckets)
    return bucket, word, which, where, len(first)


@dataclass
class LanguageModel:
    languages: list[str]
    logp: np.ndarray  # buckets x languages
    lo: int
    hi: int
    rounds: int = 8
    #: Log likelihood that another language in the set has to win, per log of the document's words.
    penalty: float = 3.0
    #: A word's n-grams overlap, so its log likelihood counts this much.
    temper: float = 0.4

    def proportions(self, t: Texts) -> np.ndarray:
        """texts x languages: the proportions within the chosen set, 0 outside; all 0 without letters."""
        return self.judge(t)[0]

    def judge(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The proportions, and each text's log likelihood (each word in its likeliest language) above that of chance."""
        k, n = len(self.languages), len(t)
        bucket, word, which, where, words = _word_grams(t.lowered(), len(self.logp), self.lo, self.hi)
        out, above = np.zeros((n, k)), np.zeros(n)
        if not words or not k:
            return out, above
        each = np.stack([np.bincount(word, self.logp[bucket, j], words) for j in range(k)], 1)
        excess = each.max(1) + np.bincount(word, minlength=words) * np.log(len(self.logp))
        above = np.bincount(where, excess[which], n)
        each *= self.temper
        top = each.max(1, keepdims=True)
        each = np.exp(np.maximum(each - top, -60.0))  # relative likelihoods of distinct words
        # equal words of a text are one row with a count
        code, times = np.unique(where * np.int64(words) + which, return_counts=True)
        where, like = code // words, each[code % words]
        texts_in, begin = np.unique(where, return_index=True)
        row = np.searchsorted(texts_in, where)
        m = len(texts_in)
        total = np.add.reduceat(times.astype(float), begin)
        alone = np.add.reduceat(np.log(like) * times[:, None], begin, axis=0)

        def em(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pi = allowed / allowed.sum(1, keepdims=True)
            for _ in range(self.rounds):
                r = like * pi[row]
                r *= (times / np.maximum(r.sum(1), 1e-300))[:, None]
                pi = np.add.reduceat(r, begin, axis=0) / total[:, None]
            score = np.add.reduceat(np.log(np.maximum((like * pi[row]).sum(1), 1e-300)) * times, begin)
            return pi, score

        first = alone.argmax(1)
        best = np.zeros((m, k))
        best[np.arange(m), first] = 1.0
        value = alone[np.arange(m), first]
        if k > 1:
            pi, _ = em(np.ones((m, k)))
            rank = np.argsort(np.argsort(-pi, axis=1, kind="stable"), axis=1, kind="stable")
            for size in range(2, k + 1):
                share, score = em((rank < size).astype(float))
                score = score - self.penalty * (size - 1) * np.log(total + 1)
                better = score > value
                best[better], value[better] = share[better], score[better]
        out[texts_in] = best
        return out, above


def fit(sample: list[tuple[str, str]], *, buckets: int = 1 << 16, lo: int = 2, hi: int = 4, smoothing: float = 0.5) -> LanguageModel:
    """Learns from (text, language) pairs."""
    languages = sorted({lang for _, lang in sample})
    counts = np.zeros((buckets, len(languages)))
    for j, lang in enumerate(languages):
        for _, _, t in texts(pa.array([x for x, own in sample if own == lang], pa.string())):
            bucket, word, which, _, n = _word_grams(t.lowered(), buckets, lo, hi)
            if n:
                counts[:, j] += np.bincount(bucket, np.bincount(which, minlength=n)[word], buckets)
    logp = np.log((counts + smoothing) / (counts.sum(0) + smoothing * buckets)) if languages else counts
    return LanguageModel(languages, logp, lo, hi)


def training_sample(docs: DataFrame, most_per_language: int) -> list[tuple[str, str]]:
    """Texts that are not held out, about most_per_language of each language at most, by a hash of the id."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    many = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}  # one row a language
    share = F.lit(0.0)
    for lang, n in sorted(many.items()):
        share = F.when(F.col("lang") == lang, min(1.0, most_per_language / n)).otherwise(share)
    # the share is drawn by the row, so rows repeated under one id are not chosen together; the limit bounds what is collected
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003))
    rows = own.where(u < share * 1_000_003).select("doc_id", "text", "lang").limit(2 * most_per_language * max(1, len(many))).collect()
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: (r[0], r[1], r[2]))]


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (the predicted language's proportion) and proportions (map, of the chosen set)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_set", T.ArrayType(T.StringType()))])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages x 8 bytes

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in trimming(batches):
            for lo, hi, t in texts(batch.column(1)):
                pi = own.proportions(t)
                some = pi.sum(1) > 0 if pi.shape[1] else np.zeros(len(pi), bool)
                pick = np.where(some, pi.argmax(1) if pi.shape[1] else 0, len(own.languages))
                score = np.where(some, np.minimum(pi.max(1, initial=0.0), 1.0), 0.0)
                sets = [[own.languages[j] for j in np.flatnonzero(p > 0)] for p in pi]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names[pick], pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string()))], names=schema.names)

    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    # a text without a letter in Unicode's sense is emptied, so that other high bytes don't count
    return docs.select("doc_id", F.when(letters, F.col("text")).otherwise("").alias("text")).mapInArrow(predict, schema)


def identify_languages(docs: DataFrame, *, most_per_language: int = 1500, **fitting) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_set; learns from docs' own lang column."""
    model = fit(training_sample(docs, most_per_language), **fitting)
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_set")


def keep_identified(docs: DataFrame, *, least_share: float = LEAST_SHARE, most_per_language: int = 1500, **fitting) -> DataFrame:
    """docs' rows and columns, without those that are `und`, have no language of least_share of their words, or are no likelier than chance.

    lang becomes the predicted language. Rows are judged in place, so nothing is shuffled.
    """
    model = fit(training_sample(docs, most_per_language), **fitting)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages x 8 bytes
    names, place, lang = docs.columns, docs.columns.index("text"), docs.columns.index("lang")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        languages = np.array([*own.languages, UNKNOWN], object)
        for batch in trimming(batches):
            letters = batch.column(len(names)).to_numpy(zero_copy_only=False)
            for lo, hi, t in texts(batch.column(place)):
                pi, above = own.judge(t)
                keep = (pi.max(1, initial=0.0) >= least_share) & (above >= 0) & letters[lo:hi]
                columns = [c.slice(lo, hi - lo) for c in batch.columns[: len(names)]]
                if pi.shape[1]:
                    columns[lang] = pa.array(languages[pi.argmax(1)], pa.string())
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in columns], names=names)

    return docs.select("*", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("_letters")).mapInArrow(judged, docs.schema)
