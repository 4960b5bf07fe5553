"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; the dynamic
program keeps the best score and the piece count that goes with it, never the pieces. Ties go to the
piece that starts first, as the public unigram tokenizer decides them (it visits starts from left to
right and replaces a path only by a strictly better one). A character without a piece of its own
costs the lowest score less 10 and counts as its UTF-8 bytes where all byte pieces exist, else as one
unknown piece per run.

Pieces hold the space mark only at their start or throughout, and none holds a line feed, so the
segmentation of a text is that of its chunks; scores are whole numbers, whose sums are exact.

Defined results: a null or empty text has no tokens; repeated rows are counted each; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from convolake.llm.kernels import trimming

SPACE_MARK = "▁"
_CHUNK = re.compile("▁*[^▁\n]+|▁+|\n")
CACHED_CHUNKS = 300_000


def piece_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter(dict):
    """chunk -> (tokens, score); computes and, up to a bound, remembers what is missing."""

    def __init__(self, vocabulary: list[tuple[str, float]], cached: int = CACHED_CHUNKS):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - 10
        self.bytes = all(f"<0x{b:02X}>" in self.automaton for b in range(256))
        self.cached = cached

    def viterbi(self, chunk: str) -> tuple[int, float]:
        n = len(chunk)
        score, count, lone = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(chunk):
            matches[end].append(found)
        for end in range(n):
            best, many, unk, single = None, 0, False, False
            for size, value in matches[end]:  # the longest first, so the first start wins a tie
                at = end + 1 - size
                single |= size == 1
                if best is None or score[at] + value > best:
                    best, many, unk = score[at] + value, count[at] + 1, False
            if not single and (best is None or score[end] + self.unknown > best):
                best, unk = score[end] + self.unknown, True
                many = count[end] + (len(chunk[end].encode()) if self.bytes else 0 if lone[end] else 1)
            score[end + 1], count[end + 1], lone[end + 1] = best, many, unk
        return count[n], score[n]

    def __missing__(self, chunk: str) -> tuple[int, float]:
        found = self.viterbi(chunk)
        if len(self) < self.cached and len(chunk) < 64:
            self[chunk] = found
        return found

    def count(self, text: str | None) -> tuple[int, float]:
        """Tokens of the text and the score of its best segmentation."""
        if not text:
            return 0, 0.0
        found = list(map(self.__getitem__, _CHUNK.findall(SPACE_MARK + text.replace(" ", SPACE_MARK))))
        return sum(f[0] for f in found), sum(f[1] for f in found)


@lru_cache(maxsize=1)
def counter_for(model: str, cached: int = CACHED_CHUNKS) -> UnigramCounter:
    """One counter for all tasks of a worker process, so that what one task has learned serves the next."""
    return UnigramCounter(piece_vocabulary(model), cached)


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_chars_counted, n_tokens and score of every whole text; nothing is shuffled."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_chars", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(model)
        for batch in trimming(batches):
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                own = part.column(1).to_pylist()
                found = [counter.count(t) for t in own]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t or "") for t in own], pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(counts, schema)
