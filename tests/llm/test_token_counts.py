import random

import pytest

from convolake.llm import token_counts
from convolake.llm.queries import UNIGRAM_MODEL, tokenizer_path


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.piece_vocabulary(tokenizer_path(UNIGRAM_MODEL))


@pytest.fixture(scope="module")
def brute(vocabulary):
    from tokenizers import Tokenizer, models

    whole = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    return lambda text: len(whole.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0


def test_counts_equal_the_tokenizer(docs, doc_rows, brute):
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, tokenizer_path(UNIGRAM_MODEL)).collect()}
    assert got == {r[0]: brute(r[1] or "") for r in doc_rows}


def test_random_strings(vocabulary, brute):
    rng = random.Random(3)
    counter = token_counts.UnigramCounter(vocabulary, cached=10)
    alphabet = "aeinorst  .\n▁é漢\U0001f600ñ\x00<>0xA"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert counter.count(text)[0] == brute(text), repr(text)


def test_ties_go_to_the_first_start():
    counter = token_counts.UnigramCounter([("a", -1.0), ("aa", -2.0), ("▁", -1.0), ("▁a", -2.0)])
    assert counter.viterbi("▁aa") == (2, -3.0)  # "▁a" + "a": the last piece "aa" starts first
    assert counter.viterbi("aaaa") == (2, -4.0)


def test_empty(no_docs):
    assert token_counts.count_tokens(no_docs, tokenizer_path(UNIGRAM_MODEL)).count() == 0
