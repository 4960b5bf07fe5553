import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key double, n long"


def make_docs(seed=1, n=120):
    """Rows with nulls in every column, empty and long texts, ties, repeats and near copies."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgéñßо") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    texts = [None, "", " \t\n ", "one", "One two", "ONE two three", "x" * 3000, "a b c d e " * 1500, "<|endoftext|> it's 12 <s> ▁ \x85\xa0 end　."]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.4 and len(texts) > 12:
            words = (rng.choice(texts[9:]) or "").split(" ")
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 8, 15, 40, 90, 200]))) + rng.choice(["", ".", "\n"]))
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", None]), None if i % 7 == 0 else len(t or ""), "clash", 1.5, i))
    return rows


@pytest.fixture(scope="session")
def doc_rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, DOC_SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
