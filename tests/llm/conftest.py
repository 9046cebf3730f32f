import random

import pytest

# Column names that the operators use themselves.
CLASH = "n_words bigint, kept boolean, row string, t string, digest string, size int, score double, text2 string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(300)]
    long_text = " ".join(rng.choices(vocabulary, k=60_000))
    texts = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (None, "one two three four five six", "b"), (None, None, None),
        (5, long_text, "b"), (6, "x y z", "b"), (6, "x y z", "b"), (7, "Été ß İ 漢字 😀 “q” don't", "é"), (8, "word\r\nword\x0bword", "a"),
        (9, "single", "a"), (10, "\n\n\nline\nline\n\nline", "a"), (11, "A-B_C|D#E", ""),
    ]
    rows = [(i, t, s, 1, True, "r", "t", "d", 2, 0.5, "z") for i, t, s in texts]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, source string, {CLASH}")


@pytest.fixture(scope="session")
def prose():
    """Plain documents with copies, near copies and repeated parts: (doc_id, text, source)."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijk", k=rng.randint(2, 8))) for _ in range(400)]
    shared = rng.choices(vocabulary, k=40)
    docs = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randint(20, 150))
        if i % 3 == 0:
            words[5:5] = shared
        docs.append(words)
    for i in range(40):
        words = list(docs[i % 7])
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append(words)
    return [(i, " ".join(w) + (".\n" if i % 2 else ""), f"s{i % 4}" if i % 11 else None) for i, w in enumerate(docs)]


@pytest.fixture(scope="session")
def prose_table(spark, prose):
    return spark.createDataFrame(prose, "doc_id bigint, text string, source string").repartition(6)
