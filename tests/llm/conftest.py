import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node long, k1 long, u string, cluster int, part int, score double, label string"


def corpus(n=60, seed=0):
    """Invented prose with exact and near copies, shared passages, and repeated lines."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, base = words(60), words(90)
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0 and texts:
            texts.append(rng.choice(texts))
        elif kind == 1:
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        elif kind == 2:
            own = words(40)
            at = rng.randrange(40)
            texts.append(" ".join(own[:at] + passage + own[at:]))
        elif kind == 3:
            own = [" ".join(words(8)) for _ in range(4)] + [" ".join(base[:12]), " ".join(base[:11] + words(1))]
            rng.shuffle(own)
            texts.append("\n".join(own))
        else:
            texts.append(" ".join(words(rng.randint(1, 80))))
    return texts


def messy_rows():
    """Nulls in every column, empty and very long texts, repeated rows, and other columns
    whose names clash with those inside the operators."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    rows = [
        (None, None, None, None), (None, "some text of a row without an id", "en", "a"), (1, None, "en", "a"), (2, "", None, None),
        (3, " \t\n ", "de", "b"), (4, "same words here again and again and again", "en", "a"),
        (4, "same words here again and again and again", "en", "a"), (5, "same words here again and again and again", None, "b"),
        (6, long, "en", "a"), (7, long, "en", None), (8, "one", "fr", "b"), (9, "你好 世界 \U0001f600 café", "zh", "b"),
        (10, "%%% ### 12 34", "en", "a"), (-5, "line one\nline one\n\nline one ", "en", "c"),
    ]
    return [(i, t, la, s, None, None, 7, 8, "x", 9, None, 0.5, "y") for i, t, la, s in rows]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).persist()
