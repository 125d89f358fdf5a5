import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and blank texts, repeated rows, ties, long texts, and columns named like those that operators use."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    texts = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (5, "a b c d e f g"), (6, "A B c d e f g"), (7, long), (8, long + " tail"), (9, "x" * 20_000), (10, "né 🦊 日本語 text 123"), (None, "one"), (None, None), (11, "\u0001 ﻿")]
    rows = [(i, t, "en", "s", len(t) if t is not None else None, "c", 1, "k", "b", 2, 0.5, [1]) for i, t in texts]
    return spark.createDataFrame(rows, DOC + ", chunk string, _key long, key string, _text string, bucket int, score double, ids array<int>")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.filter("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def families(spark):
    """Near copies of several degrees, some of which hang together only by others, beside unlike texts."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, n = [], 0
    for size in (1, 4, 6, 12, 60, 200):
        for _ in range(6):
            base = [word() for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 3, 5, 8):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(len(copy))] = word()
                rows.append((n, " ".join(copy), "en", "s", 0))
                n += 1
        chain = [word() for _ in range(size)]
        for _ in range(15):
            rows.append((n, " ".join(chain), "en", "s", 0))
            n += 1
            for _ in range(max(1, size // 60)):
                chain[rng.randrange(len(chain))] = word()
    return spark.createDataFrame(rows, DOC)
