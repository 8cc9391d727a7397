import random

import pytest

#: Rows that every operator must take: nulls, empty and odd texts, repeated rows, a clashing column.
ODD = [
    (10, None, "en", "a", 0), (11, "", "en", "a", 0), (12, " \n\t ", None, "a", 3), (13, "one", "de", None, 3), (14, "one", "de", None, 3),
    (14, "one", "de", None, 3), (15, "<|endoftext|> x  y  z　w 's don't I'll\r\n\r\n end ", "en", "b", 1), (16, "é,é'é ÉÀ× a×b 12ab 3.4 ☃☃ 😀!", "fr", "b", 1),
    (17, "x" * 70_000, "en", "b", 70_000), (18, "ab " * 30_000, "en", "b", 90_000), (19, "İstanbul ΣΑΣ ǅ", "tr", "c", 5),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, "x", r[0]) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, id long")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


def prose(rng: random.Random, n: int, words: int = 400) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(words)][:n] if n < 0 else [f"w{rng.randint(0, words)}" for _ in range(n)]


@pytest.fixture(scope="session")
def near_docs(spark):
    """Groups of near copies around the threshold, exact copies and short texts."""
    rng, rows, i = random.Random(5), [], 0
    for _ in range(25):
        base = prose(rng, rng.choice([4, 15, 60, 200]), 5000)
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = f"v{rng.randint(0, 10**6)}"
            rows.append((i, " ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "a"), (i + 3, "A"), (i + 4, "a b")]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")
