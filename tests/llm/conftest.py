import random

import pytest

VOCABULARY = [f"{a}{b}" for a in "abcdefgh" for b in ("ar", "en", "is", "ou", "é")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(id, text): null and empty texts, copies, near copies, shared passages, ties, repeated rows, a long text."""
    rng = random.Random(7)
    base, passage = prose(rng, 120), prose(rng, 70)
    words = base.split(" ")
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "one two three"), (7, base), (8, base), (9, base.upper())]
    for i in range(10, 40):
        own = list(words)
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(len(own))] = rng.choice(VOCABULARY)
        out.append((i, " ".join(own)))
    out += [(i, prose(rng, rng.randint(5, 60)) + " " + passage + "\n" + prose(rng, rng.randint(5, 60))) for i in range(40, 60)]
    out += [(i, prose(rng, rng.randint(1, 80))) for i in range(60, 90)]
    out += [(90, "x " * 200), (91, "x " * 210), (92, prose(rng, 6000)), (93, "under the MIT license, cc-by-nc; Apache License, Version 2.0 İé ﬁ 😀"), (94, "a line with words\n" * 8), (95, "### $$$ *** |||"), (96, "<|endoftext|> it's  here\n\n now then <|endo")]
    return out + [(97, "said twice in one row"), (97, "said twice in one row")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with further columns whose names operators may use themselves."""
    every = [(i, t, ("en", "de", None)[n % 3], "s", len(t or ""), n, "x", n, None, n) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long, id long, key string, band long, spans string, row long").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id < 0")


@pytest.fixture(scope="session")
def nulls(spark):
    """Rows without an id."""
    return spark.createDataFrame([(None, "a b c d e f", None), (None, None, None), (None, "a b c d e f", "en"), (5, "a b c d e f", "en")], "doc_id long, text string, lang string")
