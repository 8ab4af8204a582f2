"""The language model of higher orders, and the stored model: its probabilities sum to 1."""

import random
import uuid

import pytest

from sheaf.llm import katz
from tests.llm import brute


@pytest.fixture(scope="module")
def some():
    rng = random.Random(3)
    words = ["a", "b", "c", "d", "e", "longerword", "é", "x1"]
    return [(i, " ".join(rng.choice(words) if rng.random() < 0.9 else f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 40)))) for i in range(120)] + [(200, None), (201, "a a a")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_orders(spark, some, order):
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    want, _, _ = brute.katz_of_order(some, order)
    got = {r["doc_id"]: r["score"] for r in katz.katz_scores(docs, order=order).collect()}
    assert len(got) == len(some)
    for i, score in want:
        assert got[i] == pytest.approx(score, rel=1e-9)


def test_stored_model_sums_to_one(spark, some, tmp_path):
    """Over all words and one never seen, after histories that were seen often, once, never, and at the start."""
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    katz.katz_scores(docs, order=3, model=folder).count()
    model = katz.load(spark, folder)
    _, of, one = brute.katz_of_order(some, 3)
    words = [w for w in one if w != "</>"] + ["neverseen"]
    grams, histories = [], [["a", "b"], ["x1", "é"], ["nope", "a"], ["nope", "nope2"], [None], [None, "c"], ["w3", "a"]]
    for n, h in enumerate(histories):
        grams += [(n * 1000 + j, [*h, w]) for j, w in enumerate([*words, None])]
    found = {r["gram"]: r["p"] for r in katz.probabilities(model, spark.createDataFrame(grams, "gram long, words array<string>")).collect()}
    assert len(found) == len(grams)
    for n, h in enumerate(histories):
        assert sum(found[n * 1000 + j] for j in range(len(words) + 1)) == pytest.approx(1, abs=1e-9), h
    for n, (gram, words_) in enumerate(grams):
        if n % 7 == 0 and (words_[0] is None or len(words_) == 3):
            shown = ["<>" if w is None and i == 0 else "</>" if w is None else w for i, w in enumerate(words_)]
            assert found[gram] == pytest.approx(of(shown), rel=1e-9), words_


def test_hot_histories_of_an_order(spark, monkeypatch):
    """Many buckets and one phrase everywhere: histories spread over buckets give the same scores."""
    rows = [(i, "the same phrase again and again " * 6 + f"w{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = dict(brute.katz_of_order(rows, 3)[0])
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 20)
    got = {r["doc_id"]: r["score"] for r in katz.katz_scores(docs, order=3).collect()}
    assert got == {i: pytest.approx(x, rel=1e-9) for i, x in want.items()}
