"""Texts made to collide under polynomial hashes, keys that are refused, and folders that must be shared."""

import random

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from sheaf.llm import tables
from sheaf.llm.bpe import Encoder
from sheaf.llm.near_dups import near_dups
from sheaf.llm.quality import _duplicate_lines, quality
from sheaf.llm.substring_dedup import substring_dedup
from sheaf.llm.token_counts import id_bytes, write_flat
from sheaf.llm.words import Lanes, Words, of_column, raw

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def thue_morse(n):
    """A string of 2 ** n letters and its complement, whose polynomial hashes modulo 2 ** 64 are equal from 1,024 letters on."""
    text, swap = "a", str.maketrans("ab", "ba")
    for _ in range(n):
        text += text.translate(swap)
    return text, text.translate(swap)


X, Y = thue_morse(11)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")


def test_words_have_their_own_hashes():
    words = [X, Y, "", "a", "a\0", "\0", "abcdefgh", "abcdefghi", "abcdefghabcdefgh", "abcdefgh" * 3]
    assert len(set(of_column(pa.array([w or " " for w in words])).hash.tolist())) == len(words) - 1


def test_lanes_compare_bytes():
    data = np.frombuffer(b"abcdefghij|abcdefghij|abcdefghik|ab", np.uint8)
    lanes = Lanes(data, np.array([0, 11, 22, 33]), np.array([10, 10, 10, 2]))
    assert lanes.same(lanes, np.array([1, 0, 0, 0])).tolist() == [True, True, False, False]


def test_fragments_are_told_apart_by_bytes(monkeypatch):
    code = Encoder(PATH)
    for keys in (Encoder._keys, lambda lanes, mark, seed: (lanes.hash(seed) ^ mark.astype(np.uint64)) % np.uint64(4001)):
        monkeypatch.setattr(Encoder, "_keys", staticmethod(keys))
        code._forget()
        rng = random.Random(4)
        texts = [X, Y, "a <|endoftext|> b", *(" ".join(rng.choice(["of", "the", "and", "é", "日本", "12"]) + str(rng.randint(0, 40)) for _ in range(30)) for _ in range(6))]
        ids, cuts = code.encode_texts(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[cuts[i] : cuts[i + 1]].tolist() == code.library.encode(t, add_special_tokens=False).ids


def test_operators_tell_them_apart(spark):
    assert [r["kept"] for r in near_dups(frame(spark, [(1, X), (2, Y)])).collect()] == [True, True]
    assert quality(frame(spark, [(1, f"{X}\n{Y}\n{X}")])).first()["n_dup_lines"] == 1
    passage = " ".join(f"w{i}" for i in range(60))
    out = {r["doc_id"]: r["n_removed"] for r in substring_dedup(frame(spark, [(1, f"{X} {passage}"), (2, f"{Y} {passage}"), (3, f"{Y} {passage}")])).collect()}
    assert out == {1: 0, 2: 60, 3: 61}


def test_lines_of_one_hash(monkeypatch):
    """Lines are compared by their bytes even if the hash says nothing."""
    monkeypatch.setattr(Lanes, "hash", lambda self, seed=0: np.full(len(self.many), seed % 2, np.uint64))
    data, offsets = raw(pa.array(["a\nb\na\nc\nb\n\na", "x\ny", "q\nq"]))
    assert _duplicate_lines(data, offsets, Words(data, offsets)).tolist() == [3, 0, 1]


def test_ids_are_whole_numbers(spark):
    docs = spark.createDataFrame([("x1", "a b"), ("x2", "a b")], "doc_id string, text string")
    for operator in (near_dups, substring_dedup):
        with pytest.raises(TypeError):
            operator(docs)


def test_width_holds_the_vocabulary(spark, docs):
    assert id_bytes(PATH, 50256) == 2 and id_bytes(PATH, 70_000) == 4
    with pytest.raises(ValueError, match="do not fit"):
        write_flat(docs, PATH, "file:///nowhere", end=70_000, width=2)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    monkeypatch.setattr(tables, "ready", lambda spark: spark)
    none = type("Option", (), {"isDefined": lambda self: False})()
    context = type("Context", (), {"master": "spark://host:7077"})()
    context._jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: none})()})()
    spark = type("Session", (), {"conf": type("Conf", (), {"get": lambda self, *a: None})(), "sparkContext": context})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_folder(spark)


def test_a_long_owner_and_a_long_run(spark, monkeypatch):
    """Runs divided in parts, an owner's passages in several groups: the same words go."""
    import sheaf.llm.substring_dedup as module

    rng = random.Random(5)
    long = [f"v{rng.randrange(400)}" for _ in range(6000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[100:5900])), (3, " ".join(["x", *long[3000:3200], "y"])), (4, " ".join(long[5:60] + ["z"] + long[200:249]))]
    want = sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup(frame(spark, rows)).collect())
    assert want == [(1, 0), (2, 5800), (3, 200), (4, 55)]
    monkeypatch.setattr(module, "SHARD_WORDS", 500)
    monkeypatch.setattr(module, "PART_WINDOWS", 40)
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup(frame(spark, rows)).collect()) == want
