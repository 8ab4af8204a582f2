"""Each operator against its plain version, and on empty tables, null ids and columns of clashing names."""

import hashlib
import zlib

import numpy as np
import pytest

import public_tokenizers
from tests.llm import brute
from sheaf.llm.automaton import Automaton
from sheaf.llm.bpe import Encoder, bpe_round_trip
from sheaf.llm.decontaminate import contamination
from sheaf.llm.katz import katz_scores
from sheaf.llm.licenses import license_scan
from sheaf.llm.near_dups import near_dups, shingle_sets, sketches
from sheaf.llm.quality import COMMON, distance, quality, word_bounds
from sheaf.llm.sharding import first_map, grown, rebalanced, shard_by_slots
from sheaf.llm.substring_dedup import substring_dedup
from sheaf.llm.token_counts import corpus_token_counts, token_counts
from sheaf.llm.token_output import pack, read_tokens, token_round_trip, unpack, write_tokens
from sheaf.llm.words import of_column

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_near_dups(docs, rows, none, nulls):
    found = {r["doc_id"]: r for r in near_dups(docs, k=4).collect()}
    want = brute.near_dups(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())
    assert len({want[i][1] for i in range(10, 40)}) < 30
    assert near_dups(docs, k=4).count() == len(rows)
    assert near_dups(none).count() == 0
    assert got(near_dups(nulls, k=4), "doc_id", "component_id", "kept") == [(5, 5, True), (None, None, True), (None, None, True), (None, None, True)]


def test_near_dups_in_hot_buckets(spark, monkeypatch):
    """A chain of copies of copies, searched in many small cells."""
    import random

    import sheaf.llm.near_dups as module

    monkeypatch.setattr(module, "CELL_BYTES", 4096)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = list(words)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        if i % 10 == 0:
            words = own
        rows.append((i, " ".join(own)))
    found = {r["doc_id"]: r["component_id"] for r in near_dups(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert found == {i: c for i, (_, c) in brute.near_dups(rows).items()}


def test_near_dups_beyond_the_partners(spark):
    """A pair that its member's partners leave out, in buckets of two only."""
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, " ".join(words[100:] + words[:20]))], "doc_id long, text string")
    for partners in (0, 3):
        assert got(near_dups(docs, k=4, partners=partners), "doc_id", "component_id") == [(1, 1), (2, 1), (3, 3)]


def test_sketch_agrees_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = np.sort(pool[:300]), np.sort(pool[100:])
    s = sketches(np.concatenate((a, b)), np.array([0, 300, 600]))
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.16
    few = sketches(np.array([7], np.uint64), np.array([0, 1, 1]))
    assert (few[0] > 0).all() and not few[1].any()


def test_contamination(spark, docs, rows, none, nulls):
    items = [(1, rows[45][1]), (2, "said twice in one row"), (2, "one"), (11, None), (12, "..."), (None, "one two three"), (13, " ".join(rows[92][1].split()[100:140])), (14, rows[92][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = contamination(docs, bench)
    assert got(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(brute.contamination(rows, items), key=repr)
    assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in out.collect())
    assert contamination(none, bench).count() == 0
    assert {r["n_hit"] for r in contamination(docs, bench.where("item_id < 0")).collect()} == {0}
    assert contamination(nulls, bench).count() == 4


def test_katz(docs, rows, none, nulls):
    want, p2, one = brute.katz(rows)
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    out = katz_scores(docs).cache()
    assert got(out, *columns) == sorted((w[:5] for w in want), key=repr)
    base, score = {w[0]: w[5] for w in want}, {w[0]: w[6] for w in want}
    for r in out.collect():
        assert r["base_score"] == pytest.approx(base[r["doc_id"]], rel=1e-9) and r["score"] == pytest.approx(score[r["doc_id"]], rel=1e-9)
    for h in ("<>", "x", "aar", "never"):
        assert sum(p2(h, w) for w in one) + p2(h, "@unseen") == pytest.approx(1)
    assert katz_scores(none).count() == 0
    assert got(katz_scores(nulls), "doc_id", "held_out") == [(5, False), (None, True), (None, True), (None, True)]


def test_licenses(docs, rows, none, nulls, spark):
    out = license_scan(docs)
    assert got(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(brute.licenses(rows), key=repr)
    assert license_scan(none).count() == 0 and license_scan(nulls).count() == 4
    notice = "x y Permission is hereby granted, free of charge, to any person obtaining a copy of this new software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies. z"
    r = license_scan(spark.createDataFrame([(1, notice)], "doc_id long, text string")).first()
    assert (r["labels"], r["base_labels"], r["n_base"]) == ("mit", "", 0) and 0.6 < r["score"] < 1


def test_sharding(docs, rows, none, nulls):
    out = shard_by_slots(docs, shards=5).collect()
    assert len(out) == len(rows) and {r["law"] for r in out} == {"bytes"}
    total = {}
    for r in out:
        total.setdefault(r["shard"], []).append(r)
    for own in total.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    texts = dict(rows)
    assert all(r["size"] == 8 + len((texts[r["doc_id"]] or "").encode()) and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in out)
    sums = {s: sum(r["size"] for r in own) for s, own in total.items()}
    assert max(sums.values()) - min(sums.values()) <= max(r["size"] for r in out)
    assert shard_by_slots(none).count() == 0 and shard_by_slots(nulls).count() == 4


def test_slot_maps():
    rng = np.random.default_rng(5)
    load = {s: int(x) for s, x in enumerate(rng.integers(1, 1000, 512))} | {7: 30_000}
    old = first_map(512, 8)
    new = rebalanced(old, load, 8)
    sums = lambda m, n: [sum(load[s] for s in range(512) if m[s] == i) for i in range(n)]
    rest = sums(new, 8)
    rest.remove(max(rest))
    assert max(rest) - min(rest) < 1000 and sum(a != b for a, b in zip(old, new, strict=True)) < 400
    more = grown(new, load, 8)
    assert all(a == b or b == 8 for a, b in zip(new, more, strict=True)) and 0 < sums(more, 9)[8] <= sum(load.values()) / 9


def test_token_counts(spark, docs, rows, none, nulls, tmp_path):
    code = Encoder(PATH, special=False)
    want = sorted(((i, len(code.library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)
    assert got(corpus_token_counts(spark, docs, PATH), "doc_id", "n_tokens") == want
    assert corpus_token_counts(spark, none, PATH).count() == 0 and corpus_token_counts(spark, nulls, PATH).count() == 4
    # Blocks that hold no end, one, or many; a file that doesn't close.
    ids = np.array([5, 5, 9, 9, 5, 5, 5, 5, 5, 5, 5, 9, 5, 5], "<u2")
    (tmp_path / "a").write_bytes(ids.tobytes())
    (tmp_path / "b").write_bytes(b"")
    files = spark.createDataFrame([(f"file://{tmp_path}/a", 1, 28), (f"file://{tmp_path}/b", 2, 0)], "uri string, file long, bytes long")
    for block in (1, 2, 3, 100):
        assert got(token_counts(files, end=9, block=block), "place", "start", "n_tokens", "ended") == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 7, True), (3, 12, 2, False)]


def test_quality(docs, rows, none, nulls):
    out = quality(docs)
    assert got(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(brute.quality(rows), key=repr)
    assert not any(r["kept"] and r["base_failed"] for r in out.collect())
    assert quality(none).count() == 0 and quality(nulls).count() == 4
    assert distance(np.array([[1.0, 0], [1, 1], [0, 0]]), np.array([[0.0, 1], [1, 1], [1, 1]])).tolist() == [1.0, 0.0, 0.0]


def test_quality_verdict(spark):
    sound = [(i, " ".join(["the quick brown fox and a lazy dog were of one mind", f"about item {i} on day {i * 7}", "which no other beast in the wood had known until then"] + [f"word{j * i % 97} and" for j in range(30)]), "en") for i in range(1, 31)]
    junk = [(99, " ".join(f"{'#$%&*|'[i % 6] * (3 + i % 4)}{i}{'<>' * (i % 3)}" for i in range(120)), "en")]
    out = {r["doc_id"]: r for r in quality(spark.createDataFrame(sound + junk, "doc_id long, text string, lang string")).collect()}
    assert not out[99]["base_failed"] and not out[99]["kept"] and all(out[i]["kept"] for i in range(1, 31))


def test_quality_of_common_words(spark, sf_dir):
    """Texts without a common word and texts of another language go (those of the like es and fr from 400 words on); sound ones stay."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet").where("quality = 1 and toxic = 0")
    sound = [(r["doc_id"], r["text"], r["lang"]) for r in docs.join(labels, "doc_id", "left_semi").collect() if len(r["text"].split()) >= 60]
    bare = [(10**6 + i, " ".join(w for w in t.split() if w.strip(".,;:!?-\"'()").lower() not in COMMON[lang]), lang) for i, t, lang in sound]
    bare = [x for x in bare if len(x[1].split()) >= 60]
    foreign = [(2 * 10**6 + i, t, {"en": "fr", "de": "en", "fr": "en", "es": "en"}[lang]) for i, t, lang in sound if lang != "en" or i % 10 == 0]
    near = [(3 * 10**6 + i, t, {"fr": "es", "es": "fr"}[lang]) for i, t, lang in sound if lang in ("fr", "es") and len(t.split()) >= 400]
    # Few beside the corpus, so that the references stay what they are.
    bare, foreign, near = bare[::25], foreign[::5], near[::2]
    extra = bare + foreign + near
    out = {r["doc_id"]: r for r in quality(docs.union(spark.createDataFrame(extra, docs.schema))).collect()}
    share = lambda some: np.mean([out[x[0]]["kept"] for x in some if not out[x[0]]["base_failed"]])
    assert min(len(bare), len(foreign), len(near)) >= 5
    assert share(bare) == 0 and share(foreign) < 0.05 and share(near) == 0
    assert share(sound) > 0.99


def test_word_bounds():
    """Above what chance makes of a length, below the distance of a text without common words."""
    rng, q = np.random.default_rng(3), np.append(1 / np.arange(3, 33), 8.0) * 1000
    none = distance(np.array([[0.0] * 30 + [1]]), q[None])[0]
    for n in (100, 200, 1000, 5000):
        drawn = distance(rng.multinomial(n, q / q.sum(), 2000).astype(float), np.tile(q, (2000, 1)))
        assert np.quantile(drawn, 0.99) < word_bounds(np.array([n]), q[None], 0.6)[0] < none
    assert word_bounds(np.array([50]), np.array([[0.0] * 30 + [7]]), 0.6).tolist() == [0.0]


def test_bpe(docs, rows, none, nulls):
    library = Encoder(PATH).library
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), brute.sha(library.decode(ids, skip_special_tokens=False))))
    assert got(bpe_round_trip(docs, PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert all(r["decoded"] == (dict(rows)[r["doc_id"]] or "") for r in bpe_round_trip(docs, PATH, texts=True).collect())
    assert bpe_round_trip(none, PATH).count() == 0 and bpe_round_trip(nulls, PATH).count() == 4


def test_bpe_cuts_hold_for_odd_texts():
    import random

    import pyarrow as pa

    code, rng = Encoder(PATH), random.Random(2)
    parts = ["a", "'s", "'re", " ", "  ", "\n", "\n\n", "\t", "é", "ß", " ", "　", " ", "\u0085", "日本", "<|endoftext|>", "<|endo", ">", "?", "12", "\r\n", "\x0b", "\x1c", "​", "😀", "of the", ". ", "\x7f", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    ids, cuts = code.encode_texts(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == code.library.encode(t, add_special_tokens=False).ids, t


def test_token_output(spark, docs, rows, none, nulls, tmp_path):
    library = Encoder(PATH).library
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got(token_round_trip(spark, docs, PATH), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert token_round_trip(spark, none, PATH).count() == 0
    assert got(token_round_trip(spark, nulls, PATH), "doc_id", "start")[0] == (5, 15)
    manifest, token = write_tokens(spark, docs, PATH, f"file://{tmp_path}/t")
    assert all(r["ids"][-1] == 2 and len(r["ids"]) == r["n_tokens"] for r in read_tokens(manifest, token, ids=True).collect())


def test_variable_length_code():
    rng = np.random.default_rng(4)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert (unpack(*pack(x), n) == x).all()


def test_substring_dedup(docs, rows, none, nulls):
    want = sorted(((i, n, gone, brute.sha(kept)) for i, n, gone, kept in brute.substring(rows)), key=repr)
    out = substring_dedup(docs, texts=True)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert all(r["kept_text"] == dict(rows)[r["doc_id"]] for r in out.where("n_removed = 0").collect())
    assert substring_dedup(none).count() == 0
    assert {r["n_removed"] for r in substring_dedup(nulls, window=3).collect()} == {0}


def test_substring_dedup_beyond_65536_buckets(rows, tmp_path, monkeypatch):
    """Owners come back to their own windows when bucket numbers need more than 16 bits."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    import sheaf.llm.substring_dedup as module

    monkeypatch.setattr(module.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    monkeypatch.setattr(module, "put_file", lambda folder, name, write: write(f"{folder}/{name}"))
    source = pa.RecordBatch.from_pydict({"key": pa.array(range(len(rows)), pa.int64()), "id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows])})
    found = []
    for buckets in (8, 70_000):
        folder = tmp_path / str(buckets)
        folder.mkdir()
        asked = pa.Table.from_batches(module._ask(iter([source]), 50, buckets, str(folder)))
        answers = sorted(module._answer(asked).to_pylist(), key=lambda r: r["bucket"])
        monkeypatch.setattr(module, "_answers", lambda path, chunk, answers=answers: [r for r in answers if r["chunk"] == chunk])
        index = pa.Table.from_batches(pq.read_table(folder, schema=module._INDEX).to_batches())
        found.append(sorted((r["key"], x["start"], x["windows"], x["owner"]) for b in module._runs_of(iter(index.to_batches()), "") for r in b.to_pylist() for x in r["runs"]))
    assert found[0] == found[1] and len(found[0]) > 10


def test_automaton():
    import random

    rng = random.Random(6)
    texts = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 40))]) for i in range(8)]
    known = Automaton(texts)
    for _ in range(200):
        q, below, window = [rng.choice("abcd") for _ in range(rng.randint(0, 30))], rng.randint(0, 8), rng.randint(1, 6)
        have = {tuple(t[s : s + window]) for i, t in texts if i < below for s in range(len(t) - window + 1)}
        hit = {s + j for s in range(len(q) - window + 1) if tuple(q[s : s + window]) in have for j in range(window)}
        assert {x for a, b in known.shared(q, window, below) for x in range(a, b)} == hit


def test_sets_of_short_texts():
    import pyarrow as pa

    sets, cuts = shingle_sets(of_column(pa.array(["a b", "", None, "a b c d e", "a b a b a b a b"]), lower=True), 4)
    assert np.diff(cuts).tolist() == [1, 0, 0, 2, 2]
