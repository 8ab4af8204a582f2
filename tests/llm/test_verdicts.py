"""Verdicts of quality rules and places of shards against plain versions; the pipeline's first stage with them."""

import corpus_pipeline
from sheaf.llm.quality import COMMON, language_references, quality
from sheaf.llm.sharding import shard_by_slots
from tests.llm import brute


def test_quality_verdicts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    rows += [(10**6 + n, t.replace(" ", " zz") if n % 2 else t, None if n % 3 else lang) for n, (_, t, lang) in enumerate(rows[:60])]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = brute.quality_verdicts(rows, COMMON)
    assert sorted((r["doc_id"], r["kept"]) for r in quality(made).collect()) == sorted(want)
    assert 0.2 < sum(k for _, k in want) / len(want) < 1 and {k for _, k in want} == {True, False}


def test_given_references(spark, sf_dir):
    """Sound documents as the reference: junk alone can't become its own norm."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    sound = language_references(docs.where("lang = 'en'").select("text", "lang"))
    words = "the of and to in is that it for was".split()
    junk = spark.createDataFrame([(1, " ".join(f"{'#$%&*|'[i % 6] * (3 + i % 4)}{i}{'<>' * (i % 3)}" for i in range(120)), "en"), (2, " ".join(f"{w}{i}" for i in range(12) for w in words), "xx")], docs.schema)
    assert {r["doc_id"]: r["kept"] for r in quality(junk).collect()} == {1: True, 2: True}
    assert {r["doc_id"]: r["kept"] for r in quality(junk, references=sound).collect()} == {1: False, 2: True}


def test_quality_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute.quality_verdicts([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], COMMON)
    assert sorted(r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, sf_dir).collect()) == sorted(i for i, kept in want if kept)


def test_shards(spark, docs, rows):
    for n, slots in ((5, 64), (3, 16)):
        out = shard_by_slots(docs, shards=n, slots=slots).collect()
        assert sorted((r["doc_id"], r["size"], r["shard"]) for r in out) == sorted(brute.shards(rows, n, slots))


def test_many_equal_rows_are_numbered_in_runs(spark, monkeypatch):
    import sheaf.llm.sharding as module

    monkeypatch.setattr(module, "RUN", 10)
    same = spark.createDataFrame([(None, "copy")] * 400 + [(1, "x")], "doc_id long, text string").repartition(3)
    out = module.shard_by_slots(same, shards=2).collect()
    for s in {r["shard"] for r in out}:
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own)))
    assert len(out) == 401
