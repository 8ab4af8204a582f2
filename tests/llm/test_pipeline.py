"""The pipeline, stage by stage, against plain versions."""

import corpus_pipeline
import public_tokenizers
from tests.llm import brute
from sheaf.llm.bpe import Encoder
from sheaf.llm.quality import COMMON


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {i for i, k in brute.quality_verdicts([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], COMMON) if k}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept]
    found = brute.near_dups(rows, k=5)
    rows = [(i, t) for i, t in rows if found[i][1] == i]
    rows = [(i, " ".join(kept.split()) if gone else t) for (i, t), (_, _, gone, kept) in zip(rows, brute.substring(rows), strict=True)]
    clean = {r[0] for r in brute.contamination(rows, items) if not r[5]}
    library = Encoder(str(public_tokenizers.path("byte_bpe_50k.json"))).library
    want = sorted((i, len(library.encode(t, add_special_tokens=False).ids), brute.sha(t)) for i, t in rows if i in clean)
    out = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in out.collect()) == want


def test_stages_keep_columns_and_bear_odd_rows(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain = plain.union(spark.createDataFrame([(None, "a b c", None, None, None), (None, None, None, None, None)], plain.schema))
    for turn, start in enumerate((plain, plain.where("doc_id < 0"))):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, now, "/root/testdata/sf0.001").write.parquet(f"file://{tmp_path}/{turn}-{name}")
            now = spark.read.parquet(f"file://{tmp_path}/{turn}-{name}")
            assert now.columns == plain.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, "/root/testdata/sf0.001").count() == now.count()


def test_rows_of_one_id_keep_their_own_texts(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage, "en", "s", 9), (2, f"head {passage} tail", "en", "s", 9), (2, "another text of the same id", "en", "s", 9), (None, passage, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.substring(spark, docs, "")
    assert sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in out.collect()) == [(0, passage, 9), (1, passage, 9), (2, "another text of the same id", 9), (2, "head tail", 9)]
