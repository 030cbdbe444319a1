
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from marketops.llm import byte_bpe, mixing

from .test_ngram_join import brute as components
from .test_suffix_dedup import brute as repeats


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "ngram_join", "suffix_dedup", "mixing", "byte_bpe"]

    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = stages["ngram_join"](spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in components(rows, 5, 80)})

    cut = stages["suffix_dedup"](spark, docs, sf)
    assert cut.columns == docs.columns
    sizes = {d: n - gone for d, n, gone, _, _ in repeats(rows)}
    for r in cut.collect():
        assert r.n_chars == len(r.text) and sizes[r.doc_id] - 6 * 50 <= len(r.text.encode()) <= sizes[r.doc_id]

    mixed = stages["mixing"](spark, docs, sf)
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert mixed.columns == docs.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {d: c for d, c in copies.items() if c}

    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = dict(rows)
    assert all(r["ids"] == known.encode_ordinary(texts[r.doc_id] or "") for r in stages["byte_bpe"](spark, docs, sf).collect())


def test_awkward_rows_pass_all_stages(spark, sf, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf)
            out.collect()
            if name != "byte_bpe":
                assert out.columns == docs.columns


def test_run(spark, sf):
    out = pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and out.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_one_row_of_each_group_whatever_its_doc_id(spark, sf):
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    rows = [(4, a), (4, a), (None, b), (None, b), (None, f"{b} more"), (4, f"{a} more"), (9, a), (2, "other words of a text of its own"), (9, "two of the same id that are alike in nothing")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = dict(pipeline.STAGES)["ngram_join"](spark, docs, sf).collect()
    assert len(got) == 4 and {(r.doc_id, r.text.split()[0]) for r in got} == {(4, "a0"), (None, "b0"), (2, "other"), (9, "two")}
