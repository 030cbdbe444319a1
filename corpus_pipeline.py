"""The preparation of the documents as stages, each of which works on all that its predecessor kept.

Every stage but the last returns the columns of its input. The near-duplicate stage takes every row as a document of its own, also
those that share a doc_id or have none. A document whose text is all repeats stays with an empty text. Stages have no SQL; tests compare them
with brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketops.llm import byte_bpe, mixing, ngram_join, suffix_dedup, toxicity
from marketops.llm.common import Scratch, parallelism
from marketops.llm.queries import held_out, read

SCORE = "__toxicity"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled ones outside the held-out fold."""
    machine = toxicity.fit(toxicity.labelled_sentences(docs, read(spark, sf_dir, "labels").where(~held_out())))
    return toxicity.score(docs, machine, to=SCORE).where(F.col(SCORE) < 0.5).drop(SCORE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the first by doc_id, NULL before all others, then by a hash of the text."""
    scratch = Scratch(spark)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    # Row keys in that order, frozen by the written table.
    ranged = docs.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    keyed = scratch.store(ranged.withColumn("__row", F.monotonically_increasing_id()))
    groups = ngram_join.link_documents(keyed.select(F.col("__row").alias("doc_id"), "text"), words=5, percent=80)
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__row"))
    return keyed.join(kept, "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur before; ``n_chars`` follows the text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = suffix_dedup.remove_repeats(docs, carry=rest, characters=True)
    text = F.col("kept").cast("string")
    new = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("bigint")}
    return found.select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mix(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "doc_id", "source", "text"))
    return mixing.emit(taken).select(*[F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids)"""
    coded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
