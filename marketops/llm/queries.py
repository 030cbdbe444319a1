"""Registered queries of the operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketops.llm import byte_bpe, flac, hilbert_search, language_id, licenses, mixing, ngram_join, phrases, suffix_dedup, token_files, toxicity, turn_repair, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(plan):
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@register("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    found = token_files.read_tokens(spark, manifest)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@register("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    found = byte_bpe.decode(coded, ranks)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Fixed rules of the query.
URL_RULES = (
    url_filter.Rule("net/", "block"),
    url_filter.Rule("example.net/en/", "allow"),
    url_filter.Rule("example.com/de/", "block"),
    url_filter.Rule("org/fr/", "allow"),
)


@register("op1_url_filter")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(url_filter.labelled_by_rules(pages, URL_RULES))
    return url_filter.judge(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


@register("op5_mixing", mixing.MIX_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


@register("op7_flac")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    length = F.octet_length("text")
    padding = F.greatest(F.ceil(length / 64), F.lit(1)) * 64 - length
    padded = docs.select("doc_id", length.cast("bigint").alias("n_bytes"), F.concat("text", F.unhex(F.repeat(F.lit("00"), padding.cast("int")))).alias("payload"))
    found = flac.decode_column(flac.encode_column(padded, "payload"))
    return found.select(
        "doc_id", "n_bytes", F.octet_length("pcm").cast("bigint").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"), F.crc32(F.substring("pcm", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


@register("op2_licenses")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def held_out():
    """The fold that learning never sees."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


@register("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(toxicity.labelled_sentences(docs, read(spark, sf_dir, "labels").where(~held_out())))
    found = toxicity.score(docs, machine)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op8_ngram_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(read(spark, sf_dir, "documents"), words=3, percent=90)


@register("op6_hilbert_search")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search.search(read(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


@register("op12_phrases", phrases.PHRASE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, fixed by each row's key."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.pmod(F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))), F.lit(20))
    text = F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    role = F.when(hit == 4, F.lit("user")).otherwise(word("role"))
    return rows.where(hit != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(hit == 3, 2).otherwise(1).alias("copies"))


@register("op13_turn_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    every = rows.select("conv_id", turn_repair.conversation_key().alias("conv")).distinct()
    bad = damaged(rows)
    found = turn_repair.counts(bad).join(turn_repair.digests(turn_repair.repair(bad)), "conv")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, "conv", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def language_fold():
    """The fold whose languages are never learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


@register("op11_language_id")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_fold()), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(language_fold(), F.lit(False)).alias("held_out"), "lang_pred", "score")
