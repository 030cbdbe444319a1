import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from marketops.llm import byte_bpe, pieces, token_files

RANKS, FILE, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.load_ranks(RANKS), PATTERN)


@pytest.fixture(scope="module")
def known(encoder):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


ODD = [None, "", " ", "  a  b ", "a\n b\n\nc ", "x <|endoftext|> y", "é  b", "a\x1c b", "a \x85b", "\n", "tab\t tab", " lead", "trail ", "don't  's 'S", "a" * 3000, "= " * 500, "　漢 字 "]


def test_words_equal_the_merges(encoder, known):
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("abcdeaaatheingionst ABC  \n\n\t.,!?'s 0123éèñ漢字🙂 \x1c\x85-_====") for _ in range(rng.randint(1, 50)))
        assert list(memoryview(encoder.encode(text)).cast("i")) == known.encode_ordinary(text)


def test_compatibility_is_what_the_merges_say(encoder):
    rng, tokens = random.Random(1), sorted(encoder.bytes_of)
    for _ in range(3000):
        a, b = rng.choice(tokens[:4000]), rng.choice(tokens)
        assert encoder.compatible(a, b) == (encoder.merged(encoder.bytes_of[a] + encoder.bytes_of[b]) == [encoder.bytes_of[a], encoder.bytes_of[b]])


def test_round_trip(spark, awkward, nothing, known, sf):
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string")
    for df in (odd, awkward, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = byte_bpe.decode(byte_bpe.encode(df, RANKS, PATTERN), RANKS).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert r["ids"] == known.encode_ordinary(r.text or "")
            assert r.decoded == (r.text or "").encode()
    assert byte_bpe.decode(byte_bpe.encode(nothing, RANKS, PATTERN), RANKS).collect() == []


@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize("table", ["odd", "awkward", "given"])
def test_files_hold_all_documents_in_order(spark, awkward, sf, table, as_text):
    df = {"odd": spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string"), "awkward": awkward, "given": spark.read.parquet(f"{sf}/documents.parquet")}[table]
    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.encode_special_tokens = as_text
    rows = sorted((r.start, r.doc_id, bytes(r.ids)) for r in token_files.read_tokens(spark, token_files.write_tokens(df, FILE, added_as_text=as_text)).collect())
    want = sorted(((r.doc_id is not None, r.doc_id or 0, (r.text or "").encode(), r.text or "") for r in df.collect()))
    start = 0
    for (at, doc_id, ids), (known, number, _, text) in zip(rows, want, strict=True):
        own = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert (at, doc_id, ids) == (start, number if known else None, own)
        start += len(own) // 4


def test_added_tokens_follow_the_plain_call(spark):
    docs = spark.createDataFrame([(1, "x <|endoftext|> y"), (2, "<|endoftext|><|endoftext|>"), (3, "<|endoftext| >")], "doc_id bigint, text string")
    rows = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_tokens(spark, token_files.write_tokens(docs, FILE)).collect()}
    assert rows[1] == [87, 220, 50256, 331, 0] and rows[2] == [50256, 50256, 0] and 50256 not in rows[3]


def test_pieces_are_the_borders_of_the_text():
    for text in ["a b", " a b", "a b ", "a  b", "a \n b", "a\nb c", "", " ", "\u2003a b", "a\u2003 b", "a b\x85", "a b.\nC d"]:
        assert pieces.split(text) == pieces.BORDER.split(text)


def test_no_documents_no_files(spark, nothing):
    assert token_files.read_tokens(spark, token_files.write_tokens(nothing, FILE)).collect() == []
