import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from marketops.llm import suffix_dedup
from marketops.llm.queries import QUERIES
from marketops.llm.suffix_dedup import remove_repeats
from marketops.llm.suffix_sort import suffix_array


def brute(docs, length=100):
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode())):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            window = raw[s : s + length]
            if window in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df, **more):
    return [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in remove_repeats(df, **more).collect()]


def ordered(rows):
    return sorted(rows, key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffixes_are_sorted(symbols):
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def near_copies():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd efgh") for _ in range(400)) for _ in range(3)]
    docs = []
    for i in range(200):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            b[rng.randrange(len(b))] = rng.choice("abc x")
        a = rng.randrange(150)
        docs.append((i, "".join(b)[a : a + rng.randint(50, 400)]))
    return [*docs, (300, "a" * 500), (301, "ab" * 300), (302, "a" * 99), (303, ""), (304, "x" + "a" * 250), (305, ("abc" * 40 + "d") * 6)]


def test_repeats_equal_brute_force_also_with_hot_anchors(spark):
    docs = near_copies()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = ordered(brute(docs))
    assert ordered(found(df)) == want
    assert ordered(found(df, hot=3)) == want
    assert ordered(found(df, length=64)) == ordered(brute(docs, 64))


def test_awkward_rows(awkward, nothing):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert ordered(found(awkward)) == ordered(brute(docs))
    assert found(nothing) == []


def test_query_on_given_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert ordered(map(tuple, QUERIES["op3_suffix_dedup"](spark, sf).collect())) == ordered(brute(docs))


def test_a_batch_sends_no_more_rows_than_there_are_partitions(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, "".join(rng.choice("abcdefgh ") for _ in range(3000))) for i in range(120)]
    sent, plain = spark.sparkContext.accumulator(0), suffix_dedup.find_anchors

    def counting(*given):
        run = plain(*given)

        def counted(batches):
            for batch in run(batches):
                sent.add(batch.num_rows)
                yield batch

        return counted

    monkeypatch.setattr(suffix_dedup, "find_anchors", counting)
    df = spark.createDataFrame([*docs, *[(500 + i, t) for i, t in docs[:20]]], "doc_id bigint, text string")
    assert ordered(found(df)) == ordered(brute([*docs, *[(500 + i, t) for i, t in docs[:20]]]))
    # 8 tasks and 8 partitions; removed ranges come with at most a row per document
    assert sent.value <= 8 * 8 + 140
