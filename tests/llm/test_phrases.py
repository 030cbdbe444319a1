"""Phrase mining against plain counting."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from marketops.llm import phrases
from marketops.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mined(rows, longest=3, threshold=10, most=2000, covered=50):
    grams, words = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                grams.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    kept = {}
    for (lang, w), a in grams.items():
        if len(w) > 1 and a >= threshold:
            cuts = [(1_000_000 * a * a // (grams[lang, w[:k]] * grams[lang, w[k:]]), k, grams[lang, w[:k]], grams[lang, w[k:]]) for k in range(1, len(w))]
            kept[lang, w] = (a, *min(cuts))
    covering = {}
    for (lang, w), (a, *_) in kept.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                covering[lang, w[i : i + size]] = max(a, covering.get((lang, w[i : i + size]), 0))
    out = []
    for lang in words:
        ranked = sorted((-v[1], -v[0], " ".join(w).encode(), v) for (x, w), v in kept.items() if x == lang and not 100 * covering.get((x, w), -1) >= covered * v[0])
        out += [(lang, i + 1, phrase.decode(), v[0], v[3], v[4], words[lang], v[1]) for i, (_, _, phrase, v) in enumerate(ranked[:most])]
    return sorted(out)


def found(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def awkward_rows():
    rng = np.random.default_rng(3)
    vocabulary = ["a", "B", "the", "Éa", "x-y", "漢字", "\x85", "q" * 300, "b", "z"]
    rows = [(["en", None, "und", "fr", ""][int(rng.integers(5))], "".join(vocabulary[int(i)] + [" ", "  ", "\t", ". ", "\n", ",", " "][int(j)] for i, j in zip(rng.integers(0, 10, 60), rng.integers(0, 7, 60), strict=True))) for _ in range(60)]
    return [*rows, *rows[:20], ("en", None), ("en", ""), (None, None), ("de", " . "), ("fr", "a b a b a b " * 9000), ("fr", "ab" * 50_000)]


def test_awkward_texts(spark):
    rows = awkward_rows()
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "lang string, text string, n int, rank int, phrase int")
    assert found(phrases.collocations(docs)) == mined(rows)
    assert found(phrases.collocations(docs, longest=4, threshold=3, most=7, covered=80)) == mined(rows, 4, 3, 7, 80)
    assert phrases.collocations(docs.limit(0)).collect() == []


def test_a_full_bitmap_changes_nothing(spark):
    rows = awkward_rows()[:40]
    docs = spark.createDataFrame(rows, "lang string, text string").fillna({"lang": "und"})
    few, many = ({(r.lang, r.words, r.phrase): r.n for r in phrases.count_grams(docs, 3, 5, bits).collect()} for bits in (64, 1 << 20))
    assert few == many


def test_steps_and_slices_do_not_matter(monkeypatch):
    rows = [(x or "und", y or "") for x, y in awkward_rows()]
    batch = pa.RecordBatch.from_pydict({"lang": [x for x, _ in rows], "text": [y for _, y in rows]})

    def counted():
        total, words = Counter(), Counter()
        for step in phrases._steps(iter([batch, batch.slice(3, 20)]), 3):
            text = [t.decode() for t in step["texts"].to_pylist()]
            words.update(dict(zip(step["names"], step["total"].tolist(), strict=True)))
            for members, counts, prints in step["grams"].values():
                assert len(set(prints.tolist())) == len(prints)
                for m, n in zip(members.tolist(), counts.tolist(), strict=True):
                    total[step["names"][step["lang"][m[0]]], tuple(text[step["word"][i]] for i in m)] += n
        return +total, +words

    whole = counted()
    for words, size in ((100, 50), (1, 7), (3000, 64_000)):
        monkeypatch.setattr(phrases, "STEP_WORDS", words)
        monkeypatch.setattr(phrases, "SLICE_BYTES", size)
        assert counted() == whole


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(1)
    for threshold in (3, 10, 50):
        keys = np.r_[(rng.zipf(1.3, 200_000) % 60_000), np.arange(100_000, 260_000)].astype(np.uint32)
        rng.shuffle(keys)
        truth = Counter(keys.tolist())
        summary = phrases.Summary(len(keys) // threshold + 1)
        for part in np.array_split(keys, 37):
            distinct, n = np.unique(part, return_counts=True)
            summary.add(distinct, n)
            summary.merge()
            assert len(summary.keys) <= summary.capacity
        kept = set(summary.survivors(threshold).tolist())
        assert {k for k, n in truth.items() if n >= threshold} <= kept
        assert summary.lost < threshold


def test_query_reads_whole_tables(spark, sf):
    from marketops.llm.queries import read

    rows = [(r.lang, r.text) for r in read(spark, sf, "documents").select("lang", "text").collect()]
    assert found(QUERIES["op12_phrases"](spark, sf)) == mined(rows)
