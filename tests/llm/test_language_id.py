"""Language identification against sums over all segmentations, and held-out accuracy."""

import math
import pickle

import numpy as np
import public_tokenizers
import regex
from pyspark import SparkContext
from pyspark.sql import functions as F

from marketops.llm import language_id
from marketops.llm.queries import QUERIES, read

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = [b" ", b"a", b"b", b" a", b"ab", b"ba", b" ab", b"aba"] + [bytes([c]) for c in (0xC3, 0xA9)]


def segmented(raw, p):
    """[(probability, pieces)] of all segmentations."""
    if not raw:
        return [(1.0, ())]
    return [(p[x] * q, (x, *rest)) for x in p if raw.startswith(x) for q, rest in segmented(raw[len(x):], p)]


def random_p(seed):
    p = np.random.default_rng(seed).random(len(PIECES))
    return p / p.sum()


def test_forward_sums_all_segmentations():
    p = np.stack([random_p(1), random_p(2)], 1)
    model = language_id.Model(["x", "y"], PIECES, p)
    units = ["abaab", "b", "a" * 20, "bababa", "é", "aéb", "ab"]
    found = model.scorer().logs(units)
    for k in range(2):
        of = dict(zip(model.pieces, model.p[:, k], strict=True))
        want = [math.log(sum(q for q, _ in segmented(b" " + u.encode(), of))) for u in units]
        assert np.allclose(found[:, k], want)


def test_expected_pieces_are_those_of_all_segmentations():
    p, units, weight = random_p(3), ["abaab", "b", "bababa", "aéb"], [3.0, 1.0, 2.0, 5.0]
    of, want = dict(zip(PIECES, p, strict=True)), np.zeros(len(PIECES))
    for u, w in zip(units, weight, strict=True):
        every = segmented(b" " + u.encode(), of)
        total = sum(q for q, _ in every)
        for q, parts in every:
            for x in parts:
                want[PIECES.index(x)] += w * q / total
    lattice = language_id.Lattice(language_id.automaton_of(PIECES), units)
    assert np.allclose(lattice.expected(language_id.scaled(PIECES, p[:, None])[:, 0], np.array(weight)), want)


def test_training_raises_the_likelihood():
    units, counts = ["abaab", "ab", "bababa", "aéb"], [9, 20, 2, 1]
    lattice = language_id.Lattice(language_id.automaton_of(PIECES), units)
    likelihood = [
        (np.log(lattice.forward(language_id.learn_pieces(PIECES, units, counts, n)[:, None])[lattice.tails, 0]) * counts).sum() for n in (1, 2, 4, 8)
    ]
    assert likelihood == sorted(likelihood)


def test_held_out_languages(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    rows = QUERIES["op11_language_id"](spark, folder).join(read(spark, folder, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) > 0
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_documents(spark, awkward, nothing):
    model = language_id.train(awkward, VOCABULARY)
    assert model.langs == ["de", "en", "fr"]
    clashing = awkward.withColumn("lang_pred", F.lit(3))
    rows = language_id.predict(clashing, model).collect()
    assert len(rows) == awkward.count()
    scorer = model.scorer()
    for r in rows:
        units = regex.findall(r"\p{L}[\p{L}\p{M}]{0,19}", (r.text or "").lower())
        if not units:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = sum(scorer.logs([u])[0] for u in units[:3000]) if len(units) <= 3000 else scorer.logs(units).sum(0)
        best = model.langs[int(np.argmax(logs))]
        assert r.lang_pred == best and abs(r.score - 1 / np.exp(logs - logs.max()).sum()) < 1e-6
    assert language_id.predict(nothing, model).collect() == []
    blank = language_id.train(nothing, VOCABULARY)
    assert {(r.lang_pred, r.score) for r in language_id.predict(awkward, blank).collect()} == {("und", 0.0)}


def test_long_texts_and_a_full_memory(monkeypatch):
    p = np.stack([random_p(1), random_p(2)], 1)
    model = language_id.Model(["x", "y"], PIECES, p)
    monkeypatch.setattr(language_id, "REMEMBERED", 60)
    texts = [" ".join(bin(i)[2:].replace("0", "a").replace("1", "b") for i in range(n, n + 50)) for n in (3, 60, 600)] + ["ab" * 70_000, None, "1 2", "ba " * 40_000]
    found = model.scorer().totals(texts)
    monkeypatch.setattr(language_id, "REMEMBERED", 100_000)
    scorer = model.scorer()
    for text, got in zip(texts, found, strict=True):
        units = language_id.UNIT.findall((text or "").lower())
        assert got is None if not units else np.allclose(got, scorer.total(units))


def test_a_memory_that_turns_within_a_long_text_keeps_its_units(monkeypatch):
    """A long text that holds remembered units and more new ones than there is room for."""
    p = np.stack([random_p(1), random_p(2)], 1)
    model = language_id.Model(["x", "y"], PIECES, p)
    words = [bin(i)[2:].replace("0", "a").replace("1", "b") for i in range(256, 456)]
    long = " ".join(words[70:120] * 300)
    assert len(long) >= 100_000
    want = model.scorer().total(language_id.UNIT.findall(long))
    monkeypatch.setattr(language_id, "REMEMBERED", 100)
    scorer = model.scorer()
    scorer.totals([" ".join(words[:90])])
    (got,) = scorer.totals([long])
    assert np.allclose(got, want) and len(scorer.row) <= 100


def test_broadcasts_need_no_package_on_the_executors(spark, monkeypatch):
    sent, plain = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(value) or plain(self, value))
    model = language_id.Model(["x", "y"], PIECES, np.stack([random_p(1), random_p(2)], 1))
    assert language_id.predict(spark.createDataFrame([("ab ba",)], "text string"), model).count() == 1
    assert sent and not any(b"marketops" in pickle.dumps(value) for value in sent)


def test_too_many_labels_are_an_error(spark):
    rows = spark.createDataFrame([(f"l{i}", "abc") for i in range(5)], "lang string, text string")
    try:
        language_id.train(rows, VOCABULARY, most_languages=4)
    except ValueError as error:
        assert "labels" in str(error)
    else:
        raise AssertionError
