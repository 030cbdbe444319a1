import collections
import random
import re

import pytest

from marketops.llm import ngram_join
from marketops.llm.ngram_join import link_documents
from marketops.llm.queries import QUERIES


def brute(docs, words, percent):
    """Components by all pairs that share a run."""
    sets = []
    for _, text in docs:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [tuple(found[i : i + words]) for i in range(len(found) - words + 1)]
        sets.append(set(runs) if runs else {tuple(found)} if found else set())
    lead, where = list(range(len(docs))), collections.defaultdict(list)

    def top(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i, own in enumerate(sets):
        shared = collections.Counter(j for run in own for j in where[run])
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                lead[top(i)] = top(j)
        for run in own:
            where[run].append(i)
    rank = lambda d: -(2**63) if d is None else d
    least = {}
    for i, (d, _) in enumerate(docs):
        least[top(i)] = min(least.get(top(i), 2**63), rank(d))
    return sorted(((d, len(sets[i]), None if least[top(i)] == -(2**63) else least[top(i)]) for i, (d, _) in enumerate(docs)), key=str)


def edited(rng, count, edits):
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(30, 120))] for _ in range(4)]
    docs = []
    for i in range(count):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, edits)):
            b[rng.randrange(len(b))] = rng.choice(words)
        docs.append((i, " ".join(b).title() if i % 7 == 0 else "  ".join(b)))
    return docs


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, words, percent):
    docs = edited(random.Random(2), 300, 8) + [(400, ""), (401, "a b"), (402, "A  b"), (403, None), (404, " \t"), (405, "a\x0bb")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(map(tuple, link_documents(df, words, percent).collect()), key=str) == brute(docs, words, percent)


def test_awkward_rows(awkward, nothing):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted(map(tuple, link_documents(awkward, 3, 90).collect()), key=str) == brute(docs, 3, 90)
    assert link_documents(nothing).collect() == []


def test_query_on_given_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op8_ngram_join"](spark, sf).collect()), key=str) == brute(docs, 3, 90)


def test_long_words_with_equal_polynomials_stay_apart(spark):
    swap = str.maketrans("ab", "ba")
    a = "a"
    for _ in range(12):  # the Thue-Morse word and its complement
        a += a.translate(swap)
    docs = spark.createDataFrame([(1, a), (2, a.translate(swap)), (3, a)], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in link_documents(docs, words=3, percent=90).collect()} == {1: 1, 2: 2, 3: 1}


def test_near_copies_of_one_text_do_not_meet_in_pairs(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    docs = []
    for i in range(800):  # leaders are far from the text, so that all their groups lack and have the same runs
        own = list(base)
        for _ in range(rng.randint(14, 18) if i < 60 else rng.randint(1, 12)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(100_000)}"
        docs.append((i, " ".join(own)))
    compared, plain = spark.sparkContext.accumulator(0), ngram_join.compare

    def counting(percent):
        run = plain(percent)

        def counted(batches):
            for batch in batches:
                compared.add(batch.num_rows)
                yield from run(iter([batch]))

        return counted

    monkeypatch.setattr(ngram_join, "compare", counting)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert sorted(map(tuple, link_documents(df, 3, 90).collect()), key=str) == brute(docs, 3, 90)
    assert compared.value < 20 * len(docs)


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_matrix_of_near_copies_holds_their_own_edits_only(spark, monkeypatch, words, percent):
    rng = random.Random(11)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    docs = []
    for i in range(400):  # the first, which lead the groups, are far from the text; some of the others link without any edit in common
        own = list(base)
        for _ in range(rng.randint(14, 18) if i < 60 else rng.choice((1, 2, 3, 9, 12, 15))):
            own[rng.randrange(len(own))] = f"v{rng.randrange(100_000)}"
        docs.append((i, " ".join(own)))
    cells, plain = spark.sparkContext.accumulator(0), ngram_join.differences

    def counted(batches):
        for batch in plain(batches):
            cells.add(len(batch.column("differences").flatten()))
            yield batch

    monkeypatch.setattr(ngram_join, "differences", counted)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert sorted(map(tuple, link_documents(df, words, percent).collect()), key=str) == brute(docs, words, percent)
    assert cells.value < 250 * len(docs)
