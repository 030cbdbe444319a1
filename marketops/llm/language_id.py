"""Language identification by unigram piece models summed over all segmentations.

A text's units are its runs of up to 20 letters and marks, lower-cased, each with a space before it; a longer run is several units. The pieces are
those byte strings of a public byte-level vocabulary that can lie in a unit, and all single bytes, so every unit can be segmented. Each
language has a probability per piece; the probability of a unit is the sum over all its segmentations, which the forward algorithm gives. A text's
score is the product over its units, and the prediction is the language with the largest.

Training is expectation maximisation, language by language in its own task, on the most frequent units of a bounded sample of labelled texts.
Scoring is linear in the text; workers remember the units they met, in a memory of fixed size.

A text that is NULL or has no letter is ``und`` with score 0, as is every text if nothing was learned. Repeated texts count once in the sample. Of equal
languages the first by code point is taken. Texts of any length are read in batches of units. An input column named as a new one is replaced; all
others are kept; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketops.llm.common import bounded_batches, steps, utf8
from marketops.llm.pieces import worker_memory

UNIT_CHARS = 20
UNIT = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{UNIT_CHARS - 1}}}")
#: Probabilities are multiplied by this per byte, so that products over a unit neither vanish nor overflow.
BYTE_SCALE = 1000.0
#: Least probability of a single byte.
FLOOR = 1e-6
REMEMBERED = 200_000
UNDECIDED = "und"


def load_vocabulary(path: str) -> list[bytes]:
    """The byte strings of a rank file that can lie in a unit, and all single bytes."""
    letters = {*range(0x61, 0x7B), *range(0x80, 0x100)}
    with open(path, "rb") as lines:
        tokens = {base64.b64decode(line.split()[0]) for line in lines}
    fits = {t for t in tokens if letters.issuperset(t[1:]) and (t[:1] == b" " or t[0] in letters)}
    return sorted(fits | {bytes([b]) for b in range(256)})


def unit_batches(text: str, most: int = 200_000) -> Iterator[list[str]]:
    lower = text.lower()
    if len(lower) <= 8 * most:
        yield UNIT.findall(lower)
        return
    found = UNIT.finditer(lower)
    while some := [m[0] for m in islice(found, most)]:
        yield some


class Lattice:
    """All pieces that lie in some units, ordered so that each step of the forward algorithm is one sum over sorted rows."""

    def __init__(self, automaton: ahocorasick.Automaton, units: list[str]):
        raw = [b" " + u.encode() for u in units]
        size = np.array([len(r) for r in raw], np.int64)
        found = automaton.iter(b"".join(raw).decode("latin-1"))
        flat = np.fromiter(chain.from_iterable((end, *piece) for end, piece in found), np.int64).reshape(-1, 3)
        end, self.piece, length = flat.T
        unit = np.repeat(np.arange(len(raw)), size)[end]
        start = np.cumsum(size) - size
        depth = end - start[unit]
        order = np.argsort(depth, kind="stable")
        self.piece, unit, length, depth = self.piece[order], unit[order], length[order], depth[order]
        # One state before each byte of a unit and one at its end.
        first = start + np.arange(len(raw))
        self.states, self.heads, self.tails, self.size = int(size.sum()) + len(raw), first, first + size, size
        self.to = first[unit] + depth + 1
        self.source = self.to - length
        self.steps = np.searchsorted(depth, np.arange(int(size.max(initial=0)) + 1))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """By state and language the summed probability of what lies before; ``p`` is by piece and language."""
        alpha = np.zeros((self.states, p.shape[1]))
        alpha[self.heads] = 1.0
        for a, b in zip(self.steps[:-1], self.steps[1:], strict=True):
            to = self.to[a:b]
            edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            alpha[to[edge]] = np.add.reduceat(alpha[self.source[a:b]] * p[self.piece[a:b]], edge)
        return alpha

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each piece is expected, for one language, with units weighted."""
        alpha = self.forward(p[:, None])[:, 0]
        beta = np.zeros(self.states)
        beta[self.tails] = weight / np.maximum(alpha[self.tails], 1e-300)
        for a, b in zip(self.steps[-2::-1], self.steps[:0:-1], strict=True):
            np.add.at(beta, self.source[a:b], beta[self.to[a:b]] * p[self.piece[a:b]])
        return np.bincount(self.piece, alpha[self.source] * p[self.piece] * beta[self.to], minlength=len(p))


def automaton_of(pieces: list[bytes]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, piece in enumerate(pieces):
        out.add_word(piece.decode("latin-1"), (i, len(piece)))
    out.make_automaton()
    return out


def scaled(pieces: list[bytes], p: np.ndarray) -> np.ndarray:
    return p * BYTE_SCALE ** np.array([len(x) for x in pieces], np.float64)[:, None]


def learn_pieces(pieces: list[bytes], units: list[str], counts: list[int], rounds: int = 6) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation, from the same probability for all pieces."""
    weight = np.array(counts, np.float64)
    lattice = Lattice(automaton_of(pieces), units)
    p = np.full(len(pieces), 1.0 / len(pieces))
    for _ in range(rounds):
        found = lattice.expected(scaled(pieces, p[:, None])[:, 0], weight)
        p = found / found.sum() + 1e-9
    return p / p.sum()


class Model:
    """Languages, pieces and each language's probabilities: its own, mixed with a little of all languages' mean and a floor for bytes."""

    def __init__(self, langs: list[str], pieces: list[bytes], p: np.ndarray, share: float = 0.02):
        self.key = uuid.uuid4().hex
        used = (p > 1e-7).any(1) | (np.array([len(x) for x in pieces]) == 1) if langs else np.zeros(len(pieces), bool)
        self.langs, self.pieces = langs, [x for x, u in zip(pieces, used, strict=True) if u]
        p = p[used]
        mixed = (1 - share) * p + share * p.mean(1, keepdims=True) if langs else p
        single = np.array([len(x) == 1 for x in self.pieces], bool)
        self.p = np.where(single[:, None], np.maximum(mixed, FLOOR), mixed)

    def scorer(self) -> Scorer:
        return Scorer(self.langs, self.pieces, self.p)


class Scorer:
    """Log probabilities of units by language, remembered."""

    def __init__(self, langs: list[str], pieces: list[bytes], p: np.ndarray):
        self.automaton = automaton_of(pieces)
        self.p = scaled(pieces, p)
        self.row: dict[str, int] = {}
        self.table = np.zeros((REMEMBERED, len(langs)))

    def logs(self, units: list[str]) -> np.ndarray:
        lattice = Lattice(self.automaton, units)
        alpha = lattice.forward(self.p)[lattice.tails]
        return np.log(alpha) - np.log(BYTE_SCALE) * lattice.size[:, None]

    def add(self, units: set[str]) -> None:
        """All these units, at most ``REMEMBERED``, are in the memory afterwards."""
        new = units - self.row.keys()
        if len(self.row) + len(new) > REMEMBERED:
            self.row.clear()
            new = units
        todo = sorted(new)
        for i in range(0, len(todo), 20_000):
            some = todo[i : i + 20_000]
            at = len(self.row)
            self.table[at : at + len(some)] = self.logs(some)
            self.row.update(zip(some, range(at, at + len(some)), strict=True))

    def total(self, units: list[str]) -> np.ndarray:
        """Of one long list, in shares that fit the memory."""
        out = np.zeros(self.table.shape[1])
        for i in range(0, len(units), REMEMBERED // 2):
            some = units[i : i + REMEMBERED // 2]
            self.add(set(some))
            out += self.table[list(map(self.row.__getitem__, some))].sum(0)
        return out

    def totals(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """By text the log probabilities of all its units, None without letters."""
        found = [None if not t else list(unit_batches(t)) if len(t) < 100_000 else None for t in texts]
        lists = [f[0] if f else [] for f in found]
        units = set().union(*lists)
        out: list[np.ndarray | None] = [None] * len(texts)
        if len(units) <= REMEMBERED:
            self.add(units)
            index = np.fromiter(map(self.row.__getitem__, chain.from_iterable(lists)), np.int64)
            edge = np.cumsum([0, *map(len, lists)])
            some = [i for i, x in enumerate(lists) if x]
            if some:
                for i, v in zip(some, np.add.reduceat(self.table[index], edge[some]), strict=True):
                    out[i] = v
        else:
            for i, x in enumerate(lists):
                out[i] = self.total(x) if x else None
        for i, t in enumerate(texts):
            if t and len(t) >= 100_000:
                parts = [self.total(u) for u in unit_batches(t) if u]
                out[i] = sum(parts) if parts else None
        return out


def sample(labelled: DataFrame, texts: int = 800) -> DataFrame:
    """(lang, text): at most so many different texts of each language, those with the smallest hashes; rows without label or text do not count."""
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    keyed = rows.withColumn("__hash", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("__hash")
    chosen = keyed.select("lang", "__hash").distinct().withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= texts).drop("__at")
    return keyed.join(chosen, ["lang", "__hash"], "left_semi").dropDuplicates(["lang", "__hash"]).select("lang", "text")


def train(labelled: DataFrame, vocabulary: str, texts: int = 800, units: int = 20_000, most_languages: int = 1000) -> Model:
    """A model from at most ``texts`` texts of each language in ``lang`` and the ``units`` most frequent units in them.

    More than ``most_languages`` labels are an error.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    pieces = load_vocabulary(vocabulary)

    def unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for some in unit_batches(text):
                    seen = Counter(some)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(seen), pa.string()), "unit": pa.array(seen, pa.string()), "n": pa.array(seen.values(), pa.int64())})

    def learn(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("unit").to_pylist(), table.column("n").to_pylist(), strict=True))
        p = learn_pieces(pieces, [u for u, _ in rows], [n for _, n in rows])
        return pa.table({"lang": table.column("lang")[:1], "p": pa.array([p.tolist()], pa.list_(pa.float64()))})

    counted = sample(labelled, texts).mapInArrow(unit_counts, "lang string, unit string, n bigint").groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "unit")
    top = counted.withColumn("__at", F.row_number().over(most)).where(F.col("__at") <= units).drop("__at")
    found = sorted(top.groupBy("lang").applyInArrow(learn, "lang string, p array<double>").limit(most_languages + 1).collect(), key=lambda r: r.lang)
    if len(found) > most_languages:
        raise ValueError(f"more than {most_languages} labels in lang")
    return Model([r.lang for r in found], pieces, np.array([r.p for r in found]).T if found else np.zeros((len(pieces), 0)))


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the language and how probable it is against the others (0 to 1), all languages being as likely before the text is read."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = [f for f in docs.schema.fields if f.name.lower() not in (lang.lower(), score.lower())]
    # At most pieces x most_languages numbers. Broadcasts are pickled by reference: a Model could only be read where the package is installed.
    key, shared = model.key, spark.sparkContext.broadcast((model.langs, model.pieces, model.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, pieces, p = shared.value
        memory = worker_memory("language id", dict)
        if langs and key not in memory:
            memory.clear()
            memory[key] = Scorer(langs, pieces, p)
        for batch in batches:
            _, offsets = utf8(batch.column(text))
            for i, j in steps(offsets, 1_000_000):
                part = batch.slice(i, j - i)
                names, scores = [], []
                totals = memory[key].totals(part.column(text).to_pylist()) if langs else [None] * part.num_rows
                for logs in totals:
                    if logs is None:
                        names.append(UNDECIDED)
                        scores.append(0.0)
                        continue
                    best = int(np.argmax(logs))
                    names.append(langs[best])
                    scores.append(float(1.0 / np.exp(logs - logs[best]).sum()))
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*[f.name for f in kept], lang, score])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))
