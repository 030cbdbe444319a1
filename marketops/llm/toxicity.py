"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel of two words counts their common subsequences of four characters; each gap costs a factor, so
``i-d-i-o-t`` and inflected forms stay close to ``idiot``. A text's unit is a word; runs of single characters are
joined to a word too. A sentence, and a text, is as toxic as its most toxic unit.

Training, on labelled sentences of a bounded sample of labelled documents: landmarks are chosen one after another, each the
string that sets most of the toxic sentences not yet covered apart from clean ones. A word's kernel values with the
landmarks, times the inverse square root of the landmarks' own kernel matrix, are its features. Positive examples are the
words that carry a landmark in sentences of toxic documents, and copies of them with inserted characters; negative ones are
the words of clean sentences that come nearest to any landmark. The machine is fitted by subgradient steps.

Scoring is one pass without a shuffle: each worker remembers the decision on words it has met. NULL and empty texts, and
all texts if there are no toxic or no clean labels, get the score of a text without any near word. Labels, language, source and
doc_id are not inputs of a score.
"""

from __future__ import annotations

import math
import sys
import types
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketops.llm.common import bounded_batches, steps, utf8

ORDER, DECAY = 4, np.float32(0.7)
LONGEST = 24
#: Words a worker remembers the decision on.
REMEMBERED = 200_000
START = "^"
EDGE = ".,;:!?\"'()[]{}<>«»„“”…"


def codes(words: list[str], width: int, pad: int) -> np.ndarray:
    """Characters as numbers, one row a word."""
    out = np.full((len(words), width), pad, np.int32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    size = np.array([len(w) for w in words])
    out[np.arange(width) < size[:, None]] = flat
    return out


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The subsequence kernel of pairs of rows; all pairs advance together."""
    n, a, b = len(s), s.shape[1], t.shape[1]
    square = DECAY * DECAY
    equal = [[(s[:, i] == t[:, j]) for j in range(b)] for i in range(a)]
    before = [[np.float32(1)] * (b + 1) for _ in range(a + 1)]
    zero = np.zeros(n, np.float32)
    for _ in range(ORDER - 1):
        now = [[zero] * (b + 1) for _ in range(a + 1)]
        for i in range(1, a + 1):
            along = zero
            for j in range(1, b + 1):
                along = DECAY * along + square * (equal[i - 1][j - 1] * before[i - 1][j - 1])
                now[i][j] = DECAY * now[i - 1][j] + along
        before = now
    total = np.zeros(n, np.float64)
    for i in range(1, a + 1):
        for j in range(1, b + 1):
            total += square * (equal[i - 1][j - 1] * before[i - 1][j - 1])
    return total


def letters(words: list[str]) -> np.ndarray:
    """A bit per character (modulo 64)."""
    return np.array([_bits(w) for w in words], np.uint64)


def _bits(word: str) -> int:
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


@dataclass
class Machine:
    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -1.0
    slope: float = 3.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def similarities(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, landmark, kernel over the landmark's own) of the pairs that may have common subsequences."""
        if not words or not self.landmarks:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        marks = letters(self.landmarks)
        need = np.array([max(3, len(set(z)) - 1) for z in self.landmarks])
        own = kernel(codes(self.landmarks, LONGEST, -1), codes(self.landmarks, LONGEST, -2))
        have = letters(words)
        rows, cols, values = [], [], []
        sizes = np.array([len(w) for w in words])
        for z, (mark, least) in enumerate(zip(marks, need, strict=True)):
            near = np.flatnonzero((np.bitwise_count(have & mark) >= least) & (sizes >= ORDER))
            near = near[np.argsort(sizes[near], kind="stable")]
            for i in range(0, len(near), 4000):
                some = near[i : i + 4000]
                pair = codes([words[x] for x in some], int(sizes[some[-1]]), -1)
                k = kernel(pair, np.broadcast_to(codes([self.landmarks[z]], len(self.landmarks[z]), -2), (len(some), len(self.landmarks[z])))) / own[z]
                hit = k > 0
                rows.append(some[hit])
                cols.append(np.full(int(hit.sum()), z))
                values.append(k[hit])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)

    def decide(self, words: list[str]) -> np.ndarray:
        """The decision on each unit; long ones by overlapping parts."""
        parts, owner = [], []
        for i, w in enumerate(words):
            for piece in cut(w):
                parts.append(piece)
                owner.append(i)
        out = np.full(len(words), self.bias)
        if parts:
            row, col, value = self.similarities(parts)
            sums = self.bias + np.bincount(row, value * self.weights[col], len(parts)) if len(row) else np.full(len(parts), self.bias)
            np.maximum.at(out, np.array(owner), sums)
        return out

    def score(self, decision: float) -> float:
        return 1.0 / (1.0 + math.exp(-self.slope * decision))


def cut(word: str) -> list[str]:
    """A word behind a mark of its start, in overlapping parts if it is long."""
    word = word.strip(EDGE)
    if len(word) < ORDER:
        return []
    word = START + word
    if len(word) <= LONGEST:
        return [word]
    step = LONGEST // 2
    return [word[i : i + LONGEST] for i in range(0, len(word) - step, step)]


def units(text: str) -> list[str]:
    """Words in lower case, and each run of four or more single characters as one more word."""
    words = text.lower().split()
    if sum(len(w) == 1 for w in words) >= ORDER:
        run: list[str] = []
        joined = []
        for w in [*words, "  "]:
            if len(w) == 1:
                run.append(w)
            else:
                if len(run) >= ORDER:
                    joined.append("".join(run))
                run = []
        words += joined
    return words


def choose_landmarks(toxic: list[set[str]], clean: list[set[str]], most: int) -> list[str]:
    """Strings of 5 to 11 characters (with the mark of a word's start) that set toxic sentences apart, by sequential covering."""

    def strings(sentence: set[str]) -> set[str]:
        found = set()
        for word in sentence:
            word = START + word.strip(EDGE)
            if ORDER < len(word) <= 11:
                found.add(word)
            for n in (5, 6, 7):
                found.update(word[i : i + n] for i in range(len(word) - n + 1))
        return found

    # Counted first, so that only strings with enough support are kept.
    support: Counter[str] = Counter()
    for s in toxic:
        support.update(strings(s))
    least = max(4, 0.0005 * len(toxic))
    in_clean = {g: 0 for g, n in support.items() if n >= least}
    del support
    for s in clean:
        for g in strings(s):
            if g in in_clean:
                in_clean[g] += 1
    where: dict[str, list[int]] = {g: [] for g in in_clean}
    for i, s in enumerate(toxic):
        for g in strings(s):
            if g in where:
                where[g].append(i)
    ratio = len(clean) / max(1, len(toxic))
    where = {g: at for g, at in where.items() if in_clean[g] <= 0.01 * len(at) * ratio}
    open_ = [True] * len(toxic)
    chosen: list[str] = []
    counts = {g: len(at) for g, at in where.items()}
    inverse: dict[int, list[str]] = defaultdict(list)
    for g, at in where.items():
        for i in at:
            inverse[i].append(g)
    while counts and len(chosen) < most:
        # Of equals the longer is told from chance more easily; then code points decide.
        best = max(counts, key=lambda g: (counts[g], len(g), g))
        if counts[best] < least:
            break
        # A longer string that covers nearly as much has more subsequences and fewer chance neighbours.
        best = max((g for g in counts if best in g and counts[g] >= 0.85 * counts[best]), key=lambda g: (len(g), counts[g], g))
        chosen.append(best)
        for i in where[best]:
            if open_[i]:
                open_[i] = False
                for g in inverse[i]:
                    counts[g] -= 1
    return chosen


def fit(sentences: Iterable[tuple[str, int]], most_landmarks: int = 48, negatives: int = 20_000, caution: float = 40.0, rounds: int = 4000) -> Machine:
    """The machine from labelled sentences (text, 0 or 1)."""
    toxic, clean, seen = [], [], set()
    for text, label in sentences:
        words = units(text)
        edges = (*words[:3], *words[-3:])
        if not label:
            clean.append(set(words))
        elif edges not in seen:  # near copies of a sentence support nothing anew
            seen.add(edges)
            toxic.append(set(words))
    if not toxic or not clean:
        return Machine()
    landmarks = choose_landmarks(toxic, clean, most_landmarks)
    if not landmarks:
        return Machine()
    base = Machine(landmarks, np.zeros(len(landmarks)), 0.0)
    carriers = sorted({p for s in toxic for w in s for p in cut(w) if any(z in p for z in landmarks)})
    rng = np.random.default_rng(7)
    gapped = []
    for z in landmarks:
        for sign in ("-", ".", "*", " "):
            at = int(rng.integers(1, len(z)))
            gapped += [z[:at] + sign + z[at:], z[:2] + sign.join(z[1:])[1:]]
    ordinary = sorted({p for s in clean for w in s for p in cut(w)})
    row, col, value = base.similarities(ordinary)
    nearest = np.zeros(len(ordinary))
    np.maximum.at(nearest, row, value)
    keep = np.argsort(-nearest, kind="stable")[:negatives]
    words = [*carriers, *gapped, *[ordinary[i] for i in keep]]
    label = np.r_[np.ones(len(carriers) + len(gapped)), -np.ones(len(keep))]
    weight = np.r_[np.full(len(carriers), 1.0 / max(1, len(carriers))), np.full(len(gapped), 0.25 / len(gapped)), np.full(len(keep), caution / max(1, len(keep)))]
    row, col, value = base.similarities(words)
    k = np.zeros((len(words), len(landmarks)))
    k[row, col] = value
    row, col, value = base.similarities(landmarks)
    own = np.zeros((len(landmarks), len(landmarks)))
    own[row, col] = value
    own = (own + own.T) / 2
    size, axes = np.linalg.eigh(own)
    root = axes @ np.diag(np.where(size > 1e-3, size, np.inf) ** -0.5) @ axes.T
    x = k @ root
    w, b, total, bias = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    penalty = 1e-5
    for t in range(1, rounds + 1):
        wrong = label * (x @ w + b) < 1
        pull = weight * label * wrong
        rate = 1.0 / (penalty * (t + 1 / penalty / 2))
        w = (1 - rate * penalty) * w + rate * (x.T @ pull)
        b = b + rate * pull.sum()
        if t > rounds // 2:
            total, bias = total + w, bias + b
    half = rounds - rounds // 2
    machine = Machine(landmarks, root @ (total / half), float(bias / half))
    # The border: above all but a few clean sentences, yet below most carriers.
    decision = dict(zip(ordinary, machine.decide(ordinary).tolist(), strict=True))
    tops = [max((decision[p] for w in s for p in cut(w)), default=machine.bias) for s in clean]
    machine.bias -= border(np.array(tops), machine.decide(carriers))
    return machine


def border(clean: np.ndarray, carriers: np.ndarray, sentences: int = 40) -> float:
    """Where the missed share of carriers, and that of clean documents of so many sentences that get over it, are least
    together; a tenth of the way up, if that is a whole range."""
    at = np.unique(np.r_[clean, carriers])
    missed = np.searchsorted(np.sort(carriers), at, side="right") / max(1, len(carriers))
    over = 1 - np.searchsorted(np.sort(clean), at, side="right") / max(1, len(clean))
    cost = missed + sentences * over
    best = int(np.argmin(cost))
    above = at[best + 1] if best + 1 < len(at) else at[best] + 1.0
    return float(at[best] + 0.1 * (above - at[best]))


def labelled_sentences(docs: DataFrame, labels: DataFrame, documents: int = 3000, sentences: int = 30_000, longest: int = 2000) -> list[tuple[str, int]]:
    """Sentences of at most ``documents`` labelled documents per class (those with the smallest hashes), at most
    ``sentences`` per class, of at most ``longest`` characters each; a sentence has its document's label. Rows without doc_id, label or text do not count."""
    ids = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for label in (0, 1):
        part = ids.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
        chosen = part if chosen is None else chosen.unionByName(part)
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    # The chosen ids are bounded by the parameter, so the texts need not move.
    rows = text.join(F.broadcast(chosen), "doc_id")
    parts = rows.select("toxic", F.explode(F.split("text", r"[.!?\n]+")).alias("sentence")).where(F.length(F.trim("sentence")).between(1, longest))
    # A sentence that clean documents have too is clean.
    parts = parts.groupBy(F.trim("sentence").alias("sentence")).agg(F.min("toxic").alias("toxic"))
    out: list[tuple[str, int]] = []
    for label in (0, 1):
        some = parts.where(F.col("toxic") == label).orderBy(F.xxhash64("sentence"), "sentence").limit(sentences)
        out += [(r["sentence"], r["toxic"]) for r in some.collect()]
    return out


def score(docs: DataFrame, machine: Machine, text: str = "text", to: str = "score") -> DataFrame:
    """Add the score, 0 to 1; an input column of that name is replaced."""
    bounded_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name.lower() != to.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = sys.modules.setdefault("marketops_worker_memory", types.ModuleType("marketops_worker_memory"))
        if store.__dict__.get("toxicity_key") != machine.key:
            store.toxicity_key, store.toxicity = machine.key, {}
        known = store.toxicity
        for batch in batches:
            _, offsets = utf8(batch.column(text))
            for i, j in steps(offsets, 2_000_000):
                part = batch.slice(i, j - i)
                words = [units(t) if t else [] for t in part.column(text).to_pylist()]
                new = set().union(*words) - known.keys()
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = set().union(*words)
                if new:
                    todo = sorted(new)
                    known.update(zip(todo, machine.decide(todo).tolist(), strict=True))
                get = known.__getitem__
                found = [machine.score(max(map(get, w), default=machine.bias)) for w in words]
                columns = [part.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64())], names=[*[f.name for f in kept], to])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField(to, T.DoubleType())]))
