"""Phrase collocations by mergeable Misra-Gries summaries and an exact second pass.

A-Z are lower-cased, texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words at blanks and tabs. Everything is per
language. A phrase lies within one piece.

1. Tasks count the n-grams of some millions of words exactly, and deal fingerprints and counts to hash partitions.
2. Each partition adds these up in one Misra-Gries summary. Its capacity exceeds the partition's mass divided by the threshold, so every
   n-gram that occurs as often as the threshold survives; counts at least as large as the threshold less all that was subtracted remain.
   Fingerprints may collide, which adds survivors and loses none. Survivors become bits of a bitmap of fixed size.
3. A second pass counts the n-grams whose bit is set, with their words, exactly; Spark sums the counts and drops rare ones.
4. Cuts, scores and the dropping of phrases inside longer ones are joins of the exact counts.

A summary holds at most mass / threshold / partitions counters, so partitions (``spark.sql.shuffle.partitions``) are to grow with the input.
The bitmap (32 MB) is broadcast; were it full, more rare n-grams would be shuffled in the second pass, with the same result.
Texts of any length are read in slices. NULL and empty texts have no words, a NULL language is ``und``; rows that repeat a document
count again; ties are broken down to the phrase; an empty table gives no rows. Only lang and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketops.llm.common import MIX_A, MIX_B, Rolling, Scratch, bounded_batches, mixed, parallelism, utf8

#: Words counted in one step, and bytes of text cut into words at once.
STEP_WORDS, SLICE_BYTES = 500_000, 2_000_000
BITMAP_BITS = 1 << 28

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0 in words, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after the last, first byte, byte after the last): whole rows, or a slice of one long row that ends between words."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        at, end = int(offsets[i]), int(offsets[j])
        while end - at > SLICE_BYTES:
            cut = at + SLICE_BYTES
            while cut < end and not (gap := KIND[data[cut : cut + 65_536]] > 0).any():
                cut += 65_536
            cut = min(end, cut + int(gap.argmax()) + 1) if cut < end else end
            if cut == end:
                break
            yield i, j, at, cut
            at = cut
        yield i, j, at, end
        i = j


class Counter:
    """Exact counts of the n-grams of consecutive words, in steps; an n-gram counts where its last word lies."""

    def __init__(self, longest: int):
        self.longest = longest
        self.langs: dict[str, int] = {}
        self.base = 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.context = 0

    def add(self, langs: list[str], data: np.ndarray, offsets: np.ndarray) -> Iterator[dict]:
        code = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int64)
        last = -1
        for i, j, start, end in slices(data, offsets):
            text = LOWER[data[start:end]]
            kind = KIND[text]
            # A text that was cut goes on; all others start here.
            heads = offsets[i + (i == last) : j] - start
            last = i if end < offsets[j] else -1
            inside = kind == 0
            first, stop = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1]
            stop[:-1] &= ~inside[1:]
            inner = heads[(heads > 0) & (heads < len(text))]
            first[inner] |= inside[inner]
            stop[inner - 1] |= inside[inner - 1]
            starts, ends = np.flatnonzero(first), np.flatnonzero(stop) + 1
            row = np.searchsorted(heads, starts, side="right")
            breaks = np.cumsum(kind == 2)
            piece = self.base + breaks[starts] + row
            self.base += (int(breaks[-1]) if len(text) else 0) + len(heads)
            if len(starts):
                self.parts.append((text[inside], ends - starts, piece, code[i + row - (len(heads) == j - i)]))
                self.size += len(starts)
            if self.size >= STEP_WORDS:
                yield self.step()

    def step(self) -> dict:
        """The words so far: per order the distinct n-grams as word numbers, their counts and fingerprints."""
        data, length, piece, lang = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        n, context = len(length), self.context
        ends = np.cumsum(length)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        texts, kinds = words.dictionary, len(words.dictionary)
        pairs = pa.array(lang * kinds + words.indices.to_numpy()).dictionary_encode()
        unit, pair = pairs.indices.to_numpy().astype(np.int64), pairs.dictionary.to_numpy()
        of = {i: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x, i in self.langs.items()}
        spread = np.array([of[i] for i in range(len(of))], np.uint64)
        buffer, at = utf8(texts)
        hashes = Rolling(buffer[at[0] : at[-1]]).of(at[:-1] - at[0], at[1:] - at[0])
        word_of, lang_of = pair % kinds, pair // kinds
        own = mixed(hashes[word_of] ^ spread[lang_of])
        found = {1: (np.arange(len(pair))[:, None], np.bincount(unit[context:], minlength=len(pair)), own)}
        ids, members, prints = unit, found[1][0], own
        for order in range(2, self.longest + 1):
            where = np.flatnonzero(piece[order - 1 :] == piece[: n - order + 1]) + order - 1 if n >= order else np.zeros(0, np.int64)
            coded = pa.array(ids[where - 1] * len(pair) + unit[where]).dictionary_encode()
            index, keys = coded.indices.to_numpy(), coded.dictionary.to_numpy().astype(np.int64)
            head, tail = keys // len(pair), keys % len(pair)
            members = np.hstack([members[head], tail[:, None]])
            prints = mixed(mixed(prints[head] + MIX_A) + own[tail] * MIX_B + np.uint64(order))
            ids = np.full(n, -1, np.int64)
            ids[where] = index
            found[order] = (members, np.bincount(index[where >= context], minlength=len(keys)), prints)
        # The last words go on as context, uncounted.
        keep = min(n, self.longest - 1)
        self.parts = [(data[ends[n - keep] - length[n - keep] :], length[n - keep :], piece[n - keep :], lang[n - keep :])] if keep else []
        self.size = self.context = keep
        names = list(self.langs)
        return {"grams": found, "texts": texts, "word": word_of, "lang": lang_of, "names": names, "total": np.bincount(lang[context:], minlength=len(names))}

    def rest(self) -> Iterator[dict]:
        if self.size > self.context:
            yield self.step()


def place(prints: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash partition and 32-bit key of a fingerprint."""
    return ((prints >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), prints.astype(np.uint32)


def _steps(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[dict]:
    counter = Counter(longest)
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        yield from counter.add(batch.column("lang").to_pylist(), data, offsets)
    yield from counter.rest()


class Summary:
    """Misra-Gries counters of 32-bit keys, ``capacity`` at most between merges."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(self.capacity, 100_000):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.size = [], 0
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, counts = keys[first], np.add.reduceat(counts, first)
        if len(keys) > self.capacity:
            # The largest count beyond the capacity is taken from all.
            less = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.lost += less
            counts = counts - less
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts

    def survivors(self, threshold: int) -> np.ndarray:
        self.merge()
        return self.keys[self.counts + self.lost >= threshold]


def frequent_bits(docs: DataFrame, longest: int, threshold: int, bits: int) -> np.ndarray:
    """A bitmap (packed bytes) in which the bits of all n-grams that occur ``threshold`` times are set."""
    spark = docs.sparkSession
    parts = parallelism(spark)
    width = max(8, bits // parts // 8 * 8)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in _steps(batches, longest):
            prints = np.concatenate([p for _, _, p in step["grams"].values()])
            counts = np.concatenate([c for _, c, _ in step["grams"].values()])
            prints, counts = prints[counts > 0], counts[counts > 0]
            part, key = place(prints, parts)
            # Single ones need no count.
            order = np.lexsort((counts > 1, part))
            part, key, counts = part[order], key[order], counts[order]
            edge = np.searchsorted(part, np.arange(parts + 1))
            mass = np.add.reduceat(np.r_[counts, 0], edge[:-1]) * (edge[1:] > edge[:-1])
            rows = []
            for p in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
                many = counts[edge[p] : edge[p + 1]]
                rows.append((p, 0, int(mass[p]), b"", b""))
                rows.append((p, 1, 0, key[edge[p] : edge[p + 1]].tobytes(), many[many > 1].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "kind", "mass", "keys", "counts"])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mass, summary = None, 0, None

        def done() -> pa.RecordBatch:
            marks = np.zeros(width, np.uint8)
            if summary:
                marks[summary.survivors(threshold) % np.uint32(width)] = 1
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(marks).tobytes()], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != now:
                    if now is not None:
                        yield done()
                    now, mass, summary = row["part"], 0, None
                if not row["kind"]:  # all of a partition's masses come first
                    mass += row["mass"]
                    continue
                summary = summary or Summary(mass // threshold + 1)
                keys, many = np.frombuffer(row["keys"], np.uint32), np.frombuffer(row["counts"], np.uint32)
                summary.add(keys, np.r_[np.ones(len(keys) - len(many), np.int64), many.astype(np.int64)])
        if now is not None:
            yield done()

    dealt = docs.mapInArrow(deal, "part bigint, kind int, mass bigint, keys binary, counts binary")
    sorted_ = dealt.repartition(parts, "part").sortWithinPartitions("part", "kind")
    out = np.zeros(parts * width // 8, np.uint8)
    for row in sorted_.mapInArrow(summarise, "part bigint, bits binary").toLocalIterator():
        out[row["part"] * width // 8 : (row["part"] + 1) * width // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def count_grams(docs: DataFrame, longest: int, threshold: int, bits: int = BITMAP_BITS) -> DataFrame:
    """(lang, words, phrase, n): exact counts of all n-grams of up to ``longest`` words with at least ``threshold`` occurrences; with
    ``words`` 0 and no phrase, the number of words of the language."""
    spark = docs.sparkSession
    parts = parallelism(spark)
    width = max(8, bits // parts // 8 * 8)
    shared = spark.sparkContext.broadcast(frequent_bits(docs, longest, threshold, bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for step in _steps(batches, longest):
            names = pa.array(step["names"], pa.string())
            some = np.flatnonzero(step["total"])
            out = [([0] * len(some), names.take(pa.array(some)), pa.array([""] * len(some), pa.string()), step["total"][some])]
            for order, (members, counts, prints) in step["grams"].items():
                part, key = place(prints, parts)
                bit = part * width + (key % np.uint32(width)).astype(np.int64)
                kept = np.flatnonzero((marks[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool) & (counts > 0))
                members = members[kept]
                words = [step["texts"].take(pa.array(step["word"][members[:, k]])) for k in range(order)]
                phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if order > 1 else words[0]
                out.append(([order] * len(kept), names.take(pa.array(step["lang"][members[:, 0]])), phrase.cast(pa.large_string()).cast(pa.string()), counts[kept]))
            for order, lang, phrase, n in out:
                yield pa.RecordBatch.from_arrays([lang, pa.array(order, pa.int32()), phrase, pa.array(n, pa.int64())], names=["lang", "words", "phrase", "n"])

    rows = docs.mapInArrow(count, "lang string, words int, phrase string, n bigint")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= threshold) | (F.col("words") == 0))


def largest(df: DataFrame, by: str, order: list, most: int, salts: int = 256) -> DataFrame:
    """The first ``most`` rows of each ``by``, with their rank; the bulk of a language is cut down in ``salts`` shares first."""
    share = Window.partitionBy(by, "__salt").orderBy(*order)
    whole = Window.partitionBy(by).orderBy(*order)
    some = df.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= most)
    return some.drop("rank", "__salt").withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= most)


def collocations(docs: DataFrame, longest: int = 3, threshold: int = 10, most: int = 2000, covered: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words that occur at least ``threshold`` times.

    The lowest-scoring cut of a phrase counts. A phrase is dropped if a longer one that contains it has at least ``covered`` % of its
    occurrences. Scores are exact for up to 10**16 occurrences.
    """
    scratch = Scratch(docs.sparkSession)
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    counts = scratch.store(count_grams(read, longest, threshold))
    grams = counts.where("words > 0")
    words = F.split("phrase", " ")
    joined = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    k = F.col("words")
    phrases = grams.where("words > 1").withColumnRenamed("n", "a")
    cut = F.transform(F.sequence(F.lit(1), k - 1), lambda c: F.struct(c.alias("cut"), F.array(joined(F.lit(1), c), joined(c + 1, k - c)).alias("sides")))
    sides = phrases.select("lang", "phrase", "a", F.explode(cut).alias("c")).select("lang", "phrase", "a", "c.cut", F.posexplode("c.sides").alias("side", "part"))
    known = grams.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    cuts = sides.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "cut").agg(*[F.max(F.when(F.col("side") == i, F.col("f"))).alias(x) for i, x in enumerate("lr")])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0)) * 1000000BD) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.score", "best.l", "best.r")
    shorter = F.transform(F.sequence(F.lit(2), k - 1), lambda size: F.transform(F.sequence(F.lit(1), k - size + 1), lambda at: joined(at, size)))
    inside = phrases.where("words > 2").select("lang", "a", F.explode(F.flatten(shorter)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < covered * wide("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    total = counts.where("words = 0").select("lang", F.col("n").alias("n"))
    return largest(kept.select("lang", "phrase", "a", "l", "r", "score"), "lang", order, most).join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_CUTS = r"[.,;:!?\x0A-\x0D]"
PHRASE_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '{_CUTS}')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k
  ) GROUP BY ALL
),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS x FROM c),
s AS (
  SELECT cut.lang, cut.phrase, cut.k, a, x, l.f AS l, r.f AS r, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cut JOIN g l ON l.lang = cut.lang AND l.phrase = array_to_string(w[1:x], ' ') JOIN g r ON r.lang = cut.lang AND r.phrase = array_to_string(w[x + 1:], ' ')
),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, x) = 1),
sub AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN sub ON sub.lang = b.lang AND sub.phrase = b.phrase WHERE b.k = 3 OR longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
