"""Similarity join of documents on word n-grams, by a token-group matrix.

A document's set holds its distinct runs of ``words`` words (A-Z lower-cased, words between ASCII white space); with fewer
words the whole sequence is one run. Two documents link when ``100 * intersection >= percent * union``.

1. Equal sets are one class, represented by its smallest doc_id.
2. MinHash bands deal the classes into blocks. So many bands of three values are taken that a pair at the threshold
   misses all of them with a chance below 1e-15. The smallest class of a block is its leader; a class's group is the smallest
   leader it meets. So similar documents fall into one group, and a class is a query to every group it shares a block with.
3. Every query is compared with its groups' leaders, exactly. Most links of a large group of near copies are settled here:
   what is linked to one leader is connected, and no pairs within the group are made.
4. For blocks whose members are still in different components, the token-group matrix is taken relative to what most members of
   a group hold: per group the tokens that its members have beyond that, or lack. From the counts of such differences follows how many two
   members must have in common, if they are to link; groups where no member can have so many are not opened. In the rest, only pairs that
   share one of the decisive differences are compared, exactly (see ``prefixes``). Of two groups that share a block, the members of the
   smaller one are queries to the larger.
5. Components of the links, by smallest label with pointer jumping, each round stored.

No step gathers a group in one task or makes all pairs of it; hot blocks and groups are aggregated or joined, and
AQE splits skewed joins. Documents without words have empty sets and link with nothing. NULL doc_ids come first. Rows that
repeat a doc_id take part each with its own text. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketops.llm.common import MIX_A, Rolling, Scratch, documents_of, mixed, steps, utf8

NO_ID = -(2**63)
ROWS = 3
#: Sets of a group that its reference is taken from.
SAMPLED = 9
#: Sets the places of a run apart.
TAGS = mixed(np.arange(1, 65, dtype=np.uint64) * MIX_A)


def bands_for(percent: int) -> int:
    """Bands of three values, so that a pair at the threshold shares one but for a chance of 1e-15."""
    return math.ceil(math.log(1e-15) / math.log(1 - (percent / 100) ** ROWS))


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each document's distinct runs, sorted by both."""
    n = len(offsets) - 1
    empty = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(data):
        return empty
    lower = np.where((data >= 65) & (data <= 90), data | 32, data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & np.r_[True, ~inside[:-1] | edge[1:-1]])
    end = np.flatnonzero(inside & np.r_[~inside[1:] | edge[1:-1], True]) + 1
    if not len(start):
        return empty
    hashed = Rolling(lower).of(start, end)
    row = np.searchsorted(offsets, start, side="right") - 1
    count = np.bincount(row, minlength=n)
    total = np.zeros(len(hashed), np.uint64)
    for w in range(min(words, len(hashed))):
        total[: len(hashed) - w] += mixed(hashed[w:] + TAGS[w])
    within = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    full = within <= (count - words)[row]
    rows, found = row[full], mixed(total[full])
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):  # fewer words than a run has: the whole sequence
        own = []
        first = np.cumsum(count) - count
        for r in short.tolist():
            h = np.uint64(count[r])
            for x in hashed[first[r] : first[r] + count[r]]:
                h = mixed(np.array([h], np.uint64) * MIX_A + x)[0]
            own.append(h)
        rows, found = np.r_[rows, short], np.r_[found, np.array(own, np.uint64)]
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    new = np.r_[True, (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])]
    return rows[new], found[new]


def class_keys(rows: np.ndarray, found: np.ndarray, n: int) -> tuple[np.ndarray, list[bytes | None]]:
    size = np.bincount(rows, minlength=n)
    has = np.flatnonzero(size)
    first = (np.cumsum(size) - size)[has]
    keys: list[bytes | None] = [None] * n
    if len(has):
        one = np.add.reduceat(mixed(found), first)
        two = np.add.reduceat(mixed(found ^ MIX_A), first)
        raw = np.stack([one, two], 1).astype("<u8").tobytes()
        for i, r in enumerate(has.tolist()):
            keys[r] = raw[16 * i : 16 * i + 16]
    return size, keys


def sketch(words: int, bands: int):
    rng = np.random.default_rng(20)
    xor = rng.integers(0, 2**64, bands * ROWS, np.uint64)
    odd = rng.integers(0, 2**63, bands * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in steps(offsets):
                n = j - i
                rows, found = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                size, keys = class_keys(rows, found, n)
                has = np.flatnonzero(size)
                sigs = np.zeros((len(has), bands), np.uint64)
                if len(has):
                    first = (np.cumsum(size) - size)[has]
                    for b in range(bands):
                        h = np.full(len(has), np.uint64(b + 1))
                        for k in range(b * ROWS, b * ROWS + ROWS):
                            h = mixed(h * MIX_A + np.minimum.reduceat((found ^ xor[k]) * odd[k], first))
                        sigs[:, b] = h
                ends = np.cumsum(np.r_[0, np.where(size > 0, bands, 0)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, n), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sigs.ravel().view(np.int64)))],
                    names=["doc_id", "n", "key", "sigs"],
                )

    return run


def token_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in steps(offsets):
                rows, found = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                size, keys = class_keys(rows, found, j - i)
                ends = np.cumsum(np.r_[0, size])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.view(np.int64)))], names=["key", "tokens"])

    return run


def compare(percent: int):
    """Exact comparison of the two sets in a row: linked or not, and how many tokens of ``b`` are missing in ``a`` or new there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, missing, new = [], [], []
            a, b = batch.column("tokens_a"), batch.column("tokens_b")
            for i in range(batch.num_rows):
                x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
                union = len(np.unique(np.concatenate([x, y])))
                linked.append(100 * (len(x) + len(y) - union) >= percent * union)
                missing.append(union - len(x))
                new.append(union - len(y))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(missing, pa.int64()), pa.array(new, pa.int64())], names=["a", "b", "linked", "missing", "new"])

    return run


def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the token-group matrix: what tells a set from its group's reference, new tokens and missing ones. Other columns stay."""
    for batch in batches:
        sets, references = batch.column("tokens"), batch.column("reference")
        rows, missing, new = [], [], []
        for i in range(batch.num_rows):
            x, y = sets[i].values.to_numpy(), references[i].values.to_numpy()
            lacks, has = np.setdiff1d(y, x, True), np.setdiff1d(x, y, True)
            rows.append(np.r_[has, mixed(lacks.view(np.uint64)).view(np.int64)])  # another sign, another token
            missing.append(len(lacks))
            new.append(len(has))
        ends = np.cumsum([0, *map(len, rows)])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        kept = [c for c in batch.schema.names if c not in ("tokens", "reference")]
        added = [pa.array(missing, pa.int64()), pa.array(new, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *added], names=[*kept, "missing", "new", "differences"])


def references(asked: DataFrame, tokens: DataFrame) -> DataFrame:
    """(b, reference): the tokens that more than half of a few sets of each group hold, its own members first.

    The bounds hold whatever set the differences are taken from; one near the members only leaves fewer of them. A leader may be far
    from all the copies of a text, which then lack and have the same long lists.
    """
    few = asked.select("a", "b", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("own"), "a")).alias("__n")).where(F.col("__n") <= SAMPLED)
    sizes = few.groupBy("b").agg(F.max("__n").alias("sets"))
    held = few.join(tokens.select(F.col("key").alias("a"), "tokens"), "a").select("b", F.explode("tokens").alias("held"))
    most = held.groupBy("b", "held").agg(F.count("*").alias("k")).join(sizes, "b").where(F.col("k") * 2 > F.col("sets"))
    return most.groupBy("b").agg(F.collect_list("held").alias("reference"))


def weighted(rows: DataFrame, percent: int) -> DataFrame:
    """With the weight ``f`` of the differences, their number ``d`` and the ``slack`` of what they are taken from (see ``prefixes``)."""
    weight = (F.col("missing") * 100 + F.col("new") * percent) / (100 + percent)
    return rows.withColumns({"f": weight, "d": F.col("missing") + F.col("new"), "slack": (F.col("n") + F.col("missing") - F.col("new")) * (100 - percent) / (100 + percent)}).drop("missing", "new")


def possible(asked: DataFrame) -> DataFrame:
    """The rows that some other set of the group can link with, as no set shares more differences than it has (``d``); with ``least_f``, the
    smallest f they could meet.

    A query of another group meets the group's own members only, a member meets all, as such a query may be all that it links with. A
    group's two largest rooms are enough, as a set is no partner of its own.
    """
    mine = F.col("own") == 1
    room = asked.select("a", "b", "f", "own", (F.col("d") - F.col("f")).alias("room"))
    largest = room.withColumn("__n", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("room"), "a"))).where(F.col("__n") <= 2)
    rooms = largest.groupBy("b").agg(F.max("room").alias("most"), F.min_by("a", "__n").alias("whose"), F.max(F.when(F.col("__n") == 2, F.col("room"))).alias("second"))
    members = room.groupBy("b").agg(F.max(F.when(mine, F.col("room"))).alias("most_own"), F.min(F.when(mine, F.col("f"))).alias("f_own"), F.min("f").alias("f_any"))
    best = F.when(~mine, F.col("most_own")).when(F.col("whose") == F.col("a"), F.coalesce("second", F.lit(-1.0))).otherwise(F.col("most"))
    kept = asked.join(rooms, "b").join(members, "b").where(F.col("f_own").isNotNull() & (F.col("f") - F.col("slack") <= best + 1e-9))
    return kept.withColumn("least_f", F.when(mine, F.col("f_any")).otherwise(F.col("f_own"))).drop("most", "whose", "second", "most_own", "f_own", "f_any")


def centred(rows: DataFrame) -> DataFrame:
    """With the set ``m`` of each group that is nearest to its reference, and its weight ``f_m``.

    Two sets link without any common difference if and only if their weights add up to no more than the slack. Those of which that holds with
    ``m`` are ``close``, linked to it and, within the group, of its component: so no such pair is left to be found.
    """
    first = F.struct("f", "a")
    middle = rows.groupBy("b").agg(F.min("f").alias("f_m"), F.min_by("a", first).alias("m"), F.min_by("label", first).alias("label_m"))
    found = rows.join(middle, "b").withColumn("close", F.col("f") + F.col("f_m") <= F.col("slack") + 1e-9)
    return found.withColumn("label", F.when(F.col("close"), F.col("label_m")).otherwise(F.col("label"))).drop("label_m")


def prefixes(held: DataFrame) -> DataFrame:
    """Of each set the few differences one of which it shares with any set it links with, each with its place ``at`` among the set's.

    With B missing and A new tokens relative to whatever set R, two sets of one group link if and only if they have at least
    ``f(a) + f(b) - slack`` common differences, f = (100 B + p A) / (100 + p), slack = (100 - p) / (100 + p) * |R|. So a set must share more
    than f - f_m of its differences with one that is not close (see ``centred``), and at least f + least_f - slack with any.
    Differences that no set of another component has, or no member of the group, are none to share; without them, ``d`` are left. In an order that
    all sets of a group have in common, two sets with t common differences share one of the first ``d - t + 1`` of each. The rarest go first,
    so that what many sets lack is hardly ever looked at.
    """
    listed = held.select("a", "b", "own", "label", F.explode("differences").alias("token"))
    counts = listed.groupBy("b", "token").agg(F.count("*").alias("k"), F.max("own").alias("mine"), F.min("label").alias("low"), F.max("label").alias("high"))
    counts = counts.where("mine = 1 AND low != high").select("b", "token", "k")
    shared = listed.join(counts, ["b", "token"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("k", "token"))).alias("list"))
    held = possible(held.drop("differences", "d", "least_f").join(shared.withColumn("d", F.size("list")), ["a", "b"]))
    least = F.greatest(F.lit(1), F.ceil(F.col("f") + F.col("least_f") - F.col("slack") - 1e-9))
    near = F.col("d") + 1 - F.greatest(least, F.floor(F.col("f") - F.col("f_m")) + 1)
    first = F.when(F.col("close"), near).otherwise(F.col("d") + 1 - least)
    held = held.withColumns({"near": near, "list": F.slice("list", F.lit(1), F.greatest(F.lit(0), first).cast("int"))})
    opened = held.select("a", "b", "n", "label", "close", "own", "f", "d", "slack", "near", F.posexplode("list").alias("at", "found"))
    return opened.select("*", F.col("found.token").alias("token"), (F.col("at") < F.col("near")).alias("is_near")).drop("near", "found")


def components(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, label): the smallest (rep, key) reachable from each node (``key``, ``rep``)."""
    labels = scratch.store(nodes.select("key", F.struct("rep", "key").alias("label")))
    edges = scratch.store(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    while True:
        near = edges.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "key", "left").select("key", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        # Pointer jumping: a label's own label.
        lower = scratch.store(lower)
        jump = lower.select(F.col("key").alias("__at"), F.col("new").alias("__to"))
        jumped = lower.join(jump, F.col("new.key") == F.col("__at"), "left").select("key", "label", F.least("new", F.coalesce("__to", "new")).alias("new"))
        jumped = scratch.store(jumped)
        if jumped.where(F.col("label") != F.col("new")).isEmpty():
            return labels
        labels = jumped.select("key", F.col("new").alias("label"))


def link_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row per document; ``component_id`` is the smallest doc_id reachable by links."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = documents_of(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sets = scratch.store(rows.mapInArrow(sketch(words, bands_for(percent)), "doc_id bigint, n bigint, key binary, sigs array<bigint>"))
    first = sets.where("n > 0").groupBy("key").agg(F.min(F.struct("doc_id", "n", "sigs")).alias("s"))
    classes = first.select("key", F.col("s.doc_id").alias("rep"), F.col("s.n").alias("n"), F.explode("s.sigs").alias("sig"))
    leaders = classes.groupBy("sig").agg(F.count("*").alias("members"), F.min(F.struct("rep", "key")).alias("leader")).where("members > 1").drop("members")
    blocks = scratch.store(classes.join(leaders, "sig"))
    nodes = scratch.store(blocks.groupBy("key", "rep", "n").agg(F.min("leader").alias("group")))

    grouped = blocks.select("sig", "key", "rep", "n").join(nodes.select("key", "group"), "key")
    grouped = scratch.store(grouped)
    # A class is a query to its own group and to those of all it shares a block with; sizes must allow a link.
    ranges = nodes.groupBy("group").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    met = grouped.select("sig", F.col("group").alias("to")).distinct()
    queries = grouped.select("sig", "key", "n").join(met, "sig").select("key", "n", "to").distinct()
    leader_sizes = nodes.select(F.struct("rep", "key").alias("group"), F.col("n").alias("leader_n"))
    queries = queries.join(ranges.join(leader_sizes, "group"), F.col("to") == F.col("group"))
    queries = queries.withColumns({"low": F.least("low", "leader_n"), "high": F.greatest("high", "leader_n")})
    queries = queries.where((F.col("low") * percent <= F.col("n") * 100) & (F.col("n") * percent <= F.col("high") * 100))
    queries = scratch.store(queries.select("key", "to"))

    reps = nodes.select(F.col("rep").alias("doc_id")).distinct()
    tokens = scratch.store(rows.join(reps, "doc_id", "left_semi").mapInArrow(token_sets(words), "key binary, tokens array<bigint>").where("key IS NOT NULL"))

    def with_sets(pairs: DataFrame) -> DataFrame:
        left = pairs.join(tokens.select(F.col("key").alias("a"), F.col("tokens").alias("tokens_a")), "a")
        return left.join(tokens.select(F.col("key").alias("b"), F.col("tokens").alias("tokens_b")), "b")

    def verified(pairs: DataFrame) -> DataFrame:
        return with_sets(pairs).select("a", "b", "tokens_a", "tokens_b").mapInArrow(compare(percent), "a binary, b binary, linked boolean, missing bigint, new bigint")

    led = queries.where(F.col("key") != F.col("to.key")).select(F.col("key").alias("a"), F.col("to.key").alias("b")).distinct()
    led = scratch.store(verified(led))
    links = led.where("linked").select("a", "b")
    labels = scratch.store(components(nodes, links, scratch))

    # Blocks that still hold several components; in them, the queries and the groups of what they could link with.
    sizes = nodes.groupBy("group").agg(F.count("*").alias("size"))
    placed = grouped.join(labels.join(nodes.join(sizes, "group").select("key", "size"), "key"), "key")
    unsettled = placed.groupBy("sig").agg((F.min("label") != F.max("label")).alias("open")).where("open").select("sig")
    open_ = scratch.store(placed.join(unsettled, "sig").select("sig", "key", "n", "label", F.col("group.key").alias("group"), F.struct("size", "group.key").alias("place")))
    sides = open_.groupBy("sig", F.col("group").alias("b"), F.col("place").alias("to")).agg(F.min("label").alias("low"), F.max("label").alias("high"))
    # A pair of two groups is looked for once, in the larger one.
    met = open_.join(sides, "sig").where((F.col("group") == F.col("b")) | ((F.col("place") < F.col("to")) & ((F.col("low") != F.col("label")) | (F.col("high") != F.col("label")))))
    asked = met.groupBy(F.col("key").alias("a"), "n", "label", "b").agg(F.max((F.col("group") == F.col("b")).cast("int")).alias("own"))
    bounded = scratch.store(possible(weighted(asked.join(led.drop("linked"), ["a", "b"]), percent)).select("a", "b", "n", "label", "own"))
    pairs = bounded.join(tokens.withColumnRenamed("key", "a"), "a").join(references(bounded, tokens), "b", "left")
    pairs = pairs.withColumn("reference", F.coalesce("reference", F.array().cast("array<bigint>")))
    told = "b binary, a binary, n bigint, label struct<rep: bigint, key: binary>, own int, missing bigint, new bigint, differences array<bigint>"
    told = scratch.store(pairs.select("b", "a", "n", "label", "own", "tokens", "reference").mapInArrow(differences, told))
    told = scratch.store(centred(weighted(told, percent)))
    links = links.unionByName(told.where("close AND a != m").select("a", F.col("m").alias("b")))
    matrix = scratch.store(prefixes(scratch.store(possible(told))))
    fields = {"a": "set", "n": "n", "label": "label", "close": "close", "is_near": "near", "f": "f", "d": "d", "at": "at"}
    one = matrix.select(F.col("b").alias("group"), "token", "slack", *[F.col(c).alias(f"{name}_1") for c, name in fields.items()])
    two = matrix.where("own = 1").select(F.col("b").alias("group"), "token", *[F.col(c).alias(f"{name}_2") for c, name in fields.items()])
    # At their first common difference, no more can be common than the shorter rest.
    rest = F.least(F.col("d_1") - F.col("at_1"), F.col("d_2") - F.col("at_2"))
    pairs = one.join(two, ["group", "token"]).where(
        (F.col("label_1") != F.col("label_2")) & (F.col("close_1") | F.col("close_2") | (F.col("near_1") & F.col("near_2"))) & (F.col("f_1") + F.col("f_2") - F.col("slack") <= rest + 1e-9)
        & (F.col("n_1") * percent <= F.col("n_2") * 100) & (F.col("n_2") * percent <= F.col("n_1") * 100)
    )
    pairs = pairs.select(F.least("set_1", "set_2").alias("a"), F.greatest("set_1", "set_2").alias("b")).distinct()
    more = scratch.store(verified(pairs).where("linked").select("a", "b"))
    labels = components(nodes, links.unionByName(more), scratch)

    known = sets.join(labels.select("key", F.col("label.rep").alias("linked")), "key", "left")
    own = known.join(first.select("key", F.col("s.doc_id").alias("rep")), "key", "left")
    ids = {c: F.when(F.col(c) != NO_ID, F.col(c)) for c in ("doc_id", "component")}
    result = own.withColumn("component", F.coalesce("linked", "rep", "doc_id"))
    result = scratch.store(result.select(ids["doc_id"].alias("doc_id"), F.col("n").alias("n_shingles"), ids["component"].alias("component_id")))
    scratch.drop()
    return result
