"""Repair of conversations to ``(s?(ua)+)?`` at the least cost, by a run-length dynamic program.

A conversation is its rows by turn (NULL first), then role, then the text's SHA-256; identical rows stay side by side. Each row is one of nine
symbols: to be deleted (blank, or role and text seen earlier), or a role class with or without a truncated end. Equal consecutive symbols form a
run. The cost of what follows a run comes from the cost after it by the cached binary powers of the symbol's min-plus transition; a
second walk then unrolls the choices, always the ASCII-least edit that keeps the cost, which gives the least audit.

Keep (K) costs 0, Rerole (R) to user or assistant 1, Delete (D) 2, Insert (I) of an empty user or assistant 5; a truncated row that stays adds 5.

Long conversations are cut into parts of bounded text and rows. Each part's transition is one 4 x 4 matrix, the matrices are chained from the
end, each part maps the states it may be entered in to those it leaves, and these maps are chained from the start; so parts are unrolled alone.
Symbols travel without texts; texts are shuffled twice, once by row key (which merges identical rows first) and once by part.

NULL roles and texts count as one space, NULL turns as a turn before all others, rows without conv_id as one conversation. A turn that occurs
twice is ordered as above. Only the four named columns are read, so others cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketops.functions.windows import running
from marketops.llm.common import bounded_batches, parallelism

#: Bounds of one part of a conversation.
PART_BYTES, PART_ROWS = 4_000_000, 20_000
#: States: nothing yet, after the system, after a user, after an assistant. By role class the state a kept row leads to.
FAR = 1 << 60
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "?": (None,) * 4}
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
BLANKS = " \t\n\x0b\x0c\r"

Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(FAR, *(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def applied(a: Matrix, v: Vector) -> Vector:
    return tuple(min(FAR, *(a[i][k] + v[k] for k in range(4))) for i in range(4))


def insertions() -> Matrix:
    """The least cost of getting from state to state by inserted turns alone."""
    cost = [[0 if i == j else FAR for j in range(4)] for i in range(4)]
    for start in range(4):
        state, spent = start, 0
        for _ in range(4):
            state, spent = NEXT[state], spent + INSERT
            cost[start][state] = min(cost[start][state], spent)
    return tuple(map(tuple, cost))


INSERTED = insertions()
#: What is still to pay at the end of a conversation, by state.
END: Vector = applied(INSERTED, (0, FAR, FAR, 0))


def transition(symbol: str) -> Matrix:
    """The matrix of one row, turns inserted before it included. A symbol is ``X`` (to be deleted) or a role class, with ``!`` if truncated."""
    row = [[FAR] * 4 for _ in range(4)]
    for i in range(4):
        row[i][i] = DELETE
        if symbol != "X":
            extra = TRUNCATED * symbol.endswith("!")
            row[i][NEXT[i]] = min(row[i][NEXT[i]], REROLE + extra)
            kept = AFTER[symbol[0]][i]
            if kept is not None:
                row[i][kept] = min(row[i][kept], extra)
    return product(INSERTED, tuple(map(tuple, row)))


class Powers:
    """Transitions of runs: each symbol's binary powers, kept as they are first needed."""

    def __init__(self):
        self.known: dict[str, list[Matrix]] = {}

    def of(self, symbol: str, times: int) -> Iterator[Matrix]:
        """The powers whose product is the transition of so many rows (they commute)."""
        chain = self.known.setdefault(symbol, [transition(symbol)])
        k = 0
        while times >> k:
            if k == len(chain):
                chain.append(product(chain[-1], chain[-1]))
            if times >> k & 1:
                yield chain[k]
            k += 1

    def back(self, symbol: str, times: int, v: Vector) -> Vector:
        """The cost before a run from that after it."""
        for m in self.of(symbol, times):
            v = applied(m, v)
        return v


def runs_of(rows: list[tuple[str, int]]) -> list[list]:
    """(symbol, rows) with equal neighbours joined."""
    out: list[list] = []
    for symbol, times in rows:
        if out and out[-1][0] == symbol:
            out[-1][1] += times
        elif times:
            out.append([symbol, times])
    return out


def whole(powers: Powers, runs: list[list]) -> Matrix:
    """The transition of all runs together."""
    m = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
    for symbol, times in runs:
        for p in powers.of(symbol, times):
            m = product(m, p)
    return m


def unroll(powers: Powers, runs: list[list], state: int, after: Vector, last: bool) -> tuple[str, int]:
    """(the least audit of the runs entered in a state, the state they leave), given the cost after them."""
    costs = [after]
    for symbol, times in reversed(runs):
        costs.append(powers.back(symbol, times, costs[-1]))
    costs.reverse()
    audit = []
    for (symbol, times), end in zip(runs, costs[1:], strict=True):
        if symbol == "X":  # a deletion now costs what it costs after an insertion, and comes first
            audit.append("D" * times)
            continue
        extra = TRUNCATED * symbol.endswith("!")
        ahead = [end]
        while len(ahead) <= times:
            ahead.append(powers.back(symbol, 1, ahead[-1]))
        for left in range(times - 1, -1, -1):
            after, before = ahead[left], ahead[left + 1]
            while True:
                kept = AFTER[symbol[0]][state]
                if DELETE + after[state] == before[state]:
                    audit.append("D")
                elif INSERT + before[NEXT[state]] == before[state]:
                    audit.append("I")
                    state = NEXT[state]
                    continue
                elif kept is not None and extra + after[kept] == before[state]:
                    audit.append("K")
                    state = kept
                else:
                    audit.append("R")
                    state = NEXT[state]
                break
    if last:
        while END[state]:
            audit.append("I")
            state = NEXT[state]
    return "".join(audit), state


def normal_rows(rows: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text, copies) without NULL roles and texts; ``conv`` is a key that is never NULL."""
    copies = F.col("copies").cast("bigint") if "copies" in rows.columns else F.lit(1).cast("bigint")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(conversation_key().alias("conv"), "conv_id", F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"), copies.alias("copies"))


def conversation_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


KEY = ["conv", "turn_key", "role", "digest"]


def marked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts by row key, distinct rows without text: their copies, faults and symbols)."""
    turn_key = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    keyed = rows.select("conv", turn_key.alias("turn_key"), "role", F.sha2("text", 256).alias("digest"), "text", "copies")
    texts = keyed.groupBy(*KEY).agg(F.max("text").alias("text"))
    body = F.rtrim("text", F.lit(BLANKS))
    ends = F.substring(body, -1, 1)
    narrow = keyed.groupBy(*KEY).agg(
        F.sum("copies").alias("copies"), F.max(F.octet_length("text")).alias("size"), F.max(body == "").alias("blank"), F.max(~ends.isin(".", "!", "?")).alias("open"),
    )
    first = narrow.groupBy("conv", "role", "digest").agg(F.min("turn_key").alias("first"))
    again = F.col("turn_key") > F.col("first")
    narrow = narrow.join(first, ["conv", "role", "digest"]).withColumn("again", again & ~F.col("blank"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("?")
    symbol = F.when(F.col("blank") | F.col("again"), "X").when(F.col("open"), F.concat(kind, F.lit("!"))).otherwise(kind)
    return texts, narrow.select(*KEY, "copies", "size", "blank", "open", "again", initial.alias("initial"), symbol.alias("symbol"))


def in_parts(narrow: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Adds the part of its conversation that a row belongs to, and where in the conversation the row is."""
    ran = running(narrow, ["conv"], ["turn_key", "role", "digest"], None, {"rows_": ("sum", F.col("copies")), "bytes_": ("sum", F.col("size").cast("bigint"))}, inclusive=False)
    rows, size = F.coalesce("rows_", F.lit(0)), F.coalesce("bytes_", F.lit(0))
    part = F.floor(rows / most_rows) + F.floor(size / most_bytes)
    return ran.select(*narrow.columns, rows.alias("place"), part.cast("bigint").alias("part"))


def groups(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of sorted batches, group by group."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[c] for c in by)
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(row)
    if rows:
        yield now, rows


def batches_of(rows: Iterator[dict], schema: pa.Schema, most_rows: int = 2000, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row, weight in rows:
        out.append(row)
        size += weight
        if len(out) >= most_rows or size > most_bytes:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def symbols(rows: list[dict]) -> list[tuple[str, int]]:
    """The rows' symbols in order; further copies of a row are duplicates."""
    out = []
    for r in rows:
        out += [(r["symbol"], 1), ("X", r["copies"] - 1)]
    return out


def dealt(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.repartition(parallelism(df.sparkSession), *by).sortWithinPartitions(*by, *order)


def borders(placed: DataFrame) -> DataFrame:
    """(conv, part, parts, entry, after, before): of the conversations that have several parts, the state a part is entered in, the cost after it
    by state, and the role initial of the row before it."""
    count = placed.groupBy("conv").agg(F.max("part").alias("last_part")).where("last_part > 0")
    rows = placed.join(count, "conv").select("conv", "part", "last_part", "place", "symbol", "copies", "initial")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        schema = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("cost", pa.list_(pa.int64())), ("initial", pa.string())])
        found = (({"conv": conv, "part": part, "cost": sum(whole(powers, runs_of(symbols(r))), ()), "initial": r[-1]["initial"]}, 0) for (conv, part), r in groups(batches, "conv", "part"))
        yield from batches_of(found, schema)

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("after", pa.list_(pa.int64())), ("last", pa.bool_()), ("initial", pa.string())])

        def walk():
            now, v = None, END
            for batch in batches:
                for r in batch.to_pylist():
                    last = r["conv"] != now
                    if last:
                        now, v = r["conv"], END
                    yield {"conv": now, "part": r["part"], "after": list(v), "last": last, "initial": r["initial"]}, 0
                    c = r["cost"]
                    v = applied((tuple(c[0:4]), tuple(c[4:8]), tuple(c[8:12]), tuple(c[12:16])), v)

        yield from batches_of(walk(), schema)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        schema = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("leaves", pa.list_(pa.int64()))])

        def walk():
            for (conv, part), r in groups(batches, "conv", "part"):
                runs, after = runs_of(symbols(r)), tuple(r[0]["after"])
                yield {"conv": conv, "part": part, "leaves": [unroll(powers, runs, s, after, False)[1] for s in range(4)]}, 0

        yield from batches_of(walk(), schema)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("parts", pa.int64()), ("entry", pa.int64()), ("after", pa.list_(pa.int64())), ("before", pa.string())])

        def walk():
            now, state, before = None, 0, None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["conv"] != now:
                        now, state, before = r["conv"], 0, None
                    yield {"conv": now, "part": r["part"], "parts": 0 if r["last"] else 1, "entry": state, "after": r["after"], "before": before}, 0
                    state, before = r["leaves"][state], r["initial"]

        yield from batches_of(walk(), schema)

    costs = dealt(rows, ["conv", "part"], ["place"]).mapInArrow(matrices, "conv string, part bigint, cost array<bigint>, initial string")
    parts = parallelism(placed.sparkSession)
    back = costs.repartition(parts, "conv").sortWithinPartitions(F.asc("conv"), F.desc("part"))
    ends = back.mapInArrow(backward, "conv string, part bigint, after array<bigint>, last boolean, initial string")
    mapped = dealt(rows.join(ends.select("conv", "part", "after"), ["conv", "part"]), ["conv", "part"], ["place"]).mapInArrow(maps, "conv string, part bigint, leaves array<bigint>")
    return dealt(ends.join(mapped, ["conv", "part"]), ["conv"], ["part"]).mapInArrow(forward, "conv string, part bigint, parts bigint, entry bigint, after array<bigint>, before string")


def repair(rows: DataFrame, most_rows: int = PART_ROWS, most_bytes: int = PART_BYTES) -> DataFrame:
    """(conv, part, more, audit, illegal, cost, turns): per part of a conversation its edits' initials in order, how many neighbours had illegal roles
    before, what the edits cost, and the repaired turns as an array of (role, text). ``more`` says that another part follows.

    Reads conv_id, turn, role, text and, where given, copies: how often a row stands there.
    """
    bounded_batches(rows.sparkSession)
    texts, narrow = marked(normal_rows(rows))
    placed = in_parts(narrow, most_rows, most_bytes)
    edges = borders(placed)
    wide = texts.join(placed.select(*KEY, "place", "part", "symbol", "copies", "initial"), KEY).join(edges, ["conv", "part"], "left")
    rows_ = dealt(wide.select("conv", "part", "place", "symbol", "copies", "initial", "role", "text", "parts", "entry", "after", "before"), ["conv", "part"], ["place"])
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    schema = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("more", pa.bool_()), ("audit", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("turns", pa.list_(turn))])
    legal = {("s", "u"), ("u", "a"), ("a", "u")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()

        def walk():
            for (conv, part), found in groups(batches, "conv", "part"):
                head = found[0]
                alone = head["entry"] is None
                start, after = (0, END) if alone else (head["entry"], tuple(head["after"]))
                more = not alone and bool(head["parts"])
                audit, _ = unroll(powers, runs_of(symbols(found)), start, after, not more)
                turns, cost, state, at = [], 0, start, 0
                illegal, before = 0, head["before"]
                for r in found:
                    illegal += r["copies"] - 1 + (before is not None and (before, r["initial"]) not in legal)
                    before = r["initial"]
                    while audit[at] == "I":
                        state, cost, at = NEXT[state], cost + INSERT, at + 1
                        turns.append({"role": ROLE[state], "text": ""})
                    edit, at = audit[at], at + r["copies"]
                    cost += DELETE * (r["copies"] - 1)
                    if edit == "D":
                        cost += DELETE
                        continue
                    cost += TRUNCATED * r["symbol"].endswith("!")
                    if edit == "K":
                        state = AFTER[r["symbol"][0]][state]
                        turns.append({"role": r["role"], "text": r["text"]})
                    else:
                        state, cost = NEXT[state], cost + REROLE
                        turns.append({"role": ROLE[state], "text": r["text"]})
                for _ in audit[at:]:
                    state, cost = NEXT[state], cost + INSERT
                    turns.append({"role": ROLE[state], "text": ""})
                yield {"conv": conv, "part": part, "more": more, "audit": audit, "illegal": illegal, "cost": cost, "turns": turns}, sum(len(r["text"]) for r in found)

        yield from batches_of(walk(), schema)

    return rows_.mapInArrow(run, "conv string, part bigint, more boolean, audit string, illegal bigint, cost bigint, turns array<struct<role:string,text:string>>")


def counts(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated) of the rows as they are, each row counted for its first fault."""
    normal = normal_rows(rows)
    _, narrow = marked(normal)
    blank, again = F.col("blank"), F.col("again")
    fault = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    faults = narrow.groupBy("conv").agg(
        fault(F.when(blank, F.col("copies"))).alias("blank"),
        fault(F.when(~blank, F.col("copies") - (~again).cast("bigint"))).alias("duplicate"),
        fault((~blank & ~again & F.col("open")).cast("bigint")).alias("truncated"),
    )
    turns = normal.where("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    return faults.join(turns, "conv", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("bigint")))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, audit, illegal, cost, repaired_sha256): one row per conversation; the hash is over ``role:text`` lines.

    A hash reads its bytes in order, so the parts of one conversation are streamed through one task, which holds a single part at a time.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    parts = repaired.withColumn("several", F.col("more") | (F.col("part") > 0))
    alone = parts.where(~F.col("several")).select("conv", "audit", "illegal", "cost", F.sha2(lines, 256).alias("repaired_sha256"))
    rest = parts.where("several").select("conv", "part", "audit", "illegal", "cost", F.size("turns").alias("n"), lines.alias("lines"))
    schema = pa.schema([("conv", pa.string()), ("audit", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk():
            now, audit, illegal, cost, sha, any_ = None, [], 0, 0, hashlib.sha256(), False
            for batch in batches:
                for r in batch.to_pylist():
                    if r["conv"] != now:
                        if now is not None:
                            yield {"conv": now, "audit": "".join(audit), "illegal": illegal, "cost": cost, "repaired_sha256": sha.hexdigest()}, 0
                        now, audit, illegal, cost, sha, any_ = r["conv"], [], 0, 0, hashlib.sha256(), False
                    audit.append(r["audit"])
                    illegal, cost = illegal + r["illegal"], cost + r["cost"]
                    if r["n"]:
                        sha.update(((any_ and "\n" or "") + r["lines"]).encode())
                        any_ = True
            if now is not None:
                yield {"conv": now, "audit": "".join(audit), "illegal": illegal, "cost": cost, "repaired_sha256": sha.hexdigest()}, 0

        yield from batches_of(walk(), schema)

    joined = dealt(rest, ["conv"], ["part"]).mapInArrow(run, "conv string, audit string, illegal bigint, cost bigint, repaired_sha256 string")
    return alone.unionByName(joined)
