"""Repair of conversations against a search of all edits, row by row."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

from marketops.llm import turn_repair
from marketops.llm.queries import QUERIES, damaged, read

sys.setrecursionlimit(10_000)
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def harmed(rows):
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        yield from [(conv, turn, role, text)] * (2 if k == 3 else 1)


def searched(rows):
    """What the contract says of one conversation's rows, found by trying every edit."""
    rows = sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserts):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, ""))
        if inserts < 3:
            cost, audit = best(i, NEXT[state], inserts + 1)
            found.append((cost + 5, "I" + audit))
        if i < len(rows):
            cost, audit = best(i + 1, state, 0)
            found.append((cost + 2, "D" + audit))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                r = rows[i][2][:1]
                if (r in ("s", "u") and state == "") or (state and r == NEXT[state]):
                    cost, audit = best(i + 1, r, 0)
                    found.append((cost + extra, "K" + audit))
                cost, audit = best(i + 1, NEXT[state], 0)
                found.append((cost + 1 + extra, "R" + audit))
        return min(found, default=(10**9, ""))

    cost, audit = best(0, "", 0)
    lines, state, i = [], "", 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        state = rows[i][2][:1] if edit == "K" else NEXT[state]
        lines.append({"u": "user", "a": "assistant"}.get(state) + ":" if edit == "I" else (rows[i][2] if edit == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + rows[i][3])
        i += edit != "I"
    turns = {r[1] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum((a[2][:1], b[2][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def expected(rows):
    rows = list(rows)
    return {conv: searched([r for r in harmed(rows) if r[0] == conv]) for conv in {r[0] for r in rows}}


def test_query_agrees_with_a_search(spark, sf):
    rows = [tuple(r) for r in read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_turn_repair"](spark, sf).collect()}
    assert found == expected(rows)


def awkward_rows():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", None, "", "User", "u", "assistant"]
    texts = ["Yes.", "No?", "so", None, "", " \t\n", "Long! " * 50 + "end.", "ünd!", "Yes.", "a.\x85", "x.\n\n"]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in [*range(40), None, -3] for _ in range(rng.randint(1, 14))]
    return rows + rows[:25] + [(77, i, "user" if i % 3 else "assistant", f"Turn {i % 40}" + "." * (i % 5 > 0)) for i in range(300)] + [(78, 1, "user", "Same.")] * 200


def test_awkward_conversations_in_one_or_many_parts(spark, tmp_path):
    rows = awkward_rows()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, part int, conv string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    want = expected(rows)
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_turn_repair"](spark, str(tmp_path)).collect()}
    assert found == want
    for most_rows, most_bytes in ((7, 1000), (1, 1)):
        bad = damaged(frame)
        got = turn_repair.digests(turn_repair.repair(bad, most_rows, most_bytes)).collect()
        key = lambda c: "" if c is None else f"={c}"
        assert {r.conv: (r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got} == {key(c): v[4:] for c, v in want.items() if any(x[0] == c for x in harmed(rows))}


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op13_turn_repair"](spark, str(tmp_path)).collect() == []


def test_powers_equal_steps():
    powers = turn_repair.Powers()
    for symbol in ("X", "s", "u!", "a", "?"):
        v = turn_repair.END
        for n in range(1, 40):
            v = turn_repair.applied(turn_repair.transition(symbol), v)
            assert powers.back(symbol, n, turn_repair.END) == v == turn_repair.applied(turn_repair.whole(powers, [[symbol, n]]), turn_repair.END)
