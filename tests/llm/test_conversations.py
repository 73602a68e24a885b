"""Conversation repair against a plain shortest-path version over all audits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from culvert.llm import conversations as C
from culvert.llm.catalog import QUERIES

BLANK = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, conv string, times string, part string, audit string"


def damage(rows):
    """(conv, turn, role, text) after damage, in the order of the rows."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired of (turn, role, text) rows in order."""
    seen, found = set(), []
    for _, role, text in rows:
        said = BLANK.findall(text)
        found.append("b" if not said else "d" if (role, text) in seen else "" if said[-1] in ".!?" else "t")
        seen.add((role, text))
    initials = [role[:1] or "?" for _, role, _ in rows]
    wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))

    @lru_cache(None)
    def best(at, text, inserted):
        """(cost, audit, kept initials) from row ``at``; text: what of the kept initials matters."""
        ways = [(0, "", "")] if at == len(rows) and GRAMMAR.fullmatch(text) else []
        def go(cost, edit, initial, to, n):
            after = (text + initial)[-3:] if not (text + initial).startswith("s") else text + initial
            after = "ua" if after.endswith("ua") and len(after) > 2 else "uau" if after.endswith("uau") else after
            if re.fullmatch(r"s?(ua)*u?", after) and (rest := best(to, after, n)):
                ways.append((cost + rest[0], edit + rest[1], initial + rest[2]))
        if inserted < 4:
            for made in "ua":
                go(2, "I", made, at, inserted + 1)
        if at < len(rows):
            go(3, "D", "", at + 1, 0)
            if found[at] not in ("b", "d"):
                go(found[at] == "t", "K", initials[at], at + 1, 0)
                for made in "ua":
                    go(2 + (found[at] == "t"), "R", made, at + 1, 0)
        return min(ways, default=None)

    cost, audit, kept = best(0, "", 0)
    assert GRAMMAR.fullmatch(kept)
    lines, row, k = [], 0, 0
    for edit in audit:
        name = {"u": "user", "a": "assistant"}
        if edit != "D":
            lines.append(f"{rows[row][1] if edit == 'K' else name[kept[k]]}:{'' if edit == 'I' else rows[row][2]}")
            k += 1
        row += edit != "I"
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, found.count("b"), found.count("d"), found.count("t"), wrong, int(cost), audit, "\n".join(lines))


def wanted(rows):
    by = {}
    for row in rows:
        by.setdefault(row[0], [])
    for conv, turn, role, text in damage(rows):
        by[conv].append((turn, role, text))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return {conv: plain(own) for conv, own in by.items()}


def random_rows(rng, convs, most):
    out = []
    for conv in convs:
        for _ in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"] if rng.random() < 0.3 else ["user", "assistant"])
            out.append((conv, rng.choice([None, *range(12)]), role, rng.choice([None, "", " \n", "Yes.", "No", "Why?", "Well, then!  ", "x" * 50])))
    return out


def rows_of(df):
    return {r["conv"]: tuple(r)[1:] for r in df.collect()}


def test_repair_equals_shortest_path(spark):
    rng = random.Random(3)
    rows = random_rows(rng, [None, *range(120)], 14)
    want = wanted(rows)
    docs = spark.createDataFrame([(*r, "c", "t", "p", "a") for r in rows], SCHEMA).repartition(5)
    assert rows_of(C.repair(C.damaged(docs))) == want
    for most in (1, 2, 5):  # conversations over the bound are cut into slices
        assert rows_of(C.repair(C.damaged(docs), most)) == want, most
    assert rows_of(C.repair(C.damaged(docs), 1000, 60)) == want


def test_repair_of_one_very_large_conversation(spark):
    rng = random.Random(4)
    rows = [(1, k // 2, rng.choice(["user", "assistant"]), rng.choice(["A.", "B", f"{k}."])) for k in range(900)]
    own = sorted(((t, r, x) for _, t, r, x in damage(rows)), key=lambda r: r)
    cost, audit = C.cheapest([r[:1] for _, r, _ in own], found := C.faults([r[1:] for r in own]))
    got = rows_of(C.repair(C.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))[1]
    assert got[5:7] == (cost, audit) and got[1:4] == tuple(found.count(x) for x in ("blank", "duplicate", "truncated"))


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.repair(C.damaged(none)).count() == 0
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = rows_of(C.repair(C.damaged(spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string"))))
    assert got == {dropped: (0, 0, 0, 0, 0, 0, "", "")}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_plain_version(spark, sf):
    path = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, path).collect()}
    assert got == {c: (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest()) for c, w in wanted(rows).items()}
