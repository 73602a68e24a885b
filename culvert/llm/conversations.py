"""Structure repair of conversations: the cheapest edits that make the roles read ``(s?(ua)+)?``, found by iterative-deepening A*.

Edits of a row in ASCII order of their initials: Delete, Insert (an empty-text row before it), Keep, Rerole. A depth-first
search tries them in that order under a cost bound; the bound rises to the least cost that the last dive met beyond it.
The table of failed states holds for each (row, grammar state) the least budget that could still do, so no state is
searched twice with a budget that has failed. The first accepting path is the cheapest, and of those the ASCII-least.
What role an Insert or a Rerole gives follows from the grammar state, so an audit names one repair.

A conversation of at most ``ROWS`` rows and ``BYTES`` bytes is searched whole, in one task with others. A larger one is
cut into slices of that size by a range sort; each slice is searched for every pair of grammar states at its ends, and the
states at the borders are chosen from those tables, sixteen numbers for each slice. An Insert belongs to the slice of the row
behind it, so a slice's audits are prefix-free, and choosing the ASCII-least slice by slice gives the ASCII-least whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from culvert.llm.common import arrow_map, table
from culvert.session import materialise

ROWS, BYTES = 256, 8 << 20
#: conversations listed in a broadcast; with more large ones than that the list is joined by a shuffle
LISTED = 10_000
BLANKS = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: grammar state behind a kept role initial, and behind an inserted or changed role
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
MADE = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
#: what is inserted at the very end from each state, and its cost
TAIL = ("", "II", "I", "")
NEVER = 1 << 60


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each (role, text): blank, duplicate, truncated or none ("")."""
    seen, out = set(), []
    for role, text in rows:
        own = text.strip(BLANKS)
        out.append("blank" if not own else "duplicate" if (role, text) in seen else "" if own[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def illegal(roles: list[str]) -> int:
    return sum(x[:1] + y[:1] not in ("su", "ua", "au") for x, y in zip(roles, roles[1:], strict=False))


def floors(initials: list[str], found: list[str], goal: int | None) -> list[int]:
    """A lower bound of the cost from each row to the end, whatever the state.

    Blank and duplicate rows cost a Delete, truncated ones at least their point, other roles at least a Rerole; of the rest, each
    two neighbours that can't stand side by side cost an edit, counted for pairs that share no row.
    """
    low = [0] * (len(initials) + 1)
    spared = 0
    behind = None  # initial of the next row that may stay and is in no pair yet
    for at in range(len(initials) - 1, -1, -1):
        gone, own = found[at] in ("blank", "duplicate"), initials[at]
        if goal in (START, SYSTEM):  # all rows go but one system row
            if goal == SYSTEM and own == "s" and not gone:
                spared = 1
            low[at] = DELETE * (len(initials) - at - spared)
        elif gone:
            low[at] = low[at + 1] + DELETE
        elif own not in ("s", "u", "a"):
            low[at], behind = low[at + 1] + REROLE + (found[at] == "truncated"), None
        else:
            apart = behind is not None and own + behind not in ("su", "ua", "au")
            low[at], behind = low[at + 1] + (found[at] == "truncated") + apart * INSERT, None if apart else own
    return low


def cheapest(initials: list[str], found: list[str], entry: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """Cost and audit of the cheapest, then ASCII-least, edits from grammar state ``entry``; None if there are none.

    Without a ``goal`` the whole must be accepted and rows may be inserted at the end; with one, the edits end in that state.
    """
    n = len(initials)
    if goal is not None and goal < USER and entry != goal and not (entry == START and goal == SYSTEM and any(i == "s" and f in ("", "truncated") for i, f in zip(initials, found, strict=True))):
        return None
    low = [x for x in floors(initials, found, goal) for _ in STATES]
    if goal is None:
        low[4 * n :] = [INSERT * len(t) for t in TAIL]
    else:
        low[4 * n :] = [0 if state == goal else NEVER for state in STATES]
    root = entry
    while low[root] < NEVER:
        frames, audit = [[0, entry, low[root], 0, NEVER, 0]], []  # row, state, budget, next edit, least budget that could do, cost of coming here
        while frames:
            frame = frames[-1]
            row, state, left, edit, least, _ = frame
            if row == n and (state == goal if goal is not None else not TAIL[state]):
                return low[root], "".join(audit)
            deeper = None
            while edit < 4:
                edit += 1
                if edit == 1:  # Delete
                    if row == n:
                        continue
                    cost, to, then, name = DELETE, row + 1, state, "D"
                elif edit == 2:  # Insert
                    if row == n and goal is not None:
                        continue
                    cost, to, then, name = INSERT, row, MADE[state], "I"
                elif row == n or found[row] in ("blank", "duplicate"):
                    continue
                elif edit == 3:  # Keep
                    then = KEPT[state].get(initials[row])
                    if then is None:
                        continue
                    cost, to, name = CUT * (found[row] == "truncated"), row + 1, "K"
                else:  # Rerole
                    cost, to, then, name = REROLE + CUT * (found[row] == "truncated"), row + 1, MADE[state], "R"
                need = cost + low[4 * to + then]
                if need <= left:
                    deeper = [to, then, left - cost, 0, NEVER, cost]
                    break
                least = min(least, need)
            frame[3], frame[4] = edit, least
            if deeper:
                frames.append(deeper)
                audit.append(name)
            else:  # failed with this budget: remember what it takes
                low[4 * row + state] = max(low[4 * row + state], least)
                frames.pop()
                if frames:
                    audit.pop()
                    frames[-1][4] = min(frames[-1][4], frame[5] + low[4 * row + state])
    return None


def applied(rows: list[tuple[str, str]], audit: str, state: int = START) -> list[tuple[str, str]]:
    """The rows that an audit leaves."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            state = MADE[state]
            out.append((NAMES[state], ""))
            continue
        role, text = rows[at]
        at += 1
        if edit == "R":
            state = MADE[state]
            out.append((NAMES[state], text))
        elif edit == "K":
            state = KEPT[state][role[:1]]
            out.append((role, text))
    return out


def _lines(rows: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in rows)


def _gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """conv, [(turn, role, text, times)] of sorted batches; times 0 marks a conversation without saying anything of it."""
    conv, own, begun = None, [], False
    for batch in batches:
        for c, *row in zip(*(batch.column(name).to_pylist() for name in ("conv", "turn", "role", "text", "times")), strict=True):
            if begun and c != conv:
                yield conv, own
                own = []
            conv, begun = c, True
            if row[3]:
                own.append(tuple(row))
    if begun:
        yield conv, own


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"


def _batches(kind: pa.DataType, fields: list[tuple[str, pa.DataType]], rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", kind), *fields])
    kept, held = [], 0
    for row in rows:
        kept.append(row)
        held += 200 + sum(len(x) for x in row if isinstance(x, str))
        if held > 4 << 20:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in kept], schema)
            kept, held = [], 0
    if kept:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in kept], schema)


def _whole(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    def each():
        for conv, own in _groups(batches):
            rows = [(role, text) for _, role, text, times in own for _ in range(times)]
            found = faults(rows)
            cost, audit = cheapest([r[:1] for r, _ in rows], found)
            yield (conv, _gaps([t for t, *_ in own]), *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal([r for r, _ in rows]), cost, audit, _lines(applied(rows, audit)))

    counts = [(name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    yield from _batches(kind, [*counts, ("audit", pa.string()), ("repaired", pa.string())], each())


SLICE = "conv {kind}, part long, no long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, audits array<string>, roles array<string>, texts array<string>"


def _slices(batches: Iterator[pa.RecordBatch], kind: pa.DataType, most: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """A row for each run of at most ``most`` rows of a conversation; rows come sorted, equal ones as one with its times."""

    def close(conv, part, no, own):
        rows, found = [(r, t) for r, t, _ in own], [f for *_, f in own]
        initials = [r[:1] for r, _ in rows]
        best = [cheapest(initials, found, p, q) for p in STATES for q in STATES]
        return (conv, part, no, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal([r for r, _ in rows]), initials[0], initials[-1], [b and b[0] for b in best], [b and b[1] for b in best], [r for r, _ in rows], [t for _, t in rows])

    def each():
        conv, begun, no, own, held, part = None, False, 0, [], 0, 0
        for batch in batches:
            names = ("conv", "part", "role", "text", "times", "repeated")
            for c, p, role, text, times, repeated in zip(*(batch.column(name).to_pylist() for name in names), strict=True):
                if begun and c != conv:
                    yield close(conv, part, no, own)
                    no, own, held = no + 1, [], 0
                conv, begun, part = c, True, p
                blank = not text.strip(BLANKS)
                for k in range(times):
                    if len(own) == most or held + len(text) > most_bytes and own:
                        yield close(conv, part, no, own)
                        no, own, held = no + 1, [], 0
                    fault = "blank" if blank else "duplicate" if repeated or k else "" if text.strip(BLANKS)[-1] in ".!?" else "truncated"
                    own.append((role, text, fault))
                    held += len(text)
        if own:
            yield close(conv, part, no, own)

    counts = [(name, pa.int64()) for name in ("part", "no", "blank", "duplicate", "truncated", "illegal")]
    texts = pa.list_(pa.string())
    fields = [*counts, ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", texts), ("roles", texts), ("texts", texts)]
    for row in each():  # a slice is bounded in bytes: a batch of its own
        yield from _batches(kind, fields, iter([row]))


def _borders(pdf):
    """The states at both ends of every slice of a conversation: cost to go from the end, then the ASCII-least way from the start."""
    pdf = pdf.sort_values(["part", "no"])
    tables, ranks = pdf["costs"].tolist(), pdf["ranks"].tolist()
    to_go = [[INSERT * len(t) for t in TAIL]]
    for costs in reversed(tables):
        to_go.append([min(NEVER if costs[4 * p + q] < 0 else costs[4 * p + q] + to_go[-1][q] for q in STATES) for p in STATES])
    to_go.reverse()
    state, entries, exits = START, [], []
    for k, costs in enumerate(tables):
        able = [q for q in STATES if costs[4 * state + q] >= 0 and costs[4 * state + q] + to_go[k + 1][q] == to_go[k][state]]
        entries.append(state)
        state = min(able, key=lambda q: ranks[k][4 * state + q])
        exits.append(state)
    ends = zip(pdf["first"].tolist()[1:], pdf["last"].tolist(), strict=False)
    return pdf[["conv", "part", "no"]].assign(entry=entries, exit=exits, cost=to_go[0][START], final=[False] * (len(exits) - 1) + [True], between=[0, *(int(last + first not in ("su", "ua", "au")) for first, last in ends)])


def _pieces(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """conv, audit, repaired of conversations whose slices come in order."""

    def closed(conv, audits, pieces):
        return conv, "".join(audits), "\n".join(p for p in pieces)

    def each():
        conv, begun, audits, pieces = None, False, [], []
        for batch in batches:
            names = ("conv", "entry", "exit", "final", "audits", "roles", "texts")
            for c, entry, leave, final, own, roles, texts in zip(*(batch.column(name).to_pylist() for name in names), strict=True):
                if begun and c != conv:
                    yield closed(conv, audits, pieces)
                    audits, pieces = [], []
                conv, begun = c, True
                audit = own[4 * entry + leave]
                kept = applied(list(zip(roles, texts, strict=True)), audit, entry)
                if final:
                    kept += applied([], TAIL[leave], leave)
                    audit += TAIL[leave]
                audits.append(audit)
                if kept:
                    pieces.append(_lines(kept))
        if begun:
            yield closed(conv, audits, pieces)

    yield from _batches(kind, [("audit", pa.string()), ("repaired", pa.string())], each())


def _large(rows: DataFrame, kind: str, arrow: pa.DataType, most: int, most_bytes: int) -> DataFrame:
    key = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2")]
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    same = materialise(rows.filter("times > 0").groupBy("conv", "turn", "role", "text").agg(F.sum("times").alias("times")).select("*", *key), "conversation-rows")
    first = same.groupBy("conv", "h1", "h2").agg(F.min(order).alias("o")).select(F.col("conv").alias("c"), F.col("h1").alias("x"), F.col("h2").alias("y"), "o")
    placed = same.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("x")) & (F.col("h2") == F.col("y"))).withColumn("repeated", F.col("o") != order)
    by = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = placed.select("conv", "turn", "role", "text", "times", "repeated").repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id().cast("long"))
    slices = materialise(arrow_map(placed, partial(_slices, kind=arrow, most=most, most_bytes=most_bytes), SLICE.format(kind=kind)), "conversation-slices")
    # of the audits that leave a state, the order in ASCII; -1 for no way
    ranks = F.transform("audits", lambda a: F.size(F.filter("audits", lambda b: b < a)).cast("long"))
    small = slices.select("conv", "part", "no", "first", "last", F.transform("costs", lambda c: F.coalesce(c, F.lit(-1))).alias("costs"), F.transform(ranks, lambda r: F.coalesce(r, F.lit(-1))).alias("ranks"))
    chosen = materialise(small.groupBy("conv").applyInPandas(_borders, f"conv {kind}, part long, no long, entry long, exit long, cost long, final boolean, between long"), "conversation-borders")
    told = chosen.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("no").alias("k"), "entry", "exit", "final")
    whole = slices.join(told, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("no") == F.col("k")))
    ordered = whole.select("conv", "part", "no", "entry", "exit", "final", "audits", "roles", "texts").repartition("conv").sortWithinPartitions("conv", "part", "no").drop("part", "no")
    texts = arrow_map(ordered, partial(_pieces, kind=arrow), f"conv {kind}, audit string, repaired string")
    counts = slices.groupBy("conv").agg(*(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal")))
    across = chosen.groupBy("conv").agg(F.max("cost").alias("cost"), F.sum("between").alias("between"))
    gaps = same.select("conv", "turn").distinct().groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    out = texts
    for n, side in enumerate((counts, across, gaps)):
        out = out.join(side.withColumnRenamed("conv", f"c{n}"), F.col("conv").eqNullSafe(F.col(f"c{n}")))
    return out.select("conv", "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("between")).alias("illegal"), "cost", "audit", "repaired")


def repair(rows: DataFrame, most: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired of each conversation of ``rows``.

    ``rows`` has conv (any type), turn long, role and text strings, and times: how often the row stands there, 0 only to
    name its conversation. Rows follow each other by turn (nulls first), then role and text; ``repaired`` is the
    ``role:text`` lines left. A null role or text is one space, a null conversation is one of its own, and one without rows
    gets zeros and empty strings. A role whose initial is not s, u or a (an empty one, too) can't be kept. An empty table
    gives an empty result; further columns are ignored.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    arrow = to_arrow_type(rows.schema["conv"].dataType)
    rows = rows.select("conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("times").cast("long").alias("times"))
    held = rows.groupBy("conv").agg(F.sum("times").alias("n"), F.sum((F.octet_length("text") + 16) * F.col("times")).alias("b"))
    large = materialise(held.filter((F.col("n") > most) | (F.col("b") > most_bytes)).select(F.col("conv").alias("big")), "large-conversations")
    found = large.count()
    listed = F.broadcast(large) if found <= LISTED else large
    is_large = F.col("conv").eqNullSafe(F.col("big"))
    small = rows.join(listed, is_large, "left_anti") if found else rows
    by = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    whole = arrow_map(small.repartition("conv").sortWithinPartitions(*by), partial(_whole, kind=arrow), f"conv {kind}, {SUMMARY}")
    return whole.unionByName(_large(rows.join(listed, is_large, "left_semi"), kind, arrow, most, most_bytes)) if found else whole


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, times for ``repair``: rows spoilt by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row (times 0 stays), 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats it, 4 makes its role user.
    """
    named: Column = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind, text = F.crc32(named.cast("binary")) % 20, F.coalesce("text", F.lit(" "))
    return conversations.select(
        F.col("conv_id").alias("conv"),
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    mended = repair(damaged(table(spark, sf_dir, "conversations")))
    return mended.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2("repaired", 256).alias("repaired_sha256"))
