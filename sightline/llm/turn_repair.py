"""Operator 13: the cheapest edits that give a conversation a legal order of roles.

A legal conversation is empty or an optional system turn followed by pairs of user
and assistant. ``report`` judges each conversation and hashes its repaired form,
``repaired`` returns the repaired turns themselves.

The edits follow from a backward table of costs over four states (nothing yet, after
system, after user, after assistant). Only vectors at checkpoints are stored: a
conversation is cut in blocks of about the square root of the number of all rows, a
block stands for a small min-plus matrix, and the vectors at block ends come from
these matrices; inside a block, vectors are again kept at every square root of its
length and recomputed while the walk forward emits the edits. Blocks are cut from
rows sorted by range, so one long conversation is worked on by many tasks.

Cases: rows go by turn, those without turn first, equal turns by role and the text's
hash. Equal rows of one turn are adjacent. A null role or text counts as one space, a
null conversation id is a conversation of its own. Empty tables give empty results; other
columns are ignored. What one task must hold of a conversation is one
character and a small number a row, as the audit is one value; texts are streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.plans.shared import reliable

KEEP, REROLE, DELETE, INSERT, UNENDED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or renamed turn leads to, and that turn's role.
ONWARD = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: (state, code of a role's initial) to the state after keeping the turn.
STAYS = {
    (START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT,
}
#: Codes of adjacent initials that are legal: su, ua, au.
FOLLOWS = {(0, 1), (1, 2), (2, 1)}
#: Cost of ending in each state: what is missing is inserted.
END = [0, 2 * INSERT, INSERT, 0]
FAR = 1 << 60
#: Rows of a block at least, however short the table.
BLOCK = 1024
TRUNCATED, LIVE = 4, 8

BLANK = r"^[\x20\x09-\x0D]*\z"
UNFINISHED = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"


# ---- the table of costs -------------------------------------------------------------


def before(costs: list[int], code: int, rows: int) -> list[int]:
    """Costs in front of a run of equal rows from the costs behind it."""
    gone = rows - 1 if code & LIVE else rows
    if gone:  # later copies and blank rows must go
        costs = [c + DELETE * gone for c in costs]
    if not code & LIVE:
        return costs
    extra, initial, out = UNENDED if code & TRUNCATED else 0, code & 3, []
    for state in range(4):
        best = min(costs[state] + DELETE, costs[ONWARD[state]] + REROLE + extra)
        if (state, initial) in STAYS:
            best = min(best, costs[STAYS[state, initial]] + KEEP + extra)
        out.append(best)
    user, assistant = out[USER], out[ASSISTANT]
    out[USER], out[ASSISTANT] = min(user, assistant + INSERT), min(assistant, user + INSERT)
    out[START], out[SYSTEM] = min(out[START], out[USER] + INSERT), min(out[SYSTEM], out[USER] + INSERT)
    return out


def matrix(codes: bytes, rows: list[int]) -> list[int]:
    """Costs from each state in front of a block to each state behind it, by rows."""
    columns = []
    for state in range(4):
        costs = [0 if s == state else FAR for s in range(4)]
        for code, n in zip(reversed(codes), reversed(rows)):
            costs = before(costs, code, n)
        columns.append([min(c, FAR) for c in costs])
    return [columns[to][state] for state in range(4) for to in range(4)]


def through(block: list[int], costs: list[int]) -> list[int]:
    return [min(block[4 * s + t] + costs[t] for t in range(4)) for s in range(4)]


def walk(codes: bytes, rows: list[int], end: list[int], state: int) -> tuple[str, int]:
    """The least of the cheapest edits of a block entered in ``state``, and the state behind it."""
    n = len(codes)
    step = max(1, isqrt(n))
    marks, costs = {n: end}, end
    for i in range(n - 1, -1, -1):
        costs = before(costs, codes[i], rows[i])
        if i % step == 0:
            marks[i] = costs
    edits = []
    for low in range(0, n, step):
        high = min(low + step, n)
        ahead = [marks[high]]
        for i in range(high - 1, low - 1, -1):
            ahead.append(before(ahead[-1], codes[i], rows[i]))
        ahead.reverse()
        for i in range(low, high):
            code, gone = codes[i], rows[i]
            if code & LIVE:
                gone -= 1
                extra, initial = UNENDED if code & TRUNCATED else 0, code & 3
                here, behind = ahead[i - low], [c + DELETE * gone for c in ahead[i - low + 1]]
                while here[state] != behind[state] + DELETE and here[state] == here[ONWARD[state]] + INSERT:
                    edits.append("I")
                    state = ONWARD[state]
                stays = STAYS.get((state, initial))
                if here[state] == behind[state] + DELETE:
                    edits.append("D")
                elif stays is not None and here[state] == behind[stays] + extra:
                    edits.append("K")
                    state = stays
                else:
                    edits.append("R")
                    state = ONWARD[state]
            edits.append("D" * gone)
    return "".join(edits), state


# ---- rows, runs and blocks ----------------------------------------------------------


def turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The four columns under fixed names; ``late`` sorts rows without turn first."""
    space = F.lit(" ")
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).isNotNull().alias("late"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))


def runs(rows: DataFrame) -> DataFrame:
    """Equal rows of one turn with their number, code and whether the first of them is new to the conversation."""
    blank = F.col("text").rlike(BLANK)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    place = ["conv", "late", "turn", "role", "digest"]
    coded = rows.select(*place, F.when(blank, F.lit(None)).otherwise(initial + F.when(F.col("text").rlike(UNFINISHED), TRUNCATED).otherwise(0)).alias("code"), initial.alias("initial"))
    found = coded.groupBy(*place, "code", "initial").agg(F.count("*").alias("n"))
    known = ["conv", "role", "digest"]
    earliest = found.where("code is not null").groupBy(*known).agg(F.bool_and("late").alias("late"), F.min(F.when(F.col("late"), F.col("turn"))).alias("turn"))
    earliest = earliest.select(*known, "late", F.when(F.col("late"), F.col("turn")).otherwise(0).alias("turn"), F.lit(LIVE).alias("new"))
    a, b = found.alias("a"), earliest.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c == "conv" else F.col(f"a.{c}") == F.col(f"b.{c}") for c in place]
    joined = a.join(b, same, "left")
    code = F.coalesce(F.col("a.code") + F.col("b.new"), F.col("a.initial"))
    return joined.select(*[f"a.{c}" for c in place], "a.n", code.alias("code"), F.col("a.code").isNull().alias("blank"))


BLOCK_FIELDS = (
    "part int, no int, codes binary, rows array<bigint>, matrix array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first_initial int, last_initial int, first_turn bigint, last_turn bigint, n_turns bigint"
)


def blocks(found: DataFrame, size: int) -> DataFrame:
    """Runs in order, cut in blocks of at most ``size`` runs of one conversation."""
    order = ["conv", "late", "turn", "role", "digest"]
    kind = T.StructType([T.StructField("conv", found.schema["conv"].dataType), *T.StructType.fromDDL(BLOCK_FIELDS).fields])
    names = kind.fieldNames()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, part = to_arrow_schema(kind), TaskContext.get().partitionId()
        held, done, no, key = [], [], 0, None

        def close() -> None:
            nonlocal held, no
            codes, rows = bytes(r[0] for r in held), [r[1] for r in held]
            initials = [r[0] & 3 for r in held]
            live = [bool(r[0] & LIVE) for r in held]
            seen = [r[3] for r in held if r[3] is not None]
            done.append((
                key, part, no, codes, rows, matrix(codes, rows),
                sum(r[1] for r in held if r[2]), sum(r[1] - new for r, new in zip(held, live) if not r[2]),
                sum(1 for r in held if r[0] & LIVE and r[0] & TRUNCATED),
                sum(n - 1 for n in rows) + sum((x, y) not in FOLLOWS for x, y in zip(initials, initials[1:])),
                initials[0], initials[-1], seen[0] if seen else None, seen[-1] if seen else None, len(set(seen)),
            ))
            held, no = [], no + 1

        def flush() -> pa.RecordBatch:
            nonlocal done
            out = pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], schema)
            done = []
            return out

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "code", "n", "blank", "late", "turn")]
            for conv, code, n, blank, late, turn in zip(*columns):
                if held and (conv != key or len(held) == size):
                    close()
                key = conv
                held.append((code, n, blank, turn if late else None))
            if len(done) >= 1000:
                yield flush()
        if held:
            close()
        if done:
            yield flush()

    laid = found.repartitionByRange(*order).sortWithinPartitions(*order)
    return laid.select("conv", "code", "n", "blank", "late", "turn").mapInArrow(cut, kind)


ENDS_TYPE = "array<struct<part: int, no: int, alone: boolean, last: boolean, costs: array<bigint>>>"


def _ends(listed: pa.Array) -> pa.Array:
    """Costs behind each block of a conversation, from its blocks' matrices."""
    out = []
    for group in listed.to_pylist():
        costs, found = END, []
        for i, b in enumerate(reversed(group)):
            found.append({"part": b["part"], "no": b["no"], "alone": len(group) == 1, "last": i == 0, "costs": costs})
            costs = through(b["matrix"], costs)
        out.append(found)
    kind = pa.struct([("part", pa.int32()), ("no", pa.int32()), ("alone", pa.bool_()), ("last", pa.bool_()), ("costs", pa.list_(pa.int64()))])
    return pa.array(out, pa.list_(kind))


WALKS_TYPE = "struct<edits: array<string>, exits: array<int>>"


def _walks(codes: pa.Array, rows: pa.Array, costs: pa.Array, alone: pa.Array, last: pa.Array) -> pa.Array:
    """Edits of a block and the state behind it, for each state that it can be entered in."""
    out = []
    for c, n, end, one, final in zip(*(x.to_pylist() for x in (codes, rows, costs, alone, last))):
        edits, exits = [], []
        for state in [START] if one else range(4):
            text, state = walk(c, n, end, state)
            if final:
                text += "I" * (END[state] // INSERT)
            edits.append(text)
            exits.append(state)
        out.append({"edits": edits, "exits": exits})
    return pa.array(out, pa.struct([("edits", pa.list_(pa.string())), ("exits", pa.list_(pa.int32()))]))


STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


JOINED_TYPE = "struct<gaps: bigint, blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, cost: bigint, audit: string>"


def _joined(listed: pa.Array) -> pa.Array:
    """One conversation's figures and edits from those of its blocks in order."""
    out = []
    for group in listed.to_pylist():
        edits, state, last = [], START, None
        sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        turns, ends = 0, []
        for b in group:
            edits.append(b["walk"]["edits"][state])
            state = b["walk"]["exits"][state]
            for k in sums:
                sums[k] += b[k]
            if last is not None:
                sums["illegal"] += (last, b["first_initial"]) not in FOLLOWS
            last = b["last_initial"]
            if b["first_turn"] is not None:
                turns += b["n_turns"] - bool(ends and ends[-1] == b["first_turn"])
                ends += [b["first_turn"], b["last_turn"]]
        out.append({
            "gaps": max(ends) - min(ends) + 1 - turns if ends else 0, **sums,
            "cost": through(group[0]["matrix"], group[0]["costs"])[START], "audit": "".join(edits),
        })
    kind = pa.struct([*[(k, pa.int64()) for k in STATS], ("audit", pa.string())])
    return pa.array(out, kind)


def plan(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of conversations that have rows; ``rows`` come from ``turns``."""
    size = max(BLOCK, isqrt(rows.count()))
    cut = reliable(blocks(runs(rows), size))
    found = cut.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "no", "matrix"))).alias("blocks"))
    ends = found.select(F.explode(F.arrow_udf(_ends, ENDS_TYPE)("blocks")).alias("e")).select("e.*")
    walked = cut.join(ends, ["part", "no"]).withColumn("walk", F.arrow_udf(_walks, WALKS_TYPE)("codes", "rows", "costs", "alone", "last"))
    told = ["part", "no", "walk", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "first_turn", "last_turn", "n_turns"]
    # the first block's matrix and end tell the cost of the whole
    listed = walked.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*told, "matrix", "costs"))).alias("blocks"))
    return listed.select("conv", F.arrow_udf(_joined, JOINED_TYPE)("blocks").alias("p")).select("conv", "p.*")


# ---- texts in order -----------------------------------------------------------------


def _ordered(rows: DataFrame, all_ids: DataFrame, planned: DataFrame) -> DataFrame:
    """Plans and texts of each conversation in one stream: its id, its plan, then its rows in order."""
    kind = rows.schema["conv"].dataType
    ids = all_ids.select(F.col(all_ids.columns[0]).cast(kind).alias("conv")).distinct().withColumn("step", F.lit(0))
    plans = planned.withColumn("step", F.lit(1))
    texts = rows.withColumn("step", F.lit(2))
    both = ids.unionByName(plans, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    # salting is no use here: one digest of a conversation needs its rows one after the other
    return both.repartition("conv").sortWithinPartitions("conv", "step", "late", "turn", "role", "digest")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("open", conv, plan) and ("turn", role, text, edit, turn) in order; edits are applied."""
    key, edits, at, state = object(), "", 0, START

    def inserted():
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            state = ONWARD[state]
            at += 1
            yield ("turn", ROLE[state], "", "I", None)

    names = ["conv", "step", "late", "turn", "role", "text", "audit", *STATS]
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
        for conv, step, late, turn, role, text, audit, *stats in zip(*columns):
            if step == 0:
                yield from inserted()
                key, edits, at, state = conv, "", 0, START
                yield ("open", conv, None)
            elif step == 1:
                edits = audit
                yield ("plan", audit, stats)
            else:
                yield from inserted()
                edit, at = edits[at], at + 1
                if edit == "D":
                    yield ("turn", role, text, "D", turn if late else None)
                    continue
                if edit == "R":
                    state = ONWARD[state]
                    role = ROLE[state]
                else:
                    state = STAYS[state, {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)]
                yield ("turn", role, text, edit, turn if late else None)
    yield from inserted()


def report(
    rows: DataFrame, all_ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: its faults, the cost and the letters of its edits, and the SHA-256 of its repaired form.

    ``all_ids`` (first column) names conversations to report on even if they have no
    rows; they get zeros, an empty audit and the hash of nothing.
    """
    known = turns(rows, conv, turn, role, text)
    ordered = _ordered(known, rows.select(conv) if all_ids is None else all_ids.select(conv).unionByName(rows.select(conv)), plan(known))
    fields = [T.StructField(k, T.LongType()) for k in STATS]
    kind = T.StructType([T.StructField(conv, rows.schema[conv].dataType), *fields, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, names = to_arrow_schema(kind), kind.fieldNames()
        done, now, digest, empty = [], None, None, True

        def close() -> None:
            if now is not None:
                done.append(dict(zip(names, [*now, digest.hexdigest()])))

        for event in _told(batches):
            if event[0] == "open":
                close()
                now, digest, empty = [event[1], *[0] * len(STATS), ""], hashlib.sha256(), True
                if len(done) >= 1000:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done = []
            elif event[0] == "plan":
                now[1:] = [*event[2], event[1]]
            elif event[3] != "D":
                digest.update(f"{'' if empty else chr(10)}{event[1]}:{event[2]}".encode())
                empty = False
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return ordered.mapInArrow(judge, kind)


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns of the repaired conversations: (conv, position from 0, role, text, edit K, R or I, turn; null where inserted)."""
    known = turns(rows, conv, turn, role, text)
    ordered = _ordered(known, rows.select(conv), plan(known))
    kind = T.StructType(
        [T.StructField(conv, rows.schema[conv].dataType), T.StructField("position", T.LongType()), T.StructField(role, T.StringType()),
         T.StructField(text, T.StringType()), T.StructField("edit", T.StringType()), T.StructField(turn, T.LongType())]
    )

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, names = to_arrow_schema(kind), kind.fieldNames()
        done, key, position, held = [], None, 0, 0
        for event in _told(batches):
            if event[0] == "open":
                key, position = event[1], 0
            elif event[0] == "turn" and event[3] != "D":
                done.append(dict(zip(names, (key, position, *event[1:]))))
                position, held = position + 1, held + len(event[2])
                if len(done) >= 5000 or held > 1 << 22:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done, held = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return ordered.mapInArrow(tell, kind)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with planted faults, by a checksum of id and turn: a test bed for ``report``."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    said = F.coalesce(F.col(text), space)

    def changed(value: Column, at: int, to: Column) -> Column:
        return F.when(F.col("fault") == at, to).otherwise(value)

    known = rows.select(F.col(conv), F.col(turn), F.coalesce(F.col(role), space).alias(role), said.alias(text), fault.alias("fault")).where("fault <> 0")
    known = known.select(
        conv, turn, changed(F.col(role), 4, F.lit("user")).alias(role),
        changed(changed(F.col(text), 1, F.lit("")), 2, F.regexp_replace(text, "[.!?]", "")).alias(text),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return known.drop("copy")
