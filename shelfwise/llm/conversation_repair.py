"""Repair of conversations by the cheapest edits, found by square-root checkpointed dynamic programming.

Turns are kept, given another role, deleted or inserted, so that the initials of the roles are ``(s?(ua)+)?``. Four states
say what came last; the cost from a turn to the end is a vector over states. These vectors are stored only at
checkpoints: the ends of pieces of a conversation (at most ``PIECE`` turns in a row), as a table, and within a piece every
square root of its turns. The turns between are computed again while walking forward, which emits the ASCII-least edit that
is tight. Pieces of a conversation are walked side by side, for every state that they may begin in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import reliable, unused

DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 2, 5, 1, 5
#: Turns of a piece, as a power of two.
PIECE_BITS = 12
BLANK_CLASS = r"[^\x20\x09-\x0D]"

# states: nothing yet; after the system's turn; after the user's; after the assistant's
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: The user's turn may follow in all states but its own; the assistant's only there.
_SPOKEN = (USER, USER, ASSISTANT, USER)
_AT_END = (0, inf, inf, 0)

# A turn as one letter: the initial of its role (o: another one), in upper case if truncated; x: to be deleted.
_GONE = "x"


def _kept(letter: str, state: int) -> int | None:
    """The state after a turn that is kept, None where it may not stand."""
    role = letter.lower()
    if role == "s":
        return SYSTEM if state == START else None
    return _SPOKEN[state] if role == ("a" if state == USER else "u") else None


def _steps(letter: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of the edits that use up a turn, by their letter."""
    steps = [(DELETE, DELETE_COST, state)]
    if letter != _GONE:
        extra = TRUNCATED_COST if letter.isupper() else 0
        after = _kept(letter, state)
        if after is not None:
            steps.append((KEEP, extra, after))
        steps.append((REROLE, REROLE_COST + extra, _SPOKEN[state]))
    return steps


_STEPS = {letter: [_steps(letter, state) for state in range(STATES)] for letter in "suaoSUAOx"}


def _inserted(costs: list[float]) -> list[float]:
    """The costs when turns may also be inserted: two at most, as a third would lead back to a state."""
    for _ in range(2):
        costs = [min(c, INSERT_COST + costs[_SPOKEN[state]]) for state, c in enumerate(costs)]
    return costs


def _before(letter: str, costs: list[float]) -> list[float]:
    """The costs from before a turn, given those from behind it."""
    return _inserted([min(cost + costs[after] for _, cost, after in steps) for steps in _STEPS[letter]])


def costs_of(letters: str, behind: list[float]) -> list[float]:
    """The costs from the first of some turns, given those from behind the last."""
    for letter in reversed(letters):
        behind = _before(letter, behind)
    return behind


def walk(letters: str, behind: list[float], starts: tuple[int, ...]) -> dict[int, tuple[str, int]]:
    """From each state to begin in, the ASCII-least tight edits of some turns and the state behind them.

    Insertions before a turn belong to it; those behind the last turn belong to what follows.
    """
    block = max(1, isqrt(len(letters)))
    ends = range(len(letters), 0, -block)
    checkpoints = [behind]
    for end in ends:
        checkpoints.append(costs_of(letters[max(0, end - block) : end], checkpoints[-1]))
    paths = {start: ([], start) for start in starts if checkpoints[-1][start] < inf}
    for end, costs in reversed(list(zip(ends, checkpoints))):
        part = letters[max(0, end - block) : end]
        vectors = [costs]
        for letter in reversed(part):
            vectors.append(_before(letter, vectors[-1]))
        for i, letter in enumerate(part):
            here, following = vectors[len(part) - i], vectors[len(part) - i - 1]
            paths = {start: (edits, _tight(letter, state, here, following, edits)) for start, (edits, state) in paths.items()}
    return {start: ("".join(edits), state) for start, (edits, state) in paths.items()}


def _tight(letter: str, state: int, here: list[float], following: list[float], edits: list[str]) -> int:
    """Append the tight edits up to and including that of a turn; the state behind it."""
    while True:
        options = [(edit, after, False) for edit, cost, after in _STEPS[letter][state] if cost + following[after] == here[state]]
        if INSERT_COST + here[_SPOKEN[state]] == here[state]:
            options.append((INSERT, _SPOKEN[state], True))
        edit, state, again = min(options)
        edits.append(edit)
        if not again:
            return state


def closing(state: int) -> tuple[str, float]:
    """The edits behind the last turn of a conversation, and their cost."""
    n = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]
    return INSERT * n, INSERT_COST * n


_END = _inserted(list(_AT_END))


def piece_costs(letters: str) -> list[list[float]]:
    """[state behind][state before]: the costs of a piece from state to state."""
    return [costs_of(letters, [0 if s == behind else inf for s in range(STATES)]) for behind in range(STATES)]


def illegal_pairs(initials: str) -> int:
    """Neighbouring turns whose roles do not follow each other."""
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:])))


def actions(letters: str, edits: str, state: int) -> Iterator[tuple[str, int, str | None]]:
    """(edit, number of the turn, new role) of the edits that leave a turn; a turn that is kept has no new role."""
    turn = 0
    for edit in edits:
        if edit == KEEP:
            state = _kept(letters[turn], state)
            yield edit, turn, None
        elif edit in (INSERT, REROLE):
            state = _SPOKEN[state]
            yield edit, turn, "assistant" if state == ASSISTANT else "user"
        turn += edit != INSERT


# --- conversations as rows


def _by_row(frame: DataFrame, schema: str, each: Callable[[dict], dict]) -> DataFrame:
    """The columns of ``frame`` and those of ``schema``, made of each row by a function."""
    fields = frame.sparkSession.createDataFrame([], schema).schema.fields

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [each(row) for row in batch.to_pylist()]
            new = [pa.array([m[f.name] for m in made], _ARROW[f.dataType.simpleString()]) for f in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(f.name for f in fields)])

    return frame.mapInArrow(step, _schema(frame, fields))


def _schema(frame: DataFrame, fields: list) -> T.StructType:
    return T.StructType([*frame.schema.fields, *fields])


_VECTOR, _ACTIONS = "array<double>", "array<struct<edit:string,turn:bigint,role:string>>"
_ARROW = {
    "string": pa.string(), "bigint": pa.int64(), _VECTOR: pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
    "array<bigint>": pa.list_(pa.int64()),
    _ACTIONS: pa.list_(pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string())])),
}


def _in_order(frame: DataFrame, *order) -> DataFrame:
    """The rows of a conversation one after the other in one partition, to be read as a stream."""
    return frame.repartition("conversation").sortWithinPartitions("conversation", *order)


class _Carry:
    """What a stream of rows carries from one row of a conversation to the next."""

    def __init__(self):
        self.conversation, self.begun, self.value = None, False, None

    def begins(self, row: dict) -> bool:
        """Whether a row is the first of its conversation."""
        new = not self.begun or row["conversation"] != self.conversation
        self.conversation, self.begun = row["conversation"], True
        return new


def _behind(pieces: DataFrame) -> DataFrame:
    """Pieces with the costs from behind them, and whether they are their conversation's last."""
    carry = _Carry()

    def each(row: dict) -> dict:
        last = carry.begins(row)
        behind = _END if last else carry.value
        table = row["costs"]
        carry.value = [min(table[b * STATES + s] + behind[b] for b in range(STATES)) for s in range(STATES)]
        return {"behind": behind, "last": int(last), "cost": int(carry.value[START])}

    return _by_row(_in_order(pieces, F.desc("piece")), f"behind {_VECTOR}, last long, cost long", each)


def _walked(pieces: DataFrame) -> DataFrame:
    """Pieces with the edits and the state behind them, for each state that they may begin in."""

    def each(row: dict) -> dict:
        paths = walk(row["letters"], row["behind"], tuple(range(STATES)))
        return {"paths": [paths[s][0] for s in range(STATES)], "after": [paths[s][1] for s in range(STATES)]}

    return _by_row(pieces.repartition("conversation", "piece"), "paths array<string>, after array<bigint>", each)


def _chosen(pieces: DataFrame) -> DataFrame:
    """Pieces with their edits and the turns that these leave."""
    carry = _Carry()

    def each(row: dict) -> dict:
        first = carry.begins(row)
        state, before = (START, "") if first else carry.value
        edits, after = row["paths"][state], row["after"][state]
        if row["last"]:
            edits += closing(after)[0]
        carry.value = after, row["initials"][-1]
        left = [{"edit": e, "turn": t, "role": r} for e, t, r in actions(row["letters"], edits, state)]
        return {"edits": edits, "left": left, "first": int(first), "illegal": illegal_pairs(before + row["initials"])}

    return _by_row(_in_order(pieces, "piece"), f"edits string, left {_ACTIONS}, first long, illegal long", each)


def repair(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The repaired turns, and a report with a row per conversation.

    Turns (conversation, piece, position, edit, turn, role, text), in order of piece and position: those kept, those with
    another role, and inserted ones without turn number and text. Report (conversation, gaps, blank, duplicate,
    truncated, illegal, cost, audit): turn numbers that are missing between the least and the greatest; turns by their first fault;
    neighbours whose roles do not follow each other; cost and initials of the edits (Delete, Insert, Keep, Rerole).

    A null text or role is one space. Turns are ordered by number (null first), then role and text; repeated rows are
    duplicates of the first. Equality of texts is that of their SHA-256. A role counts by its first letter; one
    other than s, u and a cannot be kept. Null is a conversation like any other; an empty table gives empty results.

    Turns are dealt by ranges, so that a conversation with a third of all rows is spread; pieces of it are walked
    side by side, and only cost vectors and states pass through one task, as a stream.
    """
    space = F.lit(" ")
    rows = conversations.select(
        F.col(f"`{conv_id}`").alias("conversation"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), space).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), space).alias("text"),
    )
    # equal rows may go to several ranges; the text itself is no key, as the driver samples the keys
    order = ["conversation", "turn", "role", F.substring("text", 1, 64), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order, F.monotonically_increasing_id() % 1024).sortWithinPartitions(*order)
    placed = reliable(placed.withColumn("place", F.monotonically_increasing_id()))
    return _repaired(placed)


def _repaired(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    content = F.sha2("text", 256).alias("content")
    firsts = placed.select("conversation", "role", content, "place").groupBy("conversation", "role", "content").agg(F.min("place").alias("place"))
    blank = ~F.col("text").rlike(BLANK_CLASS)
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    narrow = placed.select(
        "conversation", "place", blank.alias("blank"), known.alias("initial"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open")
    ).join(firsts.select("place", F.lit(True).alias("is_first")), "place", "left")
    duplicate = ~F.col("blank") & F.col("is_first").isNull()
    truncated = ~F.col("blank") & F.col("is_first").isNotNull() & F.col("open")
    letter = F.when(F.col("blank") | duplicate, _GONE).when(truncated, F.upper("initial")).otherwise(F.col("initial"))
    in_order = F.sort_array(F.collect_list(F.struct("place", letter.alias("letter"), "initial")))
    spelt = lambda field: F.array_join(F.transform("turns", lambda t: t[field]), "").alias(field + "s")
    count = lambda fault, name: F.sum(fault.cast("long")).alias(name)
    pieces = narrow.groupBy("conversation", F.shiftright("place", PIECE_BITS).alias("piece")).agg(
        in_order.alias("turns"), count(F.col("blank"), "blank"), count(duplicate, "duplicate"), count(truncated, "truncated")
    )
    pieces = pieces.select("conversation", "piece", F.col("turns")[0]["place"].alias("place"), spelt("letter"), spelt("initial"), "blank", "duplicate", "truncated")
    pieces = _by_row(pieces, f"costs {_VECTOR}", lambda row: {"costs": [c for vector in piece_costs(row["letters"]) for c in vector]})
    pieces = reliable(_chosen(_walked(_behind(pieces).drop("costs"))).drop("paths", "after", "behind"))

    left = pieces.select("conversation", "piece", "place", F.posexplode("left").alias("position", "action")).select(
        "conversation", "piece", "position", F.col("action.edit").alias("edit"), F.col("action.role").alias("new_role"),
        F.when(F.col("action.edit") != INSERT, F.col("place") + F.col("action.turn")).alias("place"),
    )
    turns = left.join(placed.select("place", "turn", "role", "text"), "place", "left").select(
        "conversation", "piece", "position", "edit", "turn", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "edits"))), lambda p: p["edits"]), "").alias("audit")
    edits = pieces.groupBy("conversation").agg(*sums, F.sum(F.when(F.col("first") == 1, F.col("cost"))).alias("cost"), audit)
    span = F.coalesce(F.try_subtract(F.max("turn"), F.min("turn")) + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps")
    gaps = placed.groupBy("conversation").agg(span)
    report = gaps.join(edits.withColumnRenamed("conversation", "same"), F.col("conversation").eqNullSafe(F.col("same"))).drop("same")
    return turns, report.select("conversation", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def digests(turns: DataFrame) -> DataFrame:
    """(conversation, sha256) of the turns' ``role:text`` in order, joined by line feeds.

    A digest takes its bytes one after the other, so a conversation's turns are read by one task, as a stream.
    """
    lines = turns.select("conversation", "piece", "position", F.concat("role", F.lit(":"), "text").alias("line"))
    schema = T.StructType([turns.schema["conversation"], T.StructField("sha256", T.StringType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, kind = _Carry(), None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for conversation, line in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                before = carry.conversation
                if carry.begins({"conversation": conversation}):
                    if carry.value is not None:
                        done.append((before, carry.value.hexdigest()))
                    carry.value = hashlib.sha256(line.encode())
                else:
                    carry.value.update(b"\n" + line.encode())
            yield _pairs(done, kind)
        if kind is not None and carry.value is not None:
            yield _pairs([(carry.conversation, carry.value.hexdigest())], kind)

    return _in_order(lines, "piece", "position").mapInArrow(step, schema)


def _pairs(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], kind), pa.array([d for _, d in rows], pa.string())], names=["conversation", "sha256"])


def damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with planted faults, by the checksum of ``conv_id:turn`` modulo 20 (nulls are one space).

    0: dropped; 1: emptied; 2: without its sentence ends; 3: there twice; 4: the user's. Repeated rows fare alike.
    """
    own = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    m = unused(conversations, "m")
    marked = conversations.withColumn(m, F.crc32(F.concat(own(conv_id), F.lit(":"), own(turn)).cast("binary")) % 20).filter(F.col(m) != 0)
    n = F.col(m)
    new_text = F.when(n == 1, "").when(n == 2, F.regexp_replace(own(text), "[.!?]", "")).otherwise(own(text))
    new_role = F.when(n == 4, "user").otherwise(own(role))
    times = unused(marked, "times")
    twice = marked.withColumns({text: new_text, role: new_role}).withColumn(times, F.explode(F.array_repeat(F.lit(1), F.when(n == 3, 2).otherwise(1))))
    return twice.select(*(F.col(f"`{c}`") for c in conversations.columns))
