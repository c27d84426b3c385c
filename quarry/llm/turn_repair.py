"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, write_stage

#: Costs of the edits; a truncated turn that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK, DUPLICATE, CUT_OFF = 1, 2, 3
OTHER, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
#: Grammar states of (s?(ua)+)?: nothing yet, after s, after u, after a. At 0 and 3 a conversation may end.
START, AFTER_S, AFTER_U, AFTER_A = 0, 1, 2, 3
#: The state after a role that is inserted or given, and after a role that is kept (if it may stand there).
GIVEN = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
KEPT = {(START, SYSTEM): AFTER_S, (START, USER): AFTER_U, (AFTER_S, USER): AFTER_U, (AFTER_U, ASSISTANT): AFTER_A, (AFTER_A, USER): AFTER_U}
#: A word holds 16 cost layers of one bit for each state: the costs of two states never lie more than 10 apart (two
#: insertions and a deletion), and one turn adds at most 4 to the least, so that no cheapest way leaves the word.
LAYERS, STATES, WORD = 16, 4, (1 << 64) - 1
_LOWEST = 0x1111111111111111
#: Layer words are kept for every so many turns, and made again between them when the edits are read off.
STRIDE = 4096


def _moved(word: int, source: int, target: int, cost: int) -> int:
    """The layers of state `source` as those of `target`, `cost` layers higher."""
    return ((word >> source & _LOWEST) << target << STATES * cost) & WORD


def _inserted(word: int) -> int:
    """With insertions before what follows: two in a row reach every state, more only come back."""
    for _ in range(2):
        for state in (AFTER_U, START, AFTER_S, AFTER_A):
            word |= _moved(word, GIVEN[state], state, INSERT)
    return word


END = _inserted(1 << START | 1 << AFTER_A)


def layers_before(word: int, role: int, fault: int) -> tuple[int, int]:
    """From the layers after a turn, those before it, and how many empty layers fell away below.

    A state's bit is set in layer k where the turns from here on can be put right at cost base + k. All
    layers of all states take a turn's edits in a few shifts."""
    out = (word << STATES * DELETE) & WORD
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT_OFF else 0
        for state, follows in enumerate(GIVEN):
            out |= _moved(word, follows, state, REROLE + more)
            if (state, role) in KEPT:
                out |= _moved(word, KEPT[state, role], state, more)
    out, empty = _inserted(out), 0
    while not out & 15:
        out >>= STATES
        empty += 1
    return out, empty


def _steps() -> dict[tuple[int, int], dict]:
    """Per (role, fault), what each word met gives; words recur, so that most turns are one lookup."""
    return {(role, fault): {} for role in range(4) for fault in range(4)}


def repair(turns: bytes, steps: dict[tuple[int, int], dict] | None = None) -> tuple[int, str]:
    """Least cost and edits of a conversation, one byte role * 4 + fault for each turn.

    The layers go from the end to the beginning; the first layer that has the beginning's state is the
    cost. From there each letter of D, I, K, R in turn is tried, and the first whose bit is set in the layer
    that its cost leaves is the next edit: so the edits are the least in ASCII order among the
    cheapest. Time is linear in the turns, memory a byte a turn, a word for each STRIDE, and the edits."""
    steps = steps if steps is not None else _steps()

    def back(word: int, low: int, high: int) -> Iterator[tuple[int, int]]:
        for i in range(high - 1, low - 1, -1):
            known = steps[turns[i] >> 2, turns[i] & 3]
            if word not in known:
                if len(known) > 100_000:
                    known.clear()
                known[word] = layers_before(word, turns[i] >> 2, turns[i] & 3)
            word, empty = known[word]
            yield word, empty

    n, word, base = len(turns), END, 0
    blocks = list(range(0, n, STRIDE))
    after = {}
    for low in reversed(blocks):
        after[low] = (word, base)
        for word, empty in back(word, low, min(low + STRIDE, n)):
            base += empty
    cost = base + next(k for k in range(LAYERS) if word >> STATES * k & 1)

    edits, state, left = bytearray(), START, cost

    def finishes(at: tuple[int, int], state: int, left: int) -> bool:
        word, base = at
        return 0 <= left - base < LAYERS and bool(word >> STATES * (left - base) + state & 1)

    here = (word, base)
    for low in blocks:
        high = min(low + STRIDE, n)
        words, bases = array("Q", [0] * (high - low + 1)), array("q", [0] * (high - low + 1))
        words[-1], bases[-1] = after[low]
        for i, (word, empty) in zip(range(high - low - 1, -1, -1), back(after[low][0], low, high), strict=True):
            words[i], bases[i] = word, bases[i + 1] + empty
        for i in range(low, high):
            here, there = (words[i - low], bases[i - low]), (words[i - low + 1], bases[i - low + 1])
            role, fault = turns[i] >> 2, turns[i] & 3
            more = TRUNCATED if fault == CUT_OFF else 0
            while True:
                if finishes(there, state, left - DELETE):
                    edits += b"D"
                    left -= DELETE
                elif finishes(here, GIVEN[state], left - INSERT):
                    edits += b"I"
                    state, left = GIVEN[state], left - INSERT
                    continue
                elif (state, role) in KEPT and finishes(there, KEPT[state, role], left - more):
                    edits += b"K"
                    state, left = KEPT[state, role], left - more
                else:
                    edits += b"R"
                    state, left = GIVEN[state], left - REROLE - more
                break
    while left:
        edits += b"I"
        state, left = GIVEN[state], left - INSERT
    return cost, edits.decode()


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with planted faults: by crc32 of `conv_id:turn` modulo 20 a
    row is dropped (0; it stays here as a row with `dropped`, so that its conversation is not forgotten), loses its text
    (1) or its .!? (2), comes twice (3) or is the user's (4). Nulls read as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), draw.alias("draw"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("draw") == 0).alias("dropped"))


def numbered(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text, dropped) with place, their number within the conversation (by
    turn, nulls first; rows of one turn by role and text), and code: role * 4 + fault, or -1 for dropped rows.
    Of a row's faults the first of blank, duplicate (role and text came before) and truncated counts."""
    visible = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    own = Window.partitionBy("conv_id").orderBy(F.asc("dropped"), F.asc_nulls_first("turn"), "role", "text")
    again = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("place")) > 1
    fault = F.when(visible == "", BLANK).when(again, DUPLICATE).when(~F.substring(visible, -1, 1).isin(".", "!", "?"), CUT_OFF).otherwise(0)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    rows = turns.withColumn("place", F.row_number().over(own))
    return rows.withColumn("code", F.when(F.col("dropped"), -1).otherwise(role * 4 + fault).cast("int"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _out(names: list[str], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, columns, strict=True)], names=names)


def _repairs(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conversations one after another: (conv_id, turn, code) in order of place to their counts and
        edits. Held is a byte a turn of the present conversation."""
        steps, done, now = _steps(), [], None

        def finished() -> None:
            conv_id, codes, low, high, distinct, _ = now
            pairs = [(x >> 2, y >> 2) for x, y in zip(codes, codes[1:], strict=False)]
            illegal = sum(p not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)) for p in pairs)
            faults = [sum(c & 3 == f for c in codes) for f in (BLANK, DUPLICATE, CUT_OFF)]
            cost, edits = repair(bytes(codes), steps)
            done.append((conv_id, high - low + 1 - distinct if distinct else 0, *faults, illegal, cost, edits))

        for conv_id, turn, code in _streamed(batches):
            if now is None or now[0] != conv_id:
                if now is not None:
                    finished()
                now = [conv_id, bytearray(), None, None, 0, object()]
            if code >= 0:
                now[1].append(code)
                if turn is not None:
                    if turn != now[5]:
                        now[4] += 1
                    now[2], now[3], now[5] = turn if now[2] is None else now[2], turn, turn
            if len(done) >= 2000:
                yield _out(schema.names, done, schema)
                done.clear()
        if now is not None:
            finished()
        yield _out(schema.names, done, schema)

    return run


ROLE_OF = {AFTER_U: "user", AFTER_A: "assistant"}


class Edits:
    """The edits of one conversation, applied to its turns as they come by."""

    def __init__(self, edits: str):
        self.edits, self.at, self.state = edits, 0, START

    def given(self) -> str:
        self.state = GIVEN[self.state]
        return ROLE_OF[self.state]

    def inserted(self) -> Iterator[tuple[str, str]]:
        """The turns to insert before the next one."""
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            yield self.given(), ""

    def applied(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "R":
            yield self.given(), text
        elif edit == "K":
            self.state = KEPT[self.state, {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]]
            yield role, text


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Turns in order, each conversation headed by a row of place 0 whose text is its edits, to (conv_id,
    role, text) of the repaired turns, after (conv_id, None, None) for the conversation."""
    conv_id, edits = None, None
    for of, place, role, text in _streamed(batches):
        if place == 0:
            if edits is not None:
                yield from ((conv_id, *x) for x in edits.inserted())
            conv_id, edits = of, Edits(text)
            yield conv_id, None, None
        else:
            yield from ((conv_id, *x) for x in edits.applied(role, text))
    if edits is not None:
        yield from ((conv_id, *x) for x in edits.inserted())


def _turns(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, n = [], 0, 0
        for conv_id, role, text in _edited(batches):
            n = 0 if role is None else n + 1
            if n:
                rows.append((conv_id, n, role, text))
                size += len(text)
            if len(rows) >= 2000 or size > 8 << 20:
                yield _out(schema.names, rows, schema)
                rows, size = [], 0
        yield _out(schema.names, rows, schema)

    return run


def _hashes(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, state, first = [], None, True
        for conv_id, role, text in _edited(batches):
            if role is None:
                if state is not None:
                    rows[-1] = (rows[-1][0], state.hexdigest())
                if len(rows) >= 2000:
                    yield _out(schema.names, rows, schema)
                    rows = []
                rows.append((conv_id, None))
                state, first = hashlib.sha256(), True
            else:
                state.update((b"" if first else b"\n") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False
        if state is not None:
            rows[-1] = (rows[-1][0], state.hexdigest())
        yield _out(schema.names, rows, schema)

    return run


def _fields(id_field: pa.Field, **others: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field("conv_id", id_field.type), *(pa.field(n, t) for n, t in others.items())])


def _id_type(df: DataFrame) -> tuple[pa.Field, str]:
    return pa.field("conv_id", df.select("conv_id").limit(0).toArrow().schema.field(0).type), df.schema["conv_id"].dataType.simpleString()


def diagnose(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report on turns(conv_id, turn, role, text, dropped), and the turns as numbered() gives them.

    The report has a row for each conversation: gaps among its turns (largest less smallest plus one less
    the distinct ones, without nulls; 0 if all are null), the rows whose first fault is blank, duplicate
    or truncated, illegal (neighbours whose role initials are not su, ua or au), and the cost and edits (audit)
    of the cheapest repair, see repair(). Rows marked `dropped` count for nothing, so that a
    conversation of such rows alone has zeros and no edits.

    Conversations are dealt by conv_id; of a conversation a task holds a byte a turn, its texts pass by
    in order. Null roles and texts read as one space, a null conv_id is a conversation of its own. An empty
    table gives an empty report. Other columns are ignored.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    own = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), "dropped")
    marked = write_stage(numbered(own), "turns")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    id_field, id_type = _id_type(turns)
    schema = _fields(id_field, **{c: pa.int64() for c in counts}, audit=pa.string())
    light = marked.select("conv_id", "turn", "code", "place").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    report = light.select("conv_id", "turn", "code").mapInArrow(_repairs(schema), f"conv_id {id_type}, {', '.join(f'{c} long' for c in counts)}, audit string")
    return write_stage(report, "repairs"), marked


def _in_order(report: DataFrame, marked: DataFrame) -> DataFrame:
    """Each conversation's edits, then its turns, in the task that its conv_id names."""
    small_batches(report.sparkSession, 256)
    heads = report.select("conv_id", F.lit(0).alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = heads.unionByName(marked.where("not dropped").select("conv_id", "place", "role", "text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")


def repaired_turns(report: DataFrame, marked: DataFrame) -> DataFrame:
    """conv_id, place, role, text of the repaired conversations: inserted turns have empty texts."""
    id_field, id_type = _id_type(report)
    schema = _fields(id_field, place=pa.int64(), role=pa.string(), text=pa.string())
    return _in_order(report, marked).mapInArrow(_turns(schema), f"conv_id {id_type}, place long, role string, text string")


def repaired_hashes(report: DataFrame, marked: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its repaired `role:text` lines, of the empty string if none are left."""
    id_field, id_type = _id_type(report)
    schema = _fields(id_field, repaired_sha256=pa.string())
    return _in_order(report, marked).mapInArrow(_hashes(schema), f"conv_id {id_type}, repaired_sha256 string")
