"""Conversation structure repair: the cheapest edits that make the roles of a
conversation read ``(s?(ua)+)?``, found in one pass over sorted rows.

Rows are repartitioned by conversation and sorted by turn; a task reads them as
a stream of Arrow batches. A state machine of four states (nothing yet, after
the system message, after a user, after an assistant) carries, from batch to
batch, the least cost of each state, the order of the states' edit strings
(ties go to the ASCII-least) and a running hash of the text that each state's
edits leave. A row adds a back-pointer byte per state. When a conversation grows
beyond ``SPILL`` rows, its back-pointers leave the task as rows of the output;
a second stream, sorted from the last piece to the first, traces those
conversations back. No task holds more than ``SPILL`` back-pointers, one batch
of rows and one conversation's edit string.

Edits: Keep 0, Rerole to user/assistant 1, Delete 2 (blank and duplicate rows
must go), Insert an empty user/assistant message 5; truncated rows that stay
add 5. Inserts stand before a row or at the end. Two edit strings of one length
of rows can't be a beginning of each other (a row's letter comes last), so the
order of the states' strings decides every later tie.

Defined results: nulls read one space; a null conv_id is a conversation of its
own, null turns come first; equal turns go by role, then text; rows that
the damage drops still name their conversation; empty texts are blank;
long texts are hashed whole; repeated rows are duplicates but the first; a gap
beyond a long is the greatest long; an empty table gives no rows; further
columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import read, ship, stash
from .merkle import crc32_sql

SPILL = 1 << 16
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5  # costs
NEXT = (2, 2, 3, 2)  # the state after an inserted or reroled message
NAME = (None, None, "user", "assistant")
INITIAL = {2: "u", 3: "a"}
LONG = (1 << 63) - 1
FAR = 1 << 62


def after(state: int, initial: str) -> int | None:
    """The state after a message with this role initial, None if it can't follow."""
    if initial == "s":
        return 1 if state == 0 else None
    return NEXT[state] if initial and initial == INITIAL[NEXT[state]] else None


def _moves(initial: str, must_go: bool) -> list[tuple[int, int, int, str, int]]:
    """(state, new state, cost, letters, inserts) of a row, without a cut's cost."""
    out = []
    for state in range(4):
        out.append((state, state, DELETE, "D", 0))
        at = state
        for k in range(3):
            if not must_go:
                to = after(at, initial)
                if to is not None:
                    out.append((state, to, INSERT * k + KEEP, "I" * k + "K", k))
                out.append((state, NEXT[at], INSERT * k + REROLE, "I" * k + "R", k))
            at = NEXT[at]
    return out


MOVES = {(i, go): _moves(i, go) for i in ("s", "u", "a", "") for go in (False, True)}
LETTERS = ("D", "K", "R", "IK", "IR", "IIK", "IIR")
CODE = {letters: n for n, letters in enumerate(LETTERS)}
ENDS = ((0, ""), (1, "II"), (2, "I"), (3, ""))  # letters that complete a state


def traced(pointers: bytes, state: int) -> tuple[str, int]:
    """The edit string behind a state, and the state before the first pointer."""
    out = []
    for at in range(len(pointers) - 4, -4, -4):
        code = pointers[at + state]
        out.append(LETTERS[code >> 2])
        state = code & 3
    return "".join(reversed(out)), state


class Repair:
    """One conversation, row by row."""

    def __init__(self):
        self.cost = [0, FAR, FAR, FAR]
        self.rank = [0, 1, 2, 3]
        self.text = [hashlib.sha256(), None, None, None]
        self.some = [False] * 4
        self.pointers = bytearray()
        self.turns: list[int | None] = [None, None, 0]  # least, greatest, distinct
        self.faults = [0, 0, 0, 0]
        self.illegal, self.last = 0, None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        if turn is not None:
            low, high, n = self.turns
            self.turns = [turn if low is None else low, turn, n + (turn != high or low is None)]
        self.faults[fault] += 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        cut = CUT if fault == TRUNCATED else 0
        best: list = [None] * 4
        for state, to, cost, letters, k in MOVES[initial if initial in ("s", "u", "a") else "", fault in (BLANK, DUPLICATE)]:
            if self.cost[state] < FAR:
                key = (self.cost[state] + cost + (0 if letters == "D" else cut), self.rank[state], letters)
                if best[to] is None or key < best[to][0]:
                    best[to] = (key, state, k)
        order = sorted((b[0][1:], to) for to, b in enumerate(best) if b)
        rank, texts, some, pointers = [3] * 4, [None] * 4, [False] * 4, bytearray(4)
        for n, (_, to) in enumerate(order):
            rank[to] = n
        for to, b in enumerate(best):
            if b is None:
                continue
            (_, _, letters), state, k = b
            pointers[to] = CODE[letters] << 2 | state
            if letters == "D":
                texts[to], some[to] = self.text[state], self.some[state]
                continue
            lines, at = [], state
            for _ in range(k):
                at = NEXT[at]
                lines.append(f"{NAME[at]}:")
            lines.append(f"{role if letters[-1] == 'K' else NAME[to]}:{text}")
            texts[to], some[to] = self.text[state].copy(), True
            texts[to].update((("\n" if self.some[state] else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
        self.cost = [b[0][0] if b else FAR for b in best]
        self.rank, self.text, self.some = rank, texts, some
        self.pointers += pointers

    def end(self) -> tuple[int, int, str, str]:
        """cost, state, last letters and hash of the cheapest edits."""
        (cost, _, letters), state = min(((self.cost[s] + INSERT * len(tail), self.rank[s], tail), s) for s, tail in ENDS if self.cost[s] < FAR)
        done, at = self.text[state].copy(), state
        for n in range(len(letters)):
            at = NEXT[at]
            done.update(("\n" if self.some[state] or n else "").encode() + f"{NAME[at]}:".encode())
        return cost, state, letters, done.hexdigest()

    def gaps(self) -> int:
        low, high, n = self.turns
        return 0 if low is None else min(high - low + 1 - n, LONG)


# ---- damage and faults, in DataFrame functions ----------------------------------

def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage; dropped rows stay with ``live`` false."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    k = F.crc32(key.cast("binary")) % 20
    copies = F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(k == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(k.isin(0, 1), F.lit("")).when(k == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (k != 0).alias("live"), F.explode(copies).alias("copy")).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows in the order of their conversation with their first fault (0: none).
    One shuffle: the window over equal messages keeps the partitions by conversation."""
    mark = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "live", "role", "text").orderBy("turn"))
    fault = (F.when(~F.col("live"), 0).when(mark == "", BLANK).when(seen > 1, DUPLICATE)
             .when(F.right(mark, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED))
    return (rows.repartition("conv_id").withColumn("fault", fault.cast("int"))
            .sortWithinPartitions("conv_id", "turn", "role", "text"))


# ---- the streams ---------------------------------------------------------------

STATS = [T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
PLAN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("piece", T.IntegerType()), *STATS,
                     T.StructField("pointers", T.BinaryType()), T.StructField("state", T.IntegerType()),
                     T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])


def plan(rows: DataFrame, spill: int = SPILL) -> DataFrame:
    """A row per conversation; if it was spilled, rows with its back-pointers too:
    pieces 0, 1, ..., the last of them with the figures and only the end of the
    edit string."""
    schema = PLAN
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        out: list[tuple] = []
        conv, work, piece = None, None, 0

        def finish():
            cost, state, tail, sha = work.end()
            audit = tail
            pointers = bytes(work.pointers)
            if not piece:
                audit = traced(pointers, state)[0] + tail
            out.append((conv, piece, work.gaps(), work.faults[BLANK], work.faults[DUPLICATE], work.faults[TRUNCATED], work.illegal, cost,
                        pointers if piece else None, state, audit, sha))

        def record():
            cols = list(zip(*out)) if out else [[]] * len(types)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, types)], schema=types)

        for batch in batches:
            for c, turn, role, text, live, fault in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "live", "fault")]):
                if work is None or c != conv:
                    if work is not None:
                        finish()
                    conv, work, piece = c, Repair(), 0
                if live:
                    work.add(turn, role, text, fault)
                    if len(work.pointers) >= 4 * spill:
                        out.append((conv, piece, *[None] * 6, bytes(work.pointers), None, None, None))
                        work.pointers.clear()
                        piece += 1
            yield record()
        if work is not None:
            finish()
        yield record()

    return rows.select("conv_id", "turn", "role", "text", "live", "fault").mapInArrow(run, schema)


def trace(pieces: DataFrame) -> DataFrame:
    """conv_id and the whole edit string of spilled conversations, whose pieces
    are read from the last to the first."""
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("whole", T.StringType())])
    ship(pieces.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        parts, state = [], 0
        for batch in batches:
            out = []
            for c, piece, pointers, end, audit in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "piece", "pointers", "state", "audit")]):
                if end is not None:  # the last piece
                    parts, state = [audit], end
                text, state = traced(pointers, state)
                parts.append(text)
                if piece == 0:
                    out.append((c, "".join(reversed(parts))))
                    parts = []
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[], []], types)], schema=types)

    ordered = pieces.select("conv_id", "piece", "pointers", "state", "audit").repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", F.desc("piece")).mapInArrow(run, schema)


def repair(rows: DataFrame, spill: int = SPILL) -> DataFrame:
    """A row per conversation of ``rows`` (conv_id, turn, role, text, live): its
    faults, the cost, the edit string ``audit`` and the hash of the repaired text."""
    plans = stash(plan(with_faults(rows), spill), "conversation-plans")
    whole = trace(plans.where(F.col("pointers").isNotNull()))
    key = F.col("p.conv_id").eqNullSafe(F.col("w.conv_id"))
    return (plans.where(F.col("state").isNotNull()).alias("p").join(whole.alias("w"), key, "left")
            .select("p.conv_id", *[f.name for f in STATS], F.coalesce("whole", "audit").alias("audit"), "repaired_sha256"))


def messages(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, step (long, in order), edit, role,
    text. Steps of the edit string meet the rows by their number in the
    conversation; a step's role follows from the messages before it."""
    number = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    lines = with_faults(rows).where("live").withColumn("pos", F.row_number().over(number).cast("int"))
    steps = repaired.select("conv_id", "audit", F.posexplode(F.split("audit", "")).alias("step", "edit")).where("edit <> ''")
    w = Window.partitionBy("conv_id").orderBy("step")
    steps = steps.select("conv_id", F.col("step").cast("long").alias("step"), "edit",
                         F.sum(F.when(F.col("edit") == "I", 0).otherwise(1)).over(w).cast("int").alias("pos"),
                         F.sum(F.when(F.col("edit") == "D", 0).otherwise(1)).over(w).alias("nth"))
    joined = steps.alias("s").join(lines.alias("l"), F.col("s.conv_id").eqNullSafe(F.col("l.conv_id")) & (F.col("s.pos") == F.col("l.pos")) & (F.col("edit") != "I"), "left")
    system = F.max(F.when((F.col("nth") == 1) & (F.col("edit") == "K") & (F.left("role", F.lit(1)) == "s"), 1).otherwise(0)).over(Window.partitionBy("s.conv_id"))
    role = F.when(F.col("edit") == "K", F.col("role")).when((F.col("nth") - system) % 2 == 1, "user").otherwise("assistant")
    return joined.select("s.conv_id", "step", "edit", role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("edit <> 'D'")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(read(spark, sf_dir, "conversations")))


def oracle() -> str:
    """The contract in DuckDB SQL: a recursion over row numbers keeps, per
    conversation and state, the least (cost, edit string)."""
    nl = "chr(10)"
    return f"""
WITH RECURSIVE step(st, init, nst, nm) AS (VALUES (0, 's', 1, ''), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
ins AS (SELECT DISTINCT st, st AS mid, 0 AS k, '' AS lines FROM step
  UNION ALL SELECT ins.st, step.nst, k + 1, CASE WHEN k = 0 THEN '' ELSE lines || {nl} END || nm || ':' FROM ins JOIN step ON step.st = ins.mid AND step.init <> 's' WHERE k < 2),
mv AS (SELECT step.init, ins.st, step.nst, 5 * k AS c, repeat('I', k) || 'K' AS letters, lines AS ins, '' AS nm FROM ins JOIN step ON step.st = ins.mid
  UNION ALL SELECT '*', ins.st, step.nst, 5 * k + 1, repeat('I', k) || 'R', lines, nm FROM ins JOIN step ON step.st = ins.mid AND step.init <> 's'
  UNION ALL SELECT '', st, st, 2, 'D', '', '' FROM (SELECT DISTINCT st FROM step)),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
   {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations),
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS cid FROM (SELECT DISTINCT conv_id FROM src)),
live AS (SELECT cid, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
   CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
   FROM src JOIN ids ON src.conv_id IS NOT DISTINCT FROM ids.conv_id, (VALUES (1), (2)) AS n(copy) WHERE k <> 0 AND (copy = 1 OR k = 3)),
num AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS i,
   regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS mark FROM live),
f AS (SELECT *, row_number() OVER (PARTITION BY cid, role, text ORDER BY i) AS seen, lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY i) AS prev FROM num),
r AS (SELECT cid, i, turn, role, text, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS init,
   CASE WHEN mark = '' THEN 1 WHEN seen > 1 THEN 2 WHEN mark NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
   prev IS NOT NULL AND prev || left(role, 1) NOT IN ('su', 'ua', 'au') AS bad FROM f),
stat AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
   count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (bad) AS illegal, max(i) AS n FROM r GROUP BY cid),
dp AS (SELECT cid, 0::BIGINT AS i, 0 AS st, 0::BIGINT AS cost, '' AS audit, '' AS body FROM ids
  UNION ALL
  SELECT cid, i, nst, best.cost, best.audit, best.body FROM (
    SELECT dp.cid, r.i, nst, min(struct_pack(cost := cost + c + CASE WHEN fault = 3 AND letters <> 'D' THEN 5 ELSE 0 END, audit := audit || letters,
      body := CASE WHEN letters = 'D' THEN body ELSE body || CASE WHEN body = '' THEN '' ELSE {nl} END || ins || CASE WHEN ins = '' THEN '' ELSE {nl} END || CASE WHEN right(letters, 1) = 'K' THEN role ELSE nm END || ':' || text END)) AS best
    FROM dp JOIN r ON r.cid = dp.cid AND r.i = dp.i + 1 JOIN mv ON mv.st = dp.st AND (letters = 'D' OR (mv.init IN (r.init, '*') AND fault NOT IN (1, 2)))
    GROUP BY dp.cid, r.i, nst)),
fin AS (SELECT cid, min(struct_pack(cost := cost + 5 * len(tail), audit := audit || tail,
    body := body || CASE WHEN tail = '' THEN '' ELSE CASE WHEN body = '' THEN '' ELSE {nl} END || add END)) AS best
  FROM dp JOIN (VALUES (0, '', ''), (1, 'II', 'user:' || {nl} || 'assistant:'), (2, 'I', 'assistant:'), (3, '', '')) AS e(st, tail, add) USING (st)
  LEFT JOIN stat USING (cid) WHERE i = coalesce(n, 0) GROUP BY cid)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(best.body) AS repaired_sha256
FROM ids JOIN fin USING (cid) LEFT JOIN stat USING (cid)"""
