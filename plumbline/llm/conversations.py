"""Conversation structure repair by iterative-deepening A*.

A conversation is well formed if its roles are nothing, or user and assistant
in turn, with a system message before them or not.  The search edits its rows
in order (delete, insert, keep, rerole: the ASCII order of their initials),
depth first under a cost bound that rises to the least cost that exceeded it,
so the first accepted path is the cheapest, and of the cheapest the ASCII-least.
States that failed with some budget are kept in a table and not entered again
with no more of it.

What is still to pay is bounded from below by the exact costs of blocks of
BLOCK rows, each freed from what the roles before it were; their sum never
exceeds the real cost, because every row and every inserted turn is in one
block.
"""

from __future__ import annotations

import hashlib
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What edits cost.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: States by the role seen last: none, system, user, assistant.  A conversation may end in the first and in the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What an inserted or reroled turn has to be in a state.
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
LEGAL = frozenset(("su", "ua", "au"))
#: Rows whose costs are known exactly in one bound.
BLOCK = 16
#: Rows that are searched at once; a longer conversation is searched part by part, for every state that a part may begin and end in.
ROWS = 128
FAR = 1 << 60
#: Faults of a row.
SOUND, CUT, LOST = 0, 1, 2  # LOST: blank or a duplicate, has to go


def bounds(rows: list[tuple[str, int]], ends: tuple[int, ...]) -> list[list[int]]:
    """For each row and state, what the rest costs at least."""
    at_end = [min((0 if s in ends else FAR), min((INSERT if NEXT[s][0] in ends else FAR), (2 * INSERT if NEXT[NEXT[s][0]][0] in ends else FAR))) for s in range(4)]
    going = [s for s in range(4) if USER in ends or ASSISTANT in ends or s == START or s == SYSTEM and SYSTEM in ends]  # from where ends can be reached
    table: list[list[int]] = [at_end]
    for i in range(len(rows) - 1, -1, -1):
        role, fault = rows[i]
        after = table[-1] if (i + 1) % BLOCK or i + 1 == len(rows) else [min(table[-1][t] for t in going) if s in going else FAR for s in range(4)]
        here = []
        for s in range(4):
            best = DELETE + after[s]
            if fault != LOST:
                extra = TRUNCATED * fault
                if (s, role) in STEP:
                    best = min(best, extra + after[STEP[s, role]])
                best = min(best, REROLE + extra + after[NEXT[s][0]])
            here.append(best)
        for _ in range(2):  # an inserted turn before the row
            here = [min(here[s], INSERT + here[NEXT[s][0]]) for s in range(4)]
        table.append(here)
    return table[::-1]


def search(rows: list[tuple[str, int]], start: int = START, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Cost and edits of the cheapest way from state start to one of ends; None if there is none.

    rows: the initial of the role and the fault of each.
    """
    if not any(s in ends for s in (USER, ASSISTANT)):  # those two are reached from anywhere, by inserted turns
        kept = START in ends and start == START or SYSTEM in ends and (start == SYSTEM or start == START and any(role == "s" and fault != LOST for role, fault in rows))
        if not kept:
            return None
    n, h = len(rows), bounds(rows, ends)
    bound = h[0][start]
    while True:
        beyond, failed = FAR, {}
        path: list[tuple[int, int, int, int]] = [(0, start, 0, 0)]  # row, state, cost, the next edit to try
        audit: list[str] = []
        while path:
            i, s, cost, k = path.pop()
            if k == 0 and i == n and s in ends:
                return cost, "".join(audit)
            moves = edits(rows[i] if i < n else None, s)
            for k in range(k, len(moves)):
                letter, price, to, step = moves[k]
                j, paid = i + step, cost + price
                least = paid + h[j][to]
                if least > bound:
                    beyond = min(beyond, least)
                elif failed.get((j, to), -1) < bound - paid:
                    path += [(i, s, cost, k + 1), (j, to, paid, 0)]
                    audit.append(letter)
                    break
            else:
                failed[i, s] = max(failed.get((i, s), -1), bound - cost)
                if audit:
                    audit.pop()
        bound = beyond


@cache
def edits(row: tuple[str, int] | None, s: int) -> list[tuple[str, int, int, int]]:
    """Letter, cost, state after and rows used of what may be done next, in ASCII order."""
    out = [("D", DELETE, s, 1)] if row else []
    out.append(("I", INSERT, NEXT[s][0], 0))
    if row and row[1] != LOST:
        extra = TRUNCATED * row[1]
        if (s, row[0]) in STEP:
            out.append(("K", extra, STEP[s, row[0]], 1))
        out.append(("R", REROLE + extra, NEXT[s][0], 1))
    return out


class Repair:
    """One conversation's rows in order, part by part; holds one part and, for each state, one way to it."""

    def __init__(self, audited: bool):
        self.ways = {START: (0, "", hashlib.sha256(), [])}
        self.part: list[tuple[str, str, int, int]] = []  # role, text, fault, row
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = 0
        self.before, self.audited = None, audited
        self.turns: list[int] | None = None  # least and greatest turn, number of different ones, last seen

    def add(self, turn: int | None, role: str, text: str, bare: bool, cut: bool, first: bool) -> None:
        if turn is not None:
            if self.turns is None:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:  # turns come in order
                self.turns = [self.turns[0], turn, self.turns[2] + 1]
        self.blank += bare
        self.duplicate += not bare and not first
        self.truncated += not bare and first and cut
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if len(self.part) == ROWS:
            self.settle(None)
        self.part.append((role, text, LOST if bare or not first else CUT if cut else SOUND, self.rows))
        self.rows += 1

    def settle(self, ends: tuple[int, ...] | None) -> None:
        """Search the part, from each state that is reached so far; ends: None for a part that others follow."""
        rows, after = [(role[:1], fault) for role, _, fault, _ in self.part], {}
        for start, (cost, audit, sha, done) in self.ways.items():
            for goal in [ends] if ends else [(s,) for s in range(4)]:
                found = search(rows, start, goal)
                if found:
                    key = goal if ends else goal[0]
                    way = (cost + found[0], audit + found[1], start, found[1], sha, done, bool(audit.strip("D")))
                    if key not in after or way[:2] < after[key][:2]:
                        after[key] = way
        self.ways = {key: (cost, audit, *self.replay(start, part, sha.copy(), list(done), begun)) for key, (cost, audit, start, part, sha, done, begun) in after.items()}
        self.part = []

    def replay(self, s: int, audit: str, sha, done: list, begun: bool):
        """The digest and the edits after what the audit says is done to the part."""
        i = 0
        for letter in audit:
            role, text, _, row = ("", "", 0, None) if letter == "I" else self.part[i]
            i += letter != "I"
            if letter in "IR":
                s, role = NEXT[s]
            elif letter == "K":
                s = STEP[s, role[:1]]
            if letter != "D":
                sha.update((("\n" if begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                begun = True
            if self.audited:
                done.append({"edit": letter, "row": row, "role": role})
        return sha, done

    def result(self) -> tuple:
        self.settle(ENDS)
        ((cost, audit, sha, done),) = self.ways.values()
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, sha.hexdigest(), done


def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, gone (the row was dropped), copies (how often it stands), spoilt by crc32 of `conv_id:turn` modulo 20.

    0 drops the row, 1 empties its text, 2 takes its `.!?` away, 3 repeats it, 4
    gives it to the user; other rows stay.  A null id or turn counts as one
    blank there, a null role or text becomes one blank; an empty table gives no
    rows; other columns are left out, so their names don't matter.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(id_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank(text_col), ".!?", "")).otherwise(blank(text_col))
    role = F.when(kind == 4, "user").otherwise(blank(role_col))
    return conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


def in_order(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, copies: Column, gone: Column) -> DataFrame:
    """One row for all equal ones (n of them) as id, turn, role, text, gone, with `first`: no earlier row of the conversation has this role and text."""
    rows = conversations.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), copies.cast("long").alias("n"), gone.alias("gone"))
    some = rows.groupBy("id", "turn", "role", "text", "gone").agg(F.sum("n").alias("n"))
    return some.withColumn("first", F.row_number().over(Window.partitionBy("id", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"))) == 1)


# What a blank text is, and how a whole one ends.
BARE = r"\A[\x20\x09-\x0D]*\z"
WHOLE = r"[.!?][\x20\x09-\x0D]*\z"


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None, gone: Column | None = None, edits: bool = False) -> DataFrame:
    """Per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; with edits=True also edits.

    Rows stand in order of turn, nulls first, and then of role and text, so ties
    and repeated rows have one order.  A row's first fault counts: blank,
    duplicate (role and text stood earlier), truncated (doesn't end with one of
    `.!?`).  gaps are turn numbers between the least and the greatest that no
    row has, illegal are neighbours whose roles don't follow one another, audit
    has the edits' initials, and the digest is of the repaired `role:text`
    lines.  edits lists each edit with the row that it takes (null for an
    inserted one) and the role after it.

    copies says how often a row stands (once), gone that it doesn't, though its
    conversation is listed.  Null roles and texts count as one blank, a null id
    is a conversation like any other, a row of an unknown or empty role can't be
    kept, only reroled.  A conversation without rows has zeros, no audit and
    the digest of nothing; an empty table gives no rows; other columns aren't
    read, so their names don't matter.

    Equal rows meet before they are shuffled.  A task reads its conversations as
    a sorted stream and holds ROWS rows of one; a longer one is searched part by
    part, exactly.  What it holds of a conversation besides is its audit (and
    edits if asked for), which is output.  A digest is made front to back, so
    one conversation is one task's work.
    """
    rows = in_order(conversations, id_col, turn_col, role_col, text_col, F.lit(1) if copies is None else copies, F.lit(False) if gone is None else gone)
    rows = rows.withColumns({"bare": F.col("text").rlike(BARE), "cut": ~F.col("text").rlike(WHOLE)})
    rows = rows.repartition("id").sortWithinPartitions("id", F.asc_nulls_first("turn"), "role", "text").select("id", "turn", "role", "text", "bare", "cut", "first", "gone", "n")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "edits"]
    edit = pa.list_(pa.struct([("edit", pa.string()), ("row", pa.int64()), ("role", pa.string())]))
    types = [*[pa.int64()] * 6, pa.string(), pa.string(), edit]

    def run(batches):
        held, mine, out = None, None, []  # held: a conversation's id as a column of one row

        def flush():
            nonlocal out
            ids, results = [i for i, _ in out], [r for _, r in out]
            out = []
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array([r[k] for r in results], t) for k, t in enumerate(types))], ["id", *names])

        size = 0
        for batch in batches:
            ids, columns = batch.column(0), [batch.column(k).to_pylist() for k in range(1, 9)]
            keys = ids.to_pylist()
            for k, (turn, role, text, bare, cut, first, gone, n) in enumerate(zip(*columns, strict=True)):
                if mine is None or keys[k] != held[0]:
                    if mine is not None:
                        out.append((held[1], mine.result()))
                        size += len(out[-1][1][6])
                    held, mine = (keys[k], ids.slice(k, 1)), Repair(edits)
                if not gone:
                    for again in range(n):
                        mine.add(turn, role, text, bare, cut, first and not again)
                if len(out) >= 1000 or size > 10_000_000:
                    yield flush()
                    size = 0
        if mine is not None:
            out.append((held[1], mine.result()))
        if out:
            yield flush()

    kind = conversations.schema[id_col].dataType.simpleString()
    done = rows.mapInArrow(run, f"id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, edits array<struct<edit:string,row:bigint,role:string>>")
    return done.withColumnRenamed("id", id_col) if edits else done.drop("edits").withColumnRenamed("id", id_col)


def repaired_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None, gone: Column | None = None) -> DataFrame:
    """The repaired conversations: id, position (from 0), edit (I, K or R), role, text; edge cases as in repair."""
    copies, gone = F.lit(1) if copies is None else copies, F.lit(False) if gone is None else gone
    done = repair(conversations, id_col, turn_col, role_col, text_col, copies, gone, edits=True).select(F.col(id_col).alias("id"), F.posexplode(F.filter("edits", lambda e: e["edit"] != "D")).alias("position", "e"))
    done = done.select("id", "position", "e.*")
    rows = in_order(conversations, id_col, turn_col, role_col, text_col, copies, gone).where("not gone")
    rows = rows.withColumn("row", F.sum("n").over(Window.partitionBy("id").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, -1)))
    found = rows.select(F.col("id").alias("_id"), F.coalesce("row", F.lit(0)).alias("_row"), "text")  # a repeated row is kept as its first one
    out = done.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    return out.select(F.col("id").alias(id_col), "position", "edit", "role", F.coalesce("text", F.lit("")).alias("text"))
