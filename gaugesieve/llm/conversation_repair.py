"""Repair of damaged conversations by the cheapest edits, found by iterative-deepening A*.

A conversation is good if the initials of its roles read ``(s?(ua)+)?`` and none of its rows is blank or a duplicate. The
edits are taken row by row: Delete (3, and the only one allowed for a blank or duplicate row), Keep (0), Rerole to what
the grammar wants, user or assistant (2), and Insert of an empty row before a row or at the end (2); a truncated row that
is not deleted adds 1. Of the cheapest edits, those whose initials come first in ASCII are taken.

The grammar has four states: nothing yet, after system, after user, after assistant. What an edit leads to follows from the state, so
the initials alone tell the repaired conversation. The search goes depth first through the edits in ASCII order, D I K R,
under a bound on cost so far plus a lower bound of what is left; the bound then rises to the least sum that exceeded it.
The first path that is accepted under the least bound is the answer. What is left costs at least 3 for a row that must go,
1 for a truncated one, and 1 for each two neighbours among the other rows that may not follow each other, as one
edit mends two of them at most. States that fail are kept in a table over all bounds, with the least bound that may still
succeed.

A long conversation is cut into blocks. From the last block back, each state before a block gets the cheapest cost from there to
the end, the block's search ending on the costs of the next one; then the blocks are walked forward. Every edit of a block ends
with a row, so the choice of the first differing block decides, and the answer is that of one search, in time
that grows with the length.

Two passes run over Spark's sorted shuffles. The first streams a few numbers per row and gives the audit; the second
streams the texts, each conversation after its audit, into the digest, and holds one batch at a time. A conversation is one row of the
result with one SHA-256 of all its text, so its rows meet in one task, which holds a byte per row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gaugesieve.functions.storage import stored
from gaugesieve.llm.batches import bounded_batches

BLANKS = r"\x20\x09-\x0D"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)  # states; but for the first also the initials s, u and a, START being any other
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
WANTED = (USER, USER, ASSISTANT, USER)  # by state, what the grammar wants next
ACCEPTED = (START, ASSISTANT)
FOLLOWS = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
CUT, GOES = 4, 8  # added to the initial of a row that is truncated, or that must be deleted
BLOCK = 64
NEVER = 1 << 60

FACTS = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = "conv long, repaired_sha256 string"


def keeps_to(state: int, initial: int) -> int | None:
    """State after a row of that initial is kept, None where the grammar forbids it."""
    if initial == SYSTEM:
        return SYSTEM if state == START else None
    return initial if initial and initial == WANTED[state] else None


class Search:
    """Cheapest edits of a block of rows. ``after`` has the cost from each state behind the block to the end.

    Each row is a byte: its initial, and CUT or GOES.
    """

    def __init__(self, rows: bytes, after: list[int], last: bool):
        self.rows, self.after, self.last = rows, after, last
        n = len(rows)
        self.least = [min(after)] * (n + 1)
        following = None
        for i in range(n - 1, -1, -1):
            if rows[i] & GOES:
                self.least[i] = self.least[i + 1] + DELETE
                continue
            initial = rows[i] & 3
            broken = following is not None and (initial, following) not in FOLLOWS
            self.least[i] = self.least[i + 1] + (TRUNCATED if rows[i] & CUT else 0) + broken
            following = initial
        self.failed: dict[tuple[int, int], int] = {}

    def edits(self, i: int, state: int):
        """(letter, cost, next row, next state) in ASCII order."""
        n = len(self.rows)
        if i < n:
            yield "D", DELETE, i + 1, state
        if i < n or self.last:
            yield "I", INSERT, i, WANTED[state]
        if i < n and not self.rows[i] & GOES:
            more = TRUNCATED if self.rows[i] & CUT else 0
            kept = keeps_to(state, self.rows[i] & 3)
            if kept is not None:
                yield "K", more, i + 1, kept
            yield "R", REROLE + more, i + 1, WANTED[state]

    def from_state(self, state: int) -> tuple[int, str, int]:
        """(cost to the end, edits in the block, state behind it)."""
        bound = max(self.least[0], self.failed.get((0, state), 0))
        while True:
            found = self._within(state, bound)
            if found is not None:
                return bound, *found
            bound = self.failed[0, state]

    def _within(self, state: int, bound: int) -> tuple[str, int] | None:
        """Edits and last state of the first path that costs ``bound`` at most; else the table has a larger bound."""
        n, failed = len(self.rows), self.failed
        if n == 0 and not self.last:
            return "", state
        # Each frame: row, state, what may still be spent, its edits, the least that a failing edit asks for.
        stack = [[0, state, bound, self.edits(0, state), NEVER]]
        path: list[str] = []
        while stack:
            frame = stack[-1]
            i, q, left, edits, least = frame
            step = next(edits, None)
            if step is None:
                # What the state needs at least, whatever came before it.
                failed[i, q] = max(failed.get((i, q), 0), least)
                stack.pop()
                if stack:
                    path.pop()
                    parent = stack[-1]
                    parent[4] = min(parent[4], parent[2] - left + least)
                continue
            letter, cost, i2, q2 = step
            left2 = left - cost
            if i2 == n and (self.after[q2] <= left2 if not self.last else q2 in ACCEPTED and left2 >= 0):
                return "".join(path) + letter, q2
            if i2 == n and not self.last:
                frame[4] = min(least, cost + self.after[q2])
                continue
            needed = max(self.least[i2], failed.get((i2, q2), 0))
            if needed > left2:
                frame[4] = min(least, cost + needed)
                continue
            stack.append([i2, q2, left2, self.edits(i2, q2), NEVER])
            path.append(letter)
        return None


def repair(rows: bytes, block: int = BLOCK) -> tuple[int, str]:
    """Least cost and the ASCII-least edits of it for a whole conversation."""
    if not rows:
        return 0, ""
    solved = []
    after = [0, 0, 0, 0]
    for at in range((len(rows) - 1) // block * block, -1, -block):
        search = Search(rows[at:at + block], after, last=not solved)
        solved.append([search.from_state(q) for q in range(4)] if at else [search.from_state(START)])
        after = [s[0] for s in solved[-1]]
    state, parts = START, []
    for options in reversed(solved):
        _, edits, state = options[state]
        parts.append(edits)
    return solved[-1][START][0], "".join(parts)


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, there) after the seeded damage; a dropped row stays, with ``there`` false.

    The damage follows crc32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3
    repeats it, 4 makes its role user. Nulls in the key, role and text are one space.
    """
    def text(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", text(conv_col), text(turn_col))) % 20
    rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                                text(role_col).alias("role"), text(text_col).alias("text"), kind.alias("kind"))
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       changed.alias("text"), (F.col("kind") != 0).alias("there"), F.explode(copies).alias("copy")).drop("copy")


def _sorted(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of a conversation together and in order, nulls first; conversations follow each other in a partition."""
    return rows.repartition("conv").sortWithinPartitions("conv", *order)


class _Facts:
    """Counts of one conversation, taken up row by row; a byte per row is kept."""

    def __init__(self, conv: int | None):
        self.conv, self.rows = conv, bytearray()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.turns, self.first, self.turn, self.illegal = 0, None, None, 0

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn = turn
            self.turns += 1
        self.faults[fault] += 1
        code = INITIALS.get(initial, START)
        if self.rows:
            self.illegal += (self.rows[-1] & 3, code) not in FOLLOWS
        self.rows.append(code | (CUT if fault == "truncated" else GOES if fault else 0))

    def row(self) -> tuple:
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        counts = [self.faults[f] for f in ("blank", "duplicate", "truncated")]
        return self.conv, gaps, *counts, self.illegal, *repair(bytes(self.rows))


def _batch(out: list, schema: str) -> pa.RecordBatch:
    """The rows of ``out`` as a batch; ``out`` is emptied."""
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*out)) or [[]] * len(fields)
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if t == "string" else pa.int64()) for c, (_, t) in zip(columns, fields)],
                                      [name for name, _ in fields])


def _audits(batches):
    """A row of FACTS per conversation from its sorted rows (conv, there, turn, initial, fault)."""
    current, out = None, []
    for batch in batches:
        for conv, there, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if current is None or current.conv != conv:
                if current is not None:
                    out.append(current.row())
                current = _Facts(conv)
            if there:
                current.add(turn, initial, fault)
        if len(out) >= 1000:
            yield _batch(out, FACTS)
    if current is not None:
        out.append(current.row())
    yield _batch(out, FACTS)


class _Repaired:
    """The digest of one repaired conversation, from its audit and its rows one by one."""

    def __init__(self, conv: int | None, audit: str):
        self.conv, self.letters, self.state = conv, iter(audit), START
        self.digest, self.mark = hashlib.sha256(), ""

    def add(self, role: str, text: str) -> None:
        """Rows inserted before the given one, and what its own letter makes of it."""
        for letter in self.letters:
            if letter == "K":
                self.state = keeps_to(self.state, INITIALS.get(role[:1], START))
                self._write(role, text)
            elif letter != "D":
                self.state = WANTED[self.state]
                self._write(ROLES[self.state], text if letter == "R" else "")
            if letter != "I":
                return

    def _write(self, role: str, text: str) -> None:
        self.digest.update(f"{self.mark}{role}:{text}".encode())
        self.mark = "\n"

    def row(self) -> tuple:
        self.add("", "")  # what is inserted at the end
        return self.conv, self.digest.hexdigest()


def _digests(batches):
    """(conv, SHA-256 of the repaired conversation) from its audit and, after it, its sorted rows."""
    current, out = None, []
    for batch in batches:
        for conv, audit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if audit is not None:
                if current is not None:
                    out.append(current.row())
                current = _Repaired(conv, audit)
            else:
                current.add(role, text)
        if len(out) >= 1000:
            yield _batch(out, REPAIRED)
    if current is not None:
        out.append(current.row())
    yield _batch(out, REPAIRED)


def audits(rows: DataFrame) -> DataFrame:
    """FACTS of every conversation of ``rows`` (conv, turn, role, text, there).

    Rows go by turn, nulls first, then by role and the SHA-256 of the text. The first fault of a row counts: blank (no
    character but blanks), duplicate (an earlier row has its role and text), truncated (the last character that is no
    blank is none of ``.!?``). Rows that are not there only make their conversation known.
    """
    last = F.regexp_extract("text", rf"([^{BLANKS}])[{BLANKS}]*\z", 1)
    narrow = rows.select("conv", "turn", "role", "there", F.sha2("text", 256).alias("digest"), last.alias("last"))
    again = F.row_number().over(W.partitionBy("conv", "role", "digest", "there").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("last") == "", "blank").when(again, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")
    faulty = narrow.withColumn("fault", fault)
    ordered = _sorted(faulty, "turn", "role", "digest", F.col("fault") == "duplicate")
    ordered = ordered.select("conv", "there", "turn", F.substring("role", 1, 1), "fault")
    return ordered.mapInArrow(_audits, FACTS)


def repaired_digests(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): the digest of the repaired rows as ``role:text``, a line each."""
    first = audited.select("conv", F.lit(None).cast("long").alias("turn"), "audit", F.lit(None).cast("string").alias("role"),
                           F.lit(None).cast("string").alias("text"))
    texts = rows.filter("there").select("conv", "turn", F.lit(None).cast("string").alias("audit"), "role", "text")
    both = first.unionByName(texts).withColumn("digest", F.sha2("text", 256))
    ordered = _sorted(both, F.col("audit").isNull(), "turn", "role", "digest").select("conv", "audit", "role", "text")
    return ordered.mapInArrow(_digests, REPAIRED)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows``: FACTS and the digest of the repaired conversation.

    Conversations without rows that are there have zeros, an empty audit and the digest of the empty string. A null
    conversation is a conversation. Repeated rows are duplicates. An empty table gives an empty result.
    """
    bounded_batches(rows.sparkSession)
    audited = stored(audits(rows), "audits")
    found = repaired_digests(rows, audited).withColumnRenamed("conv", "of")
    return audited.join(found, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
