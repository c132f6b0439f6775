"""Repair of a conversation's structure: A* on the lattice of rows and dialogue states."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import BROADCAST_ROWS

#: White space of the contract and sentence ends.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: What an edit costs, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a search; between searches only the states' best paths are carried on.
BLOCK = 256
#: A path that costs this much more than the cheapest one of its place is never completed: any state can follow another's
#: continuation after at most two inserts and one deletion.
HOPELESS = 2 * INSERT + DELETE
#: Role initials of a sound conversation are ``(s?(ua)+)?``: state to (initial, next state), and the state's inserted initial.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
WANTED = ("u", "u", "a", "u")
FINAL = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")


def search(rows: list[tuple[str, bool, bool]], sources: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) of each state behind ``rows``, from those of the states before them; A* by (cost + bound, audit).

    A row is (role initial, must be deleted, truncated). The bound sums, over the rows not reached yet, the
    deletions that are mandatory and the charges of truncated rows, which neither keeping nor deleting avoids; it never exceeds the true rest, and falls
    by no more than an edge costs, so a node's first visit is its cheapest, and of equal cost its
    least audit (two paths to a node with one cost are never prefixes of each other: inserts cost). With ``last`` the
    first final state ends the search, and is the only one returned.
    """
    bound = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        _, must, cut = rows[i]
        bound[i] = bound[i + 1] + (DELETE if must else TRUNCATED if cut else 0)
    heap, seen, found, most = [], set(), {}, None
    for state, (cost, audit) in sources.items():
        heappush(heap, (cost + bound[0], audit, 0, state, cost))
    while heap:
        total, audit, i, state, cost = heappop(heap)
        if most is not None and total > most:
            break
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows):
            if last and state in FINAL:
                return {state: (cost, audit)}
            found[state] = (cost, audit)
            if most is None and not last:
                most = total + HOPELESS
        else:
            initial, must, cut = rows[i]
            heappush(heap, (cost + DELETE + bound[i + 1], audit + "D", i + 1, state, cost + DELETE))
            if not must:
                charge = TRUNCATED if cut else 0
                kept = NEXT[state].get(initial)
                if kept is not None:
                    heappush(heap, (cost + charge + bound[i + 1], audit + "K", i + 1, kept, cost + charge))
                price = cost + REROLE + charge
                heappush(heap, (price + bound[i + 1], audit + "R", i + 1, NEXT[state][WANTED[state]], price))
        heappush(heap, (cost + INSERT + bound[i], audit + "I", i, NEXT[state][WANTED[state]], cost + INSERT))
    return found


@dataclass
class Conversation:
    """One conversation, fed row by row in order; what is decided is hashed (and kept, if asked for) at once."""

    keep: bool = False
    gaps: tuple = (None, None, 0)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    cost: int = 0
    repaired: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self._block, self._paths, self._audit, self._pending = [], {START: (0, "")}, [], deque()
        self._state, self._hash, self._any, self._before, self._initial = START, hashlib.sha256(), False, None, None

    def add(self, turn: int | None, role: str, text: str, later: bool) -> None:
        """The next row; ``later`` if a lower turn has its role and text."""
        least, most, n = self.gaps
        if turn is not None and (n == 0 or turn != most):
            self.gaps = (turn if n == 0 else least, turn, n + 1)
        initial, sound = role[:1], text.rstrip(BLANKS)
        if self._initial is not None:
            self.illegal += self._initial + initial not in LEGAL_PAIRS
        self._initial = initial
        blank, same = not sound, later or self._before == (role, text)
        self._before = (role, text)
        cut = not blank and not same and sound[-1] not in ENDS
        self.blank += blank
        self.duplicate += same and not blank
        self.truncated += cut
        must = blank or same
        self._block.append((initial, must, cut))
        self._pending.append(None if must else (role, text))
        if len(self._block) == BLOCK:
            self._paths = search(self._block, self._paths, False)
            self._block = []
            decided = commonprefix([a for _, a in self._paths.values()])
            self._decide(decided)
            self._paths = {s: (c, a[len(decided) :]) for s, (c, a) in self._paths.items()}

    def _decide(self, edits: str) -> None:
        self._audit.append(edits)
        for edit in edits:
            row = self._pending.popleft() if edit != "I" else None
            if edit == "D":
                continue
            if edit == "K":
                role, text = row
                self._state = NEXT[self._state][role[:1]]
            else:
                role, text = ROLES[WANTED[self._state]], row[1] if row else ""
                self._state = NEXT[self._state][WANTED[self._state]]
            self._hash.update((("\n" if self._any else "") + f"{role}:{text}").encode())
            self._any = True
            if self.keep:
                self.repaired.append((role, text, edit))

    def end(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of the repaired rows."""
        ((cost, rest),) = search(self._block, self._paths, True).values()
        self._decide(rest)
        least, most, n = self.gaps
        return (most - least + 1 - n if n else 0, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self._audit), self._hash.hexdigest())


def _ordered(turns: DataFrame) -> DataFrame:
    """Rows with ``conv_id, turn, role, text, _gone, _later``; a conversation's lie together in order, in one partition.

    Only (conv_id, digest) pairs that occur under several turns are joined back, by hash, and broadcast if few.
    """
    turns = turns.withColumn("_digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    spoken = turns.filter(~F.col("_gone"))
    several = spoken.groupBy("conv_id", "_digest").agg(F.min("turn").alias("_first"), F.max("turn").alias("_last"), F.max(F.col("turn").isNull()).alias("_unnumbered")).filter(F.col("_unnumbered") & F.col("_first").isNotNull() | (F.col("_first") < F.col("_last")))
    several = several.select(F.col("conv_id").alias("_conv"), F.col("_digest").alias("_same"), "_first", "_unnumbered")
    several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    joined = turns.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_digest") == F.col("_same")), "left")
    later = F.col("turn").isNotNull() & F.col("_first").isNotNull() & (F.col("_unnumbered") | (F.col("turn") > F.col("_first")))
    rows = joined.select("conv_id", "turn", "role", "text", "_gone", F.coalesce(later, F.lit(False)).alias("_later"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def _plain(turns: DataFrame, gone: str | None) -> DataFrame:
    """The four columns under fixed types and ``_gone``; null role and text are one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    left = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word("role"), word("text"), left.alias("_gone"))


def _runs(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[tuple[int | None, Conversation]]:
    """The conversations of sorted rows, each after its last row; one is held at a time."""
    known, now = False, None
    for batch in batches:
        columns = [batch.column(c) for c in ("conv_id", "turn", "role", "text", "_gone", "_later")]
        for first in range(0, batch.num_rows, 512):
            for conv, turn, role, text, gone, later in zip(*(c.slice(first, 512).to_pylist() for c in columns)):
                if not known or conv != now:
                    if known:
                        yield now, talk
                    known, now, talk = True, conv, Conversation(keep)
                if not gone:
                    talk.add(turn, role, text, later)
    if known:
        yield now, talk


FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def audits(turns: DataFrame, gone: str | None = None) -> DataFrame:
    """One row for each conversation: its faults, the cheapest edits, their cost, and the digest of the repaired rows.

    ``turns`` has conv_id, turn, role, text; ``gone`` names a column that is true where a row only tells that its conversation
    exists. Rows without conv_id are one conversation; null role and text are one space; within a turn rows go by role and
    text in code-point order, rows without turn come first; repeated rows are duplicates. Other columns are ignored; an empty table gives no
    rows. A conversation passes through one task as a sorted stream, as its digest must; held are the rows that the next
    edits may still change, and one letter a row.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        out, size = [], 0
        for conv, talk in _runs(batches, False):
            out.append((conv, *talk.end()))
            size += 200 + len(out[-1][7])
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return _ordered(_plain(turns, gone)).mapInArrow(judged, "conv_id long, " + FIELDS)


def repaired_turns(turns: DataFrame, gone: str | None = None) -> DataFrame:
    """conv_id, place (from 0), role, text, edit (K, R or I): the rows that ``audits`` digests, with odd rows treated alike.

    A conversation without rows left has none here. The rows of one conversation are held until it ends.
    """

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, talk in _runs(batches, True):
            talk.end()
            for first in range(0, len(talk.repaired), 1024):
                part = talk.repaired[first : first + 1024]
                role, text, edit = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(part), pa.int64()), pa.array(range(first, first + len(part)), pa.int64()), pa.array(role), pa.array(text), pa.array(edit)], names=["conv_id", "place", "role", "text", "edit"])

    return _ordered(_plain(turns, gone)).mapInArrow(mended, "conv_id long, place long, role string, text string, edit string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with a fault each by the checksum of ``conv_id:turn`` modulo 20, and ``_gone`` for those dropped.

    0 drops the row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 sets role user; nulls are one space, in the
    checksum too. Dropped rows stay, marked, so that a conversation that loses all its rows is still known.
    """
    plain = _plain(turns, None)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = plain.withColumn("_fault", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20)
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_fault") == 0).alias("_gone"), F.explode(times).alias("_copy")).drop("_copy")
