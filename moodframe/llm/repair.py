"""Conversation structure repair: cheapest edits to a legal order of roles.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``.
Each row is kept (cost 0), given the role that is due (1) or deleted (2), and
rows without text may be inserted (5); blank and repeated rows must go, and a
row that breaks off costs 5 unless it is deleted.  Of the cheapest edits, the
list of their initials (D, I, K, R) that is least in ASCII is the audit.

The audit is found by Hirschberg's divide and conquer over four states (nothing
yet, after system, after user, after assistant): a forward cost vector of the
first half and a backward one of the second meet in the middle, the cheapest
crossing is fixed and both halves are solved alike.  The forward vector also
ranks its states by their least audits.  No such audit is the beginning of
another (insertions belong to the row that follows), so of several cheapest
crossings the one of least rank lies on the least audit.

Spark sorts and deals the rows by conversation; a task streams them and holds
one byte a row, and the second stream applies the audit row by row, so the
texts of a conversation are never in memory together.  A conversation has one
audit and one digest, so its rows pass through one task by definition.

Defined results: a null role or text reads as one space; rows of one turn go
by role, then text, repeated ones next to each other; null turns come first;
rows with null conversation form one conversation (its and the turns' numbers are
integers); a role other than by its initial s, u or a is never kept; a conversation without rows that is named in
``ids`` has zeros, an empty audit and the digest of no text; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
BROKEN = 5
FAR = 1 << 60
#: states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
LAWFUL = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: the state that an inserted or re-roled row leads to
DUE = (2, 2, 3, 2)
ROLE_OF = {2: "user", 3: "assistant"}
#: rows after a last one that make a conversation legal
CLOSING = (0, 2, 1, 0)
#: Runs of at most so many rows are solved with all their backward vectors.
LEAF = 32
#: a row's code: initial (2 bits), must go (4), broken off (8)
INITIALS = "sua"
GONE, CUT = 4, 8


def _moves(code: int) -> list[list[tuple[int, str] | None]]:
    """[from][to]: (cost, least edits) of one row, insertions before it included."""
    initial = "sua?"[code & 3]
    out: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for start in range(4):
        state, edits, cost = start, "", 0
        for _ in range(3):
            options = [(state, DELETE, "D")]
            if not code & GONE:
                extra = BROKEN if code & CUT else 0
                options.append((DUE[state], REROLE + extra, "R"))
                if (state, initial) in LAWFUL:
                    options.append((LAWFUL[state, initial], KEEP + extra, "K"))
            for to, more, edit in options:
                found = (cost + more, edits + edit)
                if out[start][to] is None or found < out[start][to]:
                    out[start][to] = found
            state, edits, cost = DUE[state], edits + "I", cost + INSERT
    return out


MOVES = [_moves(code) for code in range(16)]


class _Steps:
    """Cost vectors less their minimum are few, so each step is looked up."""

    def __init__(self) -> None:
        self.forward: dict[tuple, tuple[tuple, int]] = {}
        self.backward: dict[tuple, tuple[tuple, int]] = {}

    def ahead(self, vector: tuple, code: int) -> tuple[tuple, int]:
        """``vector``: (cost, rank) of each state.  The vector after a row, and
        how much its costs were lowered."""
        key = (vector, code)
        if key not in self.forward:
            best: list[tuple] = [(FAR, 0, "", to) for to in range(4)]
            for start, (cost, rank) in enumerate(vector):
                for to, move in enumerate(MOVES[code][start]):
                    if move and cost < FAR:
                        best[to] = min(best[to], (cost + move[0], rank, move[1], to))
            low = min(b[0] for b in best)
            ranked = {b[3]: i for i, b in enumerate(sorted(best, key=lambda b: b[1:3]))}
            self.forward[key] = tuple((b[0] - low if b[0] < FAR else FAR, ranked[b[3]]) for b in best), low
        return self.forward[key]

    def back(self, vector: tuple, code: int) -> tuple[tuple, int]:
        """The cheapest way on from each state before a row."""
        key = (vector, code)
        if key not in self.backward:
            best = [min((move[0] + vector[to] for to, move in enumerate(MOVES[code][start]) if move), default=FAR) for start in range(4)]
            low = min(best)
            self.backward[key] = tuple(b - low if b < FAR else FAR for b in best), low
        return self.backward[key]


_steps = _Steps()
_END = tuple(INSERT * n for n in CLOSING)


def _only(state: int) -> tuple:
    return tuple(0 if s == state else FAR for s in range(4))


def _leaf(codes: bytes, lo: int, hi: int, start: int, goal: tuple) -> tuple[str, int]:
    """Least audit of a short run to the cheapest of ``goal``, and its last state."""
    vectors = [goal]
    for i in range(hi - 1, lo - 1, -1):
        vectors.append(_steps.back(vectors[-1], codes[i])[0])
    edits, state = [], start
    for i in range(lo, hi):
        on = vectors[hi - i - 1]
        _, edit, state = min((move[0] + on[to], move[1], to) for to, move in enumerate(MOVES[codes[i]][state]) if move and on[to] < FAR)
        edits.append(edit)
    return "".join(edits), state


def audit(codes: bytes) -> tuple[str, int]:
    """(audit, cost) of a conversation given by its rows' codes."""
    parts: list[str] = []
    state = 0
    # runs still to be solved, the next one last: (from, to, costs beyond it)
    todo = [(0, len(codes), _END)]
    while todo:
        lo, hi, goal = todo.pop()
        if hi - lo <= LEAF:
            edits, state = _leaf(codes, lo, hi, state, goal)
            parts.append(edits)
            continue
        middle = (lo + hi) // 2
        forward: tuple = tuple((0 if s == state else FAR, 0) for s in range(4))
        for i in range(lo, middle):
            forward = _steps.ahead(forward, codes[i])[0]
        backward = goal
        for i in range(hi - 1, middle - 1, -1):
            backward = _steps.back(backward, codes[i])[0]
        crossing = min((forward[s][0] + backward[s], forward[s][1], s) for s in range(4))[2]
        todo.append((middle, hi, goal))
        todo.append((lo, middle, _only(crossing)))
    parts.append("I" * CLOSING[state])
    text = "".join(parts)
    return text, _cost(codes, text)


def _cost(codes: bytes, edits: str) -> int:
    worth = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
    total, i = 0, 0
    for e in edits:
        total += worth[e]
        if e != "I":
            total += BROKEN if codes[i] & CUT and e != "D" else 0
            i += 1
    return total


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Conversation:
    """What a stream of one conversation's rows, in order, adds up to."""

    def __init__(self) -> None:
        self.codes = bytearray()
        self.counts = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.turn = None
        self.turns = 0
        self.last = ""

    def add(self, turn: int | None, initial: str, blank: bool, cut: bool, first: bool, copies: int) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        plain = INITIALS.find(initial) % 4 if initial else 3
        repeats = copies - 1 if first else copies
        legal = self.last + initial in ("su", "ua", "au")
        self.counts["illegal"] += (bool(self.codes) and not legal) + copies - 1
        self.last = initial if initial in INITIALS else "?"
        if blank:
            self.counts["blank"] += copies
            self.codes += bytes([plain | GONE]) * copies
            return
        if first:
            self.counts["truncated"] += cut
            self.codes.append(plain | (CUT if cut else 0))
        self.counts["duplicate"] += repeats
        self.codes += bytes([plain | GONE]) * repeats

    def result(self) -> dict:
        text, cost = audit(bytes(self.codes))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.counts | {"gaps": gaps, "cost": cost, "audit": text}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from rows sorted by conversation and order."""
    names = ["conv_id", *COUNTS, "audit"]
    out: list[dict] = []
    open_, now = False, None
    conv = _Conversation()
    for conv_id, turn, initial, blank, cut, first, copies in _read(batches):
        if not open_ or conv_id != now:
            if open_:
                out.append({"conv_id": now} | conv.result())
            open_, now, conv = True, conv_id, _Conversation()
            if len(out) >= 1000:
                yield _batch(out, names)
                out = []
        if copies:
            conv.add(turn, initial, blank, cut, first, copies)
    if open_:
        out.append({"conv_id": now} | conv.result())
    yield _batch(out, names)


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {n: pa.int64() for n in ("conv_id", "position", *COUNTS)}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(header, None) at each conversation's beginning, then (header, (role,
    text)) for each repaired row; a header row precedes its conversation's rows."""
    header, at, state = None, 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(header["audit"]) and header["audit"][at] == "I":
            at, state = at + 1, DUE[state]
            yield header, (ROLE_OF[state], "")

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            row = dict(zip(batch.schema.names, row))
            if row["audit"] is not None:
                if header:
                    yield from inserted()
                header, at, state = row, 0, 0
                yield header, None
                continue
            for _ in range(row["copies"]):
                yield from inserted()
                edit = header["audit"][at]
                at += 1
                if edit == "D":
                    continue
                state = DUE[state] if edit == "R" else LAWFUL[state, row["role"][:1]]
                yield header, (row["role"] if edit == "K" else ROLE_OF[state], row["text"])
    if header:
        yield from inserted()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    out: list[dict] = []
    sha, some = None, False
    for header, row in _repaired(batches):
        if row is None:
            if out:
                out[-1]["repaired_sha256"] = sha.hexdigest()
            if len(out) >= 1000:
                yield _batch(out, names)
                out = []
            out.append(dict(header))
            sha, some = hashlib.sha256(), False
        else:
            sha.update((("\n" if some else "") + row[0] + ":" + row[1]).encode())
            some = True
    if out:
        out[-1]["repaired_sha256"] = sha.hexdigest()
    yield _batch(out, names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "position", "role", "text"]
    out: list[dict] = []
    position = size = 0
    for header, row in _repaired(batches):
        position = 0 if row is None else position + 1
        if row is not None:
            out.append({"conv_id": header["conv_id"], "position": position, "role": row[0], "text": row[1]})
            size += len(row[1]) + 32
            if size > 1 << 22:
                yield _batch(out, names)
                out, size = [], 0
    yield _batch(out, names)


def _ordered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, ids: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(different rows with their copies, one row a conversation with its
    counts and audit)."""
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"),
    )
    # equal rows of a turn stand next to each other: they are counted before the shuffle
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    # a null turn comes first
    when = F.struct(F.col("turn").isNotNull().alias("set"), F.coalesce("turn", F.lit(0).cast("bigint")).alias("turn"))
    keyed = rows.withColumn("said", said).withColumn("when", when)
    first = keyed.groupBy("conv_id", "said").agg(F.min("when").alias("earliest"))
    met = keyed.alias("k").join(first.alias("f"), F.expr("k.conv_id <=> f.conv_id and k.said = f.said"))
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    seen = met.select(
        "k.conv_id", "k.turn", "k.role", "k.text", "k.copies",
        F.substring("k.role", 1, 1).alias("initial"),
        (end == "").alias("blank"),
        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"),
        (F.col("k.when") == F.col("f.earliest")).alias("first"),
    )
    if ids is not None:
        none = ids.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv_id")).distinct()
        none = none.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("bigint").alias("copies"), F.lit("").alias("initial"), F.lit(True).alias("blank"), F.lit(False).alias("cut"), F.lit(True).alias("first"))
        seen = seen.unionByName(none)
    ordered = seen.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    short = ordered.select("conv_id", "turn", "initial", "blank", "cut", "first", "copies")
    audits = short.mapInArrow(_audits, "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string")
    return rows, audits


def _stream(rows: DataFrame, audits: DataFrame) -> DataFrame:
    both = rows.unionByName(audits, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "text")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", ids: DataFrame | None = None) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit and the SHA-256 of its repaired ``role:text`` lines.
    ``ids``: conversations to report even where they have no rows."""
    rows, audits = _ordered(turns, conv_col, turn_col, role_col, text_col, ids)
    kinds = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    return _stream(rows, audits).mapInArrow(_digests, kinds)


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired rows: conv_id, position (from 1), role, text."""
    rows, audits = _ordered(turns, conv_col, turn_col, role_col, text_col, None)
    return _stream(rows, audits).mapInArrow(_rows, "conv_id long, position long, role string, text string")


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows spoiled by crc32 of ``conv:turn`` modulo 20: 0 drops a row, 1
    empties its text, 2 takes its closing signs, 3 repeats it, 4 makes it the
    user's.  Nulls read as one space, there and in role and text."""
    shown = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(shown(conv_col), F.lit(":"), shown(turn_col)).cast("binary")) % 20
    text = shown(text_col)
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.when(fate == 4, "user").otherwise(shown(role_col)).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        fate.alias("fate"),
    ).filter("fate <> 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
