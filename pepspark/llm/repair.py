"""Conversation structure: faults of every conversation and its cheapest repair, by branch and bound."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import growing, materialize, source_columns

#: ASCII white space.
SPACES = " \t\n\x0b\f\r"
#: Pairs of role initials that may follow each other.
LEGAL = {"su", "ua", "au"}

# A row is one byte: the class of its role initial, and whether it must go or costs three more if it stays.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
CLASS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
GONE, CUT_OFF = 4, 8
# States of ``(s?(ua)+)?`` are named by the last role said; nothing said is 0.  What a new user or assistant turn leads to:
SAID = (USER, USER, ASSISTANT, USER)
KEEP_FROM = {SYSTEM: (0,), USER: (0, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
REROLE = INSERT = TRUNCATED = 3
DELETE = 4
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60


def suffix_bounds(codes: bytes) -> array:
    """Least cost of the rows from i on, for each state before row i, at 4 * i + state.

    The bound leaves the rule for ties aside.  After the last row only inserts are left.
    """
    n = len(codes)
    bound = array("q", bytes(32 * (n + 1)))
    after = (0, 2 * INSERT, INSERT, 0)
    bound[4 * n :] = array("q", after)
    for i in range(n - 1, -1, -1):
        code = codes[i]
        steps = [DELETE + after[state] for state in range(4)]
        if not code & GONE:
            more, role = TRUNCATED if code & CUT_OFF else 0, code & 3
            for state in range(4):
                steps[state] = min(steps[state], REROLE + more + after[SAID[state]])
            for state in KEEP_FROM.get(role, ()):
                steps[state] = min(steps[state], more + after[role])
        # At most two inserts before a row pay off: to USER, and on to ASSISTANT.
        user, assistant = min(steps[USER], INSERT + steps[ASSISTANT]), min(steps[ASSISTANT], INSERT + steps[USER])
        after = (min(steps[0], INSERT + user), min(steps[SYSTEM], INSERT + user), user, assistant)
        bound[4 * i : 4 * i + 4] = array("q", after)
    return bound


def cheapest_repair(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a conversation; of equal costs the ASCII-least audit.

    Depth-first branch and bound.  A node is (row, state); its children are Delete,
    Insert, Keep and Rerole, taken from an explicit stack in that (ASCII) order.  A
    child goes when its cost so far plus the suffix bound exceeds the incumbent's
    cost, or equals it once a complete audit is known: prefixes come in ASCII order,
    and of two prefixes of one cost at one node neither begins the other.  For the same
    reason a node's table entry, the least cost that reached it, dominates every later
    prefix that is not cheaper.  The search ends when the stack is empty, which
    proves the incumbent.  Work and memory grow with the number of rows.
    """
    n, bound = len(codes), suffix_bounds(codes)
    best, audit = bound[0], None
    reached: dict[int, int] = {}
    path: list[str] = []
    stack = [(0, 0, 0, 0, "")]
    while stack:
        depth, i, state, cost, edit = stack.pop()
        total = cost + bound[4 * i + state]
        if total > best or (audit is not None and total == best):
            continue
        node = 4 * i + state
        if reached.get(node, FAR) <= cost:
            continue
        reached[node] = cost
        del path[depth:]
        path.append(edit)
        if i == n and state in (0, ASSISTANT):
            best, audit = cost, "".join(path)
            continue
        code = codes[i] if i < n else GONE
        if not code & GONE:
            more, role = TRUNCATED if code & CUT_OFF else 0, code & 3
            stack.append((depth + 1, i + 1, SAID[state], cost + REROLE + more, "R"))
            if state in KEEP_FROM.get(role, ()):
                stack.append((depth + 1, i + 1, role, cost + more, "K"))
        stack.append((depth + 1, i, SAID[state], cost + INSERT, "I"))
        if i < n:
            stack.append((depth + 1, i + 1, state, cost + DELETE, "D"))
    return best, audit


class Rebuilt:
    """Digest of the repaired ``role:text`` lines; rows come in order, an audit says what happens to each."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.lines, self.sha = audit, 0, 0, 0, hashlib.sha256()

    def say(self, role: str, text: str) -> None:
        if self.lines:
            self.sha.update(b"\n")
        self.sha.update(f"{role}:{text}".encode())
        self.lines += 1

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = SAID[self.state]
            self.say(NAMES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str, copies: int = 1) -> None:
        for _ in range(copies):
            self.inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = CLASS[role[0]]
                self.say(role, text)
            elif edit == "R":
                self.state = SAID[self.state]
                self.say(NAMES[self.state], text)

    def digest(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): a fixed share of rows with one of five faults.

    crc32 of ``conv_id:turn`` modulo 20 decides: 0 drops the row, 1 empties its text, 2
    takes its ``[.!?]`` away, 3 repeats it, 4 makes it the user's.  A null role, text,
    or id or turn inside the key reads as one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    return (
        rows.withColumn("kind", kind)
        .filter("kind <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("kind") == 4, "user").otherwise(blank("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text")).alias("text"),
            F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
        )
    )


def undamaged(rows: DataFrame) -> DataFrame:
    """The rows as they are, in the form of ``damaged``; a null role or text reads as one space."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("copies"))


def distinct_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, again): equal rows counted, never gathered.

    ``again``: an earlier turn of the conversation has the same role and text.  The
    first turn of a text is joined back with the turn in the key, so that a text which
    every turn of a large conversation repeats is no hot key.
    """
    rows = materialize(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "turns")
    named = rows.withColumn("sha", F.unhex(F.sha2("text", 256))).withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn")))
    firsts = named.groupBy("conv_id", "role", "sha").agg(F.min("place").alias("place"))
    firsts = firsts.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("sha").alias("_sha"), F.col("place").alias("_place"))
    same = named["conv_id"].eqNullSafe(firsts["_conv"]) & (named["role"] == firsts["_role"]) & (named["sha"] == firsts["_sha"]) & (named["place"] == firsts["_place"])
    return named.join(growing(firsts), same, "left").select("conv_id", "turn", "role", "text", "copies", F.col("_sha").isNull().alias("again"))


PIECE = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_())]
    + [(c, pa.int64()) for c in ("rows", "blank", "duplicate", "truncated", "illegal")]
    + [("first_role", pa.string()), ("last_role", pa.string())]
    + [(c, pa.int64()) for c in ("min_turn", "max_turn", "turns")]
    + [("codes", pa.binary()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
)
PIECE_SQL = (
    "conv_id long, part int, seq int, whole boolean, rows long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, "
    "min_turn long, max_turn long, turns long, codes binary, cost long, audit string, repaired_sha256 string"
)


class Piece:
    """Consecutive rows of one conversation: counts, one byte a row, and the rows themselves."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.counts = dict.fromkeys(("rows", "blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.first_role = self.last_role = self.min_turn = self.max_turn = None
        self.codes, self.kept, self.size = bytearray(), [], 0

    def add(self, turn: int | None, role: str, text: str, copies: int, again: bool) -> None:
        counts, initial = self.counts, role[:1]
        if self.last_role is None:
            self.first_role = initial
        elif self.last_role + initial not in LEGAL:
            counts["illegal"] += 1
        counts["illegal"] += copies - 1
        self.last_role = initial
        counts["rows"] += copies
        if turn is not None and turn != self.max_turn:
            self.min_turn = turn if self.min_turn is None else self.min_turn
            self.max_turn = turn
            counts["turns"] += 1
        last = text.strip(SPACES)[-1:]
        code = CLASS.get(initial, OTHER)
        if not last:
            counts["blank"] += copies
            code |= GONE
        elif again:
            counts["duplicate"] += copies
            code |= GONE
        else:
            counts["duplicate"] += copies - 1
            if last not in ".!?":
                counts["truncated"] += 1
                code |= CUT_OFF
        self.codes.append(code)
        if copies > 1:
            self.codes += bytes([code | GONE]) * (copies - 1)
        self.kept.append((role, text, copies))
        self.size += len(text) + copies

    def record(self, part: int, seq: int, whole: bool) -> dict:
        row = {"conv_id": self.conv_id, "part": part, "seq": seq, "whole": whole, **self.counts}
        row |= {c: getattr(self, c) for c in ("first_role", "last_role", "min_turn", "max_turn")}
        if not whole:
            return row | {"codes": bytes(self.codes)}
        cost, audit = cheapest_repair(bytes(self.codes))
        rebuilt = Rebuilt(audit)
        for turn in self.kept:
            rebuilt.row(*turn)
        return row | {"cost": cost, "audit": audit, "repaired_sha256": rebuilt.digest()}


def pieces(rows: DataFrame, most: int = 1 << 24) -> DataFrame:
    """Conversations cut where partitions of the sorted rows end, and after about ``most`` characters.

    Rows are range-partitioned by conversation and turn, so a conversation of any length
    spreads over partitions.  A conversation that surely lies whole in one partition is
    repaired at once; of all others the counts and one byte a row go on.
    """
    order = ["conv_id", "turn", "role"]
    # A beginning of the text suffices to part rows of one turn; the sample on the driver holds no whole texts.
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first, piece = TaskContext.get().partitionId(), 0, True, None
        # ``first``: rows of this conversation may have come before, in this partition or the last.
        for batch in batches:
            out = []
            for conv_id, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece is not None and piece.conv_id != conv_id:
                    out.append(piece.record(part, seq, not first))
                    seq, first, piece = seq + 1, False, None
                elif piece is not None and piece.size >= most:
                    out.append(piece.record(part, seq, False))
                    seq, first, piece = seq + 1, True, None
                piece = piece or Piece(conv_id)
                piece.add(*turn)
            yield pa.RecordBatch.from_pylist(out, schema=PIECE)
        if piece is not None:
            yield pa.RecordBatch.from_pylist([piece.record(part, seq, False)], schema=PIECE)

    return materialize(dealt.mapInArrow(work, PIECE_SQL), "pieces")


def join_pieces(cut: DataFrame) -> DataFrame:
    """One row for each conversation that was cut; a byte a row is gathered, as its audit has to hold as much."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by([("part", "ascending"), ("seq", "ascending")]).to_pylist()
        total = dict(rows[0])
        for row in rows[1:]:
            for c in ("rows", "blank", "duplicate", "truncated", "illegal", "turns"):
                total[c] += row[c]
            total["illegal"] += total["last_role"] + row["first_role"] not in LEGAL
            total["last_role"] = row["last_role"]
            if row["min_turn"] is not None:
                total["turns"] -= total["max_turn"] == row["min_turn"]
                total["min_turn"] = row["min_turn"] if total["min_turn"] is None else total["min_turn"]
                total["max_turn"] = row["max_turn"]
        total["cost"], total["audit"] = cheapest_repair(b"".join(row["codes"] for row in rows))
        return pa.Table.from_pylist([total | {"codes": None}], schema=PIECE)

    return materialize(cut.groupBy("conv_id").applyInArrow(work, PIECE_SQL), "joined")


def rebuilt_digests(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations that were cut.

    A SHA-256 has to see a text in order, so one task reads a conversation's rows as a
    sorted stream; it holds a batch of them and the audit.
    """
    found = rows.join(growing(joined.select(F.col("conv_id").alias("_conv"))), F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    lines = found.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copies")
    heads = joined.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"))
    order = ["conv_id", "kind", "turn", "role", "text"]
    dealt = lines.unionByName(heads).repartition("conv_id").sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            done: list[tuple] = []
            for conv_id, kind, _, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if held:
                        done.append((held[0], held[1].digest()))
                    held = (conv_id, Rebuilt(text))
                else:
                    held[1].row(role, text, copies)
            yield _digest_batch(done)
        if held:
            yield _digest_batch([(held[0], held[1].digest())])

    return dealt.mapInArrow(work, "conv_id long, repaired_sha256 string")


def _digest_batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])


def repair(rows: DataFrame, damage: bool = False, most: int = 1 << 24) -> DataFrame:
    """Structure faults and the cheapest repair of every conversation.

    ``rows``: conv_id (integer), turn (integer), role, text; ``damage`` first gives a fixed share of
    rows faults of their own (``damaged``).  Rows are taken by turn, nulls first; rows of one
    turn by role, then text.  Of a row's faults the first counts: blank (white space
    only), duplicate (role and text seen earlier), truncated (last visible character
    not ``.!?``).  The repaired role initials match ``(s?(ua)+)?``; see ``cheapest_repair``
    for costs and ties.

    Returns every conv_id (null is one), gaps (missing turns between the first and last known), blank,
    duplicate, truncated, illegal (adjacent role initials other than su, ua, au), cost,
    audit, repaired_sha256 (of ``role:text`` lines).  A conversation without rows after
    damage has zeros, an empty audit and the digest of nothing.  Repeated rows each
    count; no rows, no result; other columns of the input are ignored.
    """
    rows = source_columns(rows, conv_id=F.col("conv_id").cast("long"), turn=F.col("turn").cast("long"), role=F.col("role").cast("string"), text=F.col("text").cast("string"))
    turns = materialize(distinct_rows(damaged(rows) if damage else undamaged(rows)), "marked_turns")
    cut = pieces(turns, most)
    joined = join_pieces(cut.filter("not whole"))
    digests = rebuilt_digests(turns, joined).withColumnRenamed("conv_id", "_conv")
    late = joined.drop("repaired_sha256").join(growing(digests), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    found = cut.filter("whole").unionByName(late).withColumnRenamed("conv_id", "_conv")
    ids = rows.select("conv_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return ids.join(growing(found), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id",
        zero(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns")).alias("gaps"),
        *[zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
