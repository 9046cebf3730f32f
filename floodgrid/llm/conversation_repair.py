"""Cheapest repair of conversation structure by depth-first branch and bound.

A conversation is its rows in the order of turn (nulls first; rows of one turn by a hash of role and
text). It is sound if its roles' initials read ``(s?(ua)+)?``. Each row is kept, given another role
or deleted, and empty rows may be inserted anywhere; the cheapest edits are wanted, and of equally cheap ones
those whose initials (K, R, D, I) are ASCII-least.

The search runs over nodes (rows read, state of the pattern) with an explicit stack:

* Suffix lower bounds: the cost of the remaining rows in a relaxed problem, in which system rows may be
  repeated in front and nothing need follow them.
* The incumbent is the best complete (cost, audit) so far; a prefix that cannot beat it is cut.
* A dominance table per node holds the best (cost, audit) prefix that came there; worse prefixes end.
  Prefixes that meet in a node at one cost are never prefixes of each other, so the
  comparison holds for every completion.

Conversations of any length are cut into pieces of at most ``PIECE`` rows, spread over tasks by order, and
searched for every pair of states at the ends that is still open; a conversation's pieces, about a byte a row,
then meet in one min-plus chain. Texts take part only in the end: they pass once, as a stream, by the task
that applies the edits of their conversation. Rows that are equal in all columns of one turn stand
in one task as a stream, too.

Cases: null roles and texts are one space, an empty role has no legal initial; null turns come first;
null ids are a conversation of their own; repeated rows are duplicates; an empty table gives an empty
result; further columns do not matter. A conversation's audit is one string, so at most 2^31 edits.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from floodgrid.functions.skew import join_hot
from floodgrid.runtime import write_and_read as materialize

PIECE = 256
# Fixed costs of the edits; a truncated row that stays costs the last one on top.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
# States of the pattern: nothing yet, a system row, whole pairs, an open pair.
START, SYSTEM, PAIRS, OPEN = range(4)
ACCEPTED = (START, PAIRS)
# What an inserted or renamed row makes of a state, and the role that it takes.
_NEXT = {START: OPEN, SYSTEM: OPEN, PAIRS: OPEN, OPEN: PAIRS}
_ROLE = {START: "user", SYSTEM: "user", PAIRS: "user", OPEN: "assistant"}
# In the bounds the first two states are one.
_RELAXED = {START: 0, SYSTEM: 0, PAIRS: 1, OPEN: 2}
_NEVER = 1 << 60


def keep_to(state: int, initial: str) -> int | None:
    """The state after a kept row, None where its role may not stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return None if state == OPEN else OPEN
    return PAIRS if initial == "a" and state == OPEN else None


def _edits(row: tuple[str, bool, bool], state: int) -> list[tuple[str, int, int]]:
    """(edit, state, cost) of a row (initial, to be deleted, truncated)."""
    initial, doomed, truncated = row
    out = [("D", state, DELETE)]
    if not doomed:
        more = TRUNCATED if truncated else 0
        to = keep_to(state, initial)
        if to is not None:
            out.append(("K", to, more))
        out.append(("R", _NEXT[state], REROLE + more))
    return out


def _bounds(rows: list[tuple[str, bool, bool]], ends: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """Per number of rows read and relaxed state, a cost that no completion to ``ends`` is below."""
    ends = {_RELAXED[e] for e in ends}
    front, pairs, opened = (0 if x in ends else _NEVER for x in range(3))
    out = []
    for row in [*reversed(rows), None]:
        front = min(front, INSERT + opened, 2 * INSERT + pairs)
        pairs, opened = min(pairs, INSERT + opened), min(opened, INSERT + pairs)
        out.append((front, pairs, opened))
        if row is None:
            break
        initial, doomed, truncated = row
        more = TRUNCATED if truncated else 0
        f, p, o = front + DELETE, pairs + DELETE, opened + DELETE
        if not doomed:
            f, p, o = min(f, REROLE + more + opened), min(p, REROLE + more + opened), min(o, REROLE + more + pairs)
            if initial == "s":
                f = min(f, more + front)
            elif initial == "u":
                f, p = min(f, more + opened), min(p, more + opened)
            elif initial == "a":
                o = min(o, more + pairs)
        front, pairs, opened = f, p, o
    return out[::-1]


def search(rows: list[tuple[str, bool, bool]], entry: int = START, ends: tuple[int, ...] = ACCEPTED) -> tuple[int, str] | None:
    """The least (cost, audit) that leads the rows from a state to one of ``ends``; None where nothing does."""
    bound = _bounds(rows, ends)
    best = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    edits: dict[tuple, list[tuple[str, int, int]]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        low = cost + bound[i][_RELAXED[state]]
        if low >= _NEVER or best is not None and (low > best[0] or low == best[0] and audit > best[1][: len(audit)]):
            continue
        node = (i, state)
        if node in reached and reached[node] <= (cost, audit):
            continue
        reached[node] = (cost, audit)
        if i == len(rows) and state in ends and (best is None or (cost, audit) < best):
            best = (cost, audit)
        children = [(i, _NEXT[state], cost + INSERT, audit + "I")]
        if i < len(rows):
            kind = (rows[i], state)
            if kind not in edits:
                edits[kind] = _edits(*kind)
            children += [(i + 1, to, cost + c, audit + e) for e, to, c in edits[kind]]
        # The most promising child is taken up next.
        children.sort(key=lambda c: (c[2] + bound[c[0]][_RELAXED[c[1]]], c[3]), reverse=True)
        stack.extend(children)
    return best


def apply_edits(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that remain or are new, in order."""
    state = START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = keep_to(state, role[:1])
        else:
            role, state = _ROLE[state], _NEXT[state]
        yield edit, role, text


# One string per id, so that a null id is a key like any other.
def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def _id(key: str, kind: DataType) -> Column:
    return F.when(F.col(key) != "", F.expr(f"substring({key}, 2)").cast(kind))


_SPACE = r"\x20\x09-\x0D"
_SUMS = ("blank", "duplicate", "truncated", "illegal")
_PIECES = (
    "c string, pos bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, "
    "low bigint, high bigint, turns bigint, ways array<struct<entry:int,exit:int,cost:bigint,audit:string>>"
)
_REPORT = "c string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


def _ordered(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """c, turn, h and the marks of every row, with ``pos`` in the order of the table (c, turn, h)."""
    role_of, text_of = (F.coalesce(F.col(f"`{x}`").cast("string"), F.lit(" ")) for x in (role, text))
    rows = conversations.select(
        _key(F.col(f"`{conv}`")).alias("c"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.xxhash64(role_of, text_of).alias("h"),
        F.xxhash64(text_of, F.lit(1), role_of).alias("h2"),
        F.substring(role_of, 1, 1).alias("initial"),
        (~text_of.rlike(f"[^{_SPACE}]")).alias("blank"),
        (~text_of.rlike(rf"[.!?][{_SPACE}]*\z")).alias("truncated"),
    )
    # A conversation may stand in several ranges.
    ranged = rows.repartitionByRange("c", "turn", "h").sortWithinPartitions("c", "turn", "h", "h2")
    return materialize(ranged.withColumn("pos", F.monotonically_increasing_id()))


def _pieces(ordered: DataFrame) -> DataFrame:
    """Searched pieces of conversations, in order of ``pos``."""
    keys = ["c", "h", "h2"]
    often = ordered.groupBy(*keys).agg(F.min("pos").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    again = join_hot(ordered.select(*keys, "pos"), often, keys).where("pos > first")
    # A mark stands right before the row that it is for.
    marks = again.select("c", "pos", F.lit(True).alias("mark"))
    rows = ordered.select("c", "pos", F.lit(False).alias("mark"), "turn", "initial", "blank", "truncated")
    both = rows.unionByName(marks, allowMissingColumns=True).repartition(F.shiftrightunsigned("pos", 33)).sortWithinPartitions("pos", F.desc("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece(rows: list[tuple], first: bool, last: bool) -> dict:
            found = [(r[3], r[4] or r[6], r[5] and not r[4] and not r[6]) for r in rows]
            ways = []
            for entry in (START,) if first else range(4):
                for ends in (ACCEPTED,) if last else [(e,) for e in range(4)]:
                    best = search(found, entry, ends)
                    if best is not None:
                        ways.append({"entry": entry, "exit": ends[0], "cost": best[0], "audit": best[1]})
            turns = [r[2] for r in rows if r[2] is not None]
            initials = [r[3] for r in rows]
            return {
                "c": rows[0][0],
                "pos": rows[0][1],
                "blank": sum(r[4] for r in rows),
                "duplicate": sum(r[6] and not r[4] for r in rows),
                "truncated": sum(f[2] for f in found),
                "illegal": sum(not _legal(a + b) for a, b in zip(initials, initials[1:])),
                "head": initials[0],
                "tail": initials[-1],
                "low": min(turns, default=None),
                "high": max(turns, default=None),
                "turns": len(set(turns)),
                "ways": ways,
            }

        schema = pa.schema(
            [("c", pa.string()), ("pos", pa.int64()), *[(x, pa.int64()) for x in _SUMS], ("head", pa.string()), ("tail", pa.string())]
            + [(x, pa.int64()) for x in ("low", "high", "turns")]
            + [("ways", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))]
        )
        held, marked, fresh = [], False, False
        part = None
        for batch in batches:
            out = []
            for c, pos, mark, turn, initial, blank, truncated in zip(*(column.to_pylist() for column in batch.columns)):
                if mark:
                    marked = True
                    continue
                new_part = pos >> 33 != part
                if held and (new_part or c != held[0][0] or len(held) == PIECE):
                    # Another conversation in the same range ends this one for certain.
                    ended = not new_part and c != held[0][0]
                    out.append(piece(held, fresh, ended))
                    held, fresh = [], ended
                elif new_part:
                    fresh = False
                part = pos >> 33
                held.append((c, pos, turn, initial, blank, truncated, marked))
                marked = False
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([piece(held, fresh, False)], schema=schema)

    return materialize(both.select("c", "pos", "mark", "turn", "initial", "blank", "truncated").mapInArrow(run, _PIECES))


def _chained(pieces: DataFrame) -> DataFrame:
    """Report and audit of every conversation from its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("c", pa.string()), *[(x, pa.int64()) for x in ("gaps", *_SUMS, "cost")], ("audit", pa.string())])

        def report(c, sums, span, best, done):
            low, high, turns = span
            cost, audit = min(best[e] for e in ACCEPTED if e in best)
            gaps = 0 if low is None else high - low + 1 - turns
            return {"c": c, "gaps": gaps, **sums, "cost": cost, "audit": "".join([*done, audit])}

        at = None
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                if p["c"] != at:
                    if at is not None:
                        out.append(report(at, sums, span, best, done))
                    at, sums, span, tail = p["c"], dict.fromkeys(_SUMS, 0), (None, None, 0), None
                    best, done = {START: (0, "")}, []
                for x in _SUMS:
                    sums[x] += p[x]
                sums["illegal"] += tail is not None and not _legal(tail + p["head"])
                tail = p["tail"]
                if p["low"] is not None:
                    low, high, turns = span
                    span = (p["low"] if low is None else low, p["high"], turns + p["turns"] - (high == p["low"]))
                to: dict[int, tuple[int, str]] = {}
                for w in p["ways"]:
                    if w["entry"] in best:
                        cost, audit = best[w["entry"]]
                        way = (cost + w["cost"], audit + w["audit"])
                        to[w["exit"]] = min(way, to.get(w["exit"], way))
                # What all ways have in common is decided.
                same = len(os.path.commonprefix([a for _, a in to.values()]))
                done.append(next(iter(to.values()))[1][:same])
                best = {s: (cost, audit[same:]) for s, (cost, audit) in to.items()}
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_pylist([report(at, sums, span, best, done)], schema=schema)

    ordered = pieces.repartition("c").sortWithinPartitions("c", "pos")
    return materialize(ordered.mapInArrow(run, _REPORT))


def conversation_report(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Key ``c``, gaps, counts of faults, cost and audit of every conversation."""
    return _chained(_pieces(_ordered(conversations, conv, turn, role, text)))


def repaired_rows(
    conversations: DataFrame, report: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """c, place (from 0), edit, role and text of the repaired conversations, each whole and in order in one partition."""
    role_of, text_of = (F.coalesce(F.col(f"`{x}`").cast("string"), F.lit(" ")) for x in (role, text))
    rows = conversations.select(
        _key(F.col(f"`{conv}`")).alias("c"),
        F.lit(1).alias("kind"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.xxhash64(role_of, text_of).alias("h"),
        role_of.alias("role"),
        text_of.alias("text"),
    )
    audits = report.select("c", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(0).cast("long").alias("h"), F.lit("").alias("role"), F.col("audit").alias("text"))
    # The same order as the search's; rows of one hash are equal.
    both = audits.unionByName(rows).repartition("c").sortWithinPartitions("c", "kind", "turn", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        audit, spot, place, state = "", 0, 0, START
        at = None

        def inserted():
            nonlocal spot, place, state
            while spot < len(audit) and audit[spot] == "I":
                out.append((at, place, "I", _ROLE[state], ""))
                spot, place, state = spot + 1, place + 1, _NEXT[state]

        for batch in batches:
            for c, kind, own, words in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if kind == 0:
                    inserted()
                    at, audit, spot, place, state = c, words, 0, 0, START
                    continue
                inserted()
                edit = audit[spot]
                spot += 1
                if edit == "D":
                    continue
                if edit == "K":
                    state = keep_to(state, own[:1])
                else:
                    own, state = _ROLE[state], _NEXT[state]
                out.append((at, place, edit, own, words))
                place += 1
            yield _batch(out)
            out = []
        inserted()
        yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["c", "place", "edit", "role", "text"])

    return both.select("c", "kind", "role", "text").mapInArrow(run, "c string, place bigint, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """c and the SHA-256 of the newline-joined ``role:text`` of repaired rows, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for batch in batches:
            names, sums = [], []
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if c != at:
                    if sha is not None:
                        names.append(at)
                        sums.append(sha.hexdigest())
                    at, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sums, pa.string())], ["c", "sha"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([sha.hexdigest()])], ["c", "sha"])

    return repaired.select("c", "role", "text").mapInArrow(run, "c string, sha string")


def repair(conversations: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per id of ``ids`` (of the conversations if not given): faults, cost, audit and digest of the repair.

    Ids without rows have no faults, no edits and the digest of an empty string.
    """
    named = conversations if ids is None else ids
    kind = named.schema[conv].dataType
    report = conversation_report(conversations, conv, turn, role, text)
    sums = digests(repaired_rows(conversations, report, conv, turn, role, text))
    every = named.select(_key(F.col(f"`{conv}`")).alias("c")).distinct()
    joined = every.join(report, "c", "left").join(sums, "c", "left")
    zero = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("gaps", *_SUMS, "cost")]
    empty = F.lit(hashlib.sha256().hexdigest())
    return joined.select(_id("c", kind).alias(conv), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", empty).alias("repaired_sha256"))


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of conversations after faults that their keys' checksums choose: some are dropped,
    emptied, robbed of their sentence ends, repeated, or given to the user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(f"`{conv}`").cast("string"), space), F.lit(":"), F.coalesce(F.col(f"`{turn}`").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    role_of, text_of = (F.coalesce(F.col(f"`{x}`").cast("string"), space) for x in (role, text))
    rows = conversations.select(
        F.col(f"`{conv}`").alias(conv),
        F.col(f"`{turn}`").alias(turn),
        F.when(fault == 4, "user").otherwise(role_of).alias(role),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text_of, "[.!?]", "")).otherwise(text_of).alias(text),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"),
    )
    # A column of the table named like the count cannot clash: only four are taken.
    return rows.where("times > 0").withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select(conv, turn, role, text)
