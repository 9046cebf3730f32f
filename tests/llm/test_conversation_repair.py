"""Conversation repair against an exhaustive search and a plain reading of the rules."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from floodgrid.llm import conversation_repair as cr

_GOOD = re.compile(r"(s?(ua)+)?")


def plain_repair(rows, most_inserts=4):
    """Least (cost, audit, repaired) over all edits of rows (role, text), by brute force."""
    faults, seen = [], set()
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None)
        seen.add((role, text))
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(faults, edits)):
            continue
        cost = sum({"D": 4, "K": 0, "R": 3}[e] + (3 if e != "D" and f == "truncated" else 0) for e, f in zip(edits, faults))
        for n in range(most_inserts + 1):
            if best is not None and cost + 3 * n > best[0]:
                break
            for gaps in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                audit = "".join("I" * gaps.count(i) + (edits[i] if i < len(rows) else "") for i in range(len(rows) + 1))
                # Roles of new and renamed rows follow from the pattern; try both.
                free = sum(e in "IR" for e in audit)
                for roles in itertools.product(("user", "assistant"), repeat=free):
                    pick, source, out = iter(roles), iter(rows), []
                    for e in audit:
                        role, text = ("", "") if e == "I" else next(source)
                        if e != "D":
                            out.append((role if e == "K" else next(pick), text))
                    if _GOOD.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                        best = min(best or (10**9, "", []), (cost + 3 * n, audit, out))
    return faults, best


def random_rows(rng, n):
    texts = ["Yes.", "no", "", " \t", "Why? ", "so it is!", "a.\nb"]
    return [(rng.choice(["user", "assistant", "system", "tool", "user", "assistant"]), rng.choice(texts)) for _ in range(n)]


def marked(rows, faults):
    return [(role[:1], f in ("blank", "duplicate"), f == "truncated") for (role, _), f in zip(rows, faults)]


@pytest.mark.parametrize("seed", range(4))
def test_search_is_exact(seed):
    rng = random.Random(seed)
    for _ in range(60):
        rows = random_rows(rng, rng.randint(0, 4))
        faults, (cost, audit, out) = plain_repair(rows)
        assert cr.search(marked(rows, faults)) == (cost, audit), rows
        assert [(r, t) for _, r, t in cr.apply_edits(audit, iter(rows))] == out


def layered(rows, entry, ends):
    """Shortest edits by a pass over layers of states, without bounds or stack."""
    def inserted(layer):
        for _ in range(3):
            for s in list(layer):
                way = (layer[s][0] + cr.INSERT, layer[s][1] + "I")
                layer[cr._NEXT[s]] = min(way, layer.get(cr._NEXT[s], way))
        return layer

    layer = inserted({entry: (0, "")})
    for row in rows:
        after = {}
        for s, (cost, audit) in layer.items():
            for e, to, c in cr._edits(row, s):
                way = (cost + c, audit + e)
                after[to] = min(way, after.get(to, way))
        layer = inserted(after)
    return min((layer[e] for e in ends if e in layer), default=None)


def test_search_of_long_pieces_between_all_states():
    rng = random.Random(9)
    for n in (1, 7, 40, 256):
        rows = [(rng.choice("suaxuaua"), rng.random() < 0.1, rng.random() < 0.2) for _ in range(n)]
        for entry in range(4):
            for ends in [cr.ACCEPTED, *[(e,) for e in range(4)]]:
                assert cr.search(rows, entry, ends) == layered(rows, entry, ends)
    # Many system rows in the middle, where the bounds are weakest.
    rows = [("s", False, False), *[(rng.choice("sssu"), False, False) for _ in range(255)]]
    assert cr.search(rows) == layered(rows, cr.START, cr.ACCEPTED)


def plain_report(conversations):
    """The query's row per conversation, from (conv, turn, role, text) rows after damage."""
    out = {}
    for conv, rows in conversations.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
        pairs = [(r or " " if r is None else r, " " if t is None else t) for _, r, t in rows]
        seen, faults = set(), []
        for role, text in pairs:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        cost, audit = layered(marked(pairs, faults), cr.START, cr.ACCEPTED)
        lines = [f"{r}:{t}" for _, r, t in cr.apply_edits(audit, iter(pairs))]
        initials = [r[:1] for r, _ in pairs]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def result(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def make_conversations(seed=4):
    rng = random.Random(seed)
    table = {}
    for conv in [*range(40), None]:
        turns = sorted(rng.sample(range(30), rng.randint(1, 12)))
        table[conv] = [(t, r, x) for t, (r, x) in zip(turns, random_rows(rng, len(turns)))]
    table[3][0] = (None, "user", "first of all.")
    table[5] = [(2, None, None), (3, "", "x."), (9, "user", "漢字 é. "), (9, "user", "漢字 é. ")]
    table[7] = [(None, "user", "alone")]
    # A conversation that holds most rows.
    table[1000] = [(i, rng.choice(["user", "assistant", "system", "tool"]), f"text {rng.randint(0, 400)}{rng.choice(['.', ''])}") for i in range(900)]
    return table


SCHEMA = "conv_id bigint, turn bigint, role string, text string, c string, pos int, kind int, audit string"


def frame(spark, table):
    rows = [(conv, *row, "c", 1, 2, "a") for conv, rows in table.items() for row in rows]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


@pytest.mark.parametrize("piece", [3, 256])
def test_repair_matches_a_plain_reading(spark, monkeypatch, piece):
    monkeypatch.setattr(cr, "PIECE", piece)
    table = make_conversations()
    assert result(cr.repair(frame(spark, table))) == plain_report(table)


def test_repaired_rows_are_sound_and_in_order(spark):
    table = make_conversations(8)
    df = frame(spark, table)
    report = cr.conversation_report(df)
    rows = {}
    for r in cr.repaired_rows(df, report).collect():
        rows.setdefault(r.c, []).append((r.place, r.edit, r.role, r.text))
    for c, found in rows.items():
        assert [f[0] for f in found] == list(range(len(found)))
        assert _GOOD.fullmatch("".join(f[2][:1] for f in found))
        assert all((f[1] == "I") <= (f[3] == "") for f in found)
    assert len(rows) > 30


def test_damage_by_checksum(spark):
    rows = [(i, j, "assistant", f"Text {i}. Is it? {j}!") for i in range(60) for j in range(5)] + [(None, None, None, None), (1, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        want += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    assert sorted(map(tuple, cr.damage(df).collect()), key=str) == sorted(want, key=str)


def test_ids_without_rows_and_empty_tables(spark):
    ids = spark.createDataFrame([("x", 1), ("y", 1), (None, 1), ("x", 2)], "conv_id string, turn int")
    rows = spark.createDataFrame([("x", 0, "user", "Hi.")], "conv_id string, turn bigint, role string, text string")
    got = result(cr.repair(rows, ids=ids))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert set(got) == {"x", "y", None} and got["y"] == got[None] == nothing and got["x"][5:7] == (3, "KI")
    assert cr.repair(rows.limit(0)).collect() == [] and len(result(cr.repair(rows.limit(0), ids=ids))) == 3
