"""Conversation repair against a search of all edits."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from seqloom.llm import edits, repair

NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
SCHEMA = "conv_id long, turn long, role string, text string, m int, part int, conv string"


def cheapest(turns):
    """turns: (initial, gone, cut off) -> (cost, least audit); tries every edit, from the last turn to the first."""
    behind = {}
    for i in range(len(turns), -1, -1):
        here = {}
        for inserted in (3, 2, 1, 0):  # more than three inserted turns in a row are never needed
            for state in range(4):
                found = [(0, "")] if i == len(turns) and state in (0, 3) else []
                if inserted < 3:
                    cost, rest = here[NEXT[state][1], inserted + 1]
                    found.append((3 + cost, "I" + rest))
                if i < len(turns):
                    initial, gone, cut = turns[i]
                    cost, rest = behind[state, 0]
                    found.append((4 + cost, "D" + rest))
                    if not gone:
                        extra = 3 if cut else 0
                        if (initial, state) in (("s", 0), ("u", 0), ("u", 1), ("u", 3), ("a", 2)):
                            cost, rest = behind[{"s": 1, "u": 2, "a": 3}[initial], 0]
                            found.append((extra + cost, "K" + rest))
                        cost, rest = behind[NEXT[state][1], 0]
                        found.append((3 + extra + cost, "R" + rest))
                here[state, inserted] = min(found) if found else (1 << 40, "")
        behind = here
    return behind[0, 0]


def expected(rows):
    held, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        named = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(named.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        held[conv] += []
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            held[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for conv, turns in held.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        seen, counts, judged = set(), [0, 0, 0], []
        for _, role, text in turns:
            bare = text.strip(" \t\n\v\f\r")
            cut = bool(bare) and bare[-1] not in ".!?"
            gone = not bare or (role, text) in seen
            for k, hit in enumerate((not bare, gone and bool(bare), cut and not gone)):
                counts[k] += hit
            judged.append((role[:1], gone, cut and not gone))
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit = cheapest(tuple(judged))
        state, left, lines = 0, iter(turns), []
        for letter in audit:
            turn = next(left) if letter != "I" else None
            if letter == "K":
                lines.append(f"{turn[1]}:{turn[2]}")
                state = {"s": 1, "u": 2, "a": 3}[turn[1][0]]
            elif letter != "D":
                role, state = NEXT[state]
                lines.append(f"{role}:{turn[2] if turn else ''}")
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_edits():
    rng = np.random.default_rng(3)
    t = edits.tables()
    assert len(t.vectors) < 100 and all(min(v) == 0 for v in t.vectors)
    for _ in range(1500):
        n = rng.integers(0, 15)
        drawn = zip(rng.integers(0, 4, n), rng.random(n) < 0.2, rng.random(n) < 0.3, strict=True)
        turns = [("suax"[k], bool(gone), bool(cut)) for k, gone, cut in drawn]
        symbols = np.array([edits.GONE if g else edits.symbol(k, c) for k, g, c in turns], np.uint8)
        assert t.repaired(symbols) == cheapest(tuple(turns))


def test_blocks_agree():
    """Any block length gives the same; a part's edits follow from the vector to its right."""
    symbols = np.random.default_rng(4).integers(0, 9, 1003).astype(np.uint8)
    whole = edits.Tables(1).repaired(symbols)
    assert whole == edits.Tables(2).repaired(symbols) == edits.tables().repaired(symbols)
    t, state, out = edits.tables(), edits.START, ""
    cuts = [0, 1, 2, 500, 997, 1003]
    rights = [0]
    for lo, hi in zip(cuts[-2:0:-1], cuts[:1:-1], strict=True):
        rights.append(int(t.effect(symbols[lo:hi])[0][rights[-1]]))
    for lo, hi, right in zip(cuts, cuts[1:], rights[::-1], strict=False):
        letters, state = t.walk(symbols[lo:hi], right, state)
        out += letters
    assert out + t.ending(state) == whole[1]


def made():
    rng = np.random.default_rng(9)
    roles = ["user", "assistant", "system", "tool", "", "User", None, "ux"]
    said = ["Yes.", "No", "What?", " ", "", None, "Ünï.\n", "a" * 40 + "!", "Ok. \t", "x "]
    rows = []
    for conv in [*range(60), None, -7]:
        for turn in range(rng.integers(1, 9)):
            role = roles[rng.integers(0, 8)] if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            rows.append((conv, None if rng.random() < 0.1 else turn * (1 if rng.random() < 0.8 else 2), role, f"{conv} {turn}." if rng.random() < 0.5 else said[rng.integers(0, 10)]))
    return rows + rows[:10] + [(90, 1 << 62, "user", "Far."), (90, -(1 << 62), "user", "Far?"), (91, 5, "system", "é" * 9000)]


@pytest.mark.parametrize("few", [False, True])
def test_repair(spark, monkeypatch, hot, few):
    """As it is, and with every conversation open and dealt to many tasks."""
    rows = made()
    if few:
        monkeypatch.setattr(repair.repaired, "__defaults__", (20,))
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], SCHEMA).repartition(4)
    got = {r[0]: tuple(r)[1:] for r in repair.repair_report(df).collect()}
    want = expected(rows)
    assert got == want


def test_one_long_conversation(spark, hot):
    """One conversation holds nearly all rows, many of them equal: it is spread over the tasks."""
    rng = np.random.default_rng(8)
    rows = [(1, int(k), ["user", "assistant", "tool"][rng.integers(0, 3)], f"{rng.integers(0, 40)}{'.' if k % 3 else ''}") for k in rng.integers(0, 400, 900)]
    rows += [(c, t, "user", "hi.") for c in (0, 2) for t in range(3)]
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r[0]: tuple(r)[1:] for r in repair.repair_report(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = expected(rows)
    assert got == want


def test_nothing(spark):
    assert repair.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0
