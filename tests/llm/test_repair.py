"""Conversation repair against a plain dynamic programme over whole strings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from moodframe.llm import repair
from moodframe.llm.queries import QUERIES

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain_audit(rows):
    """rows: (initial, must go, broken off).  Whole strings of every state, kept per state."""
    now = {0: (0, "")}
    for initial, gone, cut in rows:
        seen = dict(now)
        for _ in range(3):  # insertions before the row
            for state, (cost, text) in list(seen.items()):
                to = 3 if state == 2 else 2
                seen[to] = min(seen.get(to, (1 << 40, "")), (cost + 5, text + "I"))
        after = {}
        for state, (cost, text) in seen.items():
            edits = [("D", 2, state)]
            if not gone:
                edits.append(("R", 1 + 5 * cut, 3 if state == 2 else 2))
                if (state, initial) in STEP:
                    edits.append(("K", 5 * cut, STEP[state, initial]))
            for e, worth, to in edits:
                after[to] = min(after.get(to, (1 << 40, "")), (cost + worth, text + e))
        now = after
    ends = [(c + 5 * {0: 0, 1: 2, 2: 1, 3: 0}[s], t + "I" * {0: 0, 1: 2, 2: 1, 3: 0}[s]) for s, (c, t) in now.items()]
    return min(ends)[::-1]


@pytest.mark.parametrize("leaf", [1, 3, 32])
def test_audit_is_the_least_of_the_cheapest(monkeypatch, leaf):
    monkeypatch.setattr(repair, "LEAF", leaf)
    rng = random.Random(leaf)
    for _ in range(1500):
        rows = [(rng.choice("suuuaaat"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.choice([0, 1, 2, 5, 9, 40, 130]))]
        rows = [(i, g, c and not g) for i, g, c in rows]
        codes = bytes("suat".index(i) | 4 * g | 8 * c for i, g, c in rows)
        assert repair.audit(codes) == plain_audit(rows)


def test_long_conversation_is_quick_and_small():
    rng = random.Random(5)
    codes = bytes(rng.choice([0, 1, 2, 3, 5, 9, 10]) for _ in range(200_000))
    text, cost = repair.audit(codes)
    assert sum(c != "I" for c in text) == len(codes) and cost > 0


def spoiled(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = lambda v: " " if v is None else str(v)
        fate = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def plain(rows, ids):
    """(answers, repaired rows) by conversation."""
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:])
    answers, fixed = {}, {}
    for conv in {*ids, *by}:
        mine = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in mine if t is not None]
        seen, marked = set(), []
        blank = duplicate = truncated = illegal = 0
        for i, (_, role, text) in enumerate(mine):
            said = text.rstrip(" \t\n\x0b\x0c\r")
            is_blank, again = not said, (role, text) in seen
            cut = not is_blank and not again and said[-1] not in ".!?"
            blank, duplicate, truncated = blank + is_blank, duplicate + (again and not is_blank), truncated + cut
            illegal += i > 0 and mine[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
            seen.add((role, text))
            marked.append((role[:1], is_blank or again, cut))
        audit, cost = plain_audit(marked)
        lines, state, i = [], 0, 0
        for e in audit:
            role, text = mine[i][1:] if e != "I" else ("", "")
            i += e != "I"
            if e == "D":
                continue
            state = STEP[state, role[:1]] if e == "K" else 3 if state == 2 else 2
            lines.append((role if e == "K" else {2: "user", 3: "assistant"}[state], text))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        answers[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)
        fixed[conv] = lines
    return answers, fixed


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(1)
    texts = ["Yes.", "No!", "So what", "", " \t\n", "Why?  \n", None, "é　.", "a " * 30000 + "."]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 5, 8, 13, 21]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for c in [*range(60), None] for _ in range(rng.randrange(1, 9))]
    rows += [(70, t, "user" if t % 2 else "assistant", "Same words.") for t in range(3000)]
    rows += [(71, t, ["user", "assistant", "system"][t % 3], f"Words {t}" + "." * (t % 5)) for t in range(3000)]
    rows += [(72, 1, "user", "Yes.")] * 5 + [(1, 4, "user", "Yes.")] * 3
    # crc32("73:t") % 20 == 0 drops the only row
    lost = next(t for t in range(1000) if zlib.crc32(f"73:{t}".encode()) % 20 == 0)
    return [*rows, (73, lost, "user", "Gone.")]


def test_query_equals_plain(spark, odd):
    turns = spark.createDataFrame([(*r, "x", 7) for r in odd], "conv_id long, turn long, role string, text string, audit string, copies int")
    want, fixed = plain(spoiled(odd), {r[0] for r in odd})
    got = repair.repair(repair.damage(turns), ids=turns.select("conv_id")).collect()
    assert len(got) == len(want) and {r["conv_id"]: tuple(r)[1:] for r in got} == want
    rows = repair.repaired(repair.damage(turns)).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["position"]):
        by[r["conv_id"]].append((r["role"], r["text"]))
    assert by == {c: lines for c, lines in fixed.items() if lines}
    assert want[73] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_and_registered(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(repair.damage(none), ids=none.select("conv_id")).collect() == []
    assert repair.repaired(none).collect() == []
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want, _ = plain(spoiled(rows), {r[0] for r in rows})
    assert {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op13_structure_repair"](spark, sf).collect()} == want
