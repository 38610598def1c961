"""Conversation repair against all edits of short conversations, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair as cr

ROWS = "conv_id long, turn long, role string, text string, fault string, lost boolean, dropped boolean"


def faults(rows):
    """(role, text, fault) of rows (turn, role, text), by turn."""
    found, seen = [], set()
    order = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    for _, role, text in order:
        body = text.strip(cr.WHITE)
        found.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""))
        seen.add((role, text))
    return found


def every_repair(rows):
    """The least (cost, audit, repaired) of all edits, with up to two turns inserted anywhere."""
    added = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    ways = [(0, "", ())]
    for role, text, fault in rows:
        on = []
        for (cost, audit, lines), more in itertools.product(ways, added):
            before = cost + 3 * len(more), audit + "I" * len(more), lines + tuple((m, "") for m in more)
            on.append((before[0] + 4, before[1] + "D", before[2]))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                on.append((before[0] + extra, before[1] + "K", (*before[2], (role, text))))
                on += [(before[0] + extra + 3, before[1] + "R", (*before[2], (n, text))) for n in ("user", "assistant")]
        # Beginnings that can't go on are left.
        ways = [w for w in on if re.fullmatch(r"(s?(ua)*u?)?", "".join(r[:1] or "x" for r, _ in w[2]))]
    ends = [(c + 3 * len(m), a + "I" * len(m), (*s, *((n, "") for n in m))) for (c, a, s), m in itertools.product(ways, added)]
    return min(e for e in ends if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "x" for r, _ in e[2])))


def digest(lines):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def expected(rows):
    told, turns = faults(rows), [t for t, _, _ in rows if t is not None]
    cost, audit, lines = every_repair(told)
    count = lambda kind: sum(f == kind for _, _, f in told)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(told))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0), count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest(lines)


def some_conversations():
    r = random.Random(11)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why?", "é.", None, "the end . "]
    out = {}
    for i in range(150):
        out[i] = [(r.choice([0, 1, 2, 3, 5, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys", "usr"]), r.choice(texts)) for _ in range(r.randrange(1, 4))]
    out[200] = [(0, "user", "Hi."), (1, "assistant", "Hi.")] * 2
    out[201] = [(None, "user", "a"), (None, "user", "a")]
    return out


def test_repair_is_the_cheapest(spark):
    found = some_conversations()
    rows = [(i, t, r, x, "f", True, False) for i, c in found.items() for t, r, x in c]
    rows += [(None, 1, "user", "Lost?", "f", True, False), (900, 1, "user", "gone", "f", True, True), (901, 1, "user", "gone", "f", True, True), (901, 2, "user", "Here.", "f", True, False)]
    df = spark.createDataFrame(rows, ROWS)
    got = {r[0]: tuple(r[1:]) for r in cr.repair(df, F.col("dropped")).collect()}
    assert len(got) == len(found) + 3
    for i, c in found.items():
        assert got[i] == expected(c), c
    assert got[None] == expected([(1, "user", "Lost?")])
    assert got[900] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[901] == expected([(2, "user", "Here.")])
    assert cr.repair(df.limit(0)).count() == 0
    assert cr.repair(df).count() == len(got)


def plain_repair(rows):
    """The same by whole strings: a table of the best way into each state."""
    best = {cr.START: (0, "", [])}
    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, lines) in best.items():
            ways = [(state, cost + 4, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if state == cr.START and role[:1] == "s":
                    ways.append((cr.SYSTEM, cost + extra, audit + "K", [*lines, (role, text)]))
                for target, name in ((cr.USER, "user"), (cr.ASSISTANT, "assistant")):
                    fits, keeps = (state == cr.USER) == (target == cr.ASSISTANT), role[:1] == name[0]
                    other = [] if fits else [("assistant" if name == "user" else "user", "")]
                    ways.append((target, cost + extra + 3 * len(other) + 3 * (not keeps), audit + "I" * len(other) + ("K" if keeps else "R"), [*lines, *other, (role if keeps else name, text)]))
            for target, *way in ways:
                if target not in new or way[:2] < new[target][:2]:
                    new[target] = way
        best = {s: tuple(w) for s, w in new.items()}
    ends = [(c + 3 * len(cr.ENDING[s]), a + "I" * len(cr.ENDING[s]), [*ls, *((cr.NAMES[t], "") for t in cr.ENDING[s])]) for s, (c, a, ls) in best.items()]
    return min(ends, key=lambda e: e[:2])


@pytest.mark.parametrize("seed", range(6))
def test_long_conversations(seed):
    """Ties over long unresolved stretches: foreign roles only, blank rows, and a mixture."""
    r = random.Random(seed)
    kinds = [["tool"], ["user"], ["assistant", "tool"], ["user", "assistant", "system", "tool"], ["user", "assistant"], ["system", "tool"]][seed]
    rows = [(r.choice(kinds), f"text {i}", r.choice(["", "", "", "blank", "truncated"] if seed % 2 else [""])) for i in range(400)]
    repair, steps = cr.Repair(), []
    for role, text, fault in rows:
        steps += repair.row(role, text, fault == "blank", fault == "truncated")
    rest, cost, sha = repair.finish()
    assert (cost, "".join(e for e, _ in [*steps, *rest]), sha) == (lambda w: (w[0], w[1], digest(w[2])))(plain_repair(rows))


def held(repair):
    nodes = set()
    for s in repair.survivors:
        node = s.node
        while node is not None and id(node) not in nodes:
            nodes.add(id(node))
            node = node.parent
    return len(nodes)


def test_edits_are_given_out_early():
    """An ordinary conversation of any length holds a few nodes and texts of none."""
    repair, given, most = cr.Repair(), 0, 0
    for i in range(20_000):
        role = "user" if i % 97 == 5 else ("user", "assistant")[i % 2]
        given += sum(1 for _ in repair.row(role, "x" * 100, i % 53 == 7, i % 11 == 0))
        most = max(most, held(repair))
    assert most < 60 and given > 19_900


def test_repaired_turns(spark):
    """The turns themselves: their digest is the report's, their roles alternate."""
    found = some_conversations()
    df = spark.createDataFrame([(i, t, r, x, "f", True, False) for i, c in found.items() for t, r, x in c], ROWS)
    turns = {}
    for x in cr.repaired_turns(df).collect():
        turns.setdefault(x["conv_id"], []).append(x)
    for r in cr.repair(df).collect():
        mine = sorted(turns.get(r["conv_id"], []), key=lambda x: x["position"])
        assert [x["position"] for x in mine] == list(range(len(mine)))
        assert digest([(x["role"], x["text"]) for x in mine]) == r["repaired_sha256"]
        assert "".join(x["edit"] for x in mine) == r["audit"].replace("D", "")
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x["role"][0] for x in mine))


def test_damage(spark):
    rows = [(i, t, "assistant", "Is it? Yes. ") for i in range(60) for t in range(3)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for i, t, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{shown(i)}:{shown(t)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        want += [(i, t, "user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
    assert sorted(map(str, map(tuple, cr.damage(df).collect()))) == sorted(map(str, want))


def test_very_long_texts_and_rows(spark):
    """A conversation of thousands of rows beside a text of 2 MB."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"Row {i}.") for i in range(5000)] + [(2, 0, "user", "word " * 400_000 + "."), (2, 1, "assistant", "Yes.")]
    got = {r["conv_id"]: r for r in cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1]["audit"] == "K" * 5000 and got[1]["cost"] == 0 and got[2]["audit"] == "KK"
    assert got[2]["repaired_sha256"] == digest([x[2:] for x in rows[-2:]])
