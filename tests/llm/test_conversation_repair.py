"""Conversation repair against an exhaustive search over edits, and the block-wise form against the plain one."""

import hashlib
import random
import zlib
from itertools import product

import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry
from centflow.llm import audit_dp, conversation_repair as cr
from compare import SF, connect, difference

ROWS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
    # names that the operator uses itself
    T.StructField("conv", T.StringType()), T.StructField("gone", T.StringType()), T.StructField("chunk", T.StringType()),
    T.StructField("row", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("audit", T.StringType()),
])


def legal(roles):
    rest = roles[1:] if roles[:1] == "s" else roles
    return roles == "" or (rest != "" and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def exhaustive(rows, inserts=2):
    """(cost, audit) by trying every edit of every row and every insert of up to ``inserts`` in each gap."""
    best = None
    edits = ["D" if fault in ("blank", "duplicate") else "DKua" for _, fault in rows]
    gaps = ["", *("".join(p) for n in range(1, inserts + 1) for p in product("ua", repeat=n))]
    for choice in product(*edits):
        kept = [(initial if e == "K" else e) if e != "D" else "" for e, (initial, _) in zip(choice, rows)]
        base = sum(2 if e == "D" else (0 if e == "K" else 1) + (5 if fault == "truncated" else 0)
                   for e, (_, fault) in zip(choice, rows))
        for placed in product(gaps, repeat=len(rows) + 1):
            n = sum(map(len, placed))
            if n > inserts + 1:
                continue
            roles = "".join(g + k for g, k in zip(placed, kept)) + placed[-1]
            if any(k == "" and e != "D" for k, e in zip(kept, choice)) or not legal(roles):
                continue
            audit = "".join("I" * len(g) + ("R" if e in "ua" else e) for g, e in zip(placed, choice)) + "I" * len(placed[-1])
            found = (base + 5 * n, audit)
            best = found if best is None or found < best else best
    return best


FAULTS = ["", "", "", "truncated", "duplicate", "blank"]


def test_every_short_conversation():
    for n in range(3):
        for rows in product(product("suax ", ["", "truncated", "blank"]), repeat=n):
            assert audit_dp.repair(list(rows)) == exhaustive(rows)


def test_longer_conversations():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice("ssuuaax"), rng.choice(FAULTS)) for _ in range(rng.randint(3, 4))]
        assert audit_dp.repair(rows) == exhaustive(rows, inserts=1)


def strings(rows):
    """Best (cost, audit) of each state with audits as plain strings."""
    best = {audit_dp.START: (0, "")}
    for initial, fault in rows:
        new = {}
        for state, (cost, audit) in best.items():
            for to, price, edits in audit_dp._options(state, initial, fault):
                option = (cost + price, audit + edits)
                if to not in new or option < new[to]:
                    new[to] = option
        best = new
    return min((c + 5 * audit_dp._TAIL[s], a + "I" * audit_dp._TAIL[s]) for s, (c, a) in best.items())


@pytest.mark.parametrize("seed", range(40))
def test_stretches_chain_to_the_whole(seed):
    rng = random.Random(seed)
    weights = rng.choice(["suax", "uuu", "uuaaa", "aaa", "u", "sssuua"])
    rows = [(rng.choice(weights), rng.choice(FAULTS)) for _ in range(rng.randint(1, 120))]
    expected = strings(rows)
    assert audit_dp.repair(rows) == expected
    cuts = sorted({0, len(rows), *(rng.randint(0, len(rows)) for _ in range(rng.randint(0, 8)))})
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    cost, path, tail = audit_dp.chain([audit_dp.stretch(p) for p in parts])
    audit = "".join(audit_dp.between(p, a, b) for p, (a, b) in zip(parts, path)) + "I" * tail
    assert (cost, audit) == expected


def test_comparison_of_nodes():
    rng = random.Random(5)
    audits = audit_dp.Audits()
    nodes = [0]
    for _ in range(600):
        nodes.append(audits.append(rng.choice(nodes[-60:]), rng.choice(["D", "K", "R", "IK"])))
    for _ in range(4000):
        x, y = rng.choice(nodes), rng.choice(nodes)
        assert audits.less(x, y) == (audits.text(x) < audits.text(y))


def test_hashes_that_collide_are_verified(monkeypatch):
    monkeypatch.setattr(audit_dp, "_PRIME", 3)
    rng = random.Random(6)
    audits = audit_dp.Audits()
    nodes = [0]
    for _ in range(300):
        nodes.append(audits.append(rng.choice(nodes[-40:]), rng.choice("DIKR")))
    for _ in range(3000):
        x, y = rng.choice(nodes), rng.choice(nodes)
        if audits.depth[x] == audits.depth[y]:
            assert audits.less(x, y) == (audits.text(x) < audits.text(y))


def damaged(rows):
    """Rows (conv, turn, role, text) of each conversation after damage, in order."""
    out = {}
    for conv, turn, role, text in (r[:4] for r in rows):
        live = out.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        what = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if what == 0:
            continue
        if what == 1:
            text = ""
        if what == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        if what == 4:
            role = "user"
        live += [(turn, role, text)] * (2 if what == 3 else 1)
    for live in out.values():
        live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:32].encode(),
                                 hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
    return out


def by_hand(rows):
    out = []
    for conv, live in damaged(rows).items():
        faults, seen = [], set()
        for _, role, text in live:
            shown = text.rstrip(cr.SPACE)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else
                          "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in live if t is not None}
        cost, audit = strings([(r[:1], f) for (_, r, _), f in zip(live, faults)])
        lines, state, at = [], "", 0
        for e in audit:
            role, text = ("", "") if e == "I" else live[at][1:]
            at += e != "I"
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if state == "u" else "user"
            lines.append(f"{role}:{text}")
            state = role[:1]
        initials = [r[:1] for _, r, _ in live]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                    *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def repaired(spark, rows, chunk=cr.CHUNK):
    found = cr.audit(spark.createDataFrame([(*r[:4], "x", "y", "z", None, "p", "q") for r in rows], ROWS), chunk)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, found.collect()), key=repr)


EDGE = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes!"), (2, None, None, None), (2, 3, "user", None),
    (None, 0, "user", "Null id."), (None, 1, "assistant", "Ok."), (3, 0, "user", ""), (3, 1, "tool", "x"), (3, 9, "", "y."),
    (4, 5, "user", "same."), (4, 5, "user", "same."), (4, 6, "user", "same."), (4, -2, "assistant", " \t\x0b."), (5, None, "user", "a."),
    (5, None, "assistant", "b."), (6, 0, "assistant", "long " * 300_000 + "."), (6, 1, "user", "é ß? \n"), (7, 0, "system", "alone."),
    *[(8, n, "user" if n % 2 == 0 else "assistant", f"turn {n}.") for n in range(60)], *[(n, 0, "user", "q") for n in range(100, 160)],
]


def test_edge_rows(spark):
    assert repaired(spark, EDGE) == by_hand(EDGE)


def test_one_hot_conversation_in_small_chunks(spark, many_blocks):
    rng = random.Random(8)
    hot = [(50, n // 2 if n % 9 else None, rng.choice(["user", "user", "assistant", "system", "x", None]),
            rng.choice(["Same text.", f"text {n % 40}.", f"cut {n}", "", None])) for n in range(400)]
    rows = EDGE + hot + [(n, t, "user", f"{n} {t}.") for n in range(40, 60) for t in range(3) if n != 50]
    assert repaired(spark, rows, chunk=7) == by_hand(rows)


def test_empty_table(spark):
    assert repaired(spark, []) == []


def test_sql_twin(spark):
    name = "op13_conversation_repair"
    assert difference(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) == ""
