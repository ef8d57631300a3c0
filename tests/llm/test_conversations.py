"""Conversation repair beside a search over all edits, beside its SQL, and with conversations over many tasks."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from memlake.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, place int, present int"
FORM = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\v\f\r"


def damaged(rows):
    for conv, turn, role, text in rows:
        sp = lambda v: " " if v is None else v
        k = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = "user" if k == 4 else sp(role), sp(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        if k:
            yield from [(conv, turn, role, text)] * (2 if k == 3 else 1)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))


def faults(rows):
    seen = set()
    for _, _, role, text in rows:
        solid = text.rstrip(SPACE)
        yield "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))


def searched(rows, found):
    """Every way to keep, set, delete and insert, at most three inserts at a place: (cost, audit, lines)."""
    choices = []
    for (_, _, role, text), fault in zip(rows, found, strict=True):
        own, stay = [(2, "D", [])], 5 if fault == "truncated" else 0
        if fault in ("", "truncated"):
            own += [(stay, "K", [(role, text)]), (1 + stay, "R", [("user", text)]), (1 + stay, "R", [("assistant", text)])]
        choices += [own]
    inserts = [(5 * n, "I" * n, [(r, "") for r in roles]) for n in range(3) for roles in itertools.product(("user", "assistant"), repeat=n)]
    places = [inserts]
    for own in choices:
        places += [own, inserts]
    best = None
    partial = [(0, "", [])]
    for options in places:  # all prefixes that can still become well formed
        step = {}
        for (c, a, lines), (c2, a2, more) in itertools.product(partial, options):
            new = lines + more
            said = "".join(r[:1] or "-" for r, _ in new)
            if FORM.fullmatch(said) or FORM.fullmatch(said + "a") or FORM.fullmatch(said + "ua"):
                step.setdefault((said[-1:], len(said) > 0), []).append((c + c2, a + a2, new))
        partial = [min(v) for v in step.values()]  # one for each last initial: what follows hangs on it only
    ended = [p for p in partial if FORM.fullmatch("".join(r[:1] or "-" for r, _ in p[2]))]
    best = min(ended)
    return best


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = in_order([r for r in damaged(rows) if r[0] == conv])
        found = list(faults(own))
        turns = [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] for r in own]
        cost, audit, lines = searched(own, found)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        )
    return out


def random_rows(seed, convs=60):
    draw = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(draw.randrange(1, 9)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "Sam", "s", ""])
            text = draw.choice(["Yes.", "No!", "so what", "", None, " \n", f"{turn}?", "x" * 30, "é.\t"])
            rows.append((conv, draw.choice([turn, turn, turn, None, turn * 3]), role, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA)


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_search(spark, seed):
    rows = random_rows(seed)
    got = C.repair(C.damage(frame(spark, rows))).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == expected(rows)
    assert len(got) == len({r[0] for r in rows})


def test_equals_sql(spark):
    rows = random_rows(9, 200)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    said = con.execute(C.oracle())
    names = [c[0] for c in said.description]
    got = C.repair(C.damage(frame(spark, rows))).collect()
    assert sorted(said.fetchall(), key=repr) == sorted((tuple(r[c] for c in names) for r in got), key=repr)


def test_long_conversation_over_many_tasks(spark, monkeypatch):
    """One conversation holds most rows: pieces of seven turns, three to a group, equal one walk over all turns."""
    monkeypatch.setattr(C, "PIECE", 7)
    monkeypatch.setattr(C, "FAN", 3)
    draw = random.Random(4)
    rows = [(5, t // 2, draw.choice(["user", "assistant", "system"]), draw.choice(["Yes.", "no", f"{t}.", f"{t}", ""])) for t in range(700)] + random_rows(6, 10)
    own = in_order([r for r in damaged(rows) if r[0] == 5])
    found = list(faults(own))
    got = {r.conv_id: r for r in C.repair(C.damage(frame(spark, rows))).collect()}
    codes = ["-" if f in ("blank", "duplicate") else r[2][0].upper() if f else r[2][0] for r, f in zip(own, found, strict=True)]
    state = C.INSERTS
    for c in codes:
        state = C.product(state, C.turn_matrix(c))
    assert (got[5].cost, got[5].audit) == C.cheapest(state)
    assert (got[5].blank, got[5].duplicate, got[5].truncated) == tuple(found.count(k) for k in ("blank", "duplicate", "truncated"))
    assert {k: tuple(r[c] for c in COLUMNS) for k, r in got.items() if k != 5} == {k: v for k, v in expected([r for r in rows if r[0] != 5 or r[1] is None]).items() if k != 5}


def test_product_is_associative():
    draw = random.Random(2)
    for _ in range(200):
        codes = "".join(draw.choice("suaoSUAO-") for _ in range(12))
        i, j = sorted(draw.sample(range(13), 2))
        whole = C.piece_matrix(codes)
        assert whole == C.product(C.product(C.piece_matrix(codes[:i]), C.piece_matrix(codes[i:j])), C.piece_matrix(codes[j:]))


def test_repaired_turns_are_well_formed(spark):
    rows = random_rows(11)
    lines = C.repaired_turns(C.damage(frame(spark, rows))).collect()
    by_conv: dict = {}
    for r in lines:
        by_conv.setdefault(r.conv, []).append(r)
    for conv, own in by_conv.items():
        own.sort(key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own))) and FORM.fullmatch("".join(r.role[0] for r in own))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == expected([r for r in rows if r[0] == conv])[conv][-1]


def test_rows_all_dropped_and_empty_table(spark):
    conv = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = C.repair(C.damage(frame(spark, [(conv, 0, "user", "Hi.")]))).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.repair(C.damage(frame(spark, []))).collect() == []
