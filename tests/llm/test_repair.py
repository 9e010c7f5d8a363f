"""Conversation repair against a plain forward search that keeps whole strings."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from quaylens.llm import repair

DDL = "conv_id long, turn long, role string, text string, block long, flags string, step int, places string, key string, behind int"
SPACES = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
INSERTS = (("u", "user"), ("a", "assistant"))


def damaged(rows):  # noqa: ANN001, ANN201
    out = []
    for c, t, r, x in rows:
        role, text = (" " if v is None else v for v in (r, x))
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(ch for ch in text if ch not in ".!?")
        if fault == 4:
            role = "user"
        out += [(c, t, role, text)] * (2 if fault == 3 else 1)
    return out


def plain(rows):  # noqa: ANN001, ANN201
    rows = [(c, t, *(" " if v is None else v for v in rest)) for c, t, *rest in rows]
    rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
    seen, faults = set(), []
    for *_, role, text in rows:
        body = text.strip(SPACES)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    def closed(states):  # noqa: ANN001, ANN202
        changed = True
        while changed:
            changed = False
            for q, (cost, audit, out) in list(states.items()):
                for letter, name in INSERTS:
                    to, found = NEXT.get((q, letter)), (cost + 2, audit + "I", (*out, (name, "")))
                    if to and (to not in states or found[:2] < states[to][:2]):
                        states[to], changed = found, True
        return states

    states = closed({"": (0, "", ())})
    for (*_, role, text), fault in zip(rows, faults, strict=True):
        after: dict = {}
        late = fault == "truncated"
        for q, (cost, audit, out) in states.items():
            found = [(q, (cost + 3, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                found.append((NEXT.get((q, role[:1])), (cost + late, audit + "K", (*out, (role, text)))))
                found += [(NEXT.get((q, x)), (cost + 2 + late, audit + "R", (*out, (name, text)))) for x, name in INSERTS]
            for to, s in found:
                if to is not None and (to not in after or s[:2] < after[to][:2]):
                    after[to] = s
        states = closed(after)
    cost, audit, out = min(s for q, s in states.items() if q in ("", "a"))
    turns, letters = [r[1] for r in rows if r[1] is not None], [r[2][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    }, out


def by_id(rows):  # noqa: ANN001, ANN201
    out: dict = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r[:4]))
    return out


@pytest.fixture(scope="module")
def odd_turns(spark):  # noqa: ANN001, ANN201
    rng, rows = random.Random(5), []
    for c in [*range(120), None]:
        for t in range(rng.randrange(14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c, rng.choice([t, t, t + rng.randrange(4), None]), role, rng.choice(["a.", "b!", "c? \n", "d", "", " \n\t", None, f"x{t}", f"é{t}."])))
    clash = (7, "f", 1, "p", "k", 3)
    return spark.createDataFrame([(*r, *clash) for r in rows], DDL).repartition(5)


def check(df, rows, found, every=()):  # noqa: ANN001, ANN201
    expected, got = by_id(rows), {r.conv_id: r.asDict() for r in found.collect()}
    assert set(got) == {*expected, *every}
    for i, r in got.items():
        assert r == plain(expected.get(i, []))[0] | {"conv_id": i}


def test_the_given_conversations(spark, data):  # noqa: ANN001
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    check(turns, damaged(rows), repair.repair(repair.damage(turns), turns), {r[0] for r in rows})


def test_damage_of_odd_rows(odd_turns):  # noqa: ANN001
    rows = [tuple(r[:4]) for r in odd_turns.collect()]
    assert sorted(map(repr, damaged(rows))) == sorted(repr(tuple(r)) for r in repair.damage(odd_turns).collect())
    check(odd_turns, damaged(rows), repair.repair(repair.damage(odd_turns), odd_turns), {r[0] for r in rows})


@pytest.mark.parametrize("block_rows", [3, 512])
def test_odd_rows_in_blocks_of_any_size(odd_turns, block_rows):  # noqa: ANN001
    check(odd_turns, odd_turns.collect(), repair.repair(odd_turns, block_rows=block_rows))


def test_long_conversations_are_parted(spark):  # noqa: ANN001
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", f"z{t}", f"y{t}.", f"y{t}!"])) for t in range(1200)]
    rows += [(2, 7, "user", "same.")] * 400 + [(3, 0, "user", "x" * 3_000_000), (3, 1, "assistant", "y" * 3_000_000 + ".")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert repair.blocks_of(turns, 100).groupBy("conv_id").count().where("count > 1").count() == 3
    check(turns, rows, repair.repair(turns, block_rows=100))


def test_repaired_turns(odd_turns):  # noqa: ANN001
    expected = [(c, p, *rt) for c, rows in by_id(odd_turns.collect()).items() for p, rt in enumerate(plain(rows)[1])]
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in repair.repaired_turns(odd_turns, 4).collect())


def test_empty_tables(odd_turns):  # noqa: ANN001
    none = odd_turns.where("false")
    assert repair.repair(repair.damage(none), none).count() == 0
    got = repair.repair(none, odd_turns).collect()
    assert len(got) > 100 and all(r.audit == "" and r.cost == 0 and r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in got)


def test_ids_of_any_kind(spark):  # noqa: ANN001
    turns = spark.createDataFrame([("a", 1, "user", "x."), ("a", 2, "user", "x."), (None, 1, "assistant", "x")], "conv_id string, turn int, role string, text string")
    check(turns, turns.collect(), repair.repair(turns))


def test_a_path_is_the_least_of_the_cheapest():
    # u u u, all sound: one rerole and one insert, the insert first, since I is less than R
    flags = np.array([[1, 1, 1]], dtype=np.uint8)
    lengths, end = np.array([3]), repair.AT_END[None, :]
    costs = repair.costs_of(flags, lengths, end)
    audits, ends = repair.least_paths(flags, lengths, costs)
    assert (audits[0][0].decode() + repair.TAIL[ends[0][0]], int(costs[0, 0, 0])) == ("KIKR", 4)
