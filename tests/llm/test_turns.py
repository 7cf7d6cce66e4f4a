import binascii
import hashlib
import random
import re
from itertools import product

import pytest

from dawnpress.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = binascii.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def faults_of(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        ink = re.sub("[\x20\x09-\x0d]", "", text)
        found.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "whole")
        seen.add((role, text))
    return found


def outcomes(rows, faults, most):
    """All edits with at most ``most`` inserts before each row and at the end: cost, letters, repaired turns."""
    def inserts():
        return [c for n in range(most + 1) for c in product("ua", repeat=n)]

    ways = [(0, "", ())]
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        step = []
        for cost, letters, done in ways:
            for some in inserts():
                c, e, d = cost + 3 * len(some), letters + "I" * len(some), done + tuple((x, {"u": "user", "a": "assistant"}[x], "") for x in some)
                step.append((c + 4, e + "D", d))
                if fault in ("whole", "truncated"):
                    more = 3 * (fault == "truncated")
                    step.append((c + more, e + "K", d + ((role[:1] or "?", role, text),)))
                    step += [(c + 3 + more, e + "R", d + ((x[0], x, text),)) for x in ("user", "assistant")]
        ways = [w for w in step if re.fullmatch(r"(s?(ua)*u?)?", "".join(x[0] for x in w[2]))]
    for cost, letters, done in ways:
        for some in inserts():
            end = done + tuple((x, {"u": "user", "a": "assistant"}[x], "") for x in some)
            if LEGAL.fullmatch("".join(x[0] for x in end)):
                yield cost + 3 * len(some), letters + "I" * len(some), end


def brute(rows, most=1):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults = faults_of(rows)
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit, done = min(outcomes(rows, faults, most))
    text = "\n".join(f"{role}:{text}" for _, role, text in done)
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def conversation(conv, draw, n):
    texts = ["Yes.", "No!", "cut", "", " \t", "Why?\n", "é.", "x. y"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    turn = draw.choice([0, 0, 5])
    rows = []
    for _ in range(n):
        rows.append((conv, draw.choice([turn, turn, turn, None]), draw.choice(roles), draw.choice([*texts, None])))
        turn += draw.choice([1, 1, 1, 0, 3])
    return rows


def grouped(rows):
    found = {}
    for r in rows:
        found.setdefault(r[0], []).append(r)
    return found


@pytest.mark.parametrize(("seed", "bits"), [(1, 12), (2, 1), (3, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, bits):
    monkeypatch.setattr(turns, "BLOCK_BITS", bits)
    draw = random.Random(seed)
    rows = [r for conv in range(60) for r in conversation(conv if conv else None, draw, draw.randrange(1, 5))]
    after = grouped(brute_damage(rows))
    want = {conv: brute(after[conv], 2 if len(after[conv]) < 3 else 1) if conv in after else (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for conv in grouped(rows)}
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", cost int, place string")
    found = turns.repair_damaged(docs)
    assert {r.conv_id: tuple(r)[1:] for r in found.collect()} == want and found.count() == len(want)


def forward(codes):
    """Cheapest cost and first letters by a table over states, one insert at most before each turn."""
    best = {turns.START: (0, "")}
    for code in codes:
        for state, (cost, letters) in list(best.items()):
            to = turns.NEXT[state]
            best[to] = min(best.get(to, (turns.NEVER, "")), (cost + 3, letters + "I"))
        new = {}
        for state, (cost, letters) in best.items():
            for letter, ahead, head, more in turns.ARCS[code][state]:
                if ahead:
                    new[head] = min(new.get(head, (turns.NEVER, "")), (cost + more, letters + letter))
        best = new
    return min((c + turns.ENDING[s], e + turns.ENDED[s]) for s, (c, e) in best.items())


@pytest.mark.parametrize("size", [1, 7, 64, 5000])
def test_blocks_agree_with_one_pass(size):
    draw = random.Random(size)
    codes = "".join(draw.choices(sorted(turns.ARCS), k=400))
    parts = [codes[i : i + size] for i in range(0, len(codes), size)]
    cost, ends = turns.block_ends([turns.distances(p) for p in parts])
    state, audit = turns.START, ""
    for part, end in zip(parts, ends, strict=True):
        letters, exits = turns.edits(part, end)
        audit, state = audit + letters[state], exits[state]
    assert (cost, audit + turns.ENDED[state]) == forward(codes)


def test_prices_are_dual_feasible_and_tight():
    codes = "".join(random.Random(4).choices(sorted(turns.ARCS), k=300))
    prices = turns.auction(codes, turns.ENDING)
    for i, code in enumerate(codes):
        for state in turns.STATES:
            heads = [cost + prices[i + ahead][head] for _, ahead, head, cost in turns.ARCS[code][state]]
            assert prices[i][state] == min(heads)


def test_a_conversation_of_many_turns(spark):
    draw = random.Random(9)
    rows = [(1, i, draw.choice(["user", "assistant", "system"]), draw.choice(["Yes %d." % i, "no", "No!"])) for i in range(20000)]
    rows += [(2, 0, "user", "Hello."), (2, 1, "assistant", "Hi.")]
    repair = turns.Repair(spark.createDataFrame(rows, SCHEMA).repartition(7))
    found = {r.conv_id: r for r in repair.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    codes = "".join(turns.code_of(r[2][0], f) for r, f in zip(rows[:20000], faults_of(rows[:20000]), strict=True))
    assert (found[1].cost, found[1].audit) == forward(codes) and found[2].audit == "KK"
    lines = sorted(tuple(r) for r in repair.turns().collect())
    text = "\n".join(f"{role}:{text}" for conv, _, role, text in lines if conv == 1)
    assert hashlib.sha256(text.encode()).hexdigest() == found[1].repaired_sha256
    assert LEGAL.fullmatch("".join(r[2][0] for r in lines if r[0] == 1))


def test_empty_table(spark):
    assert turns.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []
