"""Conversation repair against brute force, and on odd tables."""
from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest

from trajlake.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, digest int, c string"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """Uniform-cost search over all edit sequences, nothing pruned but what was settled before; (cost, audit) order."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit
        for w in "ua":
            if w in NEXT[state]:
                heapq.heappush(heap, (cost + 5, audit + "I", at, w))
        if at == len(rows):
            continue
        initial, must_go, cut = rows[at]
        heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state))
        if not must_go:
            for w in "ua":
                if w in NEXT[state]:
                    heapq.heappush(heap, (cost + 1 + 5 * cut, audit + "R", at + 1, w))
            if initial in NEXT[state]:
                heapq.heappush(heap, (cost + 5 * cut, audit + "K", at + 1, initial))


def expected(rows, damaged=False):
    """By conversation: the counts, cost, audit and digest, from the rows as they are or after the known damage."""
    out, ids = {}, {r[0] for r in rows}
    text = lambda x: " " if x is None else str(x)
    for conv in ids:
        turns = []
        for _, turn, role, said, *_ in [r for r in rows if r[0] == conv]:
            role, said = text(role), text(said)
            fault = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20 if damaged else 9
            said = "" if fault == 1 else re.sub("[.!?]", "", said) if fault == 2 else said
            turns += [(turn is not None, turn or 0, "user" if fault == 4 else role, hashlib.sha256(said.encode()).hexdigest(), said, turn)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        turns.sort(key=lambda t: t[:4])
        counts, seen, marked = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
        for _, _, role, _, said, _ in turns:
            bare = said.rstrip("\t\n\v\f\r ")
            fault = "blank" if not bare else "duplicate" if (role, said) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, said))
            if fault:
                counts[fault] += 1
            marked.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = cheapest(marked)
        left, at, state = [], 0, ""
        for edit in audit:
            role, said = (turns[at][2], turns[at][4]) if edit != "I" else ("", "")
            at += edit != "I"
            if edit != "D":
                if edit != "K":
                    role = "assistant" if state == "u" else "user"
                left.append(f"{role}:{said}")
                state = role[:1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in left))
        numbers = [t[5] for t in turns if t[5] is not None]
        illegal = sum(a + b not in ("su", "ua", "au") for (a, *_), (b, *_) in zip(marked, marked[1:]))
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def odd_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(conversations), None]:
        for i in range(rng.randrange(1, longest)):
            turn = rng.choice([i, i, i, i // 2, None, 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "ünder"])
            said = rng.choice(["Yes.", "No!", "cut", "", " \t\r\n", None, "Why?  ", f"word {i}.", f"wörd {i}  "])
            rows += [(conv, turn, role, said, "clash", 1, None)] * rng.choice([1, 1, 1, 2])
    return rows


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_search_equals_uniform_cost_search():
    kinds = {"s": ("s", False, False), "u": ("u", False, False), "a": ("a", False, False), "o": ("o", False, False), "A": ("a", False, True), "U": ("u", False, True), "x": ("u", True, False)}
    for n in range(5):
        for word in product("suaoAUx", repeat=n):
            assert repair.cheapest([(k, 1) for k in word], repair.START, repair.ENDS) == cheapest([kinds[k] for k in word])


@pytest.mark.parametrize("block", [256, 3, 1])
def test_repair_equals_brute_force(spark, block):
    """Nulls in every column, ties, repeated rows, blank and odd roles; whole, cut in blocks, and over many tasks."""
    rows = odd_rows(5, 40, 14)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    report = repair.repair(turns, block=block).cache()
    digests = {r.conv_id: r.repaired_sha256 for r in repair.repaired_digests(turns, report).collect()}
    got = {r.conv_id: (*(r[n] for n in NAMES[:-1]), digests[r.conv_id]) for r in report.collect()}
    assert got == expected(rows) and report.count() == len(got)
    left = {}
    for r in sorted(repair.repaired_turns(turns, report).collect(), key=lambda r: r.position):
        left.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(left.get(c, [])).encode()).hexdigest() for c in got} == {c: x[-1] for c, x in got.items()}


def test_long_conversation_over_tasks(spark):
    """One conversation holds nearly all rows, a third of them equal."""
    rows = [(7, i, ("user", "assistant")[i % 2] if i % 11 else "system", f"turn {i}" + "." * (i % 5 > 0), None, 0, None) for i in range(600)]
    rows += [(7, 40, "user", "again.", None, 0, None)] * 300 + [(1, 0, "user", "hi.", None, 0, None)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(6)
    report = repair.repair(turns, block=16).collect()
    assert {r.conv_id: tuple(r[n] for n in NAMES[:-1]) for r in report} == {c: x[:-1] for c, x in expected(rows).items()}


def test_query_on_damaged_rows(spark, tmp_path):
    rows = odd_rows(9, 60, 8)
    broken = repair.repaired_conversations(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in broken.collect()}
    assert got == expected(rows, damaged=True) and broken.columns == ["conv_id", *NAMES]
    assert repair.repaired_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
