"""Conversation repair: the search and the whole query against plain code."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from medtab.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, cost int"


def cheapest(faults, initials):
    """Shortest path by a heap of (cost, audit): the cheapest edits, ASCII-least among equals."""
    heap, done = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(faults) and state in (0, 3):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        heapq.heappush(heap, (cost + 5, audit + "I", i, cr.NEXT[state]))
        if i < len(faults):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
            if faults[i] != cr.DOOMED:
                more = 5 if faults[i] == cr.TRUNCATED else 0
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, cr.NEXT[state]))
                if initials[i] == "s" and state == 0:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, 1))
                elif initials[i] == cr.EXPECTED[state][0]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, cr.NEXT[state]))


def plain(rows):
    """The contract, row by row."""
    after = {}
    for conv, turn, role, text in rows:
        kept = after.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        kept += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    out = {}
    for conv, kept in after.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, count, seen = [], {"blank": 0, "duplicate": 0, "truncated": 0}, set()
        for _, role, text in kept:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            faults.append({None: 0, "truncated": 2}.get(fault, 1))
        initials = [r[1][:1] for r in kept]
        cost, audit = cheapest(faults, initials)
        lines, i, state = [], 0, 0
        for e in audit:
            if e == "I":
                lines.append(cr.EXPECTED[state] + ":")
            elif e == "K":
                lines.append(f"{kept[i][1]}:{kept[i][2]}")
            elif e == "R":
                lines.append(f"{cr.EXPECTED[state]}:{kept[i][2]}")
            if e != "D":
                state = 1 if e == "K" and state == 0 and initials[i] == "s" else cr.NEXT[state]
            i += e != "I"
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def collected(df):
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def talk(seed, convs, longest):
    """Rows with nulls in every column, shared turns, repeated rows, blank, cut-off and very long texts."""
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None])
            text = rng.choice(["Yes.", "No!", "Why? ", "cut off", " \t\r\n", "", None, "Ünï ", f"Text {turn}.", f"Text {turn}. ", "long " * 20000 + "." if rng.random() < 0.02 else "Ok."])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn // 2, None, turn * 3]), role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rng.shuffle(rows)
    return rows


def test_search_equals_a_shortest_path():
    rng = random.Random(5)
    for _ in range(1500):
        n = rng.randrange(0, 40)
        faults, initials = [rng.choice([0, 0, 0, 1, 2]) for _ in range(n)], [rng.choice("suaat") for _ in range(n)]
        assert cr.search(faults, initials, 0)[:2] == cheapest(faults, initials)


def test_estimates_never_exceed_what_is_left_to_pay():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(0, 60)
        faults, initials = [rng.choice([0, 0, 1, 2]) for _ in range(n)], [rng.choice("sua") for _ in range(n)]
        table = cr.estimates(faults, initials)
        for i in range(n):
            for state in range(4):
                found = cr.search(faults[i:], initials[i:], state)
                assert table[i][state] <= found[0]


def test_a_state_without_a_way_on_ends_the_search():
    never = cr.NEVER
    assert cr.search([0, 1], ["u", "a"], cr.USER, (0, never, never, never)) is None
    assert cr.search([1], ["u"], cr.START, (never, 0, never, never)) is None
    assert cr.search([0], ["s"], cr.START, (never, 0, never, never)) == (0, "K", cr.SYSTEM)


@pytest.mark.parametrize(("most", "block"), [(cr.WHOLE, cr.BLOCK), (6, 4), (0, 1)])
def test_repair_equals_plain_code(spark, most, block):
    rows = talk(most + 1, 60, 30)
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA)
    assert collected(cr.repair(df, most, block)) == plain(rows)


def test_one_row_a_hundred_times_and_an_empty_table(spark):
    rows = [(1, 5, "user", "Hello.")] * 100 + [(1, 6, "assistant", "Hi.")] + [(2, None, None, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert collected(cr.repair(df, 10, 3)) == plain(rows) == collected(cr.repair(df))
    assert cr.repair(df.limit(0)).collect() == []


def test_query_equals_plain_code(spark):
    from medtab.llm.queries import op11_conversation_repair

    sf_dir = "/root/testdata/sf0.001"

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(op11_conversation_repair(spark, sf_dir)) == plain(rows)
