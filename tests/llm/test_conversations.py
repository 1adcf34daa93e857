"""Repair of conversations against a cheapest-path search over whole edit strings."""

import hashlib
import heapq
import random
import re
import time
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from panewise.llm.conversation_repair import damaged, repaired, search
from panewise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def cheapest(turns):
    """(cost, audit, repaired) of turns (role, text, fault), by Dijkstra over (cost, audit); the
    pattern is asked of the initials themselves."""
    heap, seen = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, rows = heapq.heappop(heap)
        initials = "".join(r[:1] for r, _ in rows)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in rows)
        if (i, initials[-1:]) in seen or not re.fullmatch("s?(ua)*u?", initials):
            continue
        seen.add((i, initials[-1:]))
        if i < len(turns):
            role, text, fault = turns[i]
            more = 3 if fault == "truncated" else 0
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, rows))
            if fault not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*rows, (role, text))))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, (*rows, (other, text))))
        for other in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, (*rows, (other, ""))))


def expected(rows):
    """The contract row by row, in Python, of (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, mine in out.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns, known = set(), [], {t for t, _, _ in mine if t is not None}
        for _, role, text in mine:
            words = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        cost, audit, text = cheapest(turns)
        faults = [f for _, _, f in turns]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        digest = hashlib.sha256(text.encode()).hexdigest()
        out[conv] = (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def same(df, rows):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len({r[0] for r in got})
    assert {r[0]: r for r in got} == expected(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(QUERIES["op13_conversation_repair"](spark, SF), rows)


def test_odd_rows(spark):
    rnd = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "User", "", None, "🎉", "ss"]
    texts = [None, "", " \n", "Yes.", "No", "Why? \t", "é漢!", "x" * 50_000, ".", "a\nuser:b."]
    rows = [(conv, rnd.choice([None, 0, 1, 2, 3, -5, 9, 40]), rnd.choice(roles), rnd.choice(texts)) for conv in [*range(40), None, -7] for _ in range(rnd.randint(1, 9))]
    rows += rows[:20] + [(900 + k, 1, "user", "Only.") for k in range(60)]
    odd = spark.createDataFrame([(*r, "clash", 7, True, 1) for r in rows], "conv_id long, turn long, role string, text string, phase string, pos int, gone boolean, seen int")
    same(repaired(damaged(odd)), rows)
    got = {r["conv_id"]: r for r in repaired(damaged(odd)).collect()}
    gone = [k for k in range(900, 960) if zlib.crc32(f"{k}:1".encode()) % 20 == 0]
    assert gone and all(tuple(got[k])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in gone)
    assert repaired(damaged(odd.limit(0))).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["", "truncated", "blank"])), max_size=9))
def test_search_is_cheapest_and_ascii_least(turns):
    marks = bytes(3 * {"system": 0, "user": 1, "assistant": 2, "tool": 3, "": 4}[r] + {"": 0, "truncated": 1, "blank": 2}[f] for r, f in turns)
    cost, audit, _ = cheapest([(r, "", f) for r, f in turns])
    assert search(marks) == (cost, audit)


def test_blocks_of_a_long_conversation(monkeypatch):
    rnd = random.Random(8)
    marks = bytes(rnd.randrange(15) for _ in range(600))
    whole = search(marks)
    monkeypatch.setattr("panewise.llm.conversation_repair.LEAST_BLOCK", 600)
    assert search(marks) == whole
    monkeypatch.undo()
    started = time.time()
    cost, audit = search(bytes(rnd.randrange(15) for _ in range(20_000)))
    assert cost > 0 and len(audit) >= 20_000 and time.time() - started < 60
