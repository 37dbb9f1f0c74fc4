import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from bytelake.llm import conversation_repair
from bytelake.llm.conversation_repair import BlockTables, damaged, repair_conversations, tables

LEGAL = re.compile("(s?(ua)+)?")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def cheapest(rows):
    """Dijkstra over (row, roles so far as a state) with the edit string: rows ``(role, text, must go, truncated)``."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, state, lines = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, lines
        for c, name in (("u", "user"), ("a", "assistant")):
            if (state, c) in step:
                heapq.heappush(queue, (cost + 3, audit + "I", at, c, (*lines, name + ":")))
        if at < len(rows):
            role, text, gone, cut = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, state, lines))
            if not gone:
                if (state, role[:1]) in step:
                    heapq.heappush(queue, (cost + 3 * cut, audit + "K", at + 1, step[state, role[:1]], (*lines, f"{role}:{text}")))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if (state, c) in step:
                        heapq.heappush(queue, (cost + 3 + 3 * cut, audit + "R", at + 1, c, (*lines, f"{name}:{text}")))


def brute(conversations):
    out = {}
    for conv, turn, role, text in conversations:
        rows = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    found = []
    for conv, rows in out.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged, counts = set(), [], [0, 0, 0]
        for _, role, text in rows:
            blank = not text.strip(SPACE)
            again = not blank and (role, text) in seen
            cut = not blank and text.strip(SPACE)[-1] not in ".!?"
            seen.add((role, text))
            for k, x in enumerate((blank, again, cut and not again)):
                counts[k] += x
            judged.append((role, text, blank or again, cut))
        turns = {t for t, *_ in rows if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = cheapest(judged)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        found.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(found, key=str)


def corpus(seed=1, conversations=120, longest=25):
    rnd = random.Random(seed)
    rows = []
    for c in range(conversations):
        own = []
        for t in range(rnd.randrange(1, longest)):
            role = rnd.choice(["user", "assistant"]) if rnd.random() < 0.3 else ("system" if t == 0 and c % 2 else ["user", "assistant"][(t + c % 2) % 2])
            if rnd.random() < 0.05:
                role = rnd.choice(["tool", None, "", "system"])
            text = rnd.choice(["", " \n", None, "no end", "é!  ", "same.", "same."]) if rnd.random() < 0.4 else f"text {rnd.randrange(30)}."
            own.append((c, None if rnd.random() < 0.03 else t + (t > 5) * 3, role, text))
        rows += own
    return rows + [(None, 1, "user", "a"), (None, None, "user", "b."), (5, 3, "user", "tie b."), (5, 3, "user", "tie a.")] + [(9, 2, "user", "again.")] * 3


def got(spark, given, parts=3, **options):
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("_c", "_n", "audit", "_seq")})
    return sorted((tuple(r) for r in repair_conversations(df.repartition(parts), **options).collect()), key=str)


def test_matches_brute_force(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


def test_large_conversations_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "CHUNK", 5)
    rows = corpus(2, 12, 60)
    rows += [(77, t % 300, ["user", "assistant"][t % 2], f"t{t % 90}" + "." * (t % 7 > 0)) for t in range(700)]
    rows += [(78, None, "user", "the same row.")] * 300
    # (5, 3) and its like tie on text only beyond the order by text's first characters
    assert got(spark, rows, rows=9) == brute(rows)
    assert got(spark, rows, rows=400, size=3000) == brute(rows)


def test_every_short_string_of_symbols():
    roles = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    for block in (1, 2, 3):
        t = BlockTables(block)
        for n in range(4):
            for symbols in product(range(9), repeat=n):
                rows = [("user", "", True, False) if s == 8 else (roles[s >> 1], "", False, bool(s & 1)) for s in symbols]
                cost, edits, end = t.repair(list(symbols))
                assert (cost, "".join(edits) + end) == cheapest(rows)[:2], symbols


@pytest.mark.parametrize("seed", range(40))
def test_long_strings_of_symbols(seed):
    roles = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    rnd = random.Random(seed)
    symbols = [rnd.choice([2, 4, rnd.randrange(9)]) for _ in range(rnd.randrange(90))]
    rows = [("user", "", True, False) if s == 8 else (roles[s >> 1], "", False, bool(s & 1)) for s in symbols]
    cost, edits, end = tables().repair(symbols)
    want = cheapest(rows)
    assert (cost, "".join(edits) + end) == want[:2]
    assert LEGAL.fullmatch("".join(line[0] for line in want[2]))


def test_tables_are_small():
    t = tables()
    assert len(t.vectors) < 64 and t.to.shape == (len(t.vectors), 9**t.block)


def test_damage(spark):
    rows = [(1, t, "assistant", "a. b! c?") for t in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {}
    for r in damaged(df).collect():
        found.setdefault(zlib.crc32(f"1:{r._turn}".encode()) % 20, []).append(r)
    assert all(r._gone for r in found[0]) and all(r._text == "" for r in found[1]) and all(r._text == "a b c" for r in found[2])
    assert len(found[3]) == 2 * len({r._turn for r in found[3]}) and all(r._role == "user" for r in found[4])


def test_empty_table(spark):
    assert got(spark, []) == []
