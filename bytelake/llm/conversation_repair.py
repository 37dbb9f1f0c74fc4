"""Repair of conversation structure by Four-Russians block tables.

A row of a conversation is one of nine symbols (its role's initial and whether it is truncated; blank and duplicate rows are one symbol).  The roles
of a repaired conversation read ``(s?(ua)+)?``: four states (nothing yet, after the system row, a reply is due, complete).  The costs of finishing
from each state are a vector; less its minimum, only a few vectors exist.

1. Tables.  For each vector and each block of four symbols the vector before the block and the cost added are computed once.
2. Lookup.  A conversation is read from its end, one table entry a block; only the vectors between blocks are kept.
3. Trace.  Blocks are expanded backward into vectors between their symbols, then edits are chosen from the left, each the ASCII-least
   letter among the cheapest.  A letter fixes the next state, so the string is the least of all cheapest ones; expansions are kept by (vector, block, state).

Conversations of at most ``rows`` rows and ``size`` bytes of text are handled whole, one after the other, in tasks dealt by conversation.  Larger
ones (one may hold a third of all rows) are cut into chunks in order of their rows: a chunk's table of all vectors is computed in
parallel, chunks are composed from the end, then each is traced in parallel.  Their hash streams through one task in bounded memory.

Rows are taken by turn (nulls first); ties by role, the first 32 characters of the text and a hash of it.  A row's role counts by its first
character (no role at all: none of ``s``, ``u``, ``a``).

Defined results: null conv_id and turn read as one space in the damage key, null role and text as one space; a null conv_id is a
conversation of its own; equal rows are separate rows (so all but one are duplicates); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored
from .registry import query, table

BLOCK = 4
WHOLE_ROWS = 20_000
WHOLE_BYTES = 32 << 20
CHUNK = 4096

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
MUST_GO = 8
_CLASSES = {"s": 0, "u": 1, "a": 2}
_INSERTED = (2, 2, 3, 2)  # state after an inserted (or rerolled) user or assistant row
_KEPT = {(0, 0): 1, (1, 0): 2, (1, 1): 2, (1, 3): 2, (2, 2): 3}  # (role class, state) -> state
_ROLE = {2: "user", 3: "assistant"}
_NOT_BLANK = r"[^\x20\x09-\x0D]"


def _closed(v: list[int]) -> list[int]:
    """Costs with any rows inserted first."""
    two, three = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return [min(v[0], INSERT + two), min(v[1], INSERT + two), two, three]


def _before(v: tuple[int, ...], symbol: int) -> list[int]:
    """Costs of finishing from each state in front of a symbol, from those behind it."""
    out = [DELETE + c for c in v]
    if symbol != MUST_GO:
        role, extra = symbol >> 1, TRUNCATED * (symbol & 1)
        for state in range(4):
            costs = [out[state], REROLE + extra + v[_INSERTED[state]]]
            if (role, state) in _KEPT:
                costs.append(KEEP + extra + v[_KEPT[role, state]])
            out[state] = min(costs)
    return _closed(out)


class BlockTables:
    """All cost vectors, and for each vector and block of symbols the vector in front of it and the cost added."""

    def __init__(self, block: int = BLOCK):
        unreached = 1 << 20
        last = _closed([0, unreached, unreached, 0])
        self.block, self.vectors, self.end = block, [tuple(last)], 0
        step, at = [], 0
        while at < len(self.vectors):
            row = []
            for symbol in range(9):
                costs = _before(self.vectors[at], symbol)
                vector = tuple(c - min(costs) for c in costs)
                if vector not in self.vectors:
                    self.vectors.append(vector)
                row.append((self.vectors.index(vector), min(costs)))
            step.append(row)
            at += 1
        self.one = np.array([[v for v, _ in row] for row in step], np.int64)
        self.one_cost = np.array([[c for _, c in row] for row in step], np.int64)
        codes = np.arange(9**block)
        to = np.repeat(np.arange(len(self.vectors))[:, None], len(codes), axis=1)
        cost = np.zeros_like(to)
        for k in range(block):  # the last symbol of a block is the lowest digit
            symbol = codes // 9**k % 9
            cost += self.one_cost[to, symbol]
            to = self.one[to, symbol]
        self.to, self.cost = to, cost
        self.expand = functools.cache(self._expand)

    def blocks(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """``(leading symbols, block codes)``: full blocks end at the last symbol."""
        head = len(symbols) % self.block
        codes = []
        for at in range(head, len(symbols), self.block):
            code = 0
            for s in symbols[at : at + self.block]:
                code = code * 9 + s
            codes.append(code)
        return symbols[:head], codes

    def boundaries(self, symbols: list[int], vector: int) -> tuple[list[int], list[int], list[int], int]:
        """``(leading symbols, block codes, vector behind the leading symbols and behind each block, vector in front of all)`` from the
        vector behind the symbols."""
        head, codes = self.blocks(symbols)
        behind = [vector]
        for code in reversed(codes):
            vector = int(self.to[vector, code])
            behind.append(vector)
        for s in reversed(head):
            vector = int(self.one[vector, s])
        return head, codes, behind[::-1], vector

    def summary(self, symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
        """Per vector behind the symbols: the vector in front, the cost added, and the state behind them from each state."""
        to, cost, states = [], [], []
        for vector in range(len(self.vectors)):
            head, codes, behind, front = self.boundaries(symbols, vector)
            total = sum(int(self.cost[v, c]) for v, c in zip(behind[1:], codes, strict=True))
            v = behind[0]
            for s in reversed(head):
                total += int(self.one_cost[v, s])
                v = int(self.one[v, s])
            to.append(front)
            cost.append(total)
            for state in range(4):
                _, state = self.trace(head, codes, behind, state, False)
                states.append(state)
        return to, cost, states

    def _expand(self, vector: int, code: tuple[int, ...], state: int) -> tuple[tuple[str, ...], int]:
        """Edits before and at each symbol of a block, and the state behind it."""
        vectors, costs = [vector], []
        for s in reversed(code):
            costs.append(int(self.one_cost[vectors[-1], s]))
            vectors.append(int(self.one[vectors[-1], s]))
        vectors, costs = vectors[::-1], costs[::-1]
        out = []
        for k, s in enumerate(code):
            here, behind, edits = self.vectors[vectors[k]], self.vectors[vectors[k + 1]], ""
            while True:
                left = here[state] + costs[k]
                if left == DELETE + behind[state]:
                    edits += "D"
                    break
                if here[state] == INSERT + here[_INSERTED[state]]:
                    edits += "I"
                    state = _INSERTED[state]
                    continue
                extra, kept = TRUNCATED * (s & 1), _KEPT.get((s >> 1, state))
                if s != MUST_GO and kept is not None and left == KEEP + extra + behind[kept]:
                    edits += "K"
                    state = kept
                else:
                    edits += "R"
                    state = _INSERTED[state]
                break
            out.append(edits)
        return tuple(out), state

    def digits(self, code: int) -> tuple[int, ...]:
        return tuple(code // 9**k % 9 for k in reversed(range(self.block)))

    def trace(self, head, codes, behind, state: int, edits: bool = True) -> tuple[list[str], int]:
        """Edits before and at each symbol (the last letter is the symbol's own), and the state behind them."""
        out: list[str] = []
        for code, vector in [(tuple(head), behind[0]), *((self.digits(c), v) for c, v in zip(codes, behind[1:], strict=True))]:
            part, state = self.expand(vector, code, state)
            if edits:
                out += part
        return out, state

    def at_end(self, state: int) -> str:
        """Rows inserted behind the last one."""
        return {0: "", 1: "II", 2: "I", 3: ""}[state]

    def repair(self, symbols: list[int]) -> tuple[int, list[str], str]:
        """``(cost, edits before and at each symbol, edits at the end)`` of the cheapest repair, ties ASCII-least."""
        head, codes, behind, front = self.boundaries(symbols, self.end)
        cost = sum(int(self.cost[v, c]) for v, c in zip(behind[1:], codes, strict=True))
        v = behind[0]
        for s in reversed(head):
            cost += int(self.one_cost[v, s])
            v = int(self.one[v, s])
        edits, state = self.trace(head, codes, behind, 0)
        return cost + self.vectors[front][0], edits, self.at_end(state)


@functools.cache
def tables(block: int = BLOCK) -> BlockTables:
    return BlockTables(block)


def symbol_of(role: str, must_go: bool, truncated: bool) -> int:
    return MUST_GO if must_go else 2 * _CLASSES.get(role[:1], 3) + truncated


def _lines(state: int, edits: str, role: str, text: str) -> tuple[list[str], int]:
    """The repaired rows that a row's edits give, and the state behind them."""
    out = []
    for e in edits:
        if e == "I":
            state = _INSERTED[state]
            out.append(_ROLE[state] + ":")
        elif e == "R":
            state = _INSERTED[state]
            out.append(f"{_ROLE[state]}:{text}")
        elif e == "K":
            state = _KEPT[_CLASSES[role[0]], state]
            out.append(f"{role}:{text}")
    return out, state


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(_c, _turn, _role, _text, _gone, _blank, _cut)``: the damaged rows; a dropped row stays with ``_gone`` so that its conversation is known."""

    def word(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(word(conv), F.lit(":"), word(turn))) % 20
    rows = conversations.select(
        F.col(conv).alias("_c"), F.col(turn).cast("long").alias("_turn"), word(role).alias("_role"), word(text).alias("_text"), kind.alias("_kind")
    )
    rows = rows.withColumn("_copies", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    body = F.when(F.col("_kind").isin(0, 1), "").when(F.col("_kind") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    named = F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role"))
    rows = rows.select("_c", "_turn", named.alias("_role"), body.alias("_text"), (F.col("_kind") == 0).alias("_gone"))
    blank = ~F.col("_text").rlike(_NOT_BLANK)
    return rows.withColumn("_blank", blank).withColumn("_cut", ~blank & ~F.col("_text").rlike(r"[.!?][\x20\x09-\x0D]*\z"))


def _order() -> list:
    return [F.asc_nulls_first("_turn"), F.col("_role"), F.substring("_text", 1, 32), F.xxhash64("_text"), F.col("_text")]


_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repair_whole(rows: list[tuple]) -> tuple:
    """Result columns of one conversation's rows ``(turn, role, text, blank, cut)`` in order."""
    seen, symbols = set(), []
    blank = duplicate = truncated = 0
    for _, role, text, empty, cut in rows:
        again = not empty and (role, text) in seen
        seen.add((role, text))
        blank, duplicate, truncated = blank + empty, duplicate + again, truncated + (cut and not again)
        symbols.append(symbol_of(role, empty or again, cut))
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[:1] for _, r, *_ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, edits, end = tables().repair(symbols)
    lines, state = [], 0
    for (_, role, text, _, _), e in zip(rows, edits, strict=True):
        more, state = _lines(state, e, role, text)
        lines += more
    lines += _lines(state, end, "", "")[0]
    digest = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
    return gaps, blank, duplicate, truncated, illegal, cost, "".join(edits) + end, digest


def _arrow_out(kind: pa.DataType) -> pa.Schema:
    fields = [("_c", kind), *((n, pa.string() if t == "string" else pa.int64()) for n, t in (f.split() for f in _OUT.split(", ")))]
    return pa.schema(fields)


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations handled one after the other; only the rows of one are held."""
    kind = rows.schema["_c"].dataType.simpleString()
    columns = ["_c", "_gone", "_turn", "_role", "_text", "_blank", "_cut"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        held: list[tuple] | None = None
        name = schema = None
        for batch in batches:
            schema = schema or _arrow_out(batch.schema.field(0).type)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for c, gone, *row in zip(*(part.column(i).to_pylist() for i in range(len(columns))), strict=True):
                    if held is None or c != name:
                        if held is not None:
                            found.append((name, *_repair_whole(held)))
                        name, held = c, []
                    if not gone:
                        held.append(tuple(row))
            if len(found) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
                found = []
        if held is not None:
            found.append((name, *_repair_whole(held)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    dealt = rows.repartition("_c").sortWithinPartitions(F.col("_c"), *_order()).select(*columns)
    return dealt.mapInArrow(run, f"_c {kind}, {_OUT}")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows in order over range partitions, with ``_part`` and ``_seq``; equal rows are spread by a number of their own."""
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = pa.array(np.arange(seq, seq + batch.num_rows, dtype=np.int64))
            seq += batch.num_rows
            own = pa.array(np.full(batch.num_rows, part, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, own, at], names=[*batch.schema.names, "_part", "_seq"])

    keys = [F.col("_c"), F.asc_nulls_first("_turn"), F.col("_role"), F.substring("_text", 1, 32), F.xxhash64("_text"), F.monotonically_increasing_id()]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(F.col("_c"), *_order())
    return dealt.mapInArrow(run, schema.add("_part", "long").add("_seq", "long"))


def _fields(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in text.split(", "))])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_SUMMARY = "_part long, _chunk long, to array<long>, cost array<long>, states array<long>, head string, tail string, illegal long"
_PLAN = "_n long, _part long, _chunk long, behind long, state long, total long, illegal long, last long"
_EDITS = "_n long, _part long, _chunk long, rows array<long>, edits array<string>, starts array<long>, end string, end_state long"


def _summaries(key, group):
    group = group.sort_by("_seq")
    symbols, roles = group.column("symbol").to_pylist(), group.column("_role").to_pylist()
    initials = [r[:1] for r in roles]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    row = (key[1].as_py(), key[2].as_py(), *tables().summary(symbols), initials[0], initials[-1], illegal)
    return _table([(key[0].as_py(), *row)], _fields("_n long, " + _SUMMARY))


def _composed(key, group):
    """Chunks of a conversation composed from the end (their vectors), then from the start (their states)."""
    t = tables()
    group = group.sort_by([("_part", "ascending"), ("_chunk", "ascending")])
    rows = group.to_pylist()
    vector, total, behind = t.end, 0, []
    for r in reversed(rows):
        behind.append(vector)
        total += r["cost"][vector]
        vector = r["to"][vector]
    total += t.vectors[vector][0]
    illegal = sum(r["illegal"] for r in rows) + sum(a["tail"] + b["head"] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    state, out = 0, []
    for k, (r, v) in enumerate(zip(rows, behind[::-1], strict=True)):
        out.append((key[0].as_py(), r["_part"], r["_chunk"], v, state, total, illegal, int(k == len(rows) - 1)))
        state = r["states"][4 * v + state]
    return _table(out, _fields(_PLAN))


def _chunk_edits(key, group):
    t = tables()
    group = group.sort_by("_seq")
    symbols = group.column("symbol").to_pylist()
    behind, state, last = (group.column(c)[0].as_py() for c in ("behind", "state", "last"))
    head, codes, vectors, _ = t.boundaries(symbols, behind)
    edits, end_state = t.trace(head, codes, vectors, state)
    starts = []
    for s, e in zip(symbols, edits, strict=True):
        starts.append(state)
        for letter in e:
            state = _KEPT[s >> 1, state] if letter == "K" else state if letter == "D" else _INSERTED[state]
    end = t.at_end(end_state) if last else ""
    return _table([(*(k.as_py() for k in key), group.column("_seq").to_pylist(), edits, starts, end, end_state)], _fields(_EDITS))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's repaired rows, streamed in order."""
    schema = pa.schema([("_n", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    name = digest = None
    letters: list[str] = []
    first = True
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for n, role, text, edits, state, end in zip(*(part.column(i).to_pylist() for i in range(6)), strict=True):
                if n != name:
                    if digest is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, "".join(letters), digest.hexdigest())], schema=schema)
                    name, digest, letters, first = n, hashlib.sha256(), [], True
                lines, state = _lines(state, edits, role, text)
                lines += _lines(state, end or "", "", "")[0]
                letters.append(edits + (end or ""))
                for line in lines:
                    digest.update(("" if first else "\n").encode() + line.encode("utf-8", "surrogatepass"))
                    first = False
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, "".join(letters), digest.hexdigest())], schema=schema)


def _in_chunks(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Large conversations, numbered by ``names (_c, _n)``."""
    chunk = F.floor(F.col("_seq") / CHUNK).alias("_chunk")
    ordered = rows.filter("NOT _gone").join(names.withColumnRenamed("_c", "_k"), F.col("_c").eqNullSafe(F.col("_k"))).drop("_k", "_gone")
    ordered = stored(_numbered(ordered).select("*", chunk), "ordered-rows")
    narrow = ordered.select("_n", "_part", "_seq", "_chunk", "_turn", "_role", "_blank", "_cut", F.md5(F.col("_text").cast("binary")).alias("_h"))
    firsts = narrow.groupBy("_n", "_role", "_h").agg(F.min(F.struct("_part", "_seq")).alias("_first"))
    again = ~F.col("_blank") & (F.col("_first") != F.struct("_part", "_seq"))
    role = F.substring("_role", 1, 1)
    known = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3)
    symbol = F.when(F.col("_blank") | again, MUST_GO).otherwise(2 * known + F.col("_cut").cast("int"))
    rows = stored(narrow.join(firsts, ["_n", "_role", "_h"]).withColumn("again", again).withColumn("symbol", symbol.cast("long")), "symbols")
    in_chunk = ["_n", "_part", "_chunk"]
    summary = rows.select(*in_chunk, "_seq", "_role", "symbol").groupBy(*in_chunk).applyInArrow(_summaries, "_n long, " + _SUMMARY)
    plan = stored(summary.groupBy("_n").applyInArrow(_composed, _PLAN), "chunk-plans")  # one short row for each chunk of a conversation
    edits = rows.select(*in_chunk, "_seq", "symbol").join(plan, in_chunk).groupBy(*in_chunk).applyInArrow(_chunk_edits, _EDITS)
    edits = stored(edits, "chunk-edits")
    each = edits.select("_part", F.posexplode("rows").alias("_at", "_seq"), "edits", "starts", "rows", "end").select(
        "_part", "_seq", F.col("edits")[F.col("_at")].alias("edit"), F.col("starts")[F.col("_at")].alias("start"),
        F.when(F.col("_at") == F.size("rows") - 1, F.col("end")).alias("end"),
    )
    lines = ordered.join(each, ["_part", "_seq"]).repartition("_n").sortWithinPartitions("_n", "_part", "_seq")
    hashed = lines.select("_n", "_role", "_text", "edit", "start", "end").mapInArrow(_hashed, "_n long, audit string, repaired_sha256 string")
    turns = rows.filter("_turn IS NOT NULL").groupBy("_n", "_turn").agg(F.lit(1).alias("one")).groupBy("_n")
    turns = turns.agg((F.max("_turn") - F.min("_turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    cut = F.col("_cut") & ~F.col("again")
    counts = rows.groupBy("_n").agg(*[F.sum(c.cast("long")).alias(a) for c, a in ((F.col("_blank"), "blank"), (F.col("again"), "duplicate"), (cut, "truncated"))])
    totals = plan.filter("last = 1").select("_n", F.col("total").alias("cost"), "illegal")
    out = names.join(counts, "_n", "left").join(turns, "_n", "left").join(totals, "_n", "left").join(hashed, "_n", "left")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    return out.select("_c", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), empty)


def repair_conversations(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    rows: int = WHOLE_ROWS, size: int = WHOLE_BYTES,
) -> DataFrame:
    """One row per conversation: ``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``."""
    broken = damaged(conversations, conv, turn, role, text)
    sizes = conversations.groupBy(F.col(conv).alias("_c")).agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.octet_length(text)).alias("_bytes"))
    large = stored(sizes.filter((F.col("_rows") > rows) | (F.col("_bytes") > size)).select("_c", F.monotonically_increasing_id().alias("_n")), "large")
    if large.isEmpty():
        return _whole(broken).withColumnRenamed("_c", conv)
    names = small(large)
    rest = broken.join(names.select(F.col("_c").alias("_k")), F.col("_c").eqNullSafe(F.col("_k")), "left_anti")
    return _whole(rest).unionByName(_in_chunks(broken, names)).withColumnRenamed("_c", conv)


@query("op11_conversation_repair")
def op11(spark, sf_dir):
    return repair_conversations(table(spark, sf_dir, "conversations"))
