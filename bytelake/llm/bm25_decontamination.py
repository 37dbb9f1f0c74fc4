"""Benchmark decontamination: BM25 with block-max WAND bounds, then verification of question and answer.

The test items are the indexed side.  Their inverted index (terms, postings in blocks of items, the largest
weight of each term overall and per block) is built on the driver from at most about ``max_items`` items of the benchmark table (a stated
query set).  A larger benchmark is cut by a hash of the item text into several indexes of that size, each with its own term statistics; the
passages are run against one after the other and the hits are united, so no item is left out.
Every training passage is a query: each text is cut into windows of twice the longest item, overlapping by
half, so that an item that occurs lies inside one window.

A weight is the BM25 weight of a term in an item divided by the item's own score, so the score of a window for
an item is the share of the item's BM25 mass found in it, and one threshold serves all items.  WAND's pivot test is
made once for an index: the lists with the smallest largest weights that can't reach the threshold together in any
item (``common``) never start a result, so only windows with postings in the other lists are looked at.  For these
the largest weights of each block of items are added to what the common lists can give in the block; blocks
that stay under the threshold are skipped, and the items of the others are scored exactly.  The bounds lose no pair
at or above the threshold (tested against full scoring).  A pair is a leak if at least ``overlap`` of the 5-word
shingles of the item's question and of its answer (its last sentence; shorter parts count as one shingle) occur in
the window, or that share of the shingles of the whole item, so that one changed word in a short answer clears nothing.

Defined results: a null or empty text has no passage; items without words are ignored; items without id
count, and a null stands for them once in a list; an empty benchmark flags nothing; equal rows get equal results; extra columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, map_rows, stored, text_or_empty
from .registry import query, table

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 8
MAX_ITEMS = 100_000
REACH = 0.3  # share of the threshold that the common lists may give an item
EPS = 1e-9
NO_WORD = -2

_WORD = re.compile(r"\w+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def words(text: str) -> list[str]:
    """White-space separated tokens without punctuation at their ends, in lower case."""
    return [w for w in (_EDGE.sub("", t) for t in text.lower().split()) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence (or line) is the answer; an item of one sentence is both."""
    parts = [p for p in (words(s) for s in re.split(r"\n+|(?<=[.!?])\s+", text)) if p]
    if not parts:
        return [], []
    question = [w for p in parts[:-1] for w in p]
    return question or parts[-1], parts[-1]


def shingles(seq: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(seq[i : i + n]) for i in range(max(1, len(seq) - n + 1))} if seq else set()


class ItemIndex:
    """Inverted index of the items, with per-term and per-block largest weights."""

    def __init__(self, items: list[tuple], reach: float = REACH * THRESHOLD):
        seqs = [(i, words(t or "")) for i, t in items]
        kept = [(i, s, t) for (i, s), (_, t) in zip(seqs, items, strict=True) if s]
        self.ids = [i for i, _, _ in kept]
        self.parts = [tuple(shingles(p) for p in question_and_answer(t)) for _, _, t in kept]
        self.whole = [shingles(s) for _, s, _ in kept]
        self.longest = max((len(s) for _, s, _ in kept), default=0)
        n = len(kept)
        df = Counter(w for _, s, _ in kept for w in set(s))
        self.term = {w: k for k, w in enumerate(sorted(df))}
        idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
        mean = sum(len(s) for _, s, _ in kept) / n if n else 1.0
        rows = []
        for item, (_, s, _) in enumerate(kept):
            norm = K1 * (1 - B + B * len(s) / mean)
            own = {w: idf[w] * c * (K1 + 1) / (c + norm) for w, c in Counter(s).items()}
            total = sum(own.values())
            rows += [(self.term[w], item, x / total) for w, x in own.items()]
        rows.sort()
        term, item, weight = (np.array(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        self.items, self.weights = item, weight
        self.first = np.searchsorted(term, np.arange(len(self.term) + 1))
        self.term_max = np.maximum.reduceat(weight, self.first[:-1]) if rows else np.zeros(0)
        self.n_blocks = max(1, (n + BLOCK - 1) // BLOCK)
        key = term * self.n_blocks + item // BLOCK
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if rows else np.zeros(0, int)
        self.block_max = np.maximum.reduceat(weight, starts) if rows else np.zeros(0)
        self.block = item[starts] // BLOCK
        self.block_first = np.searchsorted(term[starts], np.arange(len(self.term) + 1))
        # the pivot: lists in order of their largest weight, as long as no item gets more than `reach` from them
        self.common = np.zeros(len(self.term), bool)
        self.common_mass = np.zeros(n)
        for t in np.argsort(self.term_max, kind="stable"):
            own = slice(self.first[t], self.first[t + 1])
            mass = self.common_mass[item[own]] + weight[own]
            if mass.max() <= reach:
                self.common[t] = True
                self.common_mass[item[own]] = mass
        self.block_common = np.zeros(self.n_blocks)
        np.maximum.at(self.block_common, np.arange(n) // BLOCK, self.common_mass)


def _expand(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term its posting numbers: ``(row of the term, posting)``."""
    size = first[terms + 1] - first[terms]
    row = np.repeat(np.arange(len(terms)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + first[terms][row]


def blocks_to_score(index: ItemIndex, win: np.ndarray, term: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """``(window, block)`` pairs that may hold an item at or above the threshold, from the distinct
    (window, term) rows of the lists above the pivot."""
    row, post = _expand(index.block_first, term)
    if not len(row):
        return []
    own, inv = np.unique(win[row] * index.n_blocks + index.block[post], return_inverse=True)
    alive = np.bincount(inv, index.block_max[post]) + index.block_common[own % index.n_blocks] >= threshold - EPS
    if not alive.any():
        return []
    # the same test for the single items of those blocks
    row, post = _expand(index.first, term)
    pair = win[row] * index.n_blocks + index.items[post] // BLOCK
    ok = alive[np.searchsorted(own, pair)]
    row, post = row[ok], post[ok]
    items = len(index.ids)
    pair, inv = np.unique(win[row] * items + index.items[post], return_inverse=True)
    pair = pair[np.bincount(inv, index.weights[post]) + index.common_mass[pair % items] >= threshold - EPS]
    return [(int(w), int(b)) for w, b in sorted(set(zip(pair // items, pair % items // BLOCK, strict=True)))]


def score_block(index: ItemIndex, terms: np.ndarray, block: int, threshold: float) -> list[int]:
    """Items of the block whose score for the window's distinct terms reaches the threshold."""
    _, post = _expand(index.first, terms)
    post = post[index.items[post] // BLOCK == block]
    score = np.bincount(index.items[post] - block * BLOCK, index.weights[post], BLOCK)
    return [block * BLOCK + int(i) for i in np.flatnonzero(score >= threshold - EPS)]


class _TermIds(dict):
    """Raw token -> term number, -1 for a word no item has, ``NO_WORD`` for no word; bounded memory."""

    def __init__(self, term: dict[str, int]):
        super().__init__()
        self.term = term

    def __missing__(self, token: str) -> int:
        w = token.lower().strip(".,;:!?")
        if not w.isalnum():
            w = _EDGE.sub("", w)
        k = self.term.get(w, -1) if w else NO_WORD
        if len(self) > 300_000:
            self.clear()
        self[token] = k
        return k


def find_leaks(index: ItemIndex, texts: list[str], threshold: float = THRESHOLD, overlap: float = OVERLAP, cache: dict | None = None):
    """Per text, the sorted ids of the items it holds."""
    cache = _TermIds(index.term) if cache is None else cache
    out: list[list] = [[] for _ in texts]
    half = max(1, index.longest)
    wins, terms, of, found_in = [], [], [], {}
    for d, text in enumerate(texts):
        tokens = text.split()
        ids = np.fromiter(map(cache.__getitem__, tokens), np.int64, len(tokens))
        ids = ids[ids != NO_WORD]
        at = np.flatnonzero(ids >= 0)
        at = at[~index.common[ids[at]]]
        if not len(at):
            continue
        n = max(1, -(-len(ids) // half) - 1)  # windows of two halves
        own = at // half
        w = np.concatenate((np.minimum(own, n - 1), np.maximum(own - 1, 0)))
        pair = np.unique(w * len(index.term) + np.concatenate((ids[at], ids[at])))
        wins.append(pair // len(index.term) + len(of))
        terms.append(pair % len(index.term))
        of += [(d, k) for k in range(n)]
        found_in[d] = ids
    if not wins:
        return out
    seqs: dict[int, list[str]] = {}
    for w, block in blocks_to_score(index, np.concatenate(wins), np.concatenate(terms), threshold):
        d, k = of[w]
        near = found_in[d][k * half : (k + 2) * half]
        for item in score_block(index, np.unique(near[near >= 0]), block, threshold):
            if index.ids[item] in out[d]:
                continue
            if d not in seqs:
                seqs = {d: words(texts[d])}
            own = seqs[d][k * half : (k + 2) * half]
            held = {n: {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} for n in range(1, SHINGLE + 1)}
            enough = [sum(s in held[len(s)] for s in part) >= overlap * len(part) for part in (*index.parts[item], index.whole[item])]
            if all(enough[:-1]) or enough[-1]:
                out[d].append(index.ids[item])
    return [_in_order(x) for x in out]


def _in_order(ids: list) -> list:
    """Distinct ids, a null last."""
    return sorted({i for i in ids if i is not None}) + [None] * (None in ids)


def _item_sets(benchmark: DataFrame, item_col: str, item_text: str, max_items: int) -> tuple[int, Iterator[list[tuple]]]:
    """How many sets of about ``max_items`` items there are, and the sets; one is on the driver at a time."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).filter("t <> ''").distinct()
    n = max(1, -(-items.count() // max_items))

    def read(k):
        rows = items.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k).collect()
        return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))

    return n, map(read, range(n))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, overlap: float = OVERLAP, max_items: int = MAX_ITEMS,
) -> DataFrame:
    """One row per document: ``(id, items)`` with the ids of the benchmark items it holds."""
    kind, item_kind = (f.schema[c].dataType.simpleString() for f, c in ((docs, id_col), (benchmark, item_col)))
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text).alias("_t"), F.lit(None).cast(f"array<{item_kind}>").alias("items"))
    n, sets = _item_sets(benchmark, item_col, item_text, max_items)
    for k, items in enumerate(sets, 1):
        find = _finder(docs.sparkSession, items, threshold, overlap)
        if k < n:  # an index at a time: the hits so far are written beside the texts
            rows = stored(map_rows(rows, lambda c, f=find: (c["_id"], c["_t"], _united(c, f)), f"_id {kind}, _t string, items array<{item_kind}>"), "passages")
        else:
            rows = map_rows(rows, lambda c, f=find: (c["_id"], _united(c, f)), f"_id {kind}, items array<{item_kind}>")
    return rows.withColumnRenamed("_id", id_col)


def _united(cols, find) -> list[list]:
    return [_in_order([*(had or ()), *new]) for had, new in zip(cols["items"], find(cols["_t"]), strict=True)]


def _finder(spark, items: list[tuple], threshold: float, overlap: float):
    """Function from texts to item lists, with the index of these items broadcast (their number is bounded)."""
    shared = spark.sparkContext.broadcast(ItemIndex(items, REACH * threshold))
    cache: dict = {}

    def find(texts):
        if "terms" not in cache:
            cache["terms"] = _TermIds(shared.value.term)
        return find_leaks(shared.value, texts, threshold, overlap, cache["terms"])

    return find


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their own columns; one pass an index, no shuffle."""
    item_col, item_text, threshold, overlap, max_items = (options.get(k, v) for k, v in _DEFAULTS.items())
    n, sets = _item_sets(benchmark, item_col, item_text, max_items)
    for k, items in enumerate(sets, 1):
        find = _finder(docs.sparkSession, items, threshold, overlap)
        docs = filter_rows(docs, text, lambda texts, f=find: [not found for found in f(texts)])
        docs = stored(docs, "clean-passages") if k < n else docs
    return docs


_DEFAULTS = {"item_col": "item_id", "item_text": "text", "threshold": THRESHOLD, "overlap": OVERLAP, "max_items": MAX_ITEMS}


@query("op5_bm25_decontamination")
def op5(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", F.size("items").cast("long").alias("n_items"))
