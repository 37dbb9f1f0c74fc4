"""Secret scan: sliding-window Shannon entropy per character class, with allow-list suppression.

The base spans are pattern matches.  The method adds spans: candidate strings are runs of the characters of a
class (hex digits; base64 letters and digits with + / _ - and = at the end) of at least ``window`` characters that
no allow rule explains as a whole.  A window slides over the candidate; the counts of its characters change by one step down and
one up, and so does the sum of ``c * log2 c`` from which the entropy follows, so a string of any length costs
constant time per character.  Windows at or above the class's threshold are merged into spans, and spans on
the allow list (UUIDs, dates and plain numbers, paths of words, one-case words, alphabets in order) go.

Defined results: a null text counts as empty; equal rows give equal results; an empty table gives an empty
result; columns other than id and text are ignored; positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_or_empty
from .registry import query, table

# Fixed values of the contract.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # runs of 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

WINDOW = 20
#: bits per character that a window must reach, by character class
THRESHOLDS = {"entropy_hex": 3.0, "entropy_base64": 3.9}
CANDIDATES = {
    "entropy_hex": re.compile(r"(?<![A-Za-z0-9])(?:[0-9A-F]+|[0-9a-f]+)(?![A-Za-z0-9])"),
    "entropy_base64": re.compile(r"[A-Za-z0-9+/_-]+={0,2}"),
}
ALLOWED = [
    re.compile(p)
    for p in (
        r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
        r"[0-9_+/-]+",  # numbers, dates, rules
        r"[/_-]*(?:[A-Za-z]?[a-z]*|[A-Z]+)(?:[/_+-]+(?:[A-Za-z]?[a-z]*|[A-Z]+)[0-9]{0,4})*",  # words, paths, identifiers
        r"[A-Za-z]*(?:abcdefgh|ABCDEFGH|01234567|qwertyui)[A-Za-z0-9+/_=-]*",  # alphabets and keyboards
    )
]
_ASSIGN_WORDS = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, stop)`` of the contract's matches, by start, then kind as listed."""
    out = []
    if _ASSIGN_WORDS.search(text):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def high_entropy(run: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged ``(start, stop)`` of the windows whose entropy reaches the threshold.

    With counts c of a window of n characters the entropy is ``log2 n - sum(c log2 c) / n``."""
    if len(run) < window:
        return []
    weight = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    most = (math.log2(window) - threshold) * window + 1e-9
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += weight[c + 1] - weight[c] if c < window else 0.0
        counts[ch] = c + 1
        if i >= window - 1:
            if total <= most:
                start = i - window + 1
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])
            old = run[i - window + 1]
            c = counts[old]
            total += weight[c - 1] - weight[c]
            counts[old] = c - 1
    return [tuple(s) for s in spans]


def allowed(string: str) -> bool:
    return any(p.fullmatch(string) for p in ALLOWED)


_LONG = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % WINDOW)


def entropy_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, stop)`` the method adds; a candidate of hex digits only is judged as hex."""
    out = []
    for m in _LONG.finditer(text):
        run = m.group()
        if allowed(run):
            continue
        hexes = [h for h in CANDIDATES["entropy_hex"].finditer(run) if len(h.group()) >= WINDOW]
        kinds = [("entropy_hex", h.start(), h.group()) for h in hexes]
        if not (hexes and len(hexes[0].group()) == len(run)):
            kinds.append(("entropy_base64", 0, run))
        for kind, at, string in kinds:
            for b, e in high_entropy(string, THRESHOLDS[kind]):
                if not allowed(string[b:e]):
                    out.append((m.start() + at + b, kind, m.start() + at + e))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def _joined(spans: Iterable[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for b, k, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``(id, base, added)``; both are lists of kind:start:end, comma-joined, by start,
    then kind."""

    def run(cols):
        return cols["_id"], [_joined(base_spans(t)) for t in cols["_t"]], [_joined(entropy_spans(t)) for t in cols["_t"]]

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text).alias("_t"))
    return map_rows(rows, run, f"_id {kind}, base string, added string").withColumnRenamed("_id", id_col)


@query("op2_entropy_secrets")
def op2(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = [
        F.size(F.filter(F.split("base", ","), lambda s: s.startswith(F.lit(k + ":")))).cast("long").alias(f"n_{k}") for k in KINDS[:3]
    ]
    both = F.filter(F.split(F.concat_ws(",", "base", "added"), ","), lambda s: s != "")
    place = F.transform(
        both, lambda s: F.struct(
            F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("at"),
            F.array_position(F.array(*map(F.lit, KINDS)), F.split_part(s, F.lit(":"), F.lit(1))).alias("kind"), s.alias("span"),
        ),
    )
    spans = F.array_join(F.transform(F.array_sort(place), lambda p: p["span"]), ",")
    n_added = F.size(F.filter(F.split("added", ","), lambda s: s != "")).cast("long")
    return found.select("doc_id", *number, F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), n_added.alias("n_added"))
