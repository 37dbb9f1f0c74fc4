"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans come from patterns: the four base kinds, and wider ones that also match much that is not personal: ssn, iban,
titled names (name), first and last names (person), numbers without a plus sign or inside longer runs of digits (tel, pan), dates
of birth (birth), street addresses (street) and spelled-out mail addresses (worded).  Four labelers vote on each
candidate, yes (+), no (-) or nothing (0): a strict pattern, a gazetteer (top-level domains, reserved networks,
issuer prefixes, calling codes, country codes, first names), context words before the span, and whether the
span stands alone.  Candidates are counted by (kind, votes, length bucket): at most ``13 * 81 * 6`` groups, whatever the
input.  Expectation-maximisation on those counts estimates how often each labeler votes which way for real and
for false spans and the share of real spans of each kind; its posteriors are the soft labels on which the final
classifier, a logistic regression over kind, votes and length, is fitted.  Base spans always stay; spans of the
other kinds are added if the classifier gives them at least one half and they touch no base span and no longer
span that is added (of equal ones the first kind stays).

The candidates of each document are one array column of a written table; nothing is shuffled but the counts.
Patterns use possessive loops and start only at the first character of a run, so very long runs take linear
time and no stack; they match what the plain patterns match.

Defined results: a null text counts as empty; equal rows give equal results; an empty table gives an empty
result; columns other than id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty
from .registry import query, table

# Fixed values of the contract, written with possessive loops.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

# Kinds the method adds.
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NAME = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?"
TEL = (
    r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20/-]|[0-9]{3}[.-])"
    r"[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z])(?![.-][0-9])"
)
PAN = r"(?<![0-9])(?:[0-9]{15,16}|[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4})(?![0-9])"
_DATE = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})"
BIRTH = rf"(?<![\p{{L}}0-9])(?i:born|birth|birthday|dob|geboren|geburtsdatum|née?|nacid[oa])[^0-9\n]{{0,20}}{_DATE}(?![0-9])"
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square|Way"
STREET = rf"(?<![0-9A-Za-z])[0-9]{{1,5}}\x20(?:[A-Z][a-z]{{1,20}}\x20){{1,3}}(?:{_STREETS})(?![A-Za-z])"
_DOT = r"\x20?(?:[\[(]\x20?dot\x20?[\])]|\.)\x20?"
WORDED = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,4}}"
FIRST_NAMES = "Anna|Anne|Carlos|Daniel|David|Emma|Eva|Hans|Jean|John|Jose|Julia|Laura|Luis|Maria|Marie|Mary|Max|Michael|Paul|Peter|Sara|Thomas"
PERSON = rf"(?<![\p{{L}}0-9])(?:{FIRST_NAMES})\x20[A-Z][a-z]{{1,30}}(?!\p{{L}})"
PATTERNS = {
    "email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "ssn": SSN, "iban": IBAN, "name": NAME,
    "tel": TEL, "pan": PAN, "birth": BIRTH, "street": STREET, "worded": WORDED, "person": PERSON,
}

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}$",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})$",
    "phone": r"^\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,5}(?:[\x20.-]?[0-9]{2,5}){1,4}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{11,40}$",
    "name": r"^\p{L}+\.?\x20[A-Z][a-z]+\x20[A-Z][a-z]+$",
    "tel": r"^(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20/-]|[2-9][0-9]{2}[.-])[0-9]{3,4}[\x20.-][0-9]{3,4}$",
    "pan": r"^(?:[0-9]{16}|3[47][0-9]{13}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$",
    "birth": r"(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[./](?:0?[1-9]|[12][0-9]|3[01])[./](?:19|20)[0-9]{2})$",
    "street": r"^[1-9][0-9]{0,4}\x20(?:[A-Z][a-z]+\x20){1,2}[A-Z][a-z]+$",
    "worded": r"[\[(]\x20?dot\x20?[\])]|\.[a-z]{2,}$",
    "person": r"^[A-Z][a-z]+\x20[A-Z][a-z]{2,}$",
}
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|nl|ch|at)$",
    "ip": r"^(?!0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65)",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "ssn": r"^(?:[0-6][0-9]{2}|7[0-6][0-9]|77[0-2])",
    "iban": r"^(?:AD|AT|BE|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK)",
    "name": rf"\x20(?:{FIRST_NAMES})\b",
    "tel": r"^(?:\+|\(?0?[2-9])(?!.*(?:\.[0-9]{3}\.[0-9]{3}$))",
    "pan": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "birth": r"(?:19[2-9][0-9]|20[01][0-9])(?:-[0-9]{2}-[0-9]{2})?$",
    "street": r"(?:Street|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|Blvd)$",
    "worded": r"(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|nl|ch|at)$",
    "person": r"\x20(?!(?:Street|Avenue|Road|University|Institute|Prize|Award|Airport|Square|Bridge|Church|Hall|Island|Bay)$)",
}
CUES = {
    "email": "mail|contact|write|reach|from|to:",
    "ip": "ip|host|server|addr|client|login",
    "card": "card|visa|master|credit|pay|carte|tarjeta|karte",
    "phone": "tel|phone|call|fax|mobil|whatsapp|sms",
    "ssn": "ssn|social|security",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "name": "name|sign|dear|contact|by|von|de|por",
    "tel": "tel|phone|call|fax|mobil|whatsapp|sms|dial|contact|reach",
    "pan": "card|visa|master|credit|pay|carte|tarjeta|karte",
    "birth": "patient|name|she|he|was|date|on|er|sie",
    "street": "address|live|ship|at|resid|deliver|home|send|office",
    "worded": "mail|contact|write|reach|from|to|me",
    "person": "name(?!d)|sign|dear|contact|by|with|ask|call|customer|patient|regards|from",
}
COUNTER_CUES = r"version|release|isbn|issn|order|invoice|serial|part no|sku|build|revision|ticket|statue|named after"
LABELERS = 4


_SPANS = "array<struct<start: int, stop: int, value: string>>"


def _spans(hits: Column, gaps: Column) -> Column:
    """Matches with their places, from the matches and the lengths of the texts between them."""

    def step(state, item):
        start = state["at"] + item["gap"]
        stop = start + F.char_length(item["hit"])
        found = F.struct(start.alias("start"), stop.alias("stop"), item["hit"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

    empty = F.expr(f"cast(array() as {_SPANS})")
    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    first = F.struct(F.lit(0).alias("at"), empty.alias("found"))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, first, step, lambda s: s["found"])).otherwise(empty)


def _luhn(digits: Column) -> Column:
    places = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(places, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """The contract's check of a match."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind in ("card", "pan"):
        return F.when(n.between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "tel":
        return n.between(8, 15)
    return F.lit(True)


def _holding(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _holds(kind, s["value"]))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "+").when(no, "-").otherwise("0")


def _judged(body: Column, kind: str, kept: Column) -> Column:
    """Candidates of a kind with their group: kind, votes and length bucket."""

    def one(s):
        value = s["value"]
        before = F.lower(F.substring(body, F.greatest(s["start"] - 31, F.lit(1)), F.least(s["start"], F.lit(32))))
        after = F.substring(body, s["stop"] + 1, F.lit(1))
        short = F.length(value) <= 320  # no address or number is longer, and the patterns stay cheap
        strict = F.when(short, value.rlike(STRICT[kind])).otherwise(False)
        known = F.when(short, value.rlike(GAZETTEER[kind])).otherwise(False)
        alone = ~before.rlike(r"[\p{L}0-9]$") & ~after.rlike(r"^[\p{L}0-9]")
        votes = F.concat(
            _vote(strict, ~strict), _vote(known, ~known),
            _vote(before.rlike(CUES[kind]), before.rlike(COUNTER_CUES)), _vote(alone, ~alone),
        )
        size = F.least(F.floor(F.log2(F.length(value).cast("double"))), F.lit(5)).cast("string")
        group = F.concat(F.lit(kind + "|"), votes, F.lit("|"), size)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), group.alias("group"))

    return F.transform(kept, one)


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, spans array<struct<kind, start, stop, group>>)`` in order of kind, then start."""
    # one projection a step, so that Spark computes each match list once
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text).alias("_t"))
    rows = rows.withColumns({f"_hits_{k}": F.regexp_extract_all("_t", F.lit(p), F.lit(0)) for k, p in PATTERNS.items()})
    gaps = {k: F.transform(F.split("_t", p, -1), F.char_length) for k, p in PATTERNS.items()}
    rows = rows.withColumns({f"_gaps_{k}": F.when(F.size(f"_hits_{k}") > 0, g) for k, g in gaps.items()})
    rows = rows.withColumns({f"_all_{k}": _spans(F.col(f"_hits_{k}"), F.col(f"_gaps_{k}")) for k in PATTERNS})
    rows = rows.withColumns({f"_kept_{k}": _holding(F.col(f"_all_{k}"), k) for k in PATTERNS})
    return rows.select(F.col("_id").alias(id_col), F.concat(*(_judged(F.col("_t"), k, F.col(f"_kept_{k}")) for k in PATTERNS)).alias("spans"))


def _parse(group: str) -> tuple[str, str, int]:
    kind, votes, size = group.split("|")
    return kind, votes, int(size)


def estimate(counts: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], list[dict]]:
    """EM over the group counts: posterior of each group, and each labeler's vote rates
    ``{(real, vote): rate}``."""
    groups = {g: _parse(g) for g in counts}
    kinds = {k for k, _, _ in groups.values()}
    prior = dict.fromkeys(kinds, 0.6)
    start = {(True, "+"): 0.6, (True, "0"): 0.3, (True, "-"): 0.1, (False, "+"): 0.2, (False, "0"): 0.3, (False, "-"): 0.5}
    rates = [dict(start) for _ in range(LABELERS)]
    # labelers are taken to be better than chance: the starting rates weigh as much as a quarter of the candidates
    anchor = 2 + sum(counts.values()) / 4
    post = {}
    for _ in range(rounds):
        for g, (kind, votes, _) in groups.items():
            real, false = prior[kind], 1 - prior[kind]
            for r, v in zip(rates, votes, strict=True):
                real, false = real * r[True, v], false * r[False, v]
            post[g] = real / (real + false)
        for kind in kinds:
            own = [g for g, x in groups.items() if x[0] == kind]
            n = sum(counts[g] for g in own)
            prior[kind] = (sum(counts[g] * post[g] for g in own) + 1.2) / (n + 2)
        for j, r in enumerate(rates):
            for real in (True, False):
                weight = {v: anchor * start[real, v] for v in "+0-"}
                for g, (_, votes, _) in groups.items():
                    weight[votes[j]] += counts[g] * (post[g] if real else 1 - post[g])
                total = sum(weight.values())
                r.update({(real, v): w / total for v, w in weight.items()})
    return post, rates


def fit_classifier(counts: dict[str, int], post: dict[str, float], steps: int = 400) -> dict[str, float]:
    """Logistic regression on the soft labels (features: kind, each labeler's vote, length bucket), by gradient
    steps on the bounded group table; returns the score of each group."""
    rows = []
    for g, n in counts.items():
        kind, votes, size = _parse(g)
        rows.append((g, n, [("bias",), ("kind", kind), ("size", kind, size)] + [("vote", j, v) for j, v in enumerate(votes)]))
    total = sum(counts.values()) or 1
    w = {f: 0.0 for _, _, fs in rows for f in fs}
    score = {}
    for _ in range(steps):
        grad = {f: -1e-4 * x for f, x in w.items()}
        for g, n, fs in rows:
            p = score[g] = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[f] for f in fs)))))
            for f in fs:
                grad[f] += n / total * (post[g] - p)
        for f in w:
            w[f] += 2.0 * grad[f]
    return score


def weak_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """One row per document: ``(id, base, added)``, arrays of ``struct<kind, start, stop, score>``."""
    found = stored(candidates(docs, id_col, text), "pii-candidates")
    groups = found.select(F.explode("spans").alias("s")).groupBy("s.group").count().collect()  # bounded: see above
    counts = {r["group"]: r["count"] for r in groups}
    scores = fit_classifier(counts, estimate(counts)[0]) if counts else {"": 0.0}
    lookup = F.create_map(*[x for g, s in sorted(scores.items()) for x in (F.lit(g), F.lit(s))])
    scored = F.transform(
        "spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.element_at(lookup, s["group"]).alias("score"))
    )
    found = found.select(id_col, scored.alias("_all"))
    found = found.select(
        id_col,
        F.filter("_all", lambda s: s["kind"].isin(*BASE)).alias("base"),
        F.filter("_all", lambda s: ~s["kind"].isin(*BASE) & (s["score"] >= least)).alias("_more"),
    )
    order = list(PATTERNS)

    def beats(o, s):
        longer, same = o["stop"] - o["start"] > s["stop"] - s["start"], o["stop"] - o["start"] == s["stop"] - s["start"]
        rank = F.array(*map(F.lit, order))
        return longer | (same & (F.array_position(rank, o["kind"]) < F.array_position(rank, s["kind"])))

    def touches(o, s):
        return (o["start"] < s["stop"]) & (s["start"] < o["stop"])

    free = F.filter(
        "_more", lambda s: ~F.exists("base", lambda b: touches(b, s)) & ~F.exists("_more", lambda o: touches(o, s) & beats(o, s))
    )
    return found.select(id_col, "base", free.alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


@query("op4_weak_pii")
def op4(spark, sf_dir):
    found = weak_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = [F.size(F.filter(F.col("base")["kind"], lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id", *number, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
