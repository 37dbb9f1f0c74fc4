import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bytelake.llm import weak_pii
from bytelake.llm.weak_pii import estimate, fit_classifier, weak_pii as run_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            v = m.group()
            d = re.sub("[^0-9]", "", v)
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if ok[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    None, "", "mail a.b@c.de, x@y", "a@b@c.d e@f.g_h@i.j", "é𝄞 4041894974608795 ñ 42.144.35.254 +1 (988) 555-2485 z", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255",
    "4041-8949 7460-8795 4041 8949 7460 8796 12", "+1 23 +49 (0)30-1234567- +1+22222222222", "9" * 15_000, "a" * 15_000 + "@", "1 " * 50_000, "1." * 8_000,
    "x@" + "a." * 30_000, "+1" + " " * 50_000, "call Dr. Anna Maria or 123-45-6789 IBAN DE89 3704 0044 0532 0130 00 end", "4041894974608795@x.y 4041894974608795-", "mail a@b.com " * 300,
]


def joined(spans):
    return [f"{s.kind}:{s.start}:{s.stop}" for s in spans]


def test_base_spans_equal_plain_patterns(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("base", F.lit(1))
    got = run_pii(df).orderBy('doc_id').collect()
    assert len(got) == len(rows)
    for r in got:
        assert joined(r.base) == brute(TEXTS[r.doc_id]), r.doc_id
    added = {s.kind for r in got for s in r.added}
    assert added <= set(weak_pii.PATTERNS) - set(PLAIN) and {s.kind for s in got[15].added} == {"ssn", "iban", "name"}, got[15]
    assert all(0 <= s.score <= 1 for r in got for s in r.base)


def test_query_digest(spark):
    from bytelake.llm.registry import QUERIES

    got = QUERIES["op4_weak_pii"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in PLAIN]
        assert set(want) <= set(filter(None, r.spans.split(",")))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("a1.@+-() _é4", max_size=40), min_size=20, max_size=60))
def test_random_texts(spark, texts):
    got = run_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert joined(r.base) == brute(texts[r.doc_id]), texts[r.doc_id]


def test_em_separates_reliable_votes():
    counts = {"ssn|++++|3": 80, "ssn|++0+|3": 60, "ssn|-+--|3": 70, "ssn|---0|3": 40, "ssn|+-+-|3": 10}
    post, rates = estimate(counts)
    assert post["ssn|++++|3"] > 0.9 and post["ssn|---0|3"] < 0.1
    assert rates[0][True, "+"] > 0.8 > 0.3 > rates[0][False, "+"]
    score = fit_classifier(counts, post)
    assert score["ssn|++++|3"] > 0.8 and score["ssn|---0|3"] < 0.2


def test_empty_table(spark):
    assert run_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("kind", list(weak_pii.PATTERNS))
def test_every_kind_has_all_labelers(kind):
    assert kind in weak_pii.STRICT and kind in weak_pii.GAZETTEER and kind in weak_pii.CUES


# Planted personal data of every added kind, and lookalikes that their context or form gives away.
PLANTED = {
    "ssn": ["ssn 123-45-6789", "social security 219-09-9999"],
    "iban": ["iban DE89 3704 0044 0532 0130 00", "account GB29NWBK60161331926819"],
    "name": ["contact Mr. John Smith", "signed Dr. Anna Weber"],
    "tel": ["call (217) 555-7713", "phone 030/1234 5678", "tel 415-555-2671", "+1 (487) 555-7209 4736962573099581"],
    "pan": ["card 5555 5555 5555 4444 12 3456", "visa 4111111111111111 9999"],
    "birth": ["patient born on 12.03.1984", "name X, dob: 1984-03-12"],
    "street": ["address 221 Baker Street", "we live at 12 Old Mill Road"],
    "worded": ["mail jane.doe [at] example [dot] com", "write to x_y(at)mail.example.org"],
    "person": ["contact Maria Lopez", "best regards Thomas Miller"],
}
DECOYS = {
    "ssn": ["part no 000-00-0000", "sku 987-00-0000", "serial 666-12-0000x"],
    "iban": ["build ZZ00 ABCD EFGH JKLM 01", "sku XX99 1234 5678 9012 34"],
    "tel": ["version 101.2345678", "serial 123.456.789", "build 100-2345678"],
    "pan": ["serial 000000000000000", "order 0000-0000 0000-0000 123456"],
    "birth": ["version birth 99.99.2999", "build birth 0000-00-00"],
    "street": ["release 00001 Two Three Four Way", "order 00007 One Two Three Court"],
    "worded": ["release f(at)g.9", "build a(at)b.1"],
    "person": ["statue Paul Street", "named after Max Bay"],
}


def planted_rows():
    rows, truth = [], {}
    for i in range(40):
        for kinds, real in ((PLANTED, True), (DECOYS, False)):
            for kind, forms in kinds.items():
                for f in forms:
                    truth[len(rows)] = (kind, real)
                    rows.append((len(rows), f"Lorem {'ipsum ' * (i % 5)}dolor {f} amet."))
    return rows, truth


def test_planted_spans_are_found_and_lookalikes_are_not(spark):
    rows, truth = planted_rows()
    got = {r.doc_id: r for r in run_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in PLANTED:
        real = [i for i, x in truth.items() if x == (kind, True)]
        false = [i for i, x in truth.items() if x == (kind, False)]
        hit = lambda ids: sum(any(s.kind == kind for s in got[i].added) for i in ids)  # noqa: B023, E731
        assert hit(real) >= 0.9 * len(real), (kind, "recall", hit(real), len(real))
        assert hit(false) <= 0.1 * len(false), (kind, "lookalikes", hit(false), len(false))


def test_added_spans_follow_the_votes(spark):
    """Brute force of the whole chain: candidates from the patterns, the groups' scores by EM and classifier, no span over a base or a longer span."""
    rows, _ = planted_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in weak_pii.candidates(df).collect()}
    kinds, counts = list(weak_pii.PATTERNS), {}
    for spans in found.values():
        for s in spans:
            counts[s.group] = counts.get(s.group, 0) + 1
    score = fit_classifier(counts, estimate(counts)[0])
    assert min(score.values()) < 0.5 < max(score.values())
    for r in run_pii(df).collect():
        base = [s for s in found[r.doc_id] if s.kind in PLAIN]
        more = [s for s in found[r.doc_id] if s.kind not in PLAIN and score[s.group] >= 0.5]
        above = lambda o, s: (s.start - s.stop, kinds.index(s.kind)) > (o.start - o.stop, kinds.index(o.kind))
        apart = lambda o, s: o.stop <= s.start or s.stop <= o.start
        want = [
            f"{s.kind}:{s.start}:{s.stop}" for s in more
            if all(apart(b, s) for b in base) and all(o is s or apart(o, s) or not above(o, s) for o in more)
        ]
        assert joined(r.added) == want
