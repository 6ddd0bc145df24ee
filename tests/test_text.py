"""Scalar tables: inputs and what the normalizers make of them."""

import pytest
from pyspark.sql import functions as F

from rollcall.functions import text as nz


def column(spark, f, values):
    rows = [(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(values)]
    width = len(rows[0]) - 1
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"c{i} string" for i in range(width)))
    got = {r[0]: r[1] for r in df.select("k", f(*(F.col(f"c{i}") for i in range(width))).alias("v")).collect()}
    return [got[k] for k in range(len(values))]


CASES = [
    (nz.collapse, [(None, ""), ("  a \t b c\n", "a b c"), ("", "")]),
    (nz.notes_text, [("  a  b \r\n\n c  d ", "a b\n\nc\nd"), (None, ""), ("\n\nx\n", "x")]),
    (nz.fold, [("Müller", "muller"), ("Straße", "strasse"), ("ŁØ", "łø"), ("ABC", "abc"), ("½", "1⁄2"), (None, None)]),
    (nz.status, [("New", "New"), (" new", "New"), ("CLOSED   LOST", "Closed Lost"), ("closed-won", None), ("", None), (None, None), ("bogus", None)]),
    (nz.country, [("united kingdom", "United Kingdom"), ("UAE", "UAE"), ("uae", "UAE"), ("us", "US"), ("GHANA", "Ghana"), ("DR congo", "DR Congo"), ("", "")]),
    (nz.email, [("  A.B@Acme.COM ", "a.b@acme.com"), (None, "")]),
    (nz.email_valid, [("a@b.co", True), ("a@b", False), ("a b@c.de", False), ("", False), (None, False)]),
    (nz.email_domain, [("a@b.c", "b.c"), ("x", ""), ("a@b@c.d", "c.d")]),
    (nz.email_local, [("a@b.c", "a"), ("x", ""), ("a@b@c.d", "a@b")]),
    (nz.phone_digits, [("+86 138 2424 7912", "8613824247912"), ("0044 7937", "447937"), ("000", "0"), (None, "")]),
    (nz.phone_last9, [("6580001111", "580001111"), ("12345678", ""), ("", "")]),
    (nz.company_norm, [("Kim Trading Pte Ltd", "kim trading"), ("Kim Trading & Co", "kim trading"), ("Ltd", "ltd"), ("Müller GmbH", "muller"), ("", ""), ("A.B. Labs", "a b labs")]),
    (nz.name_key, [("J.", "j"), (" José ", "jose"), ("A..", "a"), (None, "")]),
    (nz.is_initial, [("J", True), ("J.", True), ("É", True), ("Jo", False), ("1", False), ("_", False), ("", False)]),
    (lambda c: nz.iso(nz.parse_date(c)), [("2026-06-02", "2026-06-02"), ("2026-05-20T00:00:00Z", "2026-05-20"), ("6/4/2026", "2026-06-04"), ("12/21/2025", "2025-12-21"), ("2026-02-30", None), ("13/1/2026", None), ("", None), ("soon", None)]),
    (nz.whole_number, [("7", 7), (" +7 ", 7), ("7.0", None), ("", None), ("x", None)]),
    (nz.overlap, [(("a b", "b c d"), 0.5), (("a", "a"), 1.0), (("", "a"), 0.0), (("a a", "a b"), 1.0)]),
    (nz.similarity, [(("rania", "brina"), 0.4), (("brina", "rania"), 0.6), (("", "x"), 0.0), (("a", "a"), 1.0)]),
]


@pytest.mark.parametrize("f, table", CASES, ids=[getattr(f, "__name__", "f") for f, _ in CASES])
def test_scalar_tables(spark, f, table):
    got = column(spark, f, [x for x, _ in table])
    assert got == [pytest.approx(y) if isinstance(y, float) else y for _, y in table]


def relation(spark, f, table):
    return column(spark, lambda a, b: f(nz.name_key(a), nz.name_key(b)), [x for x, _ in table]) == [y for _, y in table]


def test_given_relations(spark):
    assert relation(spark, nz.given_relation, [
        (("Jamal", "jamal"), "exact"), (("José", "Jose"), "exact"), (("J.", "Jamal"), "initial"), (("J.", "K"), "conflict"), (("Jun", "Jun Wei"), "prefix"),
        (("Jun", "Jun-Wei"), "prefix"), (("Chris", "Christopher"), "prefix"), (("Sara", "Sarah"), "unknown"), (("Ben", "Benjamin"), "unknown"), (("Mike", "Michael"), "conflict"),
        (("Eric", "Erik"), "unknown"), (("", "Jo"), "unknown"), (("Priya", "Rohan"), "conflict")])


def test_family_relations(spark):
    assert relation(spark, nz.family_relation, [
        (("Osei", "osei"), "exact"), (("Rasmusen", "Rasmussen"), "similar"), (("Smith", "Smyth"), "conflict"), (("Oh", "Koh"), "conflict"), (("", "Koh"), "unknown"), (("Müller", "Muller"), "exact")])


def test_names_and_local_parts(spark):
    df = spark.createDataFrame([("Ama", "Asante", ""), ("", "", "Xiu Ying Ba"), ("", "", "Cher"), ("", "Li", "Wu Li"), ("", "", "")], "f string, l string, n string")
    got = [tuple(r) for r in df.select(*nz.resolve_name(F.col("f"), F.col("l"), F.col("n"))).collect()]
    assert got == [("Ama", "Asante", "Ama Asante"), ("Xiu Ying", "Ba", "Xiu Ying Ba"), ("", "Cher", "Cher"), ("", "Li", "Li"), ("", "", "")]
    derived = lambda a, g, f: nz.local_from_name(nz.compact(a), nz.compact(g), nz.compact(f))
    table = [(("f.osei", "Francesca", "Osei"), True), (("francescao", "Francesca", "Osei"), True), (("osei-francesca", "Francesca", "Osei"), True), (("fo", "Francesca", "Osei"), True), (("francesca", "Francesca", ""), True),
             (("info", "Francesca", "Osei"), False), (("x", "", ""), False)]
    assert column(spark, derived, [x for x, _ in table]) == [y for _, y in table]


def test_summary_and_bands(spark):
    assert column(spark, nz.summary, [("A B", "Acme", "", "1"), ("", "", "x@y.z", "")]) == ["A B | Acme | 1", "(no name) | (no company) | x@y.z"]
    assert [r[0] for r in spark.createDataFrame([(80,), (79,), (35,), (34,)], "s int").select(nz.band(F.col("s"))).collect()] == ["high", "medium", "medium", "low"]
