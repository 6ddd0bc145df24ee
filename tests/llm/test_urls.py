import random

from pyspark.sql import functions as F

from rollcall.llm import urls

PAGES = [
    (1, "http://A.Example.ORG/es/1?q#f", None), (2, "http://example.org/en/1", None), (3, "http://example.org/en/2", None), (4, "https://x.com/fr/a", None), (5, "https://x.com/de/a", None), (6, "https://x.net/", None),
    (7, None, None), (8, "no scheme", "<link rel=canonical href='http://x.com/de/z'>"), (9, "http://notorg/", None), (10, "http://x.com", None), (11, "http://x.com/de/a", None),
    (12, "http://a.net/1", '<html><LINK data-x="1" REL="canonical" HREF="http://x.com/de/z">'), (13, "http://b.net/1", '<meta http-equiv="refresh" content="0; url=http://a.net/1">'), (14, "https://b.net/1/#top", ""),
    (15, "http://c.net/1", '<link rel="canonical" href="http://d.net/1">'), (16, "http://d.net/1", '<link rel="canonical" href="http://x.com/de/y">'), (17, "http://d.net/1", '<link rel="canonical" href="http://y.org/1">'),
    (18, "http://e.net/a/b", '<link rel="canonical" href="/c">'), (19, "http://e.net/c", '<link rel="canonical" href="//x.com/de/q">'), (20, "http://x.com/de/y", None), (21, "http://f.net/1", "refresh canonical"), (6, "https://x.net/", None), (22, "://", None), (23, "http://?x", None)]
VERDICTS = {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "block", 12: "block", 13: "block", 14: "block", 15: "allow", 16: "allow", 17: "allow", 18: "block", 19: "block", 20: "block", 21: "allow", 22: "allow", 23: "allow"}


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")


def test_aliases_share_blocks_and_allows_win(spark):
    got = urls.judged(pages(spark), urls.RULES).collect()
    assert len(got) == len(PAGES) and {r["page_id"]: r["verdict"] for r in got} == VERDICTS
    by = {r["page_id"]: r for r in got}
    assert (by[1]["host"], by[1]["path"], by[1]["rule"]) == ("a.example.org", "/es/1", "example.org/es/") and (by[7]["host"], by[7]["path"], by[7]["rule"]) == ("", "", None) and (by[10]["host"], by[10]["path"], by[10]["rule"]) == ("x.com", "", None)


def test_given_redirects(spark):
    rows = [(1, "http://p.net/1", None), (2, "http://q.net/1", None)]
    given = spark.createDataFrame([("http://p.net/1", "http://q.net/1"), ("http://q.net/1", "http://x.com/de/0"), (None, "http://q.net/1")], "source string, target string")
    assert {r["verdict"] for r in urls.judged(pages(spark, rows), redirects=given).collect()} == {"block"}


def test_empty(spark):
    assert urls.judged(pages(spark, [])).count() == 0


def test_more_rules_than_an_expression_holds(spark, monkeypatch):
    rng = random.Random(3)
    rules = [(rng.choice(["allow", "block"]), rng.choice(["net", "a.net", "b.a.net", "x.com", "com", f"h{k}.org"]), "/" + "".join(rng.choices("abé/", k=rng.randint(0, 6)))) for k in range(5_000)]
    rows = [(k, f"http://{rng.choice(['net', 'a.net', 'c.b.a.net', 'x.com', 'h7.org', 'q.h9.org', ''])}/{''.join(rng.choices('abé/', k=rng.randint(0, 8)))}", None) for k in range(300)] + [(300, None, None), (301, "x", None)]
    got = {r["page_id"]: tuple(r) for r in urls.judged(pages(spark, rows), rules).collect()}
    assert len(got) == len(rows)
    for k, url, _ in rows:
        host, _, path = (url or "").partition("://")[2].partition("/") if url and "://" in url else ("", "", "")
        path = "/" + path if url and "://" in url else ""
        fits = sorted((-len(h + p), v, h, p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p))
        assert got[k][3:] == ((fits[0][2] + fits[0][3], fits[0][1]) if fits else (None, "allow")), url
    some = rules[:400]
    plain = sorted(map(repr, urls.judged(pages(spark, rows), some).collect()))
    monkeypatch.setattr(urls, "MOST_RULES", 0)
    assert sorted(map(repr, urls.judged(pages(spark, rows), some).collect())) == plain


LINKS = [
    ("http://e.net/a/b", '<link rel="canonical" href="c">', ["x://e.net/a/c"]), ("http://e.net/a/b/", "<link rel=canonical href=../c/./d>", ["x://e.net/a/c/d"]), ("http://e.net", "<link href='c' rel='canonical'>", ["x://e.net/c"]),
    ("http://e.net/a?x=1", '<link rel="nofollow canonical" href="/s?a=1&amp;b=2">', ["x://e.net/s?a=1&b=2"]), ("http://e.net/a/b", '<link rel=canonical href="?p=2"><link rel=stylesheet href="canonical.css">', ["x://e.net/a/b?p=2"]),
    ("http://e.net/a", '<link rel="canonical" href="http://f.net/1"><LINK REL=canonical HREF="https://g.net/2"><meta http-equiv="refresh" content="0;URL=\'h\'"><meta content="5; url=//i.net/" http-equiv=refresh>', ["http://f.net/1", "https://g.net/2", "x://e.net/h", "x://i.net/"]),
    ("http://e.net/a/b", '<link rel="canonical" href="..">', ["x://e.net/"]), ("http://e.net/a", '<link rel="not-canonical" href="z">', []), ("no scheme", '<link rel="canonical" href="z">', []), (None, '<link rel="canonical" href="z">', [])]


def test_targets_are_resolved_and_decoded(spark):
    got = {}
    for r in urls.links(pages(spark, [(k, u, h) for k, (u, h, _) in enumerate(LINKS)]).withColumn("url", F.concat(F.col("url"), F.lit("#"), F.col("page_id").cast("string")))).collect():
        got.setdefault(int(r["_from"].rsplit("#", 1)[1]), []).append(r["_to"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(want) for k, (_, _, want) in enumerate(LINKS) if want}


def test_relative_targets_carry_blocks(spark):
    rows = [(1, "http://e.net/a/b", '<link rel="canonical" href="c?x=1&amp;y=2">'), (2, "http://e.net/a/c?x=1&y=2", '<link rel="canonical" href="http://x.com/de/1">')]
    assert {r["verdict"] for r in urls.judged(pages(spark, rows)).collect()} == {"block"}
