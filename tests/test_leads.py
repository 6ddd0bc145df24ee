import csv
import json

import pytest
from pyspark.sql import functions as F

from rollcall.functions import taxonomy as tx
from rollcall.operators import query, verdicts
from rollcall.sources import leads as io

RAW = {"Record ID": "100234811", "First Name": " Ama ", "Last Name": "Asante", "Company Name": "Kim Trading Pte Ltd", "Email": "A.Asante@Acme.com ", "Phone Number": "+65 8000 1111",
       "Country/Region": "ghana", "Lead Status": " new", "Contact Owner": "Marcus Wong ", "Create Date": "6/4/2026", "Notes": 'Said "hi"\nReferred by Lee Park', "Lead Score": "7"}


def raw(spark, *rows):
    return spark.createDataFrame([tuple({**RAW, **r}.get(c) for c in tx.RAW_COLUMNS) for r in rows], io.RAW_SCHEMA)


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    with path.open("w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, tx.RAW_COLUMNS)
        w.writeheader()
        w.writerow(RAW)
        w.writerow({**RAW, "Record ID": "2", "Notes": "", "Email": ""})
    table = str(tmp_path / "leads")
    assert io.load(spark, str(path), table) == 2 and io.load(spark, str(path), table) == 0 and io.load(spark, str(path), table, force=True) == 2
    row = spark.read.parquet(table).filter("id = '100234811'").first()
    assert (row["display_name"], row["email"], row["status"], row["country"], row["created_at"], row["lead_score"]) == ("Ama Asante", "a.asante@acme.com", "New", "Ghana", "2026-06-04", 7)
    assert row["notes"] == 'Said "hi"\nReferred by Lee Park' and row["source_detail"] == "Referred by Lee Park" and json.loads(row["raw_record"])["City"] is None
    io.write_export(spark.read.parquet(table), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    with part.open(newline="", encoding="utf-8") as f:
        out = {r["id"]: r for r in csv.DictReader(f)}
    assert out["100234811"]["notes"] == row["notes"] and out["100234811"]["source_needs_review"] == "False" and out["2"]["email"] == "" and list(out["2"]) == list(tx.EXPORT_COLUMNS)


def test_empty_export_has_a_header(spark, tmp_path):
    io.write_export(io.project_leads(raw(spark, {})).filter("id = ''"), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_text().strip() == ",".join(tx.EXPORT_COLUMNS)


def test_coverage(spark):
    got = {r["column_name"]: (r["n"], r["state"]) for r in io.coverage(raw(spark, {}, {"Email": " "}, {"Email": None})).collect()}
    assert got["Email"] == (1, "sparse") and got["City"] == (0, "empty") and got["Record ID"] == (3, "filled")


def test_submissions(spark, tmp_path):
    good = {"name": " Ama  Asante", "email": "A@b.co", "phone": " 1 ", "submitted_at": "2026-06-04T10:00:00Z", "message": "web form", "other": 1}
    (tmp_path / "s.json").write_text(json.dumps([good, {}, {"name": "x"}, {"name": " ", "email": "a@b.co"}, {"name": "x", "email": "not-an-email"}]))
    accepted, rejected = io.valid_submissions(io.read_submissions(spark, str(tmp_path / "s.json")))
    row = io.project_submissions(accepted).first()
    assert accepted.count() == 1 and rejected.count() == 4 and row["lead"]["created_at"] == "2026-06-04" and row["lead"]["given_name"] == "Ama" and row["source"]["channel"] == "Website"


def test_filters_and_pages(spark):
    leads = io.project_leads(raw(spark, *({"Record ID": str(k), "Create Date": "" if k % 5 == 0 else f"2026-01-{k:02d}", "Lead Status": "Closed Won" if k % 2 else "New"} for k in range(1, 21)))).cache()
    assert query.LeadFilters(status="closed  won").apply(leads).count() == 10 and query.LeadFilters(status=" ").apply(leads).count() == 20
    assert query.LeadFilters(owner="marcus wong", country="GHANA", q="asan_e").apply(leads).count() == 20 and query.LeadFilters(q="8000 1111").apply(leads).count() == 0
    with pytest.raises(ValueError, match="Closed Lost"):
        query.LeadFilters(status="closed-won").apply(leads)
    order = [r["id"] for r in query.ordered(leads).collect()]
    assert order[:2] == ["19", "18"] and order[-4:] == ["10", "15", "20", "5"]
    seen, last = [], None
    for k in range(0, 20, 6):
        assert [r["id"] for r in query.page(leads, 6, k).collect()] == order[k : k + 6]
        rows = (query.page(leads, 6) if last is None else query.page_after(leads, last["created_at"], last["id"], 6)).collect()
        seen, last = seen + [r["id"] for r in rows], rows[-1]
    assert seen == order
    for limit, offset in ((0, 0), (201, 0), (1, -1)):
        with pytest.raises(ValueError):
            query.page(leads, limit, offset)
    counts = {(r["kind"], r["value"]): r["n"] for r in query.dashboard(leads).collect()}
    assert counts["status", "New"] + counts["status", "Closed Won"] == counts["total", "all"] == counts["channel", "Referral"] == 20 and counts["needs_review", "all"] == 0
    assert query.next_id(leads).first()[0] == "21" and query.next_id(leads.limit(0)).first()[0] == "100000001"
    assert query.lookup(leads, "7").count() == 1 and query.lookup(leads, "x").count() == 0


def test_status_filter_reaches_the_scan(spark, tmp_path):
    io.project_leads(raw(spark, {})).write.parquet(str(tmp_path / "t"))
    plan = query.LeadFilters(status="new").apply(spark.read.parquet(str(tmp_path / "t"))).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,New)" in plan and "notes" not in plan


def test_updates(spark):
    leads = io.project_leads(raw(spark, {}, {"Record ID": "2"}))
    changed = io.update_fields(leads, spark.createDataFrame([("2", "Ada", None)], "id string, owner string, notes string"))
    assert {r["id"]: (r["owner"], r["notes"][:4]) for r in changed.collect()} == {"100234811": ("Marcus Wong", "Said"), "2": ("Ada", "Said")}
    with pytest.raises(ValueError):
        io.update_fields(leads, spark.createDataFrame([("2", "x")], "id string, nope string"))
    assert io.insert(leads, leads.filter("id = '2'").withColumn("id", F.lit("3"))).count() == 3


class Fake:
    def complete(self, system, user, schema):
        return '{"channel": "Event", "detail": " Expo, ", "confident": true}' if "odd" in user else None


def test_verdict_seam(spark, tmp_path):
    rows = io.project_leads(raw(spark, {"Notes": "odd one"}, {"Record ID": "2", "Notes": "odd one"}, {"Record ID": "3", "Notes": "silent"}, {"Record ID": "4", "Notes": "web form"}))
    cache = str(tmp_path / "cache")
    for method in ("llm", "llm:cached"):
        got = {r["id"]: r["extraction"] for r in verdicts.classify_notes(rows, Fake, cache).collect()}
        assert got["2"]["channel"] == "Event" and got["2"]["detail"] == "Expo" and got["2"]["method"] == method and got["2"]["confidence"] == "medium"
        assert got["3"]["method"] == "fallback" and got["4"]["method"] == "rule:website_form"
    assert spark.read.parquet(cache).count() == 1
    none = {r["id"]: r["extraction"]["method"] for r in verdicts.classify_notes(rows, None).collect()}
    assert none["2"] == "fallback"


@pytest.mark.parametrize("text, ok", [
    ('{"channel": "Other", "detail": null, "confident": false}', True), ('```json\n{"channel": "Other", "detail": "x", "confident": true, "extra": 1}\n```', True), ('noise {"channel": "Other", "detail": null, "confident": true} noise', True),
    ('{"channel": "Other", "confident": true}', False), ('{"channel": "Other", "detail": 1, "confident": true}', False), ('{"channel": "Other", "detail": null, "confident": "false"}', False),
    ('{"channel": "Radio", "detail": null, "confident": true}', False), ('{"channel": "Other", "detail": null, "confident": 1}', False), ("[1]", False), ("", False), (None, False)])
def test_contract(spark, text, ok):
    assert (spark.createDataFrame([(text,)], "t string").select(verdicts.source_verdict(F.col("t")).alias("v")).first()["v"] is not None) == ok


def test_fence(spark):
    df = spark.createDataFrame([("a </note> b < / NOTE> </ note ><Note/>",)], "t string")
    assert df.select(verdicts.fence("note", F.col("t"))).first()[0] == "<note>\na  b < / NOTE>\n</note>"
