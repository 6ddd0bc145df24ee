import pytest
from pyspark.sql import functions as F

from rollcall.functions import taxonomy as tx
from rollcall.operators import ingest
from rollcall.operators.dedupe import scored, scoring_view
from rollcall.operators.ingest import merged
from rollcall.plans import catalog
from rollcall.sources import leads as io
from tests.test_leads import raw

NOW = "2026-11-01T00:00:00+00:00"
BASE = {"Notes": "Met at the Retail Expo", "Create Date": "2026-01-05", "Contact Owner": "Ada"}


def leads_of(spark, *rows):
    return io.project_leads(raw(spark, *({**BASE, "Record ID": str(100 + k), **r} for k, r in enumerate(rows))))


def subs_of(spark, *rows):
    fields = ("sub", *io.FORM_SCHEMA.names)
    df = spark.createDataFrame([tuple({"sub": k, **{f: "" for f in io.FORM_SCHEMA.names}, **r}[f] for f in fields) for k, r in enumerate(rows)], "sub long, " + ", ".join(f"{f} string" for f in io.FORM_SCHEMA.names))
    return io.project_submissions(io.valid_submissions(df)[0])


def run(spark, leads, *subs):
    done = ingest.ingest(leads_of(spark, *leads), subs_of(spark, *subs), NOW)
    return {r["id"]: r for r in done.leads.collect()}, {r["sub"]: r for r in done.outcomes.collect()}


AMA = {"First Name": "Ama", "Last Name": "Asante", "Email": "ama@acme.com", "Phone Number": "+65 8000 1111"}


def test_tiers(spark):
    leads, told = run(
        spark, [AMA, {**AMA, "First Name": "Kofi", "Last Name": "Boateng", "Email": "kofi@b.com", "Phone Number": "+233 20 555 6666", "Country/Region": "togo"}],
        {"name": "Ama Asante", "email": "AMA@acme.com", "message": "web form", "submitted_at": "2025-12-01T00:00:00Z", "form_name": "Demo", "company": "Other"},
        {"name": "K. Boateng", "email": "new@x.com", "phone": "00233 20 555 6666"},
        {"name": "Zed Quux", "email": "kofi@b.com"},
        {"name": "Yaw Fresh", "email": "yaw@fresh.com", "country": "mali", "submitted_at": "2026-02-02"})
    assert [told[k]["matched_by"] for k in range(4)] == ["email", "phone", None, None] and [told[k]["action"] for k in range(4)] == ["updated", "updated", "created", "created"]
    ama = leads["100"]
    assert ama["created_at"] == "2025-12-01" and ama["last_modified_at"] == "2025-12-01" and ama["company"] == "Kim Trading Pte Ltd" and ama["owner"] == "Ada" and ama["source_channel"] == "Event"
    assert ama["notes"].endswith('\n[2025-12-01 · web form · "Demo"] web form (submitted company: Other)') and "notes" in told[0]["changed_fields"]
    assert told[2]["possible_duplicates"][0]["id"] == "101" and leads[told[2]["lead_id"]]["status"] == "New"
    assert leads[told[3]["lead_id"]]["created_at"] == "2026-02-02" and {told[2]["lead_id"], told[3]["lead_id"]} == {"102", "103"} and told[2]["lead_id"] == "102"


def test_later_submissions_see_earlier_writes(spark):
    leads, told = run(
        spark, [{**AMA, "Country/Region": "", "First Name": "A."}],
        {"name": "Ama Asante", "email": "ama@acme.com", "country": "ghana"}, {"name": "Yaw Fresh", "email": "yaw@f.com"}, {"name": "Yaw Fresh", "email": "yaw@f.com", "message": "again"}, {"name": "Ama Asante", "email": "z@z.com", "country": "Ghana"})
    assert told[0]["action"] == "updated" and leads["100"]["country"] == "Ghana" and leads["100"]["given_name"] == "Ama" and {"country", "given_name", "display_name"} <= set(told[0]["changed_fields"])
    assert told[1]["action"] == "created" and told[2]["lead_id"] == told[1]["lead_id"] and "again" in leads[told[1]["lead_id"]]["notes"]
    assert told[3]["action"] == "created" and len(leads) == 3


def sequential(spark, leads, subs):
    """One submission at a time, each against all records so far."""
    state, out = leads, []
    for r in subs.select("sub").orderBy("sub").collect():
        done = ingest.ingest(state, subs.filter(F.col("sub") == r["sub"]), NOW)
        state = spark.createDataFrame(done.leads.collect(), io.LEAD_SCHEMA)
        out += done.outcomes.select("sub", "action", "lead_id", "matched_by", "score").collect()
    return sorted(map(tuple, state.collect()), key=repr), sorted(map(tuple, out))


def test_waves_equal_a_sequential_fold(spark):
    leads = leads_of(spark, AMA, {**AMA, "Email": "", "Country/Region": "", "Phone Number": ""}, {**AMA, "First Name": "", "Last Name": "", "Email": "blank@x.com", "Phone Number": ""})
    subs = subs_of(
        spark, {"name": "Ama Asante", "email": "blank@x.com", "country": "ghana"}, {"name": "Ama Asante", "email": "q@q.com", "phone": "6580001111", "country": "ghana"},
        {"name": "Kofi Osei", "email": "k@k.com", "country": ""}, {"name": "Kofi Osei", "email": "k@k.com", "country": "togo"}, {"name": "Kofi Osei", "email": "k2@k2.com", "country": "togo"})
    done = ingest.ingest(leads, subs, NOW)
    got = sorted(map(tuple, done.leads.collect()), key=repr), sorted(map(tuple, done.outcomes.select("sub", "action", "lead_id", "matched_by", "score").collect()))
    assert got == sequential(spark, spark.createDataFrame(leads.collect(), io.LEAD_SCHEMA), subs)


def test_nothing_to_ingest(spark):
    done = ingest.ingest(leads_of(spark, AMA), subs_of(spark, {"name": "x", "email": "a@b.co"}).filter("sub > 5"), NOW)
    assert done.leads.count() == 1 and done.outcomes.count() == 0


def test_patch(spark):
    leads = leads_of(spark, AMA, {**AMA, "Notes": "unclear"})
    got = {r["id"]: r for r in ingest.patch(leads, spark.createDataFrame([("100", " closed won", None, "web form"), ("101", None, " New  Owner", "web form")], "id string, status string, owner string, notes string")).collect()}
    assert got["100"]["status"] == "Closed Won" and got["100"]["source_channel"] == "Event" and got["100"]["owner"] == "Ada" and got["101"]["source_channel"] == "Website" and got["101"]["owner"] == "New Owner"
    assert ingest.validated_patch({"status": "new", "owner": " A  B "}) == {"status": "New", "owner": "A B"}
    for bad in ({}, {"email": "x"}, {"owner": " "}, {"status": "nope"}, {"status": None}):
        with pytest.raises(ValueError):
            ingest.validated_patch(bad)


def test_stream(spark, tmp_path):
    import json

    from rollcall.streaming import ingest as stream

    table, inbox = str(tmp_path / "table"), tmp_path / "in"
    inbox.mkdir()
    leads_of(spark, AMA).write.parquet(f"{stream.version_path(table, 0)}/leads")
    for k, name in enumerate(("Ama Asante", "Yaw Fresh")):
        (inbox / f"{k}.json").write_text(json.dumps({"name": name, "email": "ama@acme.com" if k == 0 else "y@f.com", "message": "hi"}) + '\n{"name": "bad"}\n')
        q = stream.start(stream.read_stream(spark, str(inbox)), table, str(tmp_path / "cp"), lambda: NOW)
        q.awaitTermination(120)
        assert q.exception() is None
    assert stream.current_version(spark, table) == 2
    assert spark.read.parquet(f"{stream.version_path(table, 2)}/leads").count() == 2 and spark.read.json(f"{stream.version_path(table, 2)}/rejected").count() == 1


def crowd(spark):
    """Namesakes in one country by many spellings, days and contact keys, and submissions that reach them."""
    given, days, phones = ("Christopher", "Chris", "C.", "Priya", "", "Jun Wei", "Jun"), ("2026-01-05", "2026-02-06", ""), ("", "+65 8000 1111", "65 8000 1111", "1234567", "80001111", "0165 8000 1111")
    lead = [{"First Name": given[k % 7], "Last Name": ("Osei", "osei", "Nair")[k % 5 % 3], "Email": ("", f"c{k}.osei@a{k % 4}.com", "chris.osei@a1.com", "christopherosei@b.com")[k % 11 % 4], "Phone Number": phones[k % 13 % 6],
             "Country/Region": ("ghana", "Ghana", "")[k % 17 % 3], "Create Date": days[k % 19 % 3], "Company Name": ("Osei Labs", "Osei Trading Ltd", "")[k % 23 % 3]} for k in range(120)]
    sub = [{"name": f"{given[k % 7]} Osei".strip(), "email": (f"x{k}@new.com", "chris.osei@a1.com", f"c.osei@a{k % 4}.com", f"chrisosei{k}@n.com")[k % 4], "phone": phones[k % 5 * (k % 4 == 0)], "country": ("ghana", "")[k % 6 == 5], "company": ("", "Osei Trading")[k % 3 == 0], "submitted_at": ("2026-01-05T00:00:00Z", "", "2026-02-06")[k % 3]} for k in range(40)]
    return leads_of(spark, *lead), subs_of(spark, *sub)


def told(row):
    return row["matched_id"], row["matched_by"], row["score"], row["confidence"], row["reasons"], [tuple(d) for d in row["possible_duplicates"]]


def test_match_is_the_match_by_all_scored_candidates(spark, monkeypatch):
    leads, subs = crowd(spark)
    views = scoring_view(leads), scoring_view(subs.select("sub", "lead.*"), "sub")
    every = scored(views[1].select("sub", F.struct(*(c for c in views[1].columns if c != "sub")).alias("l")).crossJoin(views[0].select(F.struct("*").alias("r"))))
    want = {r["sub"]: [] for r in subs.select("sub").collect()}
    for p in every.select("sub", "l", "r", "score", "confidence", "reasons", "given", "family", "identity_conflict").collect():
        l, r = p["l"], p["r"]
        keys = [[x["email"], x["phone_last9"], x["email_domain"] and x["family_key"] and (x["email_domain"], x["family_key"]), x["family_key"] and (x["family_key"], x["country"].lower())] for x in (l, r)]
        if probe := next((n + 1 for n in range(4) if keys[0][n] and keys[0][n] == keys[1][n]), 0):
            email, phone = (l[c] != "" and l[c] == r[c] for c in ("email", "phone_digits"))
            tier = 1 if email and not p["identity_conflict"] else 2 if phone and p["given"] in ingest.COMPATIBLE and p["family"] != "conflict" else 3
            want[p["sub"]].append(((-p["score"], probe, r["id"]), tier, email or phone, p))
    for sub, rows in want.items():
        rows.sort(key=lambda x: x[0])
        contact = any(x[2] for x in rows)
        pick = min((x for x in rows if x[1] < 3), key=lambda x: (x[1], x[0]), default=None)
        if not pick and not contact and rows and rows[0][3]["confidence"] == "high":
            pick = rows[0]
        dups = [x for x in rows if x[2]] + [x for x in rows if not x[2] and x[3]["confidence"] != "low"]
        p = pick and pick[3]
        want[sub] = (p["r"]["id"], ("email", "phone", "score")[pick[1] - 1], p["score"], p["confidence"], p["reasons"], []) if pick else (None, None, None, None, None, [(x[0][2], -x[0][0], x[3]["confidence"]) for x in dups])
    assert {w[1] for w in want.values()} == {None, "email", "phone"} and sum(len(w[5]) for w in want.values()) > 100
    for busy in (64, 1):  # 1: every block is dealt over shares
        monkeypatch.setattr(ingest, "BUSY", busy, raising=False)
        assert {r["sub"]: told(r) for r in ingest.match(leads, subs).collect()} == want


def scored_rows(monkeypatch):
    """Counts of the pairs that go into a scoring, filled as they are made."""
    counts = []
    monkeypatch.setattr(ingest, "scored", lambda pairs: (counts.append(pairs.count()), scored(pairs))[1])
    return counts


def test_no_score_without_a_contact_key_is_high():
    most = tx.EMAIL_DOMAIN + tx.FAMILY_EXACT + tx.GIVEN_EXACT + tx.LOCALPART_NAME_DERIVED + tx.COMPANY_SIMILAR + tx.COUNTRY_EXACT + tx.CREATED_SAME_DAY
    assert most < tx.HIGH_FROM and most - tx.EMAIL_DOMAIN - tx.GIVEN_EXACT + tx.GIVEN_CONFLICT < tx.MEDIUM_FROM


@pytest.mark.parametrize("query", ["ingest_merge", "ingest_new"])
def test_records_without_a_contact_key_are_not_scored_for_a_match(spark, monkeypatch, query):
    counts = scored_rows(monkeypatch)
    assert catalog.QUERIES[query](spark, "/root/testdata/sf0.01").count() == 48
    assert sum(counts) < 200  # of 1,639 candidates


def test_namesakes_are_scored_by_profile(spark, monkeypatch):
    counts = scored_rows(monkeypatch)
    leads = leads_of(spark, *({**AMA, "Email": "", "Phone Number": "", "Company Name": ("Asante Labs", "Asante Trading")[k % 2]} for k in range(300)))
    subs = subs_of(spark, *({"name": "Ama Asante", "email": f"q{k}@q{k}.com", "country": "singapore", "company": "Asante Labs"} for k in range(5)))
    names = leads.select(F.first("country")).first()[0]
    subs = subs.withColumn("lead", F.col("lead").withField("country", F.lit(names)))
    got = ingest.match(leads, subs).collect()
    assert [len(r["possible_duplicates"]) for r in got] == [150] * 5 and sum(counts) <= 2 * 5  # not 300 * 5


def test_namesakes_are_listed_by_profile(spark, monkeypatch):
    """A record goes with its profile's others to a submission, not in a row of its own."""
    counts, alike = [], ingest._alike
    monkeypatch.setattr(ingest, "_alike", lambda held, asked: (rows := alike(held, asked), counts.append(rows.count()))[0])
    leads = leads_of(spark, *({**AMA, "Email": "", "Phone Number": "", "Company Name": "Asante Labs"} for k in range(200)))
    subs = subs_of(spark, *({"name": "Ama Asante", "email": f"q{k}@q{k}.com", "country": "singapore", "company": "Asante Labs"} for k in range(5)))
    names = leads.select(F.first("country")).first()[0]
    got = ingest.match(leads, subs.withColumn("lead", F.col("lead").withField("country", F.lit(names)))).collect()
    assert [[d["id"] for d in r["possible_duplicates"]] for r in got] == [[str(100 + k) for k in range(200)]] * 5 and counts == [5]  # not 200 * 5


def test_match_is_the_same_however_rows_are_dealt(spark, monkeypatch):
    leads, subs = crowd(spark)
    want = {r["sub"]: told(r) for r in ingest.match(leads, subs).collect()}
    for name, value in (("FEW", 0), ("PIECE", 1), ("BUSY", 1)):
        monkeypatch.setattr(ingest, name, value)
    assert {r["sub"]: told(r) for r in ingest.match(leads, subs).collect()} == want


def test_candidates_are_not_shuffled_once_they_are_paired(spark, monkeypatch):
    leads, subs = crowd(spark)
    keys = lambda r: [r["email"], r["phone_last9"], r["email_domain"] and r["family_key"] and (r["email_domain"], r["family_key"]), r["family_key"] and (r["family_key"], r["country"].lower())]
    want = {(s["sub"], r["id"], same[0] + 1) for s in subs.collect() for r in leads.collect() if (same := [n for n, (a, b) in enumerate(zip(keys(s["lead"]), keys(r))) if a and a == b])}
    for busy in (64, 1):
        monkeypatch.setattr(ingest, "BUSY", busy, raising=False)
        found = ingest.candidates(leads, subs)
        rows = [tuple(r) for r in found.collect()]
        assert set(rows) == want and len(rows) == len(want)
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]
    assert "Aggregate" not in above and "Repartition" not in above


def test_pairs_compare_numbers_before_texts(spark, monkeypatch):
    leads, subs = crowd(spark)
    found = ingest.candidates(leads, subs)
    want = sorted(map(tuple, found.collect()))
    assert " hash(" in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(ingest.F, "hash", lambda *c: F.lit(1))  # all collide
    assert sorted(map(tuple, ingest.candidates(leads, subs).collect())) == want and want


def test_rounds_do_not_follow_the_namesakes(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(ingest, "merged", lambda pairs, now: (calls.append(1), merged(pairs, now))[1])
    sub = {"name": "Kofi Osei", "country": "togo", "company": "Osei Labs"}
    leads, told = run(spark, [AMA], *({**sub, "email": f"k{k}@n{k}.com"} for k in range(10)), {**sub, "email": "k3@n3.com", "message": "again"}, {**sub, "email": "k3@n3.com", "message": "and again"})
    assert [told[k]["action"] for k in range(12)] == ["created"] * 10 + ["updated"] * 2
    assert [told[k]["lead_id"] for k in range(12)] == [str(101 + k) for k in range(10)] + ["104"] * 2
    for k in range(10):  # each sees those that came before it, and no other
        assert [d["id"] for d in told[k]["possible_duplicates"]] == [str(101 + j) for j in range(k)]
    assert leads["104"]["notes"].split("] ")[1:] == ["(no message)\n[2026-11-01 · web form", "again\n[2026-11-01 · web form", "and again"] and len(leads) == 11
    assert len(calls) <= 8  # two or three rounds of three turns, not twelve waves


def test_a_match_may_fall_with_the_write_that_made_it(spark):
    """Round one creates a record for each new e-mail; later rounds take back what came to nothing."""
    held = [{**AMA, "Country/Region": "", "First Name": "A."}]
    subs = ({"name": "Ama Asante", "email": "ama@acme.com", "phone": "+233 20 555 6666", "country": "ghana"}, {"name": "Ama Asante", "email": "b@b.com", "phone": "+65 8000 1111"},
            {"name": "Ama Asante", "email": "b@b.com", "message": "x"}, {"name": "Ama Asante", "email": "c@c.com", "phone": "+65 8000 1111"}, {"name": "Ama Asante", "email": "c@c.com"})
    leads, told = run(spark, held, *subs)
    want, outcomes = sequential(spark, spark.createDataFrame(leads_of(spark, *held).collect(), io.LEAD_SCHEMA), subs_of(spark, *subs))
    assert sorted(map(tuple, leads.values()), key=repr) == want
    assert sorted((r["sub"], r["action"], r["lead_id"], r["matched_by"], r["score"]) for r in told.values()) == outcomes
