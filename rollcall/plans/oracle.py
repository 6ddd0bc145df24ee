"""The same results in DuckDB SQL, written on their own: what the queries are held against.

Ratios have no SQL form.  Words of the fixture are finite, so pairs beyond a threshold are listed as
values, made by a rule from the word lists.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import cache

from ..functions import taxonomy as tx
from .fixture import FAMILY, FORM_SQL, GIVEN, NOTES, RAW_SQL


def ws(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def _quote(x: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'"


def _note_table() -> str:
    rows = ", ".join(f"({', '.join(map(_quote, n))})" for n in NOTES)
    return f"told(note, rule, channel, evidence, detail) AS (VALUES {rows})"


def _country(x: str) -> str:
    word = "CASE WHEN w = upper(w) AND w <> lower(w) AND length(w) <= 4 THEN w ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END"
    return f"CASE WHEN lower({ws(x)}) IN ('uae', 'usa', 'uk', 'us') THEN upper({ws(x)}) ELSE array_to_string(list_transform(string_split({ws(x)}, ' '), lambda w: {word}), ' ') END"


def _company(x: str) -> str:
    words = f"list_filter(string_split(regexp_replace(lower({ws(x)}), '[^a-z0-9_ ]+', ' ', 'g'), ' '), lambda w: w <> '')"
    legal = ", ".join(f"'{t}'" for t in tx.LEGAL_TOKENS)
    kept = f"list_filter({words}, lambda w: w NOT IN ({legal}))"
    return f"array_to_string(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {words} END, ' ')"


def _status(x: str) -> str:
    cases = " ".join(f"WHEN '{s.lower()}' THEN '{s}'" for s in tx.STATUSES)
    return f"CASE lower({ws(x)}) {cases} END"


def _digits(x: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g'), '^00', '')"


def _date(x: str) -> str:
    return f"strftime(coalesce(try_strptime({ws(x)}, '%Y-%m-%d'), try_strptime({ws(x)}, '%Y-%m-%dT%H:%M:%SZ'), try_strptime({ws(x)}, '%m/%d/%Y')), '%Y-%m-%d')"


_WORDS = f"string_split({ws('fullname')}, ' ')"
LEADS = f"""raw AS ({RAW_SQL}), {_note_table()},
named AS (SELECT *, {ws('first')} <> '' OR {ws('last')} <> '' AS apart FROM raw),
lead AS (SELECT {ws('rid')} AS id,
  CASE WHEN apart THEN trim({ws('first')} || ' ' || {ws('last')}) ELSE {ws('fullname')} END AS display_name,
  CASE WHEN apart THEN {ws('first')} ELSE array_to_string({_WORDS}[1:-2], ' ') END AS given_name,
  CASE WHEN apart THEN {ws('last')} ELSE {_WORDS}[-1] END AS family_name,
  lower(rtrim(CASE WHEN apart THEN {ws('last')} ELSE {_WORDS}[-1] END, '.')) AS family_key,
  {ws('company')} AS company, {_company('company')} AS company_norm, {ws('title')} AS job_title, lower({ws('email')}) AS email,
  CASE WHEN contains(email, '@') THEN split_part(lower({ws('email')}), '@', 1) ELSE '' END AS email_local,
  CASE WHEN contains(email, '@') THEN split_part(lower({ws('email')}), '@', 2) ELSE '' END AS email_domain,
  {ws('phone')} AS phone, {_digits('phone')} AS phone_digits,
  CASE WHEN length({_digits('phone')}) >= 9 THEN right({_digits('phone')}, 9) ELSE '' END AS phone_last9,
  {_country('country')} AS country, {_status('status')} AS status, {ws('lifecycle')} AS lifecycle_stage, {ws('owner')} AS owner,
  CASE WHEN regexp_full_match(score, '[+-]?[0-9]+') THEN CAST(score AS INTEGER) END AS lead_score, {_date('created')} AS created_at, {_date('modified')} AS last_modified_at,
  notes, told.channel AS source_channel, told.detail AS source_detail, CASE WHEN rule IS NULL THEN 'low' ELSE 'high' END AS source_confidence,
  CASE WHEN rule IS NULL THEN 'fallback' ELSE 'rule:' || rule END AS source_method, rule IS NULL AS source_needs_review, told.evidence AS evidence
  FROM named JOIN told ON notes = note)"""

SUBS = f"""form AS ({FORM_SQL}),
sub AS (SELECT CAST(form.sub AS BIGINT) AS sub, name AS display_name, array_to_string(string_split(name, ' ')[1:-2], ' ') AS given_name, string_split(name, ' ')[-1] AS family_name,
  lower(string_split(name, ' ')[-1]) AS family_key, company, {_company('company')} AS company_norm, email, split_part(email, '@', 1) AS email_local, split_part(email, '@', 2) AS email_domain,
  phone, {_digits('phone')} AS phone_digits, CASE WHEN length({_digits('phone')}) >= 9 THEN right({_digits('phone')}, 9) ELSE '' END AS phone_last9, {_country('country')} AS country,
  CASE WHEN submitted_at <> '' THEN substr(submitted_at, 1, 10) END AS created_at, message, form_id, form_name, page_url, submitted_at,
  told.channel AS source_channel, told.detail AS source_detail, CASE WHEN rule IS NULL THEN 'low' ELSE 'high' END AS source_confidence,
  CASE WHEN rule IS NULL THEN 'fallback' ELSE 'rule:' || rule END AS source_method, rule IS NULL AS source_needs_review
  FROM form JOIN told ON message = note WHERE regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'))"""

KEYS = """keyed AS (
  SELECT id, 'email' AS kind, email AS value FROM lead WHERE email <> ''
  UNION ALL SELECT id, 'phone', phone_last9 FROM lead WHERE phone_last9 <> ''
  UNION ALL SELECT id, 'domain_family', email_domain || '|' || family_key FROM lead WHERE email_domain <> '' AND family_key <> ''
  UNION ALL SELECT id, 'family_initial_country', family_key || '|' || lower(substr(given_name, 1, 1)) || '|' || lower(country) FROM lead WHERE family_key <> ''),
sizes AS (SELECT kind, value, count(*) AS n FROM keyed GROUP BY ALL),
cand AS (SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM keyed a JOIN keyed b USING (kind, value) JOIN sizes USING (kind, value) WHERE a.id < b.id AND n BETWEEN 2 AND 30)"""


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _values(name: str, pairs: list[tuple[str, str]]) -> str:
    return f"{name}(a, b) AS (VALUES {', '.join(f'({_quote(a)}, {_quote(b)})' for a, b in pairs or [('', '')])})"


def _locals(f: str) -> list[str]:
    return sorted({x for g in GIVEN for x in (f"{g}.{f}".lower(), f"{g[0]}.{f}".lower(), (g + f[0]).lower())})


@cache
def tables() -> str:
    """Word pairs beyond the thresholds: names, and local parts of one family or of a submission."""
    given, family = [g.lower() for g in GIVEN], [f.lower() for f in FAMILY]
    far = [(a, b) for a in given for b in given if a != b and _ratio(a, b) < tx.GIVEN_CONFLICT_BELOW]
    near = [(a, b) for a in family for b in family if a != b and _ratio(a, b) >= tx.FAMILY_SIMILAR_FROM]
    like = {(a, b) for f in FAMILY for a in _locals(f) for b in _locals(f) if _ratio(a, b) >= tx.LOCALPART_SIMILAR_FROM}
    for s in range(1, 101):
        base = 5 * s - (5 * s % 3 == 2)
        new = f"{GIVEN[base * 7 % len(GIVEN)].lower()}{s}"
        for f in FAMILY:
            like |= {(new, b) for b in _locals(f) if _ratio(new, b) >= tx.LOCALPART_SIMILAR_FROM}
    return ", ".join((_values("far", far), _values("near", near), _values("alike", sorted(like))))


def scores(name: str, pairs: str, left: str = "lead", right: str = "lead", left_key: str = "l.id = p.left_id", right_key: str = "r.id = p.right_id") -> str:
    """CTEs that end in ``name``: the pairs of CTE ``pairs`` with their parts of the score."""
    gk = lambda t: f"lower(rtrim({t}.given_name, '.'))"
    compact = lambda x: f"regexp_replace(replace(lower({x}), ' ', ''), '[._+-]+', '', 'g')"
    overlap = "len(list_intersect(string_split(l.company_norm, ' '), string_split(r.company_norm, ' '))) / least(len(list_distinct(string_split(l.company_norm, ' '))), len(list_distinct(string_split(r.company_norm, ' '))))"
    derived = lambda x: f"({x} IN (g || f, substr(g, 1, 1) || f, g || substr(f, 1, 1), substr(g, 1, 1) || substr(f, 1, 1), f || g, substr(f, 1, 1) || g, f || substr(g, 1, 1), substr(f, 1, 1) || substr(g, 1, 1)) AND g <> '' AND f <> '' OR (g <> '' AND {x} = g) OR (f <> '' AND {x} = f))"
    return f"""{name}_a AS (SELECT p.*, {gk('l')} AS lg, {gk('r')} AS rg, l.family_key AS lf, r.family_key AS rf,
  CASE WHEN l.email <> '' AND l.email = r.email THEN 45 WHEN l.email_domain <> '' AND l.email_domain = r.email_domain THEN 8 ELSE 0 END AS p_email,
  CASE WHEN l.phone_digits <> '' AND l.phone_digits = r.phone_digits THEN 40 WHEN l.phone_last9 <> '' AND l.phone_last9 = r.phone_last9 THEN 30 ELSE 0 END AS p_phone,
  CASE WHEN l.company_norm <> '' AND r.company_norm <> '' AND {overlap} >= 0.6 THEN 5 ELSE 0 END AS p_company,
  CASE WHEN l.country <> '' AND l.country = r.country THEN 4 ELSE 0 END AS p_country, CASE WHEN l.created_at = r.created_at THEN 10 ELSE 0 END AS p_day,
  l.email_local AS ll, r.email_local AS rl, {compact('l.email_local')} AS lc, {compact('r.email_local')} AS rc,
  {compact('CASE WHEN length(r.given_name) > length(l.given_name) THEN r.given_name ELSE l.given_name END')} AS g,
  {compact('CASE WHEN length(r.family_name) > length(l.family_name) THEN r.family_name ELSE l.family_name END')} AS f
  FROM {pairs} p JOIN {left} l ON {left_key} JOIN {right} r ON {right_key}),
{name}_b AS (SELECT *,
  CASE WHEN lf = '' OR rf = '' THEN 'unknown' WHEN lf = rf THEN 'exact' WHEN least(length(lf), length(rf)) < 4 THEN 'conflict' WHEN (lf, rf) IN (SELECT (a, b) FROM near) THEN 'similar' ELSE 'conflict' END AS fam,
  CASE WHEN lg = '' OR rg = '' THEN 'unknown' WHEN lg = rg THEN 'exact' WHEN length(lg) = 1 OR length(rg) = 1 THEN CASE WHEN substr(lg, 1, 1) = substr(rg, 1, 1) THEN 'initial' ELSE 'conflict' END
       WHEN starts_with(lg, rg) OR starts_with(rg, lg) THEN CASE WHEN least(length(lg), length(rg)) >= 4 AND abs(length(lg) - length(rg)) >= 3 THEN 'prefix' ELSE 'unknown' END
       WHEN (lg, rg) IN (SELECT (a, b) FROM far) THEN 'conflict' ELSE 'unknown' END AS giv,
  CASE WHEN p_email = 45 OR ll = '' OR rl = '' THEN 0 WHEN {derived('lc')} AND {derived('rc')} THEN 8 WHEN ll = rl OR (ll, rl) IN (SELECT (a, b) FROM alike) THEN 4 ELSE 0 END AS p_local FROM {name}_a),
{name}_c AS (SELECT *, p_email + p_phone + p_company + p_country + p_day + p_local + CASE fam WHEN 'exact' THEN 12 WHEN 'similar' THEN 6 WHEN 'conflict' THEN -25 ELSE 0 END
  + CASE giv WHEN 'exact' THEN 15 WHEN 'prefix' THEN 10 WHEN 'initial' THEN 5 WHEN 'conflict' THEN -25 ELSE 0 END AS score FROM {name}_b),
{name} AS (SELECT *, CASE WHEN score >= 80 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END AS confidence, fam = 'conflict' OR giv = 'conflict' AS identity_conflict, p_email = 45 OR p_phone > 0 AS contact_evidence FROM {name}_c)"""


def leads(body: str) -> str:
    return f"WITH {LEADS}\n{body}"


def keys(body: str) -> str:
    return f"WITH {LEADS}, {KEYS}\n{body}"


def pairs(body: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{LEADS}, {KEYS}, {tables()}, {scores('scored', 'cand')}{more}\n{body}"


def _said(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN '(blank)' ELSE '''' || {x} || '''' END"


def _both(c: str) -> str:
    return f"' (' || {_said(f'l.{c}')} || ' / ' || {_said(f'r.{c}')} || ')'"


#: Order, condition on the parts of a score, points, text.
_REASONS = (
    (1, "p_email = 45", 45, f"'identical email ' || {_said('l.email')}"),
    (1, "p_email = 8", 8, f"'same email domain ' || {_said('l.email_domain')}"),
    (2, "p_phone = 40", 40, "'identical phone number'"),
    (2, "p_phone = 30", 30, "'phone numbers agree apart from country-code formatting'"),
    (3, "fam = 'exact'", 12, f"'family name matches ' || {_said('l.family_name')}"),
    (3, "fam = 'similar'", 6, f"'family names differ by a likely typo' || {_both('family_name')}"),
    (3, "fam = 'conflict'", -25, f"'family names differ' || {_both('family_name')}"),
    (4, "giv = 'exact'", 15, f"'given name matches ' || {_said('l.given_name')}"),
    (4, "giv = 'prefix'", 10, f"'one given name is a shortening of the other' || {_both('given_name')}"),
    (4, "giv = 'initial'", 5, f"'given name initial is compatible' || {_both('given_name')}"),
    (4, "giv = 'conflict'", -25, f"'given names differ' || {_both('given_name')}"),
    (5, "p_local = 8", 8, f"'both email local parts spell the same person' || {_both('email_local')}"),
    (5, "p_local = 4", 4, "'email local parts are similar'"),
    (6, "p_company = 5", 5, f"'same company ' || {_said('l.company')}"),
    (7, "p_country = 4", 4, f"'same country ' || {_said('l.country')}"),
    (8, "p_day = 10", 10, "'both created on ' || l.created_at"),
)
_TOLD = ", ".join(f"CASE WHEN {when} THEN {{'p': {-abs(n)}, 'o': {order}, 't': {text} || ' ({n:+d})'}} END" for order, when, n, text in _REASONS)
REASONS = f""",
said AS (SELECT left_id, right_id, scored.score, list_transform(list_sort(list_filter([{_TOLD}], lambda x: x IS NOT NULL)), lambda x: x.t) AS told
  FROM scored JOIN lead l ON l.id = left_id JOIN lead r ON r.id = right_id)"""

COMPONENTS = """,
high AS (SELECT left_id, right_id FROM scored WHERE confidence = 'high'),
both_ways AS (SELECT left_id AS a, right_id AS b FROM high UNION SELECT right_id, left_id FROM high),
reach(id, root) AS (SELECT a, a FROM both_ways UNION SELECT b, root FROM reach JOIN both_ways ON a = id),
comp AS (SELECT id, min(root) AS component FROM reach GROUP BY id),
size AS (SELECT component, count(*) AS n FROM comp GROUP BY ALL),
inside AS (SELECT x.component, x.id AS left_id, y.id AS right_id FROM comp x JOIN comp y USING (component) JOIN size USING (component) WHERE x.id < y.id AND n <= 10), """

GROUPS = COMPONENTS + scores("checked", "inside") + """,
every AS (SELECT component, left_id, right_id, score, confidence, identity_conflict FROM checked
  UNION ALL SELECT component, left_id, right_id, score, confidence, false FROM scored JOIN comp ON id = left_id JOIN size USING (component) WHERE confidence = 'high' AND n > 10),
grp AS (SELECT component, arg_min(score, (score, left_id, right_id)) AS score, arg_min(confidence, (score, left_id, right_id)) AS weakest, bool_or(identity_conflict) AS internal_conflict FROM every GROUP BY component),
ids AS (SELECT component, string_agg(id, ',' ORDER BY id) AS lead_ids, count(*) AS n FROM comp GROUP BY ALL)"""

PROBES = """asked AS (SELECT sub, 1 AS probe, email AS v FROM sub WHERE email <> '' UNION ALL SELECT sub, 2, phone_last9 FROM sub WHERE phone_last9 <> ''
  UNION ALL SELECT sub, 3, email_domain || '|' || family_key FROM sub WHERE email_domain <> '' AND family_key <> '' UNION ALL SELECT sub, 4, family_key || '|' || lower(country) FROM sub WHERE family_key <> ''),
held AS (SELECT id, 1 AS probe, email AS v FROM lead WHERE email <> '' UNION ALL SELECT id, 2, phone_last9 FROM lead WHERE phone_last9 <> ''
  UNION ALL SELECT id, 3, email_domain || '|' || family_key FROM lead WHERE email_domain <> '' AND family_key <> '' UNION ALL SELECT id, 4, family_key || '|' || lower(country) FROM lead WHERE family_key <> ''),
probed AS (SELECT sub, id, min(probe) AS probe FROM asked JOIN held USING (probe, v) GROUP BY ALL)"""

MATCH = f"""{PROBES}, {scores('m', 'probed', 'sub', 'lead', 'l.sub = p.sub', 'r.id = p.id')},
ranked AS (SELECT *, p_email = 45 AS same_email, p_phone = 40 AS same_phone, row_number() OVER (PARTITION BY sub ORDER BY score DESC, probe, id) AS k FROM m),
tiered AS (SELECT *, bool_or(same_email OR same_phone) OVER (PARTITION BY sub) AS contact,
  CASE WHEN same_email AND NOT identity_conflict THEN 1 WHEN same_phone AND giv IN ('exact', 'prefix', 'initial') AND fam <> 'conflict' THEN 2 END AS tier FROM ranked),
chosen AS (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY coalesce(tier, 3), k) AS first FROM tiered WHERE tier IS NOT NULL OR (NOT contact AND k = 1 AND confidence = 'high')),
picked AS (SELECT sub, id AS matched_id, CASE coalesce(tier, 3) WHEN 1 THEN 'email' WHEN 2 THEN 'phone' ELSE 'score' END AS matched_by, score, confidence FROM chosen WHERE first = 1),
dups AS (SELECT sub, string_agg(id, ',' ORDER BY NOT (same_email OR same_phone), k) AS dups FROM tiered
  WHERE sub NOT IN (SELECT sub FROM picked) AND (same_email OR same_phone OR confidence <> 'low') GROUP BY sub)"""


def match(body: str) -> str:
    return f"WITH {LEADS}, {SUBS}, {tables()}, {MATCH}\n{body}"
