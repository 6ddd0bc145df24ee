"""URL filters with redirect equivalence.

Explicit rules (verdict, host, path) fit a host and its subdomains where the path starts with the
rule's; the longest wins.  Urls that redirect to each other, or name each other as canonical, are
aliases: distributed connected components over those edges carry a block from any alias to all, and
an explicit allow anywhere in the component takes precedence.  A url that a rule fits keeps that
rule's verdict.  Edges come from the pages' own canonical links and refresh tags and, if given, from
a table of redirects.

An address is the same with any scheme, fragment or trailing slash.  All canonical links and refresh
tags of a page count; entities in targets are decoded, and relative targets resolved against the
page's own path.  Up to ``MOST_RULES`` rules become one conditional expression, so judging reads each
row once.  More of them are a table: each distinct host and path is exploded into its host's suffixes
and its path's prefixes of the lengths that rules have, and joined by equality.  Joins are on
addresses, thin, and of a kind whose skewed side Spark may split.

Edge cases: a null url, or one without ``://``, has empty host and path, no rule and no alias and is
allowed; null html has no link; repeated rows are judged each; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .frames import cut, table

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MOST_RULES = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, address) of a url; empty where there is none."""
    at = F.locate("://", url)
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.expr("substring(_u, locate('://', _u) + 3)")).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)?", 1)
    host = F.translate(raw, UPPER, LOWER)
    return host, path, F.concat(host, F.regexp_replace(path, "/+$", ""), query)


def addressed(df: DataFrame, url: str) -> DataFrame:
    df = df.withColumn("_u", F.col(url).cast("string"))
    host, path, address = parts(F.col("_u"))
    return df.withColumns({"_host": host, "_path": path, "_address": F.when(host != "", address)}).drop("_u")


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of _host and _path: the first that fits, longest first."""
    name, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for v, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("_host") == host) | F.endswith("_host", F.lit("." + host))) & F.startswith("_path", F.lit(path))
        name, verdict = name.when(fits, host + path), verdict.when(fits, v)
    return name, verdict


def with_rules(rows: DataFrame, rules=RULES) -> DataFrame:
    """``rows`` (_host, _path and others) with rule and _own, its verdict, null where none fits.

    ``rules`` are (verdict, host, path) tuples, or a DataFrame of columns with these names."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= MOST_RULES:
            name, verdict = rule_of(rules)
            return rows.select("*", name.alias("rule"), verdict.alias("_own"))
        rules = rows.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    table_ = rules.select("verdict", F.col("host").alias("_rh"), F.col("path").alias("_rp"))
    lengths = [r[0] for r in table_.select(F.length("_rp")).distinct().collect()]  # no more than a url is long
    places = rows.select("_host", "_path").distinct()
    suffix = F.expr("transform(sequence(1, size(split(_host, '[.]'))), k -> array_join(slice(split(_host, '[.]'), k, size(split(_host, '[.]'))), '.'))")
    prefix = F.transform(F.filter(F.array(*(F.lit(n) for n in sorted(lengths))), lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n))
    each = places.select("_host", "_path", F.explode(suffix).alias("_rh"), prefix.alias("_p")).select("_host", "_path", "_rh", F.explode("_p").alias("_rp"))
    fits = each.join(table_, ["_rh", "_rp"])
    best = fits.groupBy("_host", "_path").agg(F.min(F.struct((-F.length("_rh") - F.length("_rp")).alias("n"), "verdict", "_rh", "_rp")).alias("b"))
    best = best.select(F.col("_host").alias("_bh"), F.col("_path").alias("_bp"), F.concat("b._rh", "b._rp").alias("rule"), F.col("b.verdict").alias("_own"))
    return rows.join(best, (F.col("_host") == F.col("_bh")) & (F.col("_path") == F.col("_bp")), "left").drop("_bh", "_bp")


#: The entities that addresses hold, the ampersand last.
ENTITIES = (("&#x2F;", "/"), ("&#47;", "/"), ("&#x3D;", "="), ("&#61;", "="), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def resolved(base: Column, target: Column) -> Column:
    """A target as an address names it from page ``base``: absolute, of its own host, from the root, or
    relative to the page's folder, with its dots resolved."""
    host = F.regexp_extract(base, r"://([^/?#]*)", 1)
    path = F.regexp_extract(base, r"://[^/?#]*([^?#]*)", 1)
    absolute = target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    asked = F.regexp_extract(target, r"^([^?#]*)", 1)
    rest = F.substring(target, F.length(asked) + 1, F.length(target))
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    full = F.when(F.startswith(asked, F.lit("/")), asked).when(asked == "", path).otherwise(F.concat(folder, asked))
    steps = F.slice(F.split(full, "/", -1), 2, F.size(F.split(full, "/", -1)))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    ends = F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(kept) > 0), F.concat(F.array_join(kept, "/"), F.lit("/"))).otherwise(F.array_join(kept, "/"))
    own = F.concat(F.lit("x://"), host, F.when(full == "", "").otherwise(F.concat(F.lit("/"), ends)), rest)
    return F.when(absolute, target).when(F.startswith(target, F.lit("//")), F.concat(F.lit("x:"), target)).otherwise(own)


def links(pages: DataFrame) -> DataFrame:
    """(_from, _to): urls and all that their html names as canonical or refreshes to."""
    html = F.col("html").cast("string")
    some = pages.select(F.col("url").cast("string").alias("_from"), html.alias("_html")).filter(F.col("_html").rlike(r"(?i)\bcanonical\b|\brefresh\b") & F.contains("_from", F.lit("://")))
    tags = lambda pattern: F.regexp_extract_all("_html", F.lit(pattern), F.lit(0))
    rel = lambda tag: F.lower(F.regexp_extract(tag, r"""(?is)\brel\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1))
    named = lambda tag, key: F.regexp_extract(tag, rf"""(?is)\b{key}\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    canonical = F.transform(F.filter(tags(r"(?is)<link\b[^>]*>"), lambda t: rel(t).rlike(r"(^|[\s\"'])canonical($|[\s\"'])")), lambda t: named(t, "href"))
    refresh = F.transform(F.filter(tags(r"(?is)<meta\b[^>]*>"), lambda t: t.rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b""")), lambda t: named(t, "url"))
    each = some.select("_from", F.explode(F.concat(canonical, refresh)).alias("_to"))
    to = F.col("_to")
    for entity, character in ENTITIES:
        to = F.replace(to, F.lit(entity), F.lit(character))
    each = each.select("_from", to.alias("_to")).filter("_to <> ''")
    return each.select("_from", resolved(F.col("_from"), F.col("_to")).alias("_to")).distinct()


def judged(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``; ``redirects`` is (source, target)."""
    edges = links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(F.col("source").cast("string"), F.col("target").cast("string")))
    ends = addressed(edges, "_from").withColumnsRenamed({"_address": "_a", "_host": "_fh", "_path": "_fp"})
    ends = addressed(ends, "_to").filter("_a IS NOT NULL AND _address IS NOT NULL")
    ends = cut(ends.select("_a", "_fh", "_fp", "_address", "_host", "_path"))
    rows = with_rules(addressed(pages.select(F.col("page_id"), F.col("url")), "url").select("page_id", "_host", "_path", "_address"), rules)
    # An alias is judged as each url that names it is written: a trailing slash can make a rule fit.
    each = ends.select(F.col("_a").alias("node"), F.col("_fh").alias("_host"), F.col("_fp").alias("_path")).union(ends.select("_address", "_host", "_path"))
    each = with_rules(each, rules).select("node", "_own")
    of = components(ends.select(F.col("_a").alias("a"), F.col("_address").alias("b")))
    decided = each.join(of, "node").groupBy("root").agg(F.bool_or(F.col("_own") == "allow").alias("allow"), F.bool_or(F.col("_own") == "block").alias("block"))
    decided = decided.select("root", F.when(F.col("allow"), "allow").when(F.col("block"), "block").alias("_alias")).filter("_alias IS NOT NULL")
    aliases = cut(of.join(decided, "root").select(F.col("node").alias("_address"), "_alias"))
    rows = rows.join(aliases, "_address", "left")
    return rows.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", F.coalesce("_own", "_alias", F.lit("allow")).alias("verdict"))


def op5_url_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


#: The synthetic pages hold no canonical link or refresh, so here the rules decide; tests hold aliases.
OP5_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rule(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT h.page_id, h.host, h.path, rule.host || rule.path AS rule, rule.verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rule.host || rule.path) DESC) AS k
      FROM h LEFT JOIN rule ON (h.host = rule.host OR ends_with(h.host, '.' || rule.host)) AND starts_with(h.path, rule.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""


def redirect_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over pages and a table of redirects made from them, each page's url to the next one's but
    every fourth: chains that carry blocks, on data whose html names no alias itself."""
    pages = table(spark, sf_dir, "pages")
    named = pages.select("page_id", "url")
    after = named.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("target"))
    chain = named.filter("page_id % 4 <> 0").join(after, "page_id").select(F.col("url").alias("source"), "target")
    return judged(pages, redirects=chain)


REDIRECT_SQL = OP5_SQL.rsplit("SELECT page_id, host", 1)[0].replace("WITH u AS", "WITH RECURSIVE u AS") + r""",
own AS (SELECT f.page_id, f.host, f.path, f.rule, f.verdict, f.host || regexp_replace(f.path, '/+$', '') || coalesce(regexp_extract(r, '^[^?#]*(\?[^#]*)?', 1), '') AS address FROM f JOIN u USING (page_id) WHERE k = 1),
edge AS (SELECT DISTINCT a.address AS a, b.address AS b FROM own a JOIN own b ON b.page_id = a.page_id + 1 WHERE a.page_id % 4 <> 0 AND a.host <> '' AND b.host <> ''),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(node, root) AS (SELECT a, a FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node),
comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
told AS (SELECT root, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked FROM comp JOIN own ON address = node GROUP BY root)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM own LEFT JOIN comp ON address = node AND host <> '' LEFT JOIN told USING (root)
"""
