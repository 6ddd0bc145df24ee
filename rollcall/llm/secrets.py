"""Secret scans over an incremental blob ledger.

A path's version is addressed by the SHA-256 of its content.  The ledger holds one row for each
(blob, rule version) that was ever scanned, with its findings; a scan reads only blobs that the
ledger lacks, appends them, and joins findings back to all paths.  Of many paths with one blob the
smallest id's text is the one that is read; texts are joined by id and blob, so neither a blob with a
third of all paths nor rows without an id meet in a single task, and the join back is of thin rows
whose skewed side Spark may split.  Where few blobs are new, their addresses are broadcast (after a
check of their number against the session's own bound on broadcasts) and texts aren't shuffled at all.  Of the ledger only what this scan's blobs
need is read beyond its addresses.

Spans are code points, end exclusive.  A text is split by a rule's pattern and the matches are taken
beside it, so positions are running sums of lengths, made by a window over exploded matches: any
number of matches in a text costs as many rows, never an array copied for each.

Edge cases: a null text counts as empty, an empty text has no span and the digest of nothing; rows
that repeat an id are reported each; a ledger that does not exist yet is empty; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import checkpoint_folder, cut, table, text_of

#: Kind, pattern, a literal that every match contains (or none).  Base kinds come first, in order.
#: {18,} and {16,} drop the same matches that a check of the length would.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    ("assign", ASSIGN, None),
    ("access", r"AKIA[A-Z0-9]{14,}", "AKIA"),
    ("hex", r"[0-9a-f]{16,}", None),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "eyJ"),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", "gh"),
)
BASE = ("assign", "access", "hex")
VERSION = "1"
#: Bytes that a new blob's address takes in a broadcast.
ADDRESS_BYTES = 150
SPAN = "struct<start:bigint,ord:int,end:bigint,kind:string>"
LEDGER = f"blob string, version string, spans array<{SPAN}>"


def _matches(order: int, kind: str, pattern: str, literal: str | None) -> Column:
    """The text's matches of one rule, each with the length of the gap before it."""
    text = F.col("_t")
    some = F.contains(text, F.lit(literal)) if literal else text.rlike(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ok = lambda x: (F.length(F.regexp_extract(x, pattern, 2)) >= 12) if kind == "assign" else F.lit(True)
    found = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.lit(order).alias("ord"), F.lit(kind).alias("kind"), g.cast("long").alias("gap"), F.length(h).cast("long").alias("len"), ok(h).alias("ok")))
    return F.when(some, found).otherwise(F.array().cast("array<struct<ord:int,kind:string,gap:bigint,len:bigint,ok:boolean>>"))


def scanned(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, spans) for each distinct blob of (blob, _t): a row for blobs without findings too."""
    each = blobs.select("blob", F.concat(*(_matches(k, *rule) for k, rule in enumerate(rules))).alias("m"))
    each = each.select("blob", F.posexplode_outer("m").alias("k", "m")).select("blob", "k", "m.*").dropDuplicates(["blob", "k"])
    before = Window.partitionBy("blob", "ord").orderBy("k")
    at = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before))
    span = F.when(F.col("ok"), F.struct((F.col("end") - F.col("len")).alias("start"), "ord", "end", "kind"))
    return at.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).parquet(folder) if there else spark.createDataFrame([], LEDGER)


def scan(docs: DataFrame, ledger: str, rules=RULES, version: str = VERSION) -> DataFrame:
    """(doc_id, blob, spans) for every row of ``docs``; the ledger folder gains what it lacked.

    Call it for each new version of the paths with the same folder: known blobs are not read."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_t"))
    paths = cut(rows.select("doc_id", F.sha2(F.col("_t").cast("binary"), 256).alias("blob")))
    known = _ledger(spark, ledger).filter(F.col("version") == version)
    blobs = cut(paths.groupBy("blob").agg(F.min("doc_id").alias("rep")))
    new = cut(blobs.join(known.select("blob"), "blob", "left_anti").withColumnRenamed("blob", "_blob"))
    most = max(0, spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() // ADDRESS_BYTES)
    new = F.broadcast(new) if new.limit(most + 1).count() <= most else new.hint("shuffle_hash")
    addressed = rows.withColumn("blob", F.sha2(F.col("_t").cast("binary"), 256))
    texts = addressed.join(new, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("blob") == F.col("_blob")))
    found = scanned(texts.select("blob", "_t"), rules).select("blob", F.lit(version).alias("version"), "spans")
    found.write.mode("append").parquet(ledger)
    told = _ledger(spark, ledger).filter(F.col("version") == version).join(blobs.select("blob"), "blob", "left_semi")
    told = cut(told.groupBy("blob").agg(F.first("spans").alias("spans")))  # a repeated attempt may have appended twice
    return paths.join(told, "blob").select("doc_id", "blob", "spans")


def digests(found: DataFrame, base=BASE) -> DataFrame:
    """The counts and digests of the contract from (doc_id, spans)."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *(of(k) for k in base), F.sha2(line(own).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/ledger-{uuid.uuid4().hex}"
    return digests(scan(table(spark, sf_dir, "documents"), folder))


def _sql() -> str:
    kinds = ", ".join(f"({k}, '{kind}', '{pattern.replace(chr(39), chr(39) * 2)}')" for k, (kind, pattern, _) in enumerate(RULES))
    return f"""
WITH rule(ord, kind, pat) AS (VALUES {kinds}),
t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, ord, kind, pat, regexp_extract_all(t, pat) AS hits, string_split_regex(t, pat) AS gaps FROM t, rule WHERE regexp_matches(t, pat)),
e AS (SELECT r, ord, kind, pat, unnest(range(1, len(hits) + 1)) AS k, hits, gaps FROM m),
p AS (SELECT r, ord, kind, pat, hits[k] AS hit, sum(length(gaps[k]) + length(hits[k])) OVER (PARTITION BY r, ord ORDER BY k) AS stop FROM e),
s AS (SELECT r, ord, kind, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM p
      WHERE kind <> 'assign' OR length(regexp_extract(hit, pat, 2)) >= 12),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS h,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3) AS base FROM s GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (r)
"""


OP4_SQL = _sql()
