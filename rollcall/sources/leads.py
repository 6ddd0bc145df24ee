"""Reading raw exports and form submissions, projecting them to records, and writing them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import source as src
from ..functions import taxonomy as tx
from ..functions import text as nz

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in tx.RAW_COLUMNS])
FORM_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in tx.FORM_FIELDS])
_TYPES = {"lead_score": T.IntegerType(), "source_needs_review": T.BooleanType()}
LEAD_SCHEMA = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in tx.LEAD_COLUMNS])
_CSV = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The raw CSV export: all strings, quoted fields may span lines."""
    return spark.read.csv(path, schema=RAW_SCHEMA, multiLine=True, **_CSV)


def read_submissions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Form submissions: one JSON array a file, or one object a line (which splits and streams)."""
    return spark.read.schema(FORM_SCHEMA).json(path, multiLine=not lines)


def _source_columns(extraction: Column) -> dict[str, Column]:
    return {
        "source_channel": extraction["channel"], "source_detail": extraction["detail"], "source_confidence": extraction["confidence"],
        "source_method": extraction["method"], "source_needs_review": extraction["needs_review"]}


def project_leads(raw: DataFrame) -> DataFrame:
    """Raw export rows as records, in one narrow projection; unmodelled columns stay in raw_record."""
    c = {name: (F.col(f"`{name}`") if name in raw.columns else F.lit(None).cast("string")) for name in tx.RAW_COLUMNS}
    given, family, display = nz.resolve_name(c["First Name"], c["Last Name"], c["Full Name"])
    first = raw.select(
        nz.collapse(c["Record ID"]).alias("id"), display.alias("display_name"), given.alias("given_name"), family.alias("family_name"),
        nz.name_key(family).alias("family_key"), nz.collapse(c["Company Name"]).alias("company"), nz.company_norm(c["Company Name"]).alias("company_norm"),
        nz.collapse(c["Job Title"]).alias("job_title"), nz.email(c["Email"]).alias("email"), nz.collapse(c["Phone Number"]).alias("phone"),
        nz.phone_digits(c["Phone Number"]).alias("phone_digits"), nz.country(c["Country/Region"]).alias("country"), nz.status(c["Lead Status"]).alias("status"),
        nz.collapse(c["Lifecycle Stage"]).alias("lifecycle_stage"), nz.collapse(c["Contact Owner"]).alias("owner"), nz.whole_number(c["Lead Score"]).alias("lead_score"),
        nz.iso(nz.parse_date(c["Create Date"])).alias("created_at"), nz.iso(nz.parse_date(c["Last Modified Date"])).alias("last_modified_at"),
        nz.notes_text(c["Notes"]).alias("notes"), F.to_json(F.struct(*(F.col(f"`{x}`") for x in raw.columns)), {"ignoreNullFields": "false"}).alias("raw_record"))
    at = first.withColumns({
        "email_local": nz.email_local(F.col("email")), "email_domain": nz.email_domain(F.col("email")), "phone_last9": nz.phone_last9(F.col("phone_digits"))})
    return src.with_extraction(at, F.col("notes"), "_source").withColumns(_source_columns(F.col("_source"))).select(*tx.LEAD_COLUMNS)


def valid_submissions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a submission needs a name and a valid address.  Fields are trimmed, but
    for phone and time; others are ignored."""
    has = lambda f: F.col(f"`{f}`").cast("string") if f in rows.columns else F.lit(None).cast("string")
    given = {f: has(f) for f in tx.FORM_FIELDS}
    clean = {f: nz.blank(given[f]) if f in ("phone", "submitted_at") else nz.email(given[f]) if f == "email" else nz.collapse(given[f]) for f in tx.FORM_FIELDS}
    others = [F.col(f"`{c}`") for c in rows.columns if c not in tx.FORM_FIELDS]
    at = rows.select(*others, *(v.alias(f) for f, v in clean.items()))
    ok = (F.col("name") != "") & nz.email_valid(F.col("email"))
    return at.filter(ok), at.filter(~ok)


def project_submissions(accepted: DataFrame) -> DataFrame:
    """Accepted submissions with a record each, in ``lead``, and the message's ``source``."""
    given, family = nz.split_name(F.col("name"))
    created = F.when(F.col("submitted_at") != "", nz.iso(nz.parse_date(F.substring("submitted_at", 1, 10))))
    at = accepted.withColumns({
        "_given": given, "_family": family, "_key": nz.name_key(family), "_norm": nz.company_norm(F.col("company")),
        "_digits": nz.phone_digits(F.col("phone")), "_created": created})
    none = F.lit(None).cast("string")
    lead = {
        "id": F.lit(""), "display_name": F.col("name"), "given_name": F.col("_given"), "family_name": F.col("_family"), "family_key": F.col("_key"),
        "company": nz.collapse(F.col("company")), "company_norm": F.col("_norm"), "job_title": F.lit(""), "email": F.col("email"),
        "email_local": nz.email_local(F.col("email")), "email_domain": nz.email_domain(F.col("email")), "phone": nz.collapse(F.col("phone")),
        "phone_digits": F.col("_digits"), "phone_last9": nz.phone_last9(F.col("_digits")), "country": nz.country(F.col("country")), "status": none,
        "lifecycle_stage": F.lit(""), "owner": F.lit(""), "lead_score": F.lit(None).cast("int"), "created_at": F.col("_created"), "last_modified_at": none,
        "notes": F.lit(""), "source_channel": none, "source_detail": none, "source_confidence": none, "source_method": none,
        "source_needs_review": F.lit(False), "raw_record": none}
    record = F.struct(*(lead[c].alias(c) for c in tx.LEAD_COLUMNS))
    return src.with_extraction(at.withColumn("lead", record), F.col("message"), "source").drop("_given", "_family", "_key", "_norm", "_digits", "_created")


def coverage(raw: DataFrame) -> DataFrame:
    """(column_name, n, state) of each raw column in one pass; a column is empty at 0, sparse below 60 %."""
    columns = [c for c in tx.RAW_COLUMNS if c in raw.columns]
    sums = raw.agg(F.count("*").alias("_total"), *(F.count(F.when(nz.collapse(F.col(f"`{c}`")) != "", 1)).alias(c) for c in columns))
    each = sums.unpivot(["_total"], [F.col(f"`{c}`") for c in columns], "column_name", "n")
    return each.select("column_name", "n", F.when(F.col("n") == 0, "empty").when(F.col("n") < 0.6 * F.col("_total"), "sparse").otherwise("filled").alias("state"))


def export_view(leads: DataFrame) -> DataFrame:
    """The export's fixed columns as text: null is blank, booleans are True and False."""
    text = lambda c: F.initcap(F.col(c).cast("string")) if dict(leads.dtypes)[c] == "boolean" else F.col(c).cast("string")
    return leads.select(*(nz.blank(text(c)).alias(c) for c in tx.EXPORT_COLUMNS))


def write_export(leads: DataFrame, path: str, single_file: bool = True, mode: str = "errorifexists") -> None:
    """CSV with a header, even of no rows.  One file for a person, or a part for each task."""
    view = export_view(leads)
    view = view.coalesce(1) if single_file else view
    view.write.mode(mode).csv(path, emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n", **_CSV)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def is_populated(spark: SparkSession, table: str) -> bool:
    return exists(spark, table) and not spark.read.parquet(table).isEmpty()


def load(spark: SparkSession, export: str, table: str, force: bool = False) -> int:
    """Loads an export into a Parquet table of records: rows written, 0 if it is populated already."""
    if not force and is_populated(spark, table):
        return 0
    project_leads(read_export(spark, export)).write.mode("overwrite").parquet(table)
    return spark.read.parquet(table).count()


def insert(leads: DataFrame, row: DataFrame) -> DataFrame:
    """``leads`` with more rows, by name."""
    return leads.unionByName(row.select(*tx.LEAD_COLUMNS))


def update_fields(leads: DataFrame, changes: DataFrame) -> DataFrame:
    """``leads`` with the columns of ``changes`` (id and some record columns) where those aren't null."""
    unknown = set(changes.columns) - set(leads.columns)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    own = changes.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c != "id"))
    at = leads.join(own, F.col("id") == F.col("_id"), "left")
    return at.select(*((F.coalesce(f"_new_{c}", c) if c in changes.columns and c != "id" else F.col(c)).alias(c) for c in leads.columns))
