"""Exact dedup by Grace hashing.

Records are dealt by a 64-bit hash of their normalised text.  A task partitions its records
recursively into spill files until a bucket fits an open-addressing table, which compares
complete content, never digests alone.  A record has the largest id of its rows, how many rows it
stands for and how many of them hold that id, so it decides which row stays; only rows that repeat
both id and text need a tie broken, by their place in the table.

Before the shuffle every scan task runs the same table over its own rows, so a text crosses the
network once for each scan task at most and a group holding a third of all rows adds no more than
one record for each of them.  Decisions go back to rows by a thin (id, digest) join.

Edge cases: a null text counts as empty; a null id loses against any other; rows that repeat an id
and a text are one group of which one row stays; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut, one_each, packed, small, table, text_of, text_rows, unpacked

#: Bytes of distinct text that a table holds before its records go to spill files.
TABLE_BYTES = 32 << 20
FANOUT = 16
PARTIAL = "h long, text binary, keep_id long, n long, ties long"


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed (bytes.lower is ASCII only)."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


#: Hash, text, largest id, rows, rows with that id.
Record = tuple[int, bytes, int | None, int, int]


class Table:
    """Open addressing with linear probing; equal means equal in every byte."""

    def __init__(self, slots: int = 1 << 12) -> None:
        self.slots = np.full(slots, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.ties: list[int] = []
        self.bytes = 0

    def add(self, h: int, text: bytes, doc: int | None, n: int, ties: int = 1) -> None:
        if 2 * len(self.texts) >= len(self.slots):
            self._grow()
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.texts[k] == text:
                if doc == self.ids[k]:
                    self.ties[k] += ties
                elif self.ids[k] is None or (doc is not None and doc > self.ids[k]):
                    self.ids[k], self.ties[k] = doc, ties
                self.counts[k] += n
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.ids.append(doc)
        self.counts.append(n)
        self.ties.append(ties)
        self.bytes += len(text) + 160

    def _grow(self) -> None:
        slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
        mask = len(slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = k
        self.slots = slots

    def records(self) -> Iterator[Record]:
        return zip(self.hashes, self.texts, self.ids, self.counts, self.ties)


def grace(records: Iterator[Record], budget: int = TABLE_BYTES, depth: int = 0, folder: str | None = None) -> Iterator[Record]:
    """Distinct records.  Beyond ``budget`` bytes of distinct text what follows is dealt to
    FANOUT spill files by the next bits of the hash, and each file is treated the same way."""
    held, files, own = Table(), [], None
    shift = 60 - 4 * depth
    try:
        for record in records:
            if not files and (held.bytes < budget or shift < 0):
                held.add(*record)
                continue
            if not files:
                own = tempfile.mkdtemp(prefix="grace-", dir=folder)
                files = [open(os.path.join(own, str(k)), "w+b") for k in range(FANOUT)]
                for r in held.records():
                    pickle.dump(r, files[(r[0] >> shift) & (FANOUT - 1)], 5)
                held = Table()
            pickle.dump(record, files[(record[0] >> shift) & (FANOUT - 1)], 5)
        if not files:
            yield from held.records()
        for f in files:
            f.seek(0)
            yield from grace(_stored(f), budget, depth + 1, own)
            f.close()
    finally:
        if own:
            for f in files:
                f.close()
            shutil.rmtree(own, ignore_errors=True)


def _stored(f) -> Iterator[Record]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _batches(records: Iterator[tuple], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of a bounded size of text."""
    rows: list[tuple] = []
    size = 0
    names = ["h", "text", "keep_id", "n", "ties"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for h, *rest in records:
        rows.append((h - (1 << 64) if h >> 63 else h, *rest))
        text = rest[0]
        size += len(text) + 64
        if size >= limit:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def _distinct_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan side: a task's own distinct texts; a full table is handed on and begun anew."""

    def records() -> Iterator[tuple]:
        held = Table()
        for b in small(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = normalised(text)
                held.add(xxhash.xxh64_intdigest(t), t, doc, 1)
            if held.bytes >= TABLE_BYTES:
                yield from held.records()
                held = Table()
        yield from held.records()

    yield from _batches(records())


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket side: Grace hashing of the dealt records, out as one row for each distinct text."""

    def records() -> Iterator[tuple]:
        for b in small(batches):
            for h, *rest in zip(*(b.column(k).to_pylist() for k in range(5))):
                yield h & ((1 << 64) - 1), *rest

    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        c = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.binary()), *(pa.array(x, pa.int64()) for x in c[1:])], names=["sha", "keep_id", "group_size", "ties"])

    for _, text, *rest in grace(records()):
        out.append((hashlib.sha256(text).digest(), *rest))
        if len(out) == 20_000:
            yield batch()
            out = []
    if out:
        yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        sha = [hashlib.sha256(normalised(t)).digest() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha, pa.binary())], names=["doc_id", "sha"])


def groups(docs: DataFrame) -> DataFrame:
    """(sha, keep_id, group_size, ties): one row for each distinct normalised text."""
    rows = text_rows(docs)
    partial = rows.mapInArrow(_distinct_here, PARTIAL)
    return partial.repartition("h").mapInArrow(_merge, "sha binary, keep_id long, group_size long, ties long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Of rows that repeat an id and a text, ``kept`` is true for one."""
    rows = text_rows(docs)
    thin = cut(rows.mapInArrow(_digests, "doc_id long, sha binary").select("doc_id", "sha", F.monotonically_increasing_id().alias("uid")))
    decided = cut(groups(docs))
    at = thin.join(decided, "sha").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if not decided.filter("ties > 1").isEmpty():  # an exact finding, on one row for each distinct text
        last = at.filter("kept AND ties > 1").groupBy("sha").agg(F.max("uid").alias("last")).withColumnRenamed("sha", "_sha")
        at = at.join(last, (F.col("sha") == F.col("_sha")) & (F.col("uid") <= F.col("last")), "left")
        at = at.withColumn("kept", F.col("kept") & ((F.col("ties") == 1) | F.coalesce(F.col("uid") == F.col("last"), F.lit(False))))
    return at.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """The documents without exact copies: of each group the row with the largest id stays."""
    found = cut(exact_groups(docs))
    by_id = found.groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("stays"), F.count("*").alias("n"))
    twice = not by_id.filter("n > 1").isEmpty()
    losers = by_id.filter(~F.col("stays"))
    sha = F.sha2(F.translate(text_of(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary"), 256)
    losers = losers.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    rows = packed(docs, _id=F.col("doc_id").cast("long"), _sha=sha)
    stay = rows.join(losers, rows["_id"].eqNullSafe(losers["_id"]) & (rows["_sha"] == losers["_sha"]), "left_anti")
    return unpacked(one_each(stay, ["_id", "_sha"], twice), docs)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY s ORDER BY doc_id DESC) = 1 AS kept, s AS text_sha256
FROM t WINDOW g AS (PARTITION BY s)
"""
