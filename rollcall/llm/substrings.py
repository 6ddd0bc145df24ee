"""Substring dedup by content-defined chunking.

A gear rolling hash runs over the words of a text, joined by single spaces and lower-cased (A-Z); a
chunk ends at a word whose last byte's hash is less than those of the ``AROUND`` words at either side
(of equal ones the first), so chunks have ``AROUND`` + 1 words or more, and at most ``MOST``.  The hash
sees the last 16 bytes only, so an insertion moves no end but near itself.  What is compared are
runs of neighbouring chunks, from each chunk on the fewest that hold ``least_words`` words, by a 96-bit
digest of the run's text: of equal runs those of the first document, by id, stay, the others are copies.
So each copy stands, as it is, in one earlier document; short phrases of unrelated documents make none.
Copies that overlap are joined into a span, in code points of the original text.  A span may also join
overlapping copies of several earlier documents.

Texts are divided once, a batch of them in one array.  The thin rows of their runs are written to the
shared folder, then counted with partial aggregation and joined back by digest, with the rows on the
side that Spark may split; spans are made for each document from its own runs.

Edge cases: null and empty texts have no chunk; text of fewer words than a run has none; rows that
repeat an id are told apart by a hash of the text, the order among them, and are one document if that
is equal too; a null id is the smallest; an empty table gives an empty result; extra columns are
ignored, and carried by ``without_copies``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import checkpoint_folder, packed, small, table, text_of, text_rows

AROUND, MOST = 3, 64
#: Words that neighbouring copies must hold together.  A passage that repeats loses ``AROUND`` words and
#: what it shares of a chunk at either side, so one of over 50 words keeps enough.
LEAST_WORDS = 20
#: No UTF-8 text holds this byte: it parts the texts of a batch, and adds nothing to the hash.
PAD = 0xFF
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) if b != PAD else 0 for b in range(256)], np.uint32)
SPACES = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E), PAD))
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of text that are divided together.
BATCH_BYTES = 1 << 20


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: sum of gear values shifted by their distance, 16 bytes back."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        earlier = np.zeros_like(h)
        earlier[step:] = h[:-step]
        h = h + (earlier << np.uint32(step))
    return h


def least_around(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where a word's hash is the least around it within its text, ``of`` being each word's text."""
    place = np.arange(len(h)) + AROUND * (1 + np.cumsum(np.append(0, of[1:] != of[:-1])))
    wide = np.full(place[-1] + AROUND + 1, 1 << 32, np.int64)
    wide[place] = h
    out = np.ones(len(h), bool)
    for k in range(1, AROUND + 1):
        out &= (h < wide[place - k]) & (h <= wide[place + k])
    return out


def chunk_ends(stops: list[int], n: int) -> list[int]:
    """Word numbers after each chunk's last word: at ``stops`` and the end, and ``MOST`` words apart at most."""
    ends, begin = [], 0
    for s in stops if stops and stops[-1] == n - 1 else [*stops, n - 1]:
        while s - begin >= MOST:  # no end of its own within the bound
            begin += MOST
            ends.append(begin)
        begin = s + 1
        ends.append(begin)
    return ends


def divided(texts: list[str]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text with a word: its number, all words in one line, and of each chunk, in order, its first
    byte there, the byte after its last, its start and end in code points of the text, and its words."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer((bytes([PAD]) * 16).join([b"", *data, b""]), np.uint8)
    space = SPACES[raw]
    first = np.flatnonzero(~space & np.append(True, space[:-1]))  # each word's first byte
    if not len(first):
        return
    last = np.flatnonzero(~space & np.append(space[1:], True))
    offset = np.cumsum([16, *(len(d) + 16 for d in data)])
    of = np.searchsorted(offset, first, "right") - 1
    # Words by single spaces, texts by padding: what follows a word's last byte is one space or 16 pads.
    new = np.append(True, of[1:] != of[:-1])
    gap = np.where(new, 16, 1)
    length = last - first + 1
    at = np.cumsum(gap + length) - length  # each word's first byte in the line
    line = np.full(int(at[-1] + length[-1]), 0x20, np.uint8)
    kept = ~space
    line[np.repeat(at - first, length) + np.flatnonzero(kept)] = LOWER[raw[kept]]
    begin = np.flatnonzero(new)
    line[(at[begin][:, None] - np.arange(1, 17)).ravel()] = PAD
    final = at + length - 1
    stop = least_around(gear(line)[final].astype(np.int64), of)
    points = np.cumsum((raw & 0xC0) != 0x80)
    whole = line.tobytes()
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(first)]):
        k = int(of[a])
        ends = np.array(chunk_ends(np.flatnonzero(stop[a:b]).tolist(), b - a), np.int64)
        starts = np.append(0, ends[:-1])
        zero, base = int(at[a]), int(points[offset[k]]) - 1
        i, j = a + starts, a + ends - 1
        yield k, whole[zero : int(final[b - 1]) + 1], at[i] - zero, final[j] + 1 - zero, points[first[i]] - 1 - base, points[last[j]] - base, ends - starts


def runs_of(found: tuple, least_words: int = LEAST_WORDS) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digests, starts, ends in code points, words before, words) of a divided text's runs of chunks: from
    each chunk on the fewest that hold ``least_words``, and for each chunk that ends none of these the
    fewest up to it, and two neighbours that both hold as many.  In any passage these cover all whole
    chunks, each overlapping the next."""
    _, line, a, b, starts, ends, words = found
    before = np.concatenate([[0], np.cumsum(words)])
    n, every = len(words), np.arange(len(words))
    until = np.searchsorted(before, before[:-1] + least_words) - 1
    since = np.searchsorted(before, before[1:] - least_words, "right") - 1
    back = np.flatnonzero((since >= 0) & (until[since] < every))
    whole = np.flatnonzero(until < n)
    pair = np.flatnonzero((words[:-1] >= least_words) & (words[1:] >= least_words))
    i, j = np.concatenate([whole, since[back], pair]), np.concatenate([until[whole], back, pair + 1])
    digests = [xxhash.xxh3_128_digest(line[x:y]) for x, y in zip(a[i].tolist(), b[j].tolist())]
    return digests, starts[i], ends[j], before[i], before[j + 1] - before[i]


RUN = "d long, e int, doc_id long, th int, before int, words int, start int, end int"


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Texts, null as empty, in groups of about ``BATCH_BYTES``, each with the number of its first."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH_BYTES:
            yield at, [x or "" for x in texts[at : k + 1]]
            at, size = k + 1, 0
    yield at, [x or "" for x in texts[at:]]


def _run_rows(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    """Fixed-width rows: digest (d, e), document, hash of its text, words before and in the run, start and end."""
    for b in small(batches):
        ids, hashes = b.column(0), b.column(2)
        for base, texts in _groups(b.column(1).to_pylist()):
            digests: list[bytes] = []
            parts, of = [], []
            for found in divided(texts):
                own, starts, ends, before, words = runs_of(found, least_words)
                digests += own
                parts.append((before, words, starts, ends))
                of.append((base + found[0], len(own)))
            if not digests:
                continue
            raw = np.frombuffer(b"".join(digests), "<i4").reshape(-1, 4)
            rows = pa.array(np.repeat([k for k, _ in of], [n for _, n in of]))
            rest = (pa.array(np.concatenate(c).astype(np.int32)) for c in zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(raw[:, :2]).view("<i8").ravel()), pa.array(np.ascontiguousarray(raw[:, 2])), ids.take(rows), hashes.take(rows), *rest],
                names=["d", "e", "doc_id", "th", "before", "words", "start", "end"])


def _text_hash():
    return F.hash(text_of())


def copies(docs: DataFrame, within: bool = False, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, th, before, words, start, end, first_id): every run of chunks that an earlier document
    holds, and, if ``within``, every run that its own document holds earlier."""
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/runs-{uuid.uuid4().hex}"
    text_rows(docs, _text_hash().alias("th")).mapInArrow(lambda batches: _run_rows(batches, least_words), RUN).write.option("compression", "zstd").parquet(folder)
    pack = "shiftleft(cast({0} AS bigint), 32) | {1} AS {2}"  # half as wide in the shuffle
    rows = spark.read.schema(RUN).parquet(folder).selectExpr("d", "e", "doc_id", "th", pack.format("before", "words", "place"), pack.format("start", "end", "span"))
    own = F.struct("doc_id", "th", "place") if within else F.struct("doc_id", "th")
    first = rows.groupBy("d", "e").agg(F.min(own).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    found = rows.join(first, ["d", "e"]).filter(own != F.col("first"))
    low = "cast({0} & 4294967295L as int)"
    return found.select(
        "doc_id", "th", F.shiftright("place", 32).cast("int").alias("before"), F.expr(low.format("place")).alias("words"),
        F.shiftright("span", 32).cast("int").alias("start"), F.expr(low.format("span")).alias("end"), F.col("first.doc_id").alias("first_id"))


def duplicate_spans(docs: DataFrame, least_words: int = LEAST_WORDS, within: bool = False) -> DataFrame:
    """(doc_id, th, spans, first_ids) for documents with copied spans; th is a hash of the text,
    first_ids are the documents that hold the first occurrences."""
    own = copies(docs, within, least_words).withColumn("after", F.col("before") + F.col("words")).repartition("doc_id", "th")
    order = Window.partitionBy("doc_id", "th").orderBy("before", "after")
    apart = F.col("before") >= F.coalesce(F.max("after").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = own.groupBy("doc_id", "th", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("after") - F.min("before")).cast("long").alias("words"), F.collect_set("first_id").alias("ids"))
    return joined.groupBy("doc_id", "th").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "words"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("first_ids"))


def _cut_out(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"]
    return "".join([*out, text[at:]])


def without_copies(docs: DataFrame, least_words: int = LEAST_WORDS, within: bool = False) -> DataFrame:
    """``docs`` with copied spans taken out of their texts; n_chars, where there is one, follows the text."""
    found = duplicate_spans(docs, least_words, within).select(F.col("doc_id").alias("_fd"), F.col("th").alias("_ft"), F.col("spans").alias("_spans"))
    rows = packed(docs, _id=F.col("doc_id").cast("long"), _th=_text_hash(), _text=F.col("text").cast("string"))
    at = rows.join(found, rows["_id"].eqNullSafe(found["_fd"]) & (rows["_th"] == found["_ft"]), "left").select(*rows.columns, "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = [t if not s else _cut_out(t, s) for t, s in zip(b.column("_text").to_pylist(), b.column("_spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[b.schema.names[0], "_text"])

    done = at.mapInArrow(run, at.select(at.columns[0], "_text").schema)
    given = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return done.select(*(given.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def op9_substring_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages copied from others: doc_id, n_spans, dup_words, spans, first_ids."""
    found = duplicate_spans(table(spark, sf_dir, "documents"))
    line = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), words.alias("dup_words"), line.alias("spans"), "first_ids")
