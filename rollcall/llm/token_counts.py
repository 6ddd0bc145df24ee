"""Token counts by separator scan.

Flat token files hold documents' ids one after another, each document ended by a separator id, with
no index.  Files of any size are dealt as byte ranges that know nothing of documents.  The task of a
range reads it block by block; numpy finds all separators of a block at once, and counts run on from
block to block.  What a range can't know, the tokens that its first document has before it and the
documents that ended before it, comes from a prefix scan over one thin row for each range of a file,
however many ranges a document spans.  Tokens themselves are never shuffled.

Tasks open ranges with Arrow's file systems.  A store that only Spark can open is read by Spark's own
binary reader, whose files hold 2 GB at most.

The separator ends documents, so text that spells it is encoded as ordinary text here, while op7
takes it for one special id: the two counts differ for such documents, by design.

Edge cases: an empty document has count 0; tokens after a file's last separator are a document that
is not ended; a file of no tokens has no document; bytes that don't fill an id at a file's end, and
ids that don't fit the file's type, are errors; rows that repeat an id, or have none, are counted
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import WordBpe, tokenizer
from .frames import checkpoint_folder, cut, remove, small, table, text_rows

#: 49,408 ids fit two bytes; the separator is the vocabulary's own end of text.
DTYPE = "<u2"
SEPARATOR = "<|endoftext|>"
BLOCK_TOKENS = 1 << 16
#: Tokens that one task reads at a time.
RANGE_TOKENS = 1 << 23
MOST_TASKS = 20_000
BLOCK = "file string, at long, docs long, opens boolean, counts array<long>, n long, tail long"


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system of an address as Spark writes it, and the path there."""
    scheme, _, rest = uri.partition(":")
    if not rest or scheme == "file":
        return pa.fs.LocalFileSystem(), "/" + (rest or uri).lstrip("/")
    return pa.fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def _reachable(uri: str) -> bool:
    try:
        opened(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return False
    return True


def ranges(files: DataFrame, dtype: str = DTYPE, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """(file, at, length, data) of (file, length[, content]): byte ranges, each for one task at a time.

    They are dealt by number, as their rows don't tell how much there is to read."""
    size = range_tokens * np.dtype(dtype).itemsize
    starts = F.expr(f"sequence(0L, greatest(length - 1, 0L), {size}L)")
    data = F.expr(f"substring(content, cast(at AS int) + 1, {size})") if "content" in files.columns else F.lit(None).cast("binary")
    n = files.agg(F.sum(F.greatest(F.ceil(F.col("length") / size), F.lit(1)))).first()[0] or 1
    own = files.withColumn("at", F.explode(starts)).select("file", "at", F.least(F.lit(size), F.col("length") - F.col("at")).alias("length"), data.alias("data"))
    return own.repartition(int(min(n, MOST_TASKS)), "file", "at")


def read_flat(spark: SparkSession, path: str, dtype: str = DTYPE, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """Ranges of all flat token files of a folder."""
    files = spark.read.format("binaryFile").load(path)
    some = files.select("path").first()
    content = [] if some is None or _reachable(some[0]) else ["content"]
    return ranges(files.select(F.col("path").alias("file"), "length", *content), dtype, range_tokens)


def blocks_of(row: dict, size: int) -> Iterator[bytes]:
    if row["data"] is not None:
        yield from (row["data"][k : k + size] for k in range(0, row["length"], size))
        return
    fs, path = opened(row["file"])
    with fs.open_input_file(path) as f:
        f.seek(row["at"])
        for k in range(0, row["length"], size):
            yield f.read(min(size, row["length"] - k))


def scanned(flat: DataFrame, separator: int, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each block: documents ended before it in its range, whether the first of ``counts`` may
    have begun before the range, and the counts of the documents that end in it.  A range's last block
    has its tokens ``n`` and those after its last separator, ``tail`` (null without a separator)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n, docs, begin = 0, 0, 0
                out: list[tuple] = []
                for data in blocks_of(row, block_tokens * np.dtype(dtype).itemsize):
                    tokens = np.frombuffer(data, dtype)
                    ends = np.flatnonzero(tokens == separator) + n
                    counts = np.diff(ends, prepend=begin - 1) - 1
                    out.append((docs, docs == 0, counts, None, None))
                    n += len(tokens)
                    docs += len(ends)
                    begin = int(ends[-1]) + 1 if len(ends) else begin
                    if len(out) > 1:
                        yield batch(row, [out.pop(0)])
                last = out.pop() if out else (0, True, [], None, None)
                yield batch(row, [(*last[:3], n, n - begin if docs else None)])

    def batch(row: dict, out: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.int64())
        columns = zip(*((row["file"], row["at"], *x) for x in out))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "at", "docs", "opens", "counts", "n", "tail"])

    return flat.select(F.col("file").cast("string"), F.col("at").cast("long"), F.col("length").cast("long"), F.col("data").cast("binary")).mapInArrow(run, BLOCK)


def count_tokens(flat: DataFrame, separator: int, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens, ended) for every document of the ranges' files."""
    found = cut(scanned(flat, separator, dtype, block_tokens))
    order = Window.partitionBy("file").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = found.filter("n IS NOT NULL").withColumn("_docs", F.col("docs") + F.size("counts")).withColumns({
        "_base": F.coalesce(F.sum("n").over(before), F.lit(0)), "_first": F.coalesce(F.sum("_docs").over(before), F.lit(0)), "_more": F.lead("at").over(order)})
    sums = sums.withColumn("_stop", F.col("_base") + F.col("n") - F.col("tail"))  # where the document after the last separator begins
    sums = sums.withColumn("_carry", F.col("_base") - F.coalesce(F.max("_stop").over(before), F.lit(0)))
    at = found.join(sums.select("file", "at", "_first", "_carry"), ["file", "at"])
    counts = F.when(F.col("opens"), F.expr("transform(counts, (c, k) -> c + IF(k = 0, _carry, 0L))")).otherwise(F.col("counts"))
    ended = at.select("file", (F.col("_first") + F.col("docs")).alias("_first"), F.posexplode(counts).alias("k", "n_tokens")).select("file", (F.col("_first") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    rest = F.coalesce("tail", F.col("_carry") + F.col("n"))
    open_ = sums.filter(F.col("_more").isNull() & (rest > 0)).select("file", (F.col("_first") + F.col("_docs")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.union(open_)


def fits(bpe: WordBpe, dtype: str) -> None:
    if bpe.width - 1 > np.iinfo(dtype).max:
        raise ValueError(f"ids up to {bpe.width - 1} do not fit {dtype}; use <u4")


def write_flat(docs: DataFrame, folder: str, path: str | None = None, dtype: str = DTYPE) -> DataFrame:
    """Writes the documents' tokens as flat files, one for each task attempt, and returns what lies
    beside them: (file, first, doc_ids, length), ids in file order from the ordinal ``first`` on, the
    length in a file's last row only.  Files of attempts that failed are in no row."""
    fits(tokenizer(path), dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, own = tokenizer(path), TaskContext.get()
        end = np.array([bpe.special[SEPARATOR]], dtype).tobytes()
        file = f"{folder}/{own.partitionId():06d}-{own.taskAttemptId()}.bin"
        fs, place = opened(file)
        stream, first, size = None, 0, 0
        for b in small(batches):
            if not b.num_rows:
                continue
            if stream is None:
                fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                stream = fs.open_output_stream(place)
            for ids in bpe.encoded(b.column(1).to_pylist(), special=False):
                size += stream.write(np.frombuffer(ids, "<u4").astype(dtype).tobytes() + end) or len(ids) // 4 * len(end) + len(end)
            yield beside(file, first, b.column(0), None)
            first += b.num_rows
        bpe.words = {}
        if stream is not None:
            stream.close()
            yield beside(file, first, pa.array([], pa.int64()), size)

    def beside(file: str, first: int, ids: pa.Array, length: int | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([first]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([length], pa.int64())], names=["file", "first", "doc_ids", "length"])

    return text_rows(docs).mapInArrow(run, "file string, first long, doc_ids array<long>, length long")


def document_counts(docs: DataFrame, path: str | None = None, block_tokens: int = BLOCK_TOKENS, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """doc_id and n_tokens of every row of ``docs``, counted in their flat files in the shared folder,
    which are removed again.  Ids lie beside the files, by ordinal, never in them."""
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/flat-{uuid.uuid4().hex}"
    beside = cut(write_flat(docs, folder, path))
    flat = ranges(beside.filter("length IS NOT NULL").select("file", "length"), range_tokens=range_tokens)
    found = cut(count_tokens(flat, tokenizer(path).special[SEPARATOR], block_tokens=block_tokens))
    remove(spark, folder)
    ids = beside.select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return ids.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_counts(table(spark, sf_dir, "documents"))
