"""Near-dedup by similarity: wider SimHash fingerprints, Golay-decoded by their margins.

Documents are near copies when the cosine of their five-word shingles, repeats counted, is 0.8 or
more, as a SimHash of 128 bits estimates it: at most 26 bits differ.  Two texts whose shingle sets have
a Jaccard similarity of 0.8 have a cosine of 0.89 and differ in 19 bits on average.

So many errors are beyond the code's own distance, but they aren't anywhere: a bit flips where its sum
over the shingles is near zero.  So a segment is decoded by these sums: of all 4,096 codewords of the
(23, 12, 7) code, on 21 of its places, the two that agree with them best give the segment's indices.
Six segments give, for each pair, four keys of 24 bits, 60 in all; copies share an index in two
segments of six with a probability of 0.92 at a Jaccard similarity of 0.8, 0.98 at 0.85 and over 0.99
at 0.9 (by the normal approximation, and measured in the tests).  Rows that meet in a bucket are
verified by their bits.  This is a search with a known recall, not an exact one.

Buckets are searched, and large ones dealt again, as those of ``simhash``; equal fingerprints are one
node whatever the number of rows, with the keys of one of them.

Edge cases: texts without a word have fingerprint zero, linked like any other; texts of one to four
words are one shingle; null ids are never the smallest unless a group has no other; of rows that
repeat an id and a fingerprint one stays; an empty table gives an empty result; extra columns are
carried, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import cut, one_each, packed, small, text_rows, unpacked
from .simhash import BUCKET_ROWS, GENERATOR, SEED, WORD_BYTES, bucket_links

SHINGLE_WORDS = 5
SIMILARITY = 0.8
WORDS = 2
SEGMENTS, WIDTH, BEST = 6, 21, 2
WIDE = "doc_id long, hi long, lo long, keys array<long>"


def most_bits(similarity: float) -> int:
    """Differing bits of texts of that cosine, by which SimHash estimates it."""
    return math.floor(64 * WORDS * math.acos(similarity) / math.pi)


@cache
def codewords() -> np.ndarray:
    """The code's words on the first places of a segment, as signs: a column for each index."""

    def remainder(w: int) -> int:
        for bit in range(22, 10, -1):
            if w >> bit & 1:
                w ^= GENERATOR << (bit - 11)
        return w

    words = np.array([m << 11 | remainder(m << 11) for m in range(1 << 12)])
    return np.where(words >> np.arange(22, 22 - WIDTH, -1)[:, None] & 1, 1.0, -1.0).astype(np.float32)


def margins(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """For each of the 128 bits: shingles that set it less those that don't; zero without a word."""
    words = WORD_BYTES.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.zeros(64 * WORDS, np.int64)
    line = b" ".join(words)
    n = max(1, len(words) - shingle_words + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[min(len(words), shingle_words) - 1 :].tolist()
    digest, step = xxhash.xxh3_128_digest, 1 << 15
    ones = np.zeros(64 * WORDS, np.int64)
    for k in range(0, n, step):
        part = np.frombuffer(b"".join([digest(line[a:b], SEED) for a, b in zip(starts[k : min(n, k + step)], stops[k : k + step])]), np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8 * WORDS), axis=1).sum(axis=0, dtype=np.int32)
    return 2 * ones - n


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Bits of rows of margins, as two unsigned words each."""
    return np.packbits(sums > 0, axis=1).view(">u8").astype(np.uint64)


def keys(sums: np.ndarray) -> np.ndarray:
    """The keys of rows of margins."""
    own = []
    for k in range(SEGMENTS):
        fit = sums[:, k * WIDTH : (k + 1) * WIDTH].astype(np.float32) @ codewords()
        own.append(np.argpartition(-fit, BEST, axis=1)[:, :BEST].astype(np.int64))
    pairs = [(tag << 24 | own[i][:, :, None] << 12 | own[j][:, None, :]).reshape(len(sums), -1) for tag, (i, j) in enumerate(combinations(range(SEGMENTS), 2))]
    return np.concatenate(pairs, axis=1)


def _wide_rows(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[pa.RecordBatch]:
    for b in small(batches, 256):
        if not b.num_rows:
            continue
        sums = np.stack([margins(t, shingle_words) for t in b.column(1).to_pylist()])
        fp, own = fingerprints(sums), keys(sums)
        offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1])
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(fp[:, k].copy().view(np.int64)) for k in range(WORDS)), pa.ListArray.from_arrays(offsets, pa.array(own.ravel()))], names=["doc_id", "hi", "lo", "keys"])


def links(nodes: DataFrame, most: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): names of ``nodes`` (name, hi, lo, keys) that connect what all verified rows of a bucket connect."""
    fps = nodes.select("name", "hi", "lo")
    rows = nodes.select(F.explode("keys").alias("key"), "name", "hi", "lo").repartition("key").sortWithinPartitions("key")
    found = cut(rows.mapInArrow(bucket_links(bucket_rows, 1, WORDS, most), "key long, a long, b long"))
    over = found.filter("key IS NOT NULL").select("key", F.col("a").alias("name"))
    if over.isEmpty():
        return found.filter("key IS NULL").select("a", "b")
    blocks = over.groupBy("key").agg(F.ceil(F.count("*") / F.lit(bucket_rows // 2)).cast("int").alias("n"))
    own = over.join(blocks, "key").join(fps, "name").withColumn("own", F.pmod(F.xxhash64("name"), F.col("n")).cast("int"))
    dealt = own.select("key", "name", "hi", "lo", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")).select(
        "key", F.least("own", "other").cast("long").alias("i"), F.greatest("own", "other").cast("long").alias("j"), "name", "hi", "lo")
    more = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(bucket_links(1 << 62, 3, WORDS, most), "key long, a long, b long")
    return found.filter("key IS NULL").select("a", "b").union(cut(more).select("a", "b"))


def grouped(docs: DataFrame, similarity: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, hi, lo, root) for every row of ``docs``: rows of one root are near copies."""
    wide = cut(text_rows(docs).mapInArrow(lambda batches: _wide_rows(batches, shingle_words), WIDE))
    nodes = cut(wide.groupBy("hi", "lo").agg(F.min("keys").alias("keys")).withColumn("name", F.monotonically_increasing_id()))
    roots = components(links(nodes, most_bits(similarity), bucket_rows))
    of = nodes.select("hi", "lo", "name").join(roots, F.col("name") == F.col("node"), "left").select("hi", "lo", F.coalesce("root", "name").alias("root"))
    return wide.select("doc_id", "hi", "lo").join(cut(of), ["hi", "lo"])


def dedup(docs: DataFrame, similarity: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The documents with one of each group of near copies: the one with the smallest id, then fingerprint."""
    named = cut(grouped(docs, similarity, shingle_words, bucket_rows).groupBy("root", "doc_id", "hi", "lo").agg(F.count("*").alias("n")))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hi", "lo")).alias("best"))
    stay = best.select("root", F.col("best.doc_id").alias("_id"), F.col("best.hi").alias("_hi"), F.col("best.lo").alias("_lo"))
    marked = cut(named.join(cut(stay), "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo"))).select("doc_id", "hi", "lo", "n", "stays"))
    twice = not marked.filter("stays AND n > 1").isEmpty()
    ids = marked.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
    if ids.isEmpty() and not twice:  # every id names one text: its id is enough, no second fingerprint
        lose = marked.filter("NOT stays").select(F.col("doc_id").alias("_id"))
        return unpacked(packed(docs, _id=F.col("doc_id").cast("long")).join(lose, "_id", "left_anti"), docs)
    rows = packed(docs, _id=F.col("doc_id").cast("long"), _text=F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 256):
            fp = fingerprints(np.stack([margins(t, shingle_words) for t in b.column("_text").to_pylist()])) if b.num_rows else np.empty((0, WORDS), np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(fp[:, k].copy().view(np.int64)) for k in range(WORDS))], names=[b.schema.names[0], "_id", "_hi", "_lo"])

    lose = marked.filter("NOT stays").select(F.col("doc_id").alias("_ld"), F.col("hi").alias("_lh"), F.col("lo").alias("_ll"))
    with_fp = rows.mapInArrow(run, rows.drop("_text").schema.add("_hi", "long").add("_lo", "long"))
    left = with_fp.join(lose, F.col("_id").eqNullSafe(F.col("_ld")) & (F.col("_hi") == F.col("_lh")) & (F.col("_lo") == F.col("_ll")), "left_anti")
    return unpacked(one_each(left, ["_id", "_hi", "_lo"], twice), docs)
