"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the perfect
(23, 12, 7) Golay code.  Decoding a segment gives the index of the nearest codeword and, when that
is three errors away, of the five codewords at four errors.  Two facts follow from the code's
geometry (and are tested on all error patterns): words one bit apart have the nearest codeword of
one among the indices of the other, and words two bits apart share an index.

Four errors over three segments leave either two segments with at most one error each, or one with
none and two with two each.  So keys are, for each pair of segments, (nearest, any) and (any,
nearest) index pairs, and for each segment its exact bits with any index of the next segment: about
45 keys of 24 to 34 bits for each distinct fingerprint, and every link of 4 bits or fewer meets in a
bucket, where it is verified.

A bucket is searched breadth first over what is not yet reached, so a dense group costs and emits
about its size, not its square; bucket tasks send spanning forests on.  A bucket beyond
``bucket_rows`` is dealt again as pairs of blocks, which loses no link either.

Edge cases: null and empty texts have no word and fingerprint zero, linked like any other; texts of
one to three words are one shingle; equal fingerprints are one node whatever the number of rows;
null ids are never the smallest unless a component has no other; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import beside_least, components
from .frames import cut, one_each, packed, small, table, text_rows, unpacked

SHINGLE_WORDS = 4
SEED = 42
MOST_BITS = 4
BUCKET_ROWS = 1 << 15
#: Low bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b110001110101
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None) -> int:
    words = WORD_BYTES.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[min(len(words), SHINGLE_WORDS) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), ">u8", n)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 15):
        part = hashes[k : k + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_signed(fp))], names=["doc_id", "fp"])


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits; by syndrome the error pattern, and the index
    differences to all near codewords: zero first, then five, or zeros again."""

    def remainder(w: int) -> int:
        for bit in range(22, 10, -1):
            if w >> bit & 1:
                w ^= GENERATOR << (bit - 11)
        return w

    single = [remainder(1 << k) for k in range(23)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for out, first in ((low, 0), (high, 12)):
        for w in range(1, len(out)):
            bit = w.bit_length() - 1
            out[w] = out[w ^ (1 << bit)] ^ single[first + bit]
    error = np.zeros(1 << 11, np.int64)
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                e = 1 << i | 1 << j | 1 << k
                s = single[i] ^ (single[j] if j > i else 0) ^ (single[k] if k > j else 0)
                if j == i and k > j:
                    continue
                error[s] = e
    codewords = [m << 11 | remainder(m << 11) for m in range(1 << 12)]
    sevens = [c for c in codewords if c.bit_count() == 7]
    near = np.zeros((1 << 11, 6), np.int64)
    for s, e in enumerate(error.tolist()):
        if e.bit_count() == 3:
            near[s, 1:] = [c >> 11 for c in sevens if c & e == e]
    return low, high, error, near


def indices(words: np.ndarray, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(nearest index, all indices as n x 6 with the nearest repeated where there is no other)."""
    low, high, error, near = tables
    s = low[words & 0xFFF] ^ high[words >> 12]
    nearest = (words ^ error[s]) >> 11
    return nearest, nearest[:, None] ^ near[s]


def keys(fps: np.ndarray, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows, distinct, for unsigned fingerprints."""
    segment = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    nearest, every = zip(*(indices(s, tables) for s in segment))
    out = []
    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        top = tag << 56
        out += [top | nearest[i][:, None] << 12 | every[j], top | every[i] << 12 | nearest[j][:, None]]
    for tag, (i, j) in enumerate(((0, 1), (1, 2), (2, 0)), 3):
        out.append(tag << 56 | segment[i][:, None] << 12 | every[j])
    table = np.sort(np.concatenate(out, axis=1), axis=1)
    first = np.ones(table.shape, bool)
    first[:, 1:] = table[:, 1:] != table[:, :-1]
    return table[first], np.repeat(fps, first.sum(axis=1))


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = golay_tables()
    for b in batches:
        fps = b.column(0).to_numpy().view(np.uint64)
        for k in range(0, len(fps), 4096):
            key, fp = keys(fps[k : k + 4096], tables)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64))], names=["key", "fp"])


class Forest:
    """Union-find that keeps only the links which join something."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one word, or of several in the last axis."""
    bits = np.bitwise_count(a ^ b)
    return bits if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int64)


def reach(fps: np.ndarray, forest: Forest, names: np.ndarray | None = None, most: int = MOST_BITS) -> None:
    """Links a bucket's distinct fingerprints, breadth first over what is not yet reached."""
    rest, names = fps, fps if names is None else names
    while len(rest) > 1:
        front, rest, names = [(rest[0], names[0])], rest[1:], names[1:]
        while front and len(rest):
            f, name = front.pop()
            hit = apart(rest, f) <= most
            if hit.any():
                for x in names[hit].tolist():
                    forest.link(int(name), x)
                front.extend(zip(rest[hit], names[hit]))
                rest, names = rest[~hit], names[~hit]


def bucket_links(limit: int, key_columns: int, words: int = 0, most: int = MOST_BITS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by key: key columns, then a fingerprint that names itself, or a name and a
    fingerprint of some words.  Out: links of names (null key), and names of keys beyond ``limit``."""

    def batch(key, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["key", "a", "b"])

    def links(forest: Forest) -> pa.RecordBatch:
        ends = _signed(np.array(forest.links, dtype=np.uint64).reshape(-1, 2))
        forest.up, forest.links = {}, []
        return batch([None] * len(ends), ends[:, 0], ends[:, 1])

    def runs(key: list[np.ndarray], name: np.ndarray, fp: np.ndarray, forest: Forest) -> None:
        change = np.zeros(len(fp), bool)
        change[0] = True
        for k in key:
            change[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, len(fp)))
        for d in range(1, 8):  # runs of up to 8 rows: all their pairs, at once over the batch
            some = (sizes > d) & (sizes <= 8)
            if not some.any():
                break
            n = sizes[some] - d
            i = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            near = apart(fp[i], fp[i + d]) <= most
            for a, b in zip(name[i[near]].tolist(), name[i[near] + d].tolist()):
                if a != b:
                    forest.link(a, b)
        for s, n in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
            own, first = np.unique(name[s : s + n], return_index=True)
            reach(fp[s : s + n][first], forest, own, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        key, name = [np.empty(0, np.int64)] * key_columns, np.empty(0, np.uint64)
        fp = np.empty((0, words), np.uint64) if words else name
        flowing = None  # the key whose rows go on as they come
        for b in batches:
            columns = [b.column(k).to_numpy() for k in range(key_columns + 1 + words)]
            if not len(columns[0]):
                continue
            key = [np.concatenate([x, y]) for x, y in zip(key, columns)]
            name = np.concatenate([name, columns[key_columns].view(np.uint64)])
            fp = np.concatenate([fp, np.stack([c.view(np.uint64) for c in columns[key_columns + 1 :]], axis=1)]) if words else name
            if flowing is not None:
                n = int(np.searchsorted(key[0], flowing, side="right"))
                if n:
                    yield batch(key[0][:n], name[:n].view(np.int64), name[:n].view(np.int64))
                    key, name, fp = [k[n:] for k in key], name[n:], fp[n:]
                if not len(fp):
                    continue
                flowing = None
            same = np.ones(len(fp), bool)
            for k in key:
                same &= k == k[-1]
            last = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
            if last:
                runs([k[:last] for k in key], name[:last], fp[:last], forest)
                key, name, fp = [k[last:] for k in key], name[last:], fp[last:]
            if len(fp) > limit:
                flowing = key[0][0]
                yield batch(key[0], name.view(np.int64), name.view(np.int64))
                key, name, fp = [k[:0] for k in key], name[:0], fp[:0]
            if len(forest.links) >= 50_000:
                yield links(forest)
        if len(fp):
            runs(key, name, fp, forest)
        if forest.links:
            yield links(forest)

    return run


def links(fps: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links that connect just what all links of 4 bits or fewer between distinct ``fp`` connect."""
    rows = fps.select("fp").mapInArrow(_key_rows, "key long, fp long").repartition("key").sortWithinPartitions("key")
    found = cut(rows.mapInArrow(bucket_links(bucket_rows, 1), "key long, a long, b long"))
    over = found.filter("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    if over.isEmpty():
        return found.filter("key IS NULL").select("a", "b")
    blocks = over.groupBy("key").agg(F.ceil(F.count("*") / F.lit(bucket_rows // 2)).cast("int").alias("n"))
    own = over.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    dealt = own.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")).select(
        "key", F.least("own", "other").cast("long").alias("i"), F.greatest("own", "other").cast("long").alias("j"), "fp")
    more = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(bucket_links(1 << 62, 3), "key long, a long, b long")
    return found.filter("key IS NULL").select("a", "b").union(cut(more).select("a", "b"))


def near_groups(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``."""
    rows = text_rows(docs)
    thin = cut(rows.mapInArrow(_fingerprints, "doc_id long, fp long"))
    return _named(thin, bucket_rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(thin: DataFrame, bucket_rows: int) -> DataFrame:
    nodes = cut(thin.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes, bucket_rows)).select(F.col("node").alias("fp"), "root")
    named = beside_least(nodes.join(roots, "fp"), "root", "first", "least").select("fp", "least", "root")
    of = nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return thin.join(cut(of), "fp")  # straight from its own exchange, so Spark may split a hot fingerprint's rows


def dedup(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The documents with one of each group: the one with the smallest id, then fingerprint."""
    rows = text_rows(docs)
    thin = cut(rows.mapInArrow(_fingerprints, "doc_id long, fp long"))
    named = cut(_named(thin, bucket_rows).groupBy("root", "doc_id", "fp").agg(F.count("*").alias("n")))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("best"))
    stay = best.select(F.col("best.doc_id").alias("_id"), F.col("best.fp").alias("_fp"))
    kept = named.join(stay, named["doc_id"].eqNullSafe(stay["_id"]) & (named["fp"] == stay["_fp"]), "left_semi")
    twice = not kept.filter("n > 1").isEmpty()
    lose = named.join(stay, named["doc_id"].eqNullSafe(stay["_id"]) & (named["fp"] == stay["_fp"]), "left_anti").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"))
    once = lose.groupBy("_id").agg(F.count("*").alias("_n"))
    ids = thin.groupBy("doc_id").agg(F.countDistinct("fp").alias("n")).filter("n > 1 OR doc_id IS NULL")
    if ids.isEmpty() and not twice:  # every id names one text: its id is enough, no second fingerprint
        return unpacked(packed(docs, _id=F.col("doc_id").cast("long")).join(once, "_id", "left_anti"), docs)
    marked = packed(docs, _id=F.col("doc_id").cast("long"), _text=F.col("text").cast("string"))
    with_fp = marked.mapInArrow(_add_fingerprint, marked.drop("_text").schema.add("_fp", "long"))
    left = with_fp.join(lose, with_fp["_id"].eqNullSafe(lose["_id"]) & (with_fp["_fp"] == lose["_fp"]), "left_anti")
    return unpacked(one_each(left, ["_id", "_fp"], twice), docs)


def _add_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        fp = np.array([fingerprint(t) for t in b.column("_text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_signed(fp))], names=[b.schema.names[0], "_id", "_fp"])


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
