"""Near-duplicate components of SimHash fingerprints, every pair within the radius found.

Covering hashing: each of the 64 bits gets a random vector of r + 1 bits, and each of the 2^(r+1) - 1 vectors v
that aren't zero a table, whose mask keeps the bits whose vector has an odd product with v. However r bits are
chosen, some v has an even product with all of their vectors, so of two fingerprints that differ in at most r bits
some table keeps none of these: they meet in one of its buckets, for certain.

1. Documents of one fingerprint form a class; its smallest key stands for it, so copies are never paired.
2. All tables' buckets are sorted by (bucket, fingerprint), across partitions. Each fingerprint is compared with the
   ``NEAR`` next to it in its bucket, vectorised, which is all of a small bucket. What is left open are larger
   buckets and those in which two partitions meet.
3. Components follow by label propagation. An open bucket matters only if its fingerprints are of several
   components: then those outside its largest component are compared with all, blocks against blocks. Where
   that would be more than ``MOST_PAIRS`` comparisons, the bucket's fingerprints go through a second family of
   tables, independent of the first, with buckets within the bucket, and so on: each time about half of the
   bits that were free are kept, so buckets shrink until no more fingerprints fit than the free bits have values.

A bucket is named by a hash of its table and bits. Two buckets of one name are compared as one, which costs time
and changes nothing: links are those whose fingerprints differ in at most r bits.

Defined results: a text without words, or null, has fingerprint zero and is linked like any other. A text of fewer
words than a shingle is one shingle. Rows of one key are linked by their own fingerprints alone. A null key has a
fingerprint, links nothing and has a null component. Keys must be of an integral type, else a TypeError says so. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm.common import BROADCAST_BYTES, cut, integral, ship, tidy
from veridex.llm.near_dup import components
from veridex.scratch import settled

BITS, SEED = 64, 42
#: Neighbours in a bucket that a fingerprint is compared with at once.
NEAR = 48
#: Comparisons within a bucket that one task makes, and fingerprints in a block of them.
MOST_PAIRS, BLOCK_ROWS = 1 << 28, 1024
#: Shingles whose bits are counted at once.
SLICE = 1 << 15


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The SimHash of a text's shingles, repeats included, as a signed number."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - shingle + 1, 1)
    begins, ends = begins[:n], ends[-n:]
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, SLICE):
        digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(begins[i : i + SLICE].tolist(), ends[i : i + SLICE].tolist(), strict=True)])
        ones += np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def masks(radius: int, family: int) -> list[int]:
    """The bits that each table of a family keeps, as signed numbers."""
    r = np.random.Generator(np.random.PCG64([SEED, family]))
    # every vector about as often as any other, none of them zero, since no table keeps such a bit
    vectors = 1 + r.permutation(BITS) % ((1 << (radius + 1)) - 1)
    out = []
    for v in range(1, 1 << (radius + 1)):
        keep = sum(1 << b for b in range(BITS) if int(vectors[b] & v).bit_count() % 2)
        out.append(keep - (1 << BITS) if keep >> (BITS - 1) else keep)
    return out


def _fingerprints(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(id, fp) of each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(make), "id long, fp long")


def _buckets(rows: DataFrame, radius: int, family: int) -> DataFrame:
    """(bucket, fp): each fingerprint in each table of a family. rows: (bucket, fp), whose buckets they stay in."""
    tables = F.array(*[F.lit(m).cast("long") for m in masks(radius, family)])
    at = rows.select("bucket", "fp", F.posexplode(tables).alias("table", "mask"))
    return at.select(F.xxhash64("bucket", "table", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "fp")


class Joined:
    """Which places of a sorted stretch are tied together already, so that no more links are named than it takes."""

    def __init__(self):
        self.root = np.zeros(0, np.int64)

    def grow(self, n: int) -> None:
        self.root = np.concatenate([self.root, np.arange(len(self.root), len(self.root) + n)])

    def tie(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ties places a and b, and returns which of these pairs that took."""
        pairs, at = np.unique(np.stack([self.root[a], self.root[b]], axis=1), axis=0, return_index=True)
        over: dict[int, int] = {}

        def top(x: int) -> int:
            while x in over:
                over[x] = x = over.get(over[x], over[x])
            return x

        took = []
        for (x, y), i in zip(pairs.tolist(), at.tolist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                over[max(x, y)] = min(x, y)
                took.append(i)
        if took:
            to = np.arange(len(self.root))
            to[list(over)] = [top(x) for x in over]
            self.root = to[self.root]
        return np.array(took, dtype=np.int64)

    def last(self, n: int) -> None:
        """Keeps the last n places."""
        self.root = np.unique(self.root[-n:], return_inverse=True)[1].astype(np.int64)
        first = np.unique(self.root, return_index=True)[1]
        self.root = first[self.root]


def _scanned(rows: DataFrame, radius: int) -> DataFrame:
    """(kind, a, b): links (kind 0) of fingerprints next to each other, of one bucket as many as tie together what
    they tie; and open buckets (kind 1, named by a)."""
    rows = rows.repartitionByRange("bucket", "fp").sortWithinPartitions("bucket", "fp")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

        bucket, fp, joined = np.zeros(0, np.int64), np.zeros(0, np.uint64), Joined()
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(bucket)
            bucket = np.concatenate([bucket, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            joined.grow(batch.num_rows)
            if not old:
                yield out(1, bucket[:1], bucket[:1])
            for d in range(1, min(NEAR + 1, len(fp))):
                begin = max(old - d, 0)
                mates = np.flatnonzero(bucket[begin : len(fp) - d] == bucket[begin + d :]) + begin
                if not len(mates):
                    break
                apart = np.bitwise_count(fp[mates] ^ fp[mates + d])
                linked = mates[(apart <= radius) & (apart > 0)]
                linked = linked[joined.root[linked] != joined.root[linked + d]]
                if len(linked):
                    linked = linked[joined.tie(linked, linked + d)]
                    yield out(0, fp[linked].view(np.int64), fp[linked + d].view(np.int64))
                if d == NEAR:
                    # these have more mates than were compared
                    large = np.unique(bucket[mates])
                    yield out(1, large, large)
            bucket, fp = bucket[-NEAR:], fp[-NEAR:]
            joined.last(NEAR)
        if len(bucket):
            yield out(1, bucket[-1:], bucket[-1:])

    return cut(rows.mapInArrow(tidy(scan), "kind int, a long, b long"), "scanned")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds ``comp``, the component of each fingerprint."""
    if labels is None:
        return rows.withColumn("comp", F.col("fp"))
    at = labels.select(F.col("id").alias("v"), F.col("label").alias("l"))
    return rows.join(at, F.col("fp") == F.col("v"), "left").withColumn("comp", F.coalesce("l", "fp")).drop("v", "l")


def _mixed(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(bucket, fp, comp, major, rows, outside) of the buckets whose fingerprints are of several components."""
    rows = cut(_labelled(rows, labels), "open")
    sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "comp")).alias("most"), F.sum("k").alias("rows"))
    sizes = cut(sizes.select(F.col("bucket").alias("m"), F.col("most.comp").alias("major"), "rows", (F.col("rows") - F.col("most.k")).alias("outside")).where("outside > 0"), "sizes")
    few = sizes.count() * 48 <= BROADCAST_BYTES
    return rows.join(F.broadcast(sizes) if few else sizes, F.col("bucket") == F.col("m")).drop("m")


def _across(mixed: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between fingerprints outside a bucket's largest component and those of other components."""

    def packed(df: DataFrame, n: str, p: str) -> DataFrame:
        block = F.expr(f"pmod(xxhash64(fp), 1 + {n} div {BLOCK_ROWS})")
        return df.groupBy(F.col("bucket").alias(f"{p}b"), block.alias(f"{p}n")).agg(F.collect_list(F.struct("fp", "comp")).alias(p)).drop(f"{p}n")

    both = packed(mixed.where("comp <> major"), "outside", "x").join(packed(mixed, "rows", "y"), F.col("xb") == F.col("yb")).select("x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                (a, ca), (b, cb) = ([c.to_numpy() for c in s.values.flatten()] for s in (x, y))
                apart = np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :])
                i, j = np.nonzero((apart <= radius) & (ca[:, None] != cb[None, :]))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j]))], names=["a", "b"])

    return both.mapInArrow(tidy(compare), "a long, b long")


def linked_fingerprints(classes: DataFrame, radius: int) -> DataFrame | None:
    """(id, label): the smallest fingerprint that each linked one of ``classes`` (fp, all different) reaches; None
    where nothing is linked."""
    inside, family = classes.select(F.lit(0).cast("long").alias("bucket"), "fp"), 1
    links, labels = None, None
    while True:
        rows = _buckets(inside, radius, family)
        scanned = _scanned(rows, radius)
        found = scanned.where("kind = 0").select("a", "b").distinct()
        links = cut(found if links is None else links.union(found), "links")
        labels = None if links.isEmpty() else components(links)
        still_open = cut(scanned.where("kind = 1").select(F.col("a").alias("o")).distinct(), "open")
        few = still_open.count() * 16 <= BROADCAST_BYTES
        mixed = cut(_mixed(rows.join(F.broadcast(still_open) if few else still_open, F.col("bucket") == F.col("o"), "left_semi"), labels), "mixed")
        if mixed.isEmpty():
            return labels
        light = F.col("outside") * F.col("rows") <= MOST_PAIRS
        more = cut(_across(mixed.where(light), radius).distinct(), "links")
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links)
        inside = cut(mixed.where(~light).select("bucket", "fp"), "inside")
        if inside.isEmpty():
            return labels
        family += 1


def simhash_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: key, fingerprint (16 hexadecimal digits) and component_id, the smallest key that links
    of at most ``radius`` differing bits reach."""
    ship(docs.sparkSession)
    integral(docs, key)
    return settled(docs.sparkSession, "simhash", lambda: _simhash_duplicates(docs, key, text, shingle, radius))


def _simhash_duplicates(docs: DataFrame, key: str, text: str, shingle: int, radius: int) -> DataFrame:
    rows = cut(_fingerprints(docs, key, text, shingle), "fingerprints")
    classes = cut(rows.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    labels = linked_fingerprints(classes.select("fp"), radius)
    # those alone with their fingerprint, and linked with none, need no join
    named = classes.where("n > 1").select("fp", F.col("rep").alias("component_id"))
    if labels is not None:
        of = cut(classes.join(labels, F.col("fp") == F.col("id")).select("fp", "rep", "label"), "linked")
        smallest = cut(of.groupBy("label").agg(F.min("rep").alias("component_id")).withColumnRenamed("label", "c"), "smallest")
        few = smallest.count() * 32 <= BROADCAST_BYTES
        linked = of.join(F.broadcast(smallest) if few else smallest, F.col("label") == F.col("c")).select("fp", "component_id")
        named = named.join(of.select(F.col("fp").alias("o")), F.col("fp") == F.col("o"), "left_anti").union(linked)
    named = cut(named.withColumnRenamed("fp", "f"), "named")
    side = F.broadcast(named) if named.count() * 32 <= BROADCAST_BYTES else named
    out = rows.join(side, F.col("fp") == F.col("f"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
