"""Near-duplicate components by an LSH forest over MinHash signatures, every link confirmed exactly.

1. A document's set is its distinct word shingles, as 64-bit hashes. Documents of one set (a 128-bit
   digest) form a class; its smallest key stands for it, so copies are never paired with each other.
2. A signature has ``trees`` parts of ``depth`` MinHash values. The forest is these parts, sorted: for the
   first ``sorted_trees`` of them the classes are range-partitioned and sorted by their part, and those
   next to each other are candidates if they share ``least`` values or more, so each class meets the
   neighbours of the longest common prefix, at whatever depth its region has.
3. Candidates are confirmed on their full sets; components follow by label propagation.
4. All trees are then cut at depth ``least``. Only regions in which components still differ matter. In
   each, the classes outside its largest component meet all of other components, blocks of rows against blocks,
   dealt out by runs of ``RUN_BLOCKS`` blocks. Where these were more than ``MOST_PAIRS`` comparisons, as among the
   pages of a template, the region's classes are joined by their rarest shingles instead, of which two sets that
   are similar enough share one for certain, so what all pages have in common brings up no pair.
   In the other regions each class has the counts of its shingles by 256 buckets; the sum of the counts' differences is a lower
   bound of how many shingles are in one set alone, so a pair above what the similarity allows cannot
   be a link, and is not brought up. The others are confirmed, and the components merged.

A pair of similarity s shares the first ``least`` values in one of the trees with probability
1 - (1 - s^least)^trees: with 20 trees and 4 values all but 4 in ten million at 0.85, 3 in a hundred
thousand at 0.80. Pairs of one component need no link of their own, so groups of any size take as many
candidates as they have members, not squares of them, and no group is gathered into one task.

Defined results: a document without words, or null, has an empty set and is linked with nothing. One of
fewer words than a shingle has all of them as its one shingle. Rows of equal keys are one vertex with
several sets. A null key is linked with nothing, has a null component and is kept. Keys must be of an
integral type, else a TypeError says so. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridex.llm.common import BROADCAST_BYTES, cut, integral, ship, slices, text_batches, tidy
from veridex.scratch import new_path, remove, settled

#: Rows and bytes of text that are split into words at once.
SLICE_ROWS, SLICE_BYTES = 1024, 2 << 20
#: Buckets of the counts that bound differences, rows of a region that are compared at once, and blocks of
#: the classes outside a region's largest component that meet the region in one task.
BUCKETS, BLOCK_ROWS, RUN_BLOCKS = 256, 256, 16
#: Comparisons in a region beyond which its classes are joined by their rarest shingles instead.
MOST_PAIRS = 1 << 26
#: Buckets of hashes by which rare shingles are told from others.
RARITY = 1 << 18
#: Bytes of rows that a task writes where their number is known, and tasks at least, whatever the partitions of shuffles.
TASK_BYTES, LEAST_TASKS = 8 << 20, 12
#: Comparisons that a task makes of blocks.
TASK_PAIRS = 1 << 22
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def dense(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """``df``, which has that many rows at most, in no more tasks than these ask for: a shuffle's partitions cost
    a task and a file each, however empty they are."""
    return df.coalesce(max(LEAST_TASKS, rows * row_bytes // TASK_BYTES))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[3]
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    offsets = np.asarray(split.offsets).astype(np.int64)
    words = split.flatten()
    found = words.dictionary_encode()
    spelled = found.dictionary.to_numpy(zero_copy_only=False)
    filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(filled)])
    offsets = before[offsets - offsets[0]]
    h = pd.util.hash_array(spelled, categorize=False)[found.indices.to_numpy()][filled] if len(spelled) else np.zeros(0, dtype=np.uint64)
    runs = _mix(h * _ODD[0])
    for j in range(1, shingle):
        runs = _mix(runs[: max(len(h) - j, 0)] * _ODD[4] + h[j:] * _ODD[j % 3]) if len(h) > j else runs[:0]
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(runs[a : b - shingle + 1]))
        elif b > a:
            short = _mix(h[a : a + 1] * _ODD[1] + np.uint64(b - a))
            for j in range(a + 1, b):
                short = _mix(short * _ODD[4] + h[j : j + 1] * _ODD[2])
            out.append(short)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class MinHash:
    def __init__(self, n: int, seed: int = 1):
        r = np.random.Generator(np.random.PCG64(seed))
        self.x = r.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]
        self.a = (r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1))[:, None]

    def __call__(self, s: np.ndarray) -> np.ndarray:
        low = ((s >> np.uint64(32)) ^ s).astype(np.uint32)
        best = np.full(len(self.x), 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(low), 2048):
            h = (low[None, i : i + 2048] ^ self.x) * self.a
            best = np.minimum(best, (h ^ (h >> np.uint32(15))).min(axis=1))
        return best


def _signatures(docs: DataFrame, key: str, text: str, shingle: int, n: int) -> DataFrame:
    """id, n, fp (digest of the set), sig (big-endian, so that bytes sort as values do)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(n)
        for batch in batches:
            for rows in slices(batch, [1], SLICE_ROWS, SLICE_BYTES):
                sets = shingle_sets(rows.column(1), shingle)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([minhash(s).astype(">u4").tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["id", "n", "fp", "sig"],
                )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(tidy(sign), "id long, n int, fp binary, sig binary")


def _neighbours(classes: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """Pairs (a, fa, b, fb) of classes next to each other in a sorted order, with ``least`` values in common."""
    part, prefix = 4 * depth, 4 * least
    rows = classes.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("t"), "sig", "fp", "rep", "n")
    # equals stand in another order in each tree: in one order for all, they'd be a path as long as they are many
    rows = rows.select("t", F.expr(f"substring(sig, t * {part} + 1, {part})").alias("k"), "fp", "rep", "n", F.xxhash64("t", "fp").alias("tie"))
    rows = rows.repartitionByRange("t", "k", "tie").sortWithinPartitions("t", "k", "tie", "fp").drop("tie")
    schema = "kind int, pid int, t int, k binary, a long, fa binary, an int, b long, fb binary, bn int"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, last, first = TaskContext.get().partitionId(), None, True

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "pid", "t", "k", "a", "fa", "an", "b", "fb", "bn"])

        for batch in batches:
            pairs = []
            for t, k, fp, rep, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first:
                    pairs.append((1, pid, t, k, rep, fp, n, None, None, None))
                    first = False
                elif last[0] == t and last[1][:prefix] == k[:prefix]:
                    pairs.append((0, pid, t, None, last[3], last[2], last[4], rep, fp, n))
                last = (t, k, fp, rep, n)
            if pairs:
                yield out(pairs)
        if last is not None:
            yield out([(2, pid, last[0], last[1], last[3], last[2], last[4], None, None, None)])

    found = cut(rows.mapInArrow(tidy(scan), schema), "forest")
    # where one partition ends and the next begins: two rows of each partition
    w = Window.orderBy("pid", "kind")
    edge = found.where("kind > 0").select("kind", "pid", "t", "k", "a", "fa", "an", *[F.lag(c).over(w).alias(f"l{c}") for c in ("kind", "t", "k", "a", "fa", "an")])
    edge = edge.where(f"kind = 1 AND lkind = 2 AND t = lt AND substring(k, 1, {prefix}) = substring(lk, 1, {prefix})")
    pairs = found.where("kind = 0").select("a", "fa", "an", "b", "fb", "bn").union(edge.select("la", "lfa", "lan", "a", "fa", "an"))
    return pairs.where("fa <> fb")


def _ordered(pairs: DataFrame, percent: int) -> DataFrame:
    """Each pair once, lower digest first, if its sizes allow the similarity."""
    return pairs.where(f"100L * least(an, bn) >= {percent}L * greatest(an, bn)").select(
        *[F.when(F.col("fa") < F.col("fb"), F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("a", "b", "a"), ("fa", "fb", "fa"), ("b", "a", "b"), ("fb", "fa", "fb"))]
    ).distinct()


def _confirmed(docs: DataFrame, pairs: DataFrame, most: int | None, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b), ``most`` ones if that is known, whose full sets are similar enough."""
    pairs = cut(pairs if most is None else dense(pairs, most), "candidates")
    most = pairs.count()
    texts = _texts(docs, pairs.select(F.col("a").alias("i")).union(pairs.select(F.col("b").alias("i"))), 2 * most, key, text)
    a = texts.select(F.col("id").alias("ia"), F.col("text").alias("ta"))
    b = texts.select(F.col("id").alias("ib"), F.col("text").alias("tb"))
    both = pairs.join(a, F.col("a") == F.col("ia")).select("a", "fa", "b", "fb", "ta").join(b, F.col("b") == F.col("ib")).select("a", "fa", "b", "fb", "ta", "tb")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, [4, 5], SLICE_ROWS, SLICE_BYTES):
                spelled = pa.concat_arrays([rows.column(4), rows.column(5)]).dictionary_encode()
                sets = shingle_sets(spelled.dictionary, shingle)
                fps = [digest(s) for s in sets]
                codes, n = spelled.indices.to_numpy(), rows.num_rows
                keep = []
                for x, y, fx, fy in zip(codes[:n].tolist(), codes[n:].tolist(), rows.column(1).to_pylist(), rows.column(3).to_pylist(), strict=True):
                    # of rows with one key, only those of the pair's classes
                    if fps[x] != fx or fps[y] != fy:
                        keep.append(False)
                        continue
                    both_n = len(sets[x]) + len(sets[y])
                    union = len(np.unique(np.concatenate([sets[x], sets[y]])))
                    keep.append(100 * (both_n - union) >= percent * union)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return dense(both.mapInArrow(tidy(confirm), "a long, b long").where("a <> b").distinct(), most)


def components(links: DataFrame) -> DataFrame:
    """links: (a, b). (id, label): the smallest vertex that each vertex of a link can reach.

    Each round a vertex takes the least label of its neighbours, and so does the vertex that is its own label;
    then each takes the label of its label. So whole trees of labels are hung up at once, and paths shrink by
    halves whatever the order of their vertices. Every round is cut to the shared folder. links: a table that
    was cut."""
    spark = links.sparkSession
    most = 2 * links.count()
    edges = cut(dense(links.select("a", "b").union(links.select("b", "a")).distinct(), most), "links")
    labels, path = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), new_path(spark, "labels")
    dense(labels, most).write.parquet(path)
    labels = spark.read.schema(labels.schema).parquet(path)
    # each vertex's label is asked for by its neighbours, and once more by whoever takes it
    n = labels.count()
    few = n * 32 <= BROADCAST_BYTES
    while True:
        at = labels.select(F.col("id").alias("v"), F.col("label").alias("l"))
        at = F.broadcast(at) if few else at
        mine = at.select(F.col("v").alias("u"), F.col("l").alias("own"))
        heard = edges.join(at, F.col("b") == F.col("v")).join(F.broadcast(mine) if few else mine, F.col("a") == F.col("u")).where("l < own")
        heard = heard.select(F.explode(F.array("a", "own")).alias("id"), F.col("l").alias("label"), F.lit(None).cast("long").alias("own"))
        low = heard.union(labels.select("id", "label", F.col("label").alias("own"))).groupBy("id").agg(F.max("own").alias("old"), F.min("label").alias("near"))
        new, next_path = low.join(at, F.col("near") == F.col("v"), "left").select("id", "old", F.least("near", F.coalesce("l", "near")).alias("label")), new_path(spark, "labels")
        dense(new, n).write.parquet(next_path)
        new = spark.read.schema(new.schema).parquet(next_path)
        # the round before is in no plan any more
        remove(spark, path)
        labels, path = new.select("id", "label"), next_path
        if new.where("old <> label").isEmpty():
            return labels


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """The labels once further links are added: only components are linked anew."""
    to = lambda c: labels.select(F.col("id").alias(f"v{c}"), F.col("label").alias(f"l{c}"))
    j = more.join(to("a"), F.col("a") == F.col("va"), "left").join(to("b"), F.col("b") == F.col("vb"), "left")
    between = j.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct()
    between = cut(dense(between, more.count()), "between")
    if between.isEmpty():
        return labels
    over = components(between)
    up = over.select(F.col("id").alias("u"), F.col("label").alias("top"))
    old = labels.join(up, F.col("label") == F.col("u"), "left").select("id", F.coalesce("top", "label").alias("label"))
    return cut(old.union(over.join(labels.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_anti")), "labels")


def _regions(classes: DataFrame, most: int, trees: int, depth: int, least: int) -> DataFrame | None:
    """(region, fp, rep, n, comp) of the regions in which components of ``most`` classes differ."""
    rows = classes.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("t"), "sig", "fp", "rep", "n", "comp")
    at = rows.withColumn("region", F.expr(f"xxhash64(t, substring(sig, t * {4 * depth} + 1, {4 * least}))"))
    mixed = cut(dense(at.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("region"), most * trees, 16), "regions")
    n = mixed.count()
    if not n:
        return None
    side = F.broadcast(mixed) if n * 32 <= BROADCAST_BYTES else mixed
    return at.join(side, "region", "left_semi").select("region", "fp", "rep", "n", "comp")


def _texts(docs: DataFrame, ids: DataFrame, most: int, key: str, text: str) -> DataFrame:
    """(id, text) of the rows whose key is among ids (i), ``most`` ones."""
    ids = cut(dense(ids.distinct(), most, 16), "ids")
    side = F.broadcast(ids) if ids.count() * 32 <= BROADCAST_BYTES else ids
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return texts.join(side, F.col("id") == F.col("i"), "left_semi")


def bucket_counts(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((s >> np.uint64(20)).astype(np.uint8), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def _with_counts(docs: DataFrame, regions: DataFrame, most: int, key: str, text: str, shingle: int) -> DataFrame:
    """The regions' rows, of ``most`` classes, with the bucket counts of their sets."""
    play = regions.select("fp", "rep").distinct()
    texts = _texts(docs, play.select(F.col("rep").alias("i")), most, key, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, [1], SLICE_ROWS, SLICE_BYTES):
                # of rows with one key, only the class's own
                kept = [(fp, bucket_counts(x)) for x, fp in zip(shingle_sets(rows.column(1), shingle), rows.column(0).to_pylist(), strict=True) if digest(x) == fp]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in kept], pa.binary()) for j in (0, 1)], names=["v", "counts"])

    counts = play.join(texts, F.col("rep") == F.col("id")).select("fp", "text").mapInArrow(tidy(count), "v binary, counts binary").dropDuplicates(["v"])
    where = regions.groupBy("fp").agg(F.collect_set("region").alias("own")).withColumnRenamed("fp", "u")
    return regions.join(where, F.col("fp") == F.col("u")).join(counts, F.col("fp") == F.col("v")).drop("u", "v")


def _sized(regions: DataFrame) -> DataFrame:
    """The regions' rows with their region's largest component (major), rows, and rows outside that component."""
    sizes = regions.groupBy("region", "comp").agg(F.count("*").alias("k"))
    sizes = sizes.groupBy("region").agg(F.max(F.struct("k", "comp")).alias("most"), F.sum("k").alias("rows"))
    sizes = sizes.select(F.col("region").alias("m"), F.col("most.comp").alias("major"), "rows", (F.col("rows") - F.col("most.k")).alias("outside"))
    return regions.join(sizes, F.col("region") == F.col("m")).drop("m")


def _by_rare_shingles(docs: DataFrame, members: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """Pairs of different components among members (fp, rep, n, comp) that can be similar enough: those that share
    one of their rarest shingles.

    Of two sets as similar as that, each has one of the shingles that both share among its n - ceil(n * percent / 100) + 1
    first ones, in any order that is the same for both. Here the rarest come first, as counted among the members in
    ``RARITY`` buckets of hashes, so what a template brings to all its pages meets nothing. The counts, which are of
    one size whatever the members, are broadcast; what is shuffled are the first shingles alone."""
    spark, members = docs.sparkSession, cut(members.dropDuplicates(["fp"]), "members-of-large")
    texts = _texts(docs, members.select(F.col("rep").alias("i")), members.count(), key, text)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, [4], SLICE_ROWS, SLICE_BYTES):
                sets = shingle_sets(rows.column(4), shingle)
                # of rows with one key, only the class's own
                own = [k for k, (x, fp) in enumerate(zip(sets, rows.column(0).to_pylist(), strict=True)) if digest(x) == fp]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own, pa.int64())) for c in rows.columns[:4]), pa.array([sets[k].view(np.int64) for k in own], pa.list_(pa.int64()))], names=["fp", "rep", "n", "comp", "hs"])

    spelled = members.join(texts, F.col("rep") == F.col("id")).select("fp", "rep", "n", "comp", "text")
    spelled = cut(spelled.mapInArrow(tidy(spell), "fp binary, rep long, n int, comp long, hs array<long>"), "spelled")

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(RARITY, dtype=np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy() & (RARITY - 1), minlength=RARITY)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    counted = spelled.select("hs").mapInArrow(often, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(RARITY, dtype=np.int64)
    counts[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            kept = []
            for hs in batch.column(2):
                h = hs.values.to_numpy()
                order = np.lexsort((h, rarity[h & (RARITY - 1)]))
                kept.append(h[order[: len(h) - -(-len(h) * percent // 100) + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.list_(pa.int64()))], names=["rep", "comp", "hs"])

    prefixes = spelled.select("rep", "comp", "hs").mapInArrow(tidy(first), "rep long, comp long, hs array<long>")
    prefixes = cut(prefixes.select("rep", "comp", F.explode("hs").alias("h")), "prefixes")
    shared.destroy()
    other = prefixes.select(F.col("h").alias("g"), F.col("rep").alias("b"), F.col("comp").alias("other"))
    pairs = cut(prefixes.join(other, (F.col("h") == F.col("g")) & (F.col("rep") < F.col("b")) & (F.col("comp") != F.col("other"))).select(F.col("rep").alias("a"), "b").distinct(), "by-rare")
    named = lambda x: members.select(F.col("rep").alias(f"{x}r"), F.col("fp").alias(f"f{x}"), F.col("n").cast("long").alias(f"{x}n"))
    return pairs.join(named("a"), F.col("a") == F.col("ar")).join(named("b"), F.col("b") == F.col("br")).select("a", "fa", "an", "b", "fb", "bn")


def _across(r: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a region and that the bucket counts allow: those outside
    a region's largest component with all others."""
    r = cut(r, "mixed")
    # a region's rows have its number of rows outside its largest component each
    n, work = r.agg(F.count("*"), F.coalesce(F.sum("outside"), F.lit(0))).first()
    r = r.withColumn("runs", F.expr(f"1 + outside div {BLOCK_ROWS * RUN_BLOCKS}"))
    block = lambda df, n, p: df.withColumn("block", F.expr(f"pmod(xxhash64(fp), 1 + {n} div {BLOCK_ROWS})")).groupBy("region", "runs", "block").agg(F.collect_list(F.struct("rep", "fp", "n", "comp", "counts", "own", (F.col("comp") == F.col("major")).alias("is_major"))).alias(p))
    x = block(r.where("comp <> major"), "outside", "x").select("region", F.expr("pmod(block, runs)").alias("run"), "x")
    y = block(r, "rows", "y").select(F.col("region").alias("ry"), "y", F.explode(F.expr("sequence(0L, runs - 1)")).alias("turn"))
    both = x.join(y, (F.col("region") == F.col("ry")) & (F.col("run") == F.col("turn"))).select("x", "y", "region")
    both = both.coalesce(max(4 * LEAST_TASKS, work // TASK_PAIRS, n * 2 * BUCKETS // TASK_BYTES))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(col: pa.Array, i: int) -> tuple:
            rep, fp, n, comp, counts, own, is_major = col[i].values.flatten()
            grid = np.frombuffer(b"".join(counts.to_pylist()), dtype=np.uint8).reshape(-1, BUCKETS)
            return rep.to_numpy(), fp.to_pylist(), n.to_numpy().astype(np.int64), comp.to_numpy(), grid, is_major.to_numpy(zero_copy_only=False), own

        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                ra, fa, na, ca, va, _, own_a = side(batch.column(0), i)
                rb, fb, nb, cb, vb, mb, own_b = side(batch.column(1), i)
                at, sets_b = batch.column(2)[i].as_py(), [frozenset(x) for x in own_b.to_pylist()]
                for j, mine in enumerate(own_a.to_pylist()):
                    apart = (np.maximum(vb, va[j]) - np.minimum(vb, va[j])).sum(axis=1, dtype=np.int64)
                    fits = ((100 + percent) * apart <= (100 - percent) * (nb + na[j])) & (cb != ca[j])
                    out += [(ra[j], fa[j], na[j], rb[k], fb[k], nb[k]) for k in np.flatnonzero(fits) if (mb[k] or fa[j] < fb[k]) and min(sets_b[k].intersection(mine)) == at]
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)], names=["a", "fa", "an", "b", "fb", "bn"])

    return both.mapInArrow(tidy(compare), "a long, fa binary, an long, b long, fb binary, bn long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, percent: int = 85,
    trees: int = 20, depth: int = 6, least: int = 4, sorted_trees: int = 4,
) -> DataFrame:
    """One row per document: key, n_shingles, component_id and kept (key = component_id)."""
    ship(docs.sparkSession)
    integral(docs, key)
    with text_batches(docs.sparkSession):
        return settled(docs.sparkSession, "components", lambda: _near_duplicates(docs, key, text, shingle, percent, trees, depth, least, sorted_trees))


def _near_duplicates(docs: DataFrame, key: str, text: str, shingle: int, percent: int, trees: int, depth: int, least: int, sorted_trees: int) -> DataFrame:
    rows = cut(_signatures(docs, key, text, shingle, trees * depth), "signatures")
    d = rows.count()
    classes = rows.where("id IS NOT NULL AND fp IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = cut(dense(classes, d, 64 + 4 * trees * depth), "classes")
    n = classes.count()
    member = rows.where("id IS NOT NULL AND fp IS NOT NULL").select("id", "fp").join(classes.select(F.col("fp").alias("f"), "rep"), F.col("fp") == F.col("f")).select("id", "rep")
    member = cut(dense(member.distinct(), d, 16), "members")
    # a key with several sets ties their classes together
    tied = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a < hi").select(F.col("id").alias("i"), "a")
    tied = member.join(tied, F.col("id") == F.col("i")).where("rep <> a").select("a", F.col("rep").alias("b"))

    first = _confirmed(docs, _ordered(_neighbours(classes, sorted_trees, depth, least), percent), sorted_trees * n, key, text, shingle, percent)
    links = cut(dense(first.union(tied).distinct(), sorted_trees * n + d, 16), "links-1")
    labels = components(links)
    placed = classes.join(labels, F.col("rep") == F.col("id"), "left").select("fp", "rep", "n", "sig", F.coalesce("label", "rep").alias("comp"))
    regions = _regions(cut(placed, "placed"), n, trees, depth, least)
    if regions is not None:
        sized = cut(dense(_sized(regions), n * trees), "sized")
        small, large = sized.where(f"outside * rows <= {MOST_PAIRS}"), sized.where(f"outside * rows > {MOST_PAIRS}")
        pairs = _across(_with_counts(docs, small, n, key, text, shingle), percent)
        if not large.isEmpty():
            pairs = pairs.union(_by_rare_shingles(docs, large.select("fp", "rep", "n", "comp"), key, text, shingle, percent))
        pairs = _ordered(pairs, percent)
        more = cut(_confirmed(docs, pairs, None, key, text, shingle, percent), "links-2")
        if not more.isEmpty():
            labels = merged(labels, more)
    final = member.groupBy("id").agg(F.min("rep").alias("rep")).join(labels.withColumnRenamed("id", "v"), F.col("rep") == F.col("v"), "left")
    final = final.select(F.col("id").alias("m"), F.coalesce("label", "rep").alias("comp"))
    out = rows.select("id", "n").join(final, F.col("id") == F.col("m"), "left")
    component = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
