"""Hard negatives by dense products of blocks: anchors against all rows, in two passes.

Components become integers (floor(scale * x)), so scores are whole numbers, which float64 products give exactly
below 2^53. Anchors go to the tasks in groups of at most ``GROUP_BYTES``, a broadcast for each; every task multiplies
their blocks with its own blocks of rows.

1. The first pass keeps, for each anchor, the ``n_positives`` best other rows of its label. What a task has kept are
   a few rows for each anchor, whatever it read; the best of all tasks' are the anchor's positives.
2. The second pass keeps, for each anchor and positive, the ``k`` best rows of other labels whose score lies within
   the window that the positive's score sets, and merges them in the same way.

Higher scores come first, of equal ones the smaller key. A row that can't be among the best any more is left by one
comparison with the worst one kept, so a vector that is very common costs no more than others.

Defined results: rows without key, label or vector, and those with a null or non-finite component, take no part.
Vectors of different lengths have no score with each other. Rows of an anchor's own key are never its positives;
of a repeated key each row is a row of its own, and each anchor row gives its own results. An anchor without
positives, and a positive without negatives in its window, give no row. Components too large for exact scores raise
an error. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridex.llm.common import cut, integral, ship, tidy
from veridex.scratch import settled

#: What the vectors of a group of anchors may take, and rows of the blocks that are multiplied.
GROUP_BYTES, ANCHOR_ROWS, BLOCK_ROWS = 16 << 20, 512, 4096
#: Scores are exact below.
EXACT = 2.0**53
NO_ID = np.iinfo(np.int64).max


class Block:
    """Rows of vectors of one length, by ascending key."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, grid: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.grid, self.rows = ids[order], labels[order], grid[order], rows[order]
        self.norm = float(np.sqrt(np.square(grid).sum(axis=1)).max(initial=0.0))

    def scores(self, other: Block) -> np.ndarray:
        if not self.norm * other.norm < EXACT:
            raise ValueError("components are too large: scores of 2^53 and more aren't exact")
        return self.grid @ other.grid.T


def blocks(ids: pa.Array, labels: pa.Array, vectors: pa.Array, scale: int, most: int) -> Iterator[Block]:
    """Blocks of the rows that take part; ``rows`` are their places."""
    ok = np.logical_and.reduce([x.is_valid().to_numpy(zero_copy_only=False) for x in (ids, labels, vectors)])
    offsets, values = np.asarray(vectors.offsets).astype(np.int64), pc.cast(vectors.values, pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    ids, labels = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (ids, labels))
    for d in np.unique(sizes[ok]).tolist():
        rows = np.flatnonzero(ok & (sizes == d))
        for i in range(0, len(rows), most):
            part = rows[i : i + most]
            grid = values[offsets[part][:, None] + np.arange(d)]
            whole = np.isfinite(grid).all(axis=1)
            if whole.any():
                part = part[whole]
                yield Block(ids[part], labels[part], np.floor(grid[whole] * scale), part)


class Best:
    """The ``k`` best (score, id) of each slot."""

    def __init__(self, slots: int, k: int):
        self.k, self.score, self.id = k, np.full((slots, k), -np.inf), np.full((slots, k), NO_ID)

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        """A row of scores for each slot, a column for each id, ids ascending."""
        k, worst, last = self.k, self.score[slots, -1][:, None], self.id[slots, -1][:, None]
        ok = ok & ((scores > worst) | ((scores == worst) & (ids < last)))
        over = np.flatnonzero(np.count_nonzero(ok, axis=1) > k)
        if len(over):
            w = np.where(ok[over], scores[over], -np.inf)
            least = np.partition(w, w.shape[1] - k, axis=1)[:, -k][:, None]
            keep = w >= least
            # of many equal ones those of the smallest ids, which stand first
            tied = keep & (w == least)
            keep &= ~tied | (np.cumsum(tied, axis=1) <= k - np.count_nonzero(keep & ~tied, axis=1)[:, None])
            ok[over] = keep
        r, c = np.nonzero(ok)
        if not len(r):
            return
        touched = np.unique(r)
        g = np.concatenate([np.repeat(touched, k), r])
        s = np.concatenate([self.score[slots[touched]].ravel(), scores[r, c]])
        i = np.concatenate([self.id[slots[touched]].ravel(), ids[c]])
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        rank = np.arange(len(g)) - np.searchsorted(g, g)
        kept = rank < k
        self.score[slots[touched]], self.id[slots[touched]] = s[kept].reshape(-1, k), i[kept].reshape(-1, k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, score, id) of all that is kept."""
        slot, place = np.nonzero(self.score > -np.inf)
        return slot, self.score[slot, place].astype(np.int64), self.id[slot, place]


def _narrow(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))


def _grouped(anchors: DataFrame) -> tuple[DataFrame, int]:
    """The anchors with their group, and how many groups there are: none takes more than ``GROUP_BYTES`` unless it is one row."""
    bytes_of, groups = F.sum(F.size("v") * 8 + 64), 1
    while True:
        at = anchors.withColumn("group", F.expr(f"pmod(xxhash64(row), {groups})"))
        most = at.groupBy("group").agg(bytes_of.alias("b"), F.count("*").alias("n")).where("n > 1").agg(F.max("b")).first()[0] or 0
        if most <= GROUP_BYTES:
            return at, groups
        groups *= 2


def _pass(candidates: DataFrame, anchors: DataFrame, scale: int, slots: int, k: int, windows: bool) -> DataFrame:
    """(row, slot, score, id): what each task has kept for each anchor. With windows, slots are the anchor's
    positives, and rows of other labels between lo and hi count; without, others of its label."""
    spark, parts = candidates.sparkSession, []
    at, groups = _grouped(anchors)
    for group in range(groups):
        table = at.where(F.col("group") == group).drop("group").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        shared = spark.sparkContext.broadcast(table)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            t = shared.value
            column = lambda c: pa.concat_arrays(t.column(c).chunks)
            mine = list(blocks(column("id"), column("label"), column("v"), scale, ANCHOR_ROWS))
            best = Best(t.num_rows * slots, k)
            if windows:
                lo, hi = (np.array(t.column(c).to_pylist(), dtype=np.float64) for c in ("lo", "hi"))
            for batch in batches:
                for c in blocks(batch.column(0), batch.column(1), batch.column(2), scale, BLOCK_ROWS):
                    for a in mine:
                        if a.grid.shape[1] != c.grid.shape[1]:
                            continue
                        scores, alike = a.scores(c), a.labels[:, None] == c.labels
                        if not windows:
                            best.add(a.rows, scores, c.ids, alike & (a.ids[:, None] != c.ids))
                            continue
                        for j in range(slots):
                            best.add(a.rows * slots + j, scores, c.ids, ~alike & (scores >= lo[a.rows, j][:, None]) & (scores <= hi[a.rows, j][:, None]))
            slot, score, ids = best.rows()
            row = column("row").to_numpy()[slot // slots]
            for i in range(0, len(slot), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(row[s]), pa.array((slot[s] % slots).astype(np.int32)), pa.array(score[s]), pa.array(ids[s])], names=["row", "slot", "score", "found"])

        parts.append(cut(candidates.mapInArrow(tidy(keep), "row long, slot int, score long, found long"), "kept"))
        shared.destroy()
    if not parts:
        return spark.createDataFrame([], "row long, slot int, score long, found long, rank int")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    w = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "found")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
    n_positives: int = 5, k: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each row that ``anchors``
    holds for and each of its positives the best rows of other labels that score from ``low`` to ``high`` percent of
    the positive's score."""
    ship(rows.sparkSession)
    integral(rows, key)
    return settled(rows.sparkSession, "negatives", lambda: _hard_negatives(rows, anchors, key, vector, label, scale, n_positives, k, low, high))


def _hard_negatives(rows: DataFrame, anchors: Column, key: str, vector: str, label: str, scale: int, n_positives: int, k: int, low: int, high: int) -> DataFrame:
    candidates = _narrow(rows, key, vector, label)
    chosen = _narrow(rows.where(anchors), key, vector, label).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    chosen = cut(chosen.withColumn("row", F.monotonically_increasing_id()), "anchors")
    best = _pass(candidates, chosen, scale, 1, n_positives, windows=False)
    positives = cut(best.select("row", (F.col("rank") - 1).alias("slot"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # windows in whole numbers: low * p <= 100 * n <= high * p; none where the positive is missing
    lo, hi = f"-((({-low}) * positive_score - pmod(({-low}) * positive_score, 100)) div 100)", f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100"
    at = lambda c, none: F.array(*[F.coalesce(F.max(F.when(F.col("slot") == j, F.expr(c))).cast("double"), F.lit(none)) for j in range(n_positives)])
    windows = positives.groupBy("row").agg(at(lo, float("inf")).alias("lo"), at(hi, float("-inf")).alias("hi")).withColumnRenamed("row", "r")
    with_windows = cut(chosen.join(windows, F.col("row") == F.col("r")).drop("r"), "windows")
    found = _pass(candidates, with_windows, scale, n_positives, k, windows=True)
    named = positives.join(chosen.select(F.col("row").alias("a"), F.col("id").alias("anchor_id")), F.col("row") == F.col("a")).drop("a")
    named = named.select(F.col("row").alias("r"), F.col("slot").alias("s"), "anchor_id", "positive_id", "positive_score")
    out = found.join(named, (F.col("row") == F.col("r")) & (F.col("slot") == F.col("s")))
    return out.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
