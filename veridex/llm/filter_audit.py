"""How filters overlap: what each removes in every order in which they can be applied.

1. A pass over the texts' Arrow buffers marks what each document fails. A table of byte classes turns the bytes
   of many texts into blanks, capitals, signs and continuation bytes; prefix sums at the texts' offsets count
   them and the words. Words are hashed eight bytes at a time, and the hashes sorted by document; neighbours
   of one hash are compared byte by byte, and a document with two different words of one hash is counted anew.
2. Copies: the smallest key of each digest (128 bits) comes from an aggregate. Rows that have it are joined on
   digest and key, so that copies of one text, however many, are dealt out by their keys.
3. Documents are counted by part, the set of filters that they fail (32 sets), and labels. An order's step
   removes the sets that hold its filter and none before it: all orders and steps are a matrix of 32 rows,
   and a part's figures are its counts times that matrix.

Defined results: a null text is empty. A null source is the part '', as an empty one. A null key is no copy,
makes no other row one, and has no labels. Of rows of one text, those of the smallest key are no copies, so rows
alike in both are none of each other. A key with several label rows counts as good or toxic if one of them says
so. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm.common import BROADCAST_BYTES, cut, ship, tidy
from veridex.scratch import settled

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 50, 65, 5, b"#$%&*|"
#: Bytes of text that are classified at once; a longer text is classified in pieces of that size.
BLOCK_BYTES = 4 << 20
#: Words longer than this are hashed and compared one by one.
LONG_WORD = 64
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


BLANK, CAPITAL, SIGN = _class(b" \t\n\x0b\x0c\r"), _class(bytes(range(65, 91))), _class(SIGNS)
#: UTF-8's bytes that begin no code point.
INNER = _class(bytes(range(128, 192)))


def _sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marks stand before each offset."""
    total = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=total[1:])
    return total[offsets]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[2]
    return h ^ (h >> np.uint64(29))


class Words:
    """Words of a buffer, by where they begin, how long they are and which document has them."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, doc: np.ndarray):
        self.bytes = data.tobytes()
        # eight bytes can be read from any place
        self.eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
        self.at, self.size, self.doc = at, size, doc

    def eight(self, w: np.ndarray, begin: int) -> np.ndarray:
        """Bytes ``begin`` to ``begin`` + 8 of the words, zeros behind their end."""
        got = np.ascontiguousarray(self.eights[self.at[w] + begin]).view("<u8")[:, 0]
        left = np.minimum(self.size[w] - begin, 8).astype(np.uint64)
        return got & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))

    def hashes(self) -> np.ndarray:
        every = np.arange(len(self.at))
        h = _mix(self.size.astype(np.uint64) * _ODD[0] + self.doc.astype(np.uint64) * _ODD[1])
        short, begin = every[self.size <= LONG_WORD], 0
        while len(short):
            h[short] = _mix(h[short] * _ODD[0] + self.eight(short, begin))
            begin += 8
            short = short[self.size[short] > begin]
        for w in np.flatnonzero(self.size > LONG_WORD).tolist():
            a = int(self.at[w])
            own = hashlib.blake2b(memoryview(self.bytes)[a : a + int(self.size[w])], digest_size=8).digest()
            h[w] ^= np.uint64(int.from_bytes(own, "little"))
        return h

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether these are the same words of the same documents, byte by byte."""
        same = (self.doc[a] == self.doc[b]) & (self.size[a] == self.size[b])
        left, begin = np.flatnonzero(same & (self.size[a] <= LONG_WORD)), 0
        while len(left):
            same[left] = self.eight(a[left], begin) == self.eight(b[left], begin)
            begin += 8
            left = left[same[left] & (self.size[a[left]] > begin)]
        for i in np.flatnonzero(same & (self.size[a] > LONG_WORD)).tolist():
            p, q, n = int(self.at[a[i]]), int(self.at[b[i]]), int(self.size[a[i]])
            same[i] = memoryview(self.bytes)[p : p + n] == memoryview(self.bytes)[q : q + n]
        return same

    def distinct(self, docs: int) -> np.ndarray:
        """How many different words each document has."""
        if not len(self.at):
            return np.zeros(docs, dtype=np.int64)
        h = self.hashes()
        order = np.argsort(h)
        a, b = order[:-1], order[1:]
        alike = np.flatnonzero(h[a] == h[b])
        same = self.same(a[alike], b[alike])
        out = np.bincount(self.doc, minlength=docs) - np.bincount(self.doc[a[alike[same]]], minlength=docs)
        clash = alike[~same]
        for d in np.unique(np.concatenate([self.doc[a[clash]], self.doc[b[clash]]])).tolist():
            mine = np.flatnonzero(self.doc == d)
            out[d] = len({self.bytes[s : s + n] for s, n in zip(self.at[mine].tolist(), self.size[mine].tolist(), strict=True)})
        return out


def _word_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; the texts' offsets part words as blanks do."""
    filled = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(BLANK[data], out=filled[1:-1])
    begins, ends = filled[1:-1] & ~filled[:-2], filled[1:-1] & ~filled[2:]
    inside = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inside] = filled[1:-1][inside]
    ends[inside - 1] = filled[1:-1][inside - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def scan(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts for each text of a buffer: words, distinct words, capitals, signs and code points."""
    n = len(offsets) - 1
    out = {k: np.zeros(n, dtype=np.int64) for k in ("capitals", "signs", "points")}
    begins, ends = [], []
    for p in range(0, max(len(data), 1), BLOCK_BYTES):
        piece = data[p : p + BLOCK_BYTES]
        at = np.clip(offsets - p, 0, len(piece))
        for name, marks in (("capitals", CAPITAL[piece]), ("signs", SIGN[piece]), ("points", ~INNER[piece])):
            out[name] += np.diff(_sums(marks, at))
        b, e = _word_edges(piece, at)
        begins.append(b + p)
        ends.append(e + p)
    at, end = np.concatenate(begins), np.concatenate(ends)
    # a word that goes on into the next piece was cut there
    if len(data) > BLOCK_BYTES:
        cuts = np.arange(BLOCK_BYTES, len(data), BLOCK_BYTES)
        joined = np.setdiff1d(cuts[~BLANK[data[cuts]] & ~BLANK[data[cuts - 1]]], offsets)
        at, end = at[~np.isin(at, joined)], end[~np.isin(end, joined)]
    doc = np.searchsorted(offsets, at, side="right") - 1
    words = Words(data, at, end - at, doc)
    return out | {"words": np.bincount(doc, minlength=n).astype(np.int64), "distinct": words.distinct(n)}


def failures(texts: pa.Array) -> np.ndarray:
    """For each text the filters A to D that it fails, as bits."""
    out = np.zeros(len(texts), dtype=np.int64)
    if not len(texts):
        return out
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    every = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        # as many texts as fit in a block, one at least
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, side="right")) - 1)
        c = scan(every[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        a, b = c["words"] < MIN_WORDS, 100 * c["distinct"] < DISTINCT_PERCENT * c["words"]
        out[i:j] = a + 2 * b + 4 * (100 * c["capitals"] > CAPITAL_PERCENT * c["points"]) + 8 * (c["signs"] > 0)
        i = j
    return out


def _judged(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(id, part, fails, digest) of each row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.blake2b(t.as_buffer() if t.is_valid else b"", digest_size=16).digest() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(failures(batch.column(2)), pa.int32()), pa.array(digests, pa.binary())], names=["id", "part", "fails", "digest"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(judge), "id long, part string, fails int, digest binary")


def _labelled(counted: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``counted`` with whether each key is good and toxic."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    said = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("k")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).where("good OR toxic")
    said = cut(said, "labels")
    side = F.broadcast(said) if said.count() * 32 <= BROADCAST_BYTES else said
    no = F.lit(False)
    return counted.join(side, F.col("id") == F.col("k"), "left").withColumn("good", F.coalesce("good", no)).withColumn("toxic", F.coalesce("toxic", no))


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, own bit, bits before it) of every step of every order."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        bits = [1 << FILTERS.index(f) for f in order]
        out += [(order, i + 1, bits[i], sum(bits[:i])) for i in range(len(bits))]
    return out


def matrices() -> dict[str, np.ndarray]:
    """What a document of each set of failed filters adds to a column: 32 rows, one column for each step."""
    sets = np.arange(1 << len(FILTERS))[:, None]
    own, before = (np.array([o[i] for o in orders()])[None, :] for i in (2, 3))
    fails, earlier = (sets & own) > 0, (sets & before) > 0
    size = np.bitwise_count(sets).astype(np.int64)
    # in how many of all orders a filter comes first of those that a document fails
    turns = len(list(permutations(FILTERS))) // np.maximum(size, 1)
    return {
        "kept": ~fails & ~earlier, "removed": fails & ~earlier, "redundant": fails & earlier,
        "unique_fails": fails & (size == 1), "shapley": fails * turns,
    }


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley."""
    ship(docs.sparkSession)
    return settled(docs.sparkSession, "audit", lambda: _filter_audit(docs, labels, key, text, source))


def _filter_audit(docs: DataFrame, labels: DataFrame, key: str, text: str, source: str) -> DataFrame:
    rows = cut(_judged(docs, key, text, source), "judged")
    every = rows.groupBy("id", "part", "fails").agg(F.count("*").alias("n"))
    smallest = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least")).withColumnRenamed("digest", "d")
    alike = rows.where("id IS NOT NULL").groupBy("digest", "id", "part", "fails").agg(F.count("*").alias("n"))
    first = alike.join(smallest, (F.col("digest") == F.col("d")) & (F.col("id") == F.col("least"))).select("id", "part", "fails", "n")
    first = first.union(every.where("id IS NULL"))
    both = every.select("id", "part", "fails", "n", F.lit(0).cast("long").alias("first")).union(first.select("id", "part", "fails", F.lit(0).cast("long"), "n"))
    counted = _labelled(both.groupBy("id", "part", "fails").agg(F.sum("n").alias("n"), F.sum("first").alias("first")), labels, key)
    # those that are no copies fail what their text fails, the others E as well
    sets = counted.select("part", "good", "toxic", F.explode(F.array(F.struct("fails", F.col("first").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("first")).alias("n")))).alias("s"))
    many = sets.groupBy("part", F.col("s.fails").alias("fails")).agg(F.sum("s.n").alias("n"), F.sum(F.when(F.col("good"), F.col("s.n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("s.n")).otherwise(0)).alias("toxic"))
    of_part = many.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))  # 32 at most

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, steps = matrices(), orders()
        names, places = [o[0] for o in steps], np.array([o[1] for o in steps], dtype=np.int32)
        for batch in batches:
            for part, lists in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, *counts = (x.to_numpy().astype(np.int64) for x in lists.values.flatten())
                n, good, toxic = of = np.zeros((3, 1 << len(FILTERS)), dtype=np.int64)
                of[:, at] = counts
                cols = {k: n @ m.astype(np.int64) for k, m in by.items()}
                cols |= {"good_lost": good @ by["removed"].astype(np.int64), "toxic_lost": toxic @ by["removed"].astype(np.int64)}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(names)), pa.array(names), pa.array(places), *(pa.array(cols[c], pa.int64()) for c in COUNTS)], names=["part", "filter_order", "step", *COUNTS]
                )

    return of_part.mapInArrow(tidy(reduce), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


#: The counts of a row, in their order.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
