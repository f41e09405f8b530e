"""Token-ID output: documents encoded in ascending key order into Simple-8b images, and read back.

Rows are dealt into key ranges and sorted; each task encodes its rows and emits an image whenever enough
tokens have gathered, so memory is bounded by an image, a slice of a batch and a memory of words that is
bounded by bytes. Spark's own writer
commits the images to the shared folder, so lost executors and repeated attempts leave no stray file.
A file of the output has one image a row, in order; ``first`` values come from a sum over images alone.

The word tokenizer drops white space and never joins characters across it: its pattern has no token
with white space, and its normaliser composes and lower-cases within a word. So each blank-separated
word is encoded on its own, once for each worker, and texts become gathers from that memory. A last
sign of ``,.;:!?`` behind an ASCII letter is a token stretch of its own and is looked up apart.

Defined results: a null text is empty, so it has the end id alone. Keys must be of an integral type, else a
TypeError says so. Null keys come first. Rows of equal
keys are ordered by a hash of their texts, then by text. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridex.llm import simple8b
from veridex.llm.common import BROADCAST_BYTES, give_back, integral, new_path, ship, text_batches, tidy
from veridex.llm.tokens import KEPT_CHARS, PLAIN, marked, pretoken, tokenizer

#: What a worker's memory of words may take.
KEPT_BYTES = 64 << 20
#: What may stand behind a plain word: each is one stretch, and one token or more.
SIGNS = ["", ",", ".", ";", ":", "!", "?"]
IMAGE_TOKENS = 1 << 20
#: Bytes of text that are split into words at once; of a longer text, stretches of so many characters.
SLICE_BYTES = 2 << 20
BLANK = re.compile(r"[ \t-\r]")


def stretches(text: str, size: int = SLICE_BYTES) -> Iterator[str]:
    """The text in parts cut at blanks; a word is never cut, however long."""
    at = 0
    while at < len(text):
        blank = BLANK.search(text, at + size)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    return sizes, np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(sizes.sum()))


class WordIds:
    """Ids of words in one pool, with where each word's begin and how many they are.

    Words are found by their 64-bit hashes in a sorted array and compared with the spelling that is kept, so what is
    kept takes some 60 bytes a word. When it would exceed ``kept_bytes``, or the pool does, all is forgotten;
    words of over ``KEPT_CHARS`` are forgotten after their slice."""

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        self.tok, self.kept_bytes, self.last = tokenizer(path), kept_bytes, marked(path, "</w>", at_end=True)
        self.signs = {x: np.array([t.id for t in self.tok.model.tokenize(x)], dtype=np.uint32) for x in SIGNS}
        self.forget()

    def forget(self) -> None:
        # entry 0 is no word
        self.hashes, self.entries, self.words = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32), pa.array([""], pa.string())
        self.start, self.size, self.pool = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def held(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.entries, self.words, self.start, self.size, self.pool))

    def find(self, words: list[str]) -> np.ndarray:
        """Each word's entry, or -1."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not words or not len(self.hashes):
            return out
        h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        found = self.entries[at[hit]]
        same = pc.equal(self.words.take(pa.array(found)), pa.array(words, pa.string()).take(pa.array(hit)))
        same = same.to_numpy(zero_copy_only=False)
        out[hit[same]] = found[same]
        return out

    def add(self, words: list[str], sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """The entries of new words, whose ids follow each other in ``flat``."""
        first, n = len(self.start), len(self.pool)
        self.pool = np.concatenate([self.pool, flat.astype(np.uint32, copy=False)])
        self.start, self.size = np.concatenate([self.start, n + np.cumsum(sizes) - sizes]), np.concatenate([self.size, sizes])
        made = np.arange(first, first + len(words))
        short = np.flatnonzero(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) <= KEPT_CHARS)
        # entries of long words have no spelling, so they aren't found
        self.words = pa.concat_arrays([self.words, pa.array([w if len(w) <= KEPT_CHARS else "" for w in words], pa.string())])
        h = pd.util.hash_array(np.array(words, dtype=object)[short], categorize=False) if len(short) else np.zeros(0, dtype=np.uint64)
        h, where = np.unique(h, return_index=True)
        fresh = np.ones(len(h), dtype=bool)
        if len(self.hashes):  # of words with one hash, the first is found
            fresh = self.hashes[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)] != h
        h, own = h[fresh], made[short][where][fresh].astype(np.int32)
        at = np.searchsorted(self.hashes, h)
        self.hashes, self.entries = np.insert(self.hashes, at, h), np.insert(self.entries, at, own)
        return made

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.size[entries]
        ends = np.cumsum(sizes)
        return self.pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[entries] - ends + sizes, sizes)], sizes

    def learn(self, words: list[str]) -> np.ndarray:
        """Entries of distinct words, which are added where they aren't known."""
        out = self.find(words)
        stems: dict[str, int] = {}
        plain, whole, spelled = [], [], []
        for k in np.flatnonzero(out < 0).tolist():
            w = words[k]
            m = PLAIN.fullmatch(w)
            if m is None:
                whole.append(k)
                continue
            stem = m[1].lower()
            plain.append((k, stems.setdefault(stem, len(stems)), m[2]))
            spelled.append(stem)
        at = self.find(list(stems))
        new = [x for x, e in zip(stems, at.tolist(), strict=True) if e < 0]
        if new:
            at[at < 0] = self.add(new, *self._stems(new))
        if plain:
            # the word is its stem, the stem in other letters, or the stem and a sign
            same = [(k, s) for (k, s, sign), x in zip(plain, spelled, strict=True) if not sign and words[k] == x]
            if same:
                ks, ss = (np.array(x) for x in zip(*same, strict=True))
                out[ks] = at[ss]
            other = [(k, s, sign) for (k, s, sign), x in zip(plain, spelled, strict=True) if sign or words[k] != x]
            if other:
                flat, sizes = self.gather(at[[s for _, s, _ in other]])
                ends = np.cumsum(sizes)
                tails = [self.signs[sign] if sign else self.signs[""] for _, _, sign in other]
                more = np.fromiter(map(len, tails), dtype=np.int64, count=len(tails))
                flat = np.insert(flat, np.repeat(ends, more), np.concatenate(tails))
                out[[k for k, _, _ in other]] = self.add([words[k] for k, _, _ in other], sizes + more, flat)
        for i in range(0, len(whole), 4096):
            part = whole[i : i + 4096]
            ids = [e.ids for e in self.tok.encode_batch_fast([words[k] for k in part], add_special_tokens=False)]
            out[part] = self.add([words[k] for k in part], *_flat(ids))
        return out

    def _stems(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of lower-case words of letters: each is one stretch, and only its last token ends a word."""
        sizes, flat = [], []
        for i in range(0, len(stems), 2048):
            part = stems[i : i + 2048]
            (e,) = self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(e.ids, dtype=np.uint32)
            n = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
            if len(n) != len(part):
                n, ids = _flat([[t.id for t in self.tok.model.tokenize(pretoken(x))] for x in part])
            sizes.append(n)
            flat.append(ids)
        return np.concatenate(sizes), np.concatenate(flat)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids without a break, and how many stand before each text and in all."""
        split = pc.ascii_split_whitespace(texts)
        offsets = np.asarray(split.offsets)
        found = split.flatten().dictionary_encode()
        unique = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.zeros(len(unique), dtype=np.int64)
        real = [k for k, w in enumerate(unique) if w]
        known[real] = self.learn([unique[k] for k in real])
        words = known[np.asarray(found.indices)] if len(unique) else np.zeros(0, dtype=np.int64)
        flat, sizes = self.gather(words)
        if self.held() > self.kept_bytes:
            self.forget()
        return flat, np.concatenate([[0], np.cumsum(sizes)])[offsets - offsets[0]]

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice of the texts their ids without a break, and each text's number of ids; the end
        id closes each."""
        texts = texts.fill_null("")
        upto = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)])
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + SLICE_BYTES, side="right")) - 1)
            if upto[b] - upto[a] > SLICE_BYTES:  # one long text
                parts = [self.ids(pa.array([x]))[0] for x in stretches(texts[a].as_py())]
                v = np.concatenate([*parts, np.array([end_id], dtype=np.uint32)])
                yield v, np.array([len(v)])
            else:
                flat, ends = self.ids(texts.slice(a, b - a))
                yield np.insert(flat, ends[1:], np.uint32(end_id)), np.diff(ends) + 1
            a = b


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int, key: str = "doc_id", text: str = "text", image_tokens: int = IMAGE_TOKENS) -> None:
    """Writes the documents' ids to ``path``, a table of (part, seq, n_docs, n_tokens, image)."""
    ship(docs.sparkSession)
    integral(docs, key)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memory, part, seq = word_ids(tokenizer_path), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        lengths: list[np.ndarray] = []
        values: list[np.ndarray] = []

        def image() -> pa.RecordBatch:
            n, v = np.concatenate(lengths), np.concatenate(values)
            row = [[part], [seq], [len(n)], [len(v)], [simple8b.pack(keys, n, v)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "seq", "n_docs", "n_tokens", "image"])

        for batch in batches:
            known = batch.column(0).to_pylist()
            for v, n in memory.encode(batch.column(1), end_id):
                keys += known[: len(n)]
                known = known[len(n) :]
                lengths.append(n)
                values.append(v)
                if sum(map(len, values)) >= image_tokens:
                    yield image()
                    seq, keys, lengths, values = seq + 1, [], [], []
                    give_back()
        if keys:
            yield image()

    # ranges are found from a sample of their columns, so texts stand in it by their hashes
    ordered = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    ordered = ordered.repartitionByRange("key", "h").sortWithinPartitions("key", "h", "text").drop("h")
    images = ordered.mapInArrow(tidy(encode), "part int, seq int, n_docs long, n_tokens long, image binary")
    # images are large rows: the writer looks at its buffer after each
    with text_batches(docs.sparkSession):
        images.write.option("compression", "none").option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 1).option("parquet.enable.dictionary", "false").parquet(path)


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row per document, from the files alone: key, start (ids of all documents before it), n_tokens
    and ids_crc32 (of the ids as little-endian 32-bit integers)."""
    ship(spark)
    files = spark.read.schema("part int, seq int, n_docs long, n_tokens long, image binary").parquet(path)
    # sums over parts, which are as many as tasks, then within each part
    over = lambda w, by: F.coalesce(F.sum("n_tokens").over(w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select(F.col("part").alias("p"), over(Window.partitionBy(), "part").alias("base"))
    inner = files.select("part", "seq", over(Window.partitionBy("part"), "seq").alias("inner"))
    first = inner.join(parts, F.col("part") == F.col("p")).select("part", "seq", (F.col("base") + F.col("inner")).alias("first"))
    side = F.broadcast(first) if files.count() * 64 <= BROADCAST_BYTES else first
    placed = files.select("part", "seq", "image").join(side, ["part", "seq"]).select("first", "image")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids.cache_clear()  # a worker lives on, and what it kept for encoding with it
        for batch in batches:
            for first, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, lengths, values = simple8b.unpack(image.as_py())
                ends = np.cumsum(lengths)
                data, starts = values.astype("<u4"), ends - lengths
                crcs = [zlib.crc32(data[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + first), pa.array(lengths), pa.array(crcs, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(tidy(decode), "key long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Writes, then reads back; see ``write_tokens`` and ``read_tokens``."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens", keep=True)
    write_tokens(docs, tokenizer_path, path, end_id, key, text)
    return read_tokens(spark, path, key)
