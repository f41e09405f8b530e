"""Language identification by character models, one per language: interpolated Kneser-Ney of order 4.

Texts are lower-cased; what is no letter becomes one blank between words. Four-grams are counted over all
training documents, in the executors, and summed by language. Counts of lower orders are continuation
counts, taken from the distinct four-grams. Keys are the packed code points, so the sorted arrays are
exact hash tables that a binary search reads; per four-gram known to any language they hold the log
probability under every language. A text gets the language of the lowest cross-entropy per character.

Calibration: training documents are dealt into ``folds`` parts by hashes of their keys and counted by part.
Each document is judged once, by models of all parts but its own, whose counts are differences. By all of them
the sharpness that turns cross-entropies into probabilities is chosen by its likelihood, and for each language the
cross-entropy beyond which a text is rejected, as foreign to all languages learned, from exact ranks. The models then
used are of all documents. A language found in one part alone has no model there, so its documents don't calibrate.

Model size: every four-gram of every language is kept, so a rare language loses nothing to a frequent
one, and discounts and continuation counts are those of the whole corpus. A model of more than ``part_bytes``
comes in parts, by the third character of the four-grams: a four-gram, its lower orders and their contexts
all have that character, so a part needs nothing of the others but the counts of single characters and
the discounts, which are taken in the executors. Each part is read to the driver, built and broadcast on its own; the
log probabilities of a text are added up over the parts, so results are the same for any number of parts.

Defined results: a null text or one without a letter is ``und`` with score 0. Training rows with a null
language or text are skipped. Nothing learned: all are ``und``. Repeated rows count as often. Other
columns are not read; key, language and source never enter a prediction. An empty table gives an empty
result. Characters beyond U+FFFF share one code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm.common import cut, give_back, ship, tidy
from veridex.operators.ordinals import with_ordinals
from veridex.scratch import scope, settled

ORDER = 4
#: Parts of the training documents, each judged by models of the others.
FOLDS = 8
#: What sharpness may be.
SHARPS = (1, 2, 4, 8, 16, 32, 64, 128)
#: A model that would take more than this comes in parts that don't; see ``_models`` for the estimate.
PART_BYTES = 256 << 20
PAD = "\x01" * (ORDER - 1)
#: Characters handled at once, and the longest stretch of a text that is.
SLICE_CHARS, STRETCH = 1 << 18, 1 << 17


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """By code point: 0 for what is no letter, a blank for the pad, else the code."""
    table = np.fromiter((min(i, 0xFFFD) if chr(i).isalpha() else 0 for i in range(0x110000)), dtype=np.uint16, count=0x110000)
    table[1] = 32
    return table


def slices(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, starts, keys): the four-grams of some texts without a break, and where each row's begin.
    A text longer than a stretch comes as several rows of the same number."""
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        t = (t or "").lower()
        for at in range(0, max(len(t), 1), STRETCH):
            rows.append(i)
            # a later stretch begins with the letters before it
            parts.append(PAD + t[at : at + STRETCH] if at == 0 else PAD + t[at - ORDER + 1 : at + STRETCH])
            size += len(parts[-1])
            if size >= SLICE_CHARS:
                yield _slice(rows, parts)
                rows, parts, size = [], [], 0
    if rows:
        yield _slice(rows, parts)


def _slice(rows: list[int], parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = _codes()[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    keep = code > 0
    keep[1:] |= code[:-1] > 32
    ends = np.cumsum(keep)[np.cumsum([len(p) for p in parts]) - 1]
    c = np.where(code == 0, np.uint16(32), code)[keep].astype(np.uint64)
    keys = (c[:-3] << np.uint64(48)) | (c[1:-2] << np.uint64(32)) | (c[2:-1] << np.uint64(16)) | c[3:] if len(c) > 3 else np.zeros(0, dtype=np.uint64)
    # the key at place j ends at character j + 3; a row of k kept characters has k - 3 keys
    begins = np.concatenate([[0], ends[:-1]])
    counts = ends - begins - (ORDER - 1)
    starts = np.cumsum(counts) - counts
    inside = np.repeat(begins - starts, counts) + np.arange(int(counts.sum()))
    return np.array(rows), np.append(starts, counts.sum()), keys[inside]


def discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else 0.75


class CharModels:
    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]], single: list[tuple[np.ndarray, np.ndarray]] | None = None, discounts: np.ndarray | None = None, chars: np.ndarray | None = None):
        """tables: for each language its four-grams and their counts. Of a part of a model: the continuation
        counts of single characters, the discounts by order and language, and which third characters it has."""
        self.langs, self.sharp, self.limits, self.chars = langs, 8.0, np.full(len(langs), np.inf), chars
        levels = [tables]
        for k in range(ORDER - 1, 0, -1):
            mask = np.uint64((1 << (16 * k)) - 1)
            levels.append([np.unique(g & mask, return_counts=True) for g, _ in levels[-1]])
        levels.reverse()
        if single is not None:
            levels[0] = single
        v = len(np.unique(np.concatenate([g for g, _ in levels[0]]))) + 1
        self.keys: list[np.ndarray] = []
        self.p: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.weight: list[np.ndarray] = []
        for k, level in enumerate(levels):
            keys = np.unique(np.concatenate([g for g, _ in level]))
            contexts = np.unique(keys >> np.uint64(16))
            share, weight = np.zeros((len(keys), len(langs))), np.ones((len(contexts), len(langs)))
            for j, (g, n) in enumerate(level):
                if not len(g):
                    continue
                once, twice = int((n == 1).sum()), int((n == 2).sum())
                d = discounts[k][j] if discounts is not None else discount(once, twice)
                at = np.searchsorted(contexts, g >> np.uint64(16))
                total = np.bincount(at, weights=n, minlength=len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                seen = total > 0
                weight[seen, j] = d * kinds[seen] / total[seen]
                share[np.searchsorted(keys, g), j] = np.maximum(n - d, 0) / total[at]
            lower = self._lookup(k - 1, keys & np.uint64((1 << (16 * k)) - 1)) if k else np.full((len(keys), len(langs)), 1 / v)
            self.contexts.append(contexts)
            self.weight.append(weight)
            self.keys.append(keys)
            self.p.append(share + weight[np.searchsorted(contexts, keys >> np.uint64(16))] * lower)
        self.unknown = 1 / v
        self.log = np.ascontiguousarray(np.log(self.p[-1]).T)
        self.p[-1] = np.zeros((0, len(langs)))

    def _lookup(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Probabilities of grams of order k + 1 under each language."""
        if k < 0:
            return np.full((len(grams), len(self.langs)), self.unknown if hasattr(self, "unknown") else 1e-4)
        keys = self.keys[k]
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        hit = keys[at] == grams
        out = np.empty((len(grams), len(self.langs)))
        out[hit] = self.p[k][at[hit]] if len(self.p[k]) else np.exp(self.log[:, at[hit]].T)
        miss = ~hit
        if miss.any():
            g = grams[miss]
            ctx = self.contexts[k]
            c = np.minimum(np.searchsorted(ctx, g >> np.uint64(16)), len(ctx) - 1)
            w = np.where((ctx[c] == g >> np.uint64(16))[:, None], self.weight[k][c], 1.0)
            out[miss] = w * self._lookup(k - 1, g & np.uint64((1 << (16 * k)) - 1))
        return out

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of each text's characters under each language, added up, and how many there are;
        of a part of a model, those of its own."""
        sums, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        keys = self.keys[-1]
        for rows, starts, grams in slices(texts):
            if self.chars is not None:
                own = self.chars[((grams >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
                starts, grams = np.concatenate([[0], np.cumsum(own)])[starts], grams[own]
            size = np.diff(starts)
            full = size > 0
            if not full.any():
                continue
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            miss = np.flatnonzero(keys[at] != grams)
            unseen = np.log(self._lookup(ORDER - 1, grams[miss])) if len(miss) else None
            for j in range(len(self.langs)):
                logs = self.log[j][at]
                if unseen is not None:
                    logs[miss] = unseen[:, j]
                np.add.at(sums[:, j], rows[full], np.add.reduceat(logs, starts[:-1][full]))
            np.add.at(counts, rows, size)
        return sums, counts

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, and its number of characters."""
        sums, counts = self.sums(texts)
        return -sums / np.maximum(counts, 1)[:, None], counts

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, cross-entropies and rejections."""
        h, n = self.entropies(texts)
        best = h.argmin(axis=1)
        rows = np.arange(len(texts))
        score = 1 / np.exp((h[rows, best][:, None] - h) * self.sharp).sum(axis=1)
        none = n == 0
        return [("und" if e else self.langs[b]) for b, e in zip(best, none, strict=True)], np.where(none, 0.0, score), h[rows, best], none | (h[rows, best] > self.limits[best])


def _counter(folds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, fold, text) to (lang, gram, n0, n1, ...), a count for each fold."""
        held: dict[str, dict[int, list[tuple[np.ndarray, np.ndarray]]]] = {}
        for batch in batches:
            frame = pd.DataFrame(dict(zip(("lang", "fold", "text"), (c.to_pylist() for c in batch.columns), strict=True)))
            for (lang, fold), part in frame.groupby(["lang", "fold"]):
                own = held.setdefault(lang, {}).setdefault(fold, [])
                for _, _, keys in slices(part["text"].tolist()):
                    own.append(np.unique(keys, return_counts=True))
                    # merged once what came behind the first is more than it
                    if sum(len(k) for k, _ in own[1:]) > max(1 << 18, len(own[0][0])):
                        own[:] = [merged(own)]
        for lang, by_fold in held.items():
            parts = {fold: merged(own) for fold, own in by_fold.items()}
            keys = np.unique(np.concatenate([g for g, _ in parts.values()]))
            for i in range(0, len(keys), 1 << 16):
                k = keys[i : i + (1 << 16)]
                columns = []
                for fold in range(folds):
                    n = np.zeros(len(k), dtype=np.int64)
                    if fold in parts:
                        g, c = parts[fold]
                        own = slice(np.searchsorted(g, k[0]), np.searchsorted(g, k[-1], "right"))
                        n[np.searchsorted(k, g[own])] = c[own]
                    columns.append(pa.array(n))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), *columns], names=["lang", "gram", *[f"n{f}" for f in range(folds)]])

    return count


class PartedModels:
    """Models in parts, each broadcast on its own."""

    def __init__(self, langs: list[str], parts: list[Broadcast]):
        self.langs, self.parts, self.sharp, self.limits = langs, parts, 8.0, np.full(len(langs), np.inf)


def _level_counts(counts: DataFrame, n: str) -> tuple[dict, dict]:
    """From the four-grams' counts, in the executors: how many of each order and language have the count one, and two, and
    the continuation counts of single characters by language."""
    level = counts.where(f"{n} > 0").select("code", F.col("gram").alias("key"), F.col(n).alias("c"))
    rows = {}
    for k in range(ORDER - 1, -1, -1):
        if k < ORDER - 1:
            level = level.groupBy("code", F.expr(f"key & {(1 << (16 * (k + 1))) - 1}L").alias("key")).agg(F.count("*").alias("c"))
        rows[k] = {r["code"]: (r["once"], r["twice"]) for r in level.groupBy("code").agg(F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).collect()}
    single: dict[int, tuple] = {}
    found = level.toPandas().sort_values("key")  # of single characters: 65,536 a language at most
    for code, part in found.groupby("code"):
        single[int(code)] = (part["key"].to_numpy().astype(np.uint64), part["c"].to_numpy())
    return rows, single


def _parts(counts: DataFrame, langs: list[str], n: str, part_bytes: int) -> dict[int, int]:
    """The part of the model of each third character."""
    third = F.expr("cast(shiftrightunsigned(gram, 16) & 65535L AS int)")
    sizes = counts.where(f"{n} > 0").groupBy(third.alias("c")).agg(F.count("*").alias("rows"), F.countDistinct("gram").alias("grams")).collect()
    # a key and a number a language for each four-gram, as much again for lower orders, and what is read to build them
    weight = {r["c"]: 16 * (1 + len(langs)) * r["grams"] + 20 * r["rows"] for r in sizes}
    part_of: dict[int, int] = {}
    free = 0
    part = -1
    for c in sorted(weight, key=lambda c: (-weight[c], c)):
        if part < 0 or weight[c] > free:
            part, free = part + 1, part_bytes
        part_of[c], free = part, free - weight[c]
    return part_of


def _models(counts: DataFrame, langs: list[str], n: str, part_of: dict[int, int]) -> CharModels | PartedModels:
    """counts: (code, gram, n, ...). Models from the counts in column n, in these parts."""
    spark = counts.sparkSession
    own = counts.where(f"{n} > 0")

    def tables(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        found = rows.select("code", "gram", F.col(n).alias("n")).toArrow()
        code, gram, k = (found.column(c).to_numpy() for c in ("code", "gram", "n"))
        gram, out = gram.view(np.uint64), []
        for j in range(len(langs)):
            mine = np.flatnonzero(code == j)
            mine = mine[np.argsort(gram[mine])]
            out.append((gram[mine], k[mine]))
        return out

    last = max(part_of.values(), default=0)
    if not last:
        return CharModels(langs, tables(own))
    levels, single = _level_counts(counts, n)
    none = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    singles = [single.get(j, none) for j in range(len(langs))]
    discounts = np.array([[discount(*levels[k].get(j, (0, 0))) for j in range(len(langs))] for k in range(ORDER)])
    places = F.broadcast(spark.createDataFrame(list(part_of.items()), "c int, part int"))  # a row a character
    parts = []
    with scope(spark):
        dealt = cut(own.withColumn("c", F.expr("cast(shiftrightunsigned(gram, 16) & 65535L AS int)")).join(places, "c").select("code", "gram", n, "part"), "parts")
        for i in range(last + 1):
            chars = np.full(1 << 16, i == 0)  # characters that no part has are the first one's
            for c, x in part_of.items():
                chars[c] = x == i
            parts.append(spark.sparkContext.broadcast(CharModels(langs, tables(dealt.where(F.col("part") == i)), singles, discounts, chars)))
    return PartedModels(langs, parts)


def fit(train: DataFrame, key: str, text: str, lang: str, folds: int = FOLDS, part_bytes: int = PART_BYTES) -> CharModels | PartedModels | None:
    """train: the labelled documents. None if there is nothing to learn."""
    spark = train.sparkSession
    ship(spark)
    fold = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("fold")), F.lit(folds)).cast("int")
    rows = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), fold.alias("fold"), F.col(text).alias("text"))
    own = [f"n{i}" for i in range(folds)]
    counted = rows.mapInArrow(tidy(_counter(folds)), "lang string, gram long, " + ", ".join(f"{c} long" for c in own))
    counts = cut(counted.groupBy("lang", "gram").agg(*[F.sum(c).alias(c) for c in own]), "grams").withColumn("n", F.expr(" + ".join(own)))
    seen = {r["lang"]: [r[c] for c in own] for r in counts.groupBy("lang").agg(*[F.sum(c).alias(c) for c in own]).collect()}
    langs = sorted(seen)
    if not langs:
        return None
    codes = spark.createDataFrame(list(enumerate(langs)), "code int, l string")
    counts = counts.join(F.broadcast(codes), F.col("lang") == F.col("l")).select("code", "gram", "n", *own)
    part_of = _parts(counts, langs, "n", part_bytes)
    judged = []
    for i, c in enumerate(own):
        # languages of which both this part and the others have something
        known = [x for x in langs if 0 < seen[x][i] < sum(seen[x])]
        if known:
            rest = counts.withColumn("rest", F.col("n") - F.col(c))
            # what fits one part with all documents does so with fewer
            others = _models(rest, langs, "rest", _parts(rest, langs, "rest", part_bytes) if max(part_of.values()) else part_of)
            judged.append(_calibrated(rows.where((F.col("fold") == i) & F.col("lang").isin(known)), others, SHARPS))
    model = _models(counts, langs, "n", part_of)
    if judged:
        model.sharp, model.limits = _chosen(reduce(DataFrame.union, judged), langs, SHARPS)
    return model


def _parts_sums(docs: DataFrame, model: PartedModels, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep`` of each document with ``h``, its cross-entropies by language, and ``n``, its characters.

    Documents alike in these columns and text meet in one group; that leaves sums by character as they are, and
    they are dealt out again as often as there are of them."""
    rows = docs.withColumn("_h", F.md5(text)).select("_h", *keep, text)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select("_h", *keep).dtypes)
    every = None
    for i, part in enumerate(model.parts):

        def add(batches: Iterator[pa.RecordBatch], part: Broadcast = part, first: bool = i == 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums, n = part.value.sums(batch.column(batch.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(sums), pa.list_(pa.float64())), pa.array(n), pa.array([int(first)] * len(n), pa.int32())], names=["_h", *keep, "s", "n", "times"])

        own = rows.mapInArrow(tidy(add), f"{kinds}, s array<double>, n double, times int")
        every = own if every is None else every.union(own)
    sums = [F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(len(model.langs))]
    g = every.groupBy("_h", *keep).agg(F.sum("n").alias("n"), F.sum("times").alias("times"), *sums)
    h = F.array(*[-F.col(f"s{j}") / F.greatest("n", F.lit(1.0)) for j in range(len(model.langs))])
    return g.select(*keep, "n", h.alias("h"), F.explode(F.expr("sequence(1L, times)"))).drop("col")


def _calibrated(apart: DataFrame, model: CharModels | PartedModels, sharps: tuple[int, ...]) -> DataFrame:
    """(lang, mine, loss0, loss1, ...): each document's cross-entropy under its own language, and what it loses by each
    sharpness. The model hasn't counted these documents."""
    spark, docs = apart.sparkSession, apart.select("lang", "text")
    shared = model.parts if isinstance(model, PartedModels) else [spark.sparkContext.broadcast(model)]

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = shared[0].value.entropies(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(h), pa.list_(pa.float64())), pa.array(n)], names=["lang", "h", "n"])

    def build() -> DataFrame:
        if isinstance(model, PartedModels):
            seen = _parts_sums(cut(docs, "apart"), model, ["lang"], "text")
        else:
            seen = docs.mapInArrow(tidy(entropies), "lang string, h array<double>, n double")
        at = F.array_position(F.array(*[F.lit(x) for x in model.langs]), F.col("lang")).cast("int")
        seen = seen.where("n > 0").select("lang", F.element_at("h", at).alias("mine"), "h")
        loss = [F.expr(f"ln(aggregate(h, 0D, (s, x) -> s + exp(greatest(-50D, least(50D, (mine - x) * {s}D)))))") for s in sharps]
        return seen.select("lang", "mine", *[x.alias(f"loss{i}") for i, x in enumerate(loss)])

    out = settled(spark, "calibration", build)
    for b in shared:
        b.destroy()
    return out


def _chosen(judged: DataFrame, langs: list[str], sharps: tuple[int, ...]) -> tuple[float, np.ndarray]:
    """The sharpness of the least loss, and limits from two ranks of each language's cross-entropies."""
    limits = np.full(len(langs), np.inf)
    sums = judged.groupBy("lang").agg(F.count("*").alias("docs"), *[F.sum(f"loss{i}").alias(f"loss{i}") for i in range(len(sharps))]).orderBy("lang").collect()
    if not sums:
        return 8.0, limits
    loss = {s: sum(r[f"loss{i}"] for r in sums) for i, s in enumerate(sharps)}
    ranks = {r["lang"]: (int(0.99 * (r["docs"] - 1)), r["docs"] // 2) for r in sums if r["docs"] >= 20}
    if ranks:
        wanted = F.broadcast(judged.sparkSession.createDataFrame([(x, k) for x, both in ranks.items() for k in sorted(set(both))], "l string, k long"))  # two rows a language
        placed = with_ordinals(judged.select("lang", "mine"), ["mine"], ["lang"])
        found = {(r["lang"], r["k"]): r["mine"] for r in placed.join(wanted, (F.col("lang") == F.col("l")) & (F.col("ordinal") == F.col("k"))).collect()}
        for x, (high, middle) in ranks.items():
            # beyond the 99th of a hundred by half the way from the median to it
            limits[langs.index(x)] = found[x, high] + 0.5 * (found[x, high] - found[x, middle])
    return float(min(loss, key=lambda s: (loss[s], s))), limits


def identify_languages(docs: DataFrame, model: CharModels | PartedModels | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, lang_pred, score (0 to 1), cross_entropy (nats per character) and
    rejected."""
    if model is None:
        return docs.select(F.col(key).alias(key), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(True).alias("rejected"))
    ship(docs.sparkSession)
    if isinstance(model, PartedModels):
        d = _parts_sums(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), model, ["key"], "text")
        lowest = d.withColumn("low", F.array_min("h")).withColumn("at", F.expr("cast(array_position(h, array_min(h)) AS int)"))
        names = F.array(*[F.lit(x) for x in model.langs])
        limits = F.array(*[F.lit(float(x)) for x in model.limits])
        score = F.expr(f"1 / aggregate(h, 0D, (s, x) -> s + exp((low - x) * {float(model.sharp)}D))")
        none = F.col("n") == 0
        return lowest.select(
            F.col("key").alias(key), F.when(none, "und").otherwise(F.element_at(names, F.col("at"))).alias("lang_pred"), F.when(none, 0.0).otherwise(score).alias("score"),
            F.when(none, 0.0).otherwise(F.col("low")).alias("cross_entropy"), (none | (F.col("low") > F.element_at(limits, F.col("at")))).alias("rejected"),
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        lang, score, h, rejected = shared.value.judge(texts.tolist())
        give_back()
        return pd.DataFrame({"lang_pred": lang, "score": score, "cross_entropy": h, "rejected": rejected})

    return docs.select(F.col(key).alias(key), judge(F.col(text)).alias("j")).select(key, "j.*")
