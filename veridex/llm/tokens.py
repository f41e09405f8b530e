"""Token counts by overlap resynchronisation.

A text longer than a chunk and its overlap is encoded in overlapping chunks, each by the library and with
the offsets of its tokens. Two neighbouring encodings are spliced at an offset in their overlap at which a
token begins in both and which is provably a boundary of the whole text's encoding. Where the overlap has
none, it is doubled and both chunks are encoded again, up to the whole rest of the text.

Texts of one chunk need no splice. They are cut at white space, at which the pattern cuts as well, and each
piece's count is the library's for it. A corpus repeats its pieces far more often than it brings new ones,
so a worker keeps them, up to a bound in bytes. Texts that hold a special string are encoded whole.

Why a boundary is stable: no stretch that the byte-level pattern keeps whole holds a letter followed by
something else than a letter. So the place between a letter and a blank, digit or sign ends a stretch in
every encoding that sees both characters, and what follows is matched by what stands to its right alone.
Special strings are found before the pattern applies; a place inside one is no token's beginning in an
encoding that sees all of it, so places nearer to a chunk's edge than the longest of them aren't used.

Defined results: a null text counts as empty, with no tokens. Repeated rows are counted one by one.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm.common import ship

#: Letters, and what else may follow one, of which Python and the library are of one mind in every version:
#: Latin, kana, Chinese and Hangul; blanks, digits and signs of ASCII and of Chinese.
STABLE = re.compile(r"(?<=[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xffぁ-ゖァ-ヺ一-龥가-힣])[\t-\r -@\[-`{-~、。！，：；？]")
#: What a worker's memory of pieces or words may take, by the estimate below. When full, it starts anew.
KEPT_BYTES = 128 << 20
#: Places of the door, a bit of memory that lets in only what has come up before.
DOOR = 1 << 22
#: Longer ones are encoded whenever they are met.
KEPT_CHARS = 64
#: Measured: at most what a kept one takes besides its characters, and for each of them, its ids included.
ENTRY_BYTES, CHAR_BYTES = 300, 4
#: Unicode's white space, as the tokenizers' patterns have it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Latin letters: their case, composition and class are the same to Python and the library.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: A word of Latin letters, with a blank before it or one sign behind: the sign is a stretch of its own.
PLAIN = re.compile(f"( ?[{LETTERS}]+)([,.;:!?]?)")
#: The byte-level alphabet writes bytes that aren't printable as the characters from 256 on.
_BYTES = dict(zip([*range(33), *range(127, 161), 173], range(256, 324), strict=True))
#: Texts whose pieces are counted at once.
BATCH = 64


def pretoken(text: str) -> str:
    """A stretch that the pattern keeps whole, in the byte-level alphabet that the model reads."""
    return text.encode().decode("latin-1").translate(_BYTES)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def specials(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(x["content"] for x in json.load(f)["added_tokens"])


class Door:
    """Most words of a corpus occur once and needn't be kept: a word is let in when it knocks again. Told apart by a
    hash, so some are let in at once; no word's tokens depend on it."""

    def __init__(self):
        self.knocked, self.n = np.zeros(DOOR, dtype=bool), 0

    def split(self, words: list[str]) -> tuple[list[str], list[str]]:
        """Words to keep, and those that come for the first time."""
        if not words:
            return [], []
        at = (pd.util.hash_array(np.array(words, dtype=object), categorize=False) & np.uint64(DOOR - 1)).astype(np.int64)
        again = self.knocked[at]
        self.knocked[at] = True
        self.n += len(words) - int(again.sum())
        if self.n > DOOR // 3:
            self.__init__()
        return [w for w, a in zip(words, again.tolist(), strict=True) if a], [w for w, a in zip(words, again.tolist(), strict=True) if not a]


@lru_cache(maxsize=4)
def marked(path: str, sign: str, at_end: bool) -> np.ndarray:
    """By id: whether the token ends, or begins, with the sign."""
    vocab = tokenizer(path).get_vocab()
    out = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
    out[[i for t, i in vocab.items() if (t.endswith(sign) if at_end else t.startswith(sign))]] = True
    return out


class Encoded:
    """The encoding of ``text[begin:end]``. The library is asked for the few places in an overlap alone: a list of
    all offsets, with what is made of it, takes a fifth of the time that encoding does."""

    def __init__(self, tok, text: str, begin: int, end: int):
        self.e = tok.encode(text[begin:end], add_special_tokens=False)
        self.n, self.begin, self.end = len(self.e), begin, end

    def token(self, place: int) -> int | None:
        """The token that begins at a place: so many stand before."""
        k = self.e.char_to_token(place - self.begin)
        return k if k is not None and self.e.token_to_chars(k)[0] == place - self.begin else None

    def upto(self, place: int) -> int:
        """Tokens before a place at which one begins."""
        return self.token(place) if place > self.begin else 0


class TokenCounts:
    def __init__(self, path: str, chunk: int = 4096, overlap: int = 256, kept_bytes: int = KEPT_BYTES):
        self.tok, self.specials, self.chunk, self.overlap, self.kept_bytes = tokenizer(path), specials(path), chunk, overlap, kept_bytes
        self.edge, self.first = max(map(len, self.specials), default=0), marked(path, pretoken(" "), at_end=False)
        self.n: dict[str, int] = {}
        self.held, self.door = 0, Door()

    def learn(self, found: set[str]) -> list[str]:
        """Puts the counts of all these pieces into ``n``, and returns those that are to be forgotten again."""
        new = [p for p in found if p not in self.n]
        kept, once = self.door.split([p for p in new if len(p) <= KEPT_CHARS])
        more = sum(map(len, kept)) * CHAR_BYTES + len(kept) * ENTRY_BYTES
        if self.held + more > self.kept_bytes:
            self.n, self.held = {}, 0
            return self._count(list(found))
        self.held += more
        self._count(kept)
        return self._count([*once, *(p for p in new if len(p) > KEPT_CHARS)])

    def _count(self, new: list[str]) -> list[str]:
        """Adds the pieces, and stems and signs that they are made of; returns all that is added."""
        n, plain, other, stems, signed = self.n, PLAIN.fullmatch, [], {}, []
        signs: dict[str, int] = {}
        for p in new:
            m = plain(p)
            if m is None:
                other.append(p)
                continue
            stem, sign = m.groups()
            if stem not in n:
                if stem[0] == " ":
                    stems[stem] = None
                else:
                    other.append(stem)
            if sign:
                if sign not in n:
                    signs[sign] = len(self.tok.model.tokenize(sign))
                signed.append((p, stem, sign))
        added = {**dict(self._stems(list(stems))), **dict(self._whole(other)), **signs}
        n.update(added)
        more = {p: n[stem] + n[sign] for p, stem, sign in signed}
        n.update(more)
        return [*added, *more]

    def _stems(self, stems: list[str]) -> list[tuple[str, int]]:
        """Letters behind a blank: each is one stretch, and only its first token begins with the blank."""
        out = []
        for i in range(0, len(stems), 2048):
            part = stems[i : i + 2048]
            (e,) = self.tok.encode_batch_fast(["".join(part)], add_special_tokens=False)
            firsts = np.flatnonzero(self.first[np.array(e.ids, dtype=np.int64)])
            if len(firsts) == len(part):
                out += zip(part, np.diff(firsts, append=len(e)).tolist(), strict=True)
            else:
                out += ((x, len(self.tok.model.tokenize(pretoken(x)))) for x in part)
        return out

    def _whole(self, pieces: list[str]) -> list[tuple[str, int]]:
        out = []
        for i in range(0, len(pieces), 4096):
            part = pieces[i : i + 4096]
            out += zip(part, map(len, self.tok.encode_batch_fast(part, add_special_tokens=False)), strict=True)
        return out

    def splice(self, text: str, left: Encoded, right: Encoded, after: int) -> int | None:
        """The stable place behind ``after`` at which a token begins in both, nearest to the overlap's middle."""
        low, high = max(right.begin + self.edge, after + 1), left.end - self.edge
        if low >= high:
            return None
        stable = sorted((m.start() for m in STABLE.finditer(text, low, high)), key=lambda p: abs(2 * p - low - high))
        return next((p for p in stable if left.token(p) is not None and right.token(p) is not None), None)

    def spliced(self, text: str) -> int:
        """Tokens of a long text."""
        n, total, last = len(text), 0, 0
        left = Encoded(self.tok, text, 0, min(n, self.chunk + self.overlap))
        while left.end < n:
            wide, place = self.overlap, None
            while place is None and left.end < n:
                begin = max(last, left.end - wide)
                right = Encoded(self.tok, text, begin, min(n, begin + self.chunk + wide))
                place = self.splice(text, left, right, last)
                if place is None:
                    wide *= 2
                    left = Encoded(self.tok, text, left.begin, min(n, left.end + wide))
            if place is None:
                break
            total += left.upto(place) - left.upto(last)
            last, left = place, right
        return total + left.n - left.upto(last)

    def counts(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        for i in range(0, len(texts), BATCH):
            split = {}
            for k in range(i, min(i + BATCH, len(texts))):
                t = texts[k]
                if not t:
                    continue
                if len(t) > self.chunk + self.overlap:
                    out[k] = self.spliced(t)
                elif any(s in t for s in self.specials):
                    out[k] = len(self.tok.encode(t, add_special_tokens=False))
                else:
                    split[k] = PIECE.findall(t)
            seen: set[str] = set()
            for p in split.values():
                seen.update(p)
            gone = self.learn(seen)
            n = self.n
            for k, p in split.items():
                out[k] = sum(map(n.__getitem__, p))
            for x in gone:
                del n[x]
        return out


@lru_cache(maxsize=4)
def _counter(path: str, chunk: int, overlap: int) -> TokenCounts:
    return TokenCounts(path, chunk, overlap)


def token_counts(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = 1024, chunk: int = 4096, overlap: int = 256) -> DataFrame:
    """One row per document: key, n_bytes (of UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(_counter(tokenizer_path, chunk, overlap).counts(texts.tolist()))

    whole = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(F.col(key).alias(key), F.octet_length(whole).cast("long").alias("n_bytes"), count(whole).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
