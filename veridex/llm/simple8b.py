"""Simple-8b: unsigned integers packed into 64-bit words, in blocks that decode on their own.

The upper four bits of a word select how many values share its other 60 bits, evenly, the first value
lowest. Selector 0 is the escape: its payload is an index into the block's raw words, for values of more
than 60 bits. A block holds up to ``BLOCK`` values and is laid out as: number of words, words, raw words.

An image is a run of documents: header, keys, validity of keys, lengths, the blocks' word offsets, and
the blocks of all the documents' values without a break. All numbers are little-endian.
"""

from __future__ import annotations

import struct

import numpy as np

#: Values in a word and bits of each, by selector. 0 is the escape, 1 a run of zeros.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1 << 16
MAGIC = b"VXS8\x01\x00\x00\x00"
_HEAD = struct.Struct("<8sQQQ")  # magic, documents, values, blocks


_SHORT = np.array([i.bit_length() for i in range(256)], dtype=np.int8)


def _lengths(v: np.ndarray) -> np.ndarray:
    """Bits that each value needs, byte by byte from the lowest."""
    out = _SHORT[v & np.uint64(255)]
    for k in range(1, 8):
        high = v >> np.uint64(8 * k)
        if not high.any():
            break
        out = np.where(high > 0, _SHORT[high & np.uint64(255)] + np.int8(8 * k), out)
    return out


def _runs(ok: np.ndarray, count: int) -> np.ndarray:
    """Where ``count`` values on end fit, by doubling."""
    have = 1
    while have < count:
        more = min(have, count - have)
        ok, have = ok[: len(ok) - more] & ok[more:], have + more
    return ok


def encode_block(values: np.ndarray) -> np.ndarray:
    v = np.ascontiguousarray(values, dtype=np.uint64)
    n, bits = len(v), _lengths(v)
    raw = v[bits > 60]
    step = np.ones(n, dtype=np.int8)
    selector = np.where(bits > 60, 0, 15).astype(np.int8)
    for s in range(14, 0, -1):  # from few wide values to many narrow ones
        if COUNTS[s] > n:
            break
        fit = _runs(bits <= BITS[s], int(COUNTS[s]))
        if not fit.any():
            break  # nor do more and narrower ones fit anywhere
        np.copyto(selector[: len(fit)], s, where=fit)
        np.copyto(step[: len(fit)], COUNTS[s], where=fit)
    steps, at, chosen = step.tolist(), 0, []
    while at < n:
        chosen.append(at)
        at += steps[at]
    starts = np.array(chosen, dtype=np.int64)
    sel = selector[starts]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        mine = np.flatnonzero(sel == s)
        if s == 0:
            words[mine] |= np.arange(len(mine), dtype=np.uint64)
        elif s > 1:
            first = starts[mine]
            packed = v[first]
            for j in range(1, COUNTS[s]):
                packed |= v[first + j] << np.uint64(j * BITS[s])
            words[mine] |= packed
    return np.concatenate([np.array([len(words)], dtype=np.uint64), words, raw])


def decode_block(block: np.ndarray) -> np.ndarray:
    k = int(block[0])
    words, raw = block[1 : k + 1], block[k + 1 :]
    sel = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[sel])
    out = np.zeros(int(ends[-1]) if k else 0, dtype=np.uint64)
    starts = ends - COUNTS[sel]
    for s in np.unique(sel):
        mine = sel == s
        w, first = words[mine], starts[mine]
        if s == 0:
            out[first] = raw[(w & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif s > 1:
            mask = np.uint64((1 << int(BITS[s])) - 1)
            for j in range(COUNTS[s]):
                out[first + j] = (w >> np.uint64(j * BITS[s])) & mask
    return out


def pack(keys: list[int | None], lengths: np.ndarray, values: np.ndarray) -> bytes:
    blocks = [encode_block(values[i : i + BLOCK]) for i in range(0, len(values), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    parts = [
        _HEAD.pack(MAGIC, len(keys), len(values), len(blocks)),
        np.array([k or 0 for k in keys], dtype="<i8").tobytes(),
        np.array([k is not None for k in keys], dtype="u1").tobytes(),
        np.asarray(lengths, dtype="<u8").tobytes(),
        offsets.tobytes(),
        *(b.astype("<u8").tobytes() for b in blocks),
    ]
    return b"".join(parts)


def unpack(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    magic, docs, values, blocks = _HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b image")
    at = _HEAD.size
    ids = np.frombuffer(image, "<i8", docs, at)
    valid = np.frombuffer(image, "u1", docs, at + 8 * docs)
    lengths = np.frombuffer(image, "<u8", docs, at + 9 * docs)
    offsets = np.frombuffer(image, "<u8", blocks + 1, at + 17 * docs).astype(np.int64)
    body = np.frombuffer(image, "<u8", int(offsets[-1]), at + 17 * docs + 8 * (blocks + 1))
    found = [decode_block(body[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    out = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
    if len(out) != values:
        raise ValueError("the image is damaged")
    return [int(k) if ok else None for k, ok in zip(ids, valid, strict=True)], lengths.astype(np.int64), out
