"""Array kernels over whole Arrow batches: byte buffers, rolling hashes, words, XXH64.

Everything here works on the concatenated bytes of many texts at once, so no per-row or per-character Python runs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Upper bound on the bytes of text that one step of a kernel holds in wide (8-byte) form; memory only, never results.
STEP_BYTES = 2 << 20


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, starts, lengths)`` of a string or binary column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    buf = buf[off[0] : off[-1]]
    starts, lens = off[:-1] - off[0], np.diff(off)
    if column.null_count:
        lens = np.where(pc.is_valid(column).to_numpy(zero_copy_only=False), lens, 0)
    return buf, starts, lens


def steps(starts: np.ndarray, lens: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges ``[i, j)`` of about ``limit`` bytes each; a longer text stands alone and whole."""
    i, n = 0, len(starts)
    ends = starts + lens
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, side="right")))
        yield i, min(j, n)
        i = min(j, n)


def gather_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = 24 << 20) -> Iterator[pa.Table]:
    """Join small batches until ``column`` holds about ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.column(b.schema.get_field_index(column)).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Tables of about ``limit`` bytes of ``column`` (whole rows); small batches are joined, large ones cut."""
    for t in gather_batches(batches, column, limit):
        _, starts, lens = text_buffer(t.column(column))
        for i, j in steps(starts, lens, limit):
            yield t.slice(i, j - i).combine_chunks() if j - i < len(t) else t


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, handing freed memory back to the system when a task ends, for idle workers stay alive."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
            if trim:
                trim(0)

    return lean_run


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BASE = 0x9E3779B97F4A7C15 | 1


def _power(e: int) -> np.uint64:
    return U64(pow(_BASE, e, 1 << 64))


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit polynomial hash of every ``k``-byte string of ``buf``, by doubling."""
    if len(buf) < k:
        return np.zeros(0, np.uint64)
    level, m = buf.astype(np.uint64) + U64(1), 1
    acc, size, bits = None, 0, k
    while bits:
        if bits & 1:
            if acc is None:
                acc, size = level, m
            else:
                n = len(level) - size
                acc = acc[:n] * _power(m) + level[size : size + n]
                size += m
        bits >>= 1
        if bits:
            level = level[:-m] * _power(m) + level[m:]
            m *= 2
    return mix64(acc[: len(buf) - k + 1])


def sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over every window of ``width`` values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    m = 1
    while m * 2 <= width:
        values = op(values[:-m], values[m:])
        m *= 2
    return op(values[:n], values[width - m : width - m + n]) if m < width else values[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def normal_words(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case A-Z and keep ``[^\\x20\\x09-\\x0D]+`` words, each followed by one space.

    Returns ``(bytes, word starts, word lengths, words per text)``; a run of words of one text is a slice of ``bytes``.
    """
    keep = ~_SPACE[buf]
    first, last = keep.copy(), keep.copy()
    inside = np.zeros(len(buf), bool)
    for s, n in ((starts, lens),):  # bytes between texts (of nulls) belong to none
        edge = np.zeros(len(buf) + 1, np.int32)
        np.add.at(edge, s[n > 0], 1)
        np.add.at(edge, (s + n)[n > 0], -1)
        inside = np.cumsum(edge[:-1]) > 0
    keep &= inside
    head, tail = np.zeros(len(buf) + 1, bool), np.zeros(len(buf) + 1, bool)
    head[starts[lens > 0]] = True
    tail[(starts + lens)[lens > 0]] = True
    first = keep.copy()
    first[1:] &= ~keep[:-1] | head[1:-1]
    last = keep.copy()
    last[:-1] &= ~keep[1:] | tail[1:-1]
    ws, we = np.flatnonzero(first), np.flatnonzero(last) + 1
    wl = we - ws
    owner = np.searchsorted(starts, ws, side="right") - 1
    # texts of no bytes share their start with the next one; searchsorted gives the last, which owns the word
    counts = np.bincount(owner, minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)
    out = np.full(int(wl.sum()) + len(ws), 0x20, np.uint8)
    pos = np.cumsum(wl + 1) - (wl + 1)
    where = np.flatnonzero(keep)
    out[where - np.repeat(ws - pos, wl)] = _LOWER[buf[where]]
    return out, pos, wl, counts


_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def xxh64_slices(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``buf[s:s+n]`` for every slice, one pass over each distinct length."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    v64 = np.ndarray((len(pad) - 7,), "<u8", pad, 0, (1,))
    v32 = np.ndarray((len(pad) - 3,), "<u4", pad, 0, (1,))
    seed64 = U64(seed)
    order = np.argsort(lens.astype(np.uint16) if lens.max() < 65536 else lens, kind="stable")
    sl = lens[order]
    cuts = np.flatnonzero(np.concatenate([[True], sl[1:] != sl[:-1]]))
    with np.errstate(over="ignore"):
        for c, e in zip(cuts, [*cuts[1:], len(sl)]):
            n, rows = int(sl[c]), order[c:e]
            p = starts[rows]
            at = 0
            if n >= 32:
                a = [np.full(len(p), seed64 + x, np.uint64) for x in (_P1 + _P2, _P2, U64(0), U64(0) - _P1)]
                while at + 32 <= n:
                    for i in range(4):
                        a[i] = _rot(a[i] + v64[p + (at + 8 * i)] * _P2, 31) * _P1
                    at += 32
                h = _rot(a[0], 1) + _rot(a[1], 7) + _rot(a[2], 12) + _rot(a[3], 18)
                for x in a:
                    h = (h ^ (_rot(x * _P2, 31) * _P1)) * _P1 + _P4
            else:
                h = np.full(len(p), seed64 + _P5, np.uint64)
            h += U64(n)
            while at + 8 <= n:
                h = _rot(h ^ (_rot(v64[p + at] * _P2, 31) * _P1), 27) * _P1 + _P4
                at += 8
            if at + 4 <= n:
                h = _rot(h ^ (v32[p + at].astype(np.uint64) * _P1), 23) * _P2 + _P3
                at += 4
            while at < n:
                h = _rot(h ^ (pad[p + at].astype(np.uint64) * _P5), 11) * _P1
                at += 1
            h = (h ^ (h >> U64(33))) * _P2
            h = (h ^ (h >> U64(29))) * _P3
            out[rows] = h ^ (h >> U64(32))
    return out


def bit_majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per run of ``counts`` hashes: the bits set in over half of them; zero for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts > 0)
    ends = np.cumsum(counts)
    begin = (ends - counts)[full]
    done = 0
    while done < len(full):  # about a million hashes at a time; a longer text is summed in parts
        stop = max(done + 1, int(np.searchsorted(ends[full], begin[done] + (1 << 18), side="right")))
        lo, hi = int(begin[done]), int(ends[full[stop - 1]])
        total = np.zeros((stop - done, 64), np.int64)
        for a in range(lo, hi, 1 << 19):
            b = min(hi, a + (1 << 19))
            bits = np.unpackbits(hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            rel = np.maximum(begin[done:stop] - a, 0)
            live = (begin[done:stop] < b) & (ends[full[done:stop]] > a)
            total[live] += np.add.reduceat(bits, rel[live], axis=0, dtype=np.int32)
        major = (total * 2 > counts[full[done:stop], None]).astype(np.uint8)
        out[full[done:stop]] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
        done = stop
    return out


_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 letters, digits and bytes of multi-byte characters, 2 signs
_KIND[_SPACE] = 0
_KIND[0x80:] = 1
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _geometric(ratio: int, n: int) -> np.ndarray:
    """``ratio ** i`` mod 2**64 for i < n."""
    out = np.ones(max(n, 1), np.uint64)
    m = 1
    while m < n:
        k = min(m, n - m)
        out[m : m + k] = out[:k] * U64(pow(ratio, m, 1 << 64))
        m *= 2
    return out[:n]


def token_hashes(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens (maximal runs of one kind of byte, white space dropped) and tokens per text."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    kind = _KIND[buf]
    begins = np.ones(n, bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[starts[(lens > 0)]] = True
    ts = np.flatnonzero(begins)
    te = np.append(ts[1:], n)
    real = kind[ts] > 0
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + U64(1)) * _geometric(_BASE, n), out=prefix[1:])
    ts, te = ts[real], te[real]
    h = mix64((prefix[te] - prefix[ts]) * _geometric(_INVERSE, n)[ts])
    owner = np.searchsorted(starts, ts, side="right") - 1
    return h, np.bincount(owner, minlength=len(starts))


def ngram_features(tokens: np.ndarray, counts: np.ndarray, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, bucket)`` of every token n-gram of the given orders; none crosses a text.

    A token that repeats the one before it counts, in n-grams of two and more, as a back-reference, so runs of any
    one word look alike.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    rows, cols = [], []
    for n in orders:
        if len(tokens) < n:
            continue
        if n == 2:
            again = np.concatenate([[False], (tokens[1:] == tokens[:-1]) & (owner[1:] == owner[:-1])])
            tokens = np.where(again, U64(1), tokens)
        h = np.where(tokens[1 : len(tokens) - n + 2] == U64(1), U64(1), tokens[: len(tokens) - n + 1]) if n > 1 else tokens.copy()
        for k in range(1, n):
            h = h * U64(0xD6E8FEB86659FD93) + tokens[k : len(tokens) - n + 1 + k]
        ok = owner[: len(h)] == owner[n - 1 :]
        rows.append(owner[: len(h)][ok])
        cols.append((mix64(h + U64(n)) >> U64(64 - bits))[ok].astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)


def unit_counts(rows: np.ndarray, cols: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(row, bucket)`` pairs with counts scaled to a unit vector per row."""
    key, count = np.unique(rows << bits | cols, return_counts=True)
    r, c = key >> bits, key & ((1 << bits) - 1)
    v = count.astype(np.float64)
    norm = np.sqrt(np.bincount(r, v * v, minlength=n))
    return r, c, v / norm[r]
