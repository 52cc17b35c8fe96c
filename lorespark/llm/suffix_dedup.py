"""Suffix-array dedup: bytes covered by a long string that also starts in an earlier document are removed.

Documents are ranked by doc_id and matches never cross them. The longest previous factor (LPF) of a suffix is the longest
string it shares with a suffix of an earlier document; in suffix order the only candidates are the nearest suffixes
before and after it that belong to an earlier document (previous and next smaller positions), and it is the larger of the
prefixes shared with them. Wherever it reaches ``length`` bytes, they are removed; the first copy stays.

One suffix array over everything would need every suffix in one order. Only suffixes with equal first ``length`` bytes
have to meet, and those share their least k-gram (by hash) within these bytes, the anchor. So:

1. Anchors of every document are found in one pass (about one position in sixteen) and counted by hash; only anchors
   that occur in at least two documents go on. Task by task, an anchor that several documents share is settled on the
   spot, so a hot anchor sends one record per task. Anchors that repeat at one distance (runs of a character or of a
   short pattern) are one record, however long the run.
2. Around each shared anchor lies a context of all strings of ``length`` bytes that hold it. A context equal to one of
   an earlier document has the whole context as a common prefix, so a task settles its own equal contexts at once; equal
   contexts of one document that follow each other closely are one record. The others are routed by anchor; in a task,
   the suffixes that start at one offset before one anchor are sorted, prefixes shared by neighbours are counted, and
   previous and next smaller documents give the LPF of each.
3. An anchor with more than ``HOT`` occurrences isn't routed as a whole: each string of ``length`` bytes that holds it is
   routed by its own hash, after the strings of one task have been settled among themselves, so that a hot anchor is
   spread by what surrounds it and a hot string sends one record per task. At most ``HOT_KEYS`` anchors, the most
   frequent, are treated so; any other has less than one ``HOT_KEYS``-th of all occurrences.
4. Intervals are gathered by document and applied to the whole text.

Hashes only choose what is compared; every removed byte was compared as bytes.

Defined cases: a null or empty text has no bytes and nothing removed; a null doc_id is no source and keeps its text;
rows with one doc_id are no sources for each other; texts shorter than ``length`` stay whole; an empty table gives an
empty result. ``dedup_texts`` keeps all other columns, whatever their names; where a removed run cuts a multi-byte
character, its remaining bytes go as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.llm import kernels
from lorespark.session import materialise, spread

LENGTH = 50
GRAM = 20
LEFT = LENGTH - GRAM  # bytes before an anchor that its strings can reach, and after it
CONTEXT = 2 * LEFT + GRAM
#: Occurrences beyond which an anchor's strings are routed one by one, and how many anchors at most.
HOT, HOT_KEYS = 1 << 16, 1 << 16
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
U64 = kernels.U64


# -- bytes of integer columns, as few as the largest needs ----------------------------------------------------------


def pack_columns(*columns: np.ndarray) -> bytes:
    """Non-negative integer columns of one length as byte planes."""
    parts = [np.array([len(columns[0])], "<u8").tobytes()]
    for c in columns:
        c = c.astype("<u8")
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        parts.append(bytes([width]))
        parts.append(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return b"".join(parts)


def unpack_columns(data: bytes | memoryview, n_columns: int) -> tuple[list[np.ndarray], int]:
    """The columns and the bytes they took."""
    n, at, out = int(np.frombuffer(data, "<u8", 1)[0]), 8, []
    for _ in range(n_columns):
        width = data[at]
        c = np.zeros((n, 8), np.uint8)
        c[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 1).reshape(width, n).T
        out.append(c.view("<u8").ravel())
        at += 1 + n * width
    return out, at


def delta(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, small in either direction (zigzag)."""
    d = np.diff(values.astype(np.int64), prepend=np.int64(0))
    return ((d << 1) ^ (d >> 63)).view(np.uint64)


def undelta(coded: np.ndarray) -> np.ndarray:
    d = (coded >> U64(1)).view(np.int64) ^ -(coded & U64(1)).view(np.int64)
    return np.cumsum(d)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


# -- step 1: anchors ------------------------------------------------------------------------------------------------


def _stretches(h: np.ndarray, owner: np.ndarray, pos: np.ndarray, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors stay when stretches of equal ones at one distance become one, and for each its distance << 26 | count.

    A single anchor has 0. Stretches of fewer than ``least`` stay single.
    """
    n = len(h)
    link, gap = np.zeros(n, bool), np.zeros(n, np.int64)
    gap[1:] = np.diff(pos)
    link[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1]) & (gap[1:] < 64)
    if not link.any():
        return np.arange(n), np.zeros(n, np.int64)
    head = ~link
    head[1:] |= link[1:] & link[:-1] & (gap[1:] != gap[:-1])
    at = np.flatnonzero(head)
    head |= np.repeat(np.diff(np.append(at, n)) < least, np.diff(np.append(at, n)))
    at = np.flatnonzero(head)
    count = np.diff(np.append(at, n))
    return at, np.where(count > 1, gap[np.minimum(at + 1, n - 1)] << 26 | count, 0)


def anchors(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, chunk: int = kernels.STEP_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, text, position, stretch)`` of the grams that are least in some string of ``LENGTH`` bytes."""
    width = LEFT + 1
    found = []
    for a in range(0, len(buf), chunk):
        lo, hi = max(0, a - LENGTH), min(len(buf), a + chunk + LENGTH)
        h = kernels.gram_hashes(buf[lo:hi], GRAM)
        least = kernels.sliding(h, width, np.minimum)
        if not len(least):
            continue
        edge = np.zeros(width - 1, np.uint64)
        best = kernels.sliding(np.concatenate([edge, least, edge]), width, np.maximum)
        at = np.flatnonzero(best == h)
        at = at[(at + lo >= a) & (at + lo < a + chunk)]
        h, at = h[at], at + lo
        owner = np.searchsorted(starts, at, side="right") - 1
        pos = at - starts[owner]
        ok = (pos + GRAM <= lens[owner]) & (lens[owner] >= LENGTH)
        h, owner, pos = h[ok], owner[ok], pos[ok]
        stay, run = _stretches(h, owner, pos)
        found.append((h[stay], owner[stay], pos[stay], run))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _times(run: np.ndarray) -> np.ndarray:
    """Occurrences that an anchor record stands for."""
    return np.maximum(run & ((1 << 26) - 1), 1)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Heads of the runs of equal keys in sorted columns."""
    n = len(keys[0])
    head = np.ones(n, bool)
    if n:
        head[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(head)


def _blobs(bucket: np.ndarray, n_buckets: int, make) -> Iterator[tuple[int, bytes]]:
    """One packed block per bucket of rows sorted by bucket."""
    cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield b, make(slice(cut[b], cut[b + 1]))


def _emit_blobs(blobs: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for r in blobs:
        rows.append(r)
        size += len(r[1])
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], ["b", "data"])
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], ["b", "data"])


def find_anchors(n_buckets: int):
    """Batches of ``doc_id, _tag, text`` to blocks of ``hash, doc, place, kind, stretch``; a place is tag << 32 | position.

    Kind 0 asks whether other documents share the anchor; 1 is already known to be shared (sent anywhere, to be passed
    on); 2 tells the others that several documents of this task share it, and how often (as the stretch).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in kernels.slices(batches, "text", 8 << 20):
            ids, tags = t.column("doc_id").to_numpy(), t.column("_tag").to_numpy().astype(np.int64)
            h, owner, pos, run_ = anchors(*kernels.text_buffer(t.column("text")))
            doc, pos = ids[owner], tags[owner] << 32 | pos
            order = np.argsort(h, kind="stable")
            head = _runs(h[order])
            if not len(head):
                continue
            size = np.diff(np.append(head, len(h)))
            several = np.minimum.reduceat(doc[order], head) != np.maximum.reduceat(doc[order], head)
            known = np.zeros(len(h), bool)
            known[order] = np.repeat(several, size)
            tell = order[head[several]]
            often = np.add.reduceat(_times(run_)[order], head)[several]
            bucket = ((h >> U64(44)) % U64(n_buckets)).astype(np.int64)
            where = np.where(known, (kernels.mix64(doc.view(np.uint64) + U64(1)) % U64(n_buckets)).astype(np.int64), bucket)
            bucket = np.concatenate([where, bucket[tell]])
            kind = np.concatenate([known.astype(np.uint64), np.full(len(tell), 2, np.uint64)])
            low = np.concatenate([h, h[tell]]) & U64(0xFFFFFFFF)
            low[kind == 1] = 0
            doc, pos, run_ = np.concatenate([doc, doc[tell]]), np.concatenate([pos, pos[tell]]), np.concatenate([run_, often])
            order = np.argsort(bucket, kind="stable")
            bucket, low, doc, pos, kind, run_ = bucket[order], low[order], doc[order], pos[order], kind[order], run_[order]
            # kind rides on the position; within a bucket documents and positions ascend, so differences are small
            place = pos * 3 + kind.astype(np.int64)
            yield from _emit_blobs(_blobs(bucket, n_buckets, lambda s: squeeze(pack_columns(low[s], delta(doc[s]), delta(place[s]), run_[s]))))

    return run


def _lists(doc: np.ndarray, tag: np.ndarray, value: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    """One row per document and tag with all its values."""
    order = np.lexsort([tag, doc])
    doc, tag, value = doc[order], tag[order], value[order]
    head = _runs(doc, tag)
    cut = np.append(head, len(doc))
    for a in range(0, len(head), 8192):
        part = cut[a : a + 8193]
        yield pa.RecordBatch.from_arrays([pa.array(doc[part[:-1]]), pa.array(tag[part[:-1]].astype(np.int32)), pa.ListArray.from_arrays(pa.array((part - part[0]).astype(np.int32)), pa.array(value[part[0] : part[-1]]))], ["doc_id", "_tag", name])


def _partition(batches: Iterator[pa.RecordBatch], n_columns: int, deltas: tuple[int, ...]) -> tuple[list[np.ndarray], list[tuple[list[np.ndarray], bytes]]] | None:
    """All blocks of a partition: the bucket and the columns, and for each block its columns and what follows them."""
    buckets, columns, tails = [], [], []
    for b in batches:
        for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            data = expand(data)
            cols, used = unpack_columns(data, n_columns)
            for c in deltas:
                cols[c] = undelta(cols[c])
            buckets.append(np.full(len(cols[0]), bucket, np.uint64))
            columns.append(cols)
            if used < len(data):
                tails.append((cols, data[used:]))
    if not columns:
        return None
    return [np.concatenate(buckets), *(np.concatenate(c) for c in zip(*columns))], tails


def share_anchors(hot: int):
    """Blocks of one partition to ``doc_id, _tag, at``: anchors that several documents have, in ``at``.

    A position stands alone, or a stretch is three numbers: position, minus the distance, count. Anchors with more than
    ``hot`` occurrences are reported once more, as rows with tag -1: bucket, low hash, occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _partition(batches, 4, (1, 2))
        if got is None:
            return
        bucket, low, doc, pos, stretch = got[0]
        stretch = stretch.astype(np.int64)
        kind, pos = pos % 3, pos // 3
        known = kind == 1
        ask = ~known
        key = bucket[ask] << U64(32) | low[ask]
        order = np.argsort(key, kind="stable")
        key, d, p, k, r = key[order], doc[ask][order], pos[ask][order], kind[ask][order], stretch[ask][order]
        head = _runs(key)
        if len(head):
            size = np.diff(np.append(head, len(key)))
            several = (np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)) | (np.maximum.reduceat(k, head) == 2)
            often = np.add.reduceat(np.where(k == 2, r, _times(r)), head)
            top = np.flatnonzero(several & (often > hot))
            if len(top):
                values = np.stack([bucket[ask][order][head[top]].astype(np.int64), low[ask][order][head[top]].astype(np.uint32).view(np.int32), np.minimum(often[top], (1 << 31) - 1)], axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(top), pa.int64()), pa.array(np.full(len(top), -1, np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(top) + 1, 3, dtype=np.int32)), pa.array(values.ravel()))], ["doc_id", "_tag", "at"])
            take = np.repeat(several, size) & (k == 0)
            d, p, r = d[take], p[take], r[take]
        doc, place, stretch = np.concatenate([doc[known], d]), np.concatenate([pos[known], p]), np.concatenate([stretch[known], r])
        width = np.where(stretch > 0, 3, 1)
        many = np.flatnonzero(stretch > 0)
        value = np.repeat(place & 0xFFFFFFFF, width)
        first = (np.cumsum(width) - width)[many]
        value[first + 1], value[first + 2] = -(stretch[many] >> 26), stretch[many] & ((1 << 26) - 1)
        yield from _lists(np.repeat(doc, width), np.repeat(place >> 32, width), value.astype(np.int32), "at")

    return run


def _positions(flat: np.ndarray, owner: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(owner, position)`` of all anchors in ``at`` lists, stretches spelt out, at most ``most`` at a time."""
    sign = np.flatnonzero(flat < 0)
    single = np.ones(len(flat), bool)
    single[sign] = single[sign + 1] = False
    entry = np.flatnonzero(single)
    gap, count = np.zeros(len(entry), np.int64), np.ones(len(entry), np.int64)
    at = np.searchsorted(entry, sign - 1)
    gap[at], count[at] = -flat[sign], flat[sign + 1]
    pos, owner, end = flat[entry], owner[entry], np.cumsum(count)
    for a in range(0, int(end[-1]) if len(end) else 0, most):
        k = np.arange(a, min(a + most, int(end[-1])))
        e = np.searchsorted(end, k, side="right")
        yield owner[e], pos[e] + gap[e] * (k - (end - count)[e])


# -- step 2: contexts, suffix order, previous and next smaller documents --------------------------------------------


def _gram_key(grams: np.ndarray) -> np.ndarray:
    """``gram_hashes`` of single grams (rows of bytes)."""
    powers = kernels._geometric(kernels._BASE, GRAM)[::-1]
    h = np.zeros(len(grams), np.uint64)
    for k in range(GRAM):
        h += (grams[:, k].astype(np.uint64) + U64(1)) * powers[k]
    return kernels.mix64(h)


def _row_hash(rows: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """A 64-bit hash of rows of bytes, to bring equal rows together (equality is then checked on the bytes)."""
    words = np.ascontiguousarray(rows).view("<u8")
    h = np.zeros(len(rows), np.uint64)
    for k in range(words.shape[1]):
        h = kernels.mix64(h * U64(0x9E3779B97F4A7C15) + words[:, k])
    for m in more:
        h = kernels.mix64(h + m.astype(np.uint64))
    return h


def _equal_contexts(key: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (key, context, doc, position) and whether each row in it starts a run of equal contexts."""
    order = np.lexsort([pos, doc, _row_hash(rows, left, right), key])
    r, l_, r_ = rows[order], left[order], right[order]
    head = np.ones(len(order), bool)
    head[1:] = (r[1:] != r[:-1]).any(1) | (l_[1:] != l_[:-1]) | (r_[1:] != r_[:-1]) | (key[order][1:] != key[order][:-1])
    return order, head


def _close_copies(head: np.ndarray, doc: np.ndarray, pos: np.ndarray, extent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal contexts of one document that follow each other within ``LENGTH`` bytes become one record with an extent.

    Whatever string of the context is removed has ``LENGTH`` bytes, so the removed strings of such copies touch: the
    union runs from the first copy's start to the last one's end. Returns the records that stay and their extents.
    """
    new = head.copy()
    new[1:] |= (doc[1:] != doc[:-1]) | (pos[1:] - (pos + extent)[:-1] > LENGTH)
    at = np.flatnonzero(new)
    return at, np.maximum.reduceat(pos + extent, at) - pos[at] if len(at) else extent[at]


def cut_contexts(n_buckets: int, hot: np.ndarray | None = None, most: int = 1 << 16):
    """Batches of ``doc_id, _tag, text, at`` to blocks of ``key, doc, place, left, right, kind, extent`` and then the contexts.

    Kind 1 has its answer (an equal string of an earlier document lies in this task) and is passed on; kind 2 is a
    single string of ``LENGTH`` bytes with an anchor of ``hot`` (sorted bucket << 32 | low hash).
    """
    hot = np.zeros(0, np.uint64) if hot is None else hot

    def blocks(kind: int, bucket: np.ndarray, key: np.ndarray, doc: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, extent: np.ndarray, rows: np.ndarray | None, turn: np.ndarray) -> Iterator[tuple[int, bytes]]:
        bucket = (bucket % U64(n_buckets)).astype(np.int64)
        order = np.lexsort([turn, bucket])  # rows of a bucket in the order of the texts
        b = bucket[order]

        def make(s: slice) -> bytes:
            c = order[s]
            head = pack_columns(key[c], delta(doc[c]), delta(pos[c]), left[c], right[c], np.full(len(c), kind), extent[c])
            return squeeze(head + (rows[c].tobytes() if rows is not None else b""))

        yield from _blobs(b, n_buckets, make)

    def settled(doc: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, extent: np.ndarray) -> Iterator[tuple[int, bytes]]:
        yield from blocks(1, kernels.mix64(doc.view(np.uint64) + U64(1)), np.zeros(len(doc)), doc, pos, left, right, extent, None, pos)

    def strings(rows: np.ndarray, doc: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, extent: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """The strings of contexts with hot anchors, at all offsets; those of later documents are settled."""
        offsets = np.arange(LEFT + 1)
        for a in range(0, len(doc), 2048):
            z = slice(a, a + 2048)
            r, x = np.nonzero((left[z, None] >= offsets) & (right[z, None] >= LEFT - offsets))
            word = np.zeros((len(r), 56), np.uint8)
            word[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(rows[z], LENGTH, axis=1)[r, LEFT - x]
            key, d, p, zero = _row_hash(word), doc[z][r], pos[z][r] - x, np.zeros(len(r), np.int64)
            order, head = _equal_contexts(key, word, zero, zero, d, p)
            at, ext = _close_copies(head, d[order], p[order], extent[z][r][order])
            first = np.repeat(d[order][head], np.diff(np.append(np.flatnonzero(head), len(order))))[at]
            at = order[at]
            late = d[at] > first
            zero = np.zeros(len(at), np.int64)
            yield from settled(d[at][late], p[at][late], zero[late], zero[late] + LEFT, ext[late])
            yield from blocks(2, key[at][~late] >> U64(44), key[at][~late], d[at][~late], p[at][~late], zero[~late], zero[~late] + LEFT, ext[~late], word[at[~late]], at[~late])

    def some(buf: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, bytes]]:
        left = np.minimum(pos, LEFT)
        right = np.minimum(size - pos - GRAM, LEFT)
        whole = left + right >= LEFT
        start, doc, tag, pos, left, right = start[whole], doc[whole], tag[whole], pos[whole], left[whole], right[whole]
        if not len(doc):
            return
        span = np.arange(-LEFT, LENGTH, dtype=np.int32)
        rows = np.empty((len(doc), CONTEXT), np.uint8)
        for a in range(0, len(doc), 1 << 13):  # index matrices are eight times as large as what they fetch
            z = slice(a, a + (1 << 13))
            at = (start + pos)[z, None] + span[None]
            rows[z] = buf[np.clip(at, 0, len(buf) - 1)]
            rows[z][(span[None] < -left[z, None]) | (span[None] >= (GRAM + right)[z, None])] = 0
        key, pos = _gram_key(rows[:, LEFT : LEFT + GRAM]), tag << 32 | pos
        order, head = _equal_contexts(key, rows, left, right, doc, pos)
        at, extent = _close_copies(head, doc[order], pos[order], np.zeros(len(order), np.int64))
        first = np.repeat(doc[order][head], np.diff(np.append(np.flatnonzero(head), len(order))))[at]
        at = order[at]
        done = doc[at] > first
        yield from settled(doc[at][done], pos[at][done], left[at][done], right[at][done], extent[done])
        at, extent = at[~done], extent[~done]
        if len(hot):
            name = (key[at] >> U64(44)) % U64(n_buckets) << U64(32) | key[at] & U64(0xFFFFFFFF)
            where = np.minimum(np.searchsorted(hot, name), len(hot) - 1)
            is_hot = hot[where] == name
            c = at[is_hot]
            yield from strings(rows[c], doc[c], pos[c], left[c], right[c], extent[is_hot])
            at, extent = at[~is_hot], extent[~is_hot]
        yield from blocks(0, key[at] >> U64(44), key[at], doc[at], pos[at], left[at], right[at], extent, rows[at], at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in kernels.slices(batches, "text", 8 << 20):
            buf, starts, lens = kernels.text_buffer(t.column("text"))
            ids, tags = t.column("doc_id").to_numpy(), t.column("_tag").to_numpy().astype(np.int64)
            at = t.column("at").combine_chunks()
            flat, n = at.flatten().to_numpy().astype(np.int64), np.diff(at.offsets.to_numpy())

            def blobs() -> Iterator[tuple[int, bytes]]:
                for o, pos in _positions(flat, np.repeat(np.arange(len(t)), n), most):
                    yield from some(buf, starts[o], lens[o], ids[o], tags[o], pos)

            yield from _emit_blobs(blobs())

    return run


def nearest_smaller(rank: np.ndarray, common: np.ndarray, enough: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in suffix order, the nearest one before it of smaller rank (-1: none) and the prefix they share.

    ``common[i]`` is the prefix that suffixes i - 1 and i share. All suffixes follow, at once, the pointers of those they
    point to, so a pass doubles their reach. A suffix whose shared prefix falls below ``enough`` looks no further.
    """
    n = len(rank)
    near, share = np.arange(n) - 1, common.astype(np.int64)
    share[:1] = 0
    live = np.arange(1, n)
    while len(live := live[(near[live] >= 0) & (share[live] >= enough)]) and len(live := live[rank[near[live]] >= rank[live]]):
        p = near[live]
        near[live], share[live] = near[p], np.where(near[p] < 0, 0, np.minimum(share[live], share[p]))
    near[(near >= 0) & (rank[near] >= rank)] = -1
    return near, np.where(near < 0, 0, share)


def longest_previous_factors(rank: np.ndarray, common: np.ndarray, enough: int = 0) -> np.ndarray:
    """The LPF array, in suffix order: the longer of the prefixes shared with the previous and next smaller ranks.

    Values of at least ``enough`` are exact; smaller ones may come out as less.
    """
    _, before = nearest_smaller(rank, common, enough)
    _, after = nearest_smaller(rank[::-1], np.concatenate([common[:1], common[:0:-1]]), enough)
    return np.maximum(before, after[::-1])


def judge_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one partition to ``doc_id, _tag, span``: intervals to remove, as start << 32 | end."""
    got = _partition(batches, 7, (1, 2))
    if got is None:
        return
    (_, key, doc, pos, left, right, kind, extent), tails = got
    left, right, extent = left.astype(np.int64), right.astype(np.int64), extent.astype(np.int64)
    # places keep their tag in the upper half through all arithmetic on positions
    known = kind == 1
    out_doc, out_start, out_end = [doc[known]], [(pos - left)[known]], [(pos + GRAM + right + extent)[known]]

    def rows_of(k: int, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(t for c, t in tails if c[5][0] == k), np.uint8).reshape(-1, width)

    def later_copies(k: int, width: int) -> tuple:
        """The records of kind k in the order of ``_equal_contexts``; those of later documents are put out."""
        rows, mine = rows_of(k, width), kind == k
        columns = [c[mine] for c in (key, doc, pos, left, right, extent)]
        order, head = _equal_contexts(columns[0], rows, columns[3], columns[4], columns[1], columns[2])
        columns, head = [c[order] for c in columns], np.flatnonzero(head)
        _, d, p, lf, rt, ext = columns
        size = np.diff(np.append(head, len(order)))
        later = d > np.repeat(d[head], size)  # the whole context is a prefix shared with an earlier document
        out_doc.append(d[later]), out_start.append((p - lf)[later]), out_end.append((p + GRAM + rt + ext)[later])
        return rows[order], columns, head, size, later

    if (kind == 2).any():
        later_copies(2, 56)
    if (kind == 0).any():
        rows, (key, doc, pos, left, right, extent), head, size, later = later_copies(0, CONTEXT)
        # distinct contexts of anchors that have several of them
        ck, cd, cl, cr, crow = key[head], doc[head], left[head], right[head], rows[head]
        ghead = _runs(ck)
        gsize = np.diff(np.append(ghead, len(ck)))
        many = np.flatnonzero(np.repeat(gsize > 1, gsize))
        if len(many):
            group = np.repeat(np.arange(len(ghead)), gsize)[many]
            cd, cl, cr, crow = cd[many], cl[many], cr[many], crow[many]
            gram = crow[:, LEFT : LEFT + GRAM]
            if ((gram[1:] != gram[:-1]).any(1) & (group[1:] == group[:-1])).any():  # two grams with one hash
                _, kinds = np.unique(gram, axis=0, return_inverse=True)
                pairs, group = np.unique(np.stack([group, kinds.ravel()]), axis=1, return_inverse=True)
                group = group.ravel()
            hit = np.zeros((len(many), LEFT + 1), bool)
            for x in range(LEFT + 1):  # suffixes that start x bytes before the anchor
                live = np.flatnonzero((cl >= x) & (cr >= LEFT - x))
                if len(live) < 2:
                    continue
                word = np.zeros((len(live), 32), np.uint8)  # their first LENGTH bytes but for the anchor, which they share
                word[:, :x] = crow[live, LEFT - x : LEFT]
                word[:, x:LEFT] = crow[live, LEFT + GRAM : CONTEXT - x]
                w = word.view(">u8").astype(np.uint64)
                g = group[live]
                suffix = np.lexsort([w[:, 3], w[:, 2], w[:, 1], w[:, 0], g])
                word, g = word[suffix], g[suffix]
                common = np.zeros(len(live), np.int64)
                differ = word[1:, :LEFT] != word[:-1, :LEFT]
                lead = np.where(differ.any(1), differ.argmax(1), LEFT)
                common[1:] = np.where(g[1:] != g[:-1], 0, np.where(lead < x, lead, lead + GRAM))
                hit[live[suffix], x] = longest_previous_factors(cd[live[suffix]], common, LENGTH) >= LENGTH
            # the owners (occurrences in the context's first document) take the context's matches
            some = np.flatnonzero(hit.any(1))
            owner = np.full(len(head), -1)
            owner[many[some]] = some
            mine = np.repeat(owner, size)
            at = np.flatnonzero((mine >= 0) & ~later)
            h = hit[mine[at]]
            edge = np.zeros((len(at), LEFT + 3), np.int8)
            edge[:, 1:-1] = h
            step = np.diff(edge, axis=1)
            r0, x0 = np.nonzero(step == 1)  # runs of x from x0 to x1 - 1
            _, x1 = np.nonzero(step == -1)
            out_doc.append(doc[at[r0]]), out_start.append(pos[at[r0]] - (x1 - 1)), out_end.append(pos[at[r0]] - x0 + LENGTH + extent[at[r0]])
    d, s, e = np.concatenate(out_doc), np.concatenate(out_start), np.concatenate(out_end)
    if not len(d):
        return
    tag, s, e = s >> 32, s & 0xFFFFFFFF, e & 0xFFFFFFFF
    # join overlapping intervals of a document before they are shuffled
    order = np.lexsort([s, tag, d])
    d, tag, s, e = d[order], tag[order], s[order], e[order]
    base = np.cumsum(np.concatenate([[0], (d[1:] != d[:-1]) | (tag[1:] != tag[:-1])])) * (np.int64(1) << 33)
    reach = np.maximum.accumulate(e + base)
    fresh = np.ones(len(d), bool)
    fresh[1:] = (s + base)[1:] > reach[:-1]
    head = np.flatnonzero(fresh)
    last = np.append(head[1:], len(d)) - 1
    yield from _lists(d[head], tag[head], s[head] << 32 | (reach - base)[last], "span")


# -- step 3: whole texts --------------------------------------------------------------------------------------------


def covered(lens: np.ndarray, starts: np.ndarray, owner: np.ndarray, span: np.ndarray, total: int) -> np.ndarray:
    """Which bytes of the buffer the intervals cover."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, starts[owner] + (span >> 32), 1)
    np.add.at(edge, starts[owner] + np.minimum(span & 0xFFFFFFFF, lens[owner]), -1)
    return np.cumsum(edge[:-1]) > 0


def _apply(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buf, starts, lens = kernels.text_buffer(table.column("text"))
    span = table.column("span").combine_chunks()
    n = np.where(span.is_valid().to_numpy(zero_copy_only=False), np.diff(span.offsets.to_numpy()), 0)
    return buf, starts, lens, covered(lens, starts, np.repeat(np.arange(len(lens)), n), span.flatten().to_numpy().astype(np.int64), len(buf))


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, text, span`` to the columns of ``OUT``."""
    for t in kernels.slices(batches, "text", 4 << 20):
        buf, starts, lens, gone = _apply(t)
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[starts + lens] - total[starts]
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        head[starts[lens > 0]] = gone[starts[lens > 0]]
        heads = np.concatenate([[0], np.cumsum(head)])
        kept = memoryview(np.ascontiguousarray(buf[~gone]))
        cut = starts - total[starts]
        sha = [hashlib.sha256(kept[a : a + n]).hexdigest() for a, n in zip(cut.tolist(), (lens - removed).tolist())]
        yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(lens), pa.array(removed), pa.array(heads[starts + lens] - heads[starts]), pa.array(sha, pa.string())], [x.split(" ")[0] for x in OUT.split(", ")])


def _by_document(lists: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return lists.groupBy(*keys).agg(F.flatten(F.collect_list(value)).alias(value))


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` and ``span``, the intervals of bytes to remove (null: none). ``doc_id`` and ``text`` are required.

    The texts are shuffled once, by id; the exchange serves both the cutting of contexts and the removal.
    """
    spark = docs.sparkSession
    nameless = docs.where("doc_id is null").withColumn("span", F.lit(None).cast("array<long>"))
    docs = docs.where("doc_id is not null")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count()
    # rows with one id but different texts are told apart by a tag; where ids are unique it is 0 and takes no room
    tag = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("text")) if repeated else F.lit(0)
    docs = docs.withColumn("_tag", tag.cast("int"))
    own = docs.select("doc_id", "_tag", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (32 << 20)))
    sent = own.mapInArrow(kernels.lean(find_anchors(n)), "b int, data binary").repartitionById(n, F.col("b"))
    shared = materialise(sent.mapInArrow(kernels.lean(share_anchors(HOT)), "doc_id long, _tag int, at array<int>"), "suffix-anchors")
    top = shared.where("_tag = -1").orderBy(F.desc(F.col("at")[2]), "at").limit(HOT_KEYS).collect()  # bounded
    hot = np.sort(np.array([r["at"][0] << 32 | r["at"][1] & 0xFFFFFFFF for r in top], np.uint64))
    shared = shared.where("_tag >= 0")
    keys = ["doc_id", "_tag"] if repeated else ["doc_id"]
    texts = docs.repartition(n, *keys)
    # all columns go along, so that both joins read one and the same exchange
    pairs = texts.join(_by_document(shared, "at", keys).hint("shuffle_hash"), keys)
    cut = pairs.mapInArrow(kernels.lean(cut_contexts(n, hot)), "b int, data binary").repartitionById(n, F.col("b"))
    spans = cut.mapInArrow(kernels.lean(judge_contexts), "doc_id long, _tag int, span array<long>")
    return texts.join(_by_document(spans, "span", keys).hint("shuffle_hash"), keys, "left").drop("_tag").unionByName(nameless)


def _id(docs: DataFrame) -> Column:
    """The id as a long; left bare where it is one, for an alias would keep Spark from reusing the texts' exchange."""
    return F.col("doc_id") if docs.schema["doc_id"].dataType == T.LongType() else F.col("doc_id").cast("long").alias("doc_id")


def dedup_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    own = docs.select(_id(docs), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return with_spans(own).select("doc_id", "text", "span").mapInArrow(kernels.lean(digest_rows), OUT)


def dedup_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed bytes taken out of ``text`` (and ``n_chars`` renewed, where there is such a column)."""
    names = docs.columns
    inner = docs.select(_id(docs), "text", F.struct(*[docs[c] for c in names if c != "text"]).alias("_rest"))
    joined = with_spans(inner).select("doc_id", "_rest", "text", "span")
    schema = T.StructType([joined.schema["_rest"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in kernels.slices(batches, "text", 4 << 20):
            buf, starts, lens, gone = _apply(t)
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[starts + lens] - total[starts]
            kept = np.ascontiguousarray(buf[~gone]).tobytes()
            cut = starts - total[starts]
            old = t.column("text").to_pylist()
            new = [o if not r else kept[a : a + n].decode("utf-8", "ignore") for o, r, a, n in zip(old, removed.tolist(), cut.tolist(), (lens - removed).tolist())]
            yield pa.RecordBatch.from_arrays([t.column("_rest").combine_chunks(), pa.array(new, pa.string())], ["_rest", "text"])

    done = joined.mapInArrow(kernels.lean(run), schema)
    cols = {c: F.col("text") if c == "text" else F.col("_rest")[c] for c in names}
    if "n_chars" in names:
        cols["n_chars"] = F.length(F.col("text")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[v.alias(c) for c, v in cols.items()])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every document's bytes judged against all earlier documents."""
    return dedup_digests(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
