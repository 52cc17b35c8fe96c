"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of each text; a chunk ends where it matches a mask, a strict one before the normal
size and a loose one after it (normalised chunking), within a least and a greatest size. A fingerprint is the sorted set
of chunk digests with their summed lengths, eight bytes each (four of digest, four of length) in base64; it ends with the
length of the whole text. Likeness is the length of shared chunks over the larger text's length: containment of the
larger in the smaller, 0 to 1. Insertions shift bytes but not boundaries, so all other chunks keep their digests.

Defined cases: a null text is empty; an empty text has an empty digest set, and two empty texts have likeness 1, one
empty text 0; equal texts have equal fingerprints; documents are put in descending order of (doc_id, text), so repeated
ids have a defined next document, and null ids come last; a single document is its own next; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.llm import kernels
from lorespark.session import spread

OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@dataclass(frozen=True)
class ChunkParams:
    least: int = 12
    normal: int = 32
    most: int = 192
    strict_bits: int = 6
    loose_bits: int = 3


_GEAR = kernels.mix64(np.arange(1, 257, dtype=np.uint64) * kernels.U64(0x9E3779B97F4A7C15)).astype(np.uint32)


def gear_hashes(buf: np.ndarray) -> np.ndarray:
    """``h = (h << 1) + gear[b]`` after each byte, on 32 bits, so of the last 32 bytes; by doubling."""
    h = _GEAR[buf]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            nxt = h.copy()
            nxt[k:] += h[:-k] << np.uint32(k)
            h = nxt
    return h


def chunk_ends(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, p: ChunkParams) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends, all texts in order, and chunks per text; texts must be 32 bytes apart (see ``_spaced``)."""
    h = gear_hashes(buf)
    strict, loose = (h >> np.uint32(32 - p.strict_bits)) == 0, (h >> np.uint32(32 - p.loose_bits)) == 0
    ends: list[int] = []
    counts = np.zeros(len(starts), np.int64)
    s_at, l_at = (np.flatnonzero(strict) + 1).tolist(), (np.flatnonzero(loose) + 1).tolist()
    si = li = 0
    ns, nl = len(s_at), len(l_at)
    least, normal, most = p.least, p.normal, p.most
    for t, (a, n) in enumerate(zip(starts.tolist(), lens.tolist())):
        stop, at, before = a + n, a, len(ends)
        while at < stop:
            lo, mid, hi = at + least, at + normal, at + most
            if lo >= stop:
                at = stop
            else:
                while si < ns and s_at[si] < lo:
                    si += 1
                if si < ns and s_at[si] <= mid and s_at[si] < stop:
                    at = s_at[si]
                else:
                    while li < nl and l_at[li] <= mid:
                        li += 1
                    nxt = l_at[li] if li < nl else stop
                    at = min(nxt, hi, stop)
            ends.append(at)
        counts[t] = len(ends) - before
    return np.array(ends, np.int64), counts


def _spaced(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with 32 zero bytes before each, so that no hash sees another text."""
    out = np.zeros(int(lens.sum()) + 32 * len(lens), np.uint8)
    new = np.cumsum(lens + 32) - lens
    at = np.repeat(new - starts, lens)
    where = np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
    out[where + at] = buf[where]
    return out, new


def digest_sets(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, p: ChunkParams = ChunkParams()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(digests uint32, lengths, distinct chunks per text)``, digests ascending within each text."""
    buf, starts = _spaced(buf, starts, lens)
    ends, counts = chunk_ends(buf, starts, lens, p)
    if not len(ends):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), counts
    owner = np.repeat(np.arange(len(starts)), counts)
    begin = np.concatenate([[0], ends[:-1]])
    first = np.cumsum(counts) - counts
    begin[first[counts > 0]] = starts[counts > 0]
    n = len(buf)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + kernels.U64(1)) * kernels._geometric(kernels._BASE, n), out=prefix[1:])
    d = kernels.mix64((prefix[ends] - prefix[begin]) * kernels._geometric(kernels._INVERSE, n)[begin] + (ends - begin).astype(np.uint64))
    key = (owner.astype(np.uint64) << kernels.U64(32)) | (d >> kernels.U64(32))
    order = np.argsort(key, kind="stable")
    key, size = key[order], (ends - begin)[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, size = key[head], np.add.reduceat(size, head)
    return key.astype(np.uint32), size, np.bincount((key >> kernels.U64(32)).astype(np.int64), minlength=len(starts))


def fingerprints(digests: np.ndarray, sizes: np.ndarray, counts: np.ndarray, lens: np.ndarray) -> list[str]:
    """Base64 of (digest, length) pairs, a dot, and the text's length; a text has under 2^31 bytes, so four hold any length."""
    pairs = np.empty((len(digests), 2), ">u4")
    pairs[:, 0], pairs[:, 1] = digests, sizes
    raw = pairs.tobytes()
    ends = np.cumsum(counts) * 8
    return [f"{base64.b64encode(raw[e - 8 * c : e]).decode()}.{n}" for e, c, n in zip(ends.tolist(), counts.tolist(), lens.tolist())]


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints."""

    def parse(x: str) -> tuple[dict[bytes, int], int]:
        body, _, n = x.partition(".")
        raw = base64.b64decode(body)
        return {raw[i : i + 4]: int.from_bytes(raw[i + 4 : i + 8], "big") for i in range(0, len(raw), 8)}, int(n)

    (da, na), (db, nb) = parse(a), parse(b)
    if not max(na, nb):
        return 1.0
    return min(1.0, sum(min(n, db[k]) for k, n in da.items() if k in db) / max(na, nb))


def _pair_likeness(owner_a: np.ndarray, da: np.ndarray, sa: np.ndarray, owner_b: np.ndarray, db: np.ndarray, sb: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Likeness of pair i: the sets of owner i on both sides (keys ascend)."""
    ka = owner_a.astype(np.uint64) << kernels.U64(32) | da
    kb = owner_b.astype(np.uint64) << kernels.U64(32) | db
    at = np.searchsorted(kb, ka)
    at[at == len(kb)] = 0
    same = kb[at] == ka if len(kb) else np.zeros(len(ka), bool)
    shared = np.bincount(owner_a[same], np.minimum(sa[same], sb[at[same]]), minlength=len(la))
    most = np.maximum(la, lb)
    return np.where(most > 0, np.minimum(shared / np.maximum(most, 1), 1.0), 1.0)


def edit(text: str, following: str) -> str:
    """The last third (rounded down) of ``text`` replaced by as many, or all, first characters of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _tag_ranges(base: DataFrame, cuts: list[int], inline: int = 1000) -> DataFrame:
    """Add ``_b``, the number of ``cuts`` below the id: an expression, or a binary search per batch for many cuts."""
    if not cuts:
        return base.withColumn("_b", F.lit(0))
    if len(cuts) <= inline:
        return base.withColumn("_b", F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("doc_id"))))
    sent = base.sparkSession.sparkContext.broadcast(np.array(cuts, np.int64))  # one number per range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("_b", pa.array(np.searchsorted(sent.value, b.column(0).to_numpy(), side="left").astype(np.int32)))

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("_b", T.IntegerType())]))


def in_order(docs: DataFrame, rows_per_range: int = 4096, most_ranges: int = 100_000) -> DataFrame:
    """``_b, _copy, doc_id, text, _null``: a task per range ``_b`` of ids, sorted by descending (doc_id, text).

    Ids are cut into ranges of about ``rows_per_range`` rows (``most_ranges`` ranges at most). The greatest document of
    each range also closes the range above it as a copy (the very greatest closes the lowest), so every document is
    followed by its next one, with one shuffle and no global window.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("doc_id").isNull().alias("_null"))
    parts = min(most_ranges, max(1, -(-base.count() // rows_per_range)))
    cuts = sorted({int(c) for c in base.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    tops = {r["_b"]: r["m"] for r in _tag_ranges(base.select("doc_id"), cuts).groupBy("_b").agg(F.max("doc_id").alias("m")).collect()}  # one row per range
    order = sorted(tops)
    goal = [(tops[low], high) for low, high in zip(order, [*order[1:], *order[:1]])]
    wanted = spark.createDataFrame(goal, "doc_id long, _to int")
    w = Window.partitionBy("doc_id").orderBy(F.desc("text"))
    extra = base.join(F.broadcast(wanted), "doc_id").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("doc_id", "text", "_null", F.col("_to").alias("_b"), F.lit(1).alias("_copy"))
    both = _tag_ranges(base, cuts).withColumn("_copy", F.lit(0)).unionByName(extra).select("_b", "_copy", "doc_id", "text", "_null")
    return both.repartitionById(len(cuts) + 1, F.col("_b")).sortWithinPartitions("_b", "_copy", F.desc("doc_id"), F.desc("text"))


def compare(batches: Iterator[pa.RecordBatch], p: ChunkParams = ChunkParams(), unit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of ``in_order`` to the columns of ``OUT``; each text is chunked once, each edited text once."""
    held: list[tuple[int, int | None, str]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        texts = [x[2] for x in held]
        at = [i for i in range(len(held) - 1) if not held[i][0]]
        raw = [edit(texts[i], texts[i + 1]).encode() for i in at]
        one = kernels.text_buffer(pa.array(texts, pa.large_string()))
        two = kernels.text_buffer(pa.array(raw, pa.large_binary()))
        d1, s1, c1 = digest_sets(*one, p)
        d2, s2, c2 = digest_sets(*two, p)
        at_ = np.array(at, np.int64)
        own1, own2 = np.repeat(np.arange(len(texts)), c1), np.repeat(np.arange(len(at)), c2)
        place = np.full(len(texts), -1)
        place[at_] = np.arange(len(at))
        mine = place[own1] >= 0
        after = np.full(len(texts), -1)
        after[at_ + 1] = np.arange(len(at))
        theirs = after[own1] >= 0
        a = (place[own1[mine]], d1[mine], s1[mine])
        edited = _pair_likeness(*a, own2, d2, s2, one[2][at_], two[2])
        following = _pair_likeness(*a, after[own1[theirs]], d1[theirs], s1[theirs], one[2][at_], one[2][at_ + 1])
        prints = fingerprints(d1, s1, c1, one[2])
        return pa.RecordBatch.from_arrays(
            [pa.array([held[i][1] for i in at], pa.int64()), pa.array([len(texts[i]) for i in at], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array([prints[i] for i in at], pa.string()), pa.array(fingerprints(d2, s2, c2, two[2]), pa.string()), pa.array(edited), pa.array(following)],
            [x.split(" ")[0] for x in OUT.split(", ")],
        )

    for b in batches:
        for copy, doc_id, text, null in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4))):
            held.append((copy, None if null else doc_id, text))
            size += len(text)
            if size >= unit and len(held) > 1:
                yield flush()
                held[:] = held[-1:]
                size = len(held[0][2])
    if len(held) > 1:
        yield flush()


def op2_chunk_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every document against its edited text and the next document."""
    return in_order(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))).mapInArrow(compare, OUT)
