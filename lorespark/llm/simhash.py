"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

A fingerprint bit is set if over half of the text's shingle hashes set it. Documents are first counted by fingerprint,
so copies never meet in pairs. Distinct fingerprints that differ in at most two bits agree in at least two of four
16-bit blocks; each of the six pairs of blocks routes them to groups, and a pair is taken only in the first of its
groups. In a group the fingerprints lie in Gray order; windows of eight share a masked bit pattern, windows of windows
share less, up to one root. A search adds up differences from the root down and leaves out a node, with all below it,
once they exceed two. Groups of more than ``hot`` fingerprints are routed once more by three parts of their other bits.
Links leave a task only as counts and as a star forest; components then join by alternating stars.

Defined cases: a null text is empty; a text without words has fingerprint zero and links like any other; a null doc_id
gets its fingerprint, no links and a null component, and is no partner; rows with one id count as separate documents;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import kernels
from lorespark.llm.components import components, forest
from lorespark.session import materialise, spread

RADIUS = 2
FAN = 8
PAIRS = tuple(combinations(range(4), 2))


def simhashes(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64 bits."""
    out = np.zeros(len(starts), np.uint64)
    for i, j in kernels.steps(starts, lens):
        lo, hi = starts[i], starts[j - 1] + lens[j - 1]
        text, pos, size, words = kernels.normal_words(buf[lo:hi], starts[i:j] - lo, lens[i:j])
        if not len(pos):
            continue
        last = np.cumsum(words)  # word index behind each text
        first = last - words
        n = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        to = np.minimum(at + shingle, np.repeat(last, n)) - 1
        h = kernels.xxh64_slices(text, pos[at], pos[to] + size[to] - pos[at], seed)
        out[i:j] = kernels.bit_majority(h, n)
    return out


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) of every whole text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(simhashes(*kernels.text_buffer(b.column(1))).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    r = fp.copy()
    for k in (1, 2, 4, 8, 16, 32):
        r ^= r >> kernels.U64(k)
    return r


def near_pairs(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS, chunk: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one group that differ in at most ``radius`` bits, by the hierarchical index."""
    order = np.lexsort([gray_rank(fp), group])
    leaf, g = fp[order], group[order]
    # levels from the leaves up: shared mask, pattern, group, and the range of children
    masks, patterns, groups, kids = [np.full(len(leaf), ~kernels.U64(0))], [leaf], [g], []
    while True:
        m, p, own = masks[-1], patterns[-1], groups[-1]
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        if kids and len(head) == len(own):
            break
        index = np.arange(len(own)) - np.repeat(head, np.diff(np.append(head, len(own))))
        cut = np.flatnonzero(index % FAN == 0)
        all_, any_ = np.bitwise_and.reduceat(p, cut), np.bitwise_or.reduceat(p, cut)
        shared = np.bitwise_and.reduceat(m, cut) & ~(all_ ^ any_)
        masks.append(shared), patterns.append(any_ & shared), groups.append(own[cut])
        kids.append((cut, np.append(cut[1:], len(own))))
        rest = np.repeat(shared, np.diff(np.append(cut, len(own))))
        masks[-2] = m & ~rest  # what is left to compare below the parent
    root = np.searchsorted(groups[-1], g)
    for a in range(0, len(leaf), chunk):
        q = np.arange(a, min(a + chunk, len(leaf)))
        node = root[q]
        diff = np.bitwise_count((leaf[q] ^ patterns[-1][node]) & masks[-1][node]).astype(np.int16)
        for level in range(len(kids) - 1, -1, -1):
            keep = diff <= radius
            q, node, diff = q[keep], node[keep], diff[keep]
            lo, hi = kids[level][0][node], kids[level][1][node]
            n = hi - lo
            q, diff = np.repeat(q, n), np.repeat(diff, n)
            node = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            diff = diff + np.bitwise_count((leaf[q] ^ patterns[level][node]) & masks[level][node])
        keep = (diff <= radius) & (node > q)
        yield order[q[keep]], order[node[keep]]


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))


def _agree(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first pair of blocks in which each pair agrees, and the first part of the other bits that does."""
    x = a ^ b
    same = [(x >> kernels.U64(16 * i)) & kernels.U64(0xFFFF) == 0 for i in range(4)]
    table = np.select([same[i] & same[j] for i, j in PAIRS], range(6), 6)
    rest = np.zeros(len(x), np.uint64)
    for t, (i, j) in enumerate(PAIRS):
        k, m = (z for z in range(4) if z not in (i, j))
        rest = np.where(table == t, ((x >> kernels.U64(16 * k)) & kernels.U64(0xFFFF)) << kernels.U64(16) | (x >> kernels.U64(16 * m)) & kernels.U64(0xFFFF), rest)
    part = np.select([rest >> kernels.U64(21) == 0, (rest >> kernels.U64(10)) & kernels.U64(0x7FF) == 0, rest & kernels.U64(0x3FF) == 0], range(1, 4), 4)
    return table, part


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``k, fp, n, rep`` sorted by ``k`` to ``kind, x, y``: 0 (fingerprint, linked documents), 1 (edge of representatives)."""

    def run(k: np.ndarray, fp: np.ndarray, n: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        head = np.concatenate([[True], k[1:] != k[:-1]])
        tail = np.concatenate([k[1:] != k[:-1], [True]])
        live = ~(head & tail)
        if not live.any():
            return
        k, fp, n, rep = k[live], fp[live], n[live], rep[live]
        near = np.zeros(len(fp), np.int64)
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in near_pairs(fp, k):
            table, part = _agree(fp[a], fp[b])
            split = (k[a] >> 43) & 3  # 0: not split
            first = (table == k[a] >> 45) & ((split == 0) | (part == split))
            a, b = a[first], b[first]
            np.add.at(near, a, n[b])
            np.add.at(near, b, n[a])
            if len(a):
                edges.append(forest(rep[a], rep[b]))
        hit = near > 0
        if hit.any():
            x, y = (np.concatenate(e) for e in zip(*edges))
            x, y = forest(x, y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array([0, 1], np.int32), [int(hit.sum()), len(x)])), pa.array(np.concatenate([fp[hit].view(np.int64), x])), pa.array(np.concatenate([near[hit], y]))], ["kind", "x", "y"]
            )

    held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for b in batches:
        if not len(b):
            continue
        new = [b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(), b.column(3).to_numpy()]
        held = [np.concatenate([x, y]) for x, y in zip(held, new)]
        end = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
        if end >= 1 << 15:
            yield from run(*(x[:end] for x in held))
            held = [x[end:] for x in held]
    if len(held[0]):
        yield from run(*held)


def link_fingerprints(fps: DataFrame, hot: int = 1 << 17) -> tuple[DataFrame, DataFrame]:
    """From ``fp, n, rep``: ``fp, linked`` (documents of other fingerprints within reach) and ``node, component``."""
    keys = []
    for t, (i, j) in enumerate(PAIRS):
        k, m = (z for z in range(4) if z not in (i, j))
        key = F.shiftleft(_block(F.col("fp"), i), 16).bitwiseOR(_block(F.col("fp"), j))
        rest = F.shiftleft(_block(F.col("fp"), k), 16).bitwiseOR(_block(F.col("fp"), m))
        keys.append(F.struct((F.lit(t).cast("long") * (1 << 45) + key * (1 << 11)).alias("k"), rest.alias("rest")))
    routed = fps.select("fp", "n", "rep", F.explode(F.array(*keys)).alias("r")).select("r.k", "fp", "n", "rep", "r.rest")
    crowded = materialise(routed.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("k"), "simhash-hot")
    if crowded.limit(1).count():
        rest = F.col("rest")
        parts = F.array(*[(F.lit(s).cast("long") * (1 << 43) + p) for s, p in ((1, F.shiftrightunsigned(rest, 21)), (2, F.shiftrightunsigned(rest, 10).bitwiseAND(F.lit(0x7FF))), (3, rest.bitwiseAND(F.lit(0x3FF))))])
        split = routed.join(crowded, "k").select("fp", "n", "rep", "k", F.explode(parts).alias("p")).select((F.col("k") + F.col("p")).alias("k"), "fp", "n", "rep")
        routed = routed.join(crowded, "k", "left_anti").select("k", "fp", "n", "rep").unionByName(split)
    found = materialise(routed.select("k", "fp", "n", "rep").repartition("k").sortWithinPartitions("k").mapInArrow(_search, "kind int, x long, y long"), "simhash-links")
    linked = found.where("kind = 0").groupBy(F.col("x").alias("fp")).agg(F.sum("y").alias("linked"))
    return linked, components(found.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, n_near, component_id`` of every document."""
    prints = materialise(fingerprint_documents(docs), "simhash")
    fps = materialise(prints.where("doc_id is not null").groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("rep")), "simhash-distinct")
    linked, parts = link_fingerprints(fps)
    # only fingerprints with company need a join; the rest keep the defaults
    known = fps.join(linked, "fp", "left").where("n > 1 or linked is not null").join(parts, F.col("rep") == F.col("node"), "left")
    known = materialise(known.select("fp", "n", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("_near"), F.coalesce("component", "rep").alias("_component")), "simhash-known")
    rows = prints.count()
    hot = known.where(F.col("n") * 512 > rows).drop("n")  # fewer than 512 fingerprints: broadcast, never one task
    cold = known.where(F.col("n") * 512 <= rows).select(F.col("fp").alias("_key"), F.col("_near").alias("_near2"), F.col("_component").alias("_component2"))
    joined = prints.join(F.broadcast(hot), "fp", "left").withColumn("_key", F.when(F.col("_near").isNull(), F.col("fp"))).join(cold, "_key", "left")
    alone = F.col("doc_id").isNull()
    return joined.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("_near", "_near2", F.lit(0))).cast("long").alias("n_near"),
        F.when(~alone, F.coalesce("_component", "_component2", "doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row, the least by (doc_id, fingerprint, text), of each component; rows without an id all stay.

    Components join fingerprints, not ids, so unlike rows of one id are kept or dropped each for itself.
    """
    prints = materialise(fingerprint_documents(docs), "simhash").where("doc_id is not null")
    fps = materialise(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")), "simhash-distinct")
    linked, parts = link_fingerprints(fps.select("fp", "n", F.col("fp").alias("rep")))
    known = fps.join(linked, "fp", "left").where("n > 1 or linked is not null").join(parts, F.col("fp") == F.col("node"), "left")
    known = materialise(known.select("fp", "n", "first", F.coalesce("component", "fp").alias("root")), "simhash-known")
    least = known.groupBy("root").agg(F.min(F.struct("first", "fp")).alias("least"))
    known = known.join(least, "root").select("fp", "n", F.col("least.first").alias("_id"), F.col("least.fp").alias("_fp"))
    rows = prints.count()
    hot = F.broadcast(known.where(F.col("n") * 512 > rows))  # fewer than 512 fingerprints, as in near_duplicates
    cold = known.where(F.col("n") * 512 <= rows)
    met = prints.join(hot, "fp").unionByName(prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(cold, "fp"))
    gone = materialise(met.where("doc_id <> _id or fp <> _fp").select("doc_id", "fp").distinct(), "simhash-drop")
    # the list of rows to drop grows with the input, so it is never broadcast: one plan at every size
    if not prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count():
        return docs.join(gone.select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    # an id doesn't name a row: take the fingerprint along, and the least text where even that repeats
    fp, row = (n + "_" * max(map(len, docs.columns)) for n in ("_fp", "_row"))
    tagged = docs.withColumn(fp, F.arrow_udf(_prints_of, "long")("text"))
    kept = tagged.join(gone.withColumnRenamed("fp", fp).hint("shuffle_hash"), ["doc_id", fp], "left_anti")
    met = known.where("fp = _fp and n > 1").select(F.col("_id").alias("doc_id"), F.col("fp").alias(fp))  # the only ones of which rows can repeat
    single = kept.join(met.hint("shuffle_hash"), ["doc_id", fp], "left_anti").select(*docs.columns)
    several = kept.join(met.hint("shuffle_hash"), ["doc_id", fp], "left_semi").groupBy("doc_id", fp).agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias(row))
    return single.unionByName(several.select(f"{row}.*"))


def _prints_of(text: pa.Array) -> pa.Array:
    return pa.array(simhashes(*kernels.text_buffer(text)).view(np.int64))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every document's fingerprint, links and component."""
    return near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
