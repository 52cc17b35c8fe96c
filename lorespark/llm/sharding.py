"""Fixed virtual slots: records hash into thousands of slots, a versioned map sends slots to shards.

The law is ``bytes``: sizes near equal. A record's slot is a hash of its text and of nothing else, so equal texts share a
slot and a shard, and a slot stays the same however the corpus grows. Balance comes from the map: the bytes of each slot
are summed and the slots are dealt to the shards, largest first. A slot that alone exceeds a shard's fair share can't be
balanced by moving it; the map then records a split of it, first by another hash of the text (equal texts stay
together), and, where one text alone is that large, by a hash of the id. Fewer slots than shards can be that large.
Rebalancing edits the map and appends a version: the new shard takes whole slots from the fullest ones, no other slot
moves, and splits stay.

Defined cases: a null text has size 1 and the crc of no bytes; a null id is an id like others; an empty table gives an
empty result; repeated rows are placed each; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.session import materialise, spread

SLOTS = 4096
PARTS = 64
#: Places of a slot are numbered in so many parts, so that no task sorts a whole slot.
RUNS = 64


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: ``shard_of[slot]``, and the slots that were split, in order.

    Split i (slot, by ``text`` or ``id``) turns its slot into ``PARTS`` slots from ``slots + i * PARTS`` on.
    """

    version: int
    shards: int
    slots: int
    shard_of: tuple[int, ...]
    splits: tuple[tuple[int, str], ...] = ()

    def first(self, i: int) -> int:
        return self.slots + i * PARTS

    def table(self, spark: SparkSession) -> DataFrame:
        split = {s: (self.first(i), by) for i, (s, by) in enumerate(self.splits)}
        rows = [(self.version, s, k, *split.get(s, (None, None))) for s, k in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, vslot int, shard int, split_first int, split_by string")


def build_map(slot_bytes: dict[int, int], shards: int, slots: int = SLOTS, splits: tuple[tuple[int, str], ...] = ()) -> SlotMap:
    """Largest slot first onto the emptiest shard; ties to the smaller number."""
    every = slots + PARTS * len(splits)
    load = [(0, k) for k in range(shards)]
    out = [0] * every
    for s in sorted(range(every), key=lambda s: (-slot_bytes.get(s, 0), s)):
        n, k = heapq.heappop(load)
        out[s] = k
        heapq.heappush(load, (n + slot_bytes.get(s, 0), k))
    return SlotMap(1, shards, slots, tuple(out), splits)


def rebalance(old: SlotMap, slot_bytes: dict[int, int]) -> SlotMap:
    """One more shard: it takes slots, always from the fullest shard, until it holds its fair share."""
    out, new = list(old.shard_of), old.shards
    total = sum(slot_bytes.values())
    load = [0] * (new + 1)
    held: list[list[tuple[int, int]]] = [[] for _ in range(new)]
    for s, k in enumerate(out):
        load[k] += slot_bytes.get(s, 0)
        held[k].append((slot_bytes.get(s, 0), s))
    for x in held:
        x.sort()
    fair = total / (new + 1)
    while load[new] < fair:
        k = max(range(new), key=lambda k: (load[k], -k))
        gap = fair - load[new]
        fit = [i for i, (n, _) in enumerate(held[k]) if 0 < n <= gap + 0.5 * fair / max(1, len(held[k]))]
        if not fit:
            break
        n, s = held[k].pop(fit[-1] if held[k][fit[-1]][0] <= gap else fit[0])
        out[s] = new
        load[k] -= n
        load[new] += n
    return SlotMap(old.version + 1, new + 1, old.slots, tuple(out), old.splits)


def write_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Append a version to the stored map; earlier versions stay readable."""
    slot_map.table(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the latest by default. The table has one row per slot and version."""
    df = spark.read.parquet(path)
    v = version if version is not None else df.agg(F.max("version")).first()[0]
    rows = sorted((r.vslot, r.shard, r.split_first, r.split_by) for r in df.where(F.col("version") == v).collect())
    splits = tuple((s, by) for _, s, by in sorted((first, s, by) for s, _, first, by in rows if by))
    return SlotMap(v, max(r[1] for r in rows) + 1, len(rows) - PARTS * len(splits), tuple(r[1] for r in rows), splits)


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def slot_records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, vslot`` and ``_h``, the text's hash, of every record. No shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h = F.xxhash64(text, F.octet_length(text))
    return docs.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.pmod(h, F.lit(slots)).cast("int").alias("vslot"), h.alias("_h"))


def _split(records: DataFrame, slots: int, splits: list[tuple[int, str]], since: int = 0) -> DataFrame:
    """Send the records of split slots on to the parts."""
    for i, (slot, by) in enumerate(splits[since:], since):
        key = F.xxhash64(F.lit(by), "_h" if by == "text" else "doc_id")
        part = (F.pmod(key, F.lit(PARTS)) + slots + i * PARTS).cast("int")
        records = records.withColumn("vslot", F.when(F.col("vslot") == slot, part).otherwise(F.col("vslot")))
    return records


def resolve(records: DataFrame, slot_map: SlotMap) -> DataFrame:
    """``slot_records`` with the slots that a map's splits lead to."""
    return _split(records, slot_map.slots, list(slot_map.splits))


def _totals(records: DataFrame) -> dict[int, int]:
    return {r.vslot: r.n for r in records.groupBy("vslot").agg(F.sum("size").alias("n")).collect()}  # one row per slot


def fit_map(records: DataFrame, shards: int = 16, slots: int = SLOTS) -> tuple[SlotMap, dict[int, int]]:
    """The first version of the map for ``slot_records`` and the bytes of each slot.

    Slots over a shard's fair share are split until none is left that a split could reduce: twice at most.
    """
    sizes = _totals(records)
    fair = sum(sizes.values()) / shards
    splits: list[tuple[int, str]] = []
    for by in ("text", "id"):
        large = [(s, by) for s in sorted(sizes) if sizes[s] > fair]  # fewer than shards
        if large:
            parts = _totals(_split(_split(records, slots, splits).where(F.col("vslot").isin([s for s, _ in large])), slots, splits + large, len(splits)))
            sizes = {s: n for s, n in sizes.items() if (s, by) not in large} | parts
            splits += large
    return build_map(sizes, shards, slots, tuple(splits)), sizes


def place(records: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Add ``shard`` and ``slot``, the record's place in its shard, gapless from 0.

    Places are numbered inside parts of virtual slots and shifted by the rows of the shard's earlier parts, so no task
    holds a whole slot; the list of parts is bounded by the number of slots.
    """
    spark = records.sparkSession
    parted = records.withColumn("_run", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(RUNS)).cast("int"))
    shard_of = F.broadcast(spark.createDataFrame(list(enumerate(slot_map.shard_of)), "vslot int, shard int"))
    rows = parted.groupBy("vslot", "_run").agg(F.count(F.lit(1)).alias("_rows")).join(shard_of, "vslot")
    earlier = Window.partitionBy("shard").orderBy("vslot", "_run").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")  # at most slots * RUNS rows
    w = Window.partitionBy("vslot", "_run").orderBy("doc_id", "text_crc32", "size")
    return parted.join(F.broadcast(before), ["vslot", "_run"]).withColumn("slot", F.row_number().over(w).cast("long") - 1 + F.col("_before")).drop("_before", "_run", "_h")


def assign_shards(docs: DataFrame, shards: int = 16, slots: int = SLOTS) -> tuple[DataFrame, SlotMap, dict[int, int]]:
    """Placed records, the map's first version and the bytes per slot."""
    records = materialise(slot_records(docs, slots), "slots")
    slot_map, sizes = fit_map(records, shards, slots)
    return place(resolve(records, slot_map), slot_map), slot_map, sizes


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: all documents into 16 shards under the law ``bytes``."""
    placed, _, _ = assign_shards(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))
