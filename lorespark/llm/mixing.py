"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in hash order, are cut into blocks. In a round every source has as many blocks as its whole
weight, or what it has left; a round has one slot per block. Block j of a source with u blocks in a round of P slots is
released at slot floor(j P / u) and due by slot ceil((j + 1) P / u); earliest deadline first over the released blocks
fills every slot, and after any number of slots every source is less than one block from its share of the round. Rounds
repeat until some source has less than its weight left, so a schedule has few kinds of rounds (phases), however much data
there is. Nothing is dropped or repeated. The last block of a source may be short.

Sources with equal weight and equal numbers of blocks have the same windows. They are scheduled as one class, whose
blocks with one window are a single job of many units; the schedule's size depends on the number of classes (at most the
square root of twice the number of blocks, times the number of weights), not on that of sources.

Defined cases: a null source is a source of its own; sources without a weight get ``default_weight``; a null doc_id is
ordered first by its hash; repeated rows are placed each, in the order of their texts' hash; an empty table gives an
empty result; other columns are kept, but ``mix_order`` replaces those named like one it adds (``mixed`` keeps them all).
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.session import materialise

BLOCK = 16
#: Parts, by hash, in which the documents of a source, and the sources of a class, are numbered.
BUCKETS = 1024
#: Target parts of the registered query: the dominant source is held to four, the others get one to three.
WEIGHTS = {"src0": 4, **{f"src{k}": 1 + k % 3 for k in range(1, 20)}}
ADDED = ("mix_block", "mix_slot", "mix_phase", "mix_release", "mix_deadline", "mix_position")


@dataclass(frozen=True)
class Phase:
    """Equal rounds: the first slot, slots of a round, rounds, blocks of a source in one, and each class's runs of slots.

    The units of a class in a round are its first blocks, source by source, then its second ones; ``units[c]`` and
    ``slots[c]`` say at which slot of the round each run of units starts.
    """

    start: int
    period: int
    rounds: int
    first: dict[int, int]
    quota: dict[int, int]
    units: dict[int, np.ndarray]
    slots: dict[int, np.ndarray]


def one_round(classes: Sequence[tuple[int, int, int]]) -> tuple[int, dict[int, tuple[list[int], list[int]]]]:
    """Earliest deadline first over one round of ``(class, members, blocks of each)``.

    Returns the slots of the round and, per class, where its runs of units start and at which slots. Ties go to the
    class with more blocks, then to the earlier one.
    """
    period = sum(m * u for _, m, u in classes)
    # (release, deadline, rank, class, first unit, units): the members' j-th blocks share a window
    jobs = sorted((j * period // u, -(-(j + 1) * period // u), (-u, k), c, j * m, m) for k, (c, m, u) in enumerate(classes) for j in range(u))
    runs: dict[int, tuple[list[int], list[int]]] = {c: ([], []) for c, *_ in classes}
    ready: list[list] = []
    t = at = 0
    while t < period:
        while at < len(jobs) and jobs[at][0] <= t:
            _, due, rank, c, unit, n = jobs[at]
            heapq.heappush(ready, [due, rank, c, unit, n])
            at += 1
        job = ready[0]
        n = min(job[4], jobs[at][0] - t) if at < len(jobs) else job[4]  # until the next release, which may be more urgent
        runs[job[2]][0].append(job[3])
        runs[job[2]][1].append(t)
        t += n
        if n == job[4]:
            heapq.heappop(ready)
        else:
            job[3], job[4] = job[3] + n, job[4] - n  # the order of the heap stays
    return period, runs


def phases(classes: Sequence[tuple[int, int, int]]) -> list[Phase]:
    """The whole schedule of ``(weight, blocks, members)`` classes; class c is the c-th of them."""
    left = {c: b for c, (_, b, _) in enumerate(classes) if b > 0}
    start, out = 0, []
    while left:
        quota = {c: min(classes[c][0], n) for c, n in left.items()}
        rounds = min(n // quota[c] for c, n in left.items())
        period, runs = one_round([(c, classes[c][2], u) for c, u in quota.items()])
        first = {c: classes[c][1] - n for c, n in left.items()}
        out.append(Phase(start, period, rounds, first, quota, {c: np.array(r[0], np.int64) for c, r in runs.items()}, {c: np.array(r[1], np.int64) for c, r in runs.items()}))
        start += period * rounds
        left = {c: n - rounds * quota[c] for c, n in left.items() if n > rounds * quota[c]}
    return out


def schedule(plan: Sequence[Phase], members: Mapping[int, int], c: int, member: np.ndarray, block: np.ndarray) -> np.ndarray:
    """``slot, phase, release, deadline`` (four rows) of blocks of members of class ``c``."""
    own = [k for k, p in enumerate(plan) if c in p.first]
    which = np.searchsorted([plan[k].first[c] for k in own], block, side="right") - 1
    out = np.zeros((4, len(block)), np.int64)
    for x in np.unique(which):
        p, mine = plan[own[x]], np.flatnonzero(which == x)
        u = p.quota[c]
        turn, j = np.divmod(block[mine] - p.first[c], u)
        unit = j * members[c] + member[mine]
        run = np.searchsorted(p.units[c], unit, side="right") - 1
        base = p.start + turn * p.period
        out[:, mine] = base + p.slots[c][run] + unit - p.units[c][run], np.full(len(mine), own[x]), base + j * p.period // u, base - (-(j + 1) * p.period // u)
    return out


def _numbered(df: DataFrame, keys: list[str], hash_: str, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``, each row's place from 0 among those of its keys, in the order of a hash.

    Rows are numbered in hash ranges and shifted by the rows of earlier ranges, so a key with many rows is spread; the
    shift comes by a join on the very keys and range by which the rows are shuffled anyway.
    """
    df = df.withColumn("_b", F.pmod(F.shiftright(hash_, 40), F.lit(BUCKETS)).cast("int"))
    counts = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    w = Window.partitionBy(*keys, "_b").orderBy(hash_, *order)
    return df.join(before.hint("merge"), [*keys, "_b"]).withColumn(out, F.row_number().over(w) - 1 + F.col("_before")).drop("_b", "_before")


def mix_order(docs: DataFrame, weights: Mapping[str, int] | None = None, default_weight: int = 1, block: int = BLOCK, source: str = "source") -> DataFrame:
    """``docs`` with ``mix_block`` (of its source), ``mix_slot``, ``mix_phase``, ``mix_release``, ``mix_deadline`` and ``mix_position``.

    ``mix_position`` orders all documents by slot, then by place in the block: ``slot * block`` and the place, so a short
    last block leaves numbers out. The driver sees one row per class of sources, never one per source.
    """
    weights = dict(weights or {})
    spark = docs.sparkSession
    docs = docs.drop(*ADDED)
    names = docs.columns
    text = F.xxhash64("text") if "text" in names else F.lit(0)
    # a null source gets a key of its own, so that keys can be joined and shuffled like any others
    keyed = docs.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))).withColumn("_h", F.xxhash64("doc_id")).withColumn("_t", text)
    ranked = _numbered(keyed, ["_s"], "_h", ["doc_id", "_t"], "_rank")

    known = spark.createDataFrame([("-" if s is None else f"={s}", int(w)) for s, w in weights.items()], "_s string, _w int")
    sources = keyed.groupBy("_s").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks")).join(F.broadcast(known), "_s", "left")  # the caller's own table of weights
    sources = materialise(sources.select("_s", "_blocks", F.coalesce("_w", F.lit(default_weight)).alias("_w"), F.xxhash64("_s").alias("_sh")), "mix-sources")
    kinds = [(r["_w"], r["_blocks"], r.n) for r in sources.groupBy("_w", "_blocks").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("_w"), F.desc("_blocks")).collect()]
    plan, members = phases(kinds), {c: n for c, (*_, n) in enumerate(kinds)}
    sent = spark.sparkContext.broadcast((plan, members))  # its size goes by the classes
    table = spark.createDataFrame([(w, b, c) for c, (w, b, _) in enumerate(kinds)], "_w int, _blocks long, _c int")
    sources = _numbered(sources.join(F.broadcast(table), ["_w", "_blocks"]), ["_c"], "_sh", ["_s"], "_member").select("_s", "_c", "_member")
    out = _with_source(ranked, sources).select(*names, "_c", "_member", "_rank")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.IntegerType() if c == "mix_phase" else T.LongType()) for c in ADDED)])

    def run(batches):
        plan, members = sent.value
        for b in batches:
            n = len(b.schema.names)
            kind, member, rank = (b.column(k).to_numpy() for k in (n - 3, n - 2, n - 1))
            blocks = rank // block
            cols = np.zeros((4, len(b)), np.int64)
            for c in np.unique(kind):
                mine = np.flatnonzero(kind == c)
                cols[:, mine] = schedule(plan, members, int(c), member[mine], blocks[mine])
            add = [pa.array(blocks), pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[0] * block + rank % block)]
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 3], *add], [*b.schema.names[: n - 3], *ADDED])

    return out.mapInArrow(run, schema)


def _with_source(ranked: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document's source row. Few sources (``FEW`` at most, counted) come by broadcast, more by a salted join."""
    if sources.limit(FEW + 1).count() <= FEW:
        return ranked.join(F.broadcast(sources), "_s")
    salt = F.pmod(F.shiftright("_h", 16), F.lit(SALT)).cast("int")
    spread = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return ranked.withColumn("_salt", salt).join(spread.hint("merge"), ["_s", "_salt"]).drop("_salt")


#: A table of so many short rows may be broadcast; beyond it sources are joined, each in so many parts.
FEW, SALT = 65_536, 64


def mixed(docs: DataFrame, weights: Mapping[str, int] | None = None, **options) -> DataFrame:
    """The columns of ``docs``, its rows in mixed order (sorted by range, so written files follow it)."""
    names = docs.columns
    inner = docs.select("doc_id", "source", *(["text"] if "text" in names else []), F.struct(*[docs[c] for c in names if c not in ("doc_id", "source", "text")], F.lit(0).alias("_")).alias("_rest"))
    ordered = mix_order(inner, weights, **options).orderBy("mix_position")
    return ordered.select(*[F.col(c) if c in ("doc_id", "source", "text") else F.col("_rest")[c].alias(c) for c in names])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every document's block, slot, release, deadline and position."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix_order(materialise(docs, "mix-keys"), WEIGHTS).select("doc_id", "source", "mix_block", "mix_slot", "mix_phase", "mix_release", "mix_deadline", "mix_position")
