"""Rank fusion, boosts, confidence and context packing."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import codes
from lorespark.functions import scores as S
from lorespark.functions import text as X
from lorespark.operators.ranks import positions
from lorespark.session import materialise

BASE_WEIGHTS = {"vector": 1.5, "fulltext": 1.2, "graph": 1.3, "metadata": 0.8, "time": 0.7}
#: Factors on the base weights by intent; ``summary`` and ``general`` have none.
INTENT_FACTORS = {
    "temporal": {"time": 1.8, "vector": 1.1},
    "entity_search": {"graph": 1.5, "fulltext": 1.3, "metadata": 1.2},
    "comparison": {"graph": 1.4, "vector": 1.2},
    "code_search": {"fulltext": 1.5},
    "factoid": {"fulltext": 1.3, "vector": 1.1},
    "explanation": {"vector": 1.3},
    "listing": {"metadata": 1.3, "fulltext": 1.2},
    "analytical": {"metadata": 1.4, "fulltext": 1.2},
}


def weights_for(intent: str, base: Mapping[str, float] = BASE_WEIGHTS) -> dict[str, float]:
    return {s: w * INTENT_FACTORS.get(intent, {}).get(s, 1.0) for s, w in base.items()}


def rank_hits(hits: DataFrame) -> DataFrame:
    """``step, source, id, rank`` of ``hits(step, source, id, score)``: ranks within a step, from 1, ties by id."""
    return positions(hits.select("step", "source", "id", "score"), ["step"], [F.desc("score"), "id"]).drop("score")


def fuse(ranked: DataFrame, weights: Mapping[str, float] = BASE_WEIGHTS, k: int = 60) -> DataFrame:
    """``id, score, sources, n_sources`` of ``rank_hits``: weighted reciprocal ranks, best score 1.

    Ranks are per step, so two steps on one source count twice; several sources add 15 % each.
    """
    table = F.create_map(*[x for s, v in weights.items() for x in (F.lit(s), F.lit(float(v)))])
    part = F.coalesce(table[F.col("source")], F.lit(1.0)) / (F.lit(float(k)) + F.col("rank"))
    fused = ranked.withColumn("_p", part).groupBy("id").agg(F.sum("_p").alias("_s"), F.array_sort(F.collect_set("source")).alias("_all"))
    n = F.size("_all").cast("long")
    boosted = fused.select("id", F.array_join("_all", "+").alias("sources"), n.alias("_n"), F.when(n > 1, F.col("_s") * (1 + 0.15 * (n - 1))).otherwise(F.col("_s")).alias("_s"))
    most = F.broadcast(boosted.agg(F.max("_s").alias("_m")))  # a single row
    return boosted.crossJoin(most).select("id", (F.col("_s") / F.col("_m")).alias("score"), "sources", F.col("_n").alias("n_sources"))


def rrf(hits: DataFrame, weights: Mapping[str, float] = BASE_WEIGHTS, k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of ``hits(step, source, id, score)``."""
    return fuse(rank_hits(hits), weights, k)


def best(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.orderBy(F.desc("score"), "id").limit(k)


def rank_signals(ranked: DataFrame, objects: DataFrame, k: int, now: str) -> DataFrame:
    """Boost the best ``3 k`` by importance and recency; the others keep their score. Only ``3 k`` rows meet the objects."""
    window = F.broadcast(best(ranked, 3 * k).select("id"))
    known = objects.select("id", "importance", "created_at").join(window, "id").where("importance is not null")
    r = S.recency(F.col("created_at"), F.lit(now).cast("timestamp"))
    known = known.groupBy("id").agg(F.max(S.boosted(F.lit(1.0), F.col("importance"), r)).alias("_boost"))
    return ranked.join(F.broadcast(known), "id", "left").withColumn("score", F.col("score") * F.coalesce("_boost", F.lit(1.0))).drop("_boost")


def retrieval_confidence(ranked: DataFrame, wanted: int) -> DataFrame:
    """One row over the ``wanted`` best: 0.7 x coverage + 0.3 x share found by several sources; 0 without results."""
    n, several = F.count(F.lit(1)), F.coalesce(F.avg((F.col("n_sources") > 1).cast("double")), F.lit(0.0))
    return best(ranked, wanted).agg(n.alias("found"), (0.7 * n / max(wanted, 1) + 0.3 * several).alias("confidence"))


def context(ranked: DataFrame, budget: int = 4096, min_score: float = 0.05, limit: int = 2000) -> DataFrame:
    """Chunks in order of score while their token sum stays within ``budget``; the first always stays.

    ``ranked`` is a result list that was cut to its k best, so the running sum sees k rows.
    """
    chunks = ranked.where(F.col("score") >= min_score).withColumn("content", X.trim_chunk(F.col("content"), limit)).withColumn("tokens", X.token_estimate(F.col("content")))
    w = Window.orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("running", F.sum("tokens").over(w)).withColumn("position", F.row_number().over(w)).where((F.col("running") <= budget) | (F.col("position") == 1))


def drop_similar(ranked: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Greedily drop results whose word set is too like a better one's; at most the k kept rows meet."""
    a = ranked.select(F.col("id").alias("id_a"), F.col("score").alias("score_a"), X.word_set(F.col("content")).alias("words_a"))
    b = ranked.select(F.col("id").alias("id_b"), F.col("score").alias("score_b"), X.word_set(F.col("content")).alias("words_b"))
    better = (F.col("score_a") > F.col("score_b")) | ((F.col("score_a") == F.col("score_b")) & (F.col("id_a") < F.col("id_b")))
    alike = a.join(b, better & (X.jaccard(F.col("words_a"), F.col("words_b")) >= threshold)).select("id_a", "id_b", "score_a", "score_b").collect()  # pairs of k rows
    gone: set[str] = set()
    for r in sorted(alike, key=lambda r: (-r.score_a, r.id_a, -r.score_b, r.id_b)):
        if r.id_a not in gone:
            gone.add(r.id_b)
    return ranked.where(~F.col("id").isin(sorted(gone))) if gone else ranked


def word_classes(docs: DataFrame, id_col: str = "id", col: str = "content") -> tuple[DataFrame, DataFrame]:
    """``(members, classes)``: rows with words and the class (least id) of their equal word set; each class's words once."""
    words = docs.select(F.col(id_col).alias("id"), F.array_sort(X.word_set(F.col(col))).alias("w")).where(F.size("w") > 0)
    words = materialise(words.withColumn("h", F.xxhash64("w")), "words")
    # rows of one set are folded task by task; the words themselves are shuffled once per class and task
    heads = words.groupBy("h", "w").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(heads, "word-classes")
    hot = classes.select("h").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")  # two sets with one hash
    plain = classes.join(hot, "h", "left_anti").select("h", "class_id")
    members = words.select("id", "h").join(plain.hint("shuffle_hash"), "h").select("id", "class_id")
    odd = words.join(hot, "h", "left_semi").join(classes.select("h", "w", "class_id"), ["h", "w"]).select("id", "class_id")
    return members.unionByName(odd), classes.select("class_id", "w", "copies")


#: Sets that are signed at a time.
SIGNED = 512


def _bands(largest: int, widen: float) -> np.ndarray:
    """Where bands of sizes begin, to two beyond ``largest``: a size and ``widen`` times it lie in one or in neighbours."""
    ends = [1]
    while len(ends) < 3 or ends[-3] <= largest:
        ends.append(max(ends[-1] + 1, int(np.floor(ends[-1] * widen + 1e-6)) + 1))
    return np.array(ends)


def _unlike(threshold: float, words: Column | int) -> Column:
    """How many words at most two sets of together ``words`` words differ in if they are that alike."""
    return F.floor(F.lit((1 - threshold) / (1 + threshold)) * words + 1e-9).cast("int")


def _signed(classes: DataFrame, threshold: float) -> DataFrame:
    """``class_id, n, own, key, s0..s3``: signatures of which two similar sets share at least one; see ``similar_classes``."""
    widen, share = 1 / max(threshold, 1e-3), (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, SIGNED) for i in range(0, len(whole), SIGNED)):
                words = batch.column(1)
                h = codes.mixed(words.flatten().to_numpy().view(np.uint64))
                n = np.diff(words.offsets.to_numpy())
                row = np.repeat(np.arange(len(n)), n)
                bit = np.zeros((len(n), 256), np.uint8)
                np.add.at(bit, (row, (h >> np.uint64(56)).astype(np.int64)), 1)
                sketch = np.packbits(bit & 1, axis=1).view(np.int64)
                ends = _bands(int(n.max(initial=1)), widen)
                band = np.searchsorted(ends, n, side="right") - 1
                for own in (True, False):
                    scheme = band if own else band + 1
                    parts = np.floor(share * 2 * (ends[scheme + 1] - 1) + 1e-9).astype(np.int64) + 1
                    start = np.concatenate([[0], np.cumsum(parts)])
                    at = start[row] + (h & np.uint64(0xFFFFFFFF)).astype(np.int64) % parts[row]
                    total = np.zeros(start[-1], np.uint64)
                    np.add.at(total, at, codes.mixed(h + np.uint64(1)))
                    mine = np.repeat(np.arange(len(n)), parts)
                    place = (np.arange(start[-1]) - start[mine]).astype(np.uint64)
                    key = codes.mixed(total ^ codes.mixed(place + (scheme[mine].astype(np.uint64) << np.uint64(40)) + np.uint64(1))).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(mine)), pa.array(n[mine].astype(np.int32)), pa.array(np.full(len(mine), own)), pa.array(key), *(pa.array(np.ascontiguousarray(sketch[mine, i])) for i in range(4))],
                        ["class_id", "n", "own", "key", "s0", "s1", "s2", "s3"],
                    )

    kind = dict(classes.dtypes)["class_id"]
    hashed = classes.select("class_id", F.transform("w", lambda t: F.xxhash64(t)).alias("h"))
    return hashed.mapInArrow(run, f"class_id {kind}, n int, own boolean, key long, s0 long, s1 long, s2 long, s3 long")


def similar_classes(classes: DataFrame, threshold: float, hot: int = 1000) -> DataFrame:
    """Exact pairs ``id_a, id_b, jaccard`` of classes whose word sets have a Jaccard of at least ``threshold``.

    Two sets of n and m words that are that alike differ in at most ``d = (1 - t) / (1 + t) * (n + m)`` words. If all
    words are dealt by their hash into more than d parts, the sets agree on a whole part: its words, hashed, are a
    signature that unlike sets rarely share, however common their words are. The number of parts goes by the larger set's
    band of sizes (a factor of ``1 / t`` wide); a set also signs for the band above its own. Candidates that share a
    signature are dropped before they leave the join if the parities of their words in 256 slots differ in more than d
    slots, which is no more than the sets do. A signature of more than ``hot`` classes is salted: one side is split, the
    other repeated.
    """
    signed = materialise(_signed(classes, threshold), "signatures")
    crowds = signed.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") > hot)
    crowds = materialise(crowds.select("key", F.ceil(F.col("f") / hot).cast("int").alias("salts")), "hot-signatures")
    if crowds.limit(1).count():
        salted = signed.join(crowds.hint("shuffle_hash"), "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    else:
        salted = signed.withColumn("salts", F.lit(1))
    side = lambda c: [F.col(x).alias(f"{x}_{c}") for x in ("class_id", "n", "s0", "s1", "s2", "s3")]
    # the larger set (of equal ones the later id) is in the band whose parts are compared
    left = salted.where("own").select("key", F.pmod(F.xxhash64("class_id"), F.col("salts")).cast("int").alias("salt"), *side("a"))
    right = salted.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *side("b"))
    later = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("class_id_a") > F.col("class_id_b")))
    apart = sum((F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(4)), F.lit(0))
    near = (F.col("n_b") >= F.lit(threshold) * F.col("n_a") - 1e-9) & (apart <= _unlike(threshold, F.col("n_a") + F.col("n_b")))
    met = left.join(right, (left["key"] == right["key"]) & (left["salt"] == right["salt"]) & later & near)
    pairs = met.select(F.least("class_id_a", "class_id_b").alias("id_a"), F.greatest("class_id_a", "class_id_b").alias("id_b")).distinct()
    a, b = classes.select(F.col("class_id").alias("id_a"), F.col("w").alias("w_a")), classes.select(F.col("class_id").alias("id_b"), F.col("w").alias("w_b"))
    return pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", X.jaccard(F.col("w_a"), F.col("w_b")).alias("jaccard")).where(F.col("jaccard") >= threshold)


def similar_members(members: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, class_id, links``: how many other rows are that similar (copies included), without listing them."""
    both = pairs.select(F.col("id_a").alias("class_id"), F.col("id_b").alias("other")).unionByName(pairs.select(F.col("id_b").alias("class_id"), F.col("id_a").alias("other")))
    near = both.join(classes.select(F.col("class_id").alias("other"), "copies"), "other").groupBy("class_id").agg(F.sum("copies").alias("near"))
    links = classes.select("class_id", "copies").join(near, "class_id", "left").select("class_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    return members.join(links.hint("shuffle_hash"), "class_id").select("id", "class_id", "links")
