"""Graph operators over an edge table ``src, dst, rel, weight``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions import text as X
from lorespark.operators import labels
from lorespark.operators.ranks import positions
from lorespark.session import materialise, shared_path

MAX_LINKS = 5
#: A stored frontier of at most so many ids goes to the edges; a larger one is shuffled with them.
FEW = 50_000


def fixture_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> order -> part and supplier, customer -> nation -> region, as prefixed ids."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    node = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    parts = [
        ("orders", "c", "o_custkey", "o", "o_orderkey", "placed"),
        ("lineitem", "o", "l_orderkey", "p", "l_partkey", "contains"),
        ("lineitem", "o", "l_orderkey", "s", "l_suppkey", "supplied_by"),
        ("customer", "c", "c_custkey", "n", "c_nationkey", "lives_in"),
        ("nation", "n", "n_nationkey", "r", "n_regionkey", "part_of"),
    ]
    # a relation comes from one table, so its keys are made distinct before they become long texts
    return reduce(DataFrame.unionByName, [read(t).select(a, b).distinct().select(node(p, a).alias("src"), node(q, b).alias("dst"), F.lit(rel).alias("rel")) for t, p, a, q, b, rel in parts])


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new).dropDuplicates(["src", "dst", "rel"])


def remove_node(edges: DataFrame, node: str) -> DataFrame:
    return edges.where((F.col("src") != node) & (F.col("dst") != node))


def out_edges(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node)


def in_edges(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("dst") == node)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def _step(frontier: DataFrame, hops: DataFrame) -> DataFrame:
    """A stored frontier with its edges; they are shuffled only if the frontier, counted first, isn't small."""
    return hops.join(F.broadcast(frontier) if frontier.limit(FEW + 1).count() <= FEW else frontier, "id")


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, relations: Sequence[str] | None = None) -> DataFrame:
    """``id, depth`` of every node within ``depth`` steps of ``seeds(id, depth)``; the least depth of each.

    A level joins the frontier to the edges, which should be a stored table, and leaves out what is known; the state is
    cut through the shared folder, so plans stay short and no level is computed twice.
    """
    if relations is not None:
        edges = edges.where(F.col("rel").isin(list(relations)))
    hops = edges.select(F.col("src").alias("id"), "dst")
    seen = frontier = materialise(seeds.groupBy("id").agg(F.min("depth").alias("depth")), "bfs")
    for level in range(depth):
        step = _step(frontier, hops).groupBy(F.col("dst").alias("id")).agg((F.min("depth") + 1).alias("depth"))
        frontier = materialise(step.join(seen.select("id"), "id", "left_anti"), "bfs")
        if level + 1 < depth and not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def seeds_of(spark: SparkSession, ids: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(i, 0) for i in ids], "id string, depth int")


def bidirectional(edges: DataFrame, seeds: DataFrame, depth: int, relations: Sequence[str] | None = None) -> DataFrame:
    """Forward from the seeds, then backward from everything found; the least depth of each node.

    Depths grow level by level, and a level leaves out what is already as near, so each node is expanded once a depth.
    """
    reach = materialise(bfs(edges, seeds, depth, relations), "bfs-forward")
    hops = reverse(edges if relations is None else edges.where(F.col("rel").isin(list(relations)))).select(F.col("src").alias("id"), "dst")
    for level in range(depth):
        step = _step(reach.where(F.col("depth") == level), hops).select(F.col("dst").alias("id")).distinct()
        new = step.join(reach.where(F.col("depth") <= level + 1).select("id"), "id", "left_anti").withColumn("depth", F.lit(level + 1))
        if level + 1 < depth:
            new = materialise(new, "bfs-backward")
        reach = reach.unionByName(new)
    return reach.groupBy("id").agg(F.min("depth").alias("depth"))


def scored(found: DataFrame) -> DataFrame:
    return found.withColumn("score", 1.0 / (1.0 + F.col("depth")))


def shortest_paths(edges: DataFrame, source: str, targets: Sequence[str]) -> dict[str, int | None]:
    """Hops from ``source`` to each target along edge directions; 0 for the source itself, None if it isn't reached.

    The search goes on, however deep, until all targets are reached or the frontier is empty.
    """
    spark = edges.sparkSession
    hops = edges.select(F.col("src").alias("id"), "dst")
    found: dict[str, int | None] = {t: 0 if t == source else None for t in targets}
    seen = frontier = seeds_of(spark, [source]).select("id")
    for depth in count(1):
        missing = [t for t, n in found.items() if n is None]
        if not missing:
            break
        step = _step(frontier, hops).select(F.col("dst").alias("id")).distinct()
        frontier = materialise(step.join(seen, "id", "left_anti"), "path")
        got = frontier.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("id").isin(missing), F.col("id"))).alias("hit")).first()
        found |= dict.fromkeys(got.hit, depth)
        if not got.n:
            break
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:  # long searches keep a short plan
            seen = materialise(seen, "path-seen")
    return found


def shortest_path(edges: DataFrame, source: str, target: str) -> int | None:
    """Hops from ``source`` to ``target``, as in ``shortest_paths``."""
    return shortest_paths(edges, source, [target])[target]


def counts(edges: DataFrame) -> DataFrame:
    """One row: nodes (sources and targets) and edges."""
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # two single rows


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: the least id of each weakly connected component.

    A pass of the numbered edges gives, from a union-find inside each task, the smallest root that each root is joined
    with; roots hook onto those until no edge joins two of them, so every pass has fewer roots than the one before.
    """
    spark = edges.sparkSession
    nodes, pairs, count = labels.numbered(edges)
    paths: list[str] = []
    while True:
        path = shared_path(spark, "hooks")
        labels.hook(spark, pairs, paths, count).write.parquet(path)
        if not spark.read.schema("a long, b long").parquet(path).limit(1).count():
            break
        paths.append(path)
    return labels.named(materialise(labels.labelled(nodes, paths, count), "roots"), nodes, count, "component")


def communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """``id, community`` by synchronous label propagation, at most ``rounds`` times.

    A node takes the commonest label among its neighbours and itself, the smallest of several. All nodes move at once,
    so the result doesn't depend on an order; the node's own vote keeps pairs from swapping labels for ever.
    """
    spark = edges.sparkSession
    nodes, pairs, count = labels.numbered(edges)
    own = nodes.select(F.col("n").alias("a"), F.col("n").alias("b"))
    pairs = spark.read.schema("a long, b long").parquet(pairs)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(own)
    # equal edges lie in one range, so they are made distinct without another shuffle
    near = labels.store(both.repartitionByRange("a", "b").distinct().sortWithinPartitions("a", "b"), "lpa-edges")
    path = None
    for _ in range(rounds):
        path = labels.vote(spark, near, path, count)
        if not labels.decided(spark, path).where("c <> old").limit(1).count():
            break
    last = labels.decided(spark, path).select("a", "c") if path else own.select("a", F.col("b").alias("c"))
    return labels.named(materialise(last, "lpa"), nodes, count, "community")


def summaries(groups: DataFrame, objects: DataFrame, most: int = 50, length: int = 280) -> DataFrame:
    """Communities of two and more: size and a digest of their first texts."""
    w = Window.partitionBy("community").orderBy("id")
    picked = groups.join(objects.select("id", "content"), "id").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    text = picked.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("_rn", X.digest(F.col("content"), length).alias("t")))).alias("_t"))
    size = groups.groupBy("community").agg(F.count(F.lit(1)).alias("members")).where("members >= 2")
    return size.join(text, "community").select("community", "members", X.digest(F.array_join(F.transform("_t", lambda s: s["t"]), " "), length).alias("summary"))


def co_mentions(mentions: DataFrame, order: str = "doc_id", last: int = MAX_LINKS, block: int = 1 << 16) -> DataFrame:
    """``src, dst, rel, weight`` both ways between an object and the ``last`` earlier ones with the same entity.

    Mentions are numbered by entity first; a window then sees a block of an entity's mentions and the ``last`` ones
    before it, so an entity that most objects mention is spread over many tasks.
    """
    kept = mentions.where("entity is not null").select("entity", "id", *([order] if order != "id" else []))
    ties = [order] if order == "id" else [order, "id"]
    at = F.col("_rank") - 1
    numbered = positions(kept, ["entity"], ties, "_rank").select("entity", "id", "_rank", F.floor(at / block).alias("_block"))
    tail = numbered.where((at % block >= block - last) | (F.lit(block) <= last)).select("entity", "id", "_rank", (F.col("_block") + 1).alias("_block"), F.lit(True).alias("_copy"))
    w = Window.partitionBy("entity", "_block").orderBy("_rank").rowsBetween(-last, -1)
    near = numbered.withColumn("_copy", F.lit(False)).unionByName(tail).withColumn("_past", F.collect_list("id").over(w)).where("not _copy")
    pairs = near.select("id", F.explode("_past").alias("other")).where("id <> other")
    # a pair is made distinct once and turned round afterwards: half the rows to hold and to shuffle
    once = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    both = once.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.src", "e.dst")
    return both.withColumn("rel", F.lit("co_mentions")).withColumn("weight", F.lit(0.5))
