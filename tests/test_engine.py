"""Operators on small tables: the reference's kinds of fixtures, edge cases, and plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.functions import codes
from lorespark.functions import text as X
from lorespark.functions import vectors as V
from lorespark.operators import fusion, graph, objects, proximity, search
from lorespark.operators import vector_batch as vb
from lorespark.plans import ask, planner, sqlfront
from lorespark.sources import store
from lorespark.streaming import events

NOW = "2024-06-01 00:00:00"


@pytest.fixture(scope="module")
def trio(spark):
    rows = [
        ("a", "Acme raised a large round", {"stage": "b", "company": "acme"}, ["acme", "round"], 0.9),
        ("b", "Globex builds rockets", {"stage": "a", "company": "globex"}, ["globex"], 0.4),
        ("c", "Acme and Globex signed a deal", {"stage": "b", "company": "both"}, [], 0.7),
    ]
    df = spark.createDataFrame(rows, "id string, content string, metadata map<string,string>, keywords array<string>, importance double")
    return df.withColumn("created_at", F.lit("2024-05-01 00:00:00").cast("timestamp"))


def test_small_dialect(trio):
    run = lambda q: [r.id for r in sqlfront.run(trio, q).orderBy("id").collect()]
    assert run("SELECT id FROM knowledge WHERE metadata.stage = 'b' AND importance > 0.7") == ["a"]
    assert run("SELECT * FROM objects WHERE content LIKE '%Globex%'") == ["b", "c"]
    assert run("SELECT id FROM knowledge WHERE metadata.stage = 'none'") == []
    assert run("SELECT id FROM knowledge ORDER BY importance DESC LIMIT 1") == ["a"]
    for bad in ("SELECT id FROM knowledge WHERE id = 'a' OR id = 'b'", "SELECT * FROM other", "DELETE FROM knowledge"):
        with pytest.raises(ValueError):
            sqlfront.parse(bad)


def test_guard(spark, tmp_path):
    ok = ("SELECT\n' update ' AS x", "```sql\nWITH a AS (SELECT 1) SELECT * FROM a;\n```", "SELECT created_at, count(*) FROM t GROUP BY ALL HAVING count(*) > 1 ORDER BY 1 LIMIT 3", "SELECT * FROM t WHERE a IN (SELECT b FROM t) AND EXISTS (SELECT 1 FROM t)", "VALUES (1), (2)", "SELECT x, sum(x) OVER w FROM t LATERAL VIEW explode(array(1)) e AS x WINDOW w AS (ORDER BY x)")
    for q in ok:
        assert sqlfront.is_read_only(spark, q, ["t"]), (q, sqlfront.refusal(spark, q, ["t"]))
    out = tmp_path / "out"
    bad = (
        "DROP TABLE t", "INSERT INTO t VALUES (1)", "SELECT 1; DELETE FROM t", "SET a=b", "CREATE TABLE a AS SELECT 1", "not sql", "", "UPDATE t SET a = 1", "MERGE INTO t USING t ON 1 = 1 WHEN MATCHED THEN DELETE", "TRUNCATE TABLE t", "CALL p()",
        f"INSERT OVERWRITE DIRECTORY '{out}' USING parquet SELECT 1 AS x", "REPLACE TABLE t USING parquet AS SELECT 1", "CACHE TABLE t AS SELECT 1", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "FROM t INSERT INTO t SELECT *", "ALTER TABLE t ADD COLUMNS (x int)", "DECLARE VARIABLE x INT",
        "SELECT reflect('java.lang.System', 'getenv', 'HOME')", "SELECT java_method('java.lang.Math', 'abs', 1)", "SELECT 1 WHERE 1 IN (SELECT try_reflect('java.lang.System', 'exit', 0))", "SELECT * FROM parquet.`/root`", "SELECT * FROM other", "SELECT * FROM (SELECT * FROM db.t)", "WITH a AS (SELECT * FROM other) SELECT * FROM a", "SELECT (SELECT max(x) FROM other)", "EXPLAIN SELECT 1", "SHOW TABLES", "DESCRIBE t", "EXECUTE IMMEDIATE 'DROP TABLE t'", "ADD JAR 'x'", "USE default", "REFRESH TABLE t",
    )
    for q in bad:
        assert not sqlfront.is_read_only(spark, q, ["t"]), q
        with pytest.raises(ValueError):
            sqlfront.select(spark, q, {"t": spark.range(1)})
    assert not out.exists()
    a, b = spark.range(3), spark.range(5)
    one, two = sqlfront.select(spark, "SELECT count(*) AS n FROM t", {"t": a}), sqlfront.select(spark, "SELECT count(*) AS n FROM t", {"t": b})
    assert (one.first().n, two.first().n) == (3, 5) and not spark.catalog.tableExists("t")  # no view is left or overwritten


@pytest.mark.parametrize(
    "question, intent",
    [
        ("Compare Acme with Globex", "comparison"),
        ("Which enterprise customers renewed after January 2024?", "temporal"),
        ("How many customers churned?", "analytical"),
        ("What is the average deal size?", "analytical"),
        ("How does replication work?", "explanation"),
        ("Which companies raised Series A funding?", "entity_search"),
        ("what happened after lunch", "factoid"),
        ("List the parts", "listing"),
        ("the function of a bug", "code_search"),
        ("hello there", "general"),
    ],
)
def test_intents(spark, question, intent):
    assert planner.analyse(question).intent == intent
    assert spark.range(1).select(X.intent(F.lit(question))).first()[0] == intent


def test_driver_and_column_analysis_agree(spark):
    from lorespark.plans.core_queries import PROBES

    rows = spark.createDataFrame([(p,) for p in PROBES], "text string")
    t = F.col("text")
    for r in rows.select("text", X.intent(t).alias("i"), X.named_entities(t).alias("e"), X.dates(t).alias("d"), X.keywords(t).alias("k"), X.intent_confidence(t).alias("c"), X.is_comparison(t).alias("cmp"), X.is_code(t).alias("code")).collect():
        q = planner.analyse(r.text)
        assert (q.intent, list(q.entities), list(q.dates), list(q.keywords), q.comparison, q.code) == (r.i, r.e, r.d, r.k, r.cmp, r.code), r.text
        assert abs(q.confidence - r.c) < 1e-9


def test_planner_and_cache():
    q = planner.analyse("How many deals did Acme sign since 2023? lang:en")
    assert q.intent == "temporal" and q.entities[0] == "Acme" and q.filters == {"lang": "en"} and "2023" in q.dates
    assert planner.actions(q) == ("time", "vector", "fulltext", "graph", "metadata")
    assert planner.actions(planner.analyse("hello")) == ("vector", "fulltext")
    assert planner.actions(planner.analyse("where is the source")) == ("code", "fulltext", "vector")
    assert planner.actions(planner.analyse("average of all")) == ("metadata", "fulltext", "vector")
    p = planner.plan(planner.analyse("compare apples and pears"))
    assert [(s.kind, s.limit) for s in p.steps] == [("vector", 20), ("fulltext", 20), ("graph", 10)] and p.cost == 3.0
    clock = [0.0]
    cache = planner.PlanCache(2, 10, lambda: clock[0])
    for t in ("a", "a", "b", "c", "a"):
        cache.get(t)
    assert (cache.hits, cache.misses) == (1, 4)
    clock[0] = 11
    cache.get("c")
    assert cache.misses == 5


def test_intent_weights_turn_the_ranking(spark):
    hits = spark.createDataFrame([(0, "vector", "v", 0.9), (1, "graph", "g", 0.9)], "step int, source string, id string, score double")
    first = lambda i: fusion.best(fusion.rrf(hits, fusion.weights_for(i)), 1).first().id
    assert (first("general"), first("entity_search"), first("summary")) == ("v", "g", "v")


def test_positions_of_large_groups(spark):
    from lorespark.operators.ranks import positions

    df = spark.range(20_000).select((F.col("id") % 3 == 0).cast("int").alias("g"), (F.col("id") * 7919 % 20_011).alias("x"), "id").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = positions(df, ["g"], [F.desc("x"), "id"]).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for _, rows in got.groupby("g"):
        assert rows.sort_values("x", ascending=False)["rank"].tolist() == list(range(1, len(rows) + 1))


def test_co_mentions_of_a_hot_entity(spark):
    rows = [("hot", i) for i in range(300)] + [("rare", i) for i in (5, 100, 290)] + [(None, 1)]
    df = spark.createDataFrame(rows, "entity string, id long")
    want = {(i, j) for i in range(300) for j in range(max(0, i - 5), i)} | {(100, 5), (290, 5), (290, 100)}
    for block in (1 << 16, 16):
        got = {(r.src, r.dst) for r in graph.co_mentions(df, "id", block=block).collect()}
        assert got == want | {(b, a) for a, b in want}


def test_similar_classes_with_hot_words(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 14, 12)) for _ in range(150)] + ["same words here", "here same words", "words here same", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    sets = [set((t or "").split()) for t in texts]
    alike = lambda a, b: len(a & b) / len(a | b) >= 0.85 if a and b else False
    for hot in (1000, 5):
        members, classes = fusion.word_classes(df)
        pairs = fusion.similar_classes(classes, 0.85, hot)
        got = {r.id: (r.class_id, r.links) for r in fusion.similar_members(members, classes, pairs).collect()}
        assert got == {i: (min(j for j, t in enumerate(sets) if t == s), sum(alike(s, t) for j, t in enumerate(sets) if j != i)) for i, s in enumerate(sets) if s}


def test_text_index_of_objects(spark, trio, tmp_path):
    index = search.build_text_index(trio, search.object_fields(), str(tmp_path / "i"))
    assert {(r.id, r.field) for r in index.postings.where("term = 'acme'").collect()} == {("a", "content"), ("c", "content"), ("a", "keywords"), ("a", "metadata")}
    assert [r.id for r in search.bm25_index(index, ["acme", "acme"], 5).collect()] == ["a", "c"] and search.bm25_index(index, [], 5).count() == 0
    assert index.docs == 3 and search.load_text_index(spark, str(tmp_path / "i")).mean == index.mean
    empty = search.build_text_index(trio.limit(0), search.object_fields(), str(tmp_path / "e"))
    assert empty.docs == 0 and search.bm25_index(empty, ["acme"]).count() == 0


def test_ask_prefers_important_and_filters(trio):
    corpus = ask.Corpus(trio, None, None, NOW)
    got = ask.ask(corpus, "tell me about Acme", 3).collect()
    assert [r.id for r in got][0] == "a"
    only = ask.ask(corpus, "tell me about Acme", 3, metadata={"company": "both"}).collect()
    assert [r.id for r in only] == ["c"]
    packed = ask.ask(corpus, "tell me about Acme", 3, budget=7).collect()
    assert len(packed) == 1
    assert ask.ask(corpus, "zzz", 3).collect() == []


def test_corrective_pass(trio, monkeypatch):
    """One weak hit is too little: the question is searched once more, wider; a confident result isn't."""
    seen = []
    whole = ask.corrective
    monkeypatch.setattr(ask, "corrective", lambda *a, **k: seen.append(1) or whole(*a, **k))
    corpus = ask.Corpus(trio, None, None, NOW)
    got = ask.ask(corpus, "tell me rockets", 10).collect()
    assert [r.id for r in got] == ["b"] and seen == [1]
    assert len(ask.ask(corpus, "Acme", 2).collect()) == 2 and seen == [1]
    # the wider pass takes stop words too: here only they match
    assert [r.id for r in ask.ask(corpus, "which and why", 10).collect()] == ["c"] and len(seen) == 2


def test_ask_from_the_stored_index_and_graph(spark, trio, tmp_path):
    index = search.build_text_index(trio, search.object_fields(), str(tmp_path / "i"))
    edges = spark.createDataFrame([("c", "x", "r"), ("y", "c", "r"), ("x", "z", "r"), ("z", "w", "r")], "src string, dst string, rel string")
    got = {r.id: r.sources for r in ask.ask(ask.Corpus(trio, None, edges, NOW, index), "which deal of Acme", 10).collect()}
    assert got["c"] == "fulltext" and got["x"] == got["y"] == got["z"] == "graph" and "w" not in got  # two steps for a named entity
    loaded = {r.id: r.content for r in ask.ask(ask.Corpus(trio, None, edges, NOW, index), "deal", 10).collect()}
    assert loaded["x"] == "<Object x>" and "z" not in loaded  # one step otherwise


def test_graph_chain(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("a", "d", "s"), ("x", "y", "r")], "src string, dst string, rel string")
    found = {r.id: r.depth for r in graph.bfs(e, graph.seeds_of(spark, ["a"]), 5).collect()}
    assert found == {"a": 0, "b": 1, "c": 2, "d": 1}
    assert {r.id for r in graph.bfs(e, graph.seeds_of(spark, ["a"]), 5, ["r"]).collect()} == {"a", "b", "c"}
    assert graph.shortest_path(e, "a", "c") == 2 and graph.shortest_path(e, "a", "a") == 0 and graph.shortest_path(e, "a", "x") is None
    assert {r.id: r.component for r in graph.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    tri = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "1"), ("4", "5"), ("5", "6"), ("6", "4")], "src string, dst string")
    groups = {}
    for r in graph.communities(tri).collect():
        groups.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [["1", "2", "3"], ["4", "5", "6"]]
    pair = spark.createDataFrame([("p", "q"), ("q", "p"), ("p", "p")], "src string, dst string")
    assert {r.id: r.community for r in graph.communities(pair).collect()} == {"p": "p", "q": "p"}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in search.knn(df, [1.0, 0.0], 3).collect()] == [1, 4, 2]
    bits = df.select(V.hamming(V.sign_bits(F.col("embedding")), V.sign_bits(V.literal([-1.0, -1.0]))).alias("h")).collect()
    assert [r.h for r in bits] == [2, 2, 2, 2]


def brute(x, q, k):
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    return [sorted(range(len(x)), key=lambda j: (-round(1 / (1 + r[j]), 9), j))[:k] for r in d]


@pytest.mark.parametrize("scorer", ["l2", "sign_codes", "prefix", "prefix_wide"])
def test_batch_search_is_exact(spark, scorer, monkeypatch):
    monkeypatch.setattr(vb, "CHUNK", 7)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 12)) + rng.integers(0, 4, 300)[:, None] * 2, np.zeros((3, 12)), np.ones((4, 12))]).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [1.0]), (1100, None)], "vec_id long, embedding array<float>").repartition(3)
    q = vb.store_queries(df.where("vec_id < 1000"), F.expr("vec_id % 50 = 0"))
    f = {"l2": vb.l2, "sign_codes": vb.sign_codes(1), "prefix": vb.prefix(3, 1), "prefix_wide": vb.prefix(12, 2)}[scorer]
    got = {}
    for r in vb.search(df, q, 10, f).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == dict(zip(range(0, len(x), 50), brute(x, x[::50], 10)))
    assert vb.store_queries(df.limit(0), F.expr("vec_id % 50 = 0")) is None and vb.search(df, None, 5).count() == 0


def test_codes():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(400, 50)), rng.normal(size=(20, 50))
    r = codes.rotate(x)
    assert r.shape == (400, 64) and np.allclose((r * r).sum(1), (x * x).sum(1))
    h = np.array([[1.0]])
    while len(h) < 64:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(codes.walsh_hadamard(np.eye(64)), h)
    c, d2 = codes.SignCodes.of(x), ((q[:, None] - x[None]) ** 2).sum(2)
    assert (c.at_least(q) <= np.sqrt(d2) + 1e-9).all()
    error = c.estimate(q) - d2
    assert abs(error.mean()) < 0.1 * d2.mean() and error.std() < 0.2 * d2.mean()
    assert codes.eight_bit(np.array([0.5 / 127, -0.5 / 127, 9.0])).tolist() == [1, -1, 127]
    assert (codes.SignCodes.of(np.zeros((2, 3))).estimate(np.ones((1, 3))) == 3).all()
    assert codes.synthetic(5, 3).shape == (5, 3) and codes.synthetic(50, 3, 4).dtype == np.float32


@pytest.mark.parametrize("diversify", [True, False])
def test_graph_search(spark, diversify):
    x = codes.synthetic(1500, 16, 30, seed=3)
    df = vb.store_vectors(spark, x)
    params = proximity.AnnParams(shard_rows=600, diversify=diversify)
    stored = proximity.build_graph(df, params)
    assert stored.count() == 1500 and stored.select("shard").distinct().count() == 3
    truth = vb.search(df, vb.store_queries(df, F.expr("vec_id % 50 = 0")), 10)
    found = vb.recall(proximity.search_graph(stored, df, F.expr("vec_id % 50 = 0"), 10, params), truth).first().recall
    assert found >= (0.9 if diversify else 0.3)
    gone = df.where("vec_id % 2 = 1").select(F.col("vec_id").alias("id"))
    left = proximity.search_graph(stored, df, F.expr("vec_id % 50 = 0"), 10, params, gone)
    assert left.where("id % 2 = 1").count() == 0 and left.count() == 300
    one = proximity.build_graph(df.limit(1), params)
    assert proximity.search_graph(one, df.where("vec_id = 0"), F.lit(True), 5, params).count() == 1


def test_recall_of_the_registered_searches(spark):
    from lorespark.plans import registry

    got = {r.method: r.recall for r in registry.queries()["recall_at_k"](spark, "/root/testdata/sf0.1").collect()}
    assert set(got) == {"rabitq_topk", "ivf_topk", "graph_topk"} and min(got.values()) >= 0.9, got


def test_max_sim_over_batches(spark):
    rng = np.random.default_rng(4)
    t = rng.normal(size=(90, 5))
    rows = [(i % 20, v.tolist()) for i, v in enumerate(t)] + [(3, [0.0] * 5), (50, None)]
    q = rng.normal(size=(3, 5))
    unit = lambda v: v / np.sqrt((v * v).sum(1, keepdims=True))
    s = unit(t) @ unit(q).T
    want = {i: sum(max(0.0, s[j::1][np.arange(90) % 20 == i][:, c].max()) for c in range(3)) for i in range(20) for j in (0,)}
    df = spark.createDataFrame(rows, "id long, vec array<double>").repartition(4)
    got = vb.max_sim(df, q, 5).collect()
    assert [r.id for r in got] == sorted(want, key=lambda i: (-want[i], i))[:5] and abs(got[0].score - want[got[0].id]) < 1e-9
    assert {r.id for r in vb.max_sim(df, q, 5, df.where("id < 3")).collect()} == {0, 1, 2}


def test_fusion_ties_and_similar(spark):
    hits = spark.createDataFrame([(0, "vector", "a", 1.0), (0, "vector", "b", 1.0), (1, "fulltext", "b", 3.0)], "step int, source string, id string, score double")
    got = [(r.id, r.n_sources) for r in fusion.rrf(hits).orderBy(F.desc("score")).collect()]
    assert got == [("b", 2), ("a", 1)]
    chunks = spark.createDataFrame([("1", 0.9, "one two three four"), ("2", 0.8, "one two three four"), ("3", 0.7, "other words")], "id string, score double, content string")
    assert [r.id for r in fusion.drop_similar(chunks).orderBy("id").collect()] == ["1", "3"]
    assert fusion.context(chunks, 1).count() == 1


def test_trim_and_words(spark):
    df = spark.createDataFrame([("a. " + "b" * 30,), ("x" * 50,), (None,)], "t string")
    assert [r[0] for r in df.select(X.trim_chunk(F.col("t"), 20)).collect()] == ["a.", "x" * 20, None]
    assert [r[0] for r in df.select(X.token_estimate(F.col("t"))).collect()] == [9, 13, 0]


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "one Alpha", 1), ("b", "two Beta", 1)], "id string, content string, t int")
    full = df.select("id", "content", F.create_map(F.lit("k"), F.lit("v")).alias("metadata"), F.array(F.lit("w")).alias("keywords"), F.array().cast("array<struct<relation_type:string,target_id:string,weight:float>>").alias("relationships"), F.create_map(F.lit("m"), F.array(F.lit(1.0).cast("float"))).alias("embeddings"), F.timestamp_seconds("t").alias("created_at"), F.timestamp_seconds("t").alias("updated_at"))
    s = store.ObjectStore(spark, str(tmp_path / "s"))
    s.put(full)
    s.put(full.where("id = 'a'").withColumn("content", F.lit("new Gamma")).withColumn("updated_at", F.timestamp_seconds(F.lit(5))))
    s.delete(spark.createDataFrame([("b",)], "id string"), "2024-01-01 00:00:00")
    assert [(r.id, r.content) for r in s.read().collect()] == [("a", "new Gamma")]
    tables = s.compact(str(tmp_path / "c")).rebuild()
    assert [r.entity for r in tables["entities"].where("entity <> 'w'").collect()] == ["gamma"] and [r.model for r in tables["vectors"].collect()] == ["m"]


def test_vector_file(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    store.write_vector_file(str(tmp_path / "v.bin"), x, x[:2], np.array([[0, 1], [1, 0]]))
    got = store.read_vector_files(spark, str(tmp_path / "v.bin"))
    assert got.where("part = 'vector'").count() == 4
    assert got.where("part = 'query'").orderBy("row").collect()[1].neighbours == [1, 0]


def test_update_defaults(spark):
    assert spark.range(1).select(objects.clamp_importance(F.lit(None)), objects.clamp_importance(F.lit(7))).first()[:] == (0.5, 1.0)


def test_streams(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), batch.schema, 1)
    q = events.hourly(stream).writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    q.processAllAvailable()
    q.stop()
    a = {(r.start, r.event_type): r.n for r in spark.table("hourly").collect()}
    assert a == {(r.start, r.event_type): r.n for r in events.hourly(batch).collect()}
    unique = events.deduplicated(events.read_stream(spark, str(tmp_path / "in"), batch.schema), ["event_id"], "400 days")
    q = unique.writeStream.format("memory").queryName("unique_events").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("unique_events").count() == batch.select("event_id").distinct().count()


def test_stream_ingest(spark, tmp_path):
    df = spark.createDataFrame([("a", "Alpha beta"), ("b", "beta")], "id string, content string")
    df.write.parquet(str(tmp_path / "in"))
    q = events.ingest(events.read_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out/postings")).where("term = 'beta'").count() == 2


def test_stream_of_co_mentions(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(f"e{rng.integers(0, 3)}", f"{i:03d}", i) for i in range(120)] + [(None, "x", 1)]
    df = spark.createDataFrame(rows, "entity string, id string, at long")
    for k in range(3):  # three files in order
        df.where(F.col("at").between(40 * k, 40 * k + 39)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), df.schema, 1)
    q = events.stored_links(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 3)
    q.awaitTermination(120)
    got = {(r.src, r.dst) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.src, r.dst) for r in graph.co_mentions(df, "at", 3).collect()}


def test_sql_functions(spark):
    from lorespark.plans.sql_functions import register_functions, register_table_functions

    own = spark.newSession()
    register_functions(own)
    r = own.sql("SELECT cosine(array(1D, 0D), array(1D, 1D)) AS c, cosine(array(0D), array(1D)) AS z, l2_score(array(1D), array(2D)) AS l, est_tokens('hello') AS t, jaccard(array('a'), array('a', 'b')) AS j, max_sim(array(array(1D, 0D), array(-1D, 0D)), array(array(0.5D, 0D), array(0.2D, 1D))) AS m, date_bin(INTERVAL '15' MINUTE, TIMESTAMP '2024-01-01 10:07:09', TIMESTAMP '2024-01-01') AS b").first()
    assert (round(r.c, 9), r.z, r.l, r.t, r.j, r.m, str(r.b)) == (0.707106781, 0, 0.5, 2, 0.5, 0.5, "2024-01-01 10:00:00")
    own.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>").createOrReplaceTempView("vectors")
    own.createDataFrame([("acme", "a", 2, 5), ("boat", "b", 1, 3)], "term string, id string, tf int, len int").createOrReplaceTempView("postings")
    own.createDataFrame([(2, 4.0)], "docs long, mean double").createOrReplaceTempView("text_stats")
    register_table_functions(own)
    assert [x.id for x in own.sql("SELECT * FROM knn(array(1D, 0D), 1)").collect()] == ["1"]
    assert [x.id for x in own.sql("SELECT * FROM bm25('Acme boat', 5) ORDER BY score DESC").collect()] == ["a", "b"]


def test_merge_of_scalar_results():
    from lorespark.operators.cluster import merge_scalars

    assert merge_scalars("SELECT COUNT(*), min(x), MAX(x), sum(x) FROM t", [[(2, 1.5, 4, 5.5)], [(3, 0.5, 9, 1.0)], []]) == ["5", "0.5", "9", "6.5"]
    assert merge_scalars("select count(*), max(x) from t", [[(0, None)]]) == ["0", "NULL"]
    for bad in ("SELECT avg(x) FROM t", "SELECT count(*) FROM t GROUP BY y", "SELECT x FROM t"):
        with pytest.raises(ValueError):
            merge_scalars(bad, [[(1,)]])


def test_clean_up(spark, monkeypatch):
    import os

    from lorespark import session

    monkeypatch.setattr(session, "_MADE", {})
    df = session.materialise(spark.range(3), "gone")
    (path,) = session._MADE
    assert df.count() == 3 and os.path.isdir(session.local_path(path))
    assert session.clean_up() == 1 and not os.path.exists(session.local_path(path)) and session.clean_up() == 0


def test_filters_reach_the_scan(spark, sf):
    plan = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_quantity > 45").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    knn = search.knn(spark.read.parquet(f"{sf}/embeddings.parquet"), [0.0] * 64, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in knn and "Exchange" not in knn


def test_long_chains(spark):
    ids = [f"n{i:03d}" for i in np.random.default_rng(3).permutation(300)]
    rows = list(zip(ids, ids[1:])) + [("p", "q")]
    chain = spark.createDataFrame(rows, "src string, dst string")
    assert {r.id: r.component for r in graph.components(chain).collect()} == {**dict.fromkeys(ids, "n000"), "p": "p", "q": "p"}
    assert graph.shortest_path(chain, ids[0], ids[18]) == 18 and graph.shortest_path(chain, ids[280], "p") is None


def test_graph_queries_take_the_whole_graph(spark, sf):
    from lorespark.plans import registry

    edges = [(r.src, r.dst) for r in graph.fixture_edges(spark, sf).collect()]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in registry.queries()["graph_components"](spark, sf).collect()}
    assert got == {x: root(x) for x in parent}
    near = {x: set() for x in parent}
    for a, b in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    label = {x: x for x in parent}
    for _ in range(20):
        new = {}
        for x, ns in near.items():
            votes = {label[x]: 1}
            for y in ns:
                votes[label[y]] = votes.get(label[y], 0) + 1
            new[x] = min(c for c, n in votes.items() if n == max(votes.values()))
        if new == label:
            break
        label = new
    assert {r.id: r.community for r in registry.queries()["communities"](spark, sf).collect()} == label


def test_order_of_nulls_is_reached(spark, sf):
    from lorespark.plans import registry

    q = [r.q for r in registry.queries()["sql_order_nulls"](spark, sf).collect()]
    known = [x for x in q if x is not None]
    assert len(q) == spark.read.parquet(f"{sf}/documents.parquet").count() and len(known) < len(q)
    assert q == sorted(known, reverse=True) + [None] * (len(q) - len(known))


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_labels_of_nodes_in_several_blocks(spark, block, monkeypatch):
    """Hubs whose edges lie in many blocks and files, edges in both directions, and no edges at all."""
    from lorespark.operators import labels

    rng = np.random.default_rng(4)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 40, (90, 2))] + [("hub", f"n{i}") for i in range(40)] + [(f"n{i}", "hub") for i in range(9)]
    edges = spark.createDataFrame(pairs, "src string, dst string").repartition(3)
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    want = {x: x for x in near}
    for _ in range(5):
        votes = {x: [want[y] for y in (*ns, x)] for x, ns in near.items()}
        want = {x: min(v, key=lambda c: (-v.count(c), c)) for x, v in votes.items()}
    monkeypatch.setattr(labels, "PART", block)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r.id: r.community for r in graph.communities(edges, 5).collect()} == want
        assert {r.component for r in graph.components(edges).collect()} == {"hub"}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert graph.communities(edges.limit(0)).count() == graph.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 50_000])
def test_a_small_frontier_leaves_the_edges_where_they_are(spark, few, monkeypatch):
    from lorespark.session import materialise

    monkeypatch.setattr(graph, "FEW", few)
    edges = materialise(spark.range(3000).select(F.concat(F.lit("n"), F.col("id")).alias("src"), F.concat(F.lit("n"), F.col("id") * 2 + 1).alias("dst"), F.lit("r").alias("rel")), "e")
    hops = edges.select(F.col("src").alias("id"), "dst")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph._step(graph.seeds_of(spark, ["n0"]), hops)._jdf.queryExecution().executedPlan().toString()
        assert ("hashpartitioning" in plan) == (few == 0)
        assert {r.id: r.depth for r in graph.bfs(edges, graph.seeds_of(spark, ["n0", "n5"]), 3).collect()} == {"n0": 0, "n5": 0, "n1": 1, "n11": 1, "n3": 2, "n23": 2, "n7": 3, "n47": 3}
        assert {r.id for r in graph.bidirectional(edges, graph.seeds_of(spark, ["n3"]), 1).collect()} == {"n3", "n7", "n1"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_batch_bm25_never_lists_pairs(spark, tmp_path):
    """Every query against every document, with ties and terms that nobody has; no side goes out by broadcast."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 12, 9)) for _ in range(60)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index = search.build_text_index(docs, {"text": F.col("text")}, str(tmp_path / "i"))
    asks = [(n, f"w{x}") for n in range(300) for x in rng.integers(0, 14, 4)] + [(300, "none"), (None, "w1")]
    got = search.bm25_batch(spark.createDataFrame(asks, "q long, term string"), index, 3, "q", 2)
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString().split("Window")[-1]
    split = [t.split() for t in texts]
    df = {w: sum(w in t for t in split) for w in {w for t in split for w in t}}
    part = lambda w, t: np.log(1 + (len(split) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2)
    want = set()
    for n in range(300):
        score = [sum(part(w, t) for w in {w for m, w in asks if m == n} if w in t) for t in split]
        order = sorted((i for i in range(len(split)) if score[i]), key=lambda i: (-round(score[i], 9), i))[:3]
        want |= {(n, r + 1, i, round(score[i], 7)) for r, i in enumerate(order)}
    assert {(r.q, r["rank"], r.id, round(r.score, 7)) for r in got.collect()} == want


def test_index_counts_repeated_ids_and_sizes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a", None), (1, "a c", "x"), (2, "", "x x"), (3, None, None)], "id long, text string, tag string")
    index = search.build_text_index(docs, {"text": F.col("text"), "tag": F.col("tag")}, str(tmp_path / "i"))
    assert {tuple(r) for r in index.postings.select("term", "field", "id", "tf", "len").collect()} == {("a", "text", 1, 3, 3), ("b", "text", 1, 1, 3), ("c", "text", 1, 1, 2), ("x", "tag", 1, 1, 1), ("x", "tag", 2, 2, 2)}
    sizes = {r.field: (r.docs, r["mean"]) for r in search.text_sizes(docs, {"text": F.col("text"), "tag": F.col("tag")}).collect()}
    assert sizes == {"text": (3, 1.0), "tag": (3, 1.0)} and index.docs == 3 and index.mean == {"text": 1.0, "tag": 1.0}


def test_pairs_scored_at_a_time_are_bounded(spark, monkeypatch):
    import pyarrow as pa

    sizes = [len(i) for i, _ in vb.blocks(iter([pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([[1.0]] * n)], ["id", "v"]) for n in (7, 25, 0, 1)]), 10)]
    assert sizes == [10, 10, 10, 3]
    pieces = list(vb._cut(iter([(np.arange(7), np.ones((7, 2))), (np.arange(2), np.ones((2, 2)))]), 3))
    assert [len(i) for i, _ in pieces] == [3, 3, 1, 2] and all(len(i) == len(q) for i, q in pieces)


def test_agg_approx_keeps_sketches_apart_from_distinct_keys(spark, tmp_path):
    """Ties, nulls, an even and an odd group; no sketch per customer and no exact percentile in one buffer."""
    from lorespark.plans import registry

    rows = [("a", i % 7, float(i % 5)) for i in range(40)] + [("b", i, 10.0 * i) for i in range(9)] + [(None, 1, 2.0), ("b", None, None)]
    spark.createDataFrame(rows, "o_orderpriority string, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = registry.queries()["agg_approx"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {("a", True, True), ("b", True, True), (None, True, True)}
    assert "percentile(" not in got._jdf.queryExecution().executedPlan().toString()
