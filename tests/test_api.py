"""The façade, and the entry module without the training-data operators."""

import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark import __main__ as cli
from lorespark import hooks, metrics
from lorespark.api import Lorespark

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_store_life(spark, tmp_path):
    db = Lorespark(spark, str(tmp_path / "db"))
    a, b = db.batch_insert([
        {"content": "Acme raised a large round", "metadata": {"stage": "b"}, "keywords": ["acme"], "importance": 0.9},
        {"content": "Globex met Acme in spring", "metadata": {"stage": "a"}},
    ])
    assert db.get(b).first().importance == 0.5 and db.count() == 2
    assert {(r.src, r.dst) for r in db.edges().collect()} == {(a, b), (b, a)}
    assert {(r.id, r.field) for r in db.text_index().postings.where("term = 'acme'").collect()} == {(a, "content"), (a, "keywords"), (b, "content")}
    assert db.update(a, content="Zeta raised a huge round", metadata={"note": "x"}, importance=2.0) == 1
    row = db.get(a).first()
    assert row.content.startswith("Zeta raised a huge") and row.metadata == {"stage": "b", "note": "x"} and row.importance == 1.0
    assert db.update("none", content="x") is None
    # the index follows the update: the old text is gone, the keyword and the other object stay
    assert {(r.id, r.field) for r in db.text_index().postings.where("term = 'acme'").collect()} == {(a, "content"), (a, "keywords"), (b, "content")}
    assert [r.id for r in db.top_terms(["huge"]).collect()] == [a] and db.top_terms(["large"]).count() == 0
    assert [r.id for r in db.ask("tell me about Zeta", 2).collect()][0] == a
    assert db.sql("SELECT count(*) AS n FROM knowledge WHERE metadata['stage'] = 'b'").first().n == 1
    assert {(r.src, r.dst) for r in db.edges().collect()} == {(a, b), (b, a)}  # both still name acme
    assert db.forget(b) and not db.forget(b) and db.list()[1] == 1 and db.edges().count() == 0
    db.rebuild()
    assert [r.id for r in db.list_ids().collect()] == [a] and [r.id for r in db.top_terms(["huge"]).collect()] == [a] and db.top_terms(["globex"]).count() == 0
    hits = db.plans.hits
    assert "intent" in db.explain("what is Acme") and "intent" in db.explain("what is Acme") and db.plans.hits == hits + 1
    stats = db.stats()
    assert {k: stats[k] for k in ("objects", "vectors", "graph_nodes", "graph_edges", "sessions")} == {"objects": 1, "vectors": 0, "graph_nodes": 0, "graph_edges": 0, "sessions": 0}
    assert db.metrics.calls["ask"] == 1 and 'lorespark_calls_total{operation="ask"} 1' in db.metrics.export()


def test_conversations(spark, tmp_path):
    db = Lorespark(spark, str(tmp_path / "db"))
    rocket = db.insert("The big rockets launch on monday")
    one = db.record_turn("s", "user", "I like rockets")
    assert one == db.record_turn("s", "User", "I like rockets")
    assert db.record_turn("s", "system", "be kind") is None and db.record_turn("s", "assistant", "  ") is None
    assert [(r.turn, r.role) for r in db.get_session("s").collect()] == [(0, "user"), (1, "user"), (2, "system"), (3, "assistant")]
    assert [(r.turn) for r in db.get_session("s", 2).collect()] == [2, 3]
    assert db.count() == 2 and db.get(one).first().metadata == {"session_id": "s", "role": "user", "kind": "memory"}
    assert {(r.src, r.dst) for r in db.edges().where("rel = 'mentions'").collect()} == {(one, rocket)}
    db.record_turn("t", "user", "another talk")
    assert {(r.conv_id, r.turns) for r in db.sessions().collect()} == {("s", 4), ("t", 1)}
    db.delete_session("s")
    assert [r.conv_id for r in db.sessions().collect()] == ["t"] and db.turns("s").count() == 0
    db.set_fact("t", "name", "Ada")
    db.set_fact("t", "name", "Grace")
    assert db.facts("t") == {"name": "Grace"} and db.facts("none") == {}
    db.pin("t", rocket)
    db.pin("t", rocket)
    assert [r.id for r in db.pinned("t").collect()] == [rocket] and db.pinned("s").count() == 0


def test_models_are_asked_where_given(spark, tmp_path):
    class Model:
        def complete(self, system, user):
            if "lasting fact" in system:
                return "NOOP" if "hello" in user else "Likes tea."
            if "SELECT" in system:
                return "```sql\nSELECT count(*) AS n FROM knowledge;\n```" if "many" in user else "DROP TABLE knowledge"
            if "Sum up" in system:
                return "About " + user[:4]
            if "from this summary" in system:
                return "partly " + user[:10] if "About" in user else "NONE"
            if "Combine" in system:
                raise RuntimeError("no answer")
            return ""

    class Longest:
        def score(self, question, texts):
            return [len(t) for t in texts]

    db = Lorespark(spark, str(tmp_path / "db"), provider=hooks.ProxyEmbeddings(32), llm=Model(), encoder=Longest())
    ids = db.batch_insert([{"content": "Acme sells Boats"}, {"content": "Acme sells Boats and Planes to everyone"}, {"content": "tea time", "embeddings": {"default": [1.0] * 32}}])
    assert db.vectors().count() == 3 and db.vectors().where(F.col("id") == ids[2]).first().embedding == [1.0] * 32
    found = db.ask("Acme boats", 2).collect()
    assert [r.id for r in found] == [ids[1], ids[0]] and found[0].score == 39.0 and "vector" in found[0].sources
    assert db.costs.embed_calls == 1 and db.costs.input_tokens > 0 and db.stats()["cost_usd"] > 0
    assert db.record_turn("s", "user", "hello there") is None and db.get(db.record_turn("s", "user", "I drink tea")).first().content == "Likes tea."
    assert db.answer_with_sql("how many").first().n == 4 and db.answer_with_sql("drop it") is None
    assert db.global_query("what is sold").startswith("partly About")
    plain = Lorespark(spark, str(tmp_path / "db"))
    assert plain.global_query("x") is None and plain.answer_with_sql("x") is None and plain.communities().count() >= 1


def test_hooks_without_models():
    class Flaky:
        dim, calls = 2, 0

        def embed(self, texts):
            self.calls += 1
            if self.calls < 3:
                raise OSError("busy")
            return np.array([[len(t), 1.0] for t in texts])

    pauses, flaky = [], Flaky()
    provider = hooks.Retrying(flaky, 3, 0.5, 2, pauses.append)
    assert provider.embed(["ab", "c", "ab"]).tolist() == [[2, 1], [1, 1], [2, 1]] and pauses == [0.5, 1.0]
    provider.embed(["ab"])
    assert flaky.calls == 3 and len(provider.held) == 2 and provider.embed([]).shape == (0, 2)
    flaky.calls = -9
    with pytest.raises(OSError):
        provider.embed(["new"])
    e = hooks.ProxyEmbeddings(16)
    x = e.embed(["one two", "Two, one!", "", "three"])
    assert np.allclose(x[0], x[1]) and not x[2].any() and np.isclose((x[3] ** 2).sum(), 1)
    assert hooks.distil(None, "t") == "t" and hooks.situate(None, "t") == "t" and hooks.summarise(None, ["a", "b"]) == "Community of 2 items: a\n- b" and hooks.combine(None, "q", []) is None


def test_metrics_and_costs():
    clock = iter([0.0, 1.0, 3.0, 4.0, 4.5, 10.0, 10.0])
    m = metrics.Metrics(lambda: next(clock))
    with m.timed("ask"):
        pass
    with pytest.raises(KeyError), m.timed("ask"):
        raise KeyError
    assert (m.calls["ask"], m.errors["ask"], m.mean("ask"), m.percentile("ask", 50), m.percentile("none", 50)) == (2, 1, 1.25, 1.25, 0.0)
    assert m.uptime == 10.0 and "lorespark_uptime_seconds 10.000" in m.export()
    c = metrics.CostTracker()
    c.record(1000, 1000, 1000, 7)
    assert abs(c.total - (2e-5 + 1.5e-4 + 6e-4)) < 1e-12 and c.lookups == 7
    c.reset()
    assert c.total == 0


def test_command_line(spark, tmp_path, capsys):
    path = ["--path", str(tmp_path / "cli")]
    call = lambda *a: (cli.main([*path, *a]), capsys.readouterr().out.strip())
    code, id_ = call("insert", "Ada wrote a program", "--meta", "who=ada", "--importance", "0.8")
    assert code == 0 and id_ in call("list")[1]
    assert '"content":"Ada wrote a program"' in call("ask", "What did Ada write", "-k", "3")[1]
    assert call("sql", "SELECT importance FROM knowledge")[1] == '{"importance":0.8}'
    assert cli.main([*path, "sql", "DROP TABLE knowledge"]) == 1
    assert "intent factoid" in call("explain", "what now")[1] and '"objects": 1' in call("stats")[1]
    assert call("forget", id_)[1] == "forgotten" and call("forget", id_)[1] == "not found"
    with pytest.raises(SystemExit):
        cli.main([*path, "ask", "x", "-k", "21"])


def test_entry_without_llm(tmp_path):
    """The rest of the repository imports and lists its queries when the llm folders and the pipeline are gone."""
    for name in ("lorespark", "__spark_entry__.py"):
        src, dst = os.path.join(ROOT, name), tmp_path / name
        shutil.copytree(src, dst, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, dst)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'ask_pipeline' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
