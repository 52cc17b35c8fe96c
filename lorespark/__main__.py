"""Command line: ``python -m lorespark --path DIR insert|ask|search|sql|list|forget|stats|explain|demo ...``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame

from lorespark.api import Lorespark
from lorespark.hooks import ProxyEmbeddings
from lorespark.session import get_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lorespark", description="A store of knowledge objects, and questions to it.")
    p.add_argument("--path", default="./lorespark-data", help="folder of the store")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("insert", help="add one object")
    c.add_argument("content")
    c.add_argument("--meta", action="append", default=[], metavar="KEY=VALUE")
    c.add_argument("--keyword", action="append", default=[])
    c.add_argument("--importance", type=float)
    for name in ("ask", "search"):
        c = sub.add_parser(name, help="ranked objects for a question")
        c.add_argument("question")
        c.add_argument("-k", type=int, default=5, choices=range(1, 21), metavar="1..20")
        c.add_argument("--meta", action="append", default=[], metavar="KEY=VALUE")
        if name == "ask":
            c.add_argument("--budget", type=int, help="pack a context of so many tokens")
    for name, arg in (("sql", "query"), ("forget", "id"), ("explain", "question")):
        sub.add_parser(name).add_argument(arg)
    c = sub.add_parser("list")
    c.add_argument("--offset", type=int, default=0)
    c.add_argument("--limit", type=int, default=50)
    sub.add_parser("stats")
    sub.add_parser("demo", help="insert three objects and ask about them")
    return p


def _pairs(given: Sequence[str]) -> dict[str, str]:
    bad = [x for x in given if "=" not in x]
    if bad:
        raise SystemExit(f"not KEY=VALUE: {', '.join(bad)}")
    return dict(x.split("=", 1) for x in given)


def _show(df: DataFrame) -> str:
    return "\n".join(df.toJSON().collect())


def run(args: argparse.Namespace, db: Lorespark) -> str:
    """The text that a command prints."""
    if args.command == "insert":
        fields = {"metadata": _pairs(args.meta), "keywords": args.keyword} | ({"importance": args.importance} if args.importance is not None else {})
        return db.insert(args.content, **fields)
    if args.command in ("ask", "search"):
        return _show(db.ask(args.question, args.k, getattr(args, "budget", None), _pairs(args.meta)))
    if args.command == "sql":
        return _show(db.sql(args.query))
    if args.command == "forget":
        return "forgotten" if db.forget(args.id) else "not found"
    if args.command == "explain":
        return db.explain(args.question)
    if args.command == "list":
        page, total = db.list(args.offset, args.limit)
        return "\n".join([*(r.id for r in page.collect()), f"of {total}"])
    if args.command == "stats":
        return json.dumps(db.stats())
    db.batch_insert([{"content": "Ada wrote the first program"}, {"content": "Grace built the first compiler", "importance": 0.9}, {"content": "Ada and Grace share a calendar page"}])
    return _show(db.ask("What did Grace build", 3).select("content", "score"))


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print(run(args, Lorespark(get_session("lorespark"), args.path, provider=ProxyEmbeddings())))
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
