"""Command line: python -m kelpworks COMMAND --index FOLDER [...]; rows are printed as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from .api import Engine
from .config import Config
from .session import build_session
from .sources.walker import read_tree


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kelpworks")
    p.add_argument("--index", required=True, help="folder of the stored index")
    p.add_argument("--config", help="TOML file of settings")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("root")
    sub.add_parser("status")
    for name in ("definition", "references", "callers", "callees", "outline", "imports"):
        sub.add_parser(name).add_argument("name")
    for name in ("search", "semantic", "ask"):
        q = sub.add_parser(name)
        q.add_argument("query")
        q.add_argument("--limit", type=int, default=20)
    q = sub.add_parser("locate")
    q.add_argument("--path")
    q.add_argument("--query")
    q.add_argument("--file")
    q = sub.add_parser("pack")
    q.add_argument("--budget", type=int)
    q.add_argument("--style", choices=("xml", "markdown"), default="xml")
    return p


def run(args: argparse.Namespace, spark) -> list:
    """The rows of a command; pack gives one text."""
    config = Config.load(args.config)
    if args.command == "index":
        engine = Engine.build(spark, args.index, read_tree(spark, args.root), config)
        engine.build_vectors()
        return engine.deliver(engine.get_index_status())
    e = Engine.open(spark, args.index, config)
    if args.command == "pack":
        return [e.pack_repo(args.budget, args.style).text]
    if args.command == "imports":
        return [{"side": side, **row} for side, rows in e.get_imports(args.name).items() for row in e.deliver(rows)]
    if args.command == "ask":
        return e.deliver(e.ask(args.query, limit=args.limit)[1])
    rows = {
        "status": lambda: e.get_index_status(), "definition": lambda: e.find_definition(args.name), "references": lambda: e.find_references(args.name), "callers": lambda: e.get_callers(args.name),
        "callees": lambda: e.get_callees(args.name), "outline": lambda: e.get_symbol_outline(args.name), "search": lambda: e.search_text(args.query, max_results=args.limit),
        "semantic": lambda: e.search_semantic(args.query, args.limit), "locate": lambda: e.locate(args.path, args.query, args.file),
    }[args.command]()
    return e.deliver(rows)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session(app="kelpworks-cli")
    spark.sparkContext.setLogLevel("ERROR")
    for row in run(args, spark):
        print(row if isinstance(row, str) else json.dumps(row, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
