"""Command line: index, search, info, clear, export."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from .engine import Engine
from .functions.text import Analyzer
from .sources import store

DEFAULT = ".inkwell"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkwell", description="Full-text search over Spark")
    commands = p.add_subparsers(dest="command")

    def command(name: str, about: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=about)
        c.add_argument("-d", "--db", default=DEFAULT, help="folder of the index")
        return c

    c = command("index", "put files and folders into the index")
    c.add_argument("paths", nargs="+")
    c.add_argument("-r", "--recursive", action="store_true", default=True)
    c.add_argument("--no-recursive", action="store_true")
    c.add_argument("--no-stem", action="store_true")
    c.add_argument("--no-stop-words", action="store_true")
    c.add_argument("--extensions", nargs="+")
    c = command("search", "find documents")
    c.add_argument("query", nargs="+")
    c.add_argument("-n", "--max-results", type=int, default=10)
    c.add_argument("-s", "--min-score", type=float, default=0.0)
    c.add_argument("--json", action="store_true")
    c.add_argument("--context", type=int, default=0)
    c.add_argument("--no-stem", action="store_true")
    c = command("info", "count documents and terms")
    c.add_argument("--json", action="store_true")
    c = command("clear", "empty the index")
    c.add_argument("-y", "--yes", action="store_true")
    c = command("export", "write the index as JSON")
    c.add_argument("-o", "--output")
    return p


def _session() -> SparkSession:
    return SparkSession.builder.appName("inkwell").getOrCreate()


def _figures(info: dict) -> str:
    return f"  Documents: {info['num_documents']}\n  Unique terms: {info['num_terms']}\n  Total tokens: {info['total_tokens']}\n  Avg doc length: {info['avg_doc_length']}"


def _index(a: argparse.Namespace, spark: SparkSession) -> int:
    engine = Engine(spark, a.db, Analyzer(remove_stop_words=not a.no_stop_words, stem=not a.no_stem), extensions=a.extensions)
    began = time.time()
    done = engine.index_paths(a.paths, recursive=not a.no_recursive)
    for name in a.paths:
        if name not in done:
            print(f"  {name} isn't there", file=sys.stderr)
        elif Path(name).is_dir():
            print(f"  {done[name]} files of {name}")
        elif done[name]:
            print(f"  {name}")
    total = sum(done.values())
    engine.save()
    print(f"{total} files in {time.time() - began:.2f} s, in {a.db}\n{_figures(engine.index_info())}")
    return 0


def _search(a: argparse.Namespace, spark: SparkSession) -> int:
    began = time.time()
    found = Engine(spark, a.db, Analyzer(stem=not a.no_stem)).search(" ".join(a.query), a.max_results, a.min_score)
    if a.json:
        print(json.dumps([{k: getattr(r, k) for k in ("path", "score", "title", "snippet", "line_number")} for r in found], indent=2))
    elif not found:
        print("No results found.")
    else:
        print(f"{len(found)} results in {(time.time() - began) * 1000:.1f} ms\n")
        for k, r in enumerate(found, 1):
            print(f"  {k}. [{r.score:.3f}] {r.path}")
            for line in ([f"Title: {r.title}"] if r.title and r.title != r.path else []) + ([r.snippet] if r.snippet else []):
                print(f"     {line}")
    return 0


def _info(a: argparse.Namespace, spark: SparkSession) -> int:
    engine = Engine(spark, a.db)
    info = engine.index_info()
    if not info["num_documents"]:
        print("Index is empty.")
    elif a.json:
        print(json.dumps({"index": a.db, **info}, indent=2))
    else:
        print(f"Index: {a.db}\n{_figures(info)} tokens\n\nMost frequent terms (documents, occurrences):")
        for r in engine.index.top_terms(20).collect():
            print(f"  {r['term']}: {r['doc_freq']}, {r['total_freq']}")
    return 0


def _clear(a: argparse.Namespace, spark: SparkSession) -> int:
    if not store.exists(spark, a.db):
        print(f"No index in {a.db}")
        return 1
    if not a.yes and input(f"Empty the index in {a.db}? [y/N] ").lower() not in ("y", "yes"):
        print("Cancelled.")
        return 0
    engine = Engine(spark, a.db)
    engine.clear()
    engine.save()
    print(f"Emptied {a.db}")
    return 0


def _export(a: argparse.Namespace, spark: SparkSession) -> int:
    text = Engine(spark, a.db).index.export_json()
    if a.output:
        Path(a.output).write_text(text, encoding="utf-8")
        print(f"Written to {a.output}")
    else:
        print(text)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, 1 for an error, 130 if interrupted."""
    p = parser()
    a = p.parse_args(argv)
    if a.command is None:
        p.print_help()
        return 0
    run = {"index": _index, "search": _search, "info": _info, "clear": _clear, "export": _export}[a.command]
    try:
        return run(a, spark or _session())
    except KeyboardInterrupt:
        print("Interrupted.", file=sys.stderr)
        return 130
    except Exception as e:  # noqa: BLE001
        print(f"Error: {e}", file=sys.stderr)
        return 1
