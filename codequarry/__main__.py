"""Command line: python -m codequarry --index FOLDER --source TREE COMMAND ..."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from codequarry import output
from codequarry.operators import edit, overview, quality
from codequarry.session import Index
from codequarry.sources import parsers, scan


def _parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="codequarry")
    main.add_argument("--index", required=True, help="folder of the index, in shared storage")
    main.add_argument("--source", default=".", help="the tree that is indexed")
    main.add_argument("--format", choices=["json", "pretty", "table"], default="json")
    commands = main.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, **options) -> None:
        command = commands.add_parser(name)
        for argument in arguments:
            command.add_argument(argument)
        for option, kind in options.items():
            flag = "--" + option.replace("_", "-")
            command.add_argument(flag, action="store_true") if kind is bool else command.add_argument(flag, **kind)

    text, number = {"default": None}, {"type": int, "default": 20}
    add("index")
    add("search", "query", limit=number, fields={"default": "full"})
    add("read", "path", symbol=text, parent=text, section=text, metadata=bool)
    add("overview", detail={"default": "standard"}, path=text)
    add("refs", "symbol")
    add("context", "symbol", graph=bool)
    add("deps", "path")
    add("scope", "path", "line")
    add("summarize", "path")
    add("partition", "path", "strategy")
    add("diff", path=text, symbol=text)
    add("files", path=text, skipped_only=bool, indexed_only=bool)
    add("stats", savings=bool, since=text)
    add("quality", "log", unknown_only=bool, all=bool, summary=bool, clear=bool)
    add("verify", fix=bool)
    add("supported")
    add("tests", "symbol", "path")
    add("replace", "path", "symbol", "code", parent=text, preview=bool)
    add("delete", "path", "symbol", parent=text, keep_docs=bool)
    add("insert", "path", "code", position={"default": "bottom"})
    add("extract", "path", "to", "symbols", parent=text)
    return main


def _edit(index: Index, a: argparse.Namespace) -> dict:
    """An edit and the refresh of the index after it."""
    find = lambda name: edit.find_symbol(index.files, index.chunks, a.path, name, getattr(a, "parent", None))
    report: dict = {"ok": True}
    before = os.path.getsize(p) if os.path.exists(p := os.path.join(a.source, a.path)) else 0
    if a.command == "replace" and a.preview:
        return vars(edit.preview_replace(a.source, a.path, find(a.symbol), a.code))
    if a.command == "replace":
        edit.replace(a.source, a.path, find(a.symbol), a.code)
    elif a.command == "delete":
        report["removed_lines"] = edit.delete(a.source, a.path, find(a.symbol), a.keep_docs)
    elif a.command == "insert":
        edit.insert(a.source, a.path, a.code, a.position)
    else:
        report |= edit.extract(a.source, a.path, [find(s) for s in a.symbols.split(",")], a.to)
    for path in {a.path, getattr(a, "to", a.path)}:
        if os.path.exists(os.path.join(a.source, path)):
            report.setdefault("reindexed", []).append(index.reindex_file(a.source, path, symbol=getattr(a, "symbol", None)))
    if a.command == "replace":
        report["test_impact"] = index.analyse_tests(a.source, a.symbol, a.path)
    sizes = [os.path.getsize(p) if os.path.exists(p := os.path.join(a.source, a.path)) else 0]
    new = len(a.code.encode()) if a.command in ("replace", "insert") else 0
    index.charge_edit(a.command, sizes[0], max(0, before + new - sizes[0]), new, len(output.to_json(report).encode()))
    return report


#: Commands whose costs go to the ledger.
_CHARGED = ("search", "read", "overview", "refs", "context", "deps", "scope", "summarize", "partition", "files", "tests")


def _query(index: Index, a: argparse.Namespace) -> DataFrame:
    if a.command == "index":
        return index.index(a.source)
    if a.command == "search":
        return index.search(a.query, a.limit, a.fields)
    if a.command == "read":
        if a.metadata and a.symbol:
            return index.metadata(a.symbol)
        return index.read(a.path, a.symbol, a.parent, a.section)
    if a.command == "overview":
        return index.overview(a.detail, a.path)
    if a.command == "refs":
        return index.refs_to(a.symbol)
    if a.command == "context":
        return index.context(a.symbol, a.graph)
    if a.command in ("deps", "summarize"):
        return getattr(index, a.command)(a.path)
    if a.command == "scope":
        return index.scope(a.path, int(a.line))
    if a.command == "partition":
        return index.partition(a.source, a.path, a.strategy)
    if a.command == "diff":
        return index.diff(a.source, a.path, a.symbol)
    if a.command == "files":
        rows = overview.scoped(scan.tree(index.spark, a.source)[0], a.path)
        return rows.where(f"{'NOT supported' if a.skipped_only else 'true'} AND {'supported' if a.indexed_only else 'true'}")
    if a.command == "stats":
        return index.savings(a.since) if a.savings else index.stats()
    if a.command == "quality":
        if a.clear:
            return index.spark.createDataFrame([(quality.clear_log(index.spark, a.log),)], "cleared boolean")
        log = quality.read_log(index.spark, a.log)
        return quality.summary(log) if a.summary else log if a.all and not a.unknown_only else quality.unknown(log)
    if a.command == "verify":
        return index.verify(a.source, a.fix)
    if a.command == "tests":
        return index.test_impact(a.symbol, a.path)
    return parsers.supported_extensions(index.spark)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("codequarry").getOrCreate()
    index = Index(spark, a.index)
    try:
        if a.command in ("replace", "delete", "insert", "extract"):
            print(output.to_json(_edit(index, a), a.format == "pretty"))
        else:
            text = output.truncated(output.answer(_query(index, a), a.format))
            print(text)
            if a.command in _CHARGED:
                index.charge(a.command, len(text.encode()), getattr(a, "path", None), getattr(a, "symbol", None))
    except (edit.EditError, LookupError, ValueError) as error:
        print(output.to_json({"error": getattr(error, "kind", type(error).__name__), "message": str(error)}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
