"""Command line over one JSON document: validate, point, hyperedge, query, subgraph, apply."""

from __future__ import annotations

import argparse
import sys

from .functions.jsontext import MISSING, dump, parse
from .model import GraphError


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise GraphError("invalid_arguments", message)


def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="weft", description=__doc__)
    top.add_argument("--input", help="the document's file; standard input by default")
    top.add_argument("--pretty", action="store_true")
    top.add_argument("--max-input-bytes", type=int, default=256 << 20)
    top.add_argument("--max-value-bytes", type=int, default=64 << 20)
    commands = top.add_subparsers(dest="command", required=True, parser_class=_Parser)
    commands.add_parser("validate")

    def data_options(p):
        p.add_argument("--data")
        p.add_argument("--data-file")

    for kind in ("point", "hyperedge"):
        group = commands.add_parser(kind).add_subparsers(dest="action", required=True, parser_class=_Parser)
        group.add_parser("list")
        group.add_parser("get").add_argument("id")
        add = group.add_parser("add")
        add.add_argument("id")
        data_options(add)
        remove = group.add_parser("remove")
        remove.add_argument("id")
        remove.add_argument("--ignore-missing", action="store_true")
        rename = group.add_parser("rename")
        rename.add_argument("id")
        rename.add_argument("new_id")
        if kind == "point":
            remove.add_argument("--cascade", action="store_true")
        else:
            add.add_argument("--tail", action="append", default=[])
            add.add_argument("--head", required=True)
            add.add_argument("--weight", required=True)
            change = group.add_parser("set").add_subparsers(dest="part", required=True, parser_class=_Parser)
            tails = change.add_parser("tails")
            tails.add_argument("id")
            tails.add_argument("--tail", action="append", default=[])
            for part in ("head", "weight"):
                p = change.add_parser(part)
                p.add_argument("id")
                p.add_argument("value")
        payload = group.add_parser("data").add_subparsers(dest="part", required=True, parser_class=_Parser)
        for part in ("get", "set", "remove"):
            p = payload.add_parser(part)
            p.add_argument("id")
            p.add_argument("pointer", nargs="?", default="")
            if part == "set":
                data_options(p)
            if part == "remove":
                p.add_argument("--ignore-missing", action="store_true")

    def ends(p, targets: bool):
        p.add_argument("--start", action="append", default=[])
        if targets:
            p.add_argument("--target", action="append", required=True)

    def budget(p):
        p.add_argument("--max-nodes", type=int, default=200_000)
        p.add_argument("--max-millis", type=int, default=10_000)

    query = commands.add_parser("query").add_subparsers(dest="action", required=True, parser_class=_Parser)
    ends(query.add_parser("closure"), False)
    ends(query.add_parser("diagnose"), True)
    way = query.add_parser("route")
    ends(way, True)
    budget(way)
    sub = commands.add_parser("subgraph").add_subparsers(dest="action", required=True, parser_class=_Parser)
    sub.add_parser("induced").add_argument("--point", action="append", default=[])
    ends(sub.add_parser("reachable"), False)
    way = sub.add_parser("route")
    ends(way, True)
    budget(way)
    commands.add_parser("apply").add_argument("operations")
    return top


def _value(spark, args, needed: bool):
    from .sources.document import read_limited

    if args.data is not None and args.data_file is not None:
        raise GraphError("invalid_arguments", "--data and --data-file exclude each other")
    if args.data_file is not None:
        return parse(read_limited(spark, args.data_file, args.max_value_bytes))
    if args.data is None:
        if needed:
            raise GraphError("invalid_arguments", "--data or --data-file is needed")
        return MISSING
    if len(args.data.encode()) > args.max_value_bytes:
        raise GraphError("input_limit_exceeded", "the value is too long", limit=args.max_value_bytes)
    return parse(args.data)


def execute(spark, args, text: bytes):
    """The result value of a command on a document."""
    from . import results as Z
    from .operators import edit as E
    from .sources import document as X

    graph = X.from_json(spark, text, limit=args.max_input_bytes)
    command, action = args.command, getattr(args, "action", None)
    if command == "validate":
        return X.value_of(graph)
    if command == "query":
        if action == "closure":
            return Z.closure(graph, args.start)
        return Z.diagnose(graph, args.start, args.target) if action == "diagnose" else Z.route(graph, args.start, args.target, args.max_nodes, args.max_millis)
    if command == "subgraph":
        if action == "induced":
            return Z.induced(graph, args.point)
        return Z.reachable(graph, args.start) if action == "reachable" else Z.route_subgraph(graph, args.start, args.target, args.max_nodes, args.max_millis)
    if command == "apply":
        return X.value_of(E.apply(graph, X.read_limited(spark, args.operations, args.max_input_bytes)))
    point = command == "point"
    rows = "points" if point else "hyperedges"
    if action == "list":
        return X.value_of(graph)[rows]
    if action == "get":
        (E.point_get if point else E.hyperedge_get)(graph, args.id)
        return next(x for x in X.value_of(graph)[rows] if x["id"] == args.id)
    if action == "data" and args.part == "get":
        return E.data_get(graph, command, args.id, args.pointer)
    if action == "data":
        change = E.data_set(graph, command, args.id, _value(spark, args, True), args.pointer) if args.part == "set" else E.data_remove(graph, command, args.id, args.pointer, args.ignore_missing)
    elif action == "add":
        change = E.point_add(graph, args.id, _value(spark, args, False)) if point else E.hyperedge_add(graph, args.id, args.tail, args.head, args.weight, _value(spark, args, False))
    elif action == "remove":
        change = E.point_remove(graph, args.id, args.cascade, args.ignore_missing) if point else E.hyperedge_remove(graph, args.id, args.ignore_missing)
    elif action == "rename":
        change = (E.point_rename if point else E.hyperedge_rename)(graph, args.id, args.new_id)
    elif args.part == "tails":
        change = E.hyperedge_set_tails(graph, args.id, args.tail)
    else:
        change = (E.hyperedge_set_head if args.part == "head" else E.hyperedge_set_weight)(graph, args.id, args.value)
    return X.value_of(change)


def run(argv: list[str], spark=None, text: bytes | None = None) -> tuple[int, str, str]:
    """(exit status, standard output, standard error) of a command line."""
    try:
        args = parser().parse_args(argv)
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("weft").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        if args.input is not None:
            from .sources.document import read_limited

            text = read_limited(spark, args.input, args.max_input_bytes)
        elif text is None:
            text = sys.stdin.buffer.read(args.max_input_bytes + 1)
        return 0, dump(execute(spark, args, text), args.pretty) + "\n", ""
    except GraphError as e:
        from .results import Number

        def exact(v):
            return Number(v) if isinstance(v, int) and not isinstance(v, bool) else {k: exact(x) for k, x in v.items()} if isinstance(v, dict) else [exact(x) for x in v] if isinstance(v, list) else v

        return e.exit_status, "", dump(exact(e.json())) + "\n"


def main() -> None:
    status, out, err = run(sys.argv[1:])
    try:
        sys.stdout.write(out)
        sys.stdout.flush()
    except OSError:
        status = 74
    sys.stderr.write(err)
    sys.exit(status)


if __name__ == "__main__":
    main()
