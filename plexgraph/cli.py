"""Command line: python -m plexgraph.cli STORE COMMAND ..."""

from __future__ import annotations

import argparse
import csv
import io
import json
import sys

from pyspark.sql import SparkSession

from plexgraph import config
from plexgraph.engine import Engine


def shown(value) -> str:
    text = "" if value is None else str(value)
    return text if len(text) <= 50 else text[:47] + "..."


def formatted(rows: list[dict], form: str) -> str:
    """Rows as a table, JSON or CSV."""
    if form == "json":
        return json.dumps(rows, indent=2, default=str)
    names = list(rows[0]) if rows else []
    if form == "csv":
        out = io.StringIO()
        w = csv.DictWriter(out, names)
        w.writeheader()
        w.writerows(rows)
        return out.getvalue()
    cells = [names, *([shown(r[n]) for n in names] for r in rows)]
    widths = [max(len(line[i]) for line in cells) for i in range(len(names))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(line, widths)).rstrip() for line in cells)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plexgraph")
    p.add_argument("store", help="the store's folder, or - for the one that the settings name")
    p.add_argument("--config", help="a settings file; else the nearest one upwards is read")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="a store's folder, an empty graph and a settings file").add_argument("--force", action="store_true")
    u = sub.add_parser("update")
    u.add_argument("path", nargs="?", help="the source tree; by default the project root of the settings")
    u.add_argument("--full", action="store_true")
    q = sub.add_parser("query")
    q.add_argument("text")
    q.add_argument("--param", action="append", default=[], help="name=value")
    q.add_argument("--format", choices=("table", "json", "csv"), default="table")
    q.add_argument("--limit", type=int, default=100)
    for name in ("status", "templates", "vacuum"):
        sub.add_parser(name)
    sub.add_parser("reset").add_argument("--yes", action="store_true", help="do not ask")
    e = sub.add_parser("export")
    e.add_argument("path")
    e.add_argument("--format", choices=("json", "csv"), default="json")
    a = p.parse_args(args)
    settings = config.load(a.config)
    store = settings.storage.path if a.store == "-" else a.store
    if a.command == "reset" and not a.yes and input(f"Delete the graph in {store}? [y/N] ").strip().lower() not in ("y", "yes"):
        print("nothing done")
        return 1
    engine = Engine(SparkSession.builder.appName("plexgraph").getOrCreate(), store, tuple(settings.parsing.exclude_patterns), settings.parsing.max_file_size)
    if a.command == "init":
        print("version", engine.init(a.force))
        if not a.config and not config.find():
            settings.storage.path = store
            config.save(settings, config.FILE_NAME)
    elif a.command == "reset":
        print("version", engine.reset(confirmed=True))
    elif a.command == "update":
        print(json.dumps(engine.update(a.path or settings.project_root, a.full), indent=2))
    elif a.command == "status":
        print(json.dumps(engine.status(), indent=2))
    elif a.command == "vacuum":
        print("folders deleted", engine.store.vacuum(settings.storage.keep_versions))
    elif a.command == "templates":
        print(formatted([r.asDict() for r in engine.templates().collect()], "table"))
    elif a.command == "export":
        engine.export(a.path, a.format)
    else:
        params = {k: int(v) if v.lstrip("-").isdigit() else v for k, v in (x.split("=", 1) for x in a.param)}
        rows = engine.query(a.text, params)
        rows = rows if "LIMIT" in a.text.upper() else rows.limit(a.limit)
        print(formatted([r.asDict(recursive=True) for r in rows.collect()], a.format))
    return 0


if __name__ == "__main__":
    sys.exit(main())
