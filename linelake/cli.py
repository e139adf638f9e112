"""Commands: index, profile, count, info, state, vacuum, clean."""

from __future__ import annotations

import argparse
import json
import re
from dataclasses import asdict
from urllib.parse import unquote

from pyspark.sql import SparkSession

from . import files
from .lake import Lake
from .operators import legacy
from .sources.lines import counts_by_file, scan


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linelake", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "profile", "count", "info", "state", "vacuum", "clean"):
        c = sub.add_parser(name)
        c.add_argument("path")
        if name == "index":
            c.add_argument("--pk", default="id")
            c.add_argument("--facet", default="")
        elif name == "profile":
            c.add_argument("--top", type=int, default=20)
            c.add_argument("--json", action="store_true")
            c.add_argument("--legacy-json", action="store_true")
        elif name in ("count", "info", "clean"):
            c.add_argument("-r", "--recursive", action="store_true")
            if name == "clean":
                c.add_argument("--dry-run", action="store_true")
        elif name == "state":
            c.add_argument("--ensure", action="store_true")
            c.add_argument("-j", "--json", action="store_true")
    return p


def _profile(lake: Lake, a: argparse.Namespace) -> None:
    found = lake.profile(a.top)
    rows = [r.asDict(recursive=True) for r in found.fields.orderBy(found.fields.present.desc(), "path").collect()]  # at most 2000
    if a.legacy_json:
        for r in rows:
            if r["is_array"]:
                inside = lake.elements(r["path"]).first()
                r["elements"] = inside.asDict() if inside else None
    doc = legacy.document(a.path, found.rows, rows)
    if a.legacy_json:
        files.write_json(lake.spark, a.path.removesuffix(".gz").removesuffix(".jsonl").rstrip("/") + ".profile.json", doc)
    if a.json:
        print(json.dumps(rows, ensure_ascii=False, default=str))
        return
    for path, field in doc["fields"].items():
        x = legacy.labels(field)
        print(f"{path:30} {x['types']:16} {field['total']:>9} {x['distinct']:>10} {'array' if field['isArray'] else '':6} {x['top']:40} {x['hints']}")
    print(f"{found.rows} rows, {found.invalid} invalid" + (f", {found.truncated} fields left out" if found.truncated else ""))


def _counts(spark: SparkSession, path: str, recursive: bool) -> list[tuple[str, int]]:
    """Line ends by file, most first, in one job. Empty files have none."""
    found = files.listing(spark, path, recursive)
    if not found:
        return []
    counts = {unquote(r["file"]): r["ends"] for r in counts_by_file(scan(spark, [e.path for e in found])).collect()}  # a row for each file listed
    plain = {re.sub("^file:/+", "file:/", k): n for k, n in counts.items()}
    return sorted(((e.path, plain.get(re.sub("^file:/+", "file:/", e.path), 0)) for e in found), key=lambda x: (-x[1], x[0]))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done; 2: no such dataset."""
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("linelake").getOrCreate()
    lake = Lake(spark, a.path)
    if a.command not in ("state", "clean") and not files.exists(spark, a.path):
        print(f"{a.path} does not exist")
        return 2
    if a.command == "index":
        with lake.lock():
            print(json.dumps(asdict(lake.index(a.pk.split(","), [f for f in a.facet.split(",") if f]))))
    elif a.command == "profile":
        with lake.lock():
            _profile(lake, a)
    elif a.command == "count":
        counts = _counts(spark, a.path, a.recursive)
        for path, n in counts:
            print(f"{n:>12} {path}")
        if len(counts) > 1:
            print(f"{sum(n for _, n in counts):>12} TOTAL")
    elif a.command == "info":
        meta, stats = lake.state.load(), lake.stats()
        print(json.dumps({
            "path": a.path, "rows": lake.state.rows(), "completed": meta.completed, "fresh": lake.state.fresh(), "keys": lake.key_count(), "facets": meta.facetFields,
            "fields": stats.count() if stats is not None else 0, "cache": lake.has_cache(), "files": [asdict(e) for e in files.listing(spark, a.path, a.recursive)],
        }, ensure_ascii=False))
    elif a.command == "state":
        meta = lake.state.ensure() if a.ensure else lake.state.load()
        shown = asdict(meta) | {"exists": lake.state.exists(), "fresh": lake.state.fresh()}
        print(json.dumps(shown, ensure_ascii=False) if a.json else "\n".join(f"{k}: {v}" for k, v in shown.items()))
    elif a.command == "vacuum":
        print("dropped the kept rows" if lake.vacuum() else "nothing to drop")
    elif a.command == "clean":
        old = [e.path for e in files.listing(spark, a.path, a.recursive, (".sidecar.json", ".sidecar.json.tmp"))]
        for path in [*old, *([lake.state.side] if files.exists(spark, lake.state.side) else [])]:  # both can be built again from the data
            print(path)
            if not a.dry_run:
                files.delete(spark, path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
