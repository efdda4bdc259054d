"""Command line: tests, sources and dependencies of a source tree.

    python -m impactlake tests --framework=jest [--from-sources] PATH...
    python -m impactlake sources [--from-tests] TEST...
    python -m impactlake dependencies [--from-sources] PATH...

Options: --format=args|json, --min-confidence=X, --strict, --timing, --timing-top=N, --root=FOLDER.
Without names they are read from standard input, a line each.
"""

from __future__ import annotations

import json
import math
import sys
import time
from dataclasses import dataclass, field

from .functions.scalars import FRAMEWORKS


@dataclass
class Command:
    kind: str
    names: list[str] = field(default_factory=list)
    framework: str | None = None
    format: str = "args"
    min_confidence: float = 0.0
    strict: bool = False
    timing: bool = False
    top: int = 0
    root: str = "."


def _number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return math.nan


def parse_argv(argv: list[str]) -> Command:
    """What is asked; of an option that is given twice the first sound value counts."""
    first, rest = (argv[0], argv[1:]) if argv else ("--help", [])
    known = {"--help": "help", "-h": "help", "--version": "version", "-V": "version", "config": "config", "tests": "tests", "sources": "sources", "dependencies": "dependencies"}
    if first not in known:
        return Command("unknown-command", [first])
    marker = "--from-tests" if first == "sources" else "--from-sources"
    names = []
    if marker in rest:
        for value in rest[rest.index(marker) + 1 :]:
            if value.startswith("-"):
                break
            names.append(value)
    else:
        names = [a for a in rest if not a.startswith("-")]

    def values(key: str) -> list[str]:
        return [a.partition("=")[2] for a in rest if a.startswith(key + "=")]

    out = Command(known[first], names, next(iter(values("--framework")), None), strict="--strict" in rest, root=next(iter(values("--root")), "."))
    out.format = next((v for v in values("--format") if v in ("args", "json")), "args")
    out.min_confidence = next((max(0.0, min(1.0, v)) for v in map(_number, values("--min-confidence")) if math.isfinite(v)), 0.0)
    tops = [int(v) for v in map(_number, values("--timing-top")) if math.isfinite(v) and v > 0]
    out.timing, out.top = "--timing" in rest or bool(tops), tops[-1] if tops else 0
    return out


def main(argv: list[str], stdin: list[str] | None = None) -> int:
    asked = parse_argv(argv)
    if asked.kind in ("help", "version", "unknown-command"):
        print(__doc__.strip() if asked.kind != "version" else "impactlake", file=sys.stderr if asked.kind == "unknown-command" else sys.stdout)
        return int(asked.kind == "unknown-command")
    from .config import ConfigError, find_config, load_config

    try:
        root, path = find_config(asked.root)
        config = load_config(path)
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 1
    if asked.kind == "config":
        print(config)
        return 0
    if asked.kind == "tests" and asked.framework not in FRAMEWORKS:
        print(f"--framework must be one of {', '.join(FRAMEWORKS)}", file=sys.stderr)
        return 1
    names = asked.names or [x.strip() for x in (stdin if stdin is not None else sys.stdin) if x.strip()]
    if not names:
        print("nothing is asked", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from .extract.build import graph
    from .operators import lookup
    from .operators.traverse import dependencies, derive
    from .plans.session import ship_package
    from .sources.tree import discovered, id_list, module_aliases

    began = time.time()
    spark = SparkSession.builder.getOrCreate()
    ship_package(spark)
    g = graph(discovered(spark, root, config), module_aliases(root, config.ignore), extra=list(config.extractors), test_bases=config.phpunit_bases, wrappers=list(config.wrappers))
    plain = g["files"].select("file_id", "path", "framework", "vendor")
    if asked.kind == "dependencies":
        rows, unknown = dependencies(plain, g["facts"], g["links"], id_list(spark, names, "path").select("path"), asked.min_confidence, list(config.stop_list), config.cap)
        lost = {r.path for r in unknown.collect()}
    else:
        edges = derive(plain, g["facts"], g["links"], g["tests"], config.max_depth, config.threshold, list(config.stop_list), config.cap)
        if asked.kind == "tests":
            rows, unknown = lookup.tests_from_sources(edges, g["tests"], plain, id_list(spark, names, "path"), asked.framework, asked.min_confidence)
            lost = {r.path for r in unknown.collect()}
        else:
            rows, unknown = lookup.sources_from_tests(edges, g["tests"], id_list(spark, names, "test_id"), asked.min_confidence)
            lost = {r.test_id for r in unknown.collect()}
    missing = [n for n in names if n in lost]
    for n in missing:
        print(f"unknown: {n}", file=sys.stderr)
    if asked.strict and missing:
        return 2
    column = {"tests": "test_id", "sources": "source", "dependencies": "target"}[asked.kind]
    if asked.format == "args":
        print(lookup.emit_args(rows, column))
    elif asked.kind == "dependencies":
        print(json.dumps({"dependencies": [r.asDict() for r in rows.collect()], "unknownPaths": missing}, separators=(",", ":")))
    else:
        print(lookup.emit_json(rows, missing if asked.kind == "tests" else [], missing if asked.kind == "sources" else []))
    if asked.timing:
        print(f"total {time.time() - began:.1f} s", file=sys.stderr)
        for r in g["facts"].groupBy("file_id").count().join(plain, "file_id").orderBy("count", ascending=False).limit(asked.top).collect() if asked.top else ():
            print(f"{r['count']} facts: {r.path}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
