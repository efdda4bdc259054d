"""Source trees: a listing with languages, frameworks and vendors, and the texts of its files."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, compiler_options
from ..functions.scalars import classify_language, detect_framework, framework_class, glob_regex, matches_any


def inside(root: str, path: str, allowed: tuple[str, ...]) -> bool:
    """Whether a path, links followed, is in the root or in an allowed folder."""
    real = os.path.realpath(path)
    tops = [os.path.realpath(root), *(os.path.realpath(a) for a in allowed)]
    return any(real == t or real.startswith(t.rstrip(os.sep) + os.sep) for t in tops)


def walked(root: str, ignore: tuple[str, ...], allowed: tuple[str, ...] = ()) -> Iterator[str]:
    """Paths of a local tree below its root, in order of names; what globs ignore is not entered.

    Folders that cannot be read are left out, as are links that lead out of the root.
    """
    bad = [re.compile(glob_regex(g).replace(r"\z", r"\Z")) for g in ignore]

    def enter(folder: str) -> Iterator[str]:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path = os.path.relpath(e.path, root).replace(os.sep, "/")
            if any(b.match(path) for b in bad) or (e.is_symlink() and not inside(root, e.path, allowed)):
                continue
            if e.is_dir():
                yield from enter(e.path)
            elif e.is_file():
                yield path

    yield from enter(root)


def listed(spark: SparkSession, paths: DataFrame, config: Config) -> DataFrame:
    """(path, language, vendor, framework, framework_class) of the paths that have a language.

    Vendors' files are sources of their language and no tests.
    """
    p = F.col("path")
    vendor = matches_any(p, list(config.vendor))
    framework = F.when(~vendor, detect_framework(p, list(config.playwright), list(config.qunit), list(config.jest)))
    rows = paths.select("path", classify_language(p).alias("language"), vendor.alias("vendor"), framework.alias("framework")).filter("language is not null")
    return rows.withColumn("framework_class", framework_class(p, F.col("framework"), [(list(g), c) for g, c in config.classes]))


def discovered(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """The files of a tree with their texts: (path, language, vendor, framework, framework_class, text).

    The listing of a local tree is the driver's (paths alone); the texts are read by tasks, so
    the root must be a folder that all executors see.  A file that cannot be read is left out;
    bytes that are no UTF-8 are replaced.
    """
    paths = spark.createDataFrame([(p,) for p in walked(root, config.ignore, config.symlink_targets)], "path string")
    files = listed(spark, paths, config)
    top = "file:" + os.path.realpath(root).rstrip("/") + "/"
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(os.path.realpath(root))
    texts = read.select(F.substring("path", len(top) + 1, 1 << 20).alias("path"), F.decode("content", "UTF-8").alias("text"))
    return files.join(texts, "path")


_LOOSE = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', re.DOTALL)


def loose_json(text: str) -> dict:
    """A JSON object that may have comments and commas before closing brackets; of anything else the empty one."""
    plain = _LOOSE.sub(lambda m: m[1] or "", text)
    plain = re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", plain)
    try:
        made = json.loads(plain)
    except ValueError:
        return {}
    return made if isinstance(made, dict) else {}


def module_aliases(root: str, ignore: tuple[str, ...]) -> dict[str, list[tuple[str, list[str]]]]:
    """Aliases of modules by folder, from the tsconfig and jsconfig files of a local tree and what they extend."""
    texts = {}
    for path in walked(root, ignore):
        if re.search(r"(?:^|/)[jt]sconfig[^/]*\.json$", path):
            with open(os.path.join(root, path), encoding="utf-8", errors="replace") as f:
                texts[path] = loose_json(f.read())
    plain = {p for p in texts if re.search(r"(?:^|/)[jt]sconfig\.json$", p)}
    return compiler_options(texts, plain)


def id_list(spark: SparkSession, lines: list[str], column: str) -> DataFrame:
    """Ids that a caller names, with their places: trimmed, blank ones left out, repeats kept."""
    rows = [(i, x.strip()) for i, x in enumerate(lines) if x.strip()]
    return spark.createDataFrame(rows, f"place int, {column} string")
