"""The three questions on derived edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = ["test_id", "source", "framework", "framework_class", "confidence", "partial"]


def tests_from_sources(edges: DataFrame, tests: DataFrame, files: DataFrame, paths: DataFrame, framework: str | None = None, min_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(rows by test and source, paths that no file has)."""
    known = paths.join(files.select("path"), "path", "left_semi").select(F.col("path").alias("source")).distinct()
    rows = edges.filter(F.col("confidence") >= min_confidence).join(known, "source", "left_semi").join(tests, "test_id")
    if framework is not None:
        rows = rows.filter(F.col("framework") == framework)
    return rows.select(ROW).orderBy("test_id", "source"), paths.join(files.select("path"), "path", "left_anti")


def sources_from_tests(edges: DataFrame, tests: DataFrame, ids: DataFrame, min_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(rows by test and source, test ids that no test has)."""
    rows = edges.filter(F.col("confidence") >= min_confidence).join(ids.select("test_id").distinct(), "test_id", "left_semi").join(tests, "test_id")
    return rows.select(ROW).orderBy("test_id", "source"), ids.join(tests.select("test_id"), "test_id", "left_anti")


def emit_args(rows: DataFrame, column: str) -> str:
    """The distinct values of a column, sorted, a line each; the caller's answer, so it fits the caller."""
    return "\n".join(r[0] for r in rows.select(column).distinct().orderBy(column).collect())


def emit_json(rows: DataFrame, unknown_paths: list[str], unknown_test_ids: list[str]) -> str:
    import json

    return json.dumps({"edges": [r.asDict() for r in rows.collect()], "unknownPaths": unknown_paths, "unknownTestIds": unknown_test_ids}, separators=(",", ":"))
