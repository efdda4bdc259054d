"""What is left unresolved, as work for a reader: units with their place in the source, and texts that show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import context_lines
from .store import counts_of

#: Kinds of facts whose names a reader may find (fixed values).
KINDS = ["hook-fire", "hook-listener"]
MARGIN = 8


def with_gutter(text: Column, first: Column) -> Column:
    """The lines of a text, each after its number; ``first`` is the number of the first line."""
    lines = F.split(text, "\n", -1)
    width = F.length((first + F.size(lines) - 1).cast("string"))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((first + i).cast("string"), width, F.lit(" ")), F.lit(" | "), x)), "\n")


def fence_language(path: Column) -> Column:
    return F.when(path.endswith(".php"), "php").when(path.rlike(r"\.(?:tsx|ts|jsx|js|mjs|cjs)$"), "ts").otherwise("")


def units(facts: DataFrame, files: DataFrame, answered: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Unresolved facts to be answered, in the order of their ids.

    facts (fact_id, file_id, kind, resolved, start_line, end_line, payload); files (file_id, path,
    text); ``answered`` (expr_hash) are left out, as are facts without a block that says what is
    unresolved.  (fact_id, expr_hash, kind, expression, scope, path, first_line, last_line, context).
    """
    said = lambda where: F.get_json_object("payload", f"$.unresolved.{where}")
    rows = facts.filter(F.col("kind").isin(kinds or KINDS) & ~F.col("resolved")).select("fact_id", "file_id", "kind", "start_line", "end_line", said("exprHash").alias("expr_hash"), F.coalesce(said("fields[0].expression"), F.lit("")).alias("expression"), said("scope").alias("scope"))
    rows = rows.filter("expr_hash <> '' and scope is not null").join(answered.select("expr_hash"), "expr_hash", "left_anti").join(files.select("file_id", "path", "text"), "file_id").filter("text is not null")
    n = F.size(F.split("text", "\n", -1))
    made = rows.select("fact_id", "expr_hash", "kind", "expression", "scope", "path", F.greatest(F.col("start_line") - MARGIN, F.lit(1)).alias("first_line"), F.least(F.col("end_line") + MARGIN, n).alias("last_line"), context_lines(F.col("text"), F.col("start_line"), F.col("end_line"), MARGIN).alias("context"))
    # ids may repeat over files; without the path all rows of an id would go to one task
    return made.orderBy("fact_id", "path")


def unit_text(row: DataFrame) -> Column:
    """A unit as Markdown: its hash, kind, expression and scope, and the source around it with line numbers."""
    head = F.concat(F.lit("## Unit "), row["expr_hash"], F.lit("\n\n- kind: "), row["kind"], F.lit("\n- unresolved expression: `"), row["expression"], F.lit("`\n- enclosing scope: "), row["scope"])
    place = F.concat(F.lit("\n- file: "), row["path"], F.lit(" (lines "), row["first_line"].cast("string"), F.lit("-"), row["last_line"].cast("string"), F.lit(")\n\n```"))
    return F.concat(head, place, fence_language(row["path"]), F.lit("\n"), with_gutter(row["context"], row["first_line"]), F.lit("\n```"))


def status(facts: DataFrame, resolutions: DataFrame, classes: list[str]) -> DataFrame:
    """(what, value, n): how many facts of each kind are unresolved, and how many answers of each class there are; 0 where none."""
    open_ = counts_of(facts.filter(~F.col("resolved")).select("kind"), "kind", KINDS).select(F.lit("unresolved").alias("what"), F.col("kind").alias("value"), "n")
    return open_.unionByName(counts_of(resolutions, "classification", classes).select(F.lit("answers").alias("what"), F.col("classification").alias("value"), "n"))


def summary(files: DataFrame, facts: DataFrame, tests: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many files, facts, tests, edges and kinds of evidence there are."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(files, "files").crossJoin(n(facts, "facts")).crossJoin(n(tests, "tests")).crossJoin(edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum(F.size("evidence")), F.lit(0)).cast("long").alias("evidence")))
