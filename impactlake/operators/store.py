"""The store's writes as table functions: each takes tables and gives the tables that a write leaves.

Tables are never changed in place.  Where several rows of one write meet on a key, ``ord``
(a column of the new rows) says which was written last.  Ids of new rows follow the largest
id there is, in the order of ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import stage


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2, ... in the order of columns that tell rows apart.

    Rows are dealt by ranges and counted by range, so they do not meet in one task.
    """
    dealt = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("__at")), "numbered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    # a row for each range
    before = sizes.selectExpr("__part", "coalesce(sum(n) over (order by __part rows between unbounded preceding and 1 preceding), 0) as __before")
    return dealt.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + place).drop("__part", "__before", "__at")


def last_of(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The row of each key with the greatest ``order``; the column ``order`` is left out."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest) if rest else F.lit(0), order).alias("__last"))
    return last.select(*[k for k in rows.columns if k in keys], *[F.col(f"__last.{c}").alias(c) for c in rest]).select(*[c for c in rows.columns if c != order])


def replaced(old: DataFrame, new: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """``old`` with the last of ``new`` by key in place of rows of that key."""
    last = last_of(new, keys, order)
    return old.join(last.select(*keys), keys, "left_anti").select(*last.columns).unionByName(last)


def next_ids(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """``new`` with ids after the largest of ``old``."""
    top = old.agg(F.coalesce(F.max(name), F.lit(0)).alias("__top"))
    return numbered(new, ["ord"], "__n").crossJoin(F.broadcast(top)).withColumn(name, F.col("__top") + F.col("__n") + 1).drop("__n", "__top", "ord")


def upsert_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """``files`` (file_id, path, ...) after writing ``new`` (path, ..., ord): a known path keeps its id."""
    last = last_of(new, ["path"])
    known = last.join(files.select("path", "file_id"), "path")
    first = new.groupBy("path").agg(F.min("ord").alias("ord"))
    fresh = next_ids(files, last.join(files.select("path"), "path", "left_anti").join(first, "path"), "file_id")
    written = known.select(*files.columns).unionByName(fresh.select(*files.columns))
    return files.join(last.select("path"), "path", "left_anti").select(*files.columns).unionByName(written)


def insert_facts(facts: DataFrame, new: DataFrame) -> DataFrame:
    """``facts`` and ``new`` (columns of facts without fact_id, and ord) with ids of their own."""
    return facts.unionByName(next_ids(facts, new, "fact_id").select(*facts.columns))


def upsert_anchors(anchors: DataFrame, new: DataFrame) -> DataFrame:
    """``anchors`` (anchor_id, key, type) after ``new`` (key, type, ord): a known key keeps its id and takes the type."""
    last, first = last_of(new, ["key"]), new.groupBy("key").agg(F.min("ord").alias("ord"))
    known = last.join(anchors.select("key", "anchor_id"), "key").select(*anchors.columns)
    fresh = next_ids(anchors, last.join(anchors, "key", "left_anti").join(first, "key"), "anchor_id").select(*anchors.columns)
    return anchors.join(last, "key", "left_anti").unionByName(known).unionByName(fresh)


def insert_or_ignore(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` and those of ``new`` whose key is not there; of several new rows of a key the least."""
    rest = [c for c in rows.columns if c not in keys]
    fresh = new.join(rows.select(*keys), keys, "left_anti")
    one = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__one")).select(*keys, *[F.col(f"__one.{c}").alias(c) for c in rest]) if rest else fresh.select(*keys).distinct()
    return rows.unionByName(one.select(*rows.columns))


def delete_file_facts(tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """``facts``, ``links``, ``tests`` and ``call_sites`` without the facts of ``files`` (file_id) and what hangs on them."""
    gone = tables["facts"].join(files.select("file_id").distinct(), "file_id", "left_semi").select("fact_id")
    return {name: df.join(gone, "fact_id", "left_anti").select(*df.columns) for name, df in tables.items()}


def without_orphans(edges: DataFrame, tests: DataFrame) -> DataFrame:
    """Edges whose test is still there."""
    return edges.join(tests.select("test_id"), "test_id", "left_semi")


def without_tests(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges of other tests than ``gone`` (test_id)."""
    return edges.join(gone.select("test_id"), "test_id", "left_anti")


def patched(facts: DataFrame, patches: DataFrame) -> DataFrame:
    """Facts with ``resolved`` and ``payload`` of the last patch (fact_id, resolved, payload, ord) of each."""
    last = last_of(patches, ["fact_id"]).select("fact_id", F.struct("resolved", "payload").alias("__new"))
    new = lambda c: F.when(F.col("__new").isNull(), F.col(c)).otherwise(F.col(f"__new.{c}")).alias(c)
    return facts.join(last, "fact_id", "left").select(*[new(c) if c in ("resolved", "payload") else c for c in facts.columns])


def repointed(links: DataFrame, moves: DataFrame) -> DataFrame:
    """Links (fact_id, key, role) with those of ``moves`` (fact_id, role, key, new_key) at their new key; what meets there is one."""
    moved = links.join(moves, ["fact_id", "role", "key"], "left").select("fact_id", F.coalesce("new_key", "key").alias("key"), "role")
    return moved.distinct()


def upsert_resolutions(resolutions: DataFrame, new: DataFrame) -> DataFrame:
    """Resolutions by (expr_hash, pass) after writing ``new``."""
    return replaced(resolutions, new, ["expr_hash", "pass"])


def prune_resolutions(resolutions: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolutions whose expr_hash is live, the number of the others)."""
    stale = resolutions.join(live.select("expr_hash"), "expr_hash", "left_anti").agg(F.count("*").alias("stale"))
    return resolutions.join(live.select("expr_hash"), "expr_hash", "left_semi"), stale


def counts_of(rows: DataFrame, column: str, domain: list[str], name: str = "n") -> DataFrame:
    """(column, n) for every value of ``domain``, 0 where none; other values are left out."""
    every = rows.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    return every.join(rows.groupBy(column).agg(F.count("*").alias(name)), column, "left").select(column, F.coalesce(name, F.lit(0)).cast("long").alias(name))


def edge_counts(edges: DataFrame) -> DataFrame:
    """(edges, evidence): how many rows, and kinds of evidence in them."""
    return edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum(F.size("evidence")), F.lit(0)).cast("long").alias("evidence"))


def unanimous(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) of the keys all of whose rows have one value, none of them null."""
    agg = rows.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__most"), F.count(value).alias("__n"), F.count("*").alias("__all"))
    return agg.filter(F.col(value).eqNullSafe(F.col("__most")) & (F.col("__n") == F.col("__all"))).select(*keys, value)


def unambiguous(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) of the keys whose rows, nulls apart, have one value."""
    agg = rows.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__most"))
    return agg.filter(F.col(value) == F.col("__most")).select(*keys, value)


def merged_wrappers(rows: DataFrame) -> DataFrame:
    """One wrapper of each (name, def_file, def_start_line, kind): what configuration says before what was found, then the first by ord."""
    first = F.struct((F.col("source") != "config").alias("found"), "ord")
    keys = ["name", "def_file", "def_start_line", "kind"]
    rest = [c for c in rows.columns if c not in (*keys, "ord")]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), first).alias("__one")).select(*keys, *[F.col(f"__one.{c}").alias(c) for c in rest])


def wrapper_call_sites(calls: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(fact_id, wrapper_id) of calls (fact_id, name) of wrappers (wrapper_id, name, ord); the last wrapper of a name counts."""
    return calls.join(last_of(wrappers.select("name", "wrapper_id", "ord"), ["name"]), "name").select("fact_id", "wrapper_id").distinct()


def json_object(payload: Column) -> Column:
    """A JSON text, or ``{}`` where it is no object."""
    return F.when(F.coalesce(F.try_parse_json(payload).isNotNull(), F.lit(False)) & payload.rlike(r"^\s*\{"), payload).otherwise("{}")
