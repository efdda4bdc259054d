"""Chat formatting of reply trees, with DataFrame operations only.

Every node of a tree knows its parent.  Self-joins that double the distance (a node's
parent, its parent's parent, ...) give each node its root, depth and the sum of scores on
its way; leaves rank their branches by mean score; the same tables of ancestors, joined
in turn, give the nodes of each chosen path.  A path is one conversation:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

once for each turn.  In texts and roles a backslash is doubled and ``<|`` becomes
``<\\|``; in roles a newline gets a backslash before it.  So markers are never part of a
text, and ``unescape`` gives back what was there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, dropped, partitions, read_table, shared_dir, stage, tidy_shuffles

START, END = "<|im_start|>", "<|im_end|>"
LEARNT_ROLE = "assistant"
#: Parts in which texts are dealt to their conversations, so that shuffle files hold one part at a time.
PASSES = 2
#: Internal key of conversations, and the setting under which a join on more columns keeps it as the only key to deal by.
KEY, CO_PARTITION = "__conv", "spark.sql.requireAllClusterKeysForCoPartition"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\\n"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with the column KEY; null conversations have a key of their own."""
    return rows if KEY in rows.columns else rows.withColumn(KEY, F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")))


def chain(turns: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees of one branch.

    Rows go by turn, equal turns by role and text; null turns come first.
    """
    order = Window.partitionBy(KEY).orderBy("turn", "role", "text")
    rows = _keyed(turns).select(KEY, "conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return rows.select(KEY, "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def choose_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(conv, branch, node, depth) of the best ``branches`` root-to-leaf paths of each conversation.

    nodes: (conv, node, parent, score), node ids unique in a conversation.  A node whose
    parent is null or not there is a root; a conversation may have several.  Branches rank
    by mean score, then length, then leaf id.  Nodes on a cycle are on no path.
    """
    known = nodes.select("conv", F.col("node").alias("parent")).distinct().withColumn("there", F.lit(True))
    base = nodes.join(known, ["conv", "parent"], "left").select("conv", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"))
    state = stage(base.select("conv", "node", "up", F.col("up").isNotNull().cast("long").alias("depth"), "total"), "tree")
    leaves = state.select("conv", "node").join(state.select("conv", F.col("up").alias("node")).distinct(), ["conv", "node"], "left_anti")
    levels, settled = [], []
    # distances double in each round, so after these only nodes on and below cycles are left
    largest = state.groupBy("conv").count().agg(F.max("count")).first()[0] or 1
    for _ in range(largest.bit_length() + 1):
        moving = state.filter("up is not null")
        if moving.limit(1).count() == 0:
            break
        levels.append(moving.select("conv", "node", "up"))
        above = state.select("conv", F.col("node").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"), F.col("total").alias("sum"))
        moved = moving.join(above, ["conv", "up"], "left").select("conv", "node", F.col("far").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("sum", F.lit(0.0))).alias("total"))
        moved = stage(moved, "ancestors")
        whole = state.filter("up is null").unionByName(moved)
        # conversations of which all nodes know their root are not looked at again
        unsettled = stage(moved.filter("up is not null").select("conv").distinct(), "unsettled")
        columns = ["conv", "node", "up", "depth", "total"]
        settled.append(stage(whole.join(unsettled, "conv", "left_anti").select(*columns), "settled"))
        state = stage(whole.join(unsettled, "conv", "left_semi").select(*columns), "tree")
        dropped(moved, unsettled)
    for part in settled:
        state = state.unionByName(part)
    ends = state.filter("up is null").join(leaves, ["conv", "node"], "left_semi")
    rank = Window.partitionBy("conv").orderBy(F.desc(F.col("total") / (F.col("depth") + 1)), F.desc("depth"), "node")
    chosen = ends.withColumn("branch", F.row_number().over(rank)).filter(F.col("branch") <= branches)
    path = stage(chosen.select("conv", "branch", "node", "depth"), "path")
    for k, level in enumerate(levels):
        up = path.join(level, ["conv", "node"]).select("conv", "branch", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        # written, or the plan would double with each level
        path = path.union(stage(up, "path"))
    return path


def _dealt(nodes: DataFrame) -> str:
    """A table of nodes with the column KEY, written in buckets by it; each of the passes shuffles its share of the texts."""
    spark = nodes.sparkSession
    path = shared_dir(spark, "nodes")
    name = "nodes_" + path[-32:]
    for k in range(PASSES):
        part = nodes.filter(F.pmod(F.xxhash64(KEY), F.lit(PASSES)) == k).repartition(partitions(spark), KEY)
        part.write.mode("append").bucketBy(partitions(spark), KEY).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return name


def format_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, branch, formatted, loss): each chosen path as one conversation.

    nodes: (conv_id, node, parent, role, text, score).  Null roles and texts are empty.
    A null conv_id is a conversation of its own.  ``loss`` lists the [start, end) code
    points of the escaped assistant texts in ``formatted``.  No nodes: no rows.
    """
    spark = nodes.sparkSession
    before = spark.conf.get(CO_PARTITION)
    with tidy_shuffles(spark):
        table = _dealt(_keyed(nodes).select(KEY, "conv_id", "node", "parent", "role", "text", "score"))
        keyed = spark.table(table).withColumnRenamed(KEY, "conv")
        path = choose_paths(keyed.select("conv", "node", "parent", "score"), branches)
        try:
            # texts are dealt by conversation already, and only the paths move
            spark.conf.set(CO_PARTITION, "false")
            made = stage(_formatted(keyed, path), "chat")
        finally:
            spark.conf.set(CO_PARTITION, before)
        drop_table(spark, table)
    return made


def _formatted(keyed: DataFrame, path: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = keyed.select("conv", "conv_id", "node", "role", "text").join(path, ["conv", "node"])
    rows = rows.select("conv", "conv_id", "branch", "depth", (role == LEARNT_ROLE).alias("learnt"), F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"), escape(text).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0)) + F.length("head")
    rows = rows.withColumn("start", begin).withColumn("end", F.col("start") + F.length("body"))
    made = rows.groupBy("conv", "branch").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("depth", "piece", "learnt", "start", "end"))).alias("all"))
    loss = F.transform(F.filter("all", lambda t: t["learnt"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return made.select("conv_id", "branch", F.array_join(F.transform("all", lambda t: t["piece"]), "").alias("formatted"), loss.alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, of a formatted conversation."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    shape = r"(?s)^((?:[^\\\n]|\\.)*+)\n(.*)<\|im_end\|>\n$"
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(unescape(F.regexp_extract(p, shape, 1)).alias("role"), unescape(F.regexp_extract(p, shape, 2)).alias("text")))


def learnt_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")


def chat_digest(formatted: DataFrame) -> DataFrame:
    rows = formatted.select("conv_id", "formatted", "loss", parse(F.col("formatted")).alias("turns"), learnt_text(F.col("formatted"), F.col("loss")).alias("learnt"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


HARD = f"{END}{START}assistant ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts hold the template's control strings."""
    hard = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat_digest(format_trees(chain(rows.union(hard))))


ORACLE_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), s as (select *, replace(replace(x, '\', '\\'), '<|', '<\|') ex, replace(replace(replace(r, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10)) er from t)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn, r, x)) turns_sha256,
  sum(case when r = 'assistant' then length(x) else 0 end)::bigint loss_chars,
  sha256(coalesce(string_agg(case when r = 'assistant' then x end, '' order by turn, r, x), '')) loss_sha256,
  sum(length(er) + length(ex) + 24)::bigint formatted_chars
from s group by conv_id
"""
