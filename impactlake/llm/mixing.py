"""Mixing sources to target weights by hierarchical budgeting, with DataFrame operations only.

Domains hold languages, languages hold sources.  A budget of tokens goes down the tree in
proportion to weights; what a node cannot use (its capacity is its tokens in all allowed
epochs) goes to its siblings first, and leaves the parent only when all of them are full.
Each leaf takes a prefix of a stream of seeded epochs: every epoch holds all documents of
the leaf, ordered by a hash of seed, epoch and id.

All arithmetic on budgets, and their order, is in integers, so results do not depend on how rows are dealt.
The prefix's end is found by sums over ranges of hashes, so no leaf meets in one task; the
leaf table (one row for each source) is all that is joined with the documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stage

SEED = 17
#: Parts per 100 of all tokens that the mix may take.
BUDGET_PERCENT = 80
EPOCHS = 2
#: Domains that sources are dealt to where no domain column is there.
DOMAINS = 4
#: Weights of the names of each level where the caller gives none; a name that is not listed has OTHER_WEIGHT.
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
WEIGHTS = {"lang": LANGUAGE_WEIGHTS}
OTHER_WEIGHT = 1
LEVELS = ("domain", "lang", "source")
#: Names that columns of documents do not have.
OWN = "__mix_"
#: What the mix says of a document.
TAKEN = ("epochs_taken", "tokens_taken", "tokens", "domain")


def tokens_of(text: Column) -> Column:
    """White-space separated words; null: none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """The key columns of a document: null languages and sources are the empty string."""
    lang, source = F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))
    domain = F.concat(F.lit("d"), F.pmod(F.ascii(F.md5(source)), F.lit(DOMAINS)).cast("string"))
    return docs.select("*", *[c.alias(OWN + name) for name, c in (("domain", domain), ("lang", lang), ("source", source), ("tokens", tokens_of(F.col("text"))))])


def spot(epoch: Column, doc_id: Column, seed: int = SEED) -> Column:
    """A document's place in an epoch: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _filled(nodes: DataFrame, budget: DataFrame | Column, parents: list[str], common: int) -> DataFrame:
    """Budgets of nodes (parents..., name, weight, cap) from budgets of their parents (of the root: a column).

    A node is full where its capacity is below its share of what fuller siblings leave;
    the others share the rest by weight, rounded down, and the tokens that rounding leaves
    go to the first of them that have room, one each.
    """
    rows = nodes.join(budget, parents) if parents else nodes.withColumn("budget", budget)
    # capacity by weight, in whole numbers: ``common`` is a multiple of every weight
    by_weight = F.col("cap") * (F.lit(common) / F.col("weight")).cast("long")
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = siblings.orderBy(by_weight, "name")
    rows = rows.withColumn("caps", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("caps", F.coalesce("caps", F.lit(0).cast("long")))
    rows = rows.withColumn("weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    full = F.col("cap") * F.col("weights") <= F.col("weight") * (F.col("budget") - F.col("caps"))
    rows = rows.withColumn("full", F.min(full.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(siblings), F.lit(0).cast("long"))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(siblings)
    rows = rows.withColumn("rest", rest).withColumn("open", open_weight)
    rows = rows.withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("rest * weight div open")))
    left = F.when(F.col("open").isNull(), F.lit(0).cast("long")).otherwise(F.col("budget") - F.sum("got").over(siblings))
    rows = rows.withColumn("left", left).withColumn("room", F.sum((F.col("cap") > F.col("got")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    extra = F.when((F.col("cap") > F.col("got")) & (F.col("room") <= F.col("left")), 1).otherwise(0)
    return rows.select(*parents, "name", (F.col("got") + extra).alias("budget"))


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col("name") == name, w).otherwise(out)
    return out.cast("long")


def common_multiple(level: str, weights: dict[str, dict[str, int]]) -> int:
    return math.lcm(OTHER_WEIGHT, *weights.get(level, {}).values())


def leaf_budgets(leaves: DataFrame, budget_percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """(domain, lang, source, n, budget) from leaves (domain, lang, source, n tokens).

    ``weights``: positive whole numbers by level and name; a name that is not there has OTHER_WEIGHT.
    """
    weights = WEIGHTS if weights is None else weights
    caps = leaves.select(*LEVELS, (F.col("n") * epochs).alias("cap"))
    budget: DataFrame | Column = F.expr(f"(sum(cap) over (partition by 1) div {epochs}) * {budget_percent} div 100")
    for k, level in enumerate(LEVELS):
        parents = list(LEVELS[:k])
        nodes = caps.groupBy(*parents, F.col(level).alias("name")).agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(level, weights))
        budget = _filled(nodes, budget, parents, common_multiple(level, weights)).withColumnRenamed("name", level)
    return leaves.join(budget, list(LEVELS))


def epoch_cuts(docs: DataFrame, budget_percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] | None = None, seed: int = SEED) -> DataFrame:
    """(domain, lang, source, whole, cut_spot, cut_id, cut_tokens): each leaf takes ``whole`` full epochs, and of the next the documents before the cut and ``cut_tokens`` of the document at it.

    The range of hashes in which a leaf's prefix ends is refined once: sums over ranges of
    three digits, then within the range met over three more, so what is ordered row by row
    is one in 16 million of a leaf.
    """
    leaf = [F.col(OWN + c).alias(c) for c in LEVELS]
    rows = keyed(docs).select(*leaf, F.col("doc_id"), F.col(OWN + "tokens").alias("tokens"))
    leaves = stage(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("n")).filter("n > 0"), "leaves")
    plan = leaf_budgets(leaves, budget_percent, epochs, weights)
    plan = stage(plan.select(*LEVELS, F.expr("budget div n").alias("whole"), F.expr("budget % n").alias("part")), "budgets")
    open_ = rows.join(plan.filter("part > 0"), list(LEVELS)).select(*LEVELS, "whole", "part", "doc_id", "tokens", spot(F.col("whole"), F.col("doc_id"), seed).alias("spot"))
    near = open_.withColumn("before", F.lit(0).cast("long"))
    in_order = Window.partitionBy(*LEVELS).orderBy("range")
    for digits in (3, 6):
        ranges = near.groupBy(*LEVELS, "part", "before", F.substring("spot", 1, digits).alias("range")).agg(F.sum("tokens").alias("sum"))
        ranges = ranges.withColumn("upto", F.col("before") + F.sum("sum").over(in_order))
        met = stage(ranges.filter("upto >= part and upto - sum < part").select(*LEVELS, "range", (F.col("upto") - F.col("sum")).alias("before")), "met")
        near = open_.join(met, [*LEVELS]).filter(F.substring("spot", 1, digits) == F.col("range")).drop("range")
    row_order = Window.partitionBy(*LEVELS).orderBy("spot", "doc_id", "tokens")
    near = near.withColumn("upto", F.col("before") + F.sum("tokens").over(row_order.rowsBetween(Window.unboundedPreceding, 0)))
    cut = near.filter("upto >= part and upto - tokens < part").select(*LEVELS, F.col("spot").alias("cut_spot"), F.col("doc_id").alias("cut_id"), (F.col("part") - F.col("upto") + F.col("tokens")).alias("cut_tokens"))
    return plan.select(*LEVELS, "whole").join(cut, list(LEVELS), "left")


def _mixed(docs: DataFrame, budget_percent: int, epochs: int, weights: dict[str, dict[str, int]] | None, seed: int) -> DataFrame:
    """``docs`` with what the mix takes, in columns whose names begin with OWN."""
    cuts = stage(epoch_cuts(docs, budget_percent, epochs, weights, seed), "cuts")
    cuts = cuts.select(*[F.col(c).alias(OWN + c) for c in LEVELS], F.col("whole").alias(OWN + "whole"), F.col("cut_spot").alias(OWN + "spot"), F.col("cut_tokens").alias(OWN + "cut"))
    rows = keyed(docs).join(cuts, [OWN + c for c in LEVELS], "left")
    of = lambda c: F.col(OWN + c)
    own = spot(of("whole"), F.col("doc_id"), seed)
    part = F.when(own < of("spot"), of("tokens")).when(own == of("spot"), F.least(of("cut"), of("tokens"))).otherwise(0)
    whole = F.when(of("tokens") > 0, F.coalesce(of("whole"), F.lit(0))).otherwise(0)
    taken = whole * of("tokens") + F.when(of("spot").isNull(), 0).otherwise(part)
    return rows.select(*docs.columns, whole.cast("long").alias(OWN + "epochs_taken"), taken.cast("long").alias(OWN + "tokens_taken"), of("tokens"), of("domain"))


def mixed(docs: DataFrame, budget_percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with what the mix takes of each row: ``epochs_taken`` whole epochs and ``tokens_taken`` in all, with its ``tokens`` and ``domain``.

    docs needs doc_id, text, lang and source; all its other columns stay, but columns that
    have the names of these four results give way to them.  Null languages and sources are
    leaves of their own; documents without tokens take no budget and are taken in no epoch.
    Rows with the same id share a spot, and of rows at a cut's spot each takes what the cut
    leaves to one of them.  An empty table stays empty.
    """
    rows = _mixed(docs, budget_percent, epochs, weights, seed)
    return rows.select(*[c for c in docs.columns if c not in TAKEN], *[F.col(OWN + c).alias(c) for c in TAKEN])


def mixture(docs: DataFrame, budget_percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] | None = None, seed: int = SEED) -> DataFrame:
    """The documents of the mix, columns as they were whatever their names: a row for each epoch that takes any of a document (whole texts)."""
    rows = _mixed(docs, budget_percent, epochs, weights, seed)
    whole, taken = F.col(OWN + "epochs_taken"), F.col(OWN + "tokens_taken")
    times = (whole + (taken > whole * F.col(OWN + "tokens")).cast("long")).cast("int")
    return rows.filter(taken > 0).withColumn(OWN + "time", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "domain", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "tokens", "epochs_taken", "tokens_taken")


def _level_sql(name: str, parents: str, weight: str, budget: str) -> str:
    common = common_multiple(name, WEIGHTS)
    on = f"using ({parents})" if parents else "on true"
    by = f"partition by {parents}" if parents else ""
    keys = f"{parents}, " if parents else ""
    group = f"{keys}{name}"
    return f"""{name}_0 as (select {group}, sum(n * {EPOCHS})::hugeint cap, {weight}::hugeint weight from leaves group by all),
{name}_1 as (select c.*, b.budget, coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0) caps, sum(weight) over (w rows between current row and unbounded following) weights
  from {name}_0 c join {budget} b {on} window w as ({by} order by cap * ({common} // weight), {name})),
{name}_2 as (select *, min((cap * weights <= weight * (budget - caps))::int) over ({by} order by cap * ({common} // weight), {name} rows between unbounded preceding and current row) = 1 f from {name}_1),
{name}_3 as (select *, budget - coalesce(sum(case when f then cap end) over ({by}), 0) rest, sum(case when not f then weight end) over ({by}) open from {name}_2),
{name}_4 as (select *, case when f then cap else rest * weight // open end got from {name}_3),
{name}_5 as (select *, case when open is null then 0 else budget - sum(got) over ({by}) end remain, sum((cap > got)::int) over ({by} order by cap * ({common} // weight), {name} rows between unbounded preceding and current row) room from {name}_4),
{name}_b as (select {group}, got + case when cap > got and room <= remain then 1 else 0 end budget from {name}_5)"""


_LANG_WEIGHT = "case lang " + " ".join(f"when '{k}' then {v}" for k, v in LANGUAGE_WEIGHTS.items()) + f" else {OTHER_WEIGHT} end"
ORACLE_SQL = f"""
with d as (select doc_id, 'd' || (ascii(substr(md5(coalesce(source, '')), 1, 1)) % {DOMAINS}) as domain, coalesce(lang, '') lang, coalesce(source, '') source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint tokens from documents),
leaves as (select domain, lang, source, sum(tokens) n from d group by all having sum(tokens) > 0),
root as (select sum(n) * {BUDGET_PERCENT} // 100 budget from leaves),
{_level_sql("domain", "", "1", "root")},
{_level_sql("lang", "domain", _LANG_WEIGHT, "domain_b")},
{_level_sql("source", "domain, lang", "1", "lang_b")},
plan as (select domain, lang, source, budget // n as whole, budget % n as part from leaves join source_b using (domain, lang, source)),
spots as (select d.*, whole, part, md5('{SEED}:' || whole || ':' || coalesce(doc_id::varchar, '')) spot from d left join plan using (domain, lang, source)),
upto as (select *, coalesce(sum(tokens) over (partition by domain, lang, source order by spot, doc_id, tokens rows between unbounded preceding and 1 preceding), 0) before from spots)
select doc_id, domain, lang, source, tokens, (case when tokens > 0 then coalesce(whole, 0) else 0 end)::bigint epochs_taken,
  (case when tokens > 0 then coalesce(whole, 0) * tokens + least(tokens, greatest(part - before, 0)) else 0 end)::bigint tokens_taken
from upto
"""
