"""The store's writes, dedups and counts over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as R
from ..operators import store as W
from ..operators.resolvers import CLASSES
from ..sources import projection as G
from .registry import query

_text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
_str = lambda c: F.col(c).cast("string")

_OLD_FILES = "select c_custkey file_id, 'gen/u' || c_custkey || '.ts' path, 'old' content_hash from customer where c_custkey % 2 = 0"


@query(f"""with old as ({_OLD_FILES}), last as (select 'gen/u' || user_id || '.ts' path, arg_max(event_type, event_id) h, min(event_id) f from events group by 1)
select file_id, path, content_hash from old where path not in (select path from last) union all select file_id, path, h from last join old using (path)
union all select (select max(file_id) from old) + row_number() over (order by f), path, h from last where path not in (select path from old)""")
def files_upserted(spark, sf_dir):
    """K1: each event writes the file of its user."""
    old = G.table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("file_id"), _text("gen/u", _str("c_custkey"), ".ts").alias("path"), F.lit("old").alias("content_hash"))
    new = G.table(spark, sf_dir, "events").select(_text("gen/u", _str("user_id"), ".ts").alias("path"), F.col("event_type").alias("content_hash"), F.col("event_id").alias("ord"))
    return W.upsert_files(old, new)


@query("""select p_partkey fact_id, p_size::bigint file_id, 'symbol-def' as kind from part
union all select (select max(p_partkey) from part) + row_number() over (order by s_suppkey), s_nationkey::bigint, 'symbol-use' from supplier""")
def facts_inserted(spark, sf_dir):
    """K2: suppliers' facts after those of parts."""
    old = G.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact_id"), F.col("p_size").cast("long").alias("file_id"), F.lit("symbol-def").alias("kind"))
    new = G.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("file_id"), F.lit("symbol-use").alias("kind"), F.col("s_suppkey").alias("ord"))
    return W.insert_facts(old, new)


@query("""with old as (select n_nationkey::bigint + 1 anchor_id, 'hook:n' || n_nationkey as key, 'hook' as type from nation),
new as (select 'hook:n' || (c_nationkey * 2) as key, arg_max(lower(c_mktsegment), c_custkey) as type, min(c_custkey) f from customer group by 1)
select anchor_id, key, coalesce(new.type, old.type) as type from old left join new using (key)
union all select (select max(anchor_id) from old) + row_number() over (order by f), key, type from new where key not in (select key from old)""")
def anchors_upserted(spark, sf_dir):
    """K3: customers name the anchors of twice their nation's number."""
    old = G.table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + 1).alias("anchor_id"), _text("hook:n", _str("n_nationkey")).alias("key"), F.lit("hook").alias("type"))
    new = G.table(spark, sf_dir, "customer").select(_text("hook:n", (F.col("c_nationkey") * 2).cast("string")).alias("key"), F.lower("c_mktsegment").alias("type"), F.col("c_custkey").alias("ord"))
    return W.upsert_anchors(old, new)


@query("select p_partkey fact_id, 'k' || (p_size % 8) as key, 'target' as role from part union select l_partkey, 'k' || l_linenumber, 'target' from lineitem")
def links_inserted(spark, sf_dir):
    """K4: links of line items where they are not there yet."""
    old = G.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact_id"), _text("k", (F.col("p_size") % 8).cast("string")).alias("key"), F.lit("target").alias("role"))
    new = G.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("fact_id"), _text("k", _str("l_linenumber")).alias("key"), F.lit("target").alias("role"))
    return W.insert_or_ignore(old, new, ["fact_id", "key", "role"])


@query("select 't' || user_id test_id, event_type framework, event_id fact_id from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def tests_replaced(spark, sf_dir):
    """K5: of the tests with an id the last stays."""
    e = G.table(spark, sf_dir, "events")
    return W.last_of(e.select(_text("t", _str("user_id")).alias("test_id"), F.col("event_type").alias("framework"), F.col("event_id").alias("fact_id"), F.col("event_id").alias("ord")), ["test_id"])


@query("""with old as (select distinct 't' || (p_size * 4) test_id, 's' || (p_partkey % 7) as source, 0.5::double confidence from part),
new as (select 't' || user_id test_id, 's' || (event_id % 7) as source, arg_max(round(value / 1000, 6), event_id) confidence from events group by all)
select * from new union all select * from old where (test_id, source) not in (select (test_id, source) from new)""")
def edges_written(spark, sf_dir):
    """K6, K7: edges by test and source, the last of each."""
    old = G.table(spark, sf_dir, "part").select(_text("t", (F.col("p_size") * 4).cast("string")).alias("test_id"), _text("s", (F.col("p_partkey") % 7).cast("string")).alias("source"), F.lit(0.5).alias("confidence")).distinct()
    new = G.table(spark, sf_dir, "events").select(_text("t", _str("user_id")).alias("test_id"), _text("s", (F.col("event_id") % 7).cast("string")).alias("source"), F.round(F.col("value") / 1000, 6).alias("confidence"), F.col("event_id").alias("ord"))
    return W.replaced(old, new, ["test_id", "source"])


@query("""with gone as (select o_orderkey from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING')
select 'facts' as name, o_orderkey fact_id, count(*) n from orders where o_orderkey not in (select * from gone) group by all
union all select 'links', l_orderkey, count(*) from lineitem where l_orderkey not in (select * from gone) group by all
union all select 'tests', o_orderkey, count(*) from orders where o_totalprice > 100000 and o_orderkey not in (select * from gone) group by all""")
def file_facts_deleted(spark, sf_dir):
    """K8: deleting the facts of some customers' files takes their links and tests with them."""
    o = G.table(spark, sf_dir, "orders")
    tables = {
        "facts": o.select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("file_id")),
        "links": G.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_partkey").alias("key")),
        "tests": o.filter("o_totalprice > 100000").select(F.col("o_orderkey").alias("fact_id"), F.col("o_orderstatus").alias("framework")),
    }
    left = W.delete_file_facts(tables, G.table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("file_id")))
    parts = [df.groupBy("fact_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "fact_id", "n") for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""select c_custkey test_id, count(*) n, 'live' as which from orders join customer on o_custkey = c_custkey where c_acctbal > 0 group by all
union all select o_custkey, count(*), 'other' from orders where o_custkey not in (select c_custkey from customer where c_acctbal <= 0) group by all""")
def orphan_edges(spark, sf_dir):
    """Edges whose test is there, and edges but for those of a list of tests."""
    c = G.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("test_id"), "c_acctbal")
    edges = G.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("test_id"))
    each = lambda df, which: df.groupBy("test_id").agg(F.count("*").alias("n")).withColumn("which", F.lit(which))
    return each(W.without_orphans(edges, c.filter("c_acctbal > 0")), "live").unionByName(each(W.without_tests(edges, c.filter("c_acctbal <= 0")), "other"))


@query("""with last as (select user_id fact_id, arg_max(event_type, event_id) payload, arg_max(event_id % 3 = 0, event_id) resolved from events group by 1)
select p_partkey fact_id, coalesce(last.resolved, p_size % 2 = 0) resolved, case when last.fact_id is null then p_type else last.payload end payload from part left join last on fact_id = p_partkey""")
def facts_patched(spark, sf_dir):
    """K9: facts with the last patch of each."""
    facts = G.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact_id"), (F.col("p_size") % 2 == 0).alias("resolved"), F.col("p_type").alias("payload"))
    return W.patched(facts, G.table(spark, sf_dir, "events").select(F.col("user_id").alias("fact_id"), (F.col("event_id") % 3 == 0).alias("resolved"), F.col("event_type").alias("payload"), F.col("event_id").alias("ord")))


@query("select distinct l_partkey fact_id, case when l_linenumber = 3 then 'k1' else 'k' || l_linenumber end as key, 'subject' as role from lineitem")
def links_repointed(spark, sf_dir):
    """K9: links of one key moved to another, where they may meet a link that is there."""
    links = G.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("fact_id"), _text("k", _str("l_linenumber")).alias("key"), F.lit("subject").alias("role"))
    return W.repointed(links, links.filter("key = 'k3'").select("fact_id", "role", "key", F.lit("k1").alias("new_key")).distinct())


@query("""with r as (select md5(c_nationkey::varchar) expr_hash, 'llm' as pass, arg_max(c_mktsegment, c_custkey) resolved_value from customer group by 1), old as (select md5(i::varchar) expr_hash, 'llm' as pass, 'old' resolved_value from range(40) t(i)),
written as (select * from r union all select * from old where expr_hash not in (select expr_hash from r)), live as (select md5(n_nationkey::varchar) h from nation where n_regionkey < 3)
select *, (select count(*) from written where expr_hash not in (select h from live)) stale from written where expr_hash in (select h from live)""")
def resolutions_kept(spark, sf_dir):
    """Answers written over old ones, then those pruned that no live fact asks for."""
    new = G.table(spark, sf_dir, "customer").select(F.md5(_str("c_nationkey")).alias("expr_hash"), F.lit("llm").alias("pass"), F.col("c_mktsegment").alias("resolved_value"), F.col("c_custkey").alias("ord"))
    old = spark.range(40).select(F.md5(_str("id")).alias("expr_hash"), F.lit("llm").alias("pass"), F.lit("old").alias("resolved_value"))
    live = G.table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.md5(_str("n_nationkey")).alias("expr_hash"))
    kept, stale = W.prune_resolutions(W.upsert_resolutions(old, new), live)
    return kept.crossJoin(F.broadcast(stale))


@query("""with w as (select 'w' || (s_suppkey % 9) as name, 'f' || (s_nationkey % 3) def_file, (s_suppkey % 2)::int def_start_line, 'function' as kind, case when s_suppkey % 5 = 0 then 'config' else 'auto' end as source, s_suppkey wrapper_id from supplier),
one as (select * from w qualify row_number() over (partition by name, def_file, def_start_line, kind order by source <> 'config', wrapper_id) = 1)
select name, def_file, def_start_line, kind, source, wrapper_id from one""")
def wrappers_merged(spark, sf_dir):
    """One wrapper for each definition, that of the configuration before others."""
    return W.merged_wrappers(_wrappers(spark, sf_dir))


def _wrappers(spark, sf_dir):
    s = F.col("s_suppkey")
    return G.table(spark, sf_dir, "supplier").select(
        _text("w", (s % 9).cast("string")).alias("name"), _text("f", (F.col("s_nationkey") % 3).cast("string")).alias("def_file"), (s % 2).cast("int").alias("def_start_line"), F.lit("function").alias("kind"),
        F.when(s % 5 == 0, "config").otherwise("auto").alias("source"), s.alias("wrapper_id"), s.alias("ord"),
    )


@query("select o_orderkey fact_id, wrapper_id from orders join (select 'w' || (s_suppkey % 9) as name, max(s_suppkey) wrapper_id from supplier group by 1) on name = 'w' || (o_custkey % 12)")
def wrapper_calls(spark, sf_dir):
    """Calls of a wrapper by name, of which the last definition counts."""
    calls = G.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id"), _text("w", (F.col("o_custkey") % 12).cast("string")).alias("name"))
    return W.wrapper_call_sites(calls, _wrappers(spark, sf_dir))


_DOMAIN = ["click", "error", "none-of-these", "view"]


@query("select d as event_type, (select count(*) from events where event_type = d) n from (values " + ", ".join(f"('{d}')" for d in _DOMAIN) + ") t(d)")
def histogram_zero_fill(spark, sf_dir):
    """How many of each kind there are, 0 where none."""
    return W.counts_of(G.table(spark, sf_dir, "events"), "event_type", _DOMAIN)


@query("select count(*) edges, sum(n)::bigint evidence from (select l_orderkey, count(distinct l_returnflag) n from lineitem group by 1)")
def edge_evidence_counts(spark, sf_dir):
    """A5: edges, and the kinds of evidence in them."""
    rows = G.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("evidence"))
    return W.edge_counts(rows)


@query("""select p_partkey // 2 symbol, min(p_brand) p_brand, 'all' as which from part where p_size > 3 group by 1 having count(distinct p_brand) = 1
union all select p_partkey // 3, min(case when p_size % 9 > 0 then p_type end), 'known' from part group by 1 having count(distinct case when p_size % 9 > 0 then p_type end) = 1 and count(*) = count(case when p_size % 9 > 0 then 1 end)""")
def unanimous_values(spark, sf_dir):
    """Values on which all declarations of a name agree, one without a value being no agreement."""
    p = G.table(spark, sf_dir, "part")
    a = W.unanimous(p.filter("p_size > 3").withColumn("symbol", F.expr("p_partkey div 2")), ["symbol"], "p_brand").withColumn("which", F.lit("all"))
    b = W.unanimous(p.withColumn("symbol", F.expr("p_partkey div 3")).withColumn("p_brand", F.expr("case when p_size % 9 > 0 then p_type end")), ["symbol"], "p_brand").withColumn("which", F.lit("known"))
    return a.unionByName(b)


@query("select p_partkey // 2 symbol, min(p_brand) p_brand from part group by 1 having count(distinct p_brand) = 1")
def ambiguity_poison(spark, sf_dir):
    """The symbols that one brand alone has, over all parts."""
    return W.unambiguous(G.table(spark, sf_dir, "part").withColumn("symbol", F.expr("p_partkey div 2")), ["symbol"], "p_brand")


@query("select event_type as language, count(*) files, round(sum(value), 2) ms, count(distinct user_id) workers from events group by 1")
def worker_sums(spark, sf_dir):
    """Files and time by language."""
    return G.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("language")).agg(F.count("*").alias("files"), F.round(F.sum("value"), 2).alias("ms"), F.countDistinct("user_id").alias("workers"))


_BAD = {1: "[1, 2]", 2: "not json", 3: '"text"', 4: "{"}


@query("select event_id, case when event_id % 6 in (1, 2, 3, 4) or props is null then '{}' else props end payload, case when event_id % 6 in (0, 5) then json_extract_string(props, '$.k') end k from events")
def json_objects(spark, sf_dir):
    """Payloads that are no JSON object are the empty one."""
    e = G.table(spark, sf_dir, "events")
    raw = F.col("props")
    for k, bad in _BAD.items():
        raw = F.when(F.col("event_id") % 6 == k, bad).otherwise(raw)
    return e.select("event_id", W.json_object(raw).alias("payload")).withColumn("k", F.get_json_object("payload", "$.k"))


@query("select place, path from (select o_orderkey * 2 place, 'gen/u' || o_custkey || '.ts' path from orders union all select o_orderkey * 2 + 1, 'gen/u' || (o_custkey * 3) || '.ts' from orders) where path not in (select 'gen/u' || c_custkey || '.ts' from customer where c_custkey % 2 = 0)")
def unknown_inputs(spark, sf_dir):
    """Paths that are asked and not there, with their places; repeats stay."""
    o = G.table(spark, sf_dir, "orders")
    asked = o.select((F.col("o_orderkey") * 2).alias("place"), _text("gen/u", _str("o_custkey"), ".ts").alias("path"))
    asked = asked.unionByName(o.select((F.col("o_orderkey") * 2 + 1).alias("place"), _text("gen/u", (F.col("o_custkey") * 3).cast("string"), ".ts").alias("path")))
    files = G.table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(_text("gen/u", _str("c_custkey"), ".ts").alias("path"))
    return asked.join(files, "path", "left_anti").select("place", "path")


@query("select row_number() over (order by p_type, p_partkey) - 1 place, p_partkey from part")
def dense_numbers(spark, sf_dir):
    """Ids in the order of columns, without rows meeting in one task."""
    return W.numbered(G.table(spark, sf_dir, "part").select("p_type", "p_partkey"), ["p_type", "p_partkey"], "place").select("place", "p_partkey")


@query("""select 'unresolved' as what, k as value, (select count(*) from part where case p_size % 3 when 0 then 'hook-fire' when 1 then 'symbol-use' else 'none' end = k and p_partkey % 4 > 0) n from (values ('hook-fire'), ('hook-listener')) t(k)
union all select 'answers', c, (select count(*) from customer where case c_mktsegment when 'BUILDING' then 'structural-rule' when 'MACHINERY' then 'project-constant' else 'else' end = c) from (values ('structural-rule'), ('project-constant'), ('data-dependent-unresolvable')) t(c)""")
def answer_status(spark, sf_dir):
    """How many facts wait for an answer, and what answers there are."""
    kind = F.when(F.col("p_size") % 3 == 0, "hook-fire").when(F.col("p_size") % 3 == 1, "symbol-use").otherwise("none")
    facts = G.table(spark, sf_dir, "part").select(kind.alias("kind"), (F.col("p_partkey") % 4 == 0).alias("resolved"))
    answers = G.table(spark, sf_dir, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", CLASSES[0]).when(F.col("c_mktsegment") == "MACHINERY", CLASSES[1]).otherwise("else").alias("classification"))
    return R.status(facts, answers, CLASSES)


@query("select (select count(*) from part) files, (select count(*) from lineitem) facts, (select count(*) from orders) tests, count(*) edges, sum(n)::bigint evidence from (select l_orderkey, count(distinct l_linestatus) n from lineitem group by 1)")
def graph_summary(spark, sf_dir):
    """What a graph holds, in one row."""
    t = lambda name: G.table(spark, sf_dir, name)
    edges = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linestatus").alias("evidence"))
    return R.summary(t("part"), t("lineitem"), t("orders"), edges)
