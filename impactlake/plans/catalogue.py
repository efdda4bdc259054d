"""The engine's queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import anchors as A
from ..functions import pricing as P
from ..functions import scalars as S
from ..operators import lookup
from ..operators.match import partners
from ..operators.stages import stage
from ..operators.traverse import dependencies, derive
from ..sources import projection as G
from . import extract_queries, resolver_queries, scalar_queries, store_queries, walk_queries  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES, query

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES


SRC = "select p_partkey file_id, (case when p_size = 50 then 'vendor/' else '' end) || 'src/' || lower(p_type) || '/p' || p_partkey || (case p_size % 3 when 0 then '.php' when 1 then '.ts' else '.js' end) path, p_size = 50 vendor, p_size from part"
TESTS = "select o_orderkey, c_custkey, (case c_mktsegment when 'AUTOMOBILE' then 'phpunit' when 'FURNITURE' then 'playwright' when 'HOUSEHOLD' then 'qunit' else 'jest' end) framework, 'tests/' || lower(c_mktsegment) || '/c' || c_custkey || '.test.ts' path from orders join customer on o_custkey = c_custkey"
TEST_ID = "framework || ':' || path || '::o' || o_orderkey"
FLAG_KIND = "case l_returnflag when 'A' then 'symbol-use' when 'N' then 'hook-fire' else 'rest-call-js' end"
EDGE_KIND = "case when l_returnflag = 'A' then (case when l_linestatus = 'F' then 'symbol-call' else 'symbol-call-uncertain' end) when l_returnflag = 'N' then (case when l_linestatus = 'F' then 'hook-mediated' else 'hook-mediated-uncertain' end) else (case when l_linestatus = 'F' then 'rest-mediated' else 'rest-mediated-partial' end) end"
BASE_SQL = "case k when 'symbol-call' then 0.9 when 'symbol-call-uncertain' then 0.5 when 'hook-mediated' then 0.8 when 'hook-mediated-uncertain' then 0.4 when 'rest-mediated' then 0.85 else 0.5 end"
PRICED = f"select *, {EDGE_KIND} k, least(1, greatest(0, ({BASE_SQL})::double * greatest(0.3, pow(0.92::double, l_linenumber)))) c from (select distinct l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus from lineitem)"


def evidence(spark: SparkSession, sf_dir: str, by: str = "l_orderkey") -> DataFrame:
    """Each distinct call of a test to a part, priced at the call's line as its depth; dealt by the column ``by``."""
    kind = F.create_map(*[F.lit(x) for x in ("A", "symbol-use", "N", "hook-fire", "R", "rest-call-js")])[F.col("l_returnflag")]
    rows = G.calls(spark, sf_dir, by).withColumn("kind", P.bridge_kind(kind, F.col("l_linestatus") == "F", F.lit("called"), []))
    return rows.withColumn("c", P.evidence_confidence(F.col("kind"), F.lit("exact"), F.col("l_linenumber"), F.lit(True)))


def edge_table(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """The edges of all tests to the parts that are asked (rows of part), or to all."""
    src = G.source_files(G.table(spark, sf_dir, "part") if asked is None else asked).filter("not vendor").select(F.col("file_id").alias("l_partkey"), F.col("path").alias("source"))
    t = G.tests(spark, sf_dir).select("test_id", (F.col("fact_id") - G.TEST_FACTS).alias("l_orderkey"))
    rows = evidence(spark, sf_dir, "l_partkey").join(src, "l_partkey").join(t, "l_orderkey")
    # products in one order, so that their last bits do not depend on how rows are dealt
    values = F.aggregate(F.array_sort(F.collect_list("c")), F.lit(1.0), lambda a, x: a * (1 - x), lambda a: 1 - a)
    # the id of a test names its order, by which rows are dealt already
    edges = rows.groupBy("l_orderkey", "test_id", "source").agg(values.alias("confidence"), F.bool_or(P.is_partial(F.col("kind"))).alias("partial"))
    return edges.drop("l_orderkey")


EDGES = f"select t.framework || ':' || t.path || '::o' || t.o_orderkey test_id, framework, s.path as source, 1 - product(1 - c) confidence, bool_or(k like '%-uncertain' or k like '%-partial') partial from ({PRICED}) e join ({SRC}) s on s.file_id = e.l_partkey and not vendor join ({TESTS}) t on t.o_orderkey = e.l_orderkey group by all"
CLASS = "(case framework when 'playwright' then 'e2e' else 'unit' end) framework_class"


@query(f"select test_id, source, framework, {CLASS}, round(confidence, 6) confidence, partial from ({EDGES}) where framework = 'jest' and confidence >= 0.7 and source in (select path from ({SRC}) where p_size = 7)")
def tests_from_sources(spark, sf_dir):
    paths = G.table(spark, sf_dir, "part").filter("p_size = 7")
    rows, _ = lookup.tests_from_sources(edge_table(spark, sf_dir, paths), G.tests(spark, sf_dir), G.files(spark, sf_dir), G.source_files(paths).select("path"), "jest", 0.7)
    return rows.withColumn("confidence", F.round("confidence", 6))


@query(f"select test_id, source, framework, {CLASS}, round(confidence, 6) confidence, partial from ({EDGES})")
def sources_from_tests(spark, sf_dir):
    tests = G.tests(spark, sf_dir)
    rows, _ = lookup.sources_from_tests(edge_table(spark, sf_dir), tests, tests.select("test_id"))
    return rows.withColumn("confidence", F.round("confidence", 6))


@query(f"select 'src/asked/p' || p_partkey || '.php' path from part where p_size < 3 union all select 'nowhere' from part where p_size = 1")
def unknown_paths(spark, sf_dir):
    p = G.table(spark, sf_dir, "part")
    asked = p.filter("p_size < 3").select(F.concat(F.lit("src/asked/p"), F.col("p_partkey").cast("string"), F.lit(".php")).alias("path")).union(p.filter("p_size = 1").select(F.lit("nowhere"))).union(G.source_files(p).select("path"))
    return lookup.tests_from_sources(edge_table(spark, sf_dir), G.tests(spark, sf_dir), G.files(spark, sf_dir), asked)[1]


@query(f"select {TEST_ID} test_id, round(1 - product(1 - c), 6) confidence from ({PRICED}) e join ({TESTS}) t on t.o_orderkey = e.l_orderkey group by all")
def noisy_or_confidence(spark, sf_dir):
    t = G.tests(spark, sf_dir).select("test_id", (F.col("fact_id") - G.TEST_FACTS).alias("l_orderkey"))
    return evidence(spark, sf_dir).join(t, "l_orderkey").groupBy("test_id").agg(F.round(P.noisy_or(F.col("c")), 6).alias("confidence"))


@query(f"select l_orderkey, l_linenumber, l_partkey, k as kind, round(c, 6) as c, round(c * 0.7, 6) llm, k like '%-uncertain' or k like '%-partial' as partial from ({PRICED})")
def evidence_price(spark, sf_dir):
    return evidence(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "kind", F.round("c", 6).alias("c"), F.round(P.llm_attenuated(F.col("c")), 6).alias("llm"), P.is_partial(F.col("kind")).alias("partial"))


@query(f"select l_orderkey, k as kind, count(distinct l_partkey) n, string_agg(distinct l_partkey::varchar, ',' order by l_partkey::varchar) ids from ({PRICED}) group by all")
def evidence_by_kind(spark, sf_dir):
    ids = F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ",")
    return evidence(spark, sf_dir).groupBy("l_orderkey", "kind").agg(F.countDistinct("l_partkey").alias("n"), ids.alias("ids"))


@query(f"select l_orderkey, k as kind, l_partkey, round(c, 6) as c from (select *, row_number() over (partition by l_orderkey, k, l_partkey order by l_linenumber) rn from ({PRICED})) where rn = 1")
def evidence_first_value(spark, sf_dir):
    first = evidence(spark, sf_dir).groupBy("l_orderkey", "kind", "l_partkey").agg(F.min_by("c", "l_linenumber").alias("c"))
    return first.withColumn("c", F.round("c", 6))


@query("""select * from (values ('symbol-call', 0.9::double), ('symbol-call-uncertain', 0.5), ('php-include', 0.95), ('js-import', 0.95), ('hook-mediated', 0.8), ('hook-mediated-uncertain', 0.4),
('rest-mediated', 0.85), ('rest-mediated-partial', 0.5), ('rest-mediated-broad-fallback-partial', 0.85), ('rest-mediated-broad-fallback-unresolved-partial', 0.5), ('ajax-mediated', 0.85), ('ajax-mediated-partial', 0.4),
('enqueue-mediated', 0.7), ('enqueue-mediated-sibling-fallback-partial', 0.7), ('admin-page-mediated', 0.9), ('shortcode-render', 0.85), ('block-render', 0.7), ('store-mediated', 0.8)) t(kind, base)""")
def price_table(spark, sf_dir):
    return spark.createDataFrame(list(P.BASE.items()), "kind string, base double")



HOOK = "hook:s_"
LINKS = f"select p_partkey * 8 + 1 fact_id, '{HOOK}' || (p_partkey % 97) as key, 'target' as role from part union all select p_partkey * 8 + 2, case when p_partkey % 77 = 0 then '{HOOK}' || (p_partkey % 97 // 10) || '{{*}}' else '{HOOK}' || (p_partkey % 97) end, 'subject' from part where p_partkey % 11 = 0 union all select p_partkey * 8 + 3, 'php-symbol:P' || (p_partkey // 2), 'subject' from part where p_partkey % 2 = 0 union all select p_partkey * 8 + 4, 'php-symbol:P' || p_partkey, 'target' from part"


def links(spark, sf_dir):
    return G.facts_and_links(spark, sf_dir)[1]


@query(f"with l as ({LINKS}) select a.fact_id, a.key, a.role, b.fact_id partner_id from l a join l b on a.key = b.key and b.role = (case a.role when 'target' then 'subject' else 'target' end) where a.key not like '%{{*}}%'")
def anchor_exact_join(spark, sf_dir):
    return partners(links(spark, sf_dir)).filter("precision = 'exact' and not contains(key, '{*}')").select("fact_id", "key", "role", "partner_id")


@query(f"with l as ({LINKS}), w as (select fact_id, key, row_number() over (order by key, fact_id) o from l where key like '%{{*}}%'), m as (select a.fact_id, a.key, w.fact_id partner_id, w.key other, row_number() over (partition by a.fact_id, a.key order by w.key, w.fact_id) n from l a join w on a.role = 'target' and a.key like 'hook:%' and regexp_matches(a.key, '^' || replace(w.key, '{{*}}', '[^\\s]+') || '$')) select fact_id, key, partner_id, other, 'wildcardPrefixed' as precision from m where n <= 4")
def wildcard_cap(spark, sf_dir):
    return partners(links(spark, sf_dir), cap=4).filter("precision <> 'exact' and role = 'target'").select("fact_id", "key", "partner_id", "other", "precision")


@query(f"with l as (select distinct key from ({LINKS})) select key, '^' || replace(regexp_replace(key, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g'), '\\{{\\*\\}}', '[^\\s]+') || '$' rx, case when key = '{HOOK}{{*}}' then 'x' else 'wildcardPrefixed' end breadth, split_part(key, ':', 1) as type, length(replace(key, '{{*}}', '')) as literal from l where key like '%{{*}}%'")
def wildcard_to_regex(spark, sf_dir):
    k = F.col("key")
    return links(spark, sf_dir).select("key").distinct().filter(A.is_wild(k)).select("key", A.wildcard_regex(k).alias("rx"), A.wildcard_breadth(k).alias("breadth"), A.anchor_type(k).alias("type"), F.length(F.replace(k, F.lit(A.WILD), F.lit(""))).cast("long").alias("literal"))


@query(f"with recursive up(k, a, d) as (select p_partkey, p_partkey // 2, 1 from part where p_partkey >= 2 union all select k, a // 2, d + 1 from up where a >= 2), props as (select p_partkey, p_brand from part where p_size % 7 = 0) select k as p_partkey, arg_min(p_brand, d) brand, min(d)::bigint as depth from up join props on a = props.p_partkey group by k")
def inherited_property(spark, sf_dir):
    from ..operators.resolvers import nearest_ancestor

    p = G.table(spark, sf_dir, "part")
    parents = p.filter("p_partkey >= 2").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))
    props = p.filter("p_size % 7 = 0").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("value"))
    return nearest_ancestor(parents, props).select(F.col("child").alias("p_partkey"), F.col("value").alias("brand"), "depth")


PATHS = f"select path from ({SRC}) union select path from ({TESTS})"


@query(f"select path, regexp_extract(path, '\\.([a-z]+)$', 1) as language, case when path like '%.php' and regexp_matches(path, '(?:^|/)tests/|Test\\.php$', 'i') then 'phpunit' when path like 'tests/furniture/%' then 'playwright' when path like 'tests/household/%' then 'qunit' when path like '%.test.ts' then 'jest' end framework, path like 'vendor/%' vendor from ({PATHS})")
def detect_framework(spark, sf_dir):
    p = F.col("path")
    framework = S.detect_framework(p, ["tests/furniture/**"], ["tests/household/**"], ["**/*.test.ts"])
    return G.files(spark, sf_dir).join(G.tests(spark, sf_dir).select("file_id").distinct().union(G.table(spark, sf_dir, "part").select("p_partkey")), "file_id", "left_semi").select("path").distinct().select("path", S.classify_language(p).alias("language"), framework.alias("framework"), S.is_vendor(p).alias("vendor"))


@query("select doc_id, sha1(text) content, sha256('(file)' || chr(10) || 'a=' || lang || chr(10) || 'hook=' || source || chr(10)) expr from documents")
def hashes(spark, sf_dir):
    fields = F.array(F.struct(F.lit("hook").alias("field"), F.col("source").alias("expression")), F.struct(F.lit("a").alias("field"), F.col("lang").alias("expression")))
    return G.table(spark, sf_dir, "documents").select("doc_id", S.content_hash(F.col("text")).alias("content"), S.expr_hash(F.lit("(file)"), fields).alias("expr"))


@query("select doc_id, array_to_string(l[greatest(12 - 8, 1) : least(14 + 8, len(l))], chr(10)) slice, len(l)::int lines, 3 <= len(l) and len(list_filter(l[1:least(5, len(l))], lambda x: contains(x, 'the'))) > 0 cited from (select doc_id, string_split(text, chr(10)) l from documents)")
def context_slice(spark, sf_dir):
    t = F.col("text")
    return G.table(spark, sf_dir, "documents").select("doc_id", S.context_lines(t, F.lit(12), F.lit(14)).alias("slice"), F.size(F.split(t, "\n", -1)).alias("lines"), S.citation_holds(t, F.lit(3), F.lit("the")).alias("cited"))



@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1")
def upsert_latest(spark, sf_dir):
    e = G.table(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"))
    return last.select("user_id", "last.event_id", "last.event_type")


@query("select event_id, json_extract_string(props, '$.k') k from events")
def json_payload_fields(spark, sf_dir):
    return G.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(f"with tails as (select file_id, substr(path, i + 1) tail from ({SRC}), unnest(range(0, length(path))) r(i) where i = 0 or substr(path, i, 1) = '/'), u as (select tail, min(file_id) file_id, count(*) n from tails group by 1) select 'p' || p_partkey || '.js' as tail, file_id from part join u on u.tail = 'p' || p_partkey || '.js' where n = 1")
def suffix_unique_match(spark, sf_dir):
    from ..operators.resolvers import unique_suffix

    p = G.table(spark, sf_dir, "part")
    asked = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".js")).alias("tail"))
    return unique_suffix(asked, G.source_files(p).select("file_id", "path"))


@query(f"select o_orderkey, round(o_totalprice, 2) ms from orders order by o_totalprice desc, o_orderkey limit 20")
def slowest_topn(spark, sf_dir):
    return G.table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", F.round("o_totalprice", 2).alias("ms"))


#: Facts of a part by their place: fire, listener, use, definition.
PART_FACTS = "select p_partkey p, unnest([p_partkey * 8 + 1, case when p_partkey % 11 = 0 then p_partkey * 8 + 2 end, case when p_partkey % 2 = 0 then p_partkey * 8 + 3 end, p_partkey * 8 + 4]) f from part"
#: What a part bridges to in one step: kind, the fact there and its part, precision.
PART_STEPS = """select a.p_partkey p, case when a.p_size % 5 <> 0 then 'hook-mediated' else 'hook-mediated-uncertain' end k, b.p_partkey q, b.p_partkey * 8 + 2 dest, a.p_partkey * 8 + 1 origin, 1.0::double prec from part a join part b on a.p_partkey % 97 = b.p_partkey % 97 and b.p_partkey % 11 = 0 and b.p_partkey % 77 <> 0
union all select p, k, q, dest, origin, prec from (select a.p_partkey p, case when a.p_size % 5 <> 0 then 'hook-mediated' else 'hook-mediated-uncertain' end k, b.p_partkey q, b.p_partkey * 8 + 2 dest, a.p_partkey * 8 + 1 origin, 0.6::double prec, row_number() over (partition by a.p_partkey order by b.p_partkey) n
  from part a join part b on (a.p_partkey % 97) // 10 = (b.p_partkey % 97) // 10 and a.p_partkey % 97 >= 10 and b.p_partkey % 77 = 0) where n <= 32
union all select a.p_partkey, 'symbol-call', b.p_partkey, b.p_partkey * 8 + 4, a.p_partkey * 8 + 3, 1.0 from part a join part b on b.p_partkey = a.p_partkey // 2 and a.p_partkey % 2 = 0"""
STEP_PRICE = "case k when 'hook-mediated' then 0.8 when 'hook-mediated-uncertain' then 0.4 else 0.9 end * prec"


def _graph(spark, sf_dir):
    """Facts and links, kept: the steps of a walk read them many times."""
    return tuple(stage(df, name) if df is not None else None for name, df in zip(("facts", "links"), G.facts_and_links(spark, sf_dir), strict=True))


@query(f"""with src as ({SRC}), tests as ({TESTS}), facts as (select p, f from ({PART_FACTS}) where f is not null), steps as ({PART_STEPS}),
own as (select t.o_orderkey, s.l_partkey p, min({G.CALL_FACTS} + s.l_orderkey * {G.PARTS} + s.l_partkey) i from tests t join orders o on o.o_custkey = t.c_custkey join lineitem s on s.l_orderkey = o.o_orderkey where t.framework = 'phpunit' or o.o_orderkey = t.o_orderkey group by all),
seen as (select o_orderkey, p q, 'js-import' k, f dest, i origin, 0.95::double c from own join facts using (p)
  union all select o_orderkey, q, k, dest, origin, {STEP_PRICE} * 0.92 * 0.92 from own join steps using (p)),
once as (select o_orderkey, q, k, dest, any_value(c) c from seen group by all),
edges as (select o_orderkey, q, 1 - product(1 - c) confidence, bool_or(k like '%-uncertain') partial from once group by all),
ids as (select o_orderkey, q, string_agg(x::varchar, ',' order by x) provenance from (select o_orderkey, q, origin x from seen union select o_orderkey, q, dest from seen) group by all)
select {TEST_ID} test_id, src.path as source, round(confidence, 6) confidence, partial, provenance from edges join ids using (o_orderkey, q) join tests using (o_orderkey) join src on src.file_id = q where not vendor""".replace("framework || ':' || path", "framework || ':' || tests.path"))
def traverse_edges(spark, sf_dir):
    """All edges of the projected graph (every line item is an import), through the whole walk, with the facts they come from."""
    facts, own = _graph(spark, sf_dir)
    return derive(G.files(spark, sf_dir), facts, own, G.tests(spark, sf_dir).select("test_id", "file_id", "framework", "fact_id"), evidence=False).select("test_id", "source", F.round("confidence", 6).alias("confidence"), "partial", F.array_join("provenance", ",").alias("provenance"))


@query(f"""with src as ({SRC}), steps as ({PART_STEPS})
select a.path as source, b.path target, round(1 - product(1 - {STEP_PRICE} * 0.92), 6) confidence, bool_or(k like '%-uncertain') partial, string_agg(distinct k, ',' order by k) kinds
from steps join src a on a.file_id = p and not a.vendor join src b on b.file_id = q and not b.vendor where p <> q group by all""")
def direct_dependencies(spark, sf_dir):
    """What each part directly depends on."""
    facts, own = _graph(spark, sf_dir)
    rows, _ = dependencies(G.files(spark, sf_dir), facts, own, G.source_files(G.table(spark, sf_dir, "part")).select("path"))
    return rows.select("source", "target", F.round("confidence", 6).alias("confidence"), "partial", F.array_join("kinds", ",").alias("kinds"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse_edges(spark, sf_dir)
