"""Cross-file resolvers over parts seen as classes, files, scripts and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import citation_holds
from ..operators import resolvers as R
from ..sources import projection as G
from .registry import query

_str = lambda c: F.col(c).cast("string")
_text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

_UP = "with recursive up(k, a, d) as (select p_partkey, p_partkey, 0 from part union all select k, a // 2, d + 1 from up where a >= 2)"


def _parents(p):
    return p.filter("p_partkey >= 2").select(_text("C", _str("p_partkey")).alias("child"), _text("C", F.expr("p_partkey div 2").cast("string")).alias("parent"))


@query(f"""{_UP}, ns as (select p_partkey a, 'ns' || (p_partkey % 5) || '/v1/' as v from part where p_size % 7 = 0), near as (select k, arg_min(v, d) v, arg_min(a, d) o from up join ns using (a) group by k),
e as (select p_partkey, case p_size % 3 when 0 then '/r' || p_partkey || '/' when 1 then 'items/(?P<id>[0-9]+)' else '/x/{{*}}' end route, case p_size % 2 when 0 then 'POST' end as m from part where p_size % 5 > 0)
select p_partkey fact_id, v as namespace, 'C' || o resolved_from, 'rest:' || coalesce(m, 'GET') || ' /' || rtrim(v, '/') || case when starts_with(route, '/r') then '/r' || p_partkey else '/items/{{*}}' end as key,
  not starts_with(route, '/r') route_param, starts_with(route, '/r') resolved from e join near on k = p_partkey where route not like '%{{*}}%'""")
def rest_namespaces(spark, sf_dir):
    """Endpoints that lack their namespace take that of the nearest class that has one."""
    p = G.table(spark, sf_dir, "part")
    route = F.when(F.col("p_size") % 3 == 0, _text("/r", _str("p_partkey"), "/")).when(F.col("p_size") % 3 == 1, "items/(?P<id>[0-9]+)").otherwise("/x/{*}")
    fields = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("namespace"), F.lit("rest_base"))).otherwise(F.array(F.lit("namespace")))
    e = p.select(F.col("p_partkey").alias("fact_id"), _text("C", _str("p_partkey"), "::register").alias("scope"), fields.alias("fields"), F.when(F.col("p_size") % 2 == 0, "POST").alias("method"), route.alias("route"))
    names = p.filter("p_size % 7 = 0").select(_text("C", _str("p_partkey")).alias("name"), _text("ns", (F.col("p_partkey") % 5).cast("string"), "/v1/").alias("value"))
    return R.inherited_namespaces(e, _parents(p), names)


@query(f"""{_UP}, ns as (select p_partkey a, 'ns' || (p_partkey % 5) as v from part where p_size % 7 = 0), rb as (select p_partkey a, 'base' || (p_partkey % 4) as b from part where p_size % 6 = 0),
space as (select k, arg_min(v, d) v from up join ns using (a) group by k), base as (select k, arg_min(b, d) b from up join rb using (a) group by k),
ends as (select p_partkey a, 'ns' || (p_partkey % 5) as n, '/base' || (p_partkey % 4) || '/x' || p_partkey as r from part where p_size % 4 = 0),
near as (select k, arg_min(a, d) o from up join (select distinct a from ends) using (a) where d > 0 group by k),
rows as (select near.k, near.o, space.v, n, r, mine.b mine, theirs.b theirs from near join part on p_partkey = near.k and (p_size % 7 = 0 or p_size % 6 = 0) join space on space.k = near.k join ends on ends.a = near.o left join base mine on mine.k = near.k left join base theirs on theirs.k = near.o),
moved as (select *, case when mine is not null and theirs is not null and mine <> theirs then case when starts_with(r, '/' || theirs || '/') then '/' || mine || substr(r, length(theirs) + 2) end else r end nr from rows)
select 'C' || k as name, 'C' || o as owner, k as file_id, (k * 2)::int start_line, (k * 2 + 1)::int end_line, v as namespace, nr as route, 'rest:GET /' || v || nr as key, true resolved from moved where nr is not null and not (v = n and nr = r)""")
def rest_endpoints_inherited(spark, sf_dir):
    """Endpoints that classes with settings of their own take over from the nearest ancestor with endpoints."""
    p = G.table(spark, sf_dir, "part")
    name = _text("C", _str("p_partkey"))
    classes = p.select(name.alias("name"), F.col("p_partkey").alias("file_id"), (F.col("p_partkey") * 2).cast("int").alias("start_line"), (F.col("p_partkey") * 2 + 1).cast("int").alias("end_line"))
    space, base = _text("ns", (F.col("p_partkey") % 5).cast("string")), _text("base", (F.col("p_partkey") % 4).cast("string"))
    props = p.select(name.alias("name"), F.when(F.col("p_size") % 7 == 0, space).alias("namespace"), F.when(F.col("p_size") % 6 == 0, base).alias("rest_base"))
    ends = p.filter("p_size % 4 = 0").select(name.alias("owner"), F.lit("GET").alias("method"), space.alias("namespace"), _text("/", base, "/x", _str("p_partkey")).alias("route"))
    return R.inherited_endpoints(classes, ends, _parents(p), props)


@query("""with c as (select p_partkey, case when p_size % 10 = 0 then 'own' || p_partkey else 'size' || p_size end f from part)
select 'C' || p_partkey child, 'C' || (p_partkey // 2) parent from c where f in (select f from c group by 1 having count(*) = 1)""")
def class_parents(spark, sf_dir):
    """Only a file of one class says whose parent it names; here some parts have files of their own, others share one."""
    file = F.when(F.col("p_size") % 10 == 0, _text("own", _str("p_partkey"))).otherwise(_text("size", _str("p_size")))
    p = G.table(spark, sf_dir, "part").select("p_partkey", file.alias("file_id"))
    classes = p.select("file_id", _text("C", _str("p_partkey")).alias("name"))
    return R.class_parents(classes, p.select("file_id", _text("C", F.expr("p_partkey div 2").cast("string")).alias("parent"), F.col("p_partkey").alias("ord")))


def _tree(spark, sf_dir):
    p = G.table(spark, sf_dir, "part")
    at = lambda where, tail: p.filter(where).select(_text("a", _str("p_partkey"), tail).alias("path"))
    parts = [("p_size % 2 = 0", "/x.js"), ("p_size % 3 = 0", "/build/y.asset.php"), ("p_size % 4 = 0", "/src/y/index.ts"), ("p_size % 5 = 0", "/src/y.jsx"), ("true", "/src/y.js"), ("p_size % 7 > 0", "/src/m.ts")]
    out = at(*parts[0])
    for x in parts[1:]:
        out = out.unionByName(at(*x))
    return p, out


@query("""select 'a' || p_partkey || '/x.min.js' path, 'a' || p_partkey || '/x.js' as source from part where p_size % 2 = 0
union all select 'a' || p_partkey || '/build/y.js', 'a' || p_partkey || case when p_size % 11 = 0 and p_size % 7 > 0 then '/src/m.ts' when p_size % 11 = 0 and p_size % 2 = 0 then '/src/y.js' when p_size % 4 = 0 then '/src/y/index.ts' when p_size % 5 = 0 then '/src/y.jsx' else '/src/y.js' end
from part where p_size % 3 = 0 or (p_size % 11 = 0 and (p_size % 7 > 0 or p_size % 2 = 0))""")
def compiled_sources(spark, sf_dir):
    """Minified twins, source maps (broken ones name nothing), and sources by the manifest; extensions in order, a file before its folder."""
    p, files = _tree(spark, sf_dir)
    bundle = _text("a", _str("p_partkey"), "/build/y.js")
    scripts = p.select(_text("a", _str("p_partkey"), "/x.min.js").alias("path")).unionByName(p.select(bundle.alias("path")))
    text = F.when(F.col("p_size") % 2 == 0, '{"sources":["webpack:///../none.ts","webpack:///../src/m.ts","../src/y.js"]}').otherwise('{"sources":["../src/./m.ts"]}')
    maps = p.filter("p_size % 11 < 2").select(bundle.alias("path"), F.when(F.col("p_size") % 11 == 0, text).otherwise("[no map").alias("text"))
    return R.compiled_sources(scripts, files, maps)


@query("select p_partkey fact_id, 'core/b' || p_partkey as name from part where p_size % 6 in (0, 1)")
def block_names(spark, sf_dir):
    """Names from block.json; other texts (no JSON, no name, a number, an empty name) give none."""
    p = G.table(spark, sf_dir, "part")
    named = F.to_json(F.struct(F.lit(1).alias("v"), _text("core/b", _str("p_partkey")).alias("name")))
    k = F.col("p_size") % 6
    text = F.when(k < 2, named).when(k == 2, "{broken").when(k == 3, '{"name":7}').when(k == 4, '{"name":""}').otherwise('["name"]')
    folder = F.when(k == 1, _text("d", _str("p_partkey"), "/block.json")).otherwise(_text("d", _str("p_partkey")))
    texts = p.select(_text("d", _str("p_partkey"), "/block.json").alias("path"), text.alias("text"))
    return R.block_names(p.select(F.col("p_partkey").alias("fact_id"), folder.alias("dir")), texts)


@query("""select 'src/wp-admin/edit.php' path, 'wp-admin-page:edit.php' as key, 'edit.php' as slug union all select 'wp-login.php', 'wp-frontend:login', 'wp-login.php' union all select 'wp-admin/post.php', 'wp-admin-page:post.php', 'post.php' where exists (select 1 from part)""")
def core_pages(spark, sf_dir):
    """Pages of the core that are there, the one below src first."""
    p = G.table(spark, sf_dir, "part").select(_text("src/p", _str("p_partkey"), ".php").alias("path"))
    known = spark.createDataFrame([("src/wp-admin/edit.php",), ("wp-admin/edit.php",), ("wp-login.php",), ("wp-admin/post.php",), ("wp-admin/media-new.php",), ("x/index.php",)], "path string")
    return R.core_pages(p.unionByName(known))


@query("select distinct 'js/' || a.p_partkey || '.js' path, 'Obj' || (b.p_partkey % 3) as object, b.p_brand as value from part a join part b on a.p_partkey % 50 = b.p_partkey % 70 and b.p_size % 10 = 0 where a.p_size % 2 = 0")
def localized_globals(spark, sf_dir):
    """Scripts see the objects of their handle."""
    p = G.table(spark, sf_dir, "part")
    handle = _text("script-handle:h", (F.col("p_partkey") % 50).cast("string"))
    links = p.select(F.col("p_partkey").alias("fact_id"), handle.alias("key"), F.lit("subject").alias("role"))
    links = links.unionByName(p.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("fact_id"), _text("js-module:js/", _str("p_partkey"), ".js").alias("key"), F.lit("target").alias("role")))
    objects = p.filter("p_size % 10 = 0").select(_text("h", (F.col("p_partkey") % 70).cast("string")).alias("handle"), _text("Obj", (F.col("p_partkey") % 3).cast("string")).alias("object"), F.col("p_brand").alias("value"))
    return R.localized_globals(links, objects)


@query("select p_partkey fact_id, case when p_size % 4 = 0 then p_partkey else 0 end file_id, case when p_size % 4 = 0 then 'core' else p_type end as kind from part")
def file_facts_replaced(spark, sf_dir):
    """All facts of some files give way to new ones."""
    p = G.table(spark, sf_dir, "part")
    # a part numbered 0 has a file of its own, not the one that the other parts share
    own = F.coalesce(F.col("p_size") % 4 == 0, F.lit(False))
    file = F.struct(own.alias("own"), F.when(own, F.col("p_partkey")).otherwise(0).alias("id"))
    facts = p.select(F.col("p_partkey").alias("fact_id"), file.alias("file_id"), F.col("p_type").alias("kind"))
    rows = R.replace_file_facts(facts, p.filter(own).select(F.col("p_partkey").alias("fact_id"), file.alias("file_id"), F.lit("core").alias("kind")))
    return rows.select("fact_id", F.col("file_id.id").alias("file_id"), "kind")


@query("""with f as (select md5((p_partkey % 300)::varchar) h, max(p_partkey) fact_id from part where p_size > 5 group by 1)
select md5(i::varchar) expr_hash, case i % 3 when 0 then 'structural-rule' when 1 then 'project-constant' else 'data-dependent-unresolvable' end classification, 'hook_' || (i % 7) as hook, 'src/f' || (i % 4) || '.php' cite_path, (i % 6)::int cite_line, fact_id,
  case when fact_id is null then 'stale' when i % 3 = 2 then 'unresolvable' when i % 4 < 3 and i % 6 between 1 and 5 and abs(i % 7 + 1 - i % 6) <= 2 and i % 7 < 5 then 'applied' else 'rejected' end status
from range(400) t(i) left join f on h = md5(i::varchar)""")
def resolutions_imported(spark, sf_dir):
    """Answers meet the last live fact of their hash; a citation must hold (line n of a file names hook n - 1)."""
    i = F.col("id")
    answers = spark.range(400).select(
        F.md5(_str("id")).alias("expr_hash"), F.when(i % 3 == 0, R.CLASSES[0]).when(i % 3 == 1, R.CLASSES[1]).otherwise(R.CLASSES[2]).alias("classification"),
        _text("hook_", (i % 7).cast("string")).alias("hook"), _text("src/f", (i % 4).cast("string"), ".php").alias("cite_path"), (i % 6).cast("int").alias("cite_line"),
    )
    live = G.table(spark, sf_dir, "part").filter("p_size > 5").select(F.md5((F.col("p_partkey") % 300).cast("string")).alias("expr_hash"), F.col("p_partkey").alias("fact_id"))
    texts = spark.range(3).select(_text("src/f", _str("id"), ".php").alias("path"), F.lit("\n".join(f"do_action('hook_{k}');" for k in range(5))).alias("text"))
    return R.import_resolutions(answers, live, texts, citation_holds(F.col("text"), F.col("cite_line"), F.col("hook")))
