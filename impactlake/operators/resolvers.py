"""Cross-file resolvers as joins: inheritance, suffixes, candidates, imported answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import OUTPUT_FOLDERS, collapse_route_params, join_rest_route, normalise_path, rebase_rest_route
from .stages import dropped, stage

MAX_INHERITANCE = 64


def nearest_holder(parents: DataFrame, props: DataFrame) -> DataFrame:
    """(child, ancestor, value, depth) of the nearest proper ancestor with a value, at most ``MAX_INHERITANCE`` levels up.

    parents (child, parent), props (name, value).  Of several values of a name the least
    counts, of several parents of a child the last by name.  Steps double: after round n each
    class knows the first holder among its 2**n ancestors, or its ancestor at that distance, so
    chains of any length and cycles end after a few joins.
    """
    values = props.groupBy(F.col("name").alias("at")).agg(F.min("value").alias("value"))
    up = parents.groupBy("child").agg(F.max("parent").alias("next"))
    first = up.join(values, up.next == values.at, "left").select("child", F.when(F.col("value").isNotNull(), F.col("next")).alias("ancestor"), "value", F.lit(1).cast("long").alias("depth"), "next")
    state = stage(first, "holders")
    for _ in range((MAX_INHERITANCE - 1).bit_length()):
        if not state.filter("value is null and next is not null").limit(1).count():
            break
        above = state.select(F.col("child").alias("next"), F.col("ancestor").alias("a2"), F.col("value").alias("v2"), F.col("depth").alias("d2"), F.col("next").alias("n2"))
        open_ = state.filter("value is null").join(above, "next", "left").select("child", F.col("a2").alias("ancestor"), F.col("v2").alias("value"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.col("n2").alias("next"))
        state, old = stage(state.filter("value is not null").unionByName(open_), "holders"), state
        dropped(old)
    return state.filter(F.col("value").isNotNull() & (F.col("depth") < MAX_INHERITANCE)).select("child", "ancestor", "value", "depth")


nearest_ancestor = nearest_holder


def inherited_value(parents: DataFrame, props: DataFrame) -> DataFrame:
    """(name, owner, value): each class's own value, or that of its nearest ancestor with one."""
    own = props.groupBy("name").agg(F.min("value").alias("value")).select("name", F.col("name").alias("owner"), "value")
    near = nearest_holder(parents, props).select(F.col("child").alias("name"), F.col("ancestor").alias("owner"), "value")
    return own.unionByName(near.join(own.select("name"), "name", "left_anti"))


def class_parents(classes: DataFrame, extends: DataFrame) -> DataFrame:
    """(child, parent) from classes (file_id, name) and ``extends`` (file_id, parent, ord): only files of one class tell whose parent it is; the last counts."""
    rows = single_class_files(classes).join(extends, "file_id")
    return rows.groupBy(F.col("name").alias("child")).agg(F.max_by("parent", "ord").alias("parent"))


def inherited_namespaces(endpoints: DataFrame, parents: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Endpoints that lack only their namespace, with the one of the nearest class that has it.

    endpoints (fact_id, scope, fields array<string>, method, route); namespaces (name, value).
    A route with a wildcard is left alone.  (fact_id, namespace, resolved_from, key, route_param, resolved).
    """
    lacking = endpoints.filter((F.size("fields") == 1) & (F.col("fields")[0] == "namespace") & ~F.contains("route", F.lit("{*}")))
    named = lacking.withColumn("name", F.regexp_replace("scope", "(?s)^(.*)::.*$", "$1")).join(inherited_value(parents, namespaces), "name")
    body = collapse_route_params(join_rest_route(F.col("value"), F.col("route")))
    rows = named.select("fact_id", F.col("value").alias("namespace"), F.col("owner").alias("resolved_from"), F.concat(F.lit("rest:"), F.coalesce("method", F.lit("GET")), F.lit(" "), body).alias("key"))
    return rows.withColumn("route_param", F.contains("key", F.lit("{*}"))).withColumn("resolved", ~F.col("route_param"))


def inherited_endpoints(classes: DataFrame, endpoints: DataFrame, parents: DataFrame, props: DataFrame) -> DataFrame:
    """Endpoints that a class with a namespace or base of its own takes over from its nearest ancestor with endpoints.

    classes (name, file_id, start_line, end_line); endpoints (owner, method, namespace, route);
    props (name, namespace, rest_base).  The route is rebased where both classes have a base and
    they differ, and dropped where it does not begin with the old one; what changes nothing is
    no new endpoint.  (name, owner, file_id, start_line, end_line, namespace, route, key, resolved).
    """
    settings = props.filter("namespace is not null or rest_base is not null").select("name").distinct()
    near = nearest_holder(parents, endpoints.select(F.col("owner").alias("name"), F.col("owner").alias("value"))).select(F.col("child").alias("name"), F.col("ancestor").alias("owner"))
    spaces = inherited_value(parents, props.filter("namespace is not null").select("name", F.col("namespace").alias("value"))).select("name", F.col("value").alias("new_namespace"))
    bases = inherited_value(parents, props.filter("rest_base is not null").select("name", F.col("rest_base").alias("value"))).select("name", F.col("value").alias("base"))
    rows = near.join(settings, "name").join(classes, "name").join(spaces, "name").join(bases.withColumnRenamed("base", "new_base"), "name", "left")
    rows = rows.join(bases.select(F.col("name").alias("owner"), F.col("base").alias("old_base")), "owner", "left").join(endpoints, "owner")
    moved = F.col("new_base").isNotNull() & F.col("old_base").isNotNull() & (F.col("new_base") != F.col("old_base"))
    rows = rows.withColumn("new_route", F.when(moved, rebase_rest_route(F.col("route"), F.col("old_base"), F.col("new_base"))).otherwise(F.col("route")))
    rows = rows.filter("new_route is not null and not (new_namespace = namespace and new_route = route)")
    key = F.concat(F.lit("rest:"), F.col("method"), F.lit(" "), collapse_route_params(join_rest_route(F.col("new_namespace"), F.col("new_route"))))
    return rows.select("name", "owner", "file_id", "start_line", "end_line", F.col("new_namespace").alias("namespace"), F.col("new_route").alias("route"), key.alias("key"), (~F.contains(key, F.lit("{*}"))).alias("resolved"))


def unique_suffix(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(tail, file_id) of tails that are the whole or a ``/``-suffix of exactly one path."""
    parts = F.split("path", "/", -1)
    tails = files.select("file_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("tail"))
    one = tails.join(asked.select("tail").distinct(), "tail", "left_semi").groupBy("tail").agg(F.min("file_id").alias("file_id"), F.count("*").alias("n")).filter("n = 1")
    return asked.join(one.select("tail", "file_id"), "tail")


#: Extensions of sources in order of preference (fixed values).
SOURCE_EXTENSIONS = ["tsx", "ts", "jsx", "mjs", "cjs", "js"]


def mapped_sources(maps: DataFrame, files: DataFrame) -> DataFrame:
    """(path, source) of bundles: the first entry of a source map that is a file.

    maps (path of the bundle, text).  Entries are relative to the bundle's folder; a map that
    is no JSON object with an array of strings names none.
    """
    listed = F.from_json("text", "struct<sources:array<string>>")["sources"]
    folder = F.regexp_replace("path", r"[^/]*$", "")
    rows = maps.select("path", folder.alias("folder"), F.posexplode(listed).alias("n", "entry"))
    rows = rows.select("path", "n", normalise_path(F.concat("folder", F.regexp_replace("entry", "^webpack:///?", ""))).alias("candidate"))
    return rows.join(files.select(F.col("path").alias("candidate")), "candidate").groupBy("path").agg(F.min_by("candidate", "n").alias("source"))


def compiled_sources(scripts: DataFrame, files: DataFrame, maps: DataFrame | None = None, folders: tuple[str, ...] = OUTPUT_FOLDERS) -> DataFrame:
    """(path, source) of compiled scripts (path): ``x.min.js`` to ``x.js``; then the source map (path, text); then, below an
    output folder and with a manifest beside it, ``src/x`` and ``src/x/index`` with each extension in turn."""
    parts = F.split("path", "/", -1)
    place = F.array_position(F.transform(parts, lambda p: p.isin(*folders)), True).cast("int")
    stem = F.regexp_replace(F.array_join(F.slice(parts, place + 1, F.size(parts)), "/"), r"\.js$", "")
    below = F.concat(F.regexp_replace(F.concat(F.array_join(F.slice(parts, F.lit(1), place - 1), "/"), F.lit("/src/")), "^/", ""), stem)
    built = (place > 0) & F.col("path").endswith(".js")
    tried = F.array(*[F.concat(below, F.lit(end + "." + e)) for e in SOURCE_EXTENSIONS for end in ("", "/index")])
    path = files.select(F.col("path").alias("candidate"))
    plain = scripts.filter(F.col("path").endswith(".min.js")).select("path", F.regexp_replace("path", r"\.min\.js$", ".js").alias("candidate"), F.lit(0).alias("n"))
    manifest = scripts.filter(built).withColumn("candidate", F.regexp_replace("path", r"\.js$", ".asset.php")).join(path, "candidate", "left_semi").select("path")
    rows = manifest.select("path", F.posexplode(tried).alias("n", "candidate")).select("path", "candidate", (F.col("n") + 2).alias("n"))
    rows = rows.unionByName(plain).join(path, "candidate")
    if maps is not None:
        rows = rows.unionByName(mapped_sources(maps.join(scripts.select("path"), "path", "left_semi"), files).select("path", F.col("source").alias("candidate"), F.lit(1).alias("n")))
    return rows.groupBy("path").agg(F.min_by("candidate", "n").alias("source"))


def block_names(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """(fact_id, name) of blocks (fact_id, dir) from the ``block.json`` (path, text) of their folder; a text without a non-empty name gives none."""
    named = F.col("dir").endswith("/block.json") | (F.col("dir") == "block.json")
    asked = blocks.filter("dir <> ''").select("fact_id", F.when(named, F.col("dir")).otherwise(F.concat("dir", F.lit("/block.json"))).alias("path"))
    name = F.try_variant_get(F.try_parse_json("text"), "$.name", "string")
    quoted = F.schema_of_variant(F.try_variant_get(F.try_parse_json("text"), "$.name", "variant")) == "STRING"
    return asked.join(texts, "path").filter(quoted).select("fact_id", name.alias("name")).filter("name <> ''")


#: Files that are pages of the core without registering, below the root or its ``src`` (fixed values).
CORE_PAGES = {f"wp-admin/{p}": f"wp-admin-page:{p}" for p in (
    "index.php edit.php edit-tags.php post.php post-new.php upload.php media-new.php themes.php plugins.php users.php user-new.php profile.php tools.php "
    "options-general.php options-writing.php options-reading.php options-discussion.php options-media.php options-permalink.php").split() if p != "media-new.php"}  # fmt: skip
CORE_PAGES |= {"wp-login.php": "wp-frontend:login", "index.php": "wp-frontend:home"}


def core_pages(files: DataFrame) -> DataFrame:
    """(path, key, slug) of the core's pages that are there; the one below ``src`` comes before the other."""
    rows = [(n, folder + page, key, page.rpartition("/")[2]) for page, key in CORE_PAGES.items() for n, folder in enumerate(("src/", ""))]
    asked = files.sparkSession.createDataFrame(rows, "n int, path string, key string, slug string")
    met = F.broadcast(asked).join(files.select("path"), "path")
    return met.groupBy("key", "slug").agg(F.min_by("path", "n").alias("path")).select("path", "key", "slug")


def single_class_files(classes: DataFrame) -> DataFrame:
    """Classes (file_id, name) that are the only one of their file."""
    only = classes.groupBy("file_id").agg(F.count("*").alias("n")).filter("n = 1").select("file_id")
    return classes.join(only, "file_id", "left_semi")


def localized_globals(enqueues: DataFrame, objects: DataFrame) -> DataFrame:
    """(path, object, value): scripts see the objects (handle, object, value) of their handle.

    enqueues: links (fact_id, key, role) of enqueue facts, of which ``script-handle:`` subjects
    name the handle and ``js-module:`` targets the script.
    """
    handles = enqueues.filter("role = 'subject' and key like 'script-handle:%'").select("fact_id", F.expr("substr(key, 15)").alias("handle"))
    scripts = enqueues.filter("role = 'target' and key like 'js-module:%'").select("fact_id", F.expr("substr(key, 11)").alias("path"))
    # many facts say the same of a handle; each object meets each script of its handle once
    named = handles.join(scripts, "fact_id").select("handle", "path").distinct()
    # few bytes go in and many rows come out, so tasks are not put together by what goes in
    named = named.repartition(int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")), "handle")
    return named.join(objects.select("handle", "object", "value").distinct(), "handle").select("path", "object", "value").distinct()


def replace_file_facts(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Facts with all facts of the files in ``new`` replaced by those."""
    return facts.join(new.select("file_id").distinct(), "file_id", "left_anti").select(*facts.columns).unionByName(new)


#: What an answer may be classified as (fixed values).
CLASSES = ["structural-rule", "project-constant", "data-dependent-unresolvable"]


def import_resolutions(answers: DataFrame, live: DataFrame, texts: DataFrame, cited: Column) -> DataFrame:
    """Answers (expr_hash, classification, hook, cite_path, cite_line) with fact_id and status.

    ``live`` facts (expr_hash, fact_id): the last of a hash counts.  ``texts`` (path, text):
    ``cited`` tells from ``text``, ``cite_line`` and ``hook`` whether the citation holds.  Status:
    stale (no live fact), unresolvable, rejected (the citation does not hold) or applied.
    """
    last = live.groupBy("expr_hash").agg(F.max("fact_id").alias("fact_id"))
    rows = answers.join(last, "expr_hash", "left").join(texts.withColumnRenamed("path", "cite_path"), "cite_path", "left")
    status = F.when(F.col("fact_id").isNull(), "stale").when(F.col("classification") == CLASSES[2], "unresolvable").when(F.coalesce(cited, F.lit(False)), "applied").otherwise("rejected")
    return rows.select(*answers.columns, "fact_id", status.alias("status"))
