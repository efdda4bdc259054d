"""Scalar functions on paths, routes, URLs, test ids and expressions, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by extension (fixed values).
LANGUAGES = {"php": "php", "ts": "ts", "tsx": "tsx", "js": "js", "jsx": "jsx", "mjs": "mjs", "cjs": "cjs"}
FRAMEWORKS = ["phpunit", "jest", "playwright", "qunit"]
#: Methods of the class constants of the REST server (fixed values).
METHOD_CONSTANTS = {"READABLE": "GET", "CREATABLE": "POST", "EDITABLE": "POST, PUT, PATCH", "DELETABLE": "DELETE", "ALLMETHODS": "GET, POST, PUT, PATCH, DELETE"}
#: Modules of the JavaScript runtime (fixed values).
NODE_MODULES = (
    "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs fs/promises http http2 https inspector module net os path path/posix path/win32 "
    "perf_hooks process punycode querystring readline repl stream stream/consumers stream/promises stream/web string_decoder sys test timers timers/promises tls trace_events tty url util util/types v8 vm wasi worker_threads zlib"
).split()
#: Extensions of files that bundlers take for assets (fixed values).
ASSETS = "scss sass css less stylus styl json json5 yaml yml svg png jpg jpeg gif webp avif ico woff woff2 ttf otf eot mp3 mp4 webm wav md mdx txt html wasm".split()
#: Pages of the administration that have no slug (fixed values).
CORE_ADMIN_PAGES = (
    "index.php edit.php edit-tags.php post.php post-new.php upload.php media-new.php themes.php theme-editor.php plugins.php plugin-editor.php users.php user-new.php profile.php tools.php "
    "options-general.php options-writing.php options-reading.php options-discussion.php options-media.php options-permalink.php admin.php"
).split()
#: Pages that a plain URL below /wp-admin/ names (fixed values).
URL_ADMIN_PAGES = [p for p in CORE_ADMIN_PAGES if p not in ("theme-editor.php", "plugin-editor.php", "admin.php")]
#: Folders of compiled files where no setting names others (fixed values).
OUTPUT_FOLDERS = ("build", "dist")


def regexp_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def classify_language(path: Column) -> Column:
    """The language of a path, or null: declarations and other files."""
    ext = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(path.rlike(r"\.d\.(?:ts|tsx|mts|cts)$"), F.lit(None)).otherwise(F.try_element_at(table, ext))


_GLOB = re.compile(r"(?P<deep>\*\*/?)|(?P<star>\*)|(?P<one>\?)|\[(?P<set>[^\]]*)\]|\{(?P<any>[^}]*)\}|(?P<rest>.)", re.DOTALL)


def _plain(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", text)


def glob_regex(glob: str) -> str:
    """A regular expression for a glob: ``**`` crosses folders, ``*`` and ``?`` do not, ``{a,b}`` are literals; nothing matches the empty glob."""

    def one(m: re.Match) -> str:
        if m["set"] is not None:
            inside = re.sub(r"([\\\[&])", r"\\\1", m["set"])
            return f"[{inside}]" if inside else "(?!)"
        if m["any"] is not None:
            return "(?:" + "|".join(map(_plain, m["any"].split(","))) + ")"
        return {"deep": ".*", "star": "[^/]*", "one": "[^/]"}.get(m.lastgroup) or _plain(m["rest"])

    return "^" + _GLOB.sub(one, glob) + r"\z" if glob else "(?!)"


def matches_any(path: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g))
    return hit


def detect_framework(path: Column, playwright: list[str], qunit: list[str], jest: list[str]) -> Column:
    """Playwright globs, then QUnit globs, then the PHPUnit heuristic, then Jest globs; else null."""
    php = path.endswith(".php") & path.rlike(r"(?i)(?:^|/)tests/|Test\.php$")
    return F.when(matches_any(path, playwright), "playwright").when(matches_any(path, qunit), "qunit").when(php, "phpunit").when(~path.endswith(".php") & matches_any(path, jest), "jest")


def is_vendor(path: Column) -> Column:
    return path.rlike("(?:^|/)vendor/")


def _steps(path: Column, escape: bool) -> Column:
    """array<string> of a path's parts, ``.`` dropped and ``..`` taken away; above the root null if ``escape``, else dropped."""
    nothing = F.array().cast("array<string>")
    up = lambda a: F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.lit(None).cast("array<string>") if escape else nothing)
    step = lambda a, p: F.when(a.isNull() | p.isin("", "."), a).when(p == "..", up(a)).otherwise(F.concat(a, F.array(p)))
    return F.aggregate(F.split(path, "/", -1), nothing, step)


def _walked(path: Column, escape: bool) -> Column:
    """A path without its empty parts, ``.`` and ``..``; most have none and are not taken apart."""
    return F.when(path.rlike(r"(?:^|/)\.{0,2}(?:/|\z)"), F.array_join(_steps(path, escape), "/")).otherwise(path)


def _path_error(path: Column) -> Column:
    error = F.when(path == "", "empty").when(path.rlike(r"^(?:/|[A-Za-z]:[\\/])"), "absolute").when(F.contains(path, F.lit("\0")), "nul-byte")
    return error.when(F.coalesce(_walked(path, True), F.lit("")) == "", "escapes-root")


def project_path(path: Column) -> Column:
    """struct<path, error> of a path below the project's root."""
    error = _path_error(path)
    return F.struct(F.when(error.isNull(), _walked(path, True)).alias("path"), error.alias("error"))


def parse_test_id(raw: Column) -> Column:
    """struct<framework, path, filter, error> of ``framework:path[::filter]``; a filter may be empty."""
    at = F.instr(raw, F.lit(":"))
    framework, rest = F.substr(raw, F.lit(1), at - 1), F.substr(raw, at + 1, F.length(raw))
    cut = F.instr(rest, F.lit("::"))
    path = F.substring_index(rest, "::", 1)
    name = F.when(cut > 0, F.substr(rest, cut + 2, F.length(rest)))
    error = F.when((at <= 1) | framework.rlike(r"[/\\. ]"), "malformed").when(~framework.isin(FRAMEWORKS), "unknown-framework").when(path == "", "malformed").when(_path_error(path).isNotNull(), "path-invalid")
    return F.struct(*[F.when(error.isNull(), c).alias(n) for c, n in ((framework, "framework"), (_walked(path, True), "path"), (name, "filter"))], error.alias("error"))


def format_test_id(framework: Column, path: Column, name: Column) -> Column:
    return F.concat(framework, F.lit(":"), path, F.coalesce(F.concat(F.lit("::"), name), F.lit("")))


def framework_class(path: Column, framework: Column, rules: list[tuple[list[str], str]]) -> Column:
    """The class of the first rule (globs, class) that holds a test's path, else e2e for playwright and unit for others; no framework: null."""
    own = F.lit(None).cast("string")
    for globs, name in reversed(rules):
        own = F.when(matches_any(path, globs), name).otherwise(own)
    return F.when(framework.isNotNull(), F.coalesce(own, F.when(framework == "playwright", "e2e").otherwise("unit")))


def join_rest_route(namespace: Column, route: Column) -> Column:
    ns, r = F.regexp_replace(namespace, "/+$", ""), F.regexp_replace(F.regexp_replace(route, "^/+", ""), "/+$", "")
    return F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), ns, F.lit("/"), r), "/+", "/"), r"(?s)(?<=.)/\z", "")


def rebase_rest_route(route: Column, old: Column, new: Column) -> Column:
    """The route with its prefix ``/old`` replaced, or null where it has none."""
    bare = lambda c: F.concat(F.lit("/"), F.regexp_replace(c, "^/+|/+$", ""))
    base = bare(old)
    met = (route == base) | F.startswith(route, F.concat(base, F.lit("/")))
    return F.when(met, F.concat(bare(new), F.substr(route, F.length(base) + 1, F.length(route))))


def rest_url_normalise(url: Column) -> Column:
    """What follows ``wp-json`` (a word of its own) up to query and fragment, or a path that begins with a versioned namespace; else null."""
    return F.when(url.rlike(r"\bwp-json/"), F.regexp_extract(url, r"\bwp-json(/[^?#]*)", 1)).when(url.rlike(r"^/[A-Za-z0-9_-]+/v[0-9]+(?:/|\z)"), F.regexp_extract(url, r"^[^?#]*", 0))


def norm_rest_path(url: Column) -> Column:
    """Without scheme, host, what stands before the first ``/wp-json``, query and fragment; one leading slash, none at the end."""
    c = F.regexp_replace(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""), r"^[a-z]+://[^/]+", "")
    c = F.regexp_extract(F.regexp_replace(c, r"(?s)^.*?/wp-json", ""), r"^[^?#]*", 0)
    c = F.regexp_replace(F.concat(F.lit("/"), c), "/+", "/")
    return F.when(F.length(c) > 1, F.regexp_replace(c, "/$", "")).otherwise(c)


def acceptable_rest_path(path: Column) -> Column:
    """No scoped package, and literal or with one wildcard that is not the first segment."""
    bare = F.regexp_replace(path, "^/+", "")
    wild = F.regexp_count(path, F.lit(r"\{\*\}"))
    return ~bare.startswith("@") & ((wild == 0) | ((wild == 1) & (F.substring_index(bare, "/", 1) != "{*}")))


def ajax_action(url: Column) -> Column:
    return regexp_or_null(url, r"[?&]action=([A-Za-z0-9_-]+)")


def admin_page_slug(url: Column) -> Column:
    """The page of an ``admin.php`` URL, or null."""
    return F.when(F.contains(url, F.lit("admin.php")), regexp_or_null(url, r"[?&]page=([A-Za-z0-9_-]+)"))


def admin_page_or_slug(value: Column) -> Column:
    """The slug of ``admin.php?page=...``, or the name of a core page; else null."""
    bare = F.regexp_replace(value, r"^\.?/?wp-admin/", "")
    head = F.substring_index(bare, "?", 1)
    return F.when(bare.startswith("admin.php"), regexp_or_null(bare, r"[?&]page=([A-Za-z0-9_-]+)")).when(head.isin(CORE_ADMIN_PAGES), head)


def frontend_or_admin_url(url: Column) -> Column:
    """The anchor key of a URL of the front end or of an administration page, or null."""
    path = F.regexp_extract(F.regexp_replace(url, "^https?://[^/]+", ""), "^[^?#]*", 0)
    page = F.regexp_extract(path, "^/wp-admin/([^/]+)$", 1)
    home = F.when(url == "", None).when(path == "/", "wp-frontend:home").when(path == "/wp-login.php", "wp-frontend:login")
    return F.coalesce(home, F.when((url != "") & path.isin("/wp-admin", "/wp-admin/"), "wp-admin-page:index.php"), F.when(page.isin(URL_ADMIN_PAGES), F.concat(F.lit("wp-admin-page:"), page)))


def skeleton_tail(src: Column) -> Column:
    """The literal tail of a source path that starts with a wildcard, or null."""
    c = F.regexp_replace(F.regexp_replace(src, r"^(?:\{\*\})?/*", ""), r"(?i)\{\*\}(\.m?js)$", "$1")
    return F.when(src.rlike(r"(?i)\.(?:mjs|cjs|jsx|tsx|ts|js)$") & ~F.contains(c, F.lit("{*}")), c)


def looks_compiled(path: Column, folders: tuple[str, ...] = OUTPUT_FOLDERS) -> Column:
    return path.endswith(".min.js") | path.rlike("(?:^|/)(?:" + "|".join(map(re.escape, folders)) + r")(?:/|\z)")


def normalise_path(path: Column) -> Column:
    """Without empty parts and ``.``, with ``..`` taken away; what would leave the root is dropped."""
    return _walked(path, False)


def split_methods(raw: Column) -> Column:
    """array<string> of a comma-joined list of methods."""
    return F.filter(F.split(F.upper(F.trim(raw)), r"\s*,\s*", -1), lambda m: m != "")


def rest_server_methods(name: Column) -> Column:
    """array<string> of the methods that a constant of the REST server stands for; of others none."""
    known = F.create_map(*[F.lit(x) for kv in METHOD_CONSTANTS.items() for x in kv])
    return F.coalesce(split_methods(F.try_element_at(known, F.upper(name))), F.array().cast("array<string>"))


def derive_ajax(hook: Column) -> Column:
    return regexp_or_null(hook, r"^wp_ajax_(?:nopriv_)?(.+)$")


def is_node_builtin(specifier: Column) -> Column:
    return specifier.startswith("node:") | specifier.isin(NODE_MODULES)


def is_asset(specifier: Column) -> Column:
    return F.regexp_replace(specifier, r"(?s)[?#].*$", "").rlike(r"(?i)\.(?:" + "|".join(ASSETS) + r")\z")


def is_test_base_class(name: Column) -> Column:
    return F.substring_index(name, "\\", -1).rlike(r"(?i)(?:^|_)(?:Unit)?Test_?Case$")


def expr_hash(scope: Column, fields: Column) -> Column:
    """sha256 of a scope and fields, array<struct<field, expression>>, sorted by field."""
    lines = F.transform(F.array_sort(fields), lambda f: F.concat(f["field"], F.lit("="), f["expression"], F.lit("\n")))
    return F.sha2(F.concat(scope, F.lit("\n"), F.array_join(lines, "")), 256)


def content_hash(text: Column) -> Column:
    return F.sha1(text)


def context_lines(text: Column, start: Column, end: Column, margin: int = 8) -> Column:
    """Lines [start - margin, end + margin] of a text, counted from 1 and kept inside it."""
    lines = F.split(text, "\n", -1)
    first, last = F.greatest(start - margin, F.lit(1)), F.least(end + margin, F.size(lines))
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


def citation_holds(text: Column, line: Column, token: Column, margin: int = 2) -> Column:
    lines = F.split(text, "\n", -1)
    inside = (line >= 1) & (line <= F.size(lines))
    first = F.greatest(line - margin, F.lit(1))
    near = F.slice(lines, first, F.greatest(F.least(line + margin, F.size(lines)) - first + 1, F.lit(0)))
    return inside & F.exists(near, lambda x: F.contains(x, token))


def collapse_route_params(route: Column) -> Column:
    """Every ``(?P<name>...)`` or ``(?<name>...)`` of a route becomes ``{*}``; one that is never closed takes the rest."""
    kind = "struct<out:string,depth:int,inside:boolean>"
    # brackets, and what stands between them, one token each
    tokens = F.regexp_extract_all(route, F.lit(r"\(\?P?<|[()\[\]]|[^()\[\]]+"), F.lit(0))

    def step(a: Column, c: Column) -> Column:
        opens = c.isin("(?P<", "(?<")
        depth = a["depth"] + F.when(a["inside"], 0).when((c == "(") | opens, 1).when(c == ")", -1).otherwise(0)
        within = F.struct(a["out"].alias("out"), depth.alias("depth"), F.when(a["inside"], c != "]").otherwise(c == "[").alias("inside"))
        begun = F.struct(F.concat(a["out"], F.lit("{*}")).alias("out"), F.lit(1).alias("depth"), F.lit(False).alias("inside"))
        plain = F.struct(F.concat(a["out"], c).alias("out"), F.lit(0).alias("depth"), F.lit(False).alias("inside"))
        return F.when(a["depth"] > 0, within).when(opens, begun).otherwise(plain).cast(kind)

    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit(False).alias("inside")).cast(kind)
    return F.when(route.rlike(r"\(\?P?<"), F.aggregate(tokens, empty, step, lambda a: a["out"])).otherwise(route)


def render_template(template: str, fields: Column) -> Column:
    """A template whose ``{a.b}`` are taken from a JSON text; null where one is missing, null or no plain value.  ``{*}`` stays."""
    parts = []
    for literal, name in re.findall(r"((?:[^{]|\{\*\}|\{(?![^}]+\}))*)(?:\{([^}]+)\}|$)", template):
        parts.append(F.lit(literal))
        if name:
            where = "$" + "".join(f"['{p}']" for p in name.split("."))
            held = F.try_parse_json(fields)
            plain = F.schema_of_variant(F.try_variant_get(held, where, "variant")).rlike("^(?:STRING|BIGINT|DOUBLE|DECIMAL|BOOLEAN)")
            parts.append(F.when(plain, F.try_variant_get(held, where, "string")))
    return F.concat(*parts)


def contains_wildcard(fields: Column) -> Column:
    """Whether any string of a JSON text holds a wildcard."""
    return F.coalesce(F.contains(fields, F.lit("{*}")), F.lit(False))


def literal_rest_method(fields: Column) -> Column:
    """The method that ``config`` or ``init`` of a JSON text names, in capitals, or null."""
    named = [F.get_json_object(fields, f"$.{f}.method") for f in ("config", "init")]
    return F.upper(F.coalesce(*[F.when(m != "", m) for m in named]))


def expand_skeleton(parts: Column) -> Column:
    """array<string> of all strings that one value of each of the parts, array<array<string>>, makes in order."""
    return F.aggregate(parts, F.array(F.lit("")), lambda a, p: F.flatten(F.transform(a, lambda x: F.transform(p, lambda y: F.concat(x, y)))))
