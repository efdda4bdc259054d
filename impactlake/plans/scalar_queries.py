"""Scalar functions over hard inputs, one for each part: results written out by hand from the rules.

An input is a template; ``@@`` in it, and in what is expected, stands for the part's number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import anchors as A
from ..functions import scalars as S
from ..sources import projection as G
from .registry import ORACLES, QUERIES

Case = tuple[str, tuple]


def _sql(value: object) -> str:
    if value is None:
        return "null"
    return str(value).lower() if isinstance(value, bool) else "replace('" + str(value).replace("'", "''") + "', '@@', p_partkey::varchar)"


def cases(name: str, made: dict[str, Callable[[Column], Column]], table: list[Case]) -> None:
    """Register a query of functions of an input, with the results that ``table`` gives for each."""
    kinds = ["boolean" if any(isinstance(row[1][k], bool) for row in table) else "varchar" for k in range(len(made))]
    rows = []
    for said, expected in table:
        cols = ", ".join(f"{_sql(v)}::{kind} as {column}" for v, kind, column in zip(expected, kinds, made, strict=True))
        rows.append(f"select p_partkey, {_sql(said)} as said, {cols} from part")

    def run(spark, sf_dir):
        part = G.parts(spark, sf_dir, "p_partkey").select("p_partkey", F.explode(F.array(*[F.lit(t) for t, _ in table])).alias("t"))
        said = part.select("p_partkey", F.replace("t", F.lit("@@"), F.col("p_partkey").cast("string")).alias("said"))
        return said.select("p_partkey", "said", *[f(F.col("said")).alias(c) for c, f in made.items()])

    run.__name__, QUERIES[name], ORACLES[name] = name, run, " union all ".join(rows)


cases("rest_urls", {"normalised": S.rest_url_normalise, "path": S.norm_rest_path, "action": S.ajax_action}, [
    ("https://x.test/wp-json/wc/v3/parts/@@?a=1#b", ("/wc/v3/parts/@@", "/wc/v3/parts/@@", None)),
    ("./wp-json/wc/v@@/x#y?z", ("/wc/v@@/x", "/wc/v@@/x", None)),
    ("/wp-json/", ("/", "/", None)),
    ("/wp-json", (None, "/", None)),
    ("mywp-json/a/@@", (None, "/mywp-json/a/@@", None)),
    ("/wc/v3?rest=@@", (None, "/wc/v3", None)),
    ("/wc/v3/?rest=@@", ("/wc/v3/", "/wc/v3", None)),
    ("/wc/v3x/@@", (None, "/wc/v3x/@@", None)),
    ("  http://h/a//b/@@/  ", (None, "/a/b/@@", None)),
    ("HTTP://h/a/@@", (None, "/HTTP:/h/a/@@", None)),
    ("/x/wp-json/a/wp-json/b@@", ("/a/wp-json/b@@", "/a/wp-json/b@@", None)),
    ("/admin-ajax.php?x=1&action=save_@@&y", (None, "/admin-ajax.php", "save_@@")),
    ("/a?wp-json/b&action=", ("/b&action=", "/a", None)),
    ("", (None, "/", None)),
])

cases("admin_urls", {"slug": S.admin_page_slug, "page": S.admin_page_or_slug, "anchor": S.frontend_or_admin_url}, [
    ("/wp-admin/admin.php?page=wc-@@&tab=x", ("wc-@@", "wc-@@", None)),
    ("admin.php?tab=1&page=a_@@.b", ("a_@@", "a_@@", None)),
    ("/wp-admin/admin.php", (None, None, None)),
    ("./wp-admin/edit.php?post_type=p@@", (None, "edit.php", None)),
    ("https://h.test/wp-admin/edit.php?post_type=p@@", (None, None, "wp-admin-page:edit.php")),
    ("/wp-admin/theme-editor.php", (None, "theme-editor.php", None)),
    ("/wp-admin", (None, None, "wp-admin-page:index.php")),
    ("/wp-admin/", (None, None, "wp-admin-page:index.php")),
    ("http://h@@/", (None, None, "wp-frontend:home")),
    ("/wp-login.php#x?y@@", (None, None, "wp-frontend:login")),
    ("edit.php", (None, "edit.php", None)),
    ("/edit.php", (None, None, None)),
    ("/@@/admin.php?page=", (None, None, None)),
    ("", (None, None, None)),
])

cases("route_params", {"collapsed": S.collapse_route_params, "joined": lambda c: S.join_rest_route(F.lit("wc/v3//"), c), "rebased": lambda c: S.rebase_rest_route(c, F.lit("old/"), F.lit("/new"))}, [
    ("/old/(?P<id>[\\d]+)/@@", ("/old/{*}/@@", "/wc/v3/old/(?P<id>[\\d]+)/@@", "/new/(?P<id>[\\d]+)/@@")),
    ("/a/(?<x>(b|c)[()]+)/@@/(?P<y>.*)", ("/a/{*}/@@/{*}", "/wc/v3/a/(?<x>(b|c)[()]+)/@@/(?P<y>.*)", None)),
    ("/a/(?P<x>[^)]/@@", ("/a/{*}", "/wc/v3/a/(?P<x>[^)]/@@", None)),
    ("/a/(b)/@@", ("/a/(b)/@@", "/wc/v3/a/(b)/@@", None)),
    ("old@@", ("old@@", "/wc/v3/old@@", None)),
    ("/old", ("/old", "/wc/v3/old", "/new")),
    ("//a//@@//", ("//a//@@//", "/wc/v3/a/@@", None)),
    ("", ("", "/wc/v3", None)),
])

cases("path_functions", {"plain": S.normalise_path, "below": lambda c: S.project_path(c)["path"], "wrong": lambda c: S.project_path(c)["error"], "compiled": S.looks_compiled, "tail": S.skeleton_tail, "language": S.classify_language, "vendor": S.is_vendor}, [
    ("src/x/../p@@.php", ("src/p@@.php", "src/p@@.php", None, False, None, "php", False)),
    ("../a@@", ("a@@", None, "escapes-root", False, None, None, False)),
    ("a/../../b@@.ts", ("b@@.ts", None, "escapes-root", False, "a/../../b@@.ts", "ts", False)),
    ("/abs/@@.js", ("abs/@@.js", None, "absolute", False, "abs/@@.js", "js", False)),
    ("C:\\x@@.JS", ("C:\\x@@.JS", None, "absolute", False, "C:\\x@@.JS", None, False)),
    ("", ("", None, "empty", False, None, None, False)),
    ("a/..", ("", None, "escapes-root", False, None, None, False)),
    ("./a//b/@@.d.ts", ("a/b/@@.d.ts", "a/b/@@.d.ts", None, False, "./a//b/@@.d.ts", None, False)),
    ("x/build/@@.js", ("x/build/@@.js", "x/build/@@.js", None, True, "x/build/@@.js", "js", False)),
    ("x/builds/@@.min.js", ("x/builds/@@.min.js", "x/builds/@@.min.js", None, True, "x/builds/@@.min.js", "js", False)),
    ("{*}/assets/@@{*}.js", ("{*}/assets/@@{*}.js", "{*}/assets/@@{*}.js", None, False, "assets/@@.js", "js", False)),
    ("{*}/a{*}b@@.mjs", ("{*}/a{*}b@@.mjs", "{*}/a{*}b@@.mjs", None, False, None, "mjs", False)),
    ("vendor/@@.jsx", ("vendor/@@.jsx", "vendor/@@.jsx", None, False, "vendor/@@.jsx", "jsx", True)),
    ("my-vendor/@@.cjs", ("my-vendor/@@.cjs", "my-vendor/@@.cjs", None, False, "my-vendor/@@.cjs", "cjs", False)),
])

_joined = lambda c: F.array_join(c, "|")
cases("method_lists", {"listed": lambda c: _joined(S.split_methods(c)), "constant": lambda c: _joined(S.rest_server_methods(c)), "hook_action": S.derive_ajax, "test_base": S.is_test_base_class}, [
    (" get , post,,", ("GET|POST", "", None, False)),
    ("readable", ("READABLE", "GET", None, False)),
    ("EDITABLE", ("EDITABLE", "POST|PUT|PATCH", None, False)),
    ("AllMethods", ("ALLMETHODS", "GET|POST|PUT|PATCH|DELETE", None, False)),
    ("wp_ajax_nopriv_save_@@", ("WP_AJAX_NOPRIV_SAVE_@@", "", "save_@@", False)),
    ("wp_ajax_save_@@", ("WP_AJAX_SAVE_@@", "", "save_@@", False)),
    ("wp_ajax_nopriv_", ("WP_AJAX_NOPRIV_", "", "nopriv_", False)),
    ("App@@\\WP_UnitTestCase", ("APP@@\\WP_UNITTESTCASE", "", None, True)),
    ("Foo@@\\my_test_case", ("FOO@@\\MY_TEST_CASE", "", None, True)),
    ("MyTestCase", ("MYTESTCASE", "", None, False)),
    ("TestCase", ("TESTCASE", "", None, True)),
])

cases("module_names", {"builtin": S.is_node_builtin, "asset": S.is_asset}, [
    ("fs/promises", (True, False)), ("fs/x@@", (False, False)), ("node:@@", (True, False)), ("punycode/", (False, False)), ("events/x", (False, False)), ("test", (True, False)), ("./fs", (False, False)),
    ("./a@@.SVG?x#y", (False, True)), ("./a@@.styl", (False, True)), ("./a@@.yaml", (False, True)), ("./a@@.wasm", (False, True)), ("./a@@.mdx", (False, True)), ("./a@@.wav", (False, True)), ("./a@@.json5", (False, True)),
    ("./a@@.graphql", (False, False)), ("./a@@.ts", (False, False)), ("./a@@.css.js", (False, False)), ("./a?x.css", (False, False)),
])

GLOBS = ["src/**/*.ts", "**/x?.js", "a[!b]c", "a[a!b]c", "{a,b}/*.php", "src/**", "*.min.*", ""]
cases("glob_matches", {f"g{i}": (lambda g: lambda c: c.rlike(S.glob_regex(g)))(g) for i, g in enumerate(GLOBS)}, [
    ("src/a/b@@.ts", (True, False, False, False, False, True, False, False)),
    ("src/b@@.ts", (True, False, False, False, False, True, False, False)),
    ("srcs/b@@.ts", (False, False, False, False, False, False, False, False)),
    ("x1.js", (False, True, False, False, False, False, False, False)),
    ("d@@/x1.js", (False, True, False, False, False, False, False, False)),
    ("d@@/x/.js", (False, False, False, False, False, False, False, False)),
    ("a!c", (False, False, True, True, False, False, False, False)),
    ("abc", (False, False, True, True, False, False, False, False)),
    ("axc", (False, False, False, False, False, False, False, False)),
    ("aac", (False, False, False, True, False, False, False, False)),
    ("b/x@@.php", (False, False, False, False, True, False, False, False)),
    ("b/c/x@@.php", (False, False, False, False, False, False, False, False)),
    ("a@@.min.js", (False, False, False, False, False, False, True, False)),
    ("", (False, False, False, False, False, False, False, False)),
])

_id = S.parse_test_id
cases("test_ids", {"framework": lambda c: _id(c)["framework"], "path": lambda c: _id(c)["path"], "name": lambda c: _id(c)["filter"], "wrong": lambda c: _id(c)["error"], "again": lambda c: S.format_test_id(_id(c)["framework"], _id(c)["path"], _id(c)["filter"])}, [
    ("jest:a/../b@@.ts::x > y::z", ("jest", "b@@.ts", "x > y::z", None, "jest:b@@.ts::x > y::z")),
    ("phpunit:t/@@.php", ("phpunit", "t/@@.php", None, None, "phpunit:t/@@.php")),
    ("qunit:t/@@.js::", ("qunit", "t/@@.js", "", None, "qunit:t/@@.js::")),
    ("jest:::x", (None, None, None, "malformed", None)),
    ("jest:", (None, None, None, "malformed", None)),
    (":a@@", (None, None, None, "malformed", None)),
    ("a@@", (None, None, None, "malformed", None)),
    ("a/b:c@@", (None, None, None, "malformed", None)),
    ("mocha:x@@", (None, None, None, "unknown-framework", None)),
    ("jest:../x@@", (None, None, None, "path-invalid", None)),
    ("jest:/x@@", (None, None, None, "path-invalid", None)),
    ("playwright:a:b@@::c", ("playwright", "a:b@@", "c", None, "playwright:a:b@@::c")),
])

_anchor = A.parse_anchor
cases("anchor_parsing", {"type": lambda c: _anchor(c)["type"], "key": lambda c: _anchor(c)["key"], "partial": lambda c: _anchor(c)["partial"], "failed": lambda c: _anchor(c)["error"].isNotNull(), "breadth": lambda c: A.wildcard_breadth(c)}, [
    ("rest:post /wp-json/wc/v3/@@/", ("rest", "rest:POST /wc/v3/@@", False, False, "wildcardPrefixed")),
    ("rest:/wc/{*}", ("rest", "rest:GET /wc/{*}", True, False, "wildcardPrefixed")),
    ("rest:GET /{*}", ("rest", "rest:GET /{*}", True, False, "wildcardBroad")),
    ("rest:wc/@@", (None, None, False, True, "wildcardPrefixed")),
    ("ajax:wp_ajax_nopriv_a@@", ("ajax", "ajax:a@@", False, False, "wildcardPrefixed")),
    ("ajax:wp_ajax_", (None, None, False, True, "wildcardPrefixed")),
    ("php-symbol:\\A\\B@@", ("php-symbol", "php-symbol:A\\B@@", False, False, "wildcardPrefixed")),
    ("hook:{*}", ("hook", "hook:{*}", True, False, "wildcardBroad")),
    ("hook:", (None, None, False, True, "wildcardBroad")),
    ("nothing:x@@", (None, None, False, True, "wildcardPrefixed")),
    ("plain@@", (None, None, False, True, "wildcardPrefixed")),
])

cases("json_templates", {"rendered": lambda c: S.render_template("rest:DELETE /x/{a.b}/{*}/{n}", c), "wild": S.contains_wildcard, "method": S.literal_rest_method}, [
    ('{"a":{"b":"v@@"},"n":7}', ("rest:DELETE /x/v@@/{*}/7", False, None)),
    ('{"a":{"b":true},"n":"{*}"}', ("rest:DELETE /x/true/{*}/{*}", True, None)),
    ('{"a":{"b":{"c":1}},"n":7}', (None, False, None)),
    ('{"a":"b","n":7}', (None, False, None)),
    ('{"n":null,"config":{"method":"post"}}', (None, False, "POST")),
    ('{"config":{"method":""},"init":{"method":"Put"}}', (None, False, "PUT")),
    ("no json @@", (None, False, None)),
])

_lists = lambda c: F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("-")), F.split(c, ","))
cases("skeleton_expansion", {"every": lambda c: _joined(S.expand_skeleton(_lists(c)))}, [("x@@,y", ("a-x@@|a-y|b-x@@|b-y",)), ("z", ("a-z|b-z",))])

_classes = [(["tests/e2e/**"], "e2e"), (["**/api/**"], "unit")]
cases("framework_classes", {
    "framework": lambda c: S.detect_framework(c, ["**/*.spec.ts"], ["tests/qunit/**"], ["**/*.test.{ts,js}"]),
    "class": lambda c: S.framework_class(c, S.detect_framework(c, ["**/*.spec.ts"], ["tests/qunit/**"], ["**/*.test.{ts,js}"]), _classes),
}, [
    ("tests/e2e/a@@.test.ts", ("jest", "e2e")), ("x/api/a@@.spec.ts", ("playwright", "unit")), ("x/a@@.spec.ts", ("playwright", "e2e")), ("tests/qunit/a@@.test.js", ("qunit", "unit")),
    ("tests/e2e/api/A@@.php", ("phpunit", "e2e")), ("src/A@@Test.php", ("phpunit", "unit")), ("src/a@@.ts", (None, None)), ("src/A@@.test.php", ("phpunit", "unit")),
])
