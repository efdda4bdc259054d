"""Extraction over texts made for each part; what must come out is written by hand.

``@@`` in a text stands for the part's number.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..extract import build as B
from ..operators import report as R
from ..operators.stages import stage
from ..operators.traverse import derive
from ..sources import projection as G
from .registry import ORACLES, QUERIES, query

IMPORTS = """import a, {b as c, type D} from './x@@';
import type Q from "q"
import * as ns from '../ns'
import {type E} from 'e';
export * from './all'; export {type T} from './t'
const z = require('fs'), y = await import("./dyn.css?x")
jest.mock('./m@@', () => ({})) // import 'no'
const t = `import ${require('./in')} from 'no'`
function f(require) { return "require('no')" }
"""
DEFS = """export default async function foo(x: {a: number}): Promise<{b: string}> { return 1 }
@dec() export class K@@<T> extends B {
  private static async m(a) { this.n(); }
  get n(): number { return /[/"]x/.test(a) ? 1 : 2 }
  prop = () => { foo() }
  constructor() { super(); }
}
interface I { a(): void }
type U =
  | 'x'
  | { y: 1 }
export const enum En { A }
let v1 = 1, {v2} = o,
  v3 = () => {}
export { v1 as vv, nope } from './z'
export = v3
"""
USES = """import d, { b as c } from './dep@@';
import * as ns from './dep@@'
import gone from './gone'
class A { m() { this.m(); this.x(); other.m(); new A } }
function own() { c(`t ${ns.member(1)} x`); c(2); gone(); d.x() }
own(); new ns.K(); obj.own()
const el = <d a="it's" {...p} b={own(1)}>don't {c} <ns.Part/></d>
"""
GLOBALS = """(function () {
  wp.data.select@@ = function () { return wp.i18n.__('x') }
})();
window.wp.foo = { bar() {}, 'baz': 1, ...x }
wp.late = api; api.one = 1
function a() { return () => { wp.deep.x = 1; } }
"""
TESTS = """describe('outer', () => {
  it('a@@', async () => { it('inner', f) })
  describe.each([1])('each %s', () => { test.only(`b`, function () {}) })
  test.describe.serial('ser', function named() {
    it(`x${1}`, () => {})
  })
})
it.todo('later'); it.each([1])('no', f); xit('no', f)
"""
QUNIT = """QUnit.module('m1');
QUnit.test('t1', function (assert) {});
( function () { QUnit.module('in'); QUnit.test('t2', f); } )();
QUnit.module('m2', function (hooks) { QUnit.test('t3', () => {}) });
QUnit.test('t@@', f)
"""
CALLS = """const NAME = 'core/x' as const;
class A { m() { wp.hooks.doAction('a_' + kind + '_b'); useDispatch(NAME) } }
apiFetch({ path: `/wc/v3/orders/${id}`, method: 'post' });
fetch('/wp-json/x/v1/@@', { method: "DELETE" });
$.post(ajaxurl + '?action=save_it', {});
jQuery.ajax({ url: u, data: { action: 'go@@' } });
page.goto('/wp-admin/admin.php?page=wc-x'); page.goto('/wp-login.php?x');
request.get('./wp-json/wc/v3/x?y'); request.get('/other');
select(other); admin.visitAdminPage('edit.php', 'x'); this.addAction('zz')
"""
PHP = """<?php
namespace App\\Rest;
use Foo\\Bar; use Baz\\Qux as Q;
define('MY_DIR', 'assets');
require_once __DIR__ . '/../inc/a@@.php';
include $x;
/** @covers Bar::go */
final class Ctl extends \\WP_UnitTestCase implements Iface {
  const NS = 'app/v1';
  protected $namespace = 'ns/v2';
  /** @dataProvider prov */
  public function test_it() { $this->helper(); Q::make(); new Bar(); }
  public function register() {
    register_rest_route( $this->namespace, '/i@@/(?P<id>[\\d(]+)', array( array( 'methods' => WP_REST_Server::CREATABLE ), array('methods' => 'get') ) );
    add_submenu_page('p','t','m','c','my-slug', array($this,'render'));
    do_action( "pre_{$h}_" . self::NS );
  }
}
function boot() {
  foreach ( array( 'a', 'b' ) as $t ) { add_action( "save_$t", 'cb', 10 ); }
  wp_enqueue_script( 'h', plugins_url( 'js/a.js', __FILE__ ) );
  register_block_type_from_metadata( __DIR__, array( 'render_callback' => 'render_block_core_latest_posts' ) );
}
?>
<b>html don't</b> <?php do_shortcode( 'tag@@' ); # note ?>
"""
BROKEN = "const a = `never closed ${"

#: (query, kinds of facts, [(path, language, framework, text)], [(path, kind, resolved, first line, last line, keys)])
_T = "jest:p@@/t.spec.ts::outer > "
TABLE = [
    ("js_imports", ["import-edge", "parse-error"], [("p@@/src/i.ts", "ts", None, IMPORTS), ("p@@/src/x@@.tsx", "tsx", None, ""), ("p@@/ns/index.js", "js", None, ""), ("p@@/src/bad.js", "js", None, BROKEN)], [
        ("p@@/src/i.ts", "import-edge", True, 1, 1, "js-module:p@@/src/x@@.tsx"), ("p@@/src/i.ts", "import-edge", False, 2, 2, "js-module:q"), ("p@@/src/i.ts", "import-edge", True, 3, 3, "js-module:p@@/ns/index.js"),
        ("p@@/src/i.ts", "import-edge", False, 4, 4, "js-module:e"), ("p@@/src/i.ts", "import-edge", False, 5, 5, "js-module:./all"), ("p@@/src/i.ts", "import-edge", False, 5, 5, "js-module:./t"),
        ("p@@/src/i.ts", "import-edge", True, 6, 6, "js-module:fs"), ("p@@/src/i.ts", "import-edge", True, 6, 6, "js-module:./dyn.css?x"), ("p@@/src/i.ts", "import-edge", False, 7, 7, "js-module:./m@@"),
        ("p@@/src/i.ts", "import-edge", False, 8, 8, "js-module:./in"), ("p@@/src/bad.js", "parse-error", False, 1, 1, ""),
    ]),
    ("js_symbols", ["symbol-def"], [("p@@/d.ts", "ts", "jest", DEFS)], [
        ("p@@/d.ts", "symbol-def", True, a, b, f"js-symbol:p@@/d.ts:{n}") for n, a, b in (("foo", 1, 1), ("K@@", 2, 7), ("K@@#m", 3, 3), ("K@@#n", 4, 4), ("I", 8, 8), ("U", 9, 11), ("En", 12, 12), ("v1", 13, 14), ("v3", 13, 14), ("vv", 13, 14), ("nope", 15, 15), ("default", 16, 16))
    ]),
    ("js_uses", ["symbol-use"], [("p@@/u.tsx", "tsx", "jest", USES), ("p@@/dep@@.ts", "ts", "jest", "")], [
        ("p@@/u.tsx", "symbol-use", True, a, a, k) for a, k in (
            (4, "js-symbol:p@@/u.tsx:A#m"), (4, "js-symbol:p@@/u.tsx:A"), (5, "js-symbol:p@@/dep@@.ts:b"), (5, "js-symbol:p@@/dep@@.ts:member"), (6, "js-symbol:p@@/u.tsx:own"),
            (6, "js-symbol:p@@/dep@@.ts:K"), (7, "js-symbol:p@@/dep@@.ts:default"), (7, "js-symbol:p@@/dep@@.ts:Part"))
    ]),
    ("js_globals", ["symbol-def", "symbol-use"], [("p@@/g.js", "js", None, GLOBALS)], [
        ("p@@/g.js", "symbol-def", True, 2, 2, "js-global:wp.data"), ("p@@/g.js", "symbol-def", True, 2, 2, "js-global:wp.data.select@@"), ("p@@/g.js", "symbol-use", True, 2, 2, "js-global:wp.i18n.__"),
        ("p@@/g.js", "symbol-def", True, 4, 4, "js-global:wp.foo"), ("p@@/g.js", "symbol-def", True, 4, 4, "js-global:wp.foo.bar"), ("p@@/g.js", "symbol-def", True, 4, 4, "js-global:wp.foo.baz"),
        ("p@@/g.js", "symbol-def", True, 5, 5, "js-global:wp.late"), ("p@@/g.js", "symbol-def", True, 5, 5, "js-global:wp.late.one"), ("p@@/g.js", "symbol-def", True, 6, 6, "js-symbol:p@@/g.js:a"),
    ]),
    ("js_tests", ["test-def"], [("p@@/t.spec.ts", "ts", "jest", TESTS), ("p@@/q.js", "js", "qunit", QUNIT), ("p@@/n.js", "js", None, TESTS)], [
        ("p@@/t.spec.ts", "test-def", True, 2, 2, f"test:{_T}a@@"), ("p@@/t.spec.ts", "test-def", True, 3, 3, f"test:{_T}b"), ("p@@/t.spec.ts", "test-def", False, 5, 5, f"test:{_T}ser > <dynamic>"),
        ("p@@/t.spec.ts", "test-def", True, 8, 8, "test:jest:p@@/t.spec.ts::later"),
        ("p@@/q.js", "test-def", True, 2, 2, "test:qunit:p@@/q.js::m1 > t1"), ("p@@/q.js", "test-def", True, 3, 3, "test:qunit:p@@/q.js::m1 > in > t2"),
        ("p@@/q.js", "test-def", True, 4, 4, "test:qunit:p@@/q.js::m2 > t3"), ("p@@/q.js", "test-def", True, 5, 5, "test:qunit:p@@/q.js::m1 > t@@"),
    ]),
    ("js_patterns", ["hook-fire", "hook-listener", "store-access", "rest-call-js", "ajax-call-js", "admin-page-nav"], [("p@@/c.ts", "ts", None, CALLS)], [
        ("p@@/c.ts", k, r, a, a, key) for k, r, a, key in (
            ("hook-fire", False, 2, "hook:a_{*}_b"), ("store-access", True, 2, "wp-store:core/x"), ("rest-call-js", False, 3, "rest:POST /wc/v3/orders/{*}"), ("rest-call-js", True, 4, "rest:DELETE /wp-json/x/v1/@@"),
            ("ajax-call-js", False, 5, ""), ("ajax-call-js", True, 5, "ajax:save_it"), ("ajax-call-js", True, 6, "ajax:go@@"), ("admin-page-nav", True, 7, "wp-admin-page:wc-x"), ("admin-page-nav", True, 7, "wp-frontend:login"),
            ("rest-call-js", True, 8, "rest:GET /wc/v3/x"), ("store-access", False, 9, ""), ("admin-page-nav", True, 9, "wp-admin-page:edit.php"), ("hook-listener", True, 9, "hook:zz"))
    ]),
    ("php_facts", ["symbol-def", "php-include", "test-def"], [("p@@/src/x.php", "php", None, PHP)], [
        ("p@@/src/x.php", k, r, a, b, key) for k, r, a, b, key in (
            ("php-include", True, 5, 5, "php-file:p@@/inc/a@@.php"), ("php-include", False, 6, 6, ""), ("symbol-def", True, 8, 18, "php-symbol:App\\Rest\\Ctl"), ("symbol-def", True, 12, 12, "php-symbol:App\\Rest\\Ctl::test_it"),
            ("test-def", True, 12, 12, "test:phpunit:p@@/src/x.php::App\\Rest\\Ctl::test_it"), ("symbol-def", True, 13, 17, "php-symbol:App\\Rest\\Ctl::register"), ("symbol-def", True, 19, 23, "php-symbol:App\\Rest\\boot"))
    ]),
    ("php_uses", ["symbol-use"], [("p@@/src/x.php", "php", None, PHP)], [
        ("p@@/src/x.php", "symbol-use", True, a, b, "php-symbol:" + key) for a, b, key in (
            (4, 4, "define"), (8, 18, "WP_UnitTestCase"), (8, 18, "App\\Rest\\Iface"), (8, 18, "Foo\\Bar::go"), (12, 12, "App\\Rest\\Ctl::prov"), (12, 12, "App\\Rest\\Ctl::helper"), (12, 12, "Baz\\Qux"), (12, 12, "Baz\\Qux::make"),
            (12, 12, "Foo\\Bar"), (14, 14, "register_rest_route"), (14, 14, "App\\Rest\\WP_REST_Server"), (15, 15, "App\\Rest\\Ctl::render"), (15, 15, "add_submenu_page"), (16, 16, "do_action"),
            (20, 20, "add_action"), (21, 21, "wp_enqueue_script"), (21, 21, "plugins_url"), (22, 22, "register_block_type_from_metadata"), (25, 25, "do_shortcode"))
    ]),
    ("php_patterns", ["hook-fire", "hook-listener", "rest-endpoint", "enqueue-script", "block-render", "admin-page-register", "shortcode"], [("p@@/src/x.php", "php", None, PHP)], [
        ("p@@/src/x.php", k, r, a, a, key) for k, r, a, key in (
            ("rest-endpoint", True, 14, "rest:POST /ns/v2/i@@/{*}"), ("rest-endpoint", True, 14, "rest:GET /ns/v2/i@@/{*}"), ("admin-page-register", True, 15, "wp-admin-page:my-slug"), ("hook-fire", False, 16, "hook:pre_{*}_app/v1"),
            ("hook-listener", True, 20, "hook:save_a"), ("hook-listener", True, 20, "hook:save_b"), ("enqueue-script", True, 21, "js-module:p@@/src/js/a.js script-handle:h"), ("block-render", True, 22, "block:core/latest-posts"),
            ("shortcode", True, 25, "shortcode:tag@@"))
    ]),
]


def _texts(spark, sf_dir, files):
    table = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(lang).alias("language"), F.lit(fw).cast("string").alias("framework"), F.lit(text).alias("text")) for p, lang, fw, text in files])
    rows = G.parts(spark, sf_dir, "p_partkey").select(F.col("p_partkey").cast("string").alias("k"), F.explode(table).alias("f"))
    own = lambda c: F.replace(F.col(f"f.{c}"), F.lit("@@"), F.col("k")).alias(c)
    return rows.select(own("path"), "f.language", "f.framework", own("text"))


def _raw(texts, kinds=None):
    """The facts of texts, or those of some kinds, kept: reading texts is what takes time, and what joins files reads the facts more than once."""
    return stage(B.raw_facts(texts, kinds=kinds), "raw-facts")


def _register(name, kinds, files, expected):
    def run(spark, sf_dir):
        texts = _texts(spark, sf_dir, files)
        raw = _raw(texts, kinds)
        specifiers = raw.select("path", F.get_json_object("payload", "$.specifier").alias("specifier")).filter("specifier is not null")
        rows = B.with_modules(raw, B.resolved_modules(specifiers, texts))
        keys = F.array_join(F.array_sort(F.transform("anchors", lambda a: a["key"])), " ")
        return rows.select("path", "kind", "resolved", "start_line", "end_line", keys.alias("keys"))

    def text(v):
        return "replace('" + v.replace("'", "''") + "', '@@', p_partkey::varchar)"

    rows = [f"select {text(p)} as path, '{k}' as kind, {str(r).lower()} as resolved, {a}::int as start_line, {b}::int as end_line, {text(key)} as keys from part" for p, k, r, a, b, key in expected]
    run.__name__, QUERIES[name], ORACLES[name] = name, run, " union all ".join(rows)


for _row in TABLE:
    _register(*_row)


@query("select 'p' || p_partkey || '/h.php' path, 1::int as n, 'save_' || p_partkey as action, 'cb' as callback from part union all select 'p' || p_partkey || '/h.php', 3, 'x', null from part")
def ajax_listeners(spark, sf_dir):
    """listeners of AJAX hooks; of others none."""
    php = "<?php add_action('wp_ajax_nopriv_save_@@', 'cb'); add_action('init', 'x'); add_filter('wp_ajax_x', $y);"
    rows = B.ajax_listeners(B.raw_facts(_texts(spark, sf_dir, [("p@@/h.php", "php", None, php)])))
    order = F.row_number().over(Window.partitionBy("path").orderBy("n"))
    return rows.select("path", (2 * order - 1).cast("int").alias("n"), F.get_json_object("payload", "$.action").alias("action"), F.get_json_object("payload", "$.callback").alias("callback"))


_CONST = "export const STORE = 'core/@@' as const; export let { x } = y\nconst own = 'no'; export { own as shown }\nexport const part = `a${x}`\n"
_ASKS = "import { STORE as S, part, gone } from './a'\nselect(S); doAction(S); dispatch(part); useDispatch(gone); apiFetch(S)\n"


@query("""select 'p' || p_partkey || '/b.ts' path, kind, resolved, replace(keys, '@@', p_partkey::varchar) as keys, replace(said, '@@', p_partkey::varchar) said from part,
(values ('store-access', true, 'wp-store:core/@@', 'core/@@'), ('hook-fire', true, 'hook:core/@@', 'core/@@'), ('store-access', false, '', null), ('store-access', false, '', null), ('rest-call-js', false, '', null)) t(kind, resolved, keys, said)""")
def imported_constants(spark, sf_dir):
    """A call's name is taken from the exported constant it imports; templates with expressions and names that are not there stay open."""
    texts = _texts(spark, sf_dir, [("p@@/a.ts", "ts", None, _CONST), ("p@@/b.ts", "ts", None, _ASKS)])
    raw = _raw(texts)
    specifiers = raw.select("path", F.get_json_object("payload", "$.specifier").alias("specifier")).filter("specifier is not null")
    rows = B.with_constants(raw, B.resolved_modules(specifiers, texts)).filter("kind in ('store-access', 'hook-fire', 'rest-call-js')")
    said = F.when(F.col("resolved"), F.coalesce(F.get_json_object("payload", "$.key"), F.get_json_object("payload", "$.hook")))
    return rows.select("path", "kind", "resolved", F.array_join(F.transform("anchors", lambda a: a["key"]), " ").alias("keys"), said.alias("said"))


_WRAPS = """<?php
namespace W;
function on_saved( $name, $cb ) { $full = 'saved_@@'; add_action( $name, $cb ); do_action( $full ); }
function later( $hook ) { add_action( 'init', function () use ( $hook ) { do_action( $hook ); } ); }
class Page { public function menu( $slug ) { add_menu_page( 't', 'm', 'c', $slug ); } public function all() { $this->menu( 'own_@@' ); } }
function plain() { do_action( 'plain_@@' ); }
"""
_CALLS = """<?php
on_saved( 'one_@@', 'f' ); later( "two_@@_$x" ); on_saved( $z, 'g' ); $page->menu( 'three' ); Other::menu( 'four' ); plain();
"""


@query("""select 'p' || p_partkey || case k when 1 then '/w.php' else '/c.php' end path, kind, resolved, replace(keys, '@@', p_partkey::varchar) as keys, wrapper from part,
(values (2, 'hook-listener', true, 'hook:one_@@', 'on_saved'), (2, 'hook-fire', false, 'hook:two_@@_{*}', 'later'), (2, 'hook-listener', false, '', 'on_saved'), (2, 'admin-page-register', true, 'wp-admin-page:three', 'menu'),
(1, 'admin-page-register', true, 'wp-admin-page:own_@@', 'menu'), (1, 'hook-fire', true, 'hook:plain_@@', null)) t(k, kind, resolved, keys, wrapper)""")
def php_wrappers(spark, sf_dir):
    """Functions that hand a parameter on, and what their calls make; within a wrapper patterns make nothing."""
    texts = _texts(spark, sf_dir, [("p@@/w.php", "php", None, _WRAPS), ("p@@/c.php", "php", None, _CALLS)])
    raw = _raw(texts)
    # each part's files are a project of its own here, so wrappers meet calls of their part
    own = raw.withColumn("payload", F.when(F.col("kind").isin(*B.WRAPPER_ROWS), F.regexp_replace("payload", '"(name|callee)": "', F.concat(F.lit('"$1": "'), F.regexp_extract("path", "^p[0-9]+", 0), F.lit("|")))).otherwise(F.col("payload")))
    rows = raw.unionByName(B.wrapped_calls(own, B.wrapper_index(own))).filter("kind in ('hook-listener', 'hook-fire', 'admin-page-register')")
    keys = F.array_join(F.array_sort(F.transform("anchors", lambda a: a["key"])), " ")
    return rows.select("path", "kind", "resolved", keys.alias("keys"), F.regexp_extract(F.get_json_object("payload", "$.meta.wrapperName"), r"[^|]*$", 0).alias("wrapper"))


_TEST = """import { run } from '../src/lib@@';
describe('g', () => { it('calls', () => { run() }) })
"""
_LIB = """import { add } from './util'
export function run() { wp.hooks.doAction('saved_@@'); return add(1) }
"""
_UTIL = "export const add = (x) => x + 1\n"
_HOOK = "<?php\nadd_action( 'saved_@@', 'App\\on_saved' );\n"


@query("""with c as (select p_partkey, 'jest:p' || p_partkey || '/tests/lib.test.ts::g > calls' test_id from part),
  v as (select *, 1 - (1 - 0.95) ** 5 * (1 - 0.9 * pow(0.92, 1)) a, 1 - (1 - 0.95) * (1 - 0.9 * pow(0.92, 2)) b, 0.8 * pow(0.92, 2) h from c)
select test_id, 'p' || p_partkey || '/src/lib' || p_partkey || '.ts' as source, round(a, 6) confidence, 'js-import,symbol-call' kinds from v
union all select test_id, 'p' || p_partkey || '/src/util.js', round(b, 6), 'js-import,symbol-call' from v
union all select test_id, 'p' || p_partkey || '/hooks.php', round(h, 6), 'hook-mediated' from v""")
def texts_to_edges(spark, sf_dir):
    """From texts to edges: a test calls a library, which imports another and fires a hook that PHP listens to.

    The library has five facts (its import, the function, two uses, the hook) and is called by name;
    what it imports has one fact that an import meets, and is called at depth 2, like the listener.
    """
    files = [("p@@/tests/lib.test.ts", "ts", "jest", _TEST), ("p@@/src/lib@@.ts", "ts", None, _LIB), ("p@@/src/util.js", "js", None, _UTIL), ("p@@/hooks.php", "php", None, _HOOK)]
    texts = _texts(spark, sf_dir, files).withColumn("framework_class", F.lit("unit")).withColumn("vendor", F.lit(False))
    g = B.graph(texts)
    edges = derive(g["files"].select("file_id", "path", "framework", "vendor"), g["facts"], g["links"], g["tests"])
    kinds = F.array_join(F.array_sort(F.transform("evidence", lambda e: e["kind"])), ",")
    return edges.select("test_id", "source", F.round("confidence", 6).alias("confidence"), kinds.alias("kinds"))


_OPEN = "<?php\n// @@\nfunction f( $a ) {\n\tdo_action( 'x_' . $a );\n}\n\ndo_action( $b );\nadd_action( 'known', 'g' );"


@query("""with l as (select p_partkey, string_split('<?php' || chr(10) || '// ' || p_partkey || chr(10) || 'function f( $a ) {' || chr(10) || chr(9) || 'do_action( ''x_'' . $a );' || chr(10) || '}' || chr(10) || chr(10) || 'do_action( $b );' || chr(10) || 'add_action( ''known'', ''g'' );', chr(10)) t from part),
u as (select * from l, (values (4, '''x_'' . $a', 'f'), (7, '$b', '(file)')) v(line, expression, scope)),
h as (select *, sha256(scope || chr(10) || 'hook=' || expression || chr(10)) expr_hash from u)
select 'p' || p_partkey || '/o.php' path, line::int as line, '## Unit ' || expr_hash || chr(10) || chr(10) || '- kind: hook-fire' || chr(10) || '- unresolved expression: `' || expression || '`' || chr(10) || '- enclosing scope: ' || scope || chr(10)
  || '- file: p' || p_partkey || '/o.php (lines 1-8)' || chr(10) || chr(10) || '```php' || chr(10) || array_to_string([i || ' | ' || t[i] for i in range(1, len(t) + 1)], chr(10)) || chr(10) || '```' as said from h""")
def unresolved_units(spark, sf_dir):
    """What is left unresolved, as texts with the source around it."""
    texts = _texts(spark, sf_dir, [("p@@/o.php", "php", None, _OPEN)])
    facts = _raw(texts, R.KINDS).select(F.col("n").alias("fact_id"), F.col("path").alias("file_id"), "kind", "resolved", "start_line", "end_line", "payload")
    rows = R.units(facts, texts.select(F.col("path").alias("file_id"), "path", "text"), spark.createDataFrame([("none",)], "expr_hash string"))
    lines = F.when(F.col("expression") == "$b", 7).otherwise(4)
    return rows.select("path", lines.cast("int").alias("line"), R.unit_text(rows).alias("said"))
