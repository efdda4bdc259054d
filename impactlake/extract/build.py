"""From source texts to the tables that the walk reads: extraction, modules, derived facts, ids.

Files are read one at a time in Python workers, a batch of rows after the other; what joins
files (modules, uses of imported names, live symbols) is joined here.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_asset, is_node_builtin, normalise_path
from ..operators.stages import stage
from ..operators.store import last_of, numbered
from .patterns import PHP_PATTERNS, SCRIPT_PATTERNS, Matcher, Pattern
from .php import TEST_BASES, Php, wrapped_fact
from .script import Fact, Script
from .tokens import LexError

RAW = "path string, n int, kind string, resolved boolean, start_line int, end_line int, anchors array<struct<key:string,role:string>>, payload string"
_ARROW = pa.schema([
    ("path", pa.string()), ("n", pa.int32()), ("kind", pa.string()), ("resolved", pa.bool_()), ("start_line", pa.int32()), ("end_line", pa.int32()),
    ("anchors", pa.list_(pa.struct([("key", pa.string()), ("role", pa.string())]))), ("payload", pa.string()),
])


def facts_of(path: str, text: str, language: str, framework: str | None, patterns: list[Pattern], test_bases: tuple[str, ...] = TEST_BASES) -> list[Fact]:
    """All facts of one file; of a text that is no script, one of kind parse-error."""
    try:
        if language == "php":
            return Php(text, path, patterns, test_bases).facts()
        script = Script(text, path, language)
        matcher = Matcher(script, patterns)
        return [*script.facts(framework), *matcher.facts(), *matcher.constants()]
    except (LexError, IndexError, KeyError) as e:
        line = text.count("\n", 0, getattr(e, "at", 0)) + 1
        return [Fact("parse-error", line, line, [], {"message": str(e) or "unexpected end", "line": line}, False)]


#: Facts that go to Spark at a time.
FACTS = 1000


def _rows(patterns: list[Pattern], test_bases: tuple[str, ...], kinds: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["text"] is not None and row["language"] is not None:
                    for n, f in enumerate(facts_of(row["path"], row["text"], row["language"], row["framework"], patterns, test_bases)):
                        if kinds is None or f.kind in kinds:
                            rows.append((row["path"], n, f.kind, f.resolved, f.start_line, f.end_line, [{"key": k, "role": r} for k, r in f.anchors], json.dumps(f.payload, ensure_ascii=False)))
                if len(rows) >= FACTS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def raw_facts(files: DataFrame, extra: list[Pattern] = (), test_bases: tuple[str, ...] = TEST_BASES, kinds: list[str] | None = None) -> DataFrame:
    """The facts (RAW) of files (path, text, language, framework); null texts and languages have none.

    ``extra``: patterns of the project, after the built-in ones.  ``kinds``: the facts that leave
    the workers, where not all are asked for; their numbers count all facts of the file.
    """
    patterns = [*SCRIPT_PATTERNS, *PHP_PATTERNS, *extra]
    return files.select("path", "text", "language", "framework").mapInArrow(_rows(patterns, tuple(test_bases), None if kinds is None else frozenset(kinds)), RAW)


#: Endings that are tried for a module in the order of a compiler: TypeScript first, files before folders (fixed values).
TYPED_ENDINGS = [".ts", ".tsx", "/index.ts", "/index.tsx"]
PLAIN_ENDINGS = [".js", ".jsx", "", "/index.js", "/index.jsx"]


Aliases = list[tuple[str, list[str]]]


def module_candidates(path: Column, specifier: Column, aliases: Aliases | dict[str, Aliases] = ()) -> Column:
    """array<string> of the files that a specifier may name in a file, best first.

    ``aliases``: (pattern with at most one ``*``, targets below the root), the first whose
    pattern fits counts; or such lists by folder, of which the nearest above a file counts.
    Specifiers of packages name none.
    """
    if isinstance(aliases, dict):
        out = module_candidates(path, specifier, aliases.get("", ()))
        for folder in sorted((f for f in aliases if f), key=len):
            out = F.when(path.startswith(folder + "/"), module_candidates(path, specifier, aliases[folder])).otherwise(out)
        return out
    folder = F.regexp_replace(path, r"[^/]*$", "")
    own = F.when(specifier.rlike(r"^\.\.?(?:/|$)"), F.array(normalise_path(F.concat(folder, specifier))))
    fits = F.lit(None).cast("array<string>")
    for pattern, targets in reversed(list(aliases)):
        head, star, tail = pattern.partition("*")
        middle = F.substring(specifier, len(head) + 1, 1 << 20) if not tail else F.expr("null")
        if tail:
            middle = F.substr(specifier, F.lit(len(head) + 1), F.length(specifier) - len(head) - len(tail))
        hit = (specifier == pattern) if not star else specifier.startswith(head) & specifier.endswith(tail) & (F.length(specifier) >= len(head) + len(tail))
        made = [normalise_path(F.concat(F.lit(t.partition("*")[0]), middle if "*" in t else F.lit(""), F.lit(t.partition("*")[2]))) for t in targets]
        fits = F.when(hit, F.array(*made)).otherwise(fits)
    bases = F.coalesce(own, fits, F.array().cast("array<string>"))
    ends = lambda b, some: F.array(*[F.concat(b, F.lit(e)) for e in some])
    bare = lambda b: F.regexp_replace(b, r"\.(m|c)?jsx?$", "")
    typed = lambda b: F.when(bare(b) != b, F.concat(ends(b, TYPED_ENDINGS), ends(bare(b), [".ts", ".tsx"]))).otherwise(ends(b, TYPED_ENDINGS))
    return F.flatten(F.transform(bases, lambda b: F.concat(typed(b), ends(b, PLAIN_ENDINGS))))


def resolved_modules(specifiers: DataFrame, files: DataFrame, aliases: Aliases | dict[str, Aliases] = ()) -> DataFrame:
    """(path, specifier, resolved_path, builtin, asset) of (path, specifier): the first candidate that is a file, or null."""
    s = F.col("specifier")
    flagged = specifiers.select("path", "specifier").distinct().withColumn("builtin", is_node_builtin(s)).withColumn("asset", ~F.col("builtin") & is_asset(s))
    tried = flagged.filter("not builtin and not asset").select("path", "specifier", F.posexplode(module_candidates(F.col("path"), s, aliases)).alias("n", "candidate"))
    found = tried.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("path", "specifier").agg(F.min_by("candidate", "n").alias("resolved_path"))
    return flagged.join(found, ["path", "specifier"], "left")


def with_modules(raw: DataFrame, modules: DataFrame) -> DataFrame:
    """RAW facts with ``resolved_path`` and anchors of files: imports and uses of imported names.

    A use of a name that no file of the project gives is dropped; of equal uses in a file the first stays.
    """
    # few payloads are worth parsing
    said = F.when(F.contains("payload", F.lit('"specifier"')), F.get_json_object("payload", "$.specifier"))
    use = F.col("kind") == "symbol-use"
    own_use = F.coalesce(use & F.get("anchors", F.lit(0))["key"].startswith("js-symbol:"), F.lit(False))
    every = raw.withColumn("specifier", said)
    # what names no file and repeats nothing stays where it is
    alone = every.filter(F.col("specifier").isNull() & ~own_use).withColumns({"resolved_path": F.lit(None).cast("string"), "builtin": F.lit(None).cast("boolean"), "asset": F.lit(None).cast("boolean")})
    rows = every.filter(F.col("specifier").isNotNull() | own_use).join(modules, ["path", "specifier"], "left")
    use = use & F.col("specifier").isNotNull()
    rows = rows.filter(~use | F.col("resolved_path").isNotNull())
    key = F.concat(F.lit("js-symbol:"), F.col("resolved_path"), F.lit(":"), F.get_json_object("payload", "$.name"))
    anchor = lambda k, role: F.array(F.struct(k.alias("key"), F.lit(role).alias("role")))
    module = F.concat(F.lit("js-module:"), F.coalesce("resolved_path", "specifier"))
    edge = (F.col("kind") == "import-edge") & F.col("specifier").isNotNull()
    anchors = F.when(use, anchor(key, "target")).when(edge, anchor(module, "module")).otherwise(F.col("anchors"))
    known = F.when(use, True).when(edge, F.col("builtin") | F.col("asset") | F.col("resolved_path").isNotNull()).otherwise(F.col("resolved"))
    rows = rows.withColumn("anchors", anchors).withColumn("resolved", known)
    target = F.when((F.col("kind") == "symbol-use") & F.get("anchors", F.lit(0))["key"].startswith("js-symbol:"), F.get("anchors", F.lit(0))["key"])
    first = F.min("n").over(Window.partitionBy("path", "__use"))
    kept = rows.withColumn("__use", target).withColumn("__first", first).filter("__use is null or n = __first")
    columns = ["path", "n", "kind", "resolved", "start_line", "end_line", "anchors", "payload", "specifier", "resolved_path", "builtin", "asset"]
    return kept.select(columns).unionByName(alone.select(columns))


def _synthesized(patterns: list[Pattern]):
    known: dict[str, list[Pattern]] = {}
    for p in patterns:
        if p.lang == "php" and p.node == "function-call":
            known.setdefault(p.name, []).append(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                call, wrapper = json.loads(row["call"]), json.loads(row["wrapper"])
                for p in known.get(wrapper["wraps"], ()):
                    fact = wrapped_fact(p, wrapper["argSpecs"], call, call["callee"], (row["start_line"], row["end_line"]))
                    if fact is not None:
                        rows.append((row["path"], row["n"], fact.kind, fact.resolved, fact.start_line, fact.end_line, [{"key": k, "role": r} for k, r in fact.anchors], json.dumps(fact.payload, ensure_ascii=False)))
            if rows:
                yield _batch(rows)

    return run


#: Rows that only other rows are made of.
WRAPPER_ROWS = ("wrapper-def", "wrapper-call", "script-constant")


def with_constants(raw: DataFrame, modules: DataFrame) -> DataFrame:
    """RAW facts in which a call's one missing name is taken from the exported constant that it imports."""
    field = lambda c: F.get_json_object("payload", f"$.{c}")
    constants = raw.filter("kind = 'script-constant'").select(F.col("path").alias("resolved_path"), field("name").alias("name"), field("value").alias("value"))
    wanted = F.from_json(field("imported"), "struct<field:string,specifier:string,name:string,template:string,role:string>")
    asks = raw.filter(field("imported").isNotNull()).select("path", "n", wanted.alias("w"))
    found = asks.withColumn("specifier", F.col("w.specifier")).join(modules.select("path", "specifier", "resolved_path"), ["path", "specifier"]).withColumn("name", F.col("w.name")).join(constants, ["resolved_path", "name"])
    found = found.groupBy("path", "n").agg(F.min(F.struct("value", "w")).alias("got"))
    rows = raw.join(found, ["path", "n"], "left")
    got, held = F.col("got.value"), F.col("got").isNotNull()
    key = F.replace(F.col("got.w.template"), F.concat(F.lit("{"), F.col("got.w.field"), F.lit("}")), got)
    plain = F.map_filter(F.from_json("payload", "map<string,string>"), lambda k, v: ~k.isin("unresolved", "imported"))
    payload = F.to_json(F.map_concat(plain, F.create_map(F.col("got.w.field"), got)))
    return rows.select(
        "path", "n", "kind", (F.col("resolved") | held).alias("resolved"), "start_line", "end_line",
        F.when(held, F.array(F.struct(key.alias("key"), F.col("got.w.role").alias("role")))).otherwise(F.col("anchors")).alias("anchors"), F.when(held, payload).otherwise(F.col("payload")).alias("payload"),
    )


def wrapper_index(raw: DataFrame, configured: list[dict] = ()) -> DataFrame:
    """(name, class, source, wrapper) of all wrappers that were found, and of those configured, which come in place of found ones of their name."""
    found = raw.filter("kind = 'wrapper-def'").select(*[F.get_json_object("payload", f"$.{c}").alias(c) for c in ("name", "class", "source")], F.col("payload").alias("wrapper")).distinct()
    own = [(w["name"], None, "config", json.dumps({"wraps": w["wraps"], "argSpecs": w["argSpecs"]})) for w in configured]
    listed = raw.sparkSession.createDataFrame(own, "name string, class string, source string, wrapper string")
    return found.join(listed.select("name"), "name", "left_anti").unionByName(listed)


def wrapped_calls(raw: DataFrame, wrappers: DataFrame, extra: list[Pattern] = ()) -> DataFrame:
    """RAW facts of calls of wrappers: functions by name, methods of ``$this`` and of a named class by class, others by name alone."""
    field = lambda c: F.get_json_object("payload", f"$.{c}")
    calls = raw.filter("kind = 'wrapper-call'").select("path", "n", "start_line", "end_line", field("callee").alias("name"), field("shape").alias("shape"), field("class").alias("of"), F.col("payload").alias("call"))
    met = calls.join(wrappers, "name").filter("(shape = 'function') = (class is null) and (shape in ('function', 'method-instance') or of is null or of = class)")
    rows = met.select("path", (F.col("n") + 2_000_000).alias("n"), "start_line", "end_line", "call", "wrapper")
    return rows.mapInArrow(_synthesized([*PHP_PATTERNS, *extra]), RAW)


def ajax_listeners(raw: DataFrame) -> DataFrame:
    """RAW facts of the listeners that hooks ``wp_ajax_...`` and ``wp_ajax_nopriv_...`` stand for."""
    hook = F.get_json_object("payload", "$.hook")
    action = F.regexp_extract(hook, r"^wp_ajax_(?:nopriv_)?(.+)$", 1)
    rows = raw.filter((F.col("kind") == "hook-listener") & hook.rlike(r"^wp_ajax_(?:nopriv_)?.+$")).withColumn("action", action)
    key = F.array(F.struct(F.concat(F.lit("ajax:"), "action").alias("key"), F.lit("subject").alias("role")))
    payload = F.to_json(F.struct(F.col("action"), F.get_json_object("payload", "$.callback").alias("callback")))
    # after the facts of the file
    return rows.select("path", (F.col("n") + 1_000_000).alias("n"), F.lit("ajax-listener").alias("kind"), "resolved", "start_line", "end_line", key.alias("anchors"), payload.alias("payload"))


_PAYLOAD = "name string, type_only boolean, mocked boolean, dynamic boolean, hook string, target string, framework string, testId string, meta struct<callable:boolean,resolvedBy:string,scopeRanges:array<struct<startLine:int,endLine:int>>>"


def graph(files: DataFrame, aliases: Aliases | dict[str, Aliases] = (), extra: list[Pattern] = (), test_bases: tuple[str, ...] = TEST_BASES, wrappers: list[dict] = ()) -> dict[str, DataFrame]:
    """The tables files, facts, links and tests of files (path, text, language, framework, framework_class, vendor).

    Ids are numbers in the order of paths and of facts in a file.  Of tests with the same id
    the last counts.  A file that cannot be read has the one fact of its error.
    """
    listed = stage(numbered(files.select("path", "language", "framework", "framework_class", "vendor", F.sha1("text").alias("content_hash")), ["path"], "file_id"), "files")
    raw = stage(raw_facts(files, extra, test_bases), "raw-facts")
    modules = stage(resolved_modules(raw.select("path", F.get_json_object("payload", "$.specifier").alias("specifier")).filter("specifier is not null"), files, aliases), "modules")
    calls = wrapped_calls(raw, wrapper_index(raw, wrappers), extra)
    raw = with_constants(raw, modules).filter(~F.col("kind").isin(*WRAPPER_ROWS)).unionByName(calls)
    raw = raw.unionByName(ajax_listeners(raw))
    placed = numbered(with_modules(raw, modules), ["path", "n"], "fact_id")
    placed = stage(placed.join(listed.select("path", "file_id"), "path"), "facts")
    p = F.from_json("payload", _PAYLOAD)
    scopes = F.transform(p["meta"]["scopeRanges"], lambda r: F.struct(r["startLine"].alias("start_line"), r["endLine"].alias("end_line")))
    flag = lambda c: F.coalesce(c, F.lit(False))
    facts = placed.select(
        "fact_id", "file_id", "kind", "resolved", "start_line", "end_line", p["name"].alias("name"), flag(p["meta"]["callable"]).alias("callable"), "resolved_path",
        flag(p["type_only"]).alias("type_only"), flag(p["mocked"]).alias("mocked"), flag(p["dynamic"]).alias("dynamic"), p["hook"].alias("hook"), p["target"].alias("target"), p["meta"]["resolvedBy"].alias("resolved_by"), scopes.alias("scopes"), "payload",
    )
    links = placed.select("fact_id", F.explode("anchors").alias("a")).select("fact_id", "a.key", "a.role").distinct()
    tests = placed.filter("kind = 'test-def'").select(p["testId"].alias("test_id"), "file_id", p["framework"].alias("framework"), "fact_id", F.col("fact_id").alias("ord"))
    tests = last_of(tests, ["test_id"]).join(listed.select("file_id", F.coalesce("framework_class", F.lit("unit")).alias("framework_class")), "file_id")
    return {"files": listed, "facts": facts, "links": links, "tests": tests.select("test_id", "file_id", "framework", "framework_class", "fact_id")}
