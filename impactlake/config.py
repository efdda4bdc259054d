"""Configuration: a checked table of settings, found by walking up from a folder.

A file is data (JSON or TOML), never code that runs.
"""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field
from typing import Any

from .extract.patterns import BIND_TYPES, NODE_KINDS, PHP_PATTERNS, TRANSFORMS, Bind, Pattern
from .functions.pricing import effective_stop_list
from .operators.match import CAP
from .operators.traverse import MAX_DEPTH

#: Names of configuration files, best first.
NAMES = ("impactlake.toml", "impactlake.json")
#: Kinds of facts that a pattern may emit (fixed values).
FACT_KINDS = (
    "symbol-def symbol-use import-edge php-include hook-listener hook-fire rest-endpoint rest-call-js ajax-listener ajax-call-js enqueue-script "
    "admin-page-nav admin-page-register store-register store-access script-localize script-localize-inline shortcode block-render test-def parse-error"
).split()
#: Folders and files that are not walked, by the switch that takes them in again (fixed values).
_FOLDERS = {
    None: "node_modules dist build .git", "agenticWorktrees": ".claude/worktrees .worktrees worktrees", "toolDirs": ".yarn/cache .yarn/releases .yarn/unplugged .yarn/sdks .bun .pnpm-store",
    "testArtifacts": "playwright-report test-results blob-report playwright/.cache cypress/videos cypress/screenshots cypress/downloads coverage .nyc_output",
    "buildCaches": ".next .nuxt .svelte-kit .turbo .parcel-cache .vercel .netlify .cache .angular", "minified": "",
}
_FILES = {"toolDirs": ".yarn/install-state.gz .yarn/build-state.yml .pnp.*", "minified": "*.min.js *.min.mjs *.min.cjs *.min.jsx *.min.ts *.min.tsx *.min.css"}


class ConfigError(ValueError):
    """What is wrong, each with the place of it."""


@dataclass(frozen=True)
class Config:
    jest: tuple[str, ...] = ("**/*.test.{ts,tsx,js,jsx}", "**/*.spec.{ts,tsx,js,jsx}")
    playwright: tuple[str, ...] = ()
    qunit: tuple[str, ...] = ()
    phpunit_bases: tuple[str, ...] = ("PHPUnit\\Framework\\TestCase",)
    classes: tuple[tuple[tuple[str, ...], str], ...] = ()
    default_class: str = "unit"
    stop_list: tuple[str, ...] = field(default_factory=lambda: tuple(effective_stop_list()))
    extractors: tuple[Pattern, ...] = ()
    wrappers: tuple[dict, ...] = ()
    threshold: float = 0.0
    max_depth: int = MAX_DEPTH
    cap: int = CAP
    output_folders: tuple[str, ...] = ("build", "dist")
    ignore: tuple[str, ...] = ()
    vendor: tuple[str, ...] = ("**/vendor", "**/vendor/**")
    symlink_targets: tuple[str, ...] = ()


def ignored_globs(extra: list[str] = (), switches: dict[str, bool] | None = None) -> tuple[str, ...]:
    out: list[str] = []
    for key, names in _FOLDERS.items():
        if key is None or (switches or {}).get(key, True):
            out += [g for n in names.split() for g in (f"**/{n}", f"**/{n}/**")]
            out += [f"**/{n}" for n in _FILES.get(key, "").split()]
    return (*out, *extra)


class _Reader:
    """Reads a table of settings, noting what is wrong or not known."""

    def __init__(self) -> None:
        self.wrong: list[str] = []

    def bad(self, at: str, what: str) -> None:
        self.wrong.append(f"{at}: {what}")

    def table(self, raw: Any, at: str, keys: tuple[str, ...] | None) -> dict:
        if raw is None:
            return {}
        if not isinstance(raw, dict):
            self.bad(at or "(root)", "expected a table")
            return {}
        for k in raw if keys is not None else ():
            if k not in keys:
                self.bad(f"{at}.{k}" if at else k, "unknown key")
        return raw

    def strings(self, raw: Any, at: str, default: tuple[str, ...]) -> tuple[str, ...]:
        if raw is None:
            return default
        if not isinstance(raw, list) or not all(isinstance(x, str) for x in raw):
            self.bad(at, "expected a list of strings")
            return default
        return tuple(raw)

    def number(self, raw: Any, at: str, default: float, least: float, most: float | None = None) -> float:
        if raw is None:
            return default
        if isinstance(raw, bool) or not isinstance(raw, int | float) or raw < least or (most is not None and raw > most):
            self.bad(at, f"must be a number of at least {least}" + (f" and at most {most}" if most is not None else ""))
            return default
        return raw

    def one_of(self, raw: Any, at: str, values, default: Any = None) -> Any:
        if raw is None and default is not None:
            return default
        if raw not in values:
            self.bad(at, f"expected one of {', '.join(map(str, values))}")
        return raw

    def pattern(self, raw: Any, at: str) -> Pattern | None:
        before = len(self.wrong)
        p = self.table(raw, at, ("match", "bind", "emit", "anchor", "transform"))
        m = self.table(p.get("match"), f"{at}.match", ("lang", "nodeKind", "name", "receiver"))
        lang, node = self.one_of(m.get("lang"), f"{at}.match.lang", ("php", "js", "ts")), self.one_of(m.get("nodeKind"), f"{at}.match.nodeKind", NODE_KINDS)
        if not isinstance(m.get("name"), str):
            self.bad(f"{at}.match.name", "expected a string")
        binds = {}
        for key, b in self.table(p.get("bind"), f"{at}.bind", None).items():
            here = f"{at}.bind.{key}"
            b = self.table(b, here, ("arg", "type", "default", "optional"))
            if isinstance(b.get("arg"), bool) or not isinstance(b.get("arg"), int) or b["arg"] < 0:
                self.bad(f"{here}.arg", "must be a non-negative integer")
            binds[key] = Bind(b.get("arg"), self.one_of(b.get("type"), f"{here}.type", BIND_TYPES), b.get("optional", False) is True, b.get("default"))
        anchor = self.table(p.get("anchor"), f"{at}.anchor", ("template", "role"))
        role = self.one_of(anchor.get("role"), f"{at}.anchor.role", ("subject", "target", "callback", "module")) if anchor else "target"
        emit = self.one_of(p.get("emit"), f"{at}.emit", FACT_KINDS)
        transform = self.one_of(p["transform"], f"{at}.transform", TRANSFORMS) if p.get("transform") is not None else None
        return Pattern(lang, node, m.get("name"), emit, binds, m.get("receiver"), anchor.get("template"), role, transform) if len(self.wrong) == before else None

    def wrapper(self, raw: Any, at: str) -> dict:
        w = self.table(raw, at, None)
        if not isinstance(w.get("name"), str):
            self.bad(f"{at}.name", "expected a string")
        if w.get("wraps") not in {p.name for p in PHP_PATTERNS}:
            self.bad(f"{at}.wraps", "is not the name of a known pattern")
        if not isinstance(w.get("argSpecs"), list):
            self.bad(f"{at}.argSpecs", "expected a list")
            return w
        needs = {"fixed": ("value",), "param": ("wrapperParamIdx",), "merge": ("defaults", "callerParamIdx"), "unresolved": ()}
        for i, spec in enumerate(w["argSpecs"]):
            here = f"{at}.argSpecs.{i}"
            kind = spec.get("kind") if isinstance(spec, dict) else None
            if self.one_of(kind, f"{here}.kind", tuple(needs)) in needs:
                for key in needs[kind]:
                    if key not in spec or (key.endswith("Idx") and not isinstance(spec[key], int)) or (key == "defaults" and not isinstance(spec[key], dict)):
                        self.bad(f"{here}.{key}", "missing or of a wrong type")
        return w


def parse_config(raw: Any) -> Config:
    """The settings of a table; ConfigError names every wrong or unknown key."""
    r = _Reader()
    top = r.table(raw, "", ("tests", "hooks", "extractors", "confidence", "traversal", "concurrency", "build", "ignore", "ignoreDefaults", "vendor", "allowSymlinkTargets", "wpPatternWrappers"))
    tests = r.table(top.get("tests"), "tests", ("phpunit", "jest", "playwright", "qunit", "classes", "defaultClass"))
    globs = {f: r.strings(r.table(tests.get(f), f"tests.{f}", ("fileGlobs",)).get("fileGlobs"), f"tests.{f}.fileGlobs", getattr(Config(), f)) for f in ("jest", "playwright", "qunit")}
    bases = r.strings(r.table(tests.get("phpunit"), "tests.phpunit", ("baseClasses", "methodPatterns")).get("baseClasses"), "tests.phpunit.baseClasses", Config().phpunit_bases)
    rules = []
    for i, c in enumerate(tests.get("classes") or ()):
        c = r.table(c, f"tests.classes.{i}", ("paths", "phpunitBaseClasses", "class"))
        rules.append((r.strings(c.get("paths"), f"tests.classes.{i}.paths", ()), r.one_of(c.get("class"), f"tests.classes.{i}.class", ("unit", "e2e"))))
    stop = r.table(r.table(top.get("hooks"), "hooks", ("stopList",)).get("stopList"), "hooks.stopList", ("add", "remove"))
    walk = r.table(top.get("traversal"), "traversal", ("maxDepth", "maxMillisPerTest", "maxWildcardMatchesPerAnchor"))
    r.number(walk.get("maxMillisPerTest"), "traversal.maxMillisPerTest", 5000, 0)
    for key, value in r.table(top.get("concurrency"), "concurrency", ("phpWorkers", "tsWorkers", "deriveWorkers")).items():
        r.number(value, f"concurrency.{key}", 0, 0)
    sure = r.table(top.get("confidence"), "confidence", ("weights", "threshold"))
    switches = r.table(top.get("ignoreDefaults"), "ignoreDefaults", tuple(k for k in _FOLDERS if k))
    for key, value in switches.items():
        if not isinstance(value, bool):
            r.bad(f"ignoreDefaults.{key}", "expected true or false")
    made = Config(
        **globs, phpunit_bases=bases, classes=tuple(rules), default_class=r.one_of(tests.get("defaultClass"), "tests.defaultClass", ("unit", "e2e"), "unit"),
        stop_list=tuple(effective_stop_list(list(r.strings(stop.get("add"), "hooks.stopList.add", ())), list(r.strings(stop.get("remove"), "hooks.stopList.remove", ())))),
        extractors=tuple(x for i, p in enumerate(top.get("extractors") or ()) if (x := r.pattern(p, f"extractors.{i}"))),
        wrappers=tuple(r.wrapper(w, f"wpPatternWrappers.{i}") for i, w in enumerate(top.get("wpPatternWrappers") or ())),
        threshold=r.number(sure.get("threshold"), "confidence.threshold", 0.0, 0, 1), max_depth=int(r.number(walk.get("maxDepth"), "traversal.maxDepth", MAX_DEPTH, 0)),
        cap=int(r.number(walk.get("maxWildcardMatchesPerAnchor"), "traversal.maxWildcardMatchesPerAnchor", CAP, 1)),
        output_folders=r.strings(r.table(top.get("build"), "build", ("outputDirs",)).get("outputDirs"), "build.outputDirs", ("build", "dist")),
        ignore=ignored_globs(list(r.strings(top.get("ignore"), "ignore", ())), switches), vendor=r.strings(top.get("vendor"), "vendor", Config().vendor),
        symlink_targets=r.strings(top.get("allowSymlinkTargets"), "allowSymlinkTargets", ()),
    )
    if r.wrong:
        raise ConfigError("; ".join(r.wrong))
    return made


def find_config(start: str) -> tuple[str, str]:
    """(project root, configuration file): the first folder from ``start`` upwards that has one."""
    folder = os.path.abspath(start)
    while True:
        for name in NAMES:
            if os.path.isfile(path := os.path.join(folder, name)):
                return folder, path
        above = os.path.dirname(folder)
        if above == folder:
            raise ConfigError(f"no {' or '.join(NAMES)} in {start} or above it")
        folder = above


def load_config(path: str) -> Config:
    with open(path, "rb") as f:
        try:
            raw = tomllib.load(f) if path.endswith(".toml") else json.load(f)
        except ValueError as e:
            raise ConfigError(f"{path}: {e}") from e
    return parse_config(raw)


def compiler_options(configs: dict[str, dict], named: set[str] | None = None) -> dict[str, list[tuple[str, list[str]]]]:
    """Aliases of modules by folder, from the texts of tsconfig and jsconfig files by path.

    ``extends`` takes over what a file does not say itself; targets are below ``baseUrl`` (or
    the folder of the file that lists them) and relative to the root.  A circle ends.  ``named``:
    the files that say something of their folders; others are only extended.
    """
    import posixpath

    def options(path: str, seen: tuple[str, ...] = ()) -> dict:
        own = configs.get(path) or {}
        said, folder = own.get("compilerOptions") or {}, posixpath.dirname(path)
        out: dict = {}
        parents = own.get("extends") or []
        for parent in [parents] if isinstance(parents, str) else parents:
            base = posixpath.normpath(posixpath.join(folder, parent if parent.endswith(".json") else parent + ".json"))
            if base not in (*seen, path):
                out |= options(base, (*seen, path))
        if "baseUrl" in said:
            out["base"] = posixpath.normpath(posixpath.join(folder, said["baseUrl"]))
        if "paths" in said:
            out["paths"], out["paths_at"] = said["paths"], folder
        return out

    made = {}
    for path in configs if named is None else sorted(named):
        o = options(path)
        base = o.get("base", o.get("paths_at", posixpath.dirname(path)))
        aliases = [(p, [posixpath.normpath(posixpath.join(base, t)) for t in targets]) for p, targets in (o.get("paths") or {}).items()]
        if "base" in o:
            aliases.append(("*", [posixpath.normpath(posixpath.join(base, "*"))]))
        # an exact pattern first, then the one with the longest start
        made[posixpath.dirname(path)] = sorted(aliases, key=lambda a: ("*" in a[0], -len(a[0].partition("*")[0])))
    return made
