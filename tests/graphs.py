"""Small graphs as rows, and a plain queue that walks them one test at a time."""

from __future__ import annotations

import re
from collections import deque

FILE = "file_id long, path string, framework string, vendor boolean"
FACT = (
    "fact_id long, file_id long, kind string, resolved boolean, start_line int, end_line int, name string, callable boolean, resolved_path string, "
    "type_only boolean, mocked boolean, dynamic boolean, hook string, target string, resolved_by string, scopes array<struct<start_line:int,end_line:int>>"
)
LINK = "fact_id long, key string, role string"
TEST = "test_id string, file_id long, framework string, fact_id long"
FIELDS = [c.split()[0] for c in re.split(r", (?![^<]*>)", FACT)]


def fact(fact_id, file_id, kind, line=1, end=None, **more):
    row = dict.fromkeys(FIELDS) | {"fact_id": fact_id, "file_id": file_id, "kind": kind, "resolved": True, "start_line": line, "end_line": end or line} | more
    return row


def frames(spark, g):
    rows = [tuple(f[c] for c in FIELDS) for f in g["facts"]]
    return (
        spark.createDataFrame(g["files"], FILE), spark.createDataFrame(rows, FACT),
        spark.createDataFrame(g["links"], LINK), spark.createDataFrame(g["tests"], TEST),
    )


BASE = {
    "symbol-call": 0.9, "symbol-call-uncertain": 0.5, "php-include": 0.95, "js-import": 0.95, "hook-mediated": 0.8, "hook-mediated-uncertain": 0.4, "rest-mediated": 0.85,
    "rest-mediated-partial": 0.5, "enqueue-mediated": 0.7, "enqueue-mediated-sibling-fallback-partial": 0.7, "ajax-mediated": 0.85, "ajax-mediated-partial": 0.4,
    "rest-mediated-broad-fallback-partial": 0.85, "rest-mediated-broad-fallback-unresolved-partial": 0.5,
}
PRECISION = {"exact": 1.0, "prefixed": 0.6, "broad": 0.25}


def price(kind, precision, depth, bridge):
    return BASE[kind] * PRECISION[precision] * (max(0.3, 0.92**depth) if bridge else 1)


def rx(key):
    return re.compile("^" + re.escape(key).replace(r"\{\*\}", r"[^\s]+") + "$")


def breadth(key):
    body = key.split(":", 1)[1].split(" ", 1)[-1]
    return "broad" if all(s == "{*}" for s in body.split("/") if s) else "prefixed"


def partners(g, key, role, cap=32):
    want = {"target": "subject", "subject": "target"}.get(role, role)
    index = {}
    for f, k, r in g["links"]:
        if r == want:
            index.setdefault(k, []).append(f)
    for v in index.values():
        v.sort()
    literal, wild = {k: v for k, v in index.items() if "{*}" not in k}, {k: v for k, v in sorted(index.items()) if "{*}" in k}
    length = lambda k: len(k.replace("{*}", ""))
    if "{*}" not in key:
        met = [k for k in wild if rx(k).match(key)]
        if key.startswith("rest:") and met:
            met = [k for k in met if length(k) == max(map(length, met))]
        return [(f, "exact") for f in literal.get(key, [])] + [(f, breadth(k)) for k in met for f in wild[k]][:cap]
    if key in wild:
        return [(f, "exact") for f in wild[key]]
    if key.startswith("rest:"):
        met = [k for k in wild if rx(k).match(key) or rx(key).match(k)]
        if met:
            return [(f, breadth(k)) for k in met if length(k) == max(map(length, met)) for f in wild[k]][:cap]
    return [(f, breadth(key)) for k in sorted(literal) if rx(key).match(k) for f in literal[k]][:cap]


def walk(g, test, stop=(), max_depth=100):
    """{source path: (confidence, kinds)} of one test."""
    files = {f[0]: f for f in g["files"]}
    by_path = {f[1]: f[0] for f in g["files"]}
    facts = {f["fact_id"]: f for f in sorted(g["facts"], key=lambda f: f["fact_id"])}
    of_file = {}
    for f in facts.values():
        of_file.setdefault(f["file_id"], []).append(f)
    links = {}
    for f, k, r in sorted(g["links"], key=lambda x: (x[0], x[1], x[2])):
        links.setdefault(f, []).append((k, r))
    _, test_file, framework, test_fact = test
    if test_fact not in facts:
        return {}
    holds = lambda a, b: b["start_line"] >= a["start_line"] and b["end_line"] <= a["end_line"]
    is_call = lambda f: f["kind"] == "symbol-def" and bool(f["callable"])
    source = lambda i: files[i][2] is None and not files[i][3]
    own, t = of_file[test_file], facts[test_fact]
    if framework == "phpunit":
        calls = [f for f in own if is_call(f)]
        chosen = next((c for c in calls if c["start_line"] <= t["start_line"] <= c["end_line"]), None)
        good = [c for c in calls if c is chosen or (c["name"] or "").split("::")[-1] in ("setUp", "tearDown")]
        seeds = []
        for f in own:
            owner = f if is_call(f) else next((c for c in calls if c is not f and holds(c, f)), None)
            if owner is None or owner in good:
                seeds.append(f)
    elif framework:
        scope = lambda f: [tuple(s) for s in f["scopes"] or []]
        every = {s for f in own if f["kind"] == "test-def" for s in scope(f)}
        seeds = [f for f in own if not any(s["kind"] == "test-def" and s is not t and holds(s, f) for s in own) and all(not (f["start_line"] >= a and f["end_line"] <= b) or (a, b) in scope(t) for a, b in every)]
    else:
        seeds = own
    mocked = {f["resolved_path"] for f in own if f["kind"] == "import-edge" and f["mocked"]}
    queue = deque((f, 0, None, "exact", False, False) for f in seeds)
    seen, found = {f["fact_id"] for f in seeds}, {}

    def record(file_id, kind, dest, c):
        if file_id != test_file and source(file_id):
            found.setdefault(file_id, {}).setdefault((kind, dest), c)

    def push(f, depth, kind=None, precision="exact", bridge=False, sibling=False):
        if f["fact_id"] not in seen:
            seen.add(f["fact_id"])
            queue.append((f, depth, kind, precision, bridge, sibling))

    while queue:
        f, depth, kind, precision, bridge, sibling = queue.popleft()
        if depth > max_depth:
            continue
        if kind:
            record(f["file_id"], kind, f["fact_id"], price(kind, precision, depth, bridge))
        if is_call(f):
            for x in of_file[f["file_id"]]:
                if x is not f and holds(f, x):
                    push(x, depth)
        if f["kind"] == "import-edge":
            if not (f["type_only"] or f["mocked"] or (f["dynamic"] and f["file_id"] != test_file)) and f["resolved_path"] not in mocked and f["resolved_path"] in by_path:
                for x in of_file.get(by_path[f["resolved_path"]], []):
                    push(x, depth + 1, "js-import")
            continue
        if f["kind"] == "php-include":
            path = next((k[9:] for k, r in links.get(f["fact_id"], []) if r == "target" and k.startswith("php-file:")), f["target"])
            if path in by_path:
                there = of_file.get(by_path[path], [])
                record(by_path[path], "php-include", there[0]["fact_id"] if there else f["fact_id"], price("php-include", "exact", depth + 1, False))
                for x in there:
                    if not is_call(x) and not any(is_call(c) and holds(c, x) for c in there):
                        push(x, depth + 1)
            continue
        if f["kind"] == "enqueue-script":
            for k, r in links.get(f["fact_id"], []):
                if r == "target" and k.startswith("js-module:") and k[10:] in by_path:
                    for x in of_file.get(by_path[k[10:]], []):
                        push(x, depth + 1, "enqueue-mediated-sibling-fallback-partial" if sibling else "enqueue-mediated", "exact", True)
            continue
        if f["kind"] == "symbol-use" and any(k.startswith(f"js-symbol:{m}:") for m in mocked for k, _ in links.get(f["fact_id"], [])):
            continue
        names = {"symbol-use": ("symbol-call", "symbol-call-uncertain"), "hook-fire": ("hook-mediated", "hook-mediated-uncertain"), "rest-call-js": ("rest-mediated", "rest-mediated-partial"), "ajax-call-js": ("ajax-mediated", "ajax-mediated-partial")}
        if f["kind"] not in names or (f["kind"] == "hook-fire" and (f["hook"] is None or f["hook"] in stop or not re.search("[A-Za-z0-9]", f["hook"].replace("{*}", "")))):
            continue
        start = names[f["kind"]][0 if f["resolved"] else 1]
        for key, role in links.get(f["fact_id"], []):
            for p, how in partners(g, key, role):
                x = facts[p]
                kind = start
                if start == "hook-mediated" and x["kind"] == "hook-listener" and any(is_call(c) and holds(c, x) for c in of_file[x["file_id"]]):
                    kind = "hook-mediated-uncertain"
                elif how == "broad" and start.startswith("rest-"):
                    kind = "rest-mediated-broad-fallback-partial" if start == "rest-mediated" else "rest-mediated-broad-fallback-unresolved-partial"
                record(x["file_id"], kind, p, price(kind, how, depth + 1, True))
                for y in of_file[x["file_id"]]:
                    if y["kind"] == "enqueue-script":
                        push(y, depth + 1, sibling=True)
                if x["kind"] == "admin-page-register":
                    for y in of_file[x["file_id"]]:
                        if y["kind"] == "symbol-use" and y["start_line"] == x["start_line"]:
                            push(y, depth + 1)
                push(x, depth + 1, kind, how, True)
    out = {}
    for i, values in found.items():
        rest = 1.0
        for c in values.values():
            rest *= 1 - c
        out[files[i][1]] = (1 - rest, sorted({k for k, _ in values}))
    return out


def random_graph(r, base):
    """A graph whose ids start at ``base`` and whose paths and keys are its own."""
    g = {"files": [], "facts": [], "links": [], "tests": []}
    n = r.randint(4, 9)
    paths = [f"g{base}/f{i}.php" for i in range(n)]
    for i in range(n):
        framework = r.choice([None, "jest", "phpunit"]) if i == 0 else r.choice([None] * 6 + ["jest"])
        g["files"].append((base + i, paths[i], framework, i > 0 and r.random() < 0.1))
    next_id = base + 100
    for i in range(n):
        for k in range(r.randint(1, 6)):
            line = r.randint(1, 12)
            kind = r.choice(["import-edge", "php-include", "symbol-use", "symbol-def", "hook-fire", "hook-listener", "rest-call-js", "rest-endpoint", "enqueue-script", "admin-page-register"])
            if i == 0 and k == 0:
                kind = "test-def"
            f = fact(next_id, base + i, kind, line, line + (r.randint(0, 6) if kind in ("symbol-def", "test-def") else 0), resolved=r.random() < 0.8)
            role = "subject" if kind in ("hook-listener", "rest-endpoint", "symbol-def") else "target"
            if kind == "import-edge":
                f |= {"resolved_path": r.choice(paths), "mocked": r.random() < 0.15, "dynamic": r.random() < 0.2, "type_only": r.random() < 0.1}
            elif kind == "php-include":
                f["target"] = r.choice(paths)
            elif kind in ("symbol-use", "symbol-def"):
                f |= {"callable": kind == "symbol-def" and r.random() < 0.7, "name": r.choice(["A::setUp", "A::run"])}
                g["links"].append((next_id, f"js-symbol:{r.choice(paths)}:s{r.randint(0, 2)}", role))
            elif kind.startswith("hook"):
                f["hook"] = r.choice(["a", "b", "{*}", None])
                g["links"].append((next_id, f"hook:g{base}_{r.choice(['a', 'b', 'a_{*}', 'a_x', '{*}'])}", role))
            elif kind.startswith("rest"):
                g["links"].append((next_id, f"rest:GET /g{base}/{r.choice(['x', 'y', '{*}', 'x/{*}', 'x/1', '{*}/1'])}", role))
            elif kind == "enqueue-script":
                g["links"].append((next_id, f"js-module:{r.choice(paths)}", "target"))
            if kind == "test-def":
                f["scopes"] = [(line, line + 3)] if r.random() < 0.5 else None
                g["tests"].append((f"t{base}", base, g["files"][0][2], next_id))
            g["facts"].append(f)
            next_id += 1
    return g
