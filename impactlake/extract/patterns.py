"""Call-site patterns: a table of calls, what to bind of their arguments, and the facts they make."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from ..functions.scalars import CORE_ADMIN_PAGES, URL_ADMIN_PAGES
from .script import Fact, Script

TRANSFORMS = frozenset(
    "rest-route enqueue-src ajax-action-from-url admin-page-slug-from-url admin-page-slug-from-url-or-slug admin-page-slug block-render localize-data rest-url-normalise wp-frontend-or-admin-url wp-ajax-callback php-binary-script".split()
)
NODE_KINDS = ("function-call", "method-call", "static-call", "new-expression", "jsx-element")
BIND_TYPES = ("string", "int", "bool", "callable", "object", "array", "path-literal", "regex-literal")


@dataclass(frozen=True)
class Bind:
    arg: int
    type: str = "string"
    optional: bool = False
    default: object = None


@dataclass(frozen=True)
class Pattern:
    lang: str
    node: str
    name: str
    emit: str
    bind: dict[str, Bind] = field(default_factory=dict)
    receiver: str | None = None
    template: str | None = None
    role: str = "target"
    transform: str | None = None


def _js(node: str, name: str, emit: str, template: str, role: str = "target", receiver: str | None = None, transform: str | None = None, **bind: Bind) -> Pattern:
    return Pattern("ts", node, name, emit, bind, receiver, template, role, transform)


def _script_patterns() -> list[Pattern]:
    """Calls of the front end that are known without configuration (fixed values)."""
    first, config, data = Bind(0), Bind(0, "object"), Bind(1, "object", True)
    call, method = "function-call", "method-call"
    out = [
        _js(call, "apiFetch", "rest-call-js", "rest:GET {config.path}", config=config),
        _js(call, "fetch", "rest-call-js", "rest:GET {url}", url=first, init=data),
    ]
    for receiver, transform in (("axios", None), ("request", "rest-url-normalise"), ("requestUtils", "rest-url-normalise")):
        out += [_js(method, verb, "rest-call-js", f"rest:{verb.upper()} {{url}}", receiver=receiver, transform=transform, url=first) for verb in ("get", "post", "put", "patch", "delete")]
    url = Bind(0, "string", True)
    out += [_js(method, "ajax", "ajax-call-js", "ajax:{config.data.action}", receiver=r, config=config) for r in ("jQuery", "$", "Backbone")]
    out += [_js(method, name, "ajax-call-js", "ajax:{data.action}", receiver=r, url=url, data=data) for name in ("post", "get", "getJSON") for r in ("jQuery", "$")]
    out += [
        _js(method, "post", "ajax-call-js", "ajax:{action}", receiver="$", transform="ajax-action-from-url", url=url),
        _js(method, "post", "ajax-call-js", "ajax:{action}", receiver="ajax", action=first),
    ]
    for node, receiver in ((call, None), (method, "hooks")):
        out += [_js(node, name, "hook-listener", "hook:{hook}", "subject", receiver, hook=first) for name in ("addAction", "addFilter")]
        out += [_js(node, name, "hook-fire", "hook:{hook}", "target", receiver, hook=first) for name in ("doAction", "applyFilters")]
    out += [_js(call, name, "store-register", "wp-store:{key}", "subject", key=first) for name in ("registerStore", "createReduxStore")]
    out += [_js(call, name, "store-access", "wp-store:{key}", key=first) for name in ("useDispatch", "select", "dispatch")]
    out.append(_js(call, "registerBlockType", "block-render", "block:{name}", name_=first))
    for transform, template in (("admin-page-slug-from-url", "wp-admin-page:{slug}"), ("wp-frontend-or-admin-url", "{anchor}")):
        out += [_js(method, name, "admin-page-nav", template, receiver="page", transform=transform, url=first) for name in ("goto", "route")]
    out += [
        _js(method, "visitAdminPage", "admin-page-nav", "wp-admin-page:{slug}", receiver="admin", transform="admin-page-slug-from-url-or-slug", adminPath=first),
        _js(method, "createNewPost", "admin-page-nav", "wp-admin-page:post-new.php", receiver="admin"),
        _js(method, "publishPost", "admin-page-nav", "wp-admin-page:post.php", receiver="editor"),
        _js(method, "deleteAllPosts", "rest-call-js", "rest:DELETE /wp/v2/posts/{*}", receiver="requestUtils"),
    ]
    return [Pattern(p.lang, p.node, p.name, p.emit, {k.rstrip("_"): v for k, v in p.bind.items()}, p.receiver, p.template, p.role, p.transform) for p in out]


SCRIPT_PATTERNS = _script_patterns()


def _php_patterns() -> list[Pattern]:
    """Calls of the back end that are known without configuration (fixed values)."""

    def of(name: str, emit: str, template: str, role: str, transform: str | None = None, **bind: Bind) -> Pattern:
        return Pattern("php", "function-call", name, emit, {k.rstrip("_"): v for k, v in bind.items()}, None, template, role, transform)

    listen = {"hook": Bind(0), "callback": Bind(1, "callable", True), "priority": Bind(2, "int", True)}
    script = {"handle": Bind(0), "src": Bind(1, "string", True)}
    out = [of(name, "hook-listener", "hook:{hook}", "subject", **listen) for name in ("add_action", "add_filter")]
    out += [of(name, "hook-fire", "hook:{hook}", "target", hook=Bind(0)) for name in ("do_action", "apply_filters")]
    out.append(of("register_rest_route", "rest-endpoint", "rest:GET /{namespace}{route}", "subject", "rest-route", namespace=Bind(0), route=Bind(1)))
    out += [of(f"wp_{verb}_script", "enqueue-script", "script-handle:{handle}", "subject", "enqueue-src", **script) for verb in ("enqueue", "register")]
    out += [of(f"wp_{verb}_style", "enqueue-script", "script-handle:{handle}", "subject", **script) for verb in ("enqueue", "register")]
    out += [
        of("wp_localize_script", "script-localize", "script-handle:{handle}", "subject", "localize-data", handle=Bind(0)),
        of("add_shortcode", "shortcode", "shortcode:{tag}", "subject", tag=Bind(0), callback=Bind(1, "callable", True)),
        of("do_shortcode", "shortcode", "shortcode:{tag}", "target", tag=Bind(0)),
        *(of(name, "block-render", "block:{name}", "subject", "block-render", name_=Bind(0, "string", True)) for name in ("register_block_type", "register_block_type_from_metadata")),
        of("add_menu_page", "admin-page-register", "wp-admin-page:{slug}", "subject", "admin-page-slug", slug=Bind(3)),
        of("add_submenu_page", "admin-page-register", "wp-admin-page:{slug}", "subject", "admin-page-slug", slug=Bind(4)),
    ]
    return out


PHP_PATTERNS = _php_patterns()


# --- scalar functions on bound values ------------------------------------------------------------


def rendered(template: str, fields: dict) -> str | None:
    """The template with ``{a.b}`` taken from the fields; None where one is missing or no plain value."""
    lost = False

    def one(m: re.Match) -> str:
        nonlocal lost
        if m[1] == "*":
            return m[0]
        value: object = fields
        for key in m[1].split("."):
            value = value.get(key) if isinstance(value, dict) else None
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, str | int | float):
            return str(value)
        lost = True
        return ""

    text = re.sub(r"\{([^}]+)\}", one, template)
    return None if lost else text


def has_wildcard(value: object) -> bool:
    if isinstance(value, dict):
        return any(map(has_wildcard, value.values()))
    if isinstance(value, list):
        return any(map(has_wildcard, value))
    return isinstance(value, str) and "{*}" in value


def expr_hash(scope: str, fields: list[dict]) -> str:
    lines = "".join(f"{f['field']}={f['expression']}\n" for f in sorted(fields, key=lambda f: f["field"]))
    return hashlib.sha256(f"{scope}\n{lines}".encode()).hexdigest()


def unresolved(scope: str, fields: list[dict]) -> dict:
    return {"scope": scope, "fields": fields, "exprHash": expr_hash(scope, fields)}


def _page_of(url: str) -> str | None:
    m = re.search(r"[?&]page=([A-Za-z0-9_-]+)", url)
    return m[1] if m else None


def _slug_or_page(value: str) -> str | None:
    bare = re.sub(r"^\.?/?wp-admin/", "", value)
    if bare.startswith("admin.php"):
        return _page_of(bare)
    head = bare.partition("?")[0]
    return head if head in CORE_ADMIN_PAGES else None


def _rest_url(url: str) -> str | None:
    m = re.search(r"\bwp-json(/[^?#]*)", url)
    if m:
        return m[1]
    return re.match(r"[^?#]*", url)[0] if re.match(r"/[A-Za-z0-9_-]+/v[0-9]+(?:/|\Z)", url) else None


def _url_anchor(url: str) -> str | None:
    if not url:
        return None
    path = re.match(r"[^?#]*", re.sub(r"^https?://[^/]+", "", url))[0]
    known = {"/": "wp-frontend:home", "/wp-login.php": "wp-frontend:login", "/wp-admin": "wp-admin-page:index.php", "/wp-admin/": "wp-admin-page:index.php"}
    page = path.removeprefix("/wp-admin/")
    return known.get(path) or (f"wp-admin-page:{page}" if path != page and page in URL_ADMIN_PAGES else None)


def transformed(name: str | None, fields: dict, call: str) -> bool:
    """Apply a transform to bound fields; False where there is no fact."""
    url = fields.get("url")
    if name == "ajax-action-from-url":
        m = re.search(r"[?&]action=([A-Za-z0-9_-]+)", url) if isinstance(url, str) else None
        if m:
            fields["action"] = m[1]
            del fields["url"]
    elif name == "admin-page-slug-from-url":
        fields["method"] = call
        slug = _page_of(url) if isinstance(url, str) and "admin.php" in url else None
        if slug is None:
            return False
        fields["slug"] = slug
    elif name == "rest-url-normalise":
        path = _rest_url(url) if isinstance(url, str) else None
        if path is None:
            return False
        fields["url"] = path
    elif name == "admin-page-slug-from-url-or-slug":
        fields["method"] = call
        raw = fields.get("adminPath", url)
        slug = _slug_or_page(raw) if isinstance(raw, str) and raw else None
        if slug is None:
            return False
        fields["slug"] = slug
    elif name == "wp-frontend-or-admin-url":
        fields["method"] = call
        anchor = _url_anchor(url) if isinstance(url, str) else None
        if anchor is None:
            return False
        fields["anchor"] = anchor
    return True


# --- expressions of a script ----------------------------------------------------------------------

Span = tuple[int, int]
_LOOSE = frozenset(["?", "||", "&&", "??", "=", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "=>", ",", "+=", "-=", "instanceof", "in", "|", "&", "^"])


class Matcher:
    """Facts that patterns make of the calls of a script."""

    def __init__(self, script: Script, patterns: list[Pattern]):
        self.s, self.t = script, script.t
        self.patterns: dict[str, list[Pattern]] = {}
        for p in patterns:
            if p.lang != "php":
                self.patterns.setdefault(p.name, []).append(p)
        self.inits = self._inits()
        #: Names that imports bind: specifier, and the name there.
        self.imported = {here: (self.t.text[x["at"]], there) for x in script.import_list if "bound" in x for there, here, _ in x["bound"]["names"]}

    def top(self, span: Span) -> list[int]:
        """The tokens of an expression that stand in no group of it, openings of groups included."""
        out, i = [], span[0]
        while i <= span[1]:
            out.append(i)
            i = self.s.after(i)
        return out

    def unwrapped(self, span: Span) -> Span:
        a, b = span
        while True:
            if self.s.is_(a, "(") and self.t.match.get(a) == b:
                a, b = a + 1, b - 1
            elif self.s.is_(b, "!") and b > a:
                b -= 1
            else:
                cut = next((i for i in self.top((a, b)) if i > a and self.t.kind[i] == "id" and self.t.text[i] in ("as", "satisfies") and not self.s.is_(i - 1, ".")), None)
                if cut is None:
                    return a, b
                b = cut - 1

    def _literal(self, span: Span) -> bool:
        a, b = span
        return (a == b and (self.t.kind[a] in ("str", "num") or self.s.is_(a, "true", "false"))) or (self.s.is_(a, "{", "`") and self.t.match.get(a) == b)

    def _inits(self) -> dict[str, Span]:
        out = {}
        for i in range(self.s.n):
            if self.t.kind[i] == "id" and self.t.text[i] in ("const", "let", "var") and not self.s.is_(i - 1, "."):
                j = i + 1
                while j < self.s.n:
                    name, k = self.s.name(j), j + 1 if self.s.name(j) else self.s.after(j)
                    while k < self.s.n and not self.s.is_(k, "=", ",", ";", ")", "}", "]", "of", "in") and not self.s.breaks(k):
                        k = self.s.type_end(k) if self.s.is_(k, "<") else self.s.after(k)
                    if not self.s.is_(k, "="):
                        if self.s.is_(k, ","):
                            j = k + 1
                            continue
                        break
                    first = k = k + 1
                    while k < self.s.n and not self.s.is_(k, ",", ";", ")", "}", "]") and not (k > first and self.s.breaks(k)):
                        k = self.s.after(k)
                    if name and k > first and self._literal(span := self.unwrapped((first, k - 1))):
                        out[name] = span
                    if not self.s.is_(k, ","):
                        break
                    j = k + 1
        return out

    def resolved(self, span: Span) -> Span:
        a, b = self.unwrapped(span)
        return self.inits.get(self.t.text[a], (a, b)) if a == b and self.s.name(a) else (a, b)

    def skeleton(self, a: int) -> str:
        """A template with ``{*}`` for its expressions."""
        out, i, stop = [], a + 1, self.t.match[a]
        while i < stop:
            out.append(self.t.text[i] if self.t.kind[i] == "chunk" else "{*}")
            i = self.s.after(i)
        return "".join(out)

    def added(self, span: Span) -> str | None:
        """The skeleton of a sum; None where the expression is no sum."""
        tops = self.top(span)
        if any(self.s.is_(i, *_LOOSE) for i in tops):
            return None
        signs = [i for i in tops if i > span[0] and self.s.is_(i, "+", "-") and not self.s.is_(i - 1, "+", "-", "*", "/", "%", "**", "(", "!", "~")]
        if not signs or not self.s.is_(signs[-1], "+"):
            return None
        return self.part((span[0], signs[-1] - 1)) + self.part((signs[-1] + 1, span[1]))

    def part(self, span: Span) -> str:
        a, b = self.unwrapped(span)
        if a == b and self.t.kind[a] == "str":
            return self.t.text[a]
        if self.s.is_(a, "`") and self.t.match.get(a) == b:
            return self.skeleton(a)
        return self.added((a, b)) or "{*}"

    def value(self, span: Span, kind: str) -> object:
        a, b = span
        if kind == "string":
            if a == b and self.t.kind[a] == "str":
                return self.t.text[a]
            return self.skeleton(a) if self.s.is_(a, "`") and self.t.match.get(a) == b else self.added(span)
        if kind == "int" and a == b and self.t.kind[a] == "num":
            return _number(self.t.text[a])
        if kind == "bool" and a == b and self.s.is_(a, "true", "false"):
            return self.t.text[a] == "true"
        if kind == "object" and self.s.is_(a, "{") and self.t.match.get(a) == b:
            out = {}
            for first, last, name in self.s.properties(a):
                if self.t.kind[first] != "id" or not self.s.is_(first + 1, ":"):
                    continue
                x, y = self.resolved((first + 2, last))
                if x == y and self.t.kind[x] == "num":
                    out[name] = _number(self.t.text[x])
                elif x == y and self.s.is_(x, "true", "false"):
                    out[name] = self.t.text[x] == "true"
                elif self.s.is_(x, "{") and self.t.match.get(x) == y:
                    out[name] = self.value((x, y), "object")
                elif (x == y and self.t.kind[x] == "str") or (self.s.is_(x, "`") and self.t.match.get(x) == y):
                    out[name] = self.value((x, y), "string")
            return out
        if kind == "array" and self.s.is_(a, "[") and self.t.match.get(a) == b:
            return []
        return None

    def scope(self, i: int) -> str:
        """``Class::function`` that encloses a token by name, or ``(file)``."""
        holders = sorted((a, b) for a, b in self.s.functions if a < i <= b)
        names = []
        for a, _ in holders:
            if a in self.s.method_names and self.t.kind[a] == "id":
                names.append((a, self.t.text[a]))
            elif self.s.is_(a, "function") and (name := self.s.name(a + 1 + self.s.is_(a + 1, "*"))) and (a == 0 or self.s.is_(a - 1, ";", "{", "}", "export", "default", "async", ")") or self.s.breaks(a)):
                names.append((a, name))
        around = max(((a, name) for name, a, brace, declared in self.s.classes if name and declared and a <= i <= self.t.match[brace]), default=None)
        if around:
            own = [n for a, n in names if a > around[0]]
            return f"{around[1]}::{own[-1]}" if own else around[1]
        return names[-1][1] if names else "(file)"

    def begin(self, i: int) -> int:
        """The first token of the expression whose last name is ``i``."""
        while self.s.is_(i - 1, ".", "?."):
            i -= 2
            while self.s.is_(i, ")", "]", "`", "!"):
                i = self.t.match.get(i, i)
                if i > 0 and (self.s.name(i - 1) or self.s.is_(i - 1, ")", "]")):
                    i -= 1
                else:
                    return i
        return i

    def constants(self) -> list[Fact]:
        """Exported constants that are strings, for other files' calls."""
        out = []
        for name, (a, b, exported, what) in self.s.declared.items():
            value = self.value(self.inits[name], "string") if exported and what == "variable" and name in self.inits else None
            if value is not None and "{*}" not in value:
                out.append(Fact("script-constant", a, b, [], {"name": name, "value": value}))
        return out

    def facts(self) -> list[Fact]:
        out = []
        silent = {k for a, b in self.s.types for k in range(a, b + 1)}
        for i in range(self.s.n):
            if self.t.kind[i] != "id" or self.t.text[i] not in self.patterns or i in silent or i in self.s.method_names or self.s.is_(i - 1, "function"):
                continue
            j = i + 1 + self.s.is_(i + 1, "?.")
            if self.s.typed and self.s.is_(j, "<") and self.s.is_(self.s.type_end(j), "("):
                j = self.s.type_end(j)
            if not self.s.is_(j, "("):
                continue
            member, receiver = self.s.is_(i - 1, ".", "?."), None
            if member and self.t.kind[i - 2] == "id" and self.t.text[i - 2] not in ("this", "super"):
                receiver = self.t.text[i - 2]
            new = not member and self.s.is_(i - 1, "new")
            first = i - 1 if new else self.begin(i)
            call = self.s_call(first, j)
            for p in self.patterns[self.t.text[i]]:
                if p.node == "jsx-element" or new != (p.node == "new-expression"):
                    continue
                if p.node == "function-call" and receiver is not None:
                    continue
                if p.node in ("method-call", "static-call") and (receiver is None or (p.receiver is not None and p.receiver != receiver)):
                    continue
                if (fact := self.made(p, call, first, self.t.text[i])) is not None:
                    out.append(fact)
        return out

    def s_call(self, first: int, open_: int):
        from .script import Call

        return Call(first, open_ - 1, open_, False, None, self.t.match[open_])

    def made(self, p: Pattern, call, first: int, name: str) -> Fact | None:
        fields: dict = {}
        args, known, failed = self.s.arguments(call), True, []
        for key, bind in p.bind.items():
            raw = args[bind.arg] if bind.arg < len(args) else None
            value = self.value(self.resolved(raw), bind.type) if raw else bind.default
            if (value is None or (isinstance(value, str) and "{*}" in value)) and not bind.optional:
                known = False
                failed.append({"field": key, "expression": self.t.source[self.t.start[raw[0]] : self.t.end[raw[1]]] if raw else ""})
            if value is not None:
                fields[key] = value
        if not transformed(p.transform, fields, name):
            return None
        if known and has_wildcard(fields):
            known = False
        anchors = []
        if p.template is not None:
            key = rendered(p.template, fields)
            if key is not None and p.emit == "rest-call-js" and key.startswith("rest:GET "):
                method = next((m for f in ("config", "init") if isinstance(fields.get(f), dict) and isinstance(m := fields[f].get("method"), str) and m), None)
                key = f"rest:{method.upper()} {key[9:]}" if method else key
            if key is None:
                known = False
            else:
                anchors.append((key, p.role))
        if not known and failed:
            fields["unresolved"] = unresolved(self.scope(first), failed)
            # the one name that is missing may be a constant of another file
            there = self.imported.get(failed[0]["expression"])
            if len(failed) == 1 and there and p.transform is None and p.template is not None and re.findall(r"\{[^}*]+\}", p.template) == [f"{{{failed[0]['field']}}}"]:
                fields["imported"] = {"field": failed[0]["field"], "specifier": there[0], "name": there[1], "template": p.template, "role": p.role}
        return Fact(p.emit, self.s.first_line(first), self.s.last_line(call.end), anchors, fields, known)


def _number(text: str) -> int | float:
    text = text.replace("_", "").rstrip("n")
    return int(text, 0) if re.fullmatch(r"0[xXbBoO].*|[1-9]\d*|0", text) else float(text)
