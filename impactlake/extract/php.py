"""Facts of PHP: classes, functions, uses, includes, tests, and calls that patterns know."""

from __future__ import annotations

import posixpath
import re
from bisect import bisect_left, bisect_right
from functools import cached_property

from .patterns import Pattern, has_wildcard, rendered, unresolved
from .script import Fact
from .tokens import LexError

METHOD_CONSTANTS = {"READABLE": ["GET"], "CREATABLE": ["POST"], "EDITABLE": ["POST", "PUT", "PATCH"], "DELETABLE": ["DELETE"], "ALLMETHODS": ["GET", "POST", "PUT", "PATCH", "DELETE"]}
#: Functions that give the address of the folder a file is in (fixed values).
FOLDER_FUNCTIONS = ("get_template_directory_uri", "get_stylesheet_directory_uri", "plugin_dir_url", "get_theme_file_uri")
#: Classes from which test classes derive (fixed values).
TEST_BASES = ("PHPUnit\\Framework\\TestCase", "WP_UnitTestCase")
_LEX = re.compile(
    r"(?P<space>\s+)|(?P<doc>/\*\*(?=\s).*?\*/)|(?P<note>/\*.*?\*/|(?://|\#(?!\[))(?:(?!\?>)[^\n])*)|(?P<heredoc><<<[ \t]*(?P<q>['\"]?)(?P<id>[A-Za-z_]\w*)(?P=q)\r?\n)"
    r"|(?P<var>\$[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)|(?P<name>\\?[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*(?:\\[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)*)"
    r"|(?P<num>0[xX][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>[bB]?'(?:[^'\\]|\\.)*')|(?P<dstr>[bB]?\"(?:[^\"\\]|\\.)*\")|(?P<shell>`(?:[^`\\]|\\.)*`)"
    r"|(?P<p>\?->|\?\?=|\.\.\.|===|!==|<=>|\*\*=|->|::|=>|\.=|==|!=|<>|<=|>=|&&|\|\||\?\?|\+\+|--|\*\*|[-+*/%&|^]=|<<|>>|\#\[|[-+*/%&|^!<>=?:;,.~@()\[\]{}$])",
    re.DOTALL,
)
_BEGIN = re.compile(r"<\?(?:php\b|=)", re.IGNORECASE)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "#[": "]"}, {")": "(", "]": "[", "}": "{"}
_INSIDE = re.compile(r"\{\$(?:[^{}]|\{[^{}]*\})*\}|\$\{[^}]*\}|\$[A-Za-z_]\w*(?:\?*->[A-Za-z_]\w*|\[[^\]]*\])?")
_SHORT = {"n": "\n", "t": "\t", "r": "\r", "v": "\v", "e": "\x1b", "f": "\f"}
_CONTROL = frozenset("if elseif else while for foreach switch match catch return echo print include include_once require require_once and or xor not function fn array list isset unset empty exit die new use namespace class interface trait enum static clone yield throw declare instanceof insteadof as extends implements abstract final public private protected const var global do try finally case default goto break continue".split())
#: Words before a name that is then no use of a function or class.
_DECLARES = frozenset(["->", "?->", "function", "const", "class", "interface", "trait", "enum", "namespace", "use", "as", "insteadof", "goto"])
_LOOSE = frozenset(["?", "??", "||", "&&", "=", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "<=>", "<>", "=>", ",", ".=", "??=", "+=", "-=", "|", "&", "^"])


class PhpTokens:
    """As Tokens, with kinds name, var, num, str, dstr (``parts``: literals, and expressions in a list) and p; ``docs``: the comment before a token."""

    def __init__(self, text: str):
        self.source = text
        self.kind, self.text, self.start, self.end = [], [], [], []
        self.match: dict[int, int] = {}
        self.docs: dict[int, str] = {}
        self.parts: dict[int, list] = {}
        self._lines = [m.end() for m in re.finditer("\n", text)]
        held, at, doc = [], 0, None
        match, size = _LEX.match, len(text)
        kinds, texts, starts, ends = self.kind, self.text, self.start, self.end
        while True:
            m = _BEGIN.search(text, at)
            if not m:
                break
            at = m.end()
            while at < size:
                if text[at] == "?" and text.startswith("?>", at):
                    self._put("p", ";", at, at + 2)
                    at += 2
                    break
                m = match(text, at)
                if not m:
                    raise LexError("unterminated comment" if text.startswith("/*", at) else "unterminated string" if text[at] in "'\"" else "unexpected character", at)
                kind, begin = m.lastgroup, at
                at = m.end()
                if kind == "space":
                    continue
                word = text[begin:at]
                if kind == "q" or kind == "id":
                    kind = "heredoc"
                if kind == "doc":
                    doc = word
                elif kind == "heredoc":
                    close = re.compile(rf"^([ \t]*){m['id']}\b", re.MULTILINE).search(text, at)
                    if not close:
                        raise LexError("unterminated heredoc", begin)
                    body = text[at : max(at, close.start() - 1)]
                    body = re.sub(rf"(?m)^{close[1]}", "", body) if close[1] else body
                    i = self._put("str" if m["q"] == "'" else "dstr", body, begin, close.end())
                    if m["q"] != "'":
                        self._interpolated(i, body, "")
                    at = close.end()
                elif kind != "note":
                    if kind == "str":
                        word = word[word.index("'") + 1 : -1]
                        word = re.sub(r"\\([\\'])", r"\1", word) if "\\" in word else word
                    i = len(kinds)
                    kinds.append("str" if kind == "shell" else kind), texts.append(word), starts.append(begin), ends.append(at)
                    if kind == "dstr":
                        self._interpolated(i, word[word.index('"') + 1 : -1], '"')
                    if doc is not None:
                        self.docs[i], doc = doc, None
                    if kind == "p" and word in _OPEN:
                        held.append(i)
                    elif kind == "p" and word in _CLOSE:
                        if not held or _OPEN[self.text[held[-1]]] != word:
                            raise LexError("unbalanced bracket", begin)
                        j = held.pop()
                        self.match[j], self.match[i] = i, j
            else:
                break
        if held:
            raise LexError("bracket is not closed", self.start[held[-1]])

    def _put(self, kind: str, text: str, start: int, end: int) -> int:
        self.kind.append(kind), self.text.append(text), self.start.append(start), self.end.append(end)
        return len(self.kind) - 1

    def _interpolated(self, i: int, raw: str, quote: str) -> None:
        def plain(s: str) -> str:
            return re.sub(r"\\(?:([ntrvef\\$\"])|u\{([0-9a-fA-F]+)\}|x([0-9a-fA-F]{1,2})|([0-7]{1,3}))", lambda m: _SHORT.get(m[1], m[1]) if m[1] else chr(int(m[2] or m[3], 16)) if m[2] or m[3] else chr(int(m[4], 8) & 255), s)

        out, at = [], 0
        for m in _INSIDE.finditer(raw):
            if (len(raw[: m.start()]) - len(raw[: m.start()].rstrip("\\"))) % 2:
                continue
            out += [plain(raw[at : m.start()]), [m[0].strip("{}").replace("${", "$")]]
            at = m.end()
        self.parts[i] = [p for p in [*out, plain(raw[at:])] if p != ""]
        if all(isinstance(p, str) for p in self.parts[i]):
            self.kind[i], self.text[i] = "str", "".join(self.parts[i])

    def line(self, at: int) -> int:
        return bisect_right(self._lines, at) + 1


def normal_include(path: str) -> str:
    out: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == "..":
            out[-1:] = []
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def joined_route(namespace: str, route: str) -> str:
    middle = route.lstrip("/").rstrip("/")
    return re.sub("/+", "/", "/" + namespace.rstrip("/") + (f"/{middle}" if middle else ""))


def without_params(route: str) -> str:
    """Named groups of a route as ``{*}``, brackets balanced and those in character classes not counted."""
    out, at = [], 0
    while (m := re.compile(r"\(\?P?<").search(route, at)) is not None:
        out += [route[at : m.start()], "{*}"]
        depth, at = 0, m.start()
        for x in re.compile(r"\[[^\]]*(?:\]|\Z)|[()]").finditer(route, m.start()):
            depth += {"(": 1, ")": -1}.get(x[0], 0)
            if not depth:
                at = x.end()
                break
        else:
            return "".join(out)
    return "".join(out) + route[at:]


def wrapped_fact(p: Pattern, specs: list[dict], call: dict, name: str, lines: tuple[int, int]) -> Fact | None:
    """The fact that a call of a wrapper makes: the pattern's, on the values that the wrapper hands on."""

    def handed(k: int) -> object:
        spec = specs[k] if k < len(specs) else {}
        if spec.get("kind") == "param":
            i = spec["wrapperParamIdx"]
            return call["args"][i] if i < len(call["args"]) else None
        return spec.get("value")

    fields, failed, known = {}, [], True
    for key, bind in p.bind.items():
        value = handed(bind.arg)
        value = value if isinstance(value, str) and bind.type in ("string", "callable", "path-literal") or isinstance(value, int) and bind.type == "int" else None
        if (value is None or has_wildcard(value)) and not bind.optional:
            known = False
            failed.append({"field": key, "expression": value or ""})
        if value is not None:
            fields[key] = value
    anchors, template = [], p.template
    if p.transform == "rest-route":
        body = without_params(joined_route(fields.get("namespace", "{*}"), fields.get("route", "{*}")))
        anchors, template, fields = [(f"rest:GET {body}", "subject")], None, fields | {"method": "GET"}
    elif p.transform == "enqueue-src" and re.search(r"(?i)\.(?:mjs|cjs|jsx|tsx|ts|js)$", fields.get("src", "")) and not has_wildcard(fields["src"]):
        fields["srcPath"] = normal_include(fields["src"].lstrip("/"))
        anchors = [(f"js-module:{fields['srcPath']}", "target")]
    elif p.transform == "admin-page-slug" and fields.get("slug") in (None, "", "{*}"):
        return None
    if template is not None:
        key = rendered(template, fields)
        known &= key is not None
        anchors = [*([(key, p.role)] if key else []), *anchors]
    extra = {"unresolved": unresolved(call["scope"], failed)} if not known and failed else {}
    return Fact(p.emit, *lines, anchors, fields | {"meta": {"resolvedBy": "wrapper-auto", "wrapperName": name}} | extra, known)


class Php:
    def __init__(self, text: str, path: str, patterns: list[Pattern], test_bases: tuple[str, ...] = TEST_BASES):
        self.t, self.path, self.bases = PhpTokens(text), path, test_bases
        self.n = len(self.t.kind)
        #: Names and signs in lower case, by token; of others None.
        self.low = [x.lower() if k == "name" else x if k == "p" else None for k, x in zip(self.t.kind, self.t.text, strict=True)]
        self._where: dict[str | None, list[int]] = {}
        for i, x in enumerate(self.low):
            self._where.setdefault(x, []).append(i)
        self._vars = [i for i in self._where.get(None, ()) if self.t.kind[i] == "var"]
        #: Names before an opening bracket.
        self._called = [i - 1 for i in self._where.get("(", ()) if i and self.t.kind[i - 1] == "name"]
        self.patterns: dict[str, list[Pattern]] = {}
        for p in patterns:
            if p.lang == "php":
                self.patterns.setdefault(p.name, []).append(p)
        self.out: list[Fact] = []

    # --- structure -----------------------------------------------------------------------------

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < self.n and self.low[i] in texts

    def where(self, *texts: str) -> list[int]:
        """The tokens that ``is_`` one of ``texts``, in order."""
        return self._where.get(texts[0], []) if len(texts) == 1 else sorted(i for x in texts for i in self._where.get(x, ()))

    @staticmethod
    def between(tokens: list[int], first: int, stop: int) -> list[int]:
        """Those of a sorted list that stand from ``first`` on before ``stop``."""
        return tokens[bisect_left(tokens, first) : bisect_left(tokens, stop)]

    def after(self, i: int) -> int:
        j = self.t.match.get(i)
        return (j if j is not None and j > i else i) + 1

    def lines(self, first: int, last: int) -> tuple[int, int]:
        return self.t.line(self.t.start[first]), self.t.line(self.t.end[last] - 1)

    def top(self, span: tuple[int, int]) -> list[int]:
        match = self.t.match
        out, i = [], span[0]
        while i <= span[1]:
            out.append(i)
            j = match.get(i, i)
            i = (j if j > i else i) + 1
        return out

    def statement_end(self, i: int, stop: int) -> int:
        while i < stop and not self.is_(i, ";"):
            i = self.after(i)
        return min(i, stop - 1)

    def text_of(self, span: tuple[int, int] | None) -> str:
        return self.t.source[self.t.start[span[0]] : self.t.end[span[1]]] if span else ""

    def items(self, open_: int) -> list[tuple[int, int]]:
        """First and last token of what commas part between brackets; a name and colon before an argument left out."""
        match, low = self.t.match, self.low
        out, i, stop = [], open_ + 1, match[open_]
        while i < stop:
            first = i
            while i < stop and low[i] != ",":
                j = match.get(i, i)
                i = (j if j > i else i) + 1
            if i > first:
                out.append((first + 2 if self.t.kind[first] == "name" and self.is_(first + 1, ":") else first, i - 1))
            i += 1
        return out

    def array(self, span: tuple[int, int] | None) -> list[tuple[tuple[int, int] | None, tuple[int, int]]] | None:
        """(key, value) of an array literal, or None."""
        if span is None:
            return None
        a, b = span
        open_ = a if self.is_(a, "[") else a + 1 if self.is_(a, "array") and self.is_(a + 1, "(") else None
        if open_ is None or self.t.match.get(open_) != b:
            return None
        out = []
        for x, y in self.items(open_):
            arrow = next((i for i in self.top((x, y)) if self.is_(i, "=>")), None)
            out.append(((x, arrow - 1), (arrow + 1, y)) if arrow else (None, (x, y)))
        return out

    def string(self, span: tuple[int, int] | None) -> str | None:
        return self.t.text[span[0]] if span and span[0] == span[1] and self.t.kind[span[0]] == "str" else None

    @cached_property
    def functions(self) -> list[tuple[int, int, int, int | None, str | None, str]]:
        """(first token, name or keyword, last token, brace, name, what: function, method or closure)."""
        out = []
        holders = {brace: self.t.match[brace] for _, _, brace, _, _ in self.classes}
        for i in self.where("function", "fn"):
            if self.is_(i - 1, "->", "::", "?->", "use"):
                continue
            j = i + 1 + self.is_(i + 1, "&")
            name = self.t.text[j] if self.t.kind[j : j + 1] == ["name"] and not self.is_(i, "fn") and not self.is_(j, "use") else None
            k = j + (name is not None)
            if not self.is_(k, "("):
                continue
            k = self.after(k)
            if self.is_(i, "fn"):
                while k < self.n and not self.is_(k, "=>"):
                    k = self.after(k)
                k += 1
                while k < self.n and not self.is_(k, ",", ";", ")", "]", "}"):
                    k = self.after(k)
                out.append((i, i, k - 1, None, None, "closure"))
                continue
            while k < self.n and not self.is_(k, "{", ";"):
                k = self.after(k)
            brace = k if self.is_(k, "{") else None
            last = self.t.match[k] if brace is not None else min(k, self.n - 1)
            inside = max((b for b, e in holders.items() if b < i < e), default=None)
            owner = max((b for f in out if f[3] is not None and f[3] < i < self.t.match[f[3]] for b in [f[3]]), default=-1)
            what = "closure" if name is None else "method" if inside is not None and inside > owner else "function"
            first = i
            while first > 0 and self.is_(first - 1, "public", "private", "protected", "static", "final", "abstract", "var") or (first > 0 and self.is_(first - 1, "]") and self.t.text[self.t.match.get(first - 1, 0)] == "#["):
                first = self.t.match[first - 1] if self.is_(first - 1, "]") else first - 1
            out.append((first, i, last, brace, name, what))
        return out

    @cached_property
    def classes(self) -> list[tuple[int, str | None, int, list[tuple[str, str]], str]]:
        """(first token, name, brace, parents as (relation, name), keyword)."""
        out = []
        for i in self.where("class", "interface", "trait", "enum"):
            if self.is_(i - 1, "->", "::", "?->"):
                continue
            named = self.t.kind[i + 1 : i + 2] == ["name"] and not self.is_(i + 1, "extends", "implements")
            if not named and not self.is_(i - 1, "new", "readonly"):
                continue
            j, relation, parents = i + 1 + named, "", []
            if not named and self.is_(j, "("):
                j = self.after(j)
            while j < self.n and not self.is_(j, "{", ";"):
                if self.is_(j, "extends", "implements"):
                    relation = self.t.text[j].lower()
                elif self.t.kind[j] == "name" and relation:
                    parents.append((relation, self.t.text[j]))
                j += 1
            if self.is_(j, "{"):
                first = i
                while first > 0 and (self.is_(first - 1, "final", "abstract", "readonly") or (self.is_(first - 1, "]") and self.t.text[self.t.match.get(first - 1, 0)] == "#[")):
                    first = self.t.match[first - 1] if self.is_(first - 1, "]") else first - 1
                out.append((first, self.t.text[i + 1] if named else None, j, parents, self.t.text[i].lower()))
        return out

    # --- names -----------------------------------------------------------------------------------

    def _scan_names(self) -> None:
        """Namespaces and aliases by token, constants and properties."""
        self.spaces: list[tuple[int, str | None]] = [(-1, None)]
        self.aliases: list[tuple[int, str, str]] = []
        inside = [(b, self.t.match[b]) for _, _, b, _, _ in self.classes]
        for i in self.where("namespace", "use"):
            if self.is_(i, "namespace") and not self.is_(i - 1, "->", "::") and (self.t.kind[i + 1 : i + 2] == ["name"] or self.is_(i + 1, "{")):
                self.spaces.append((i, self.t.text[i + 1] if self.t.kind[i + 1] == "name" else None))
            elif self.is_(i, "use") and not self.is_(i + 1, "(") and not any(b < i < e for b, e in inside):
                stop = self.statement_end(i, self.n)
                if any(self.is_(k, "{") for k in range(i, stop)):
                    continue
                j = i + 1 + self.is_(i + 1, "function", "const")
                while j < stop:
                    whole = self.t.text[j].lstrip("\\")
                    alias = self.t.text[j + 2] if self.is_(j + 1, "as") else whole.rpartition("\\")[2]
                    self.aliases.append((i, alias, whole))
                    while j < stop and not self.is_(j, ","):
                        j += 1
                    j += 1
        self.defines: dict[str, str] = {}
        self.constants: dict[tuple[str, str], str] = {}
        self.props: dict[str, dict[str, str]] = {}
        self.locals: dict[int, dict[str, str]] = {}
        self.around: list[tuple[int, int, str]] = [(b, self.t.match[b], self.qualified(name, f)) for f, name, b, _, _ in self.classes if name]
        # constants may be made of constants before them
        for i in sorted([*self.where("define", "const"), *(i - 1 for i in self.where("=") if i and self.t.kind[i - 1] == "var")]):
            if self.is_(i, "define") and self.is_(i + 1, "(") and not self.is_(i - 1, "->", "::", "function"):
                args = self.items(i + 1)
                value = self.skeleton(args[1]) if len(args) > 1 else None
                if (name := self.string(args[0] if args else None)) and value is not None and "{*}" not in value:
                    self.defines.setdefault(name, value)
            elif self.is_(i, "const") and not self.is_(i - 1, "use"):
                stop, holder = self.statement_end(i, self.n), self.class_at(i)
                for x, y in self._parts(i + 1, stop - 1):
                    eq = next((k for k in range(x, y + 1) if self.is_(k, "=")), None)
                    value = self.skeleton((eq + 1, y)) if eq else None
                    if value is not None and "{*}" not in value:
                        if holder:
                            self.constants[holder, self.t.text[eq - 1]] = value
                        else:
                            self.defines.setdefault(self.t.text[eq - 1], value)
            elif self.t.kind[i] == "var" and self.is_(i + 1, "=") and (holder := self.class_at(i)) and self.function_at(i) is None:
                value = self.skeleton((i + 2, self._part_end(i + 2)))
                if value is not None and "{*}" not in value:
                    self.props.setdefault(holder, {})[self.t.text[i][1:]] = value
        for k, (_, _, last, brace, name, what) in enumerate(self.functions):
            if brace is not None and what != "closure":
                found: dict[str, set[str | None]] = {}
                for i in self.between(self._vars, brace + 1, last):
                    if self.is_(i + 1, "=", ".=", "??=", "+=") and not self.is_(i - 1, "->", "::"):
                        top = self.is_(i + 1, "=") and self.is_(i - 1, ";", "{", "}") and self.function_at(i) == k and not any(a > brace and a < i < self.t.match[a] for a in self.t.match if self.t.text[a] == "{" and a < self.t.match[a])
                        found.setdefault(self.t.text[i], set()).add(self.string((i + 2, self._part_end(i + 2))) if top else None)
                self.locals[k] = {v: next(iter(s)) for v, s in found.items() if len(s) == 1 and None not in s}
                if name == "__construct" and (holder := self.class_at(brace)):
                    for i in range(brace + 1, last):
                        if self.t.text[i] == "$this" and self.is_(i + 1, "->") and self.is_(i + 3, "=") and (value := self.string((i + 4, self._part_end(i + 4)))) is not None:
                            self.props.setdefault(holder, {}).setdefault(self.t.text[i + 2], value)

    def _part_end(self, i: int) -> int:
        while i < self.n and not self.is_(i, ";", ",", ")", "]", "}"):
            i = self.after(i)
        return i - 1

    def _parts(self, i: int, last: int) -> list[tuple[int, int]]:
        out, first = [], i
        while i <= last + 1:
            if i == last + 1 or self.is_(i, ","):
                out.append((first, i - 1))
                first = i + 1
            i = self.after(i) if i <= last else i + 1
        return [x for x in out if x[1] >= x[0]]

    def space(self, i: int) -> str | None:
        return max((x for x in self.spaces if x[0] <= i), key=lambda x: x[0])[1]

    def alias(self, i: int, name: str) -> str | None:
        begin = max(x[0] for x in self.spaces if x[0] <= i)
        return next((whole for at, alias, whole in reversed(self.aliases) if begin <= at <= i and alias == name), None)

    def class_at(self, i: int) -> str | None:
        return max((x for x in self.around if x[0] < i < x[1]), default=(0, 0, None))[2]

    def function_at(self, i: int) -> int | None:
        return max((k for k, f in enumerate(self.functions) if f[1] < i <= f[2]), key=lambda k: self.functions[k][1], default=None)

    def scope(self, i: int) -> str:
        k = max((k for k, f in enumerate(self.functions) if f[1] < i <= f[2] and f[5] != "closure"), default=None)
        holder = self.class_at(i)
        if k is None:
            return holder or "(file)"
        return f"{holder}::{self.functions[k][4]}" if holder and self.functions[k][5] == "method" else self.functions[k][4]

    def qualified(self, name: str, i: int) -> str:
        return f"{space}\\{name}" if (space := self.space(i)) else name

    def function_name(self, raw: str, i: int) -> str:
        raw = raw.lstrip("\\")
        head, _, rest = raw.partition("\\")
        if whole := self.alias(i, head):
            return f"{whole}\\{rest}" if rest else whole
        return raw

    def class_name(self, raw: str, i: int) -> str:
        if raw.startswith("\\"):
            return raw[1:]
        head, _, rest = raw.partition("\\")
        if whole := self.alias(i, head):
            return f"{whole}\\{rest}" if rest else whole
        return self.qualified(raw, i)

    # --- values ------------------------------------------------------------------------------------

    def part(self, source: str, i: int) -> str | None:
        m = re.fullmatch(r"\$this->([A-Za-z_]\w*)", source)
        if m:
            return self.prop(m[1], i)
        if re.fullmatch(r"\$[A-Za-z_]\w*", source):
            return self.variable(source, i)
        return None

    def variable(self, name: str, i: int) -> str | None:
        k = self.function_at(i)
        return self.locals.get(k, {}).get(name) if k is not None and self.functions[k][5] != "closure" else None

    def prop(self, name: str, i: int) -> str:
        value = self.props.get(self.class_at(i), {}).get(name)
        if value is None:
            self.missed.append(name)
            return "{*}"
        return value

    missed: list[str] = []

    def skeleton(self, span: tuple[int, int] | None) -> str | None:
        """What a string expression gives, with ``{*}`` for parts that are not known; None where it is no such expression."""
        if span is None or span[1] < span[0]:
            return None
        a, b = span
        while self.is_(a, "(") and self.t.match.get(a) == b:
            a, b = a + 1, b - 1
        tops, low = self.top((a, b)), self.low
        if any(low[i] in _LOOSE for i in tops):
            return None
        dots = [i for i in tops if low[i] == "."]
        if dots:
            left, right = self.skeleton((a, dots[-1] - 1)), self.skeleton((dots[-1] + 1, b))
            return "{*}" if left is None and right is None else (left or "{*}" if left is None else left) + ("{*}" if right is None else right)
        if a == b:
            kind, text = self.t.kind[a], self.t.text[a]
            if kind == "str":
                return text
            if kind == "dstr":
                return "".join(p if isinstance(p, str) else self.part(p[0], a) or "{*}" for p in self.t.parts[a])
            if kind == "var":
                return self.variable(text, a)
            if text.lower() in ("__dir__", "__file__"):
                return self.path if text.lower() == "__file__" else posixpath.dirname(self.path)
            if text.lower() == "__function__":
                k = self.function_at(a)
                return (self.functions[k][4] or "{closure}") if k is not None else ""
            return self.defines.get(text) if kind == "name" else None
        if self.is_(a, "dirname") and self.is_(a + 1, "(") and self.t.match[a + 1] == b:
            args = self.items(a + 1)
            base = self.skeleton(args[0]) if args else None
            if base is None or "{*}" in base:
                return None
            levels = int(self.t.text[args[1][0]]) if len(args) > 1 and self.t.kind[args[1][0]] == "num" else 1
            for _ in range(levels):
                base = posixpath.dirname(base)
            return base if levels > 0 else None
        if b == a + 2 and self.is_(a + 1, "::") and self.t.kind[b] == "name":
            holder = self.class_at(a) if self.is_(a, "self", "static") else None if self.is_(a, "parent") else self.class_name(self.t.text[a], a)
            return self.constants.get((holder, self.t.text[b]))
        if b == a + 2 and self.t.text[a] == "$this" and self.is_(a + 1, "->") and self.t.kind[b] == "name":
            return self.prop(self.t.text[b], a)
        return None

    def value(self, span: tuple[int, int] | None, kind: str) -> object:
        if span is None:
            return None
        a, b = span
        if kind == "string":
            return self.skeleton(span)
        if kind == "int" and a == b and self.t.kind[a] == "num" and re.fullmatch(r"\d+", self.t.text[a]):
            return int(self.t.text[a])
        if kind == "bool" and a == b and self.is_(a, "true", "false"):
            return self.is_(a, "true")
        if kind in ("callable", "path-literal") and self.string(span) is not None:
            return self.string(span)
        if kind == "callable" and (pair := self.array(span)) and len(pair) == 2:
            x, y = (self.string(v) for _, v in pair)
            return f"{x}::{y}" if x is not None and y is not None else None
        return None

    def strings(self, span: tuple[int, int] | None, i: int) -> list[str] | None:
        """The strings of an array literal, a merge of such, or a variable that last held one before ``i``."""
        if span is None:
            return None
        if (pairs := self.array(span)) is not None:
            out = [self.string(v) for _, v in pairs]
            return None if None in out else out
        a, b = span
        if a == b and self.t.kind[a] == "var":
            same = self.scope(i)
            for k in range(min(i, a) - 1, -1, -1):
                if self.t.kind[k] == "var" and self.t.text[k] == self.t.text[a] and self.is_(k + 1, "=") and self.scope(k) == same and (got := self.strings((k + 2, self._part_end(k + 2)), k)) is not None:
                    return got
        if self.is_(a, "array_merge") and self.is_(a + 1, "(") and self.t.match[a + 1] == b:
            each = [self.strings(x, i) for x in self.items(a + 1)]
            return None if None in each else [s for x in each for s in x]
        return None

    @cached_property
    def listings(self) -> list[tuple[int, int, str, list[str]]]:
        """(first, last token, expression, its values) of loops over lists and of guards by them."""
        out = []
        for i in self.where("foreach", "if", "elseif"):
            if not self.is_(i + 1, "("):
                continue
            close = self.t.match[i + 1]
            body = close + 1
            last = self.t.match[body] if self.is_(body, "{") else self.statement_end(body, self.n)
            if self.is_(i, "foreach"):
                at = next((k for k in range(i + 2, close) if self.is_(k, "as")), None)
                values = self.strings((i + 2, at - 1), i) if at else None
                if values and self.t.kind[close - 1] == "var":
                    out.append((i, last, self.t.text[close - 1], values))
            else:
                for k in range(i + 2, close):
                    if self.is_(k, "in_array") and self.is_(k + 1, "(") and not self.is_(k - 1, "!"):
                        args = self.items(k + 1)
                        values = self.strings(args[1], i) if len(args) > 1 else None
                        if values:
                            out.append((i, last, self.text_of(args[0]), values))
                        break
        return out

    def expanded(self, span: tuple[int, int] | None, frames: list) -> list[str] | None:
        """All strings that an expression gives over the listings around it."""
        if span is None:
            return None
        said = self.text_of(span)
        for _, _, text, values in reversed(frames):
            if text == said:
                return values
        if self.string(span) is not None:
            return [self.string(span)]
        a, b = span
        pieces: list[list[str] | None] = []
        if a == b and self.t.kind[a] == "dstr":
            pieces = [[p] if isinstance(p, str) else next((v for _, _, text, v in reversed(frames) if text == p[0]), None) for p in self.t.parts[a]]
        else:
            dots = [i for i in self.top(span) if self.is_(i, ".")]
            if not dots or any(self.low[i] in _LOOSE for i in self.top(span)):
                return None
            pieces = [self.expanded((x + 1, y - 1), frames) for x, y in zip([a - 1, *dots], [*dots, b + 1], strict=True)]
        out = [""]
        for p in pieces:
            if p is None:
                return None
            out = [x + y for x in out for y in p]
        return out

    # --- facts -------------------------------------------------------------------------------------

    def put(self, kind: str, span: tuple[int, int], anchors: list[tuple[str, str]], payload: dict, resolved: bool = True) -> None:
        self.out.append(Fact(kind, *self.lines(*span), anchors, payload, resolved))

    def use(self, name: str, span: tuple[int, int], **meta) -> None:
        self.put("symbol-use", span, [(f"php-symbol:{name}", "subject")], {"name": name, **({"meta": meta} if meta else {})})

    def class_use(self, raw: str, span: tuple[int, int], **meta) -> None:
        if raw.lower() not in ("self", "static", "parent"):
            self.use(self.class_name(raw, span[0]), span, **meta)

    def lacking(self, i: int, **fields: tuple[int, int] | None) -> dict:
        return unresolved(self.scope(i), [{"field": f, "expression": self.text_of(s)} for f, s in fields.items()])

    def covers(self, doc: str, span: tuple[int, int]) -> None:
        for raw in re.findall(r"@covers\s+([^\s*]+)", doc):
            raw = raw.rstrip("()")
            if raw.startswith("::"):
                self.use(self.function_name(raw[2:], span[0]), span, covers=True)
            elif raw:
                name, sep, method = raw.partition("::")
                self.use(self.class_name(name, span[0]) + sep + method, span, covers=True)

    def facts(self) -> list[Fact]:
        self.around, self.spaces, self.aliases, self.missed = [], [(-1, None)], [], []
        self._scan_names()
        classes = {c[0]: c for c in self.classes if c[1]}
        functions = {f[1]: f for f in self.functions if f[4]}
        test_classes = set()
        for i in range(self.n):
            if i in classes:
                first, name, brace, parents, keyword = classes[i]
                whole, span = self.qualified(name, i), (first, self.t.match[brace])
                for relation, parent in parents:
                    extends = keyword == "class" and relation == "extends"
                    self.class_use(parent, span, **({"rel": "extends"} if extends else {}))
                    base = self.class_name(parent, i)
                    if extends and (base in self.bases or re.search(r"(?i)(?:^|_)(?:Unit)?Test_?Case$", base.rpartition("\\")[2])):
                        test_classes.add(whole)
                props = self.props.get(whole)
                self.put("symbol-def", span, [(f"php-symbol:{whole}", "target")], {"name": whole, "exported": True, **({"meta": {"props": props}} if props else {})})
                self.covers(self.doc(first), span)
            if i in functions:
                first, _, last, _, name, what = functions[i]
                holder = self.class_at(i) if what == "method" else None
                if what == "method" and holder is None:
                    continue
                whole = f"{holder}::{name}" if holder else self.qualified(name, i)
                span, doc = (first, last), self.doc(first)
                self.put("symbol-def", span, [(f"php-symbol:{whole}", "target")], {"name": whole, "exported": holder is None, "meta": {"callable": True}})
                if holder:
                    attributes = self.t.source[self.t.start[first] : self.t.start[i]]
                    if holder in test_classes and (name.startswith("test") or "@test" in doc or re.search(r"#\[(?:[^\]]*,\s*)?Test\b", attributes)):
                        test = f"phpunit:{self.path}::{whole}"
                        self.put("test-def", span, [(f"test:{test}", "subject")], {"framework": "phpunit", "testId": test, "title": whole})
                        for provider in re.findall(r"@dataProvider\s+([^\s*]+)", doc):
                            self.use(f"{holder}::{provider.rstrip('()')}", span, provider=True)
                        for provider in re.findall(r"#\[(?:\w*\\)*DataProvider\(\s*['\"]([^'\"]+)['\"]", attributes):
                            self.use(f"{holder}::{provider}", span, provider=True)
                        for other, provider in re.findall(r"#\[(?:\w*\\)*DataProviderExternal\(\s*([\w\\]+)::class\s*,\s*['\"]([^'\"]+)['\"]", attributes):
                            self.use(f"{self.class_name(other, i)}::{provider}", span, provider=True)
                    self.covers(doc, span)
            kind = self.t.kind[i]
            if kind != "name" and kind != "var":
                continue
            if self.is_(i, "include", "include_once", "require", "require_once") and not self.is_(i - 1, "->", "::", "function"):
                self._include(i)
            elif kind == "name":
                self._name(i, test_classes)
            elif kind == "var" and self.is_(i + 1, "->", "?->") and self.t.kind[i + 2 : i + 3] == ["name"] and self.is_(i + 3, "("):
                holder, name = self.class_at(i), self.t.text[i + 2]
                self._patterns("method-call", i, i + 3, name, self.t.text[i][1:])
                if self.t.text[i] == "$this" and holder in test_classes:
                    self.use(f"{holder}::{name}", (i, self.t.match[i + 3]))
        self.wrapper_rows()
        return self.out

    def doc(self, i: int) -> str:
        return self.t.docs.get(i, "")

    # --- wrappers ----------------------------------------------------------------------------------

    @cached_property
    def wrappers(self) -> list[tuple[tuple, str, list[dict]]]:
        """(function, pattern callee, what each argument is) of functions that hand a parameter on to a call that patterns know.

        The call is a statement of the body, or of a closure that the body gives to
        ``add_action`` and that uses the parameter.
        """
        out = []
        for k, f in enumerate(self.functions):
            first, at, last, brace, name, what = f
            if brace is None or name is None or what == "closure":
                continue
            params = {self.t.text[i]: n for n, (a, b) in enumerate(self.items(next(i for i in range(at, brace) if self.is_(i, "(")))) for i in range(a, b + 1) if self.t.kind[i] == "var"}
            local = {self.t.text[i]: (i + 2, self._part_end(i + 2)) for i in self.between(self._vars, brace + 1, last) if self.is_(i + 1, "=") and self.is_(i - 1, ";", "{", "}") and self.function_at(i) == k}
            for i in self.between(self._called, brace + 1, last):
                if self.t.text[i] not in self.patterns or not self.is_(i - 1, ";", "{", "}"):
                    continue
                inner = self.function_at(i)
                known = params
                if inner != k:
                    closure = self.functions[inner]
                    outer = next((x for x in range(closure[0], brace, -1) if self.is_(x, "add_action") and self.is_(x + 1, "(")), None)
                    if closure[5] != "closure" or outer is None or self.t.match[outer + 1] < closure[2] or self.function_at(closure[0]) != k or closure[3] is None:
                        continue
                    listed = {self.t.text[x] for x in range(closure[1], closure[3]) if self.t.kind[x] == "var"}
                    known = {v: n for v, n in params.items() if v in listed}
                specs = []
                for a, b in self.items(i + 1):
                    a, b = local.get(self.t.text[a], (a, b)) if a == b and self.t.kind[a] == "var" and self.t.text[a] not in known else (a, b)
                    value = self.skeleton((a, b))
                    if a == b and self.t.text[a] in known:
                        specs.append({"kind": "param", "wrapperParamIdx": known[self.t.text[a]]})
                    elif value is not None:
                        specs.append({"kind": "fixed", "value": value})
                    else:
                        specs.append({"kind": "unresolved"})
                if any(s["kind"] == "param" for s in specs):
                    out.append((f, self.t.text[i], specs))
        return out

    def wrapper_rows(self) -> None:
        """Rows of wrappers and of calls that may be of one; what they make is found when all files are read."""
        for f, wraps, specs in self.wrappers:
            holder = self.class_at(f[1]) if f[5] == "method" else None
            self.put("wrapper-def", (f[0], f[2]), [], {"name": f[4], "class": holder, "wraps": wraps, "argSpecs": specs, "source": "auto"})
        for i in self._called:
            if self.low[i] in _CONTROL or self.t.text[i] in self.patterns or self.is_(i - 1, "function", "new"):
                continue
            shape, holder, first = "function", None, i
            if self.is_(i - 1, "->", "?->"):
                own = self.t.text[i - 2] == "$this" and self.class_at(i) is not None
                shape, holder, first = ("method-this", self.class_at(i), i - 2) if own else ("method-instance", None, i - 2)
            elif self.is_(i - 1, "::"):
                raw = self.t.text[i - 2]
                shape, first = "static-method", i - 2
                holder = self.class_at(i) if raw.lower() in ("self", "static") else self.class_name(raw, i) if self.t.kind[i - 2] == "name" else None
            args = [self.skeleton(x) for x in self.items(i + 1)]
            self.put("wrapper-call", (first, self.t.match[i + 1]), [], {"callee": self.t.text[i], "shape": shape, "class": holder, "args": args, "scope": self.scope(i)})

    def _include(self, i: int) -> None:
        last = i + 1
        while last < self.n and not self.is_(last, ";", ")", ",", "]", "}", "or", "and"):
            last = self.after(last)
        inner, span = (i + 1, last - 1), (i, last - 1)
        raw = self.skeleton(inner)
        if raw is None:
            self.put("php-include", span, [], {"target": "{*}", "unresolved": self.lacking(i, target=inner)}, False)
            return
        target = raw if "{*}" in raw else normal_include(raw)
        known = "{*}" not in raw
        self.put("php-include", span, [(f"php-file:{target}", "target")], {"target": target, **({} if known else {"unresolved": self.lacking(i, target=inner)})}, known)

    def _name(self, i: int, test_classes: set[str]) -> None:
        raw = self.t.text[i]
        if i and self.low[i - 1] in _DECLARES:
            return
        if self.is_(i + 1, "::") and not self.is_(i - 1, "::"):
            last = i + 2
            static = self.is_(last + 1, "(") and self.t.kind[last] in ("name", "var")
            span = (i, self.t.match[last + 1] if static else min(last, self.n - 1))
            if static or self.t.kind[last] in ("name", "var"):
                self.class_use(raw, span)
            if static and self.t.kind[last] == "name":
                holder = self.class_at(i) if raw.lower() in ("self", "static") else self.class_name(raw, i)
                self._patterns("static-call", i, last + 1, self.t.text[last], holder)
                if self.class_at(i) in test_classes and holder:
                    self.use(f"{holder}::{self.t.text[last]}", span)
        elif self.is_(i - 1, "new") and raw.lower() not in ("class", "static"):
            span = (i - 1, self.t.match[i + 1] if self.is_(i + 1, "(") else i)
            self.class_use(raw, span)
            self._patterns("new-expression", i - 1, i + 1 if self.is_(i + 1, "(") else None, raw.rpartition("\\")[2], None)
        elif self.is_(i + 1, "(") and raw.lower() not in _CONTROL and not self.is_(i - 1, "::", "new", "&") or self.is_(i - 1, "&") and self.is_(i + 1, "(") and not self.is_(i - 2, "function") and raw.lower() not in _CONTROL:
            self._patterns("function-call", i, i + 1, raw.lstrip("\\"), None)
            self.use(self.function_name(raw, i), (i, self.t.match[i + 1]))

    def _patterns(self, node: str, first: int, open_: int | None, name: str, receiver: str | None) -> None:
        # what a wrapper hands on is known where it is called
        if name in self.patterns and any(f[3] < first < f[2] for f, _, _ in self.wrappers):
            return
        for p in self.patterns.get(name, ()):
            if p.node == node and (p.receiver is None or p.receiver == receiver):
                self._apply(p, first, open_, name)

    def _apply(self, p: Pattern, first: int, open_: int | None, name: str) -> None:
        args = self.items(open_) if open_ is not None else []
        span = (first, self.t.match[open_] if open_ is not None else first + 1)
        arg = lambda k: args[k] if k < len(args) else None
        self.missed = []
        fields, failed, known = {}, {}, True
        for key, bind in p.bind.items():
            value = self.value(arg(bind.arg), bind.type)
            if (value is None or has_wildcard(value)) and not bind.optional:
                known, failed[key] = False, arg(bind.arg)
            if value is not None:
                fields[key] = value
        special = {"rest-route": self._rest, "enqueue-src": self._enqueue, "admin-page-slug": self._admin_page, "block-render": self._block, "localize-data": self._localize, "wp-ajax-callback": self._ajax_callback, "php-binary-script": self._binary}
        if p.transform in special:
            special[p.transform](span, args, fields, name)
            return
        frames = [f for f in self.listings if f[0] <= first <= f[1]]
        if frames:
            for key, bind in p.bind.items():
                values = self.expanded(arg(bind.arg), frames) if bind.type == "string" else None
                if values:
                    for v in values:
                        own = fields | {key: v}
                        anchor = rendered(p.template, own) if p.template is not None else None
                        self.put(p.emit, span, [(anchor, p.role)] if anchor else [], own)
                    return
        anchors = []
        if p.template is not None:
            anchor = rendered(p.template, fields)
            known &= anchor is not None
            anchors += [(anchor, p.role)] if anchor else []
        if p.emit == "php-include" and (scope := self.scope(first)) != "(file)":
            anchors.append((f"php-symbol:{scope}", "target"))
        if not known and failed:
            fields["unresolved"] = self.lacking(first, **failed)
        self.put(p.emit, span, anchors, fields, known)

    def _rest(self, span, args, fields: dict, name: str) -> None:
        arg = lambda k: args[k] if k < len(args) else None
        lost = {f: arg(k) for k, f in enumerate(("namespace", "route")) if not isinstance(fields.get(f), str)}
        if lost:
            self.put("rest-endpoint", span, [], fields | {"unresolved": self.lacking(span[0], **lost)}, False)
            return
        whole = joined_route(fields["namespace"], fields["route"])
        body, wild = without_params(whole), "{*}" in whole
        extra = {"routeParam": True} if not wild and "{*}" in body else {}
        if wild and self.missed:
            extra["unresolved"] = unresolved(self.scope(span[0]), [{"field": f, "expression": f"$this->{f}"} for f in dict.fromkeys(self.missed)])
        for method in self.methods(arg(2)) or ["GET"]:
            self.put("rest-endpoint", span, [(f"rest:{method} {body}", "subject")], {"method": method, "route": fields["route"], "namespace": fields["namespace"]} | extra, not wild)

    def methods(self, span) -> list[str]:
        out: list[str] = []
        for key, value in self.array(span) or ():
            named = (self.string(key) or "").lower() if key else None
            if named == "methods":
                out += self._methods_of(value)
            elif key is None or self.t.kind[key[0]] == "num":
                for k, v in self.array(value) or ():
                    if k and (self.string(k) or "").lower() == "methods":
                        out += self._methods_of(v)
        return list(dict.fromkeys(out))

    def _methods_of(self, span) -> list[str]:
        said = self.string(span)
        if said is not None:
            return [m for m in re.split(r"\s*,\s*", said.strip().upper()) if m]
        if span[1] == span[0] + 2 and self.is_(span[0] + 1, "::") and self.t.text[span[0]].lstrip("\\").lower() == "wp_rest_server":
            return METHOD_CONSTANTS.get(self.t.text[span[1]].upper(), [])
        return [m for _, v in self.array(span) or () for m in self._methods_of(v)]

    def _enqueue(self, span, args, fields: dict, name: str) -> None:
        arg = lambda k: args[k] if k < len(args) else None
        anchors, handle, source = [], fields.get("handle"), self._source(arg(1))
        named = isinstance(handle, str) and handle != "" and "{*}" not in handle
        if isinstance(handle, str) and handle:
            anchors.append((f"script-handle:{handle}", "subject"))
        there = bool(source) and "{*}" not in source and re.search(r"(?i)\.(?:mjs|cjs|jsx|tsx|ts|js)$", source) is not None
        if there:
            anchors.append((f"js-module:{source}", "target"))
            fields["srcPath"] = source
        lost = ({} if named else {"handle": arg(0)}) | ({} if there else {"src": arg(1)})
        self.put("enqueue-script", span, anchors, fields | ({"unresolved": self.lacking(span[0], **lost)} if lost else {}), not lost)

    def _source(self, span) -> str | None:
        if span is None:
            return None
        said, folder = self.string(span), posixpath.dirname(self.path)
        if said is not None:
            return normal_include(said.lstrip("/")) if said else None
        a, b = span
        if self.is_(a, "plugins_url") and self.is_(a + 1, "(") and self.t.match[a + 1] == b:
            args = self.items(a + 1)
            said = self.string(args[0]) if args else None
            return normal_include(f"{folder}/{said}") if said is not None else None
        return self._below(span)

    def _below(self, span) -> str | None:
        """The path of a sum of a folder's address and a literal tail."""
        dots = [i for i in self.top(span) if self.is_(i, ".")]
        if not dots:
            return None
        base, tail = self._folder((span[0], dots[-1] - 1)), self.skeleton((dots[-1] + 1, span[1]))
        return normal_include(f"{base}/{tail}") if base is not None and tail is not None and "{*}" not in tail else None

    def _folder(self, span) -> str | None:
        a, b = span
        if self.is_(a, *FOLDER_FUNCTIONS) and self.is_(a + 1, "(") and self.t.match[a + 1] == b:
            return posixpath.dirname(self.path)
        if a == b and self.t.kind[a] == "name":
            return normal_include(self.defines[self.t.text[a]]) if self.t.text[a] in self.defines else None
        return self._below(span)

    def _admin_page(self, span, args, fields: dict, name: str) -> None:
        slug = fields.get("slug")
        if not isinstance(slug, str) or slug in ("", "{*}"):
            return
        sub, known = name == "add_submenu_page", "{*}" not in slug
        place = 4 if sub else 3
        lost = {} if known else {"unresolved": self.lacking(span[0], slug=args[place] if place < len(args) else None)}
        self.put("admin-page-register", span, [(f"wp-admin-page:{slug}", "subject")], {"slug": slug, "fn": "add_submenu_page" if sub else "add_menu_page"} | lost, known)
        callback = self._callback(args[5] if len(args) > 5 else None)
        if callback:
            self.use(callback, span)

    def _callback(self, span) -> str | None:
        said = self.string(span)
        if said is not None:
            return said or None
        pair = self.array(span)
        if not pair or len(pair) != 2 or not (method := self.string(pair[1][1])):
            return None
        a, b = pair[0][1]
        holder = self.string((a, b))
        if a == b and self.t.text[a] == "$this":
            holder = self.class_at(a)
        elif b == a + 2 and self.is_(a + 1, "::") and self.is_(b, "class"):
            holder = self.class_name(self.t.text[a], a)
        return f"{holder}::{method}" if holder else None

    def _block(self, span, args, fields: dict, name: str) -> None:
        first = args[0] if args else None
        block = self.string(first) if name != "register_block_type_from_metadata" else None
        known = bool(block) and "{*}" not in block
        if not known:
            options = next((x for x in reversed(args) if self.array(x) is not None), None)
            for key, value in self.array(options) or ():
                if key and self.string(key) == "render_callback":
                    m = re.fullmatch(r"render_block_core_([a-z0-9_]+)", self.string(value) or "")
                    if m:
                        block, known = "core/" + m[1].replace("_", "-"), True
                    break
        payload = {"name": block} if block else {}
        if not known:
            folder = self.skeleton(first)
            if folder and "{*}" not in folder:
                payload["dir"] = normal_include(folder)
            payload["unresolved"] = self.lacking(span[0], name=first)
        self.put("block-render", span, [(f"block:{block}", "subject")] if known else [], payload, known)

    def _localize(self, span, args, fields: dict, name: str) -> None:
        said = self.string(args[1] if len(args) > 1 else None)
        data = {self.string(k): v for k, x in (self.array(args[2]) if len(args) > 2 else None) or () if k and self.string(k) is not None and (v := self.string(x)) is not None}
        handle = fields.get("handle") or "{*}"
        payload = {"handle": handle, **({} if said is None else {"objectName": said}), **({"data": data} if data else {})}
        self.put("script-localize", span, [(f"script-handle:{handle}", "subject")], payload, "{*}" not in handle and said is not None)

    def _ajax_callback(self, span, args, fields: dict, name: str) -> None:
        action = fields.get("action")
        if isinstance(action, str) and action and "{*}" not in action:
            self.use("wp_ajax_" + action.replace("-", "_"), span)

    def _binary(self, span, args, fields: dict, name: str) -> None:
        command = self.array(args[0] if args else None)
        if not command or len(command) < 2 or not self.is_(command[0][1][0], "php_binary"):
            return
        raw = self.skeleton(command[1][1])
        if raw and "{*}" not in raw and (target := normal_include(raw)).lower().endswith(".php"):
            self.put("php-include", span, [(f"php-file:{target}", "target")], {"target": target})
