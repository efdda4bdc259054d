"""Facts of JavaScript and TypeScript: imports, symbols, uses, globals and tests.

A fact is (kind, resolved, start_line, end_line, anchors, payload); anchors are (key, role).
Where a module's file is not known yet, an anchor names the specifier and ``resolve.py``
joins it with the files there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

from .tokens import KEYWORDS, Tokens

MARKUP = ("tsx", "jsx", "js", "mjs", "cjs")
#: Names under which tests and groups of tests are declared, and what may follow them (fixed values).
TEST_MODIFIERS = frozenset("concurrent fail failing fixme only skip slow todo".split())
GROUP_MODIFIERS = frozenset("only parallel serial skip".split())
_MODIFIERS = frozenset("export default declare abstract async public private protected static readonly override accessor".split())
_GOES_ON = frozenset("instanceof in of as satisfies extends implements".split())
_STARTS = frozenset(["{", "@", "!", "~", "++", "--", "..."])


@dataclass
class Fact:
    kind: str
    start_line: int
    end_line: int
    anchors: list[tuple[str, str]]
    payload: dict
    resolved: bool = True


@dataclass
class Call:
    """A call or ``new`` expression: its callee's first and last token, and the bracket of its arguments (or none)."""

    at: int
    last: int
    open: int | None
    new: bool
    chain: list[str] | None  # names of the callee where it is a chain of plain names

    end: int = field(default=0)


class Script:
    def __init__(self, text: str, path: str, language: str):
        self.t = Tokens(text, language in MARKUP)
        self.path, self.typed = path, language in ("ts", "tsx")
        self.n = len(self.t)
        #: Names and signs, by token; of others None.
        self.word = [x if k == "id" or k == "p" else None for k, x in zip(self.t.kind, self.t.text, strict=True)]

    # --- structure ---------------------------------------------------------------------------

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < self.n and self.word[i] in texts

    def name(self, i: int) -> str | None:
        return self.t.text[i] if 0 <= i < self.n and self.t.kind[i] == "id" and self.t.text[i] not in KEYWORDS and self.t.text[i][0] != "#" else None

    def after(self, i: int) -> int:
        """The token after ``i``, or after the group that ``i`` opens."""
        j = self.t.match.get(i)
        return (j if j is not None and j > i else i) + 1

    def first_line(self, i: int) -> int:
        return self.t.line(self.t.start[i])

    def last_line(self, i: int) -> int:
        return self.t.line(self.t.end[i])

    def new_line(self, i: int) -> bool:
        return i > 0 and self.t.line(self.t.end[i - 1] - 1) < self.first_line(i)

    def breaks(self, i: int) -> bool:
        """Whether a statement that reaches ``i`` ends before it without a semicolon."""
        if not self.new_line(i):
            return False
        kind, text = self.t.kind[i - 1], self.t.text[i - 1]
        ends = kind in ("num", "str", "re") or (kind == "id" and text not in _GOES_ON and text not in ("typeof", "new", "return", "case", "else", "do")) or (kind == "p" and text in (")", "]", "}", "`", "</>", "++", "--"))
        starts = self.t.kind[i] in ("num", "str", "re") or (self.t.kind[i] == "id" and self.t.text[i] not in _GOES_ON) or (self.t.kind[i] == "p" and self.t.text[i] in _STARTS) or self.is_(i, "<>")
        return ends and starts

    def statement_end(self, i: int, stop: int) -> int:
        """The last token of an expression statement or declaration that holds ``i``."""
        begin = i
        while i < stop:
            if self.is_(i, ";"):
                return i
            if i > begin and self.breaks(i):
                return i - 1
            i = self.after(i)
        return stop - 1

    def type_end(self, i: int) -> int:
        """After a type's ``<...>`` that opens at ``i``."""
        depth = 0
        while i < self.n:
            if self.is_(i, "<"):
                depth += 1
            elif self.is_(i, ">"):
                depth -= 1
                if not depth:
                    return i + 1
            elif self.is_(i, ";", "}"):
                return i
            i = self.after(i) if not self.is_(i, "<", ">") else i + 1
        return i

    def body_of(self, i: int, stop: int) -> tuple[int | None, int | None, int]:
        """From the token after a function's name: (bracket of its parameters, brace of its body, last token)."""
        if self.is_(i, "<"):
            i = self.type_end(i)
        if not self.is_(i, "("):
            return None, None, i - 1
        params, i = i, self.after(i)
        if self.is_(i, ":"):
            i += 1
            first = True
            while i < stop and not self.is_(i, ";"):
                if self.is_(i, "{") and not first and not self.is_(i - 1, "|", "&", "=>", ":", ",", "<", "is", "extends", "?"):
                    break
                if not first and self.breaks(i) and not self.is_(i, "{"):
                    return params, None, i - 1
                first = False
                i = self.type_end(i) if self.is_(i, "<") else self.after(i)
        if self.is_(i, "{"):
            return params, i, self.t.match[i]
        return params, None, i if self.is_(i, ";") else i - 1

    def skip_decorators(self, i: int) -> int:
        while self.is_(i, "@"):
            i += 2
            while self.is_(i, "."):
                i += 2
            if self.is_(i, "("):
                i = self.after(i)
        return i

    def members(self, brace: int) -> Iterator[tuple[str | None, str, int, int]]:
        """(name or null, method|property, first token, last token) of a class's members."""
        i, stop = brace + 1, self.t.match[brace]
        while i < stop:
            if self.is_(i, ";"):
                i += 1
                continue
            first, i, access = i, self.skip_decorators(i), False
            while self.t.kind[i] == "id" and not self.is_(i + 1, "(", "=", ";", "}", ":", "?", "!", "<") and i + 1 < stop and (self.t.text[i] in _MODIFIERS or self.t.text[i] in ("get", "set")):
                access |= self.t.text[i] in ("get", "set")
                i += 1
            if self.is_(i, "{"):  # a static block
                i = self.after(i)
                continue
            i += self.is_(i, "*")
            name = self.t.text[i] if self.t.kind[i] == "id" and self.t.text[i][0] != "#" else None
            i = self.after(i)
            i += self.is_(i, "?", "!")
            if self.is_(i, "(", "<"):
                _, _, last = self.body_of(i, stop)
                yield (None if name == "constructor" and not access else name), "method", first, last
            else:
                last = first
                while i < stop and not self.is_(i, ";") and not (i > first + 1 and self.breaks(i)):
                    last, i = self.after(i) - 1, self.after(i)
                last = max(last, i - 1)
                yield name, "property", first, last
            i = max(last + 1, first + 1)

    @cached_property
    def classes(self) -> list[tuple[str | None, int, int, bool]]:
        """(name, first token, brace) of every class, and whether it is a declaration."""
        out = []
        for i in range(self.n):
            if self.t.kind[i] == "id" and self.t.text[i] == "class" and not self.is_(i - 1, ".", "?."):
                j, name = i + 1, None
                if j < self.n and self.t.kind[j] == "id" and self.t.text[j] not in ("extends", "implements"):
                    name, j = self.t.text[j], j + 1
                while j < self.n and not self.is_(j, "{"):
                    j = self.type_end(j) if self.is_(j, "<") else self.after(j)
                if j < self.n:
                    declared = i == 0 or self.is_(i - 1, ";", "{", "}", "export", "default", "abstract", "declare", ")") or self.breaks(i)
                    out.append((name, i, j, declared))
        return out

    @cached_property
    def method_names(self) -> set[int]:
        """Tokens that name a method of a class or an object, and so are no callees."""
        out = set()
        for _, _, brace, _ in self.classes:
            for _, kind, first, last in self.members(brace):
                if kind == "method":
                    i = self.skip_decorators(first)
                    while i < last and not self.is_(i + 1, "(", "<"):
                        i += 1
                    out.add(i)
        for i in range(1, self.n - 1):
            if self.word[i + 1] == "(" and self.t.kind[i] in ("id", "str") and self.is_(i - 1, "{", ",", "async", "get", "set", "*") and self.is_(self.t.match[i + 1] + 1, "{"):
                out.add(i)
        return out

    @cached_property
    def functions(self) -> list[tuple[int, int]]:
        """First and last token of everything like a function."""
        out = []
        for i in range(self.n):
            text = self.t.text[i]
            if self.t.kind[i] == "id" and text == "function" and not self.is_(i - 1, "."):
                j = i + 1 + self.is_(i + 1, "*")
                j += self.name(j) is not None
                out.append((i, self.body_of(j, self.n)[2]))
            elif self.t.kind[i] == "p" and text == "=>":
                first = self.t.match.get(i - 1, i - 1)
                j = i + 1
                if self.is_(j, "{"):
                    last = self.t.match[j]
                else:
                    while j < self.n and not self.is_(j, ",", ";", ")", "]", "}") and not (j > i + 1 and self.breaks(j)):
                        j = self.after(j)
                    last = j - 1
                out.append((min(first, i), last))
            elif i in self.method_names:
                out.append((i, self.body_of(i + 1, self.n)[2]))
        return out

    def chain_from(self, i: int) -> tuple[list[str], int]:
        """The names of ``a.b.c`` from token ``i`` on, and the last token of it."""
        names = [self.t.text[i]]
        while self.is_(i + 1, ".", "?.") and i + 2 < self.n and self.t.kind[i + 2] == "id":
            names.append(self.t.text[i + 2])
            i += 2
        return names, i

    @cached_property
    def types(self) -> list[tuple[int, int]]:
        """First and last token of interfaces and type aliases, in which nothing is called."""
        out = []
        for i in range(self.n if self.typed else 0):
            if self.t.kind[i] != "id" or self.is_(i - 1, ".", "?.") or not self.name(i + 1):
                continue
            if self.t.text[i] == "interface":
                j = i + 1
                while j < self.n and not self.is_(j, "{"):
                    j += 1
                out.append((i, self.t.match.get(j, i)))
            elif self.t.text[i] == "type" and self.is_(i + 2, "=", "<"):
                out.append((i, self.statement_end(i, self.n)))
        return out

    @cached_property
    def calls(self) -> list[Call]:
        """Calls and new expressions whose callee is a chain of names, in the order of the text."""
        out = []
        silent = {k for a, b in self.types for k in range(a, b + 1)}
        for i in range(self.n):
            if self.t.kind[i] != "id" or i in silent or self.is_(i - 1, ".", "?.", "function") or (self.is_(i - 1, "*") and self.is_(i - 2, "function")) or i in self.method_names or self.t.text[i] in ("class", "interface"):
                continue
            new = self.is_(i - 1, "new")
            if self.t.text[i] in KEYWORDS and self.t.text[i] not in ("this", "import"):
                continue
            names, last = self.chain_from(i)
            # a call may follow any prefix of the chain only at its end, as brackets end a chain
            j = last + 1 + self.is_(last + 1, "?.")
            if self.typed and self.is_(j, "<"):
                after = self.type_end(j)
                if after < j + 40 and self.is_(after, "("):
                    j = after
            if self.is_(j, "("):
                out.append(Call(i - new, last, j, new, names, self.t.match[j]))
            elif new:
                out.append(Call(i - 1, last, None, True, names, last))
        return out

    def arguments(self, call: Call) -> list[tuple[int, int]]:
        """First and last token of each argument."""
        if call.open is None:
            return []
        match, word = self.t.match, self.word
        out, i, stop = [], call.open + 1, match[call.open]
        while i < stop:
            first = i
            while i < stop and word[i] != ",":
                j = match.get(i, i)
                i = (j if j > i else i) + 1
            if i > first:
                out.append((first, i - 1))
            i += 1
        return out

    def literal(self, span: tuple[int, int] | None) -> str | None:
        """A string, or a template without expressions."""
        if span is None:
            return None
        a, b = span
        if a == b and self.t.kind[a] == "str":
            return self.t.text[a]
        if self.is_(a, "`") and b == a + 2 and self.t.match.get(a) == b:
            return self.t.text[a + 1]
        return None

    def string_argument(self, call: Call) -> int | None:
        """The token of the first argument where it is a string."""
        args = self.arguments(call)
        return args[0][0] if args and args[0][0] == args[0][1] and self.t.kind[args[0][0]] == "str" else None

    # --- imports -------------------------------------------------------------------------------

    def named(self, brace: int) -> list[tuple[str, str, bool]]:
        """(name there, name here, type only) of a list in braces."""
        out, i, stop = [], brace + 1, self.t.match[brace]
        while i < stop:
            first = i
            while i < stop and not self.is_(i, ","):
                i += 1
            words = [self.t.text[k] for k in range(first, i)]
            only = words[:1] == ["type"] and len(words) in (2, 4) and words[1] != "as" or len(words) == 4
            words = words[1:] if only else words
            if words:
                out.append((words[0], words[-1], only))
            i += 1
        return out

    @cached_property
    def import_list(self) -> list[dict]:
        """Every import: specifier token, flags, and for statements what they bind (default, names, namespace)."""
        out = []
        for i in range(self.n):
            word = self.t.text[i]
            if word not in ("import", "export") or self.t.kind[i] != "id" or self.is_(i - 1, ".", "?."):
                continue
            if word == "import" and not self.is_(i + 1, "(", "."):
                j, only, bound = i + 1, False, {"default": None, "names": [], "namespace": None}
                if self.is_(j, "type") and not self.is_(j + 1, "from", ",", "=") or self.is_(j, "type") and self.is_(j + 1, "from") and self.is_(j + 2, "from"):
                    only, j = True, j + 1
                if self.name(j) and not self.is_(j, "from") or self.is_(j, "from") and self.is_(j + 1, "from", ","):
                    bound["default"], j = self.t.text[j], j + 1
                    j += self.is_(j, ",")
                if self.is_(j, "*"):
                    bound["namespace"], j = self.t.text[j + 2], j + 3
                elif self.is_(j, "{"):
                    bound["names"], j = self.named(j), self.t.match[j] + 1
                    only |= bound["default"] is None and bool(bound["names"]) and all(x[2] for x in bound["names"])
                j += self.is_(j, "from")
                if j < self.n and self.t.kind[j] == "str":
                    out.append({"at": j, "type_only": only, "bound": bound})
            elif word == "export" and self.is_(i + 1, "*", "{", "type"):
                j = i + 1
                only = self.is_(j, "type") and self.is_(j + 1, "*", "{")
                j += only
                if self.is_(j, "*"):
                    j += 1
                    j += 2 * self.is_(j, "as")
                elif self.is_(j, "{"):
                    names = self.named(j)
                    only |= bool(names) and all(x[2] for x in names)
                    j = self.t.match[j] + 1
                else:
                    continue
                if self.is_(j, "from") and j + 1 < self.n and self.t.kind[j + 1] == "str":
                    out.append({"at": j + 1, "type_only": only})
        for c in self.calls:
            if not c.new and c.chain in (["import"], ["require"], ["jest", "mock"]) and c.last + 1 == c.open and (at := self.string_argument(c)) is not None:
                out.append({"at": at, "type_only": False, "mocked": c.chain[0] == "jest", "dynamic": c.chain[0] == "import"})
        return sorted(out, key=lambda x: x["at"])

    def imports(self) -> list[Fact]:
        out = []
        for x in self.import_list:
            said, line = self.t.text[x["at"]], self.first_line(x["at"])
            flags = {k: True for k in ("type_only", "mocked", "dynamic") if x.get(k)}
            out.append(Fact("import-edge", line, self.last_line(x["at"]), [(f"js-module:{said}", "module")], {"specifier": said, **flags}, False))
        return out

    # --- symbols -------------------------------------------------------------------------------

    @cached_property
    def declared(self) -> dict[str, tuple[int, int, bool, str]]:
        """name -> (first line, last line, exported, what) of the declarations at the top, the last of a name."""
        out: dict[str, tuple[int, int, bool, str]] = {}

        def add(name: str, first: int, last: int, exported: bool, what: str) -> None:
            out[name] = (self.first_line(first), self.last_line(last), exported or (name in out and out[name][2]), what)

        self.reexports: list[int] = []
        i = 0
        while i < self.n:
            if not (i == 0 or self.is_(i - 1, ";", "}", ")") or self.t.kind[i - 1] == "str" or self.breaks(i)):
                i = self.after(i)
                continue
            first, j = i, self.skip_decorators(i)
            words = set()
            while self.is_(j, "export", "default", "declare", "abstract", "async") and not self.is_(j + 1, "=", "(", ".", ",", ";", "=>"):
                words.add(self.t.text[j])
                j += 1
                j = self.skip_decorators(j)
            exported = "export" in words
            if self.is_(j, "function"):
                k = j + 1 + self.is_(j + 1, "*")
                name = self.name(k)
                last = self.body_of(k + (name is not None), self.n)[2]
                if name or "default" in words:
                    add(name or "default", first, last, exported or not name, "function")
                i = last + 1
            elif self.is_(j, "class"):
                found = next((c for c in self.classes if c[1] == j), None)
                if found is None:
                    i = j + 1
                    continue
                name, _, brace, _ = found
                last = self.t.match[brace]
                if name or "default" in words:
                    add(name or "default", first, last, exported or not name, "class")
                if name:
                    for member, kind, a, b in self.members(brace):
                        if kind == "method" and member:
                            add(f"{name}#{member}", a, b, False, "method")
                i = last + 1
            elif (self.is_(j, "interface") and self.name(j + 1)) or (self.is_(j, "enum") and self.name(j + 1)) or (self.is_(j, "const") and self.is_(j + 1, "enum")):
                k = j + 1 + self.is_(j, "const")
                name = self.t.text[k]
                while k < self.n and not self.is_(k, "{"):
                    k = self.type_end(k) if self.is_(k, "<") else k + 1
                last = self.t.match.get(k, self.n - 1)
                add(name, first, last, exported, "type")
                i = last + 1
            elif self.is_(j, "type") and self.name(j + 1) and self.is_(j + 2, "=", "<"):
                last = self.statement_end(j, self.n)
                add(self.t.text[j + 1], first, last, exported, "type")
                i = last + 1
            elif self.is_(j, "const", "let", "var"):
                last = self.statement_end(j, self.n)
                for name in self.declarators(j + 1, last):
                    add(name, first, last, exported, "variable")
                i = last + 1
            elif exported and "default" in words or self.is_(i, "export") and self.is_(i + 1, "=", "default"):
                last = self.statement_end(j, self.n)
                add("default", first, last, True, "value")
                i = last + 1
            elif self.is_(i, "export") and self.is_(i + 1, "{", "type") and self.is_(i + 1 + self.is_(i + 1, "type"), "{"):
                self.reexports.append(i + 1 + self.is_(i + 1, "type"))
                i = self.statement_end(i, self.n) + 1
            else:
                i = self.after(i)
        return out

    def declarators(self, i: int, last: int) -> list[str]:
        out, fresh = [], True
        while i <= last:
            if fresh and (name := self.name(i)):
                out.append(name)
            fresh = self.is_(i, ",")
            i = self.type_end(i) if self.typed and self.is_(i, "<") and self.is_(i - 2, ":") else self.after(i)
        return out

    def symbols(self) -> list[Fact]:
        found = {name: x[:3] for name, x in self.declared.items()}
        for brace in self.reexports:
            i, stop = brace + 1, self.t.match[brace]
            while i < stop:
                first = i
                while i < stop and not self.is_(i, ","):
                    i += 1
                if i > first:
                    k = first + (self.is_(first, "type") and i - first in (2, 4))
                    local, shown = self.t.text[k], self.t.text[i - 1]
                    found[shown] = (*found[local][:2], True) if local in found else (self.first_line(first), self.last_line(i - 1), True)
                i += 1
        return [Fact("symbol-def", a, b, [(f"js-symbol:{self.path}:{name}", "subject")], {"name": name, "exported": e}) for name, (a, b, e) in found.items()]

    def uses(self) -> list[Fact]:
        """Calls, constructions and elements of imported or own names; those of imports carry the specifier and the name there."""
        names: dict[str, tuple[str, str]] = {}
        spaces: dict[str, str] = {}
        for x in self.import_list:
            if "bound" not in x:
                continue
            said, b = self.t.text[x["at"]], x["bound"]
            if b["default"]:
                names[b["default"]] = (said, "default")
            for there, here, _ in b["names"]:
                names[here] = (said, there)
            if b["namespace"]:
                spaces[b["namespace"]] = said
        own = {name for name, x in self.declared.items() if x[3] in ("function", "class", "variable") and name != "default"}
        methods = {name: {m for m, kind, _, _ in self.members(brace) if kind == "method" and m} for name, _, brace, declared in self.classes if name and declared}
        bodies = [(at, self.t.match[brace], name) for name, at, brace, declared in self.classes if name and declared]
        seen, out = set(), []

        def record(target: tuple[str | None, str], first: int, last: int) -> None:
            if target not in seen:
                seen.add(target)
                said, name = target
                anchors = [(f"js-symbol:{self.path}:{name}", "target")] if said is None else []
                out.append(Fact("symbol-use", self.t.line(first), self.t.line(last), anchors, {"name": name, **({} if said is None else {"specifier": said})}, said is None))

        def of(chain: list[str], first: int, last: int) -> None:
            if len(chain) == 1:
                if chain[0] in names:
                    record(names[chain[0]], first, last)
                elif chain[0] in own:
                    record((None, chain[0]), first, last)
            elif len(chain) == 2 and chain[0] in spaces:
                record((spaces[chain[0]], chain[1]), first, last)

        found = [(c.at, c) for c in self.calls] + [(i, None) for i in self.t.tag_end]
        for i, c in sorted(found, key=lambda x: x[0]):
            if c is None:
                of(self.t.text[i].split("."), self.t.start[i], self.t.tag_end[i])
            elif c.chain[0] == "this":
                holder = max(((a, name) for a, b, name in bodies if a <= i <= b), default=(0, None))[1]
                if not c.new and len(c.chain) == 2 and c.chain[1] in methods.get(holder, ()):
                    record((None, f"{holder}#{c.chain[1]}"), self.t.start[c.at], self.t.end[c.end])
            elif c.chain[0] != "import":
                of(c.chain, self.t.start[c.at], self.t.end[c.end])
        return out

    # --- the wp global -------------------------------------------------------------------------

    def global_symbols(self, framework: str | None) -> list[Fact]:
        """Definitions and uses of members of ``wp``; ``framework`` is "" where it is not known."""
        chains = []
        for i in range(self.n):
            if self.t.kind[i] == "id" and self.t.text[i] in ("wp", "window") and not self.is_(i - 1, ".", "?."):
                names, last = self.chain_from(i)
                if names[0] == "window":
                    names = names[1:]
                if len(names) > 1 and names[0] == "wp":
                    chains.append((i, last, names, self.is_(last + 1, "=")))
        direct = {".".join(n) for _, _, n, assigned in chains if len(n) == 2 and not assigned}
        local: dict[str, list[str]] = {}
        # members of other names count where one is assigned to a global
        for i in range(self.n if chains else 0):
            if self.name(i) and not self.is_(i - 1, ".", "?."):
                names, last = self.chain_from(i)
                if len(names) > 1 and names[0] not in ("wp", "window") and self.is_(last + 1, "="):
                    local.setdefault(names[0], []).append(".".join(names[1:]))
        seen, out = set(), []

        def emit(kind: str, name: str, first: int, last: int) -> None:
            key = (kind, name, self.t.start[first] if kind == "symbol-use" and framework else None)
            if key not in seen:
                seen.add(key)
                payload = {"name": name, "exported": True} if kind == "symbol-def" else {"name": name}
                out.append(Fact(kind, self.first_line(first), self.last_line(last), [(f"js-global:{name}", "target" if kind == "symbol-def" else "subject")], payload))

        for i, last, names, assigned in chains:
            prefixes = [".".join(names[: k + 2]) for k in range(len(names) - 1)]
            depth = sum(a <= i <= b for a, b in self.functions)
            if assigned and framework != "qunit" and depth <= 1:
                for p in prefixes:
                    emit("symbol-def", p, i, last)
                value, root = last + 2, ".".join(names)
                if self.is_(value, "{"):
                    for first, end, key in self.properties(value):
                        emit("symbol-def", f"{root}.{key}", first, end)
                elif self.name(value) and not self.is_(value + 1, ".", "?.", "(", "["):
                    for member in dict.fromkeys(local.get(self.t.text[value], ())):
                        emit("symbol-def", f"{root}.{member}", i, last)
            elif not assigned and framework in ("", "qunit"):
                root = ".".join(names[:2])
                for p in prefixes[-2:]:
                    if p != root or len(names) == 2 or root in direct:
                        emit("symbol-use", p, i, last)
        return out

    def properties(self, brace: int) -> Iterator[tuple[int, int, str]]:
        """(first token, last token, name) of an object's properties that have plain names."""
        i, stop = brace + 1, self.t.match[brace]
        while i < stop:
            first = i
            while i < stop and not self.is_(i, ","):
                i = self.after(i)
            k = first
            while k + 1 < i and self.is_(k, "async", "get", "set", "*") and not self.is_(k + 1, ":", "(", ","):
                k += 1
            if i > first and self.t.kind[k] in ("id", "str") and not self.is_(first, "..."):
                yield first, i - 1, self.t.text[k]
            i += 1

    # --- tests ---------------------------------------------------------------------------------

    def tests(self, framework: str | None) -> list[Fact]:
        if framework in (None, "", "phpunit"):
            return []
        out: list[Fact] = []

        def emit(call: Call, scope: list[str], ranges: list[dict]) -> None:
            args = self.arguments(call)
            title = self.literal(args[0] if args else None)
            test_id = f"{framework}:{self.path}::{' > '.join([*scope, '<dynamic>' if title is None else title])}"
            payload = {"framework": framework, "testId": test_id, **({} if title is None else {"title": title}), **({"meta": {"scopeRanges": ranges}} if ranges else {})}
            out.append(Fact("test-def", self.first_line(call.at), self.last_line(call.end), [(f"test:{test_id}", "subject")], payload, title is not None))

        at = {c.at: c for c in self.calls if not c.new and c.open is not None}
        if framework == "qunit":
            self._qunit(at, 0, self.n, [], [], emit)
        else:
            self._walk(at, 0, self.n, [], [], emit)
        return out

    def callback(self, call: Call) -> tuple[int, int] | None:
        """The tokens of the body of the function that is the second argument."""
        args = self.arguments(call)
        if len(args) < 2:
            return None
        a, b = args[1]
        a += self.is_(a, "async") and not self.is_(a + 1, "=>", ",", ")")
        if self.is_(a, "function"):
            k = a + 1 + self.is_(a + 1, "*")
            k += self.name(k) is not None
            body = self.body_of(k, self.n)[1]
            return (body, self.t.match[body]) if body is not None else None
        i = a
        while i <= b and not self.is_(i, "=>"):
            i = self.type_end(i) if self.is_(i, "<") else self.after(i)
        return (i + 1, b) if i < b else None

    def _range(self, call: Call) -> dict:
        return {"startLine": self.first_line(call.at), "endLine": self.last_line(call.end)}

    def _walk(self, at, i: int, stop: int, scope: list[str], ranges: list[dict], emit) -> None:
        while i < stop:
            call = at.get(i)
            what = test_name(call.chain) if call else None
            if what == "describe":
                args = self.arguments(call)
                title, body = self.literal(args[0] if args else None), self.callback(call)
                if body:
                    self._walk(at, body[0], body[1] + 1, [*scope, "<dynamic>" if title is None else title], [*ranges, self._range(call)], emit)
                i = call.end + 1
            elif what:
                emit(call, scope, ranges)
                i = call.end + 1
            else:
                i += 1

    def _qunit(self, at, i: int, stop: int, inherited: list[str], ranges: list[dict], emit) -> None:
        """The statements of a block: a module without a callback names those after it."""
        scope, begin = list(inherited), i
        while i < stop:
            call = at.get(i)
            starts = i == begin or self.is_(i - 1, ";", "}", "{") or self.breaks(i)
            alone = call is not None and starts and (call.end + 1 >= stop or self.is_(call.end + 1, ";", "}") or self.breaks(call.end + 1))
            if alone and call.chain in (["QUnit", "module"], ["QUnit", "test"]):
                if call.chain[1] == "test":
                    emit(call, scope, ranges)
                else:
                    args = self.arguments(call)
                    title, body = self.literal(args[0] if args else None) or "<dynamic>", self.callback(call)
                    if body and self.is_(body[0], "{"):
                        self._qunit(at, body[0] + 1, body[1], [*inherited, title], [*ranges, self._range(call)], emit)
                    else:
                        scope = [*inherited, title]
                i = call.end + 1
            elif self.is_(i, "{"):
                self._qunit(at, i + 1, self.t.match[i], scope, ranges, emit)
                i = self.after(i)
            else:
                i += 1

    def facts(self, framework: str | None) -> list[Fact]:
        return [*self.imports(), *self.symbols(), *self.uses(), *self.global_symbols(framework if framework is not None else ""), *self.tests(framework)]


def test_name(chain: list[str]) -> str | None:
    """describe, test or it, where a chain of names declares one."""
    root, rest = chain[0], chain[1:]
    if root in ("test", "it") and rest[:1] == ["describe"]:
        root, rest = "describe", rest[1:]
    if root == "describe":
        return root if GROUP_MODIFIERS.issuperset(rest) else None
    return root if root in ("test", "it") and TEST_MODIFIERS.issuperset(rest) else None
