"""Tokens of JavaScript and TypeScript with their brackets matched.

Templates and elements of markup are groups like brackets, so code inside them is in the
stream and whatever is around them can step over them.
"""

from __future__ import annotations

import re
from bisect import bisect_right

KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield".split()
)
#: Words after which an expression begins.
_BEFORE_VALUE = frozenset("return typeof instanceof in of new delete void throw case do else await yield extends default".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
_PLAIN = re.compile(
    r"(?P<space>[\s\ufeff]+|//[^\n]*|/\*.*?\*/)|(?P<num>(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)n?)"
    r"|(?P<id>#?(?:[^\W\d]|[$\\])(?:\w|[$\u200c\u200d\\])*)|(?P<str>'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\")"
    r"|(?P<p>\?\.(?!\d)|=>|\.\.\.|===|!==|\*\*=|<<=|>>>=|>>=|&&=|\|\|=|\?\?=|==|!=|<=|\*\*|\+\+|--|&&|\|\||\?\?|[-+*/%&|^]=|[-+*/%&|^!<>=?:;,.~@#(){}\[\]])",
    re.DOTALL,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_CHUNK = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.DOTALL)
_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)", re.DOTALL)
_MARKUP = re.compile(r"<(?=[A-Za-z_$>])(?![A-Za-z_$][\w$]*\s*(?:,|extends\b))")
_TAG = re.compile(r"[A-Za-z_$][\w$:.-]*")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|.))", re.DOTALL)
_SHORT = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}


class LexError(ValueError):
    """A text that is no script; ``at``: where."""

    def __init__(self, what: str, at: int):
        super().__init__(what)
        self.at = at


def cooked(raw: str) -> str:
    """What a string's inside stands for."""
    if "\\" not in raw:
        return raw
    return _ESCAPE.sub(lambda m: chr(int(next(x for x in m.groups()[:3] if x), 16)) if any(m.groups()[:3]) else _SHORT.get(m[4], m[4]), raw)


class Tokens:
    """kind, text, start, end of each token; ``match``: the other end of a group.

    Kinds: id, num, str (text is what it stands for), re, chunk (a template's literal part),
    tag (the name of an element that opens) and p.  Groups open and close with p tokens; those
    of templates are `` ` ``, those of elements ``<>`` and ``</>``, of expressions in templates
    and markup braces.
    """

    def __init__(self, text: str, markup: bool):
        self.source, self.markup = text, markup
        self.kind: list[str] = []
        self.text: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.match: dict[int, int] = {}
        #: Ends of the opening tags, by token of the tag.
        self.tag_end: dict[int, int] = {}
        self._lines = [m.end() for m in re.finditer("\n", text)]
        self._code(0, None)

    def __len__(self) -> int:
        return len(self.kind)

    def line(self, at: int) -> int:
        return bisect_right(self._lines, at) + 1

    def _put(self, kind: str, text: str, start: int, end: int) -> int:
        self.kind.append(kind), self.text.append(text), self.start.append(start), self.end.append(end)
        return len(self.kind) - 1

    def _pair(self, a: int, b: int) -> None:
        self.match[a], self.match[b] = b, a

    def value_before(self) -> bool:
        """Whether the last token ends a value, so that ``/`` divides and ``<`` compares."""
        if not self.kind:
            return False
        kind, text = self.kind[-1], self.text[-1]
        return (kind == "id" and text not in _BEFORE_VALUE) or kind in ("num", "str", "re") or (kind == "p" and text in (")", "]", "}", "`", "</>"))

    def _code(self, at: int, until: str | None) -> int:
        """Tokens from ``at`` to the closing brace ``until`` of the group that began before it; where that is."""
        source, held = self.source, []
        match, size = _PLAIN.match, len(source)
        kinds, texts, starts, ends = self.kind, self.text, self.start, self.end
        while at < size:
            c = source[at]
            if c == " ":
                at += 1
                continue
            if c == "`":
                at = self._template(at)
                continue
            if c == "/" and not source.startswith(("//", "/*"), at) and not self.value_before():
                m = _REGEX.match(source, at)
                if m:
                    self._put("re", m[0], at, m.end())
                    at = m.end()
                    continue
            if c == "<" and self.markup and not self.value_before() and _MARKUP.match(source, at):
                at = self._element(at)
                continue
            m = match(source, at)
            if not m or (c == "/" and m[0] == "/" and source.startswith("/*", at)):
                raise LexError("unterminated comment" if c == "/" else "unterminated string" if c in "'\"" else "unexpected character", at)
            kind, word = m.lastgroup, m[0]
            if kind != "space":
                if until and word == until and not held:
                    return at
                i = len(kinds)
                kinds.append(kind), texts.append(cooked(word[1:-1]) if kind == "str" else word), starts.append(at), ends.append(m.end())
                if kind != "p":
                    pass
                elif word in _OPEN:
                    held.append(i)
                elif word in _CLOSE:
                    if not held or self.text[held[-1]] != _CLOSE[word]:
                        raise LexError("unbalanced bracket", at)
                    self._pair(held.pop(), i)
            at = m.end()
        if held:
            raise LexError("bracket is not closed", self.start[held[-1]])
        if until:
            raise LexError("expression is not closed", at)
        return at

    def _braced(self, at: int) -> int:
        """An expression in braces that begins at ``at`` (the brace); the place after it."""
        a = self._put("p", "{", at, at + 1)
        at = self._code(at + 1, "}")
        self._pair(a, self._put("p", "}", at, at + 1))
        return at + 1

    def _template(self, at: int) -> int:
        a, begin = self._put("p", "`", at, at + 1), at
        at += 1
        while True:
            m = _CHUNK.match(self.source, at)
            self._put("chunk", cooked(m[0]), at, m.end())
            at = m.end()
            if at >= len(self.source):
                raise LexError("unterminated template", begin)
            if self.source[at] == "`":
                self._pair(a, self._put("p", "`", at, at + 1))
                return at + 1
            at = self._braced(at + 1)

    def _space(self, at: int) -> int:
        while m := _SPACE.match(self.source, at):
            at = m.end()
        return at

    def _element(self, at: int) -> int:
        source, begin = self.source, at
        a = self._put("p", "<>", at, at + 1)
        at += 1
        m = _TAG.match(source, at)
        tag = self._put("tag", m[0], begin, m.end()) if m else None
        at = m.end() if m else at
        while True:
            at = self._space(at)
            if at >= len(source):
                raise LexError("unterminated element", begin)
            c = source[at]
            if c == "{":
                at = self._braced(at)
            elif source.startswith("/>", at):
                at += 2
                if tag is not None:
                    self.tag_end[tag] = at
                self._pair(a, self._put("p", "</>", at - 1, at))
                return at
            elif c == ">":
                at += 1
                break
            elif c in "'\"":
                close = source.find(c, at + 1)
                if close < 0:
                    raise LexError("unterminated attribute", at)
                at = close + 1
            elif c == "<":
                at = self._element(at)
            else:
                at = m.end() if (m := re.compile(r"[^\s/>{'\"<=]+|=|/").match(source, at)) else at + 1
        if tag is not None:
            self.tag_end[tag] = at
        while True:
            m = re.compile(r"[^<{]*").match(source, at)
            at = m.end()
            if at >= len(source):
                raise LexError("unterminated element", begin)
            if source[at] == "{":
                at = self._braced(at)
            elif m := re.compile(r"</\s*[\w$:.-]*\s*>").match(source, at):
                self._pair(a, self._put("p", "</>", at, m.end()))
                return m.end()
            else:
                at = self._element(at)
