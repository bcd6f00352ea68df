"""Go and TypeScript (or JavaScript) sources read by their tokens: definitions, calls and bracket errors.

There is no parser for these languages here. Comments, strings and templates are told apart from
code, brackets are matched, and declarations are read from the tokens around them. Statements that
are wrong without a wrong bracket or an open string are not found.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

_STRINGS = r'''"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*\''''
_TOKEN = {
    "go": re.compile(rf"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>{_STRINGS}|`[^`]*`)|(?P<open>/\*|[\"'`])|(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<mark>:=|\.\.\.|&&|\|\||<-|[=!<>]=|.)", re.S),
    "ts": re.compile(rf"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>{_STRINGS})|(?P<open>/\*|[\"'])|(?P<name>[^\W\d]\w*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\.\.\.|\?\.|&&|\|\||\?\?|[=!]==?|[<>]=|#?.)", re.S),
}
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_CLOSER = {"(": ")", "[": "]", "{": "}"}
_NOT_CALLED = {
    "go": frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()),
    "ts": frozenset("if for while switch catch function return typeof await async with do else new delete void in of instanceof case throw yield super import class extends".split()),
}
#: After these a word, bracket or slash begins an expression.
_BEFORE_VALUE = frozenset("( [ { } , ; = == === != !== => + - * / % & | ! ~ ? : < > && || ?? ... <= >= return typeof case in of delete void throw new else do".split())


class Token(NamedTuple):
    kind: str  # name, number, text, mark
    text: str
    at: int  # letters before it
    end: int


class Source:
    """Tokens of a source, its matched brackets, and what is wrong with these."""

    def __init__(self, source: str, language: str):
        self.source, self.language = source, language
        self.tokens: list[Token] = []
        self.errors: list[tuple[int, str]] = []  # letters before, message
        self._scan()
        self.match = [-1] * len(self.tokens)
        self.around = [-1] * len(self.tokens)  # the bracket that a token is directly in
        self._pair()
        self.lines = [0]
        self.lines += [m.end() for m in re.finditer("\n", source)]
        self._plain = source.isascii()

    def _template(self, at: int) -> int:
        """The end of a template that begins at a backquote; code in it is scanned as code."""
        i, source = at + 1, self.source
        while i < len(source):
            if source[i] == "\\":
                i += 2
            elif source[i] == "`":
                return i + 1
            elif source.startswith("${", i):
                i = self._scan(i + 2, True)
            else:
                i += 1
        self.errors.append((at, "missing `"))
        return len(source)

    def _scan(self, at: int = 0, inside: bool = False) -> int:
        """Tokens from here on; inside a template up to the brace that ends its code."""
        source, pattern, depth = self.source, _TOKEN[self.language], 0
        while at < len(source):
            if self.language == "ts" and source[at] == "`":
                end = self._template(at)
                self.tokens.append(Token("text", "`", at, end))
                at = end
                continue
            before = self.tokens[-1].text if self.tokens else ";"
            m = _REGEX.match(source, at) if self.language == "ts" and source[at] == "/" and before in _BEFORE_VALUE else None
            if m:
                self.tokens.append(Token("text", m.group(), at, m.end()))
                at = m.end()
                continue
            m = pattern.match(source, at)
            if m.lastgroup == "open":  # a string or comment that doesn't end
                self.errors.append((at, f"missing {'*/' if m.group() == '/*' else m.group()}"))
                at = len(source) if m.group() in ("/*", "`") else (source.find("\n", at) + 1 or len(source))
                continue
            if inside and m.group() in ("{", "}"):
                depth += 1 if m.group() == "{" else -1
                if depth < 0:
                    return m.end()
            if m.lastgroup != "skip":
                self.tokens.append(Token(m.lastgroup, m.group(), at, m.end()))
            at = m.end()
        return at

    def _pair(self) -> None:
        stack: list[int] = []
        for k, t in enumerate(self.tokens):
            self.around[k] = stack[-1] if stack else -1
            if t.kind != "mark":
                continue
            if t.text in _CLOSER:
                stack.append(k)
            elif t.text in _CLOSER.values():
                while stack and _CLOSER[self.tokens[stack[-1]].text] != t.text and any(_CLOSER[self.tokens[o].text] == t.text for o in stack):
                    self.errors.append((t.at, f"missing {_CLOSER[self.tokens[stack.pop()].text]}"))
                if stack and _CLOSER[self.tokens[stack[-1]].text] == t.text:
                    o = stack.pop()
                    self.match[o], self.match[k] = k, o
                    self.around[k] = stack[-1] if stack else -1
                else:
                    self.errors.append((t.at, t.text))
        self.errors += [(len(self.source), f"missing {_CLOSER[self.tokens[o].text]}") for o in reversed(stack)]

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def byte(self, at: int) -> int:
        return at if self._plain else len(self.source[:at].encode())

    def column(self, at: int) -> int:
        """Byte column, from 1."""
        return len(self.source[self.lines[self.line(at) - 1] : at].encode()) + 1

    def text(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) else ""

    def kind(self, k: int) -> str:
        return self.tokens[k].kind if 0 <= k < len(self.tokens) else ""

    def statement_end(self, k: int) -> int:
        """The last token of what begins at k: up to a semicolon, a comma or a line's end outside brackets."""
        last = k
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.kind == "mark" and (t.text in (";", ",") or t.text in _CLOSER.values()):
                return last
            if k > last and self.line(t.at) > self.line(self.tokens[last].end) and self.text(last) not in _BEFORE_VALUE - {"}"} and t.text not in (".", "?.", "=>", "&&", "||", "??", "?", ":", "+", "-", "*", "=", "|", "&"):
                return last
            if t.text in _CLOSER and t.kind == "mark":
                if self.match[k] < 0:
                    return len(self.tokens) - 1
                k = self.match[k]
            last, k = k, k + 1
        return last

    def body_end(self, k: int) -> int | None:
        """The brace that ends the first block after k; braces of types in a signature are passed over."""
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.text == "{" and t.kind == "mark" and self.text(k - 1) not in ("interface", "struct", ":", "|", "<"):
                return self.match[k] if self.match[k] >= 0 else len(self.tokens) - 1
            if t.text in _CLOSER and t.kind == "mark":
                if self.match[k] < 0:
                    return None
                k = self.match[k]
            elif t.text == ";" or self.language == "go" and k and self.line(t.at) > self.line(self.tokens[k - 1].end - 1):
                return None
            k += 1
        return None

    # what the tokens say

    def _declared(self, first: int, name: int, last: int | None, kind: str) -> tuple:
        a, b = self.tokens[first].at, self.tokens[name if last is None else last].end
        return (self.text(name), kind, self.line(a), self.line(a), self.line(b - 1), self.byte(a), self.byte(b))

    def definitions(self) -> list[tuple[str, str, int, int, int, int, int]]:
        """(name, kind, match_line, start_line, end_line, start_byte, end_byte) in document order."""
        out = self._go_definitions() if self.language == "go" else self._ts_definitions()
        return sorted(out, key=lambda d: (d[5], d[0]))

    def _go_definitions(self) -> list[tuple]:
        out = []
        for k, t in enumerate(self.tokens):
            if t.text == "func" and self.around[k] < 0:
                name = k + 1
                if self.text(name) == "(":
                    name = self.match[name] + 1 if self.match[name] >= 0 else len(self.tokens)
                if self.kind(name) == "name" and self.text(name + 1) in ("(", "["):
                    end = self.body_end(name + 1)
                    out.append(self._declared(k, name, self.statement_end(name) if end is None else end, "function"))
            elif t.text == "type" and t.kind == "name" and self.text(k - 1) != ".":
                group = self.text(k + 1) == "(" and self.match[k + 1] >= 0
                at, stop = (k + 2, self.match[k + 1]) if group else (k + 1, k + 2)
                while at < stop:
                    if self.text(at) == ";":
                        at += 1
                        continue
                    if self.kind(at) != "name":
                        break
                    end = self.statement_end(at)
                    if self.text(at + 1) != "=":  # an alias is no type of its own
                        kind = "interface" if "interface" in (self.text(at + 1), self.text(self.match[at + 1] + 1) if self.text(at + 1) == "[" else "") else "type"
                        out.append(self._declared(at, at, end, kind))
                    at = end + 1
        return out

    def _ts_definitions(self) -> list[tuple]:
        out = []
        for k, t in enumerate(self.tokens):
            if t.kind != "name" or self.text(k - 1) in (".", "?."):
                continue
            if t.text == "function":
                first = k - 1 if self.text(k - 1) == "async" else k
                name = k + 1  # a generator is no function declaration
                if self.kind(name) == "name" and (first == 0 or self.text(first - 1) in ("{", "}", ";", "export", "default", ")") or self._on_new_line(first)) and self.text(first - 1) not in ("=", "(", ",", ":", "=>"):
                    out.append(self._declared(first, name, self.body_end(name + 1), "function"))
            elif t.text in ("class", "interface") and self.kind(k + 1) == "name" and self.text(k - 1) not in ("=", "(", ",", ":", "abstract", "return"):
                end = self.body_end(k + 2)
                if end is not None:
                    out.append(self._declared(k, k + 1, end, t.text))
            elif t.text in ("const", "let", "var") and self.text(k + 1) != "enum":
                at = k + 1
                while self.kind(at) == "name":
                    end = self.statement_end(at)
                    if self.text(k - 1) == "(" and self.text(at + 1) in ("of", "in"):
                        end = at
                    out.append(self._declared(at, at, end, "const"))
                    if self.text(end + 1) != ",":
                        break
                    at = end + 2
        return out

    def _on_new_line(self, k: int) -> bool:
        return k == 0 or self.line(self.tokens[k].at) > self.line(self.tokens[k - 1].end - 1)

    def _in_members(self, k: int) -> bool:
        """Whether the token is directly in the braces of a class or an interface."""
        o = self.around[k]
        if o < 0 or self.text(o) != "{":
            return False
        k = o - 1
        while k >= 0 and self.text(k) not in ("{", "}", ";", ")", "=>", "="):
            if self.text(k) in ("class", "interface"):
                return True
            k -= 1
        return False

    def calls(self) -> list[tuple[str, int, int]]:
        """(callee, line, byte column from 1) of calls of names and members, in document order."""
        out = []
        for k, t in enumerate(self.tokens):
            if t.text == "(" and t.kind == "mark" and (name := self._callee(k)) is not None:
                at = self.tokens[name].at
                out.append((self.text(name), self.line(at), self.column(at)))
        return sorted(out, key=lambda c: (c[1], c[2]))

    def _callee(self, k: int) -> int | None:
        """The name that the bracket at k calls, if it is a call's."""
        name, ts = k - 1, self.language == "ts"
        if ts and self.text(name) == "?.":
            name -= 1
        if ts and self.text(name) == ">":  # f<T>(x)
            depth = 0
            while name >= 0 and self.text(name) not in (";", "{", "}", "(", ")", "&&", "||"):
                depth += {">": 1, "<": -1}.get(self.text(name), 0)
                name -= 1
                if not depth:
                    break
        while ts and self.text(name) == "]" and self.match[name] >= 0:  # obj[key](x)
            name = self.match[name] - 1
        if self.text(name) == ")" and self.match[name] >= 0:  # (f)(x)
            inner = self.match[name]
            return name - 1 if self.kind(name - 1) == "name" and (self._on_new_line(inner) or self.kind(inner - 1) not in ("name", "text") and self.text(inner - 1) not in (")", "]")) and all(self.kind(j) == "name" or self.text(j) == "." for j in range(inner + 1, name)) else None
        if self.kind(name) != "name" or self.text(name - 1) not in (".", "?.") and self.text(name) in _NOT_CALLED[self.language]:
            return None
        before, after = self.text(name - 1), self.text(self.match[k] + 1) if self.match[k] >= 0 else ""
        if ts:
            if before in ("function", "#") or before == "*" and self.text(name - 2) == "function" or after == "=>" and before == "async":
                return None
            start = name
            while self.text(start - 1) in (".", "?.") and start > 1:  # new a.b.C() calls nothing
                start -= 2
            if self.text(start - 1) == "new":
                return None
            if before not in (".", "?.") and (after == "{" or self._in_members(name) and before not in ("=", "=>", "(", ",", "?", ":", "!", "@")):
                return None  # a method's head
            return name
        if before == "func" or before == "]" and self.kind(name) == "name" and self.match[name - 1] >= 0 and self.kind(self.match[name - 1] - 1) != "name":
            return None  # a declaration, or a conversion to []T
        if before == ")" and self.match[name - 1] >= 0 and self.text(self.match[name - 1] - 1) == "func" and self.around[name] < 0:
            return None  # a method's declaration
        o = self.around[name]
        if o >= 0 and self.text(o) == "{" and (self.text(o - 1) == "interface") and before != ".":
            return None  # a method of an interface
        return name


def language(path: str) -> str | None:
    ending = path[path.rfind(".") :].lower() if "." in path.rsplit("/", 1)[-1] else ""
    return "go" if ending == ".go" else "ts" if ending in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs") else None
