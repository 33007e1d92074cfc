"""Token streams of the bundled languages, fed to their parsers; each `check_*` gives the first error or None.

An error is (offset, what): the first place at which no continuation can make the text a sentence.
"""

from __future__ import annotations

import re

from .glr import END, Parser, tables

Error = tuple[int, str]


class _Bad(Exception):
    """A place where no token begins."""


def _feed_all(parser: Parser, stream, size: int) -> Error | None:
    try:
        for kind, at in stream:
            if not parser.feed(kind):
                return at, f"unexpected {kind}"
    except _Bad as e:
        return e.args[0], e.args[1]
    return None if parser.feed(END) else (size, "unexpected end of file")


# --- JSON ---------------------------------------------------------------------------------------

_JSON = re.compile(r'[ \t\r\n]+|(?P<STRING>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<NUMBER>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|(?P<op>true\b|false\b|null\b|[\[\]{},:])', re.A)


def check_json(text: str) -> Error | None:
    return _feed_all(Parser(tables("json")), _simple(_JSON, text), len(text))


def _simple(pattern: re.Pattern, text: str):
    at, size = 0, len(text)
    while at < size:
        m = pattern.match(text, at)
        if not m or m.end() == at:
            raise _Bad(at, "no token")
        kind = m.lastgroup
        if kind:
            yield (m.group() if kind == "op" else kind), at
        at = m.end()


# --- TOML ---------------------------------------------------------------------------------------

_ESC = r'\\(?:["\\bfnrte]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2})'
_CTRL = r"\x00-\x08\x0a-\x1f\x7f"
_TOML_COMMENT = re.compile(rf"[ \t]+|#[^{_CTRL}]*")
_TOML_NL = re.compile(r"\r?\n")
_TOML_KEY = re.compile(rf"""[A-Za-z0-9_-]+|"(?:[^"\\{_CTRL}]|{_ESC})*"|'[^'{_CTRL}]*'""")
_TOML_VALUE = re.compile(
    rf"""(?P<STRING>\"\"\"(?:[^"\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|{_ESC}|\\[ \t]*\r?\n\s*|"(?!""))*"{{3,5}}|'''(?:[^'\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|'(?!''))*'{{3,5}}|"(?:[^"\\{_CTRL}]|{_ESC})*"|'[^'{_CTRL}]*')"""
    r"""|(?P<DATE>\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?)"""
    r"""|(?P<NUMBER>0x[0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0o[0-7]+(?:_[0-7]+)*|0b[01]+(?:_[01]+)*|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9]\d*(?:_\d+)*)(?:\.\d+(?:_\d+)*)?(?:[eE][+-]?\d+(?:_\d+)*)?)"""
    r"""|(?P<BOOL>true|false)""",
    re.A,
)


def _toml(text: str):
    at, size, depth, key = 0, len(text), [], True
    if text.startswith("\ufeff"):
        at = 1
    line_start = True
    while at < size:
        m = _TOML_COMMENT.match(text, at)
        if m:
            at = m.end()
            continue
        m = _TOML_NL.match(text, at)
        if m:
            if depth and depth[-1] == "{":
                raise _Bad(at, "line break in an inline table")
            yield "NL", at
            at = m.end()
            if not depth:
                key = line_start = True
            continue
        c = text[at]
        if key:
            if line_start and c == "[":
                two = text.startswith("[[", at)
                yield ("[[" if two else "["), at
                at += 2 if two else 1
                line_start = False
                depth.append("h")
                continue
            line_start = False
            if depth and depth[-1] == "h" and c == "]":
                two = text.startswith("]]", at)
                yield ("]]" if two else "]"), at
                at += 2 if two else 1
                depth.pop()
                key = False
                continue
            if c == ".":
                yield ".", at
                at += 1
                continue
            if c == "=":
                yield "=", at
                at += 1
                key = False
                continue
            if c == "}" and depth and depth[-1] == "{":
                depth.pop()
                yield "}", at
                at += 1
                key = False
                continue
            m = _TOML_KEY.match(text, at)
            if not m:
                raise _Bad(at, "no key")
            yield "KEY", at
            at = m.end()
            continue
        if c in "[{":
            depth.append(c)
            key = c == "{"
            yield c, at
            at += 1
            continue
        if c in "]}":
            if depth:
                depth.pop()
            yield c, at
            at += 1
            continue
        if c == ",":
            key = bool(depth) and depth[-1] == "{"
            yield c, at
            at += 1
            continue
        m = _TOML_VALUE.match(text, at)
        if not m or (m.lastgroup != "STRING" and re.match(r"[\w.+-]", text[m.end() : m.end() + 1])):
            raise _Bad(at, "no value")
        yield m.lastgroup, at
        at = m.end()


def check_toml(text: str) -> Error | None:
    return _feed_all(Parser(tables("toml")), _toml(text), len(text))


# --- YAML ---------------------------------------------------------------------------------------

_YAML_BAD = re.compile("[^\x09\x0a\x0d\x20-\x7e\x85\xa0-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_YAML_ESC = re.compile(r"""\\(?:[0abt\tnvfre "/\\N_LP]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|\r?\n)""")
_PLAIN_END = re.compile(r":(?=[ \t\r\n]|\Z)|[ \t]#|[\r\n]")
_PLAIN_END_FLOW = re.compile(r":(?=[ \t\r\n,\[\]{}]|\Z)|[ \t]#|[\r\n]|[,\[\]{}?]")


class _Yaml:
    """The scanner: turns indentation into MAP, SEQ and OUT and finds out what is a key."""

    def __init__(self, text: str):
        self.s, self.at, self.n = text, 0, len(text)
        self.indents: list[tuple[int, str]] = []
        self.flow: list[str] = []
        self.key_ok = True  # a block key or dash may begin here
        self.colon_ok = False  # in a flow collection, after a quoted scalar or bracket, ':' needs no blank
        self.line = 0  # where the line begins

    def column(self, at: int) -> int:
        return at - self.line

    def unwind(self, column: int):
        while self.indents and self.indents[-1][0] > column:
            self.indents.pop()
            yield "OUT", self.at

    def roll(self, column: int, kind: str):
        if not self.indents or self.indents[-1][0] < column:
            self.indents.append((column, kind))
            yield kind, self.at

    def blanks(self) -> bool:
        """Skips blanks, comments and line ends; True if a line end was passed."""
        s, passed = self.s, False
        while self.at < self.n:
            c = s[self.at]
            if c == " " or (c == "\t" and (self.flow or not self.key_ok)):
                self.at += 1
            elif c == "\t":
                rest = re.compile(r"[ \t]*(#|\r?\n|\Z)").match(s, self.at)
                if not rest:
                    raise _Bad(self.at, "tab as indentation")
                self.at = rest.start(1)
            elif c == "#":
                while self.at < self.n and s[self.at] not in "\r\n":
                    self.at += 1
            elif c in "\r\n":
                self.at += 2 if s.startswith("\r\n", self.at) else 1
                self.line = self.at
                passed = True
                if not self.flow:
                    self.key_ok = True
            else:
                break
        return passed

    def marker(self, at: int) -> str | None:
        if self.column(at) == 0 and self.s[at : at + 3] in ("---", "...") and (at + 3 >= self.n or self.s[at + 3] in " \t\r\n"):
            return self.s[at : at + 3]
        return None

    def blank_at(self, at: int) -> bool:
        return at >= self.n or self.s[at] in " \t\r\n"

    def stream(self):
        s = self.s
        if s.startswith("\ufeff"):
            self.at = self.line = 1
        while True:
            self.blanks()
            if self.at >= self.n:
                if self.flow:
                    raise _Bad(self.n, "unexpected end of file")
                yield from self.unwind(-1)
                return
            at, c = self.at, s[self.at]
            if not self.flow:
                yield from self.unwind(self.column(at))
            mark = self.marker(at)
            if mark:
                if self.flow:
                    raise _Bad(at, "document marker in a flow collection")
                yield from self.unwind(-1)
                yield ("START" if mark == "---" else "END"), at
                self.at += 3
                self.key_ok = False
                if mark == "...":
                    self.blanks()
                    self.key_ok = True
                continue
            if c == "%" and self.column(at) == 0 and not self.flow:
                m = re.compile(r"%\w+[^\r\n]*").match(s, at)
                if not m:
                    raise _Bad(at, "no directive")
                yield "DIRECTIVE", at
                self.at = m.end()
                continue
            if c in "[{":
                yield from self.node(at, c)
                continue
            if c in "]}":
                if not self.flow:
                    raise _Bad(at, f"unexpected {c}")
                self.flow.pop()
                self.at += 1
                self.colon_ok = True
                yield c, at
                continue
            if c == "," and self.flow:
                self.at += 1
                self.colon_ok = False
                yield ",", at
                continue
            if c in "-?" and self.blank_at(at + 1) and (c == "?" or not self.flow):
                if not self.flow:
                    if not self.key_ok:
                        raise _Bad(at, f"{c} is not allowed here")
                    if c == "-":
                        top = self.indents[-1] if self.indents else (-1, "")
                        if top[0] < self.column(at):
                            yield from self.roll(self.column(at), "SEQ")
                    else:
                        yield from self.roll(self.column(at), "MAP")
                self.at += 1
                self.key_ok = True
                yield ("ITEM" if c == "-" else "?"), at
                continue
            if c == ":" and (self.blank_at(at + 1) or (self.flow and (self.colon_ok or s[at + 1] in ",[]{}"))):
                if not self.flow and self.key_ok:
                    yield from self.roll(self.column(at), "MAP")
                self.at += 1
                self.key_ok = self.key_ok and not self.flow
                self.colon_ok = False
                yield ":", at
                continue
            yield from self.node(at, c)

    def value_follows(self, at: int) -> bool:
        """Whether ':' stands after a key that ends at `at`."""
        s = self.s
        while at < self.n and s[at] in " \t":
            at += 1
        if at >= self.n or s[at] != ":":
            return False
        return self.blank_at(at + 1) or (bool(self.flow) and (s[at + 1] in ",[]{}" or self.colon_ok))

    def node(self, at: int, c: str):
        """Anchors, tags, aliases and the scalar or collection that follows, with KEY before them if they are a key."""
        s = self.s
        out, begin, line = [], at, self.line
        while c in "&*!":
            m = re.compile(r"[&*][^\s,\[\]{}]+|!<[^>\s]+>|![^\s,\[\]{}]*").match(s, self.at)
            if not m:
                raise _Bad(self.at, f"unexpected {c}")
            out.append(("ALIAS" if c == "*" else "ANCHOR" if c == "&" else "TAG", self.at))
            self.at = m.end()
            if out[-1][0] == "ALIAS":
                break
            while self.at < self.n and s[self.at] in " \t":
                self.at += 1
            c = s[self.at] if self.at < self.n else "\n"
        if out and out[-1][0] == "ALIAS":
            yield from self.emit(begin, line, out)
            return
        if self.at >= self.n or c in "\r\n#" or (self.flow and c in ",]}") or (c == ":" and self.blank_at(self.at + 1)):
            yield from self.emit(begin, line, out)
            return
        if c in "[{":
            # Whether the collection is a key shows only at its end: look ahead on the same line.
            end = self.flow_end(self.at)
            key = end is not None and self.value_after(end)
            if key and not self.flow:
                if not self.key_ok:
                    raise _Bad(begin, "a key is not allowed here")
                yield from self.roll(begin - line, "MAP")
            if key:
                yield "KEY", begin
            yield from out
            yield c, self.at
            self.flow.append(c)
            self.at += 1
            self.key_ok = False
            self.colon_ok = False
            return
        if c in "\"'":
            self.quoted(c)
            out.append(("SCALAR", begin))
            self.colon_ok = True
        elif c in "|>" and not self.flow:
            yield from out
            yield "BLOCK", self.at
            self.block()
            return
        elif c in "%@`" or (c in "|>" and self.flow):
            raise _Bad(self.at, f"unexpected {c}")
        elif c in "-?:" and (self.blank_at(self.at + 1) or (self.flow and s[self.at + 1] in ",[]{}")):
            raise _Bad(self.at, f"unexpected {c}")
        else:
            self.plain()
            out.append(("SCALAR", begin))
            self.colon_ok = False
        yield from self.emit(begin, line, out)

    def emit(self, begin: int, line: int, out: list):
        if self.line == line and self.value_follows(self.at):
            if not self.flow:
                if not self.key_ok:
                    raise _Bad(begin, "a key is not allowed here")
                yield from self.roll(begin - line, "MAP")
            yield "KEY", begin
        elif not self.flow and self.line != line:
            at = self.at
            while at < self.n and self.s[at] in " \t":
                at += 1
            if at < self.n and self.s[at] == ":" and self.blank_at(at + 1):
                raise _Bad(at, "a key must be on one line")
        self.key_ok = self.key_ok and self.at > 0 and self.s[self.at - 1] in "\r\n"
        yield from out

    def value_after(self, at: int) -> bool:
        while at < self.n and self.s[at] in " \t":
            at += 1
        return at < self.n and self.s[at] == ":" and (self.blank_at(at + 1) or bool(self.flow))

    def flow_end(self, at: int) -> int | None:
        depth = 0
        while at < self.n and self.s[at] not in "\r\n":
            c = self.s[at]
            if c in "\"'":
                close = self.s.find(c, at + 1)
                if close < 0:
                    return None
                at = close
            depth += c in "[{"
            depth -= c in "]}"
            at += 1
            if not depth:
                return at
        return None

    def quoted(self, q: str) -> None:
        s, at = self.s, self.at
        self.at += 1
        while self.at < self.n:
            c = s[self.at]
            if c == q:
                if q == "'" and s.startswith("''", self.at):
                    self.at += 2
                    continue
                self.at += 1
                return
            if c == "\\" and q == '"':
                m = _YAML_ESC.match(s, self.at)
                if not m:
                    raise _Bad(self.at, "unknown escape")
                if m.group()[-1] == "\n":
                    self.line = m.end()
                self.at = m.end()
                continue
            self.at += 1
            if c in "\r\n" and not s.startswith("\r\n", self.at - 1):
                self.line = self.at
                if self.marker(self.at):
                    raise _Bad(self.at, "document marker in a quoted scalar")
        raise _Bad(self.n, f"no end of the string that begins at {at}")

    def plain(self) -> None:
        s = self.s
        end = _PLAIN_END_FLOW if self.flow else _PLAIN_END
        least = (self.indents[-1][0] if self.indents else -1) + 1
        while True:
            m = end.search(s, self.at)
            stop = m.start() if m else self.n
            while m and m.group() == "?" and stop > self.at:  # '?' ends a flow scalar only at its start
                m = end.search(s, stop + 1)
                stop = m.start() if m else self.n
            self.at = stop
            if not m or m.group() not in "\r\n" or not m.group():
                return
            # The scalar goes on if the next line with text is indented deeper and is no comment or marker.
            at, line = stop, self.line
            while at < self.n and s[at] in " \t\r\n":
                if s[at] == "\n" or (s[at] == "\r" and not s.startswith("\r\n", at)):
                    line = at + 1
                at += 1
            if at >= self.n or s[at] == "#" or (not self.flow and at - line < least) or (at == line and s[at : at + 3] in ("---", "...") and self.blank_at(at + 3)):
                return
            if self.flow and s[at] in ",[]{}?" or (s[at] == ":" and self.blank_at(at + 1)):
                return
            if not self.flow and "\t" in s[line:at] and s[line : line + least].strip(" "):
                return
            self.line, self.at = line, at
            nxt = end.match(s, at)
            if nxt and nxt.start() == at and nxt.group() != "?":
                return

    def block(self) -> None:
        s = self.s
        m = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-]?)(?:[ \t]+#[^\r\n]*|[ \t]*)(\r?\n|\Z)").match(s, self.at)
        if not m:
            raise _Bad(self.at + 1, "no header of a block scalar")
        digit = re.search(r"[1-9]", m.group().split("#")[0])
        self.at = m.end()
        self.line = self.at
        parent = self.indents[-1][0] if self.indents else -1
        need = max(parent, 0) + int(digit.group()) if digit else None
        while self.at < self.n:
            stop = s.find("\n", self.at)
            stop = self.n if stop < 0 else stop + 1
            text = s[self.at : stop]
            body = text.strip("\r\n")
            lead = len(body) - len(body.lstrip(" "))
            if body.strip(" "):
                if need is None:
                    need = max(lead, parent + 1)
                if lead < need or self.marker_text(body):
                    break
            self.at = self.line = stop
        self.key_ok = True

    @staticmethod
    def marker_text(body: str) -> bool:
        return body[:3] in ("---", "...") and (len(body) == 3 or body[3] in " \t")


def check_yaml(text: str) -> Error | None:
    bad = _YAML_BAD.search(text)
    if bad and not (bad.start() == 0 and bad.group() == "\ufeff"):
        return bad.start(), "control character"
    return _feed_all(Parser(tables("yaml")), _Yaml(text).stream(), len(text))


# --- Python -------------------------------------------------------------------------------------

#: The reserved words of the language.
_PY_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split())
_PY_TOKEN = re.compile(
    r"(?P<num>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
    r"|(?P<str>(?P<pre>[rR][bBfF]?|[bBfF][rR]?|[uU])?(?P<q>\"\"\"|'''|\"|'))"
    r"|(?P<name>[^\W\d]\w*)"
    r"|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|==|!=|<=|>=|<<|>>|\*\*|//|[-+*/%@&|^~<>()\[\]{},:;.=!])"
)
_PY_AUGMENTED = frozenset("**= //= >>= <<= += -= *= /= %= @= &= |= ^=".split())
_PY_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)\b")
_PY_ESC_U = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?![0-9a-fA-F]{8})|N(?!\{[^}]+\}))")


class _Python:
    def __init__(self, text: str):
        self.s, self.n, self.at = text, len(text), 0

    def stream(self):
        s, n = self.s, self.n
        self.at = 1 if s.startswith("\ufeff") else 0
        indents, depth, fresh, some = [(0, 0)], 0, True, False
        while True:
            if fresh:
                col = alt = 0
                while self.at < n and s[self.at] in " \t\f":
                    c = s[self.at]
                    col, alt = (col + 1, alt + 1) if c == " " else ((col // 8 + 1) * 8, alt + 1) if c == "\t" else (0, 0)
                    self.at += 1
                if self.at < n and s[self.at] in "#\r\n":
                    self.line_end()
                    continue
                if self.at >= n:
                    break
                if s[self.at] == "\\" and re.match(r"\r?\n", s[self.at + 1 : self.at + 3]):
                    self.at += 3 if s[self.at + 1] == "\r" else 2
                    continue
                if col > indents[-1][0]:
                    if alt <= indents[-1][1]:
                        raise _Bad(self.at, "tabs and spaces are mixed")
                    indents.append((col, alt))
                    yield "INDENT", self.at
                else:
                    while col < indents[-1][0]:
                        indents.pop()
                        yield "DEDENT", self.at
                    if col != indents[-1][0]:
                        raise _Bad(self.at, "no such indentation")
                    if alt != indents[-1][1]:
                        raise _Bad(self.at, "tabs and spaces are mixed")
                fresh = False
            if self.at >= n:
                break
            c = s[self.at]
            if c in " \t\f":
                self.at += 1
            elif c in "#\r\n":
                at = self.at
                if c == "#":
                    while self.at < n and s[self.at] not in "\r\n":
                        self.at += 1
                    continue
                self.line_end()
                if not depth:
                    yield "NEWLINE", at
                    fresh = True
            elif c == "\\":
                m = re.compile(r"\\\r?\n").match(s, self.at)
                if not m or m.end() >= n:
                    raise _Bad(self.at, "backslash")
                self.at = m.end()
            else:
                some = True
                for kind, at in self.token():
                    depth += kind in ("(", "[", "{")
                    depth -= kind in (")", "]", "}")
                    if depth < 0:
                        raise _Bad(at, f"unexpected {kind}")
                    yield kind, at
        if some and not fresh:
            if depth:
                raise _Bad(n, "unexpected end of file")
            yield "NEWLINE", n
        for _ in indents[1:]:
            yield "DEDENT", n

    def line_end(self) -> None:
        s = self.s
        while self.at < self.n and s[self.at] not in "\r\n":
            self.at += 1
        if self.at < self.n:
            self.at += 2 if s.startswith("\r\n", self.at) else 1

    def token(self):
        s, at = self.s, self.at
        m = _PY_TOKEN.match(s, at)
        if not m:
            raise _Bad(at, "no token")
        kind = m.lastgroup if m.group("str") is None else "str"
        if kind == "str":
            yield from self.string(at, (m.group("pre") or "").lower(), m.group("q"), m.end())
            return
        self.at = m.end()
        t = m.group()
        if kind == "num":
            nxt = s[self.at : self.at + 1]
            if (nxt.isalnum() or nxt == "_") and not _PY_AFTER_NUMBER.match(s, self.at):
                raise _Bad(at, "bad number")
            if re.fullmatch(r"0[\d_]*[1-9][\d_]*", t):
                raise _Bad(at, "leading zero")
            yield "NUMBER", at
        elif kind == "name":
            if t in _PY_WORDS:
                yield t, at
            elif not t.isascii() and not t.isidentifier():
                raise _Bad(at, "no name")
            else:
                yield "NAME", at
        else:
            yield ("AUGMENTED" if t in _PY_AUGMENTED else t), at

    def string(self, at: int, prefix: str, quote: str, begin: int):
        s = self.s
        if "f" in prefix:
            yield "FSTART", at
            self.at = begin
            yield from self.pieces(quote, "r" in prefix, False)
            return
        p, triple = begin, len(quote) == 3
        while True:
            if p >= self.n:
                raise _Bad(at, "no end of the string")
            c = s[p]
            if c == "\\":
                if "r" not in prefix and "b" not in prefix and _PY_ESC_U.match(s, p):
                    raise _Bad(p, "bad escape")
                p += 3 if s.startswith("\\\r\n", p) else 2
            elif s.startswith(quote, p):
                break
            elif c in "\r\n" and not triple:
                raise _Bad(at, "no end of the string")
            elif "b" in prefix and c > "\x7f":
                raise _Bad(p, "bytes are ASCII")
            else:
                p += 1
        self.at = p + len(quote)
        yield "BYTES" if "b" in prefix else "STRING", at

    def pieces(self, quote: str, raw: bool, spec: bool):
        """The text and fields of an f-string up to its end, or of a format specification up to its brace."""
        s, triple = self.s, len(quote) == 3
        while True:
            if self.at >= self.n:
                raise _Bad(self.n, "no end of the string")
            c = s[self.at]
            if not spec and s.startswith(quote, self.at):
                yield "FEND", self.at
                self.at += len(quote)
                return
            if spec and c == "}":
                return
            if spec and s.startswith(quote, self.at):
                raise _Bad(self.at, "no end of the field")
            if c in "\r\n" and not triple:
                raise _Bad(self.at, "no end of the string")
            if c == "{" and (spec or not s.startswith("{{", self.at)):
                yield "{", self.at
                self.at += 1
                yield from self.field(quote, raw)
                continue
            if c == "}" and not spec:
                if not s.startswith("}}", self.at):
                    raise _Bad(self.at, "unexpected }")
                self.at += 2
                continue
            if c == "{":
                self.at += 2
                continue
            if c == "\\" and s.startswith("\\N{", self.at) and not raw:
                self.at = s.find("}", self.at) + 1 or self.n
                continue
            self.at += 2 if c == "\\" and s[self.at + 1 : self.at + 2] not in ("{", "}") else 1

    def field(self, quote: str, raw: bool):
        s, depth = self.s, 0
        while True:
            while self.at < self.n and (s[self.at] in " \t\f" or s[self.at] in "\r\n"):
                self.at += 1
            if self.at >= self.n:
                raise _Bad(self.n, "no end of the field")
            c = s[self.at]
            if c == "#":
                self.line_end()
                continue
            if c == "\\" and re.match(r"\\\r?\n", s[self.at : self.at + 3]):
                self.at = s.index("\n", self.at) + 1
                continue
            if depth == 0:
                if c == "}":
                    yield "}", self.at
                    self.at += 1
                    return
                if c == "!" and not s.startswith("!=", self.at):
                    yield "!", self.at
                    self.at += 1
                    continue
                if c == ":":
                    yield ":", self.at
                    self.at += 1
                    yield from self.pieces(quote, raw, True)
                    continue
            for kind, at in self.token():
                depth += kind in ("(", "[", "{")
                depth -= kind in (")", "]", "}")
                yield kind, at


def check_python(text: str) -> Error | None:
    if "\0" in text:
        return text.index("\0"), "null character"
    return _feed_all(Parser(tables("python")), _Python(text).stream(), len(text))


# --- JavaScript and TypeScript ------------------------------------------------------------------

_JS_TOKEN = re.compile(
    r"(?P<skip>[ \t\v\f\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+|//[^\n\r\u2028\u2029]*)|(?P<nl>[\n\r\u2028\u2029]+)|(?P<com>/\*(?:[^*]|\*(?!/))*\*/)"
    r"|(?P<num>0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)"
    r"|(?P<name>(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|[$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)"
    r"|(?P<priv>\#(?:[^\W\d]|[$_])(?:\w|\$)*)"
    r"|(?P<str>\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    r"|(?P<op>\.\.\.|=>|\?\.(?!\d)|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|==|!=|<=|>=|&&|\|\||\?\?|\*\*|<<|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^~!?:;,.(){}\[\]<>=@])"
)
_JS_REGEX = re.compile(r"/(?:[^/\\\[\n\r\u2028\u2029]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/\w*")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_JS_ASSIGN = frozenset("**= <<= &&= ||= ??= += -= *= /= %= &= |= ^=".split())
_JS_OPERATORS = frozenset("=== !== == != <= && || ?? ** << % & | ^".split())
#: Reserved words that the rules do not use otherwise.
_JS_RESERVED = frozenset(["enum"])


def _check_script(text: str, language: str) -> Error | None:
    t = tables(language)
    terminals = t.terminals
    p = Parser(t)
    n, at, newline, last = len(text), 0, False, ""
    braces: list[bool] = []  # True: of a template
    if text.startswith("#!"):
        m = re.compile(r"#![^\n\r]*").match(text)
        at = m.end()
        p.feed("HASHBANG")
    match, feed = _JS_TOKEN.match, p.feed
    while at < n:
        m = match(text, at)
        begin = at
        if m is None:
            if text[at] == "`":
                m = _JS_TEMPLATE.match(text, at + 1)
                if not m:
                    return at, "no end of the template"
                kind = "TEMPLATE" if m.group(1) == "`" else "TSTART"
                if kind == "TSTART":
                    braces.append(True)
                at = m.end()
                tok = kind
            else:
                return at, "no token"
        else:
            group = m.lastgroup
            at = m.end()
            if group == "skip":
                continue
            if group == "nl":
                newline = True
                continue
            tok = m.group()
            if group == "com":
                newline = newline or "\n" in tok
                continue
            if group == "name":
                tok = tok if tok in terminals and tok.islower() else "RESERVED" if tok in _JS_RESERVED else "NAME"
            elif group == "num":
                if at < n and (text[at].isalnum() or text[at] in "_$"):
                    return begin, "bad number"
                tok = "NUMBER"
            elif group == "str":
                tok = "STRING"
            elif group == "priv":
                tok = "PRIVATE"
            elif tok == "{":
                braces.append(False)
            elif tok == "}":
                if braces and braces.pop():
                    m = _JS_TEMPLATE.match(text, at)
                    if not m:
                        return begin, "no end of the template"
                    at = m.end()
                    tok = "TEND" if m.group(1) == "`" else "TMIDDLE"
                    if tok == "TMIDDLE":
                        braces.append(True)
            elif tok in ("/", "/="):
                if text.startswith("/*", begin):
                    return begin, "no end of the comment"
                if not p.can("/" if tok == "/" else "ASSIGN"):
                    m = _JS_REGEX.match(text, begin)
                    if not m:
                        return begin, f"unexpected {tok}"
                    at = m.end()
                    tok = "REGEX"
                elif tok == "/=":
                    tok = "ASSIGN"
            elif tok in _JS_ASSIGN:
                tok = "ASSIGN"
            elif tok in _JS_OPERATORS and tok not in terminals:
                tok = "OPERATOR"
        if newline and (last in ("return", "break", "continue") or tok in ("++", "--")):
            feed("ASI")
        if not feed(tok):
            if not ((newline or tok == "}") and feed("ASI") and feed(tok)):
                return begin, f"unexpected {tok}"
        newline, last = False, tok
    if feed(END) or (feed("ASI") and feed(END)):
        return None
    return n, "unexpected end of file"


def check_javascript(text: str) -> Error | None:
    return _check_script(text, "javascript")


def check_typescript(text: str) -> Error | None:
    return _check_script(text, "typescript")


# --- Rust ---------------------------------------------------------------------------------------

#: The words of the language, reserved or with a meaning in some places.
_RS_WORDS = frozenset(
    "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn box try typeof yield union auto default raw safe".split()
)
_RS_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*)|(?P<com>/\*)|(?P<raw>(?:br|cr|r)(?P<h>\#*)\")|(?P<str>[bc]?\"(?:[^\"\\]|\\[\s\S])*\")|(?P<char>b?'(?:[^'\\\n\r\t]|\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))')"
    r"|(?P<life>'(?:r\#)?[^\W\d]\w*)|(?P<name>(?:r\#)?[^\W\d]\w*)|(?P<float>\d[\d_]*(?:\.\d[\d_]*(?:[eE][+-]?_*\d[\d_]*)?|[eE][+-]?_*\d[\d_]*|\.(?![._\w]))(?:f32|f64|f16|f128)?)|(?P<int>0x[0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0b[01_]+(?:[iu](?:8|16|32|64|128|size))?|0o[0-7_]+(?:[iu](?:8|16|32|64|128|size))?|\d[\d_]*(?:[iu](?:8|16|32|64|128|size)|f32|f64)?)"
    r"|(?P<op>\.\.\.|\.\.=|<<=|\.\.|::|->|=>|==|!=|<=|>=|&&|\|\||<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^~!?:;,.(){}\[\]<>=@\#$_])"
)
_RS_BINARY = frozenset("== != <= << % ^".split())
_RS_ASSIGN = frozenset("<<= += -= *= /= %= &= |= ^=".split())
_RS_COMMENT = re.compile(r"/\*|\*/")


def _rust(text: str):
    at, n = 0, len(text)
    if text.startswith("\ufeff"):
        at = 1
    if text.startswith("#!", at) and not re.match(r"#!\s*\[", text[at:]):
        yield "SHEBANG", at
        at = text.find("\n", at)
        at = n if at < 0 else at
    while at < n:
        m = _RS_TOKEN.match(text, at)
        if not m:
            raise _Bad(at, "no token")
        kind, begin = m.lastgroup, at
        if m.group("raw") is not None:
            close = text.find('"' + m.group("h"), m.end())
            if close < 0:
                raise _Bad(begin, "no end of the string")
            at = close + 1 + len(m.group("h"))
            yield "STRING", begin
            continue
        at = m.end()
        if kind == "skip":
            continue
        t = m.group()
        if kind == "com":
            depth = 1
            while depth:
                c = _RS_COMMENT.search(text, at)
                if not c:
                    raise _Bad(begin, "no end of the comment")
                depth += 1 if c.group() == "/*" else -1
                at = c.end()
        elif kind == "name":
            yield (t if t in _RS_WORDS else "_" if t == "_" else "IDENT"), begin
        elif kind in ("int", "float"):
            if at < n and (text[at].isalnum() or text[at] == "_"):
                raise _Bad(begin, "bad number")
            yield kind.upper(), begin
        elif kind == "op":
            yield ("BINARY" if t in _RS_BINARY else "ASSIGN" if t in _RS_ASSIGN else t), begin
        else:
            yield {"str": "STRING", "char": "CHAR", "life": "LIFETIME"}[kind], begin


def check_rust(text: str) -> Error | None:
    p = Parser(tables("rust"))
    try:
        for kind, at in _rust(text):
            if not p.feed(kind) and not (kind not in "()[]{}" and p.feed("ANY")):
                return at, f"unexpected {kind}"
    except _Bad as e:
        return e.args[0], e.args[1]
    return None if p.feed(END) else (len(text), "unexpected end of file")
