"""Source files that are not valid text of the language that their path names.

Each file is read by the lexical rules of its language into token characters, brackets included, and parsed as a whole by a packrat
parser of the language's parsing-expression grammar, which must consume every token. What no lexical rule can read is a token that no
grammar accepts. A failure is reported with the furthest position that the table reached and a cause: merge conflict, truncation
(nothing follows, or brackets are still open at the end), or other.

Results: null and empty contents and other extensions are no cases; repeated rows count once; extra columns are ignored; brackets nested
deeper than peg.DEEPEST are a failure at the bracket, as with compilers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.llm import grammars
from repolith.llm.peg import BAD, DEEPEST, FIRST
from repolith.session import spread

LANGUAGES = {"py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "json": "json", "toml": "toml"}

_conflict = re.compile(r"(?m)^(?:<{7}|\|{7}|={7}|>{7})(?: .*)?\r?$")


class Failure(NamedTuple):
    position: int
    line: int
    cause: str


class _Unreadable(Exception):
    """What begins at a position can't be read by the lexical rules."""

    def __init__(self, position: int):
        self.position = position


def _words(text: str) -> dict[str, str]:
    """'k: a b c' lines to {word: k}."""
    return {w: line.split(":")[0].strip() for line in text.strip().split("\n") for w in line.split(":", 1)[1].split()}


# --- lexical rules -------------------------------------------------------------------------------------------------------------

_NAME = r"(?:[^\W\d]|\$)(?:\w|\$)*"

_json = re.compile(
    r'[ \t\r\n]*(?:(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<d>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<v>(?:true|false|null)\b)|(?P<mark>[\[\]{},:])|(?P<end>\Z))'
)

_PYTHON_WORDS = _words("""
d: def
C: class
I: if
g: elif
E: else
F: for
K: while
t: try
V: except
U: finally
h: with
R: return
T: raise
f: from
i: import
Z: del
G: global nonlocal
H: assert
Q: pass break continue
L: lambda
W: yield
J: await
Y: async
N: in
O: not
S: is
l: and or
A: as
v: None True False
1: match
2: case
3: type
""")
_py_string = (
    r"(?:[rR][bB]?|[bB][rR]?|[uU]|[fF][rR]?|[rR][fF])?(?:"
    r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""|'
    r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''|"
    r'"(?!"")(?:[^"\\\n]|\\[\s\S])*+"|' + r"'(?!'')(?:[^'\\\n]|\\[\s\S])*+')"
)
#: Escapes that text strings and byte strings can't hold.
_bad_escape = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?![0-9a-fA-F]{8})|N(?!\{[^}]+\}))")
_bad_byte = re.compile(r"(?<!\\)(?:\\\\)*\\x(?![0-9a-fA-F]{2})|[^\x00-\x7f]")
_PYTHON_LEXEMES = (
    rf"(?P<s>{_py_string})|(?P<name>[^\W\d]\w*)"
    r"|(?P<d>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"
    r"|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])|0(?:_?0)*|[1-9](?:_?\d)*)(?=\W|\Z|(?:in|if|is|or|and|else|for|not)\b))"
    r"|(?P<nl>\n)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<mark>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|<=|>=|==|[-+*/%&|^~<>=.,:;@])"
)
_python = re.compile(rf"(?:[ \t\f\r]|\\\r?\n|#[^\n]*)*+(?:{_PYTHON_LEXEMES}|(?P<end>\Z))")
_PYTHON_MARKS = _words("""
a: += -= *= /= //= %= &= |= ^= @= >>= <<= **=
X: **
x: *
/: /
o: // << >> % & ^
|: |
-: + -
~: ~
c: != <= >= == < >
r: ->
w: :=
e: ...
=: =
.: .
,: ,
;: ;
p: @
""") | {":": ":"}

_toml_key = re.compile(r"[A-Za-z0-9_-]+")
_toml = re.compile(
    r"(?:[ \t]|#[^\n\x00-\x08\x0b\x0c\x0e-\x1f\x7f]*)*+(?:(?P<m>" + r'"""(?:[^"\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|\\[btnfre"\\]|\\[ \t]*\r?\n|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|"{1,2}(?!"))*+"{3,5}|' + r"'''(?:[^'\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|'{1,2}(?!'))*+'{3,5})"
    + r'|(?P<s>"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|\\[btnfr"\\]|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8})*+"|' + r"'[^'\x00-\x08\x0a-\x1f\x7f]*+')"
    + r"|(?P<nl>\r?\n)|(?P<value>\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?(?![\w-])|\d\d:\d\d:\d\d(?:\.\d+)?(?!\w)|(?:[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[+-]?(?:inf|nan)|true|false)(?![\w-]))"
    + r"|(?P<key>[A-Za-z0-9_-]+)|(?P<mark>[\[\]{},=.])|(?P<end>\Z))"
)

_SCRIPT_WORDS = _words("""
F: function
C: class
V: var let
O: const
I: if
E: else
W: while
D: do
L: for
R: return
h: throw
t: try
H: catch
Z: finally
S: switch
c: case
f: default
b: break continue debugger
N: new
u: typeof delete
z: void
w: await
Y: yield
i: in instanceof
x: extends
e: export
m: import
v: this super null true false
y: async
q: of
T: type
X: is
1: from
2: as satisfies
3: get set static readonly public private protected abstract declare override accessor
4: interface
5: enum
6: implements
7: namespace module
8: keyof infer unique asserts
""")
#: A template's text up to its end or its next hole.
_template = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(?:`|\$\{)")
_SCRIPT_LEXEMES = (
    r"(?P<name>" + _NAME + r")|(?P<s>" + r'"(?:[^"\\\n]|\\[\s\S])*+"|' + r"'(?:[^'\\\n]|\\[\s\S])*+')|(?P<tick>`)"
    r"|(?P<d>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$]))"
    r"|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<mark>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|\?(?=\.\D)|[-+*/%&|^!~<>=?:.,;#@])"
)
_script = re.compile(rf"(?P<gap>(?:\s|\ufeff|//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)*+)(?:{_SCRIPT_LEXEMES}|(?P<end>\Z))")
_regex_literal = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_SCRIPT_MARKS = _words("""
>: =>
a: >>>= **= <<= >>= &&= ||= ??= += -= *= /= %= &= |= ^=
M: **
Q: ??
l: && ||
o: === !== == != <= << / % ^
k: ++ --
~: ...
""") | {c: c for c in "-*!<=?.,;#|:&@"} | {">": "g", "+": "-", "~": "!"}

_GO_WORDS = _words("""
F: func
V: var
c: const
T: type
i: import
p: package
I: if
E: else
L: for
g: range
S: switch
W: select
C: case
f: default
R: return
b: break continue goto fallthrough
G: go defer
M: map
h: chan
r: struct
j: interface
""")
_GO_LEXEMES = (
    r"(?P<name>[^\W\d]\w*)|(?P<s>" + r'"(?:[^"\\\n]|\\[^\n])*+"|`[^`]*+`|' + r"'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))')"
    r"|(?P<d>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w))"
    r"|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<mark>\.\.\.|<<=|>>=|&\^=|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^!<>=:.,;~])"
)
_go = re.compile(rf"(?P<gap>(?:\s|//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)*+)(?:{_GO_LEXEMES}|(?P<end>\Z))")
_GO_MARKS = _words("""
e: ...
a: <<= >>= &^= += -= *= /= %= &= |= ^=
o: && || == != <= >= << >> &^ / % < >
>: <-
k: ++ --
w: :=
-: + -
!: ! ^
""") | {c: c for c in "*&=.,;|~:"}
#: Tokens after which a line end is the end of a statement.
_GO_ENDS = frozenset("ndsbRk)]}")

_RUST_WORDS = _words("""
F: fn
V: let
c: const static
T: type
u: use
m: mod
S: struct union
e: enum
i: impl
t: trait
I: if
E: else
M: match
W: while
L: for
N: in
D: loop
R: return
b: break continue
p: pub
q: unsafe async extern move
w: where
a: as
y: mut ref
x: dyn
v: true false
""")
# comments inside comments, as deep as they are seen
_nested = r"/\*(?:[^*/]|\*(?!/)|/(?!\*))*+\*/"
for _ in range(4):
    _nested = rf"/\*(?:[^*/]|\*(?!/)|/(?!\*)|{_nested})*+\*/"
_raw = "|".join(rf'{"#" * k}"[\s\S]*?"{"#" * k}' for k in range(9))
_RUST_LEXEMES = (
    r"(?P<s>b?r(?:" + _raw + r")|[bc]?\"(?:[^\"\\]|\\[\s\S])*+\"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F]+\}|.))')|(?P<l>'[^\W\d]\w*)|(?P<name>(?:r#)?[^\W\d]\w*)"
    r"|(?P<d>(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?[\d_]+)?)(?:[iuf](?:8|16|32|64|128|size))?(?!\w))"
    r"|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<mark>\.\.\.|\.\.=|<<=|>>=|::|->|=>|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\.\.|<<|[-+*/%&|^!<>=:.,;#@?$])"
)
_rust = re.compile(rf"(?P<gap>(?:\s|//[^\n]*|{_nested})*+)(?:{_RUST_LEXEMES}|(?P<end>\Z))")
_RUST_MARKS = _words("""
r: ... ..= ..
+: <<= >>= += -= *= /= %= &= |= ^=
>: ->
f: =>
&: && &
h: ||
o: == != <= >= << / % ^
""") | {c: c for c in "*!-<=.,;#@?|:"} | {"::": "2", ">": "g", "+": "P", "$": "n"}


# --- reading ---------------------------------------------------------------------------------------------------------------------


class _Tokens:
    """The token characters of a text so far, where each begins, and the brackets that are open."""

    __slots__ = ("kinds", "places", "open")

    def __init__(self) -> None:
        self.kinds: list[str] = []
        self.places: list[int] = []
        self.open: list[str] = []

    def add(self, kind: str, place: int) -> None:
        self.kinds.append(kind)
        self.places.append(place)

    def bracket(self, kind: str, place: int) -> None:
        if kind in "([{":
            self.open.append(kind)
            if len(self.open) > DEEPEST:
                raise _Unreadable(place)
        elif self.open:
            self.open.pop()
        self.kinds.append(kind)
        self.places.append(place)


def _json_tokens(text: str, found: _Tokens) -> None:
    match, at = _json.match, 0
    while m := match(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "end":
            return
        start = m.start(kind)
        if kind != "mark":
            found.add("s" if kind == "s" else "v", start)
        elif text[start] in ",:":
            found.add(text[start], start)
        else:
            found.bracket(text[start], start)
    raise _Unreadable(at + len(text[at:]) - len(text[at:].lstrip()))


def _toml_tokens(text: str, found: _Tokens) -> None:
    kinds, braces = found.kinds, found.open
    match, at = _toml.match, 0
    header = ""
    while m := match(text, at):
        kind, at = m.lastgroup, m.end()
        start = m.start(kind)
        last = kinds[-1] if kinds else ";"
        if kind == "end":
            return
        as_key = last in (".{;" if not braces else ".{") or header != "" or last == "," and braces[-1:] == ["{"]
        if kind == "value":
            key = _toml_key.match(text, start) if as_key else None
            if as_key and key is None:
                raise _Unreadable(start)
            found.add("k" if key else "v", start)
            at = key.end() if key else at
        elif kind in ("key", "s", "m"):
            if kind == "key" and not as_key:
                raise _Unreadable(start)
            found.add("k" if kind == "key" else kind, start)
        elif kind == "nl":
            found.add(";", start)
            header = ""
        elif text[start] == "[" and last == ";" and not braces:
            header = "]]" if text.startswith("[[", start) else "]"
            found.add("L" if len(header) == 2 else "<", start)
            at = start + len(header)
        elif text[start] == "]" and header:
            if not text.startswith(header, start):
                raise _Unreadable(start)
            found.add("R" if len(header) == 2 else ">", start)
            at = start + len(header)
            header = ""
        elif text[start] in "[]{}":
            found.bracket(text[start], start)
        else:
            found.add(text[start], start)
    raise _Unreadable(at)


_line_start = re.compile(r"(?:[ \t\f]*(?:#[^\n]*)?\r?\n)*([ \t\f]*)")
_fstring = re.compile(r"(?P<raw>[rR])?[fF](?(raw)|(?P<raw2>[rR])?)(?P<quote>\"\"\"|\'\'\'|\"|\')")
_literal_run = re.compile(r"[^\\{}\"'\n]+")
_gap = re.compile(r"\s*")
_lone_return = re.compile(r"\r(?!\n)")
_hole_end = re.compile(r"\s*(?:=(?!=)\s*)?(?:!\s*[rsa]\s*)?(?=[:}])")


def _fstring_tokens(text: str, m: re.Match[str], found: _Tokens) -> int:
    """End of the f-string that begins with m. Its holes are tokens of their own."""
    found.add("b", m.start())
    at = _literal_part(text, m.end(), m["quote"], bool(m["raw"] or m["raw2"]), False, found)
    found.add("u", at)
    return at + len(m["quote"])


def _literal_part(text: str, at: int, quote: str, raw: bool, in_format: bool, found: _Tokens) -> int:
    """Where a part of an f-string ends: at its quotes, or at the brace behind a format."""
    while at < len(text):
        run = _literal_run.match(text, at)
        if run:
            at = run.end()
            continue
        c = text[at]
        if text.startswith(quote, at):
            if in_format:
                raise _Unreadable(at)
            return at
        if c == "\\":
            if not raw and text.startswith("N{", at + 1):
                at = text.find("}", at)
                if at < 0:
                    break
                at += 1
            else:
                at += 1 if text[at + 1 : at + 2] in ("{", "}") else 2
        elif c == "\n" and len(quote) == 1:
            raise _Unreadable(at)
        elif c == "{":
            if not in_format and text.startswith("{", at + 1):
                at += 2
            else:
                at = _hole_tokens(text, at + 1, quote, raw, found) + 1
        elif c == "}":
            if in_format:
                return at
            if not text.startswith("}", at + 1):
                raise _Unreadable(at)
            at += 2
        else:
            at += 1
    raise _Unreadable(len(text))


def _hole_tokens(text: str, at: int, quote: str, raw: bool, found: _Tokens) -> int:
    """Where the hole that begins at `at` is closed."""
    found.add("y", at)
    begin, depth = len(found.kinds), len(found.open)
    while True:
        if len(found.open) == depth and (end := _hole_end.match(text, at)) and not (end.end() == at and len(found.kinds) == begin):
            at = end.end()
            if text[at] == ":":
                found.add("m", at)
                at = _literal_part(text, at + 1, quote, raw, True, found)
            found.add("z", at)
            return at
        start = _gap.match(text, at).end()
        if inner := _fstring.match(text, start):
            at = _fstring_tokens(text, inner, found)
            continue
        m = _python.match(text, at)
        if m is None or m.lastgroup == "end":
            raise _Unreadable(start)
        kind = m.lastgroup
        start, at = m.start(kind), m.end()
        if kind == "close" and len(found.open) == depth:
            raise _Unreadable(start)
        if kind != "nl":
            _python_token(text, kind, m.group(kind), start, found)


def _python_token(text: str, kind: str, written: str, start: int, found: _Tokens) -> None:
    if kind == "name":
        found.add(_PYTHON_WORDS.get(written, "n"), start)
    elif kind == "mark":
        found.add(_PYTHON_MARKS[written], start)
    elif kind == "s":
        head = written[: next(k for k in range(3) if written[k] in "\"'")].lower()
        if "\\" in written and "r" not in head and (_bad_byte if "b" in head else _bad_escape).search(written) or "b" in head and not written.isascii():
            raise _Unreadable(start)
        found.add("B" if "b" in head else "s", start)
    elif kind == "d":
        found.add("v", start)
    else:
        found.bracket(written, start)


def _python_tokens(text: str, found: _Tokens) -> None:
    match, kinds, places, words = _python.match, found.kinds, found.places, _PYTHON_WORDS
    widths, narrows = [0], [0]
    at, length = int(text.startswith("﻿")), len(text)
    if "\r" in text:  # a line end of its own, too
        text = _lone_return.sub("\n", text)
    fresh = True
    while True:
        if fresh:
            m = _line_start.match(text, at)
            at = m.end()
            if at >= length or text[at] not in "#\r\n":
                blanks = m.group(1).replace("\f", "") if at < length else ""
                width, narrow = (len(blanks),) * 2 if "\t" not in blanks else (len(blanks.expandtabs(8)), len(blanks.expandtabs(1)))
                if width > widths[-1]:
                    if narrow <= narrows[-1]:
                        raise _Unreadable(at)
                    widths.append(width)
                    narrows.append(narrow)
                    found.add(">", at)
                else:
                    while width < widths[-1]:
                        widths.pop()
                        narrows.pop()
                        found.add("<", at)
                    if width != widths[-1] or narrow != narrows[-1]:
                        raise _Unreadable(at)
            fresh = False
        m = match(text, at)
        if m is None:
            raise _Unreadable(at)
        kind = m.lastgroup
        start, end = m.span(kind)
        at = end
        if kind == "name":
            if end < length and text[end] in "\"'" and (literal := _fstring.match(text, start)):
                at = _fstring_tokens(text, literal, found)
            else:
                kinds.append(words.get(text[start:end], "n"))
                places.append(start)
        elif kind == "nl":
            if not found.open:
                if kinds and kinds[-1] not in "$><":
                    found.add("$", start)
                fresh = True
        elif kind == "end":
            break
        elif kind == "s" and text[start] in "fFrR" and (literal := _fstring.match(text, start)):
            at = _fstring_tokens(text, literal, found)
        else:
            _python_token(text, kind, text[start:end], start, found)
    if kinds and kinds[-1] not in "$><":
        found.add("$", length)
    for _ in widths[1:]:
        found.add("<", length)


#: Tokens behind which a slash divides.
_SCRIPT_OPERAND = frozenset("nyqTX12345678vsdrkJK)]")


def _script_tokens(text: str, found: _Tokens) -> None:
    kinds, places, words, marks = found.kinds, found.places, _SCRIPT_WORDS, _SCRIPT_MARKS
    match, length = _script.match, len(text)
    at = text.find("\n") if text.startswith("#!") else 0
    at = length if at < 0 else at
    # of each open bracket: ( of a head or of an operand, { of a block or of an operand, ` of a hole
    inside: list[str] = []
    last, before = "", ""
    divides = False
    while m := match(text, at):
        kind, at = m.lastgroup, m.end()
        start = m.start(kind)
        if kind == "end":
            return
        first = FIRST if start > 0 and "\n" in text[m.start() : start] else 0
        if kind == "name":
            token = words.get(text[start:at], "n")
            divides = token in _SCRIPT_OPERAND or last == "."
        elif kind == "mark":
            mark = text[start:at]
            token = marks[mark]
            if mark in ("/", "/=") and not divides:
                literal = _regex_literal.match(text, start)
                if literal is None:
                    raise _Unreadable(start)
                token, at = "r", literal.end()
            divides = token in _SCRIPT_OPERAND
        elif kind in ("s", "d"):
            token, divides = kind, True
        elif kind == "tick" or text[start] == "}" and inside[-1:] == ["`"]:
            hole = kind != "tick"
            part = _template.match(text, at)
            if part is None:
                raise _Unreadable(length)
            at = part.end()
            ended = text[at - 1] == "`"
            token = ("K" if ended else "B") if hole else ("J" if ended else "A")
            if hole and ended:
                inside.pop()
                found.open.pop()
            elif not hole and not ended:
                inside.append("`")
                found.open.append("`")
            divides = ended
        elif kind == "open":
            token = text[start]
            operand = token != "{" or last in frozenset("=(,?[aol&|Q-!*:uzwYRN~23") or last == "f" and before == "e"
            inside.append(token if token == "{" and operand else "head" if token == "(" and last in frozenset("IWLH") else "block" if token == "{" else "")
            found.bracket(token, start)
            kinds.pop()
            places.pop()
            divides = False
        else:
            token = text[start]
            opened = inside.pop() if inside else ""
            divides = opened not in ("head", "block")
            found.bracket(token, start)
            kinds.pop()
            places.pop()
        kinds.append(chr(ord(token) + FIRST) if first else token)
        places.append(start)
        last, before = token, last
    raise _Unreadable(at)


def _go_tokens(text: str, found: _Tokens) -> None:
    kinds = found.kinds
    match, at = _go.match, 0
    while m := match(text, at):
        kind, at = m.lastgroup, m.end()
        start = m.start(kind)
        if kinds and kinds[-1] in _GO_ENDS and (kind == "end" or "\n" in m.group("gap")):
            found.add(";", start)
        if kind == "end":
            return
        written = text[start:at]
        if kind == "name":
            found.add(_GO_WORDS.get(written, "n"), start)
        elif kind == "mark":
            found.add(_GO_MARKS[written], start)
        elif kind in ("s", "d"):
            found.add(kind, start)
        else:
            found.bracket(written, start)
    raise _Unreadable(at)


def _rust_tokens(text: str, found: _Tokens) -> None:
    match, at = _rust.match, text.find("\n") if text.startswith("#!") and not text.startswith("#![") else 0
    while m := match(text, max(at, 0)):
        kind, at = m.lastgroup, m.end()
        if kind == "end":
            return
        start = m.start(kind)
        if kind == "name":
            found.add(_RUST_WORDS.get(m.group(kind), "n"), start)
        elif kind == "mark":
            found.add(_RUST_MARKS[m.group(kind)], start)
        elif kind in ("s", "d", "l"):
            found.add(kind, start)
        else:
            found.bracket(text[start], start)
    raise _Unreadable(at)


# --- reading without places -------------------------------------------------------------------------------------------------------
# Most files are valid, and the place of a token is only asked for in others. A text is first split into its lexemes by one pattern and
# these are looked up; whatever needs more than that (a slash in a script, a literal inside a literal, a tab before a line, anything
# unreadable) and every failure goes through the readers above.


def _lexemes(known: str, skipped: str, lines: str = "") -> re.Pattern[str]:
    """Splits a text into the known lexemes, behind what is skipped; lines: what can end a line. An empty lexeme stands before a bad number."""
    return re.compile(f"{skipped}({lines}{re.sub(r'[(][?]P<[a-z]+>', '(?:', known)}|(?=\\d)|[\\s\\S])")


_comment = r"/\*(?:[^*]|\*(?!/))*+\*/|"
_fast_python = _lexemes(_PYTHON_LEXEMES, r"(?:[ \t\f]|\\\r?\n|#[^\n]*|\r(?=\n))*+", r"\n(?:[ \t\f]*(?:#[^\n]*)?\r?\n)*[ \t\f]*(?=[^\s#]|\Z)|")
_fast_script = _lexemes(_SCRIPT_LEXEMES, r"(?:[^\S\n]|\ufeff|//[^\n]*)*+", r"\n\s*|" + _comment + r"`(?:[^`\\]|\\[\s\S])*+`|" + rf"(?:(?<=[(=,:\[!&|?;])|(?<=[(=,:\[!&|?;] )){_regex_literal.pattern}|")
_fast_go = _lexemes(_GO_LEXEMES, r"(?:[^\S\n]|//[^\n]*)*+", r"\n\s*|" + _comment)
_fast_rust = _lexemes(_RUST_LEXEMES, rf"(?:\s|//[^\n]*|{_nested})*+")
_brackets = {c: c for c in "([{}])"}
#: Lexemes that a worker remembers; the memory's bound, results don't depend on it.
KEPT_LEXEMES = 200_000


class _Known(dict[str, str]):
    """Token of each lexeme that has been seen."""

    def __init__(self, *tables: dict[str, str]):
        super().__init__()
        for table in (_brackets, *tables):
            self.update(table)
        self.fixed = dict(self)

    def keep(self, lexeme: str, token: str) -> str:
        if len(self) >= KEPT_LEXEMES:
            self.clear()
            self.update(self.fixed)
        self[lexeme] = token
        return token


_known_python = _Known(_PYTHON_WORDS, _PYTHON_MARKS)
_known_script = _Known(_SCRIPT_WORDS, {k: v for k, v in _SCRIPT_MARKS.items() if k not in ("/", "/=")})
_known_go = _Known(_GO_WORDS, _GO_MARKS)
_known_rust = _Known(_RUST_WORDS, _RUST_MARKS)


def _literal_kinds(read: Callable[[str, _Tokens], None], lexeme: str) -> str | None:
    """The tokens of a literal with holes; None if it isn't one as a whole."""
    found = _Tokens()
    try:
        read(lexeme, found)
    except _Unreadable:
        return None
    return "".join(found.kinds)


def _read_whole_fstring(lexeme: str, found: _Tokens) -> None:
    if _fstring_tokens(lexeme, _fstring.match(lexeme), found) != len(lexeme):
        raise _Unreadable(0)


def _fast_python_kinds(text: str) -> str | None:
    if "\t" in text or "\r" in text and _lone_return.search(text) or text.startswith("\ufeff"):
        return None
    text = text.rstrip(" \r\n\f")
    if text.endswith("\\"):
        return None
    get, kinds, depth = _known_python.get, [], 0
    add = kinds.append
    widths = [0]
    for x in _fast_python.findall(f"\n{text}\n"):
        k = get(x)
        if k is None:
            c = x[:1]
            if c == "\n":
                if depth:
                    continue
                if kinds and kinds[-1] not in "$><":
                    add("$")
                width = len(x) - x.rfind("\n") - 1
                if width != widths[-1]:
                    if "\f" in x:
                        return None
                    if width > widths[-1]:
                        widths.append(width)
                        add(">")
                    else:
                        while width < widths[-1]:
                            widths.pop()
                            add("<")
                        if width != widths[-1]:
                            return None
                continue
            if x.isidentifier():
                k = _known_python.keep(x, "n")
            elif c.isdigit() or c == "." and len(x) > 1:
                k = "v"
            elif x and x[-1] in "\"'" and len(x) > 1:
                if "\\" in x or c in "bBrRfF":
                    f = _fstring.match(x)
                    k = _literal_kinds(_read_whole_fstring if f else _python_tokens, x)
                    if k is None:
                        return None
                    k = k.rstrip("$")
                else:
                    k = "s"
            else:
                return None
        elif k in "([{":
            depth += 1
            if depth > DEEPEST:
                return None
        elif k in ")]}":
            depth -= depth > 0
        add(k)
    return None if depth else "".join(kinds)


def _fast_script_kinds(text: str) -> str | None:
    if text.startswith("#!") or text.count("(") + text.count("[") + text.count("{") > DEEPEST:
        return None
    get, kinds = _known_script.get, []
    add = kinds.append
    first = False
    for x in _fast_script.findall(text):
        k = get(x)
        if k is None:
            c = x[:1]
            if c == "\n":
                first = True
                continue
            if c.isalpha() or c in ("_", "$") and x:
                k = _known_script.keep(x, "n")
            elif c.isdigit() or c == "." and len(x) > 1:
                k = "d"
            elif len(x) > 1 and c in "\"'":
                k = "s"
            elif len(x) > 1 and c == "`":
                k = _literal_kinds(_script_tokens, x) if "${" in x else "J"
                if k is None:
                    return None
            elif x.startswith("/*"):
                first = first or "\n" in x
                continue
            elif len(x) > 1 and c == "/":
                k = "r"
            else:
                return None
        if first:
            k = chr(ord(k[0]) + FIRST) + k[1:]
            first = False
        add(k)
    return "".join(kinds)


def _fast_go_kinds(text: str) -> str | None:
    if text.count("(") + text.count("[") + text.count("{") > DEEPEST:
        return None
    get, kinds = _known_go.get, []
    add = kinds.append
    k: str | None = ""
    for x in _fast_go.findall(f"{text}\n"):
        last, k = k, get(x)
        if k is None:
            c = x[:1]
            if c == "\n" or x.startswith("/*"):
                if last in _GO_ENDS and "\n" in x:
                    add(";")
                    k = ";"
                else:
                    k = last
                continue
            if c.isalpha() or c == "_":
                k = _known_go.keep(x, "n")
            elif c.isdigit() or c == "." and len(x) > 1:
                k = "d"
            elif len(x) > 1 and c in "\"'`":
                k = "s"
            else:
                return None
        add(k)
    return "".join(kinds)


def _fast_rust_kinds(text: str) -> str | None:
    if text.startswith("#!") or text.count("(") + text.count("[") + text.count("{") > DEEPEST:
        return None
    get, kinds = _known_rust.get, []
    for x in _fast_rust.findall(text):
        k = get(x)
        if k is None:
            c = x[:1]
            if len(x) > 1 and x[-1] in "\"'#":
                k = "s"
            elif c == "'" and len(x) > 1:
                k = "l"
            elif c.isalpha() or c == "_":
                k = _known_rust.keep(x, "n")
            elif c.isdigit():
                k = "d"
            else:
                return None
        kinds.append(k)
    return "".join(kinds)


_fast = {"python": _fast_python_kinds, "javascript": _fast_script_kinds, "typescript": _fast_script_kinds, "go": _fast_go_kinds, "rust": _fast_rust_kinds}
_readers = {
    "json": (_json_tokens, grammars.JSON),
    "toml": (_toml_tokens, grammars.TOML),
    "python": (_python_tokens, grammars.PYTHON),
    "javascript": (_script_tokens, grammars.JAVASCRIPT),
    "typescript": (_script_tokens, grammars.TYPESCRIPT),
    "go": (_go_tokens, grammars.GO),
    "rust": (_rust_tokens, grammars.RUST),
}


def check(language: str, text: str) -> Failure | None:
    """None if all of the text is valid, else where it stops to be and why."""
    read, grammar = _readers[language]
    kinds = _fast[language](text) if language in _fast else None
    if kinds is not None and grammar.accepts("file", kinds):
        return None
    found = _Tokens()
    try:
        read(text, found)
    except _Unreadable as stop:
        found.add(BAD, stop.position)
        found.open.clear()
    failed = grammar.failure("file", "".join(found.kinds))
    if failed is None:
        return None
    position = min(found.places[failed] if failed < len(found.places) else len(text), len(text))
    if _conflict.search(text):
        cause = "conflict"
    elif found.open or not text[position:].strip():
        cause = "truncated"
    else:
        cause = "other"
    return Failure(position, text.count("\n", 0, position) + 1, cause)


def failures(files: DataFrame) -> DataFrame:
    """(repo_id, path, language, position, line, cause): every file with a language; the last three are null for valid ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = [LANGUAGES[x] for x in batch.column(2).to_pylist()]
            found = [check(language, text) for language, text in zip(languages, batch.column(3).to_pylist(), strict=True)]
            columns = [
                pa.array([f and f.position for f in found], type=pa.int64()),
                pa.array([f and f.line for f in found], type=pa.int64()),
                pa.array([f and f.cause for f in found], type=pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(languages), *columns], names=["repo_id", "path", "language", "position", "line", "cause"])

    extension = F.regexp_extract("path", r"\.(" + "|".join(LANGUAGES) + ")$", 1)
    chosen = files.select("repo_id", "path", extension.alias("extension"), "content").where("extension <> '' and content is not null and content <> ''")
    return spread(chosen).mapInArrow(run, "repo_id string, path string, language string, position bigint, line bigint, cause string")


def rates(checked: DataFrame) -> DataFrame:
    """Files, invalid files and their share for each repository and language, and for each alone (null stands for all)."""
    once = checked.groupBy("repo_id", "path", "language").agg(F.max(F.col("position").isNotNull()).alias("invalid"))
    return (
        once.cube("repo_id", "language")
        .agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("files"), F.count_if("invalid").alias("invalid"))
        .withColumn("rate", F.col("invalid") / F.col("files"))
    )
