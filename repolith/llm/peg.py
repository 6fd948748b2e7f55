"""Packrat parsers from parsing-expression grammars over token strings.

A grammar is text: rules `name <- expression`, with ordered choice `/`, `*`, `+`, `?`, `&`, `!`, quoted tokens, classes `[...]`, `^` (the next
token is the first of its line) and names of rules, the rule itself included. Every token is one character below 128; one that
begins a line is the same character plus FIRST. Four rules are given: `any` is every token, `other` every one but brackets, `tree` one token or a
bracketed run of trees, `eof` the end.

Every rule that can contain itself becomes a function with a table from positions to ends, the packrat table of (rule, position); what
never recurs is matched by atomic patterns in between. Neither goes back into a choice once taken, so that the time is linear in the
tokens. A text that is refused is parsed once more with every test on its own, which finds the furthest position.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

#: What the first token of a line is raised by.
FIRST = 128
#: The end of the input, and a place that no lexical rule can read.
END, BAD = "\0", "\1"
#: Brackets inside each other beyond which a text is refused, as compilers do; the parser's stack is made for it.
DEEPEST = 5_000
FRAMES_PER_LEVEL = 60
#: Lines that a worker remembers; the memory's bound, results don't depend on it.
KEPT_LINES = 200_000

_piece = re.compile(r"\s*(?:'(?P<lit>[^']*)'|\[(?P<cls>(?:\\.|[^\]\\])+)\]|(?P<name>[a-z_]\w*)|(?P<op>[/*+?&!()^]))")

GIVEN = "tree <- '(' tree* ')' / '[' tree* ']' / '{' tree* '}' / other"
_ASCII = frozenset(map(chr, range(2, FIRST)))
_TOKENS = _ASCII | {chr(ord(c) + FIRST) for c in _ASCII}


def _both(chars: str | frozenset[str]) -> frozenset[str]:
    return frozenset(chars) | {chr(ord(c) + FIRST) for c in chars if ord(c) < FIRST}


class _Node:
    """One expression: kind is set, seq, choice, star, plus, opt, and, not, first or call."""

    __slots__ = ("kind", "parts", "chars", "name")

    def __init__(self, kind: str, parts: tuple[_Node, ...] = (), chars: frozenset[str] = frozenset(), name: str = ""):
        self.kind, self.parts, self.chars, self.name = kind, parts, chars, name


class _Reader:
    """Reads the text of one rule's body."""

    def __init__(self, body: str):
        self.pieces: list[tuple[str, str]] = []
        at, body = 0, body.rstrip()
        while at < len(body):
            m = _piece.match(body, at)
            if m is None:
                raise ValueError(f"grammar at {body[at:][:40]!r}")
            self.pieces.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def _next(self, *ops: str) -> str:
        if self.at < len(self.pieces) and self.pieces[self.at][0] == "op" and self.pieces[self.at][1] in ops:
            self.at += 1
            return self.pieces[self.at - 1][1]
        return ""

    def choice(self) -> _Node:
        options = [self.sequence()]
        while self._next("/"):
            options.append(self.sequence())
        return options[0] if len(options) == 1 else _Node("choice", tuple(options))

    def sequence(self) -> _Node:
        parts: list[_Node] = []
        while self.at < len(self.pieces) and self.pieces[self.at] not in (("op", "/"), ("op", ")")):
            parts.append(self.suffixed())
        return parts[0] if len(parts) == 1 else _Node("seq", tuple(parts))

    def suffixed(self) -> _Node:
        if op := self._next("&", "!"):
            return _Node("and" if op == "&" else "not", (self.suffixed(),))
        if self._next("^"):
            node = _Node("first")
        elif self._next("("):
            node = self.choice()
            self.at += 1
        else:
            kind, text = self.pieces[self.at]
            self.at += 1
            if kind == "name":
                node = _Node("call", name=text)
            elif kind == "cls":
                node = _Node("set", chars=_both(text.replace("\\", "")))
            else:
                sets = tuple(_Node("set", chars=_both(c)) for c in text)
                node = sets[0] if len(sets) == 1 else _Node("seq", sets)
        while op := self._next("*", "+", "?"):
            node = _Node({"*": "star", "+": "plus", "?": "opt"}[op], (node,))
        return node


class Grammar:
    def __init__(self, text: str, lines: dict[str, str] | None = None):
        """lines: rules whose match always ends with the next token of a kind and looks no further. It depends on the tokens up to there alone, so
        that such lines are looked up in a table that all texts share."""
        self.lines = lines or {}
        self.tables: dict[str, dict[str, bool]] = {name: {} for name in self.lines}
        self.rules: dict[str, _Node] = {"any": _Node("set", chars=_TOKENS), "other": _Node("set", chars=_TOKENS - _both("()[]{}")), "eof": _Node("not", (_Node("call", name="any"),))}
        for rule in filter(None, re.split(r"\n+(?=\w+ <-)|\n+\Z", f"{GIVEN}\n{text.strip()}\n".strip("\n"))):
            name, body = rule.split("<-", 1)
            self.rules[name.strip()] = _Reader(body).choice()
        self.recursive = {name for name in self.rules if self._reaches(name)}
        self._starts: dict[str, tuple[frozenset[str], bool]] = {}
        self._parsers: dict[tuple[str, bool], Callable] = {}

    def _calls(self, node: _Node) -> set[str]:
        return {node.name} if node.kind == "call" else set().union(*map(self._calls, node.parts), set())

    def _reaches(self, name: str) -> bool:
        """Whether a rule leads to a rule that contains itself."""
        seen: set[str] = set()
        new = self._calls(self.rules[name])
        while new:
            seen |= new
            new = set().union(*(self._calls(self.rules[n]) for n in new)) - seen
        if name in seen:
            return True
        return any(n in self._closure(n) for n in seen)

    def _closure(self, name: str) -> set[str]:
        seen: set[str] = set()
        new = self._calls(self.rules[name])
        while new:
            seen |= new
            new = set().union(*(self._calls(self.rules[n]) for n in new)) - seen
        return seen

    # --- what an expression can begin with ---------------------------------------------------------------------------------------

    def _start(self, node: _Node) -> tuple[frozenset[str], bool]:
        """Tokens that node can begin with, and whether it can match without consuming one."""
        kind = node.kind
        if kind == "set":
            return node.chars, False
        if kind == "call":
            if node.name not in self._starts:
                self._starts[node.name] = (frozenset(), False)  # left recursion is not written
                self._starts[node.name] = self._start(self.rules[node.name])
            return self._starts[node.name]
        if kind in ("and", "not", "first"):
            return frozenset(), True
        if kind == "choice":
            starts = [self._start(p) for p in node.parts]
            return frozenset().union(*(s for s, _ in starts)), any(e for _, e in starts)
        if kind == "seq":
            found: frozenset[str] = frozenset()
            for part in node.parts:
                chars, empty = self._start(part)
                found |= chars
                if not empty:
                    return found, False
            return found, True
        chars, empty = self._start(node.parts[0])
        return chars, empty or kind != "plus"

    # --- patterns of what never recurs -------------------------------------------------------------------------------------------

    def _flat(self, node: _Node) -> bool:
        return not self._calls(node) & self.recursive

    def _pattern(self, node: _Node) -> str:
        kind = node.kind
        if kind == "set":
            if node.chars == _TOKENS:
                return f"[^{END}{BAD}]"
            return "[" + "".join("\\" + c if c in "\\^]-[&~|" else c for c in sorted(node.chars)) + "]"
        if kind == "call":
            return self._pattern(self.rules[node.name])
        if kind == "first":
            return f"(?=[{chr(FIRST)}-{chr(2 * FIRST - 1)}])"
        if kind == "and":
            return f"(?={self._pattern(node.parts[0])})"
        if kind == "not":
            return f"(?!{self._pattern(node.parts[0])})"
        if kind == "seq":
            return "".join(map(self._pattern, node.parts))
        if kind == "choice":
            return f"(?>{'|'.join(map(self._pattern, node.parts))})"
        inner = self._pattern(node.parts[0])
        single = node.parts[0].kind == "set"
        return (inner if single else f"(?:{inner})") + {"star": "*+", "plus": "++", "opt": "?+"}[kind]

    # --- functions of the others -------------------------------------------------------------------------------------------------

    def _parser(self, rule: str, traced: bool) -> Callable[[str], tuple[int, int]]:
        if (rule, traced) not in self._parsers:
            self._parsers[rule, traced] = _Writer(self, traced).written(rule)
        return self._parsers[rule, traced]

    def accepts(self, rule: str, tokens: str) -> bool:
        """Whether the rule consumes all tokens."""
        if sys.getrecursionlimit() < DEEPEST * FRAMES_PER_LEVEL:
            sys.setrecursionlimit(DEEPEST * FRAMES_PER_LEVEL)
        return self._parser(rule, False)(tokens + END)[0] == len(tokens)

    def failure(self, rule: str, tokens: str) -> int | None:
        """None if the rule consumes all tokens, else how many tokens can still begin a text that it accepts."""
        if self.accepts(rule, tokens):
            return None
        end, furthest = self._parser(rule, True)(tokens + END)
        return max(end, furthest)


class _Writer:
    """Writes the Python functions of the rules that a start rule needs."""

    def __init__(self, grammar: Grammar, traced: bool):
        self.grammar, self.traced = grammar, traced
        self.lines: list[str] = []
        self.names: dict[str, object] = {}
        self.known: dict[object, str] = {}
        self.count = 0

    def _value(self, key: object, make: Callable[[], object]) -> str:
        if key not in self.known:
            self.known[key] = name = f"K{len(self.known)}"
            self.names[name] = make()
        return self.known[key]

    def _new(self) -> str:
        self.count += 1
        return f"t{self.count}"

    def _put(self, depth: int, line: str) -> None:
        self.lines.append(" " * depth + line)

    def _simple(self, node: _Node) -> bool:
        return not self.traced and self.grammar._flat(node)

    @staticmethod
    def _token(node: _Node) -> bool:
        """Whether node is a test of one token, which is cheaper than a pattern."""
        return node.kind == "set" or node.kind in ("star", "opt") and node.parts[0].kind == "set"

    def written(self, rule: str) -> Callable[[str], tuple[int, int]]:
        needed = self.grammar._closure(rule) | {rule}
        named = [n for n in self.grammar.rules if n in needed and (self.traced or n in self.grammar.recursive or n == rule)]
        # the text and the tables are the module's own, so that a parse leaves no cycles of functions behind
        self.names |= {"s": "", "far": [0]}
        for name in named:
            self._put(0, f"M_{name} = {{}}")
            self._put(0, f"G_{name} = M_{name}.get")
            self._put(0, f"def r_{name}(i):")
            self._put(1, f"out = G_{name}(i)")
            self._put(1, "if out is not None: return out")
            shared = not self.traced and name in self.grammar.lines
            if shared:
                table = self._value(("table", name), lambda n=name: self.grammar.tables[n])
                self._put(1, f"end = s.find({self.grammar.lines[name]!r}, i) + 1")
                self._put(1, "line = s[i:end]")
                self._put(1, f"held = {table}.get(line)")
                self._put(1, "if held is not None:")
                self._put(2, f"out = M_{name}[i] = end if held else -1")
                self._put(2, "return out")
            self.write(self.grammar.rules[name], "i", "out", 1)
            if shared:
                self._put(1, f"if len({table}) >= {KEPT_LINES}: {table}.clear()")
                self._put(1, f"if end: {table}[line] = out == end")
            self._put(1, f"M_{name}[i] = out")
            self._put(1, "return out")
        self._put(0, "def parse(text):")
        self._put(1, "global s")
        self._put(1, "s, far[0] = text, 0")
        self._put(1, "try:")
        self._put(2, f"return r_{rule}(0), far[0]")
        self._put(1, "finally:")
        self._put(2, "; ".join(f"M_{name}.clear()" for name in named))
        exec(compile("\n".join(self.lines), f"<grammar {rule}>", "exec"), self.names)  # noqa: S102 (text made above from the grammar alone)
        return self.names["parse"]

    def _test(self, node: _Node, at: str, depth: int) -> int:
        """Writes a test of the token at `at` against what node can begin with, where that decides; the depth behind it."""
        chars, empty = self.grammar._start(node)
        if self.traced or empty or chars == _TOKENS or node.kind == "set":
            return depth
        self._put(depth, f"if s[{at}] in {self._value(chars, lambda: chars)}:")
        return depth + 1

    def write(self, node: _Node, at: str, out: str, depth: int) -> None:
        """Lines that set `out` to the end of node's match at `at`, or to -1."""
        kind = node.kind
        if kind == "set":
            held = self._value(node.chars, lambda: node.chars)
            if self.traced:
                self._put(depth, f"if s[{at}] in {held}: {out} = {at} + 1")
                self._put(depth, "else:")
                self._put(depth + 1, f"{out} = -1")
                self._put(depth + 1, f"if {at} > far[0]: far[0] = {at}")
            else:
                self._put(depth, f"{out} = {at} + 1 if s[{at}] in {held} else -1")
        elif not self.traced and kind == "star" and node.parts[0].kind == "set":
            held = self._value(node.parts[0].chars, lambda: node.parts[0].chars)
            self._put(depth, f"{out} = {at}")
            self._put(depth, f"while s[{out}] in {held}: {out} += 1")
        elif not self.traced and kind == "opt" and node.parts[0].kind == "set":
            held = self._value(node.parts[0].chars, lambda: node.parts[0].chars)
            self._put(depth, f"{out} = {at} + 1 if s[{at}] in {held} else {at}")
        elif kind == "call" and (self.traced or node.name in self.grammar.recursive):
            self._put(depth, f"{out} = r_{node.name}({at})")
        elif self._simple(node):
            pattern = self.grammar._pattern(node)
            held = self._value(("re", pattern), lambda: re.compile(pattern, re.S).match)
            found = self._new()
            self._put(depth, f"{found} = {held}(s, {at})")
            self._put(depth, f"{out} = {found}.end() if {found} else -1")
        elif kind == "first":
            self._put(depth, f"{out} = {at} if s[{at}] >= '\\x80' else -1")
        elif kind == "seq":
            self._sequence(node, at, out, depth)
        elif kind == "choice":
            self._put(depth, f"{out} = -1")
            for k, part in enumerate(node.parts):
                inner = depth
                if k:
                    self._put(depth, f"if {out} < 0:")
                    inner += 1
                self.write(part, at, out, self._test(part, at, inner))
        elif kind == "opt":
            part = node.parts[0]
            self._put(depth, f"{out} = -1")
            self.write(part, at, out, self._test(part, at, depth))
            self._put(depth, f"if {out} < 0: {out} = {at}")
        elif kind in ("star", "plus"):
            part, step = node.parts[0], self._new()
            self._put(depth, f"{out} = {at}")
            if kind == "plus":
                self.write(part, at, out, depth)
                self._put(depth, f"if {out} >= 0:")
                depth += 1
            self._put(depth, "while True:")
            self._put(depth + 1, f"{step} = -1")
            self.write(part, out, step, self._test(part, out, depth + 1))
            self._put(depth + 1, f"if {step} <= {out}: break")
            self._put(depth + 1, f"{out} = {step}")
        else:
            inner = self._new()
            if self.traced and kind == "not":
                kept = self._new()
                self._put(depth, f"{kept} = far[0]")
            self.write(node.parts[0], at, inner, depth)
            if self.traced and kind == "not":
                self._put(depth, f"far[0] = {kept}")
                self._put(depth, f"if {inner} >= 0 and {at} > far[0]: far[0] = {at}")
            self._put(depth, f"{out} = {at} if {inner} {'>=' if kind == 'and' else '<'} 0 else -1")

    def _sequence(self, node: _Node, at: str, out: str, depth: int) -> None:
        parts: list[_Node] = []
        for part in node.parts:  # neighbours that never recur are one pattern
            if parts and self._simple(part) and self._simple(parts[-1]) and not (self._token(part) and self._token(parts[-1])):
                held = parts[-1].parts if parts[-1].kind == "seq" else (parts[-1],)
                parts[-1] = _Node("seq", (*held, part))
            else:
                parts.append(part)
        if not parts:
            self._put(depth, f"{out} = {at}")
            return
        self._put(depth, f"{out} = -1")
        for part in parts[:-1]:
            step = self._new()
            if part.kind == "set" and not self.traced:
                self._put(depth, f"if s[{at}] in {self._value(part.chars, lambda p=part: p.chars)}:")
                self._put(depth + 1, f"{step} = {at} + 1")
            else:
                self.write(part, at, step, depth)
                if self.traced or not (part.kind in ("star", "opt")):
                    self._put(depth, f"if {step} >= 0:")
                else:
                    depth -= 1
            at, depth = step, depth + 1
        self.write(parts[-1], at, out, depth)
