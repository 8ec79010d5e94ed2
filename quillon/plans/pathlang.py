"""Parser for path expressions: an XPath 1.0 subset over statements."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"\s*(?:(?P<string>\"[^\"]*\"|'[^']*')|(?P<number>\d+(?:\.\d*)?|\.\d+)|(?P<var>\$[\w.-]+)|(?P<op>//|\.\.|!=|<=|>=|[/@*\[\]()=<>|,+.-])|(?P<name>[A-Za-z_][\w.-]*(?::(?:[A-Za-z_][\w.-]*|\*))?))"
)


@dataclass(frozen=True)
class Literal:
    value: str | float


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Step:
    axis: str  # child, descendant, parent, self, attribute
    test: str
    predicates: tuple = field(default=())


@dataclass(frozen=True)
class Path:
    absolute: bool
    steps: tuple


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"path: unexpected {text[at:at + 12]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Parser:
    LEVELS = (("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("div", "mod"), ("|",))

    def __init__(self, text: str):
        self.items, self.at = tokens(text), 0

    def peek(self, ahead: int = 0) -> str | None:
        i = self.at + ahead
        return self.items[i][1] if i < len(self.items) else None

    def kind(self) -> str | None:
        return self.items[self.at][0] if self.at < len(self.items) else None

    def take(self, wanted: str | None = None) -> str:
        got = self.peek()
        if got is None or wanted is not None and got != wanted:
            raise SyntaxError(f"path: expected {wanted or 'more'}, found {got!r}")
        self.at += 1
        return got

    def parse(self):
        out = self.binary(0)
        if self.peek() is not None:
            raise SyntaxError(f"path: unexpected {self.peek()!r}")
        return out

    def binary(self, level: int):
        if level == len(self.LEVELS):
            return self.primary()
        left = self.binary(level + 1)
        while self.peek() in self.LEVELS[level]:
            op = self.take()
            left = Binary(op, left, self.binary(level + 1))
        return left

    def primary(self):
        kind, text = self.kind(), self.peek()
        if kind == "string":
            self.take()
            return Literal(text[1:-1])
        if kind == "number":
            self.take()
            return Literal(float(text))
        if kind == "var":
            self.take()
            return Variable(text[1:])
        if text == "-":
            self.take()
            return Binary("-", Literal(0.0), self.primary())
        if text == "(":
            self.take()
            inner = self.binary(0)
            self.take(")")
            return self.filtered(inner)
        if kind == "name" and self.peek(1) == "(" and text not in ("node", "text"):
            self.take()
            self.take("(")
            args = []
            while self.peek() != ")":
                args.append(self.binary(0))
                if self.peek() == ",":
                    self.take()
            self.take(")")
            return Call(text, tuple(args))
        return self.path()

    def filtered(self, inner):
        """(path)[predicate]"""
        found = []
        while self.peek() == "[":
            found.append(self.predicate())
        return Call("filtered", (inner, *found)) if found else inner

    def predicate(self):
        self.take("[")
        out = self.binary(0)
        self.take("]")
        return out

    def path(self) -> Path:
        steps, absolute = [], False
        axis = "child"
        if self.peek() in ("/", "//"):
            absolute = True
            axis = "descendant" if self.take() == "//" else "child"
            if self.peek() is None:
                return Path(True, ())
        while True:
            steps.append(self.step(axis))
            if self.peek() not in ("/", "//"):
                return Path(absolute, tuple(steps))
            axis = "descendant" if self.take() == "//" else "child"

    def step(self, axis: str) -> Step:
        text = self.take()
        if text == ".":
            axis, test = "self", "node()"
        elif text == "..":
            axis, test = "parent", "node()"
        elif text == "@":
            axis, test = "attribute", self.take()
        elif text in ("node", "text") and self.peek() == "(":
            self.take()
            self.take(")")
            test = text + "()"
        elif text == "*" or self.items[self.at - 1][0] == "name":
            test = text
        else:
            raise SyntaxError(f"path: unexpected {text!r}")
        found = []
        while self.peek() == "[":
            found.append(self.predicate())
        return Step(axis, test, tuple(found))


def parse(text: str):
    return Parser(text).parse()
