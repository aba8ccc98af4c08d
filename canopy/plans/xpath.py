"""XPath text to syntax tree. A tree is nested tuples: (kind, operands...)."""

from __future__ import annotations

import re
from decimal import Decimal

AXES = frozenset(
    "ancestor ancestor-or-self attribute child descendant descendant-or-self following following-sibling namespace parent preceding preceding-sibling self".split()
)
REVERSE_AXES = frozenset("ancestor ancestor-or-self preceding preceding-sibling parent".split())
NODE_TESTS = frozenset("node text comment processing-instruction document-node element attribute namespace-node item".split())
MAX_DEPTH = 64


class XPathError(ValueError):
    """A static or dynamic error; ``code`` is the local name of the error code."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


_NAME = r"[^\W\d][\w.\-·]*"
_LEX = re.compile(
    rf"""\s+|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<string>"(?:[^"]|"")*"|'(?:[^']|'')*')|(?P<bq>Q\{{[^{{}}]*\}}(?:{_NAME}|\*))
    |(?P<name>{_NAME}(?::(?!:)(?:{_NAME}|\*))?|\*:{_NAME})|(?P<op>::|:=|//|\.\.|!=|<=|>=|<<|>>|\|\||=>|[()\[\]{{}}.,@/|+\-*=<>$!?\#:])""",
    re.X,
)


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each token; comments (: :) nest."""
    out, at = [], 0
    while at < len(text):
        if text.startswith("(:", at):
            depth, at = 1, at + 2
            while depth:
                m = re.compile(r"\(:|:\)").search(text, at)
                if not m:
                    raise XPathError("XPST0003", "comment without an end")
                depth, at = depth + (1 if m[0] == "(:" else -1), m.end()
            continue
        m = _LEX.match(text, at)
        if not m:
            raise XPathError("XPST0003", f"unexpected {text[at]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.depth = tokens(text), 0, 0

    def peek(self, ahead: int = 0) -> str:
        at = self.at + ahead
        return self.tokens[at][1] if at < len(self.tokens) and self.tokens[at][0] != "string" else ""

    def kind(self, ahead: int = 0) -> str:
        at = self.at + ahead
        return self.tokens[at][0] if at < len(self.tokens) else "end"

    def take(self, text: str | None = None) -> str:
        kind, found = self.tokens[self.at]
        if text is not None and (found != text or kind == "string"):
            raise XPathError("XPST0003", f"expected {text!r}, found {found!r}")
        self.at += 1
        return found

    def accept(self, *texts: str) -> str | None:
        return self.take() if self.peek() in texts and self.peek() else None

    def whole(self) -> tuple:
        tree = self.expr()
        if self.kind() != "end":
            raise XPathError("XPST0003", f"unexpected {self.peek()!r}")
        return tree

    def expr(self) -> tuple:
        items = [self.single()]
        while self.accept(","):
            items.append(self.single())
        return items[0] if len(items) == 1 else ("sequence", items)

    def single(self) -> tuple:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise XPathError("XPST0003", "expression nested too deeply")
        try:
            word, after = self.peek(), self.peek(1)
            if word in ("for", "let") and after == "$":
                return self.binding(word)
            if word in ("some", "every") and after == "$":
                self.take()
                bound = self.bindings("in")
                self.take("satisfies")
                return ("quantified", word, bound, self.single())
            if word == "if" and after == "(":
                self.take()
                self.take()
                test = self.expr()
                self.take(")")
                self.take("then")
                then = self.single()
                self.take("else")
                return ("if", test, then, self.single())
            if word == "try" and after == "{":
                return self.try_catch()
            return self.binary(0)
        finally:
            self.depth -= 1

    def bindings(self, word: str) -> list[tuple[str, tuple]]:
        found = []
        while True:
            self.take("$")
            name = self.take()
            if self.accept("as"):
                self.sequence_type()
            self.take(word)
            found.append((name, self.single()))
            if not self.accept(","):
                return found

    def binding(self, word: str) -> tuple:
        self.take()
        bound = self.bindings("in" if word == "for" else ":=")
        body = self.binding(self.peek()) if self.peek() in ("for", "let") and self.peek(1) == "$" else None
        if body is None:
            self.take("return")
            body = self.single()
        for name, value in reversed(bound):
            body = (word, name, value, body)
        return body

    def try_catch(self) -> tuple:
        self.take("try")
        self.take("{")
        body = self.expr()
        self.take("}")
        handlers = []
        while self.accept("catch"):
            codes = [self.take()]
            while self.accept("|"):
                codes.append(self.take())
            self.take("{")
            handlers.append((codes, self.expr()))
            self.take("}")
        return ("try", body, handlers)

    LEVELS = (
        {"or": "or"},
        {"and": "and"},
        {"=": "=", "!=": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">=", "eq": "eq", "ne": "ne", "lt": "lt", "le": "le", "gt": "gt", "ge": "ge", "is": "is", "<<": "<<", ">>": ">>"},
        {"||": "||"},
        {"to": "to"},
        {"+": "+", "-": "-"},
        {"*": "*", "div": "div", "idiv": "idiv", "mod": "mod"},
        {"|": "union", "union": "union"},
        {"intersect": "intersect", "except": "except"},
    )

    def binary(self, level: int) -> tuple:
        if level == len(self.LEVELS):
            return self.typed()
        left = self.binary(level + 1)
        while self.kind() in ("op", "name") and self.peek() in self.LEVELS[level]:
            op = self.LEVELS[level][self.take()]
            left = ("binary", op, left, self.binary(level + 1))
        return left

    def typed(self) -> tuple:
        value = self.arrow()
        for first, second, kind in (("instance", "of", "instance"), ("treat", "as", "treat"), ("castable", "as", "castable"), ("cast", "as", "cast")):
            if self.peek() == first and self.peek(1) == second:
                self.take()
                self.take()
                value = (kind, value, self.sequence_type())
        return value

    def sequence_type(self) -> tuple[str, str]:
        name = self.take()
        if self.accept("("):
            inner = ""
            depth = 1
            while depth:
                word = self.take()
                depth += (word == "(") - (word == ")")
                inner += word if depth else ""
                if self.kind() == "end" and depth:
                    raise XPathError("XPST0003", "unfinished type")
            name += f"({inner})"
        elif name == "(":
            self.take(")")
            name = "empty-sequence()"
        return name, self.accept("?", "*", "+") or ""

    def arrow(self) -> tuple:
        value = self.unary()
        while self.accept("=>"):
            if self.accept("$"):
                target: tuple = ("variable", self.take())
            elif self.peek() == "(":
                self.take()
                target = self.expr()
                self.take(")")
            else:
                name = self.take()
                self.take("(")
                value = ("call", name, [value, *self.arguments()])
                continue
            self.take("(")
            value = ("apply", target, [value, *self.arguments()])
        return value

    def unary(self) -> tuple:
        sign = 1
        signed = False
        while self.peek() in ("+", "-"):
            sign = -sign if self.take() == "-" else sign
            signed = True
        value = self.simple_map()
        return ("negate", value) if sign < 0 else ("plus", value) if signed else value

    def simple_map(self) -> tuple:
        value = self.path()
        while self.accept("!"):
            value = ("map-operator", value, self.path())
        return value

    def path(self) -> tuple:
        if self.accept("/"):
            start: tuple = ("root",)
            if not self.starts_step():
                return start
            steps = [self.step()]
        elif self.accept("//"):
            start, steps = ("root",), [("axis", "descendant-or-self", ("kind", "node", None), []), self.step()]
        else:
            first = self.step()
            if self.peek() not in ("/", "//"):
                return first if first[0] != "axis" else ("path", ("context",), [first])
            start, steps = (("context",), [first]) if first[0] == "axis" else (first, [])
        while op := self.accept("/", "//"):
            if op == "//":
                steps.append(("axis", "descendant-or-self", ("kind", "node", None), []))
            steps.append(self.step())
        return ("path", start, steps)

    def starts_step(self) -> bool:
        return self.kind() in ("name", "bq", "string", "number") or self.peek() in ("*", "@", ".", "..", "$", "(", "[", "?")

    def step(self) -> tuple:
        if self.accept(".."):
            return ("axis", "parent", ("kind", "node", None), self.predicates())
        if self.accept("@"):
            return ("axis", "attribute", self.node_test("attribute"), self.predicates())
        word, after = self.peek(), self.peek(1)
        if self.kind() == "name" and after == "::":
            if word not in AXES:
                raise XPathError("XPST0003", f"no axis {word}")
            self.take()
            self.take()
            return ("axis", word, self.node_test(word), self.predicates())
        if word == "*" or self.kind() == "bq" and after != "(":
            return ("axis", "child", self.node_test("child"), self.predicates())
        if self.kind() == "name" and word not in ("map", "array", "function") or self.kind() == "name" and after not in ("{", "("):
            if after == "(" and word in NODE_TESTS:
                axis = "attribute" if word == "attribute" else "child"
                return ("axis", axis, self.node_test(axis), self.predicates())
            if after not in ("(", "#") or word.endswith("*") or word.startswith("*"):
                return ("axis", "child", self.node_test("child"), self.predicates())
        return self.postfix()

    def node_test(self, axis: str) -> tuple:
        if self.kind() == "bq":
            uri, _, local = self.take()[2:].partition("}")
            return ("name", ("uri", uri), local)
        if self.accept("*"):
            return ("name", None, "*")
        name = self.take()
        if self.peek() == "(" and name in NODE_TESTS:
            self.take()
            argument = None
            if self.peek() != ")" or self.kind() == "string":
                kind, text = self.tokens[self.at]
                argument = text[1:-1] if kind == "string" else text
                self.take()
                while self.peek() != ")":
                    self.take()
            self.take(")")
            return ("kind", name, argument)
        prefix, colon, local = name.rpartition(":")
        if name.startswith("*:"):
            return ("name", "*", local)
        return ("name", ("prefix", prefix) if colon else None if local == "*" else ("default",), local)

    def predicates(self) -> list[tuple]:
        found = []
        while self.accept("["):
            found.append(self.expr())
            self.take("]")
        return found

    def arguments(self) -> list[tuple]:
        found: list[tuple] = []
        if not self.accept(")"):
            while True:
                if self.peek() == "?" and self.peek(1) in (",", ")"):
                    self.take()
                    found.append(("hole",))
                else:
                    found.append(self.single())
                if not self.accept(","):
                    break
            self.take(")")
        return found

    def postfix(self) -> tuple:
        value = self.primary()
        while True:
            if self.accept("["):
                value = ("filter", value, self.expr())
                self.take("]")
            elif self.peek() == "(" and value[0] in ("variable", "filter", "inline", "apply", "lookup", "reference", "call", "paren", "map", "array"):
                self.take()
                value = ("apply", value, self.arguments())
            elif self.peek() == "?" and (self.kind(1) in ("name", "number") or self.peek(1) in ("*", "(")):
                self.take()
                value = ("lookup", value, self.key())
            else:
                return value

    def key(self) -> tuple:
        if self.accept("*"):
            return ("star",)
        if self.accept("("):
            inner = self.expr()
            self.take(")")
            return inner
        kind, text = self.tokens[self.at]
        self.take()
        return ("literal", int(text) if kind == "number" else text)

    def primary(self) -> tuple:
        kind, text = self.tokens[self.at]
        if kind == "number":
            self.take()
            return ("literal", float(text) if "e" in text.lower() else Decimal(text) if "." in text else int(text))
        if kind == "string":
            self.at += 1
            return ("literal", text[1:-1].replace(text[0] * 2, text[0]))
        if self.accept("$"):
            return ("variable", self.take())
        if self.accept("."):
            return ("context",)
        if self.accept("("):
            if self.accept(")"):
                return ("sequence", [])
            inner = self.expr()
            self.take(")")
            return ("paren", inner)
        if self.accept("["):
            members = []
            if not self.accept("]"):
                members.append(self.single())
                while self.accept(","):
                    members.append(self.single())
                self.take("]")
            return ("array", members)
        if self.accept("?"):
            return ("lookup", ("context",), self.key())
        if kind in ("name", "bq"):
            self.take()
            if text == "map" and self.accept("{"):
                entries = []
                while not self.accept("}"):
                    key = self.single()
                    self.take(":")
                    entries.append((key, self.single()))
                    self.accept(",")
                return ("map", entries)
            if text == "array" and self.accept("{"):
                inner = ("sequence", []) if self.peek() == "}" else self.expr()
                self.take("}")
                return ("curly-array", inner)
            if text == "function" and self.peek() == "(":
                return self.inline()
            if self.accept("#"):
                return ("reference", text, int(self.take()))
            if self.accept("("):
                return ("call", text, self.arguments())
        raise XPathError("XPST0003", f"unexpected {text!r}")

    def inline(self) -> tuple:
        self.take("(")
        names = []
        while not self.accept(")"):
            self.take("$")
            names.append(self.take())
            if self.accept("as"):
                self.sequence_type()
            self.accept(",")
        if self.accept("as"):
            self.sequence_type()
        self.take("{")
        body = ("sequence", []) if self.peek() == "}" else self.expr()
        self.take("}")
        return ("inline", names, body)


def compile_xpath(text: str) -> tuple:
    """Syntax tree of an expression; raises XPathError before any job starts."""
    try:
        return _Parser(text).whole()
    except RecursionError:
        raise XPathError("XPST0003", "expression nested too deeply") from None


def parse_type(text: str) -> tuple[str, str]:
    """(item type, occurrence) of a sequence type."""
    return _Parser(text).sequence_type()
