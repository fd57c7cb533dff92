"""A small sandboxed template language, compiled to Python closures.

Statements: {{ expr }}, {% for x in expr %}, {% if expr %} / {% elif expr %} / {% else %}, {% set x = expr %},
{% generation %} (its output is marked), each closed by {% endNAME %} where it opens a body.
Expressions: or, and, not, ==, !=, in, ~ (join as text), literals, names, x.field, expr | filter, parentheses.

The sandbox is the language itself: names come only from the context and the template, a field is a key of a dict, filters are
the given functions; there are no calls, attributes, imports or Python names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[~|.()]))")
ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    """The template does not follow the language."""


@dataclass
class Output:
    """Rendered text and the marked spans, in code points."""

    parts: list = field(default_factory=list)
    length: int = 0
    spans: list = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def as_text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


class Expression:
    """Recursive descent over the tokens of one expression; nodes are tuples (kind, ...)."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.tokens, self.filters, at = [], filters, 0
        source = source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def parse(self):
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return fold(node, self.filters)

    def accept(self, *values: str):
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def chain(self, below, *operators: str):
        node = below()
        while op := self.accept(*operators):
            node = (op, node, below())
        return node

    def either(self):
        return self.chain(self.both, "or")

    def both(self):
        return self.chain(self.negated, "and")

    def negated(self):
        return ("not", self.negated()) if self.accept("not") else self.compared()

    def compared(self):
        return self.chain(self.joined, "==", "!=", "in")

    def joined(self):
        return self.chain(self.filtered, "~")

    def filtered(self):
        node = self.primary()
        while op := self.accept(".", "|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
            if kind != "name":
                raise TemplateError(f"a name must follow {op!r}")
            self.at += 1
            if op == "|" and name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            node = ("field" if op == "." else "filter", node, name)
        return node

    def primary(self):
        if self.accept("("):
            node = self.either()
            if not self.accept(")"):
                raise TemplateError("missing )")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1]))
        if kind == "int":
            return ("const", int(text))
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else ("name", text)
        raise TemplateError(f"unexpected {text!r}")


def closure(node, filters) -> Callable[[dict], object]:
    """A function of the environment for an expression node."""
    kind = node[0]
    if kind == "const":
        return lambda env, value=node[1]: value
    if kind == "name":
        return lambda env, name=node[1]: env.get(name)
    if kind == "not":
        inner = closure(node[1], filters)
        return lambda env: not inner(env)
    left = closure(node[1], filters)
    if kind == "field":
        def get(env, name=node[2]):
            value = left(env)
            return value.get(name) if isinstance(value, dict) else None
        return get
    if kind == "filter":
        return lambda env, f=filters[node[2]]: f(left(env))
    right = closure(node[2], filters)
    return {
        "or": lambda env: left(env) or right(env), "and": lambda env: left(env) and right(env),
        "==": lambda env: left(env) == right(env), "!=": lambda env: left(env) != right(env),
        "in": lambda env: left(env) in (right(env) or ()), "~": lambda env: as_text(left(env)) + as_text(right(env)),
    }[kind]


def fold(node, filters):
    """Replace what depends on no name by its value."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    node = (kind, *(fold(x, filters) if isinstance(x, tuple) else x for x in node[1:]))
    if all(x[0] == "const" for x in node[1:] if isinstance(x, tuple)):
        return ("const", closure(node, filters)({}))
    return node


class Template:
    """Syntax tree and compiled form of a template."""

    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        self.filters = filters or {}
        self.pieces, at = [], 0
        for m in TAG.finditer(source):
            self.pieces += [("text", source[at: m.start()])] if m.start() > at else []
            self.pieces.append(("expr", m[1]) if m[1] is not None else ("tag", m[2].strip()))
            at = m.end()
        self.pieces += [("text", source[at:])] if at < len(source) else []
        self.at = 0
        self.tree = self.body(())
        if self.at < len(self.pieces):
            raise TemplateError(f"unexpected {self.pieces[self.at][1]!r}")
        self.run = self.compiled(self.tree)

    def expression(self, source: str):
        return Expression(source, self.filters).parse()

    def body(self, until: tuple[str, ...]) -> list:
        """Nodes up to a tag whose first word is in until; constants and texts next to each other are one text."""
        nodes: list = []

        def add(node):
            if node[0] == "text" and nodes and nodes[-1][0] == "text":
                nodes[-1] = ("text", nodes[-1][1] + node[1])
            else:
                nodes.append(node)
        while self.at < len(self.pieces):
            kind, content = self.pieces[self.at]
            if kind == "tag" and content.split(None, 1)[0:1] and content.split(None, 1)[0] in until:
                return nodes
            self.at += 1
            if kind == "text":
                add(("text", content))
            elif kind == "expr":
                e = self.expression(content)
                add(("text", as_text(e[1])) if e[0] == "const" else ("print", e))
            else:
                for node in self.statement(content):
                    add(node)
        if until:
            raise TemplateError(f"missing {until[-1]}")
        return nodes

    def close(self) -> str:
        self.at += 1
        return self.pieces[self.at - 1][1]

    def statement(self, content: str) -> list:
        word, _, rest = content.partition(" ")
        if word == "generation":
            inner = self.body(("endgeneration",))
            self.close()
            return [("mark", inner)]
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"cannot read {content!r}")
            inner = self.body(("endfor",))
            self.close()
            return [("for", m[1], self.expression(m[2]), inner)]
        if word == "set":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"cannot read {content!r}")
            return [("set", m[1], self.expression(m[2]))]
        if word == "if":
            branches, test = [], self.expression(rest)
            while True:
                inner = self.body(("elif", "else", "endif"))
                branches.append((test, inner))
                word, _, rest = self.close().partition(" ")
                if word == "endif":
                    break
                test = self.expression(rest) if word == "elif" else ("const", True)
            # branches that cannot be reached go; one that always holds needs no test
            live = [b for b in branches if b[0][0] != "const" or b[0][1]]
            if live and live[0][0][0] == "const":
                return live[0][1]
            return [("if", live)] if live else []
        raise TemplateError(f"unknown statement {content!r}")

    def compiled(self, nodes: list) -> Callable[[dict, Output], None]:
        steps = [self.step(n) for n in nodes]

        def run(env: dict, out: Output) -> None:
            for s in steps:
                s(env, out)
        return steps[0] if len(steps) == 1 else run

    def step(self, node) -> Callable[[dict, Output], None]:
        kind = node[0]
        if kind == "text":
            return lambda env, out, text=node[1]: out.write(text)
        if kind == "print":
            value = closure(node[1], self.filters)
            return lambda env, out: out.write(as_text(value(env)))
        if kind == "mark":
            inner = self.compiled(node[1])

            def mark(env, out):
                begin = out.length
                inner(env, out)
                if out.length > begin:
                    out.spans.append((begin, out.length))
            return mark
        if kind == "set":
            value = closure(node[2], self.filters)
            return lambda env, out, name=node[1]: env.__setitem__(name, value(env))
        if kind == "for":
            items, inner = closure(node[2], self.filters), self.compiled(node[3])

            def loop(env, out, name=node[1]):
                values = list(items(env) or ())
                for i, value in enumerate(values):
                    inner({**env, name: value, "loop": {"index": i + 1, "first": i == 0, "last": i + 1 == len(values)}}, out)
            return loop
        tests = [(closure(t, self.filters), self.compiled(b)) for t, b in node[1]]

        def branch(env, out):
            for test, inner in tests:
                if test(env):
                    return inner(env, out)
        return branch

    def render(self, **context) -> Output:
        out = Output()
        self.run(dict(context), out)
        return out
