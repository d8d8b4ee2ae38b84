"""A small sandboxed template language, compiled to Python closures.

Text with ``{{ expression }}`` and the statements ``for x in y``/``endfor``, ``if``/``elif``/``else``/``endif``,
``set x = e`` and ``generation``/``endgeneration`` in ``{% %}``. Expressions: names, ``a.b``, ``a['b']``, text and
whole numbers, ``true``/``false``/``none``, ``+``, ``~``, ``==``, ``!=``, ``in``, ``not``, ``and``, ``or``,
parentheses and the filters given to the compiler. There are no calls and no attributes of objects: only
keys of the mappings handed in, so a template cannot reach anything else.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|[()\[\].|~+]))")
CONSTANTS = {"true": True, "false": False, "none": None}
ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class TemplateError(ValueError):
    """The template breaks a rule, or names something that it was not given."""


@dataclass(frozen=True)
class Node:
    """A part of the syntax tree: what it is, its own value and its parts."""

    kind: str
    value: Any = None
    parts: tuple["Node", ...] = ()


@dataclass
class Output:
    """The text written so far, and the places of generated text, in characters."""

    pieces: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


class _Expression:
    """Reads one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, Any]] = []
        at = 0
        source = source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            number, text, name, sign = m.groups()
            if number:
                self.tokens.append(("value", int(number)))
            elif text:
                self.tokens.append(("value", re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[0]), text[1:-1], flags=re.S)))
            elif name in CONSTANTS:
                self.tokens.append(("value", CONSTANTS[name]))
            else:
                self.tokens.append(("sign" if sign or name in ("and", "or", "not", "in") else "name", sign or name))
            at = m.end()
        self.at = 0

    def see(self, *signs: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == "sign" and self.tokens[self.at][1] in signs

    def take(self, kind: str | None = None, value: Any = None) -> Any:
        if self.at >= len(self.tokens) or kind and self.tokens[self.at][0] != kind or value and self.tokens[self.at][1] != value:
            raise TemplateError(f"expected {value or kind or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"did not expect {self.tokens[self.at][1]!r}")
        return node

    def chain(self, below: Callable[[], Node], *signs: str) -> Node:
        node = below()
        while self.see(*signs):
            node = Node(self.take(), None, (node, below()))
        return node

    def either(self) -> Node:
        return self.chain(self.each, "or")

    def each(self) -> Node:
        return self.chain(self.negated, "and")

    def negated(self) -> Node:
        if self.see("not"):
            self.take()
            return Node("not", None, (self.negated(),))
        return self.chain(self.joined, "==", "!=", "in")

    def joined(self) -> Node:
        return self.chain(self.filtered, "+", "~")

    def filtered(self) -> Node:
        node = self.single()
        while self.see("|", ".", "["):
            sign = self.take()
            if sign == "|":
                node = Node("filter", self.take("name"), (node,))
            elif sign == ".":
                node = Node("item", None, (node, Node("value", self.take("name"))))
            else:
                node = Node("item", None, (node, self.either()))
                self.take("sign", "]")
        return node

    def single(self) -> Node:
        if self.see("("):
            self.take()
            node = self.either()
            self.take("sign", ")")
            return node
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            return Node("name", self.take())
        return Node("value", self.take("value"))


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    tags: list[tuple[str, str]] = []
    at = 0
    for m in TAG.finditer(source):
        if m.start() > at:
            tags.append(("text", source[at : m.start()]))
        tags.append(("put", m[1]) if m[1] is not None else ("do", m[2].strip()))
        at = m.end()
    if at < len(source):
        tags.append(("text", source[at:]))
    place = 0

    def block(*ends: str) -> tuple[Node, str]:
        nonlocal place
        parts: list[Node] = []
        while place < len(tags):
            kind, body = tags[place]
            place += 1
            if kind == "text":
                parts.append(Node("write", None, (Node("value", body),)))
                continue
            if kind == "put":
                parts.append(Node("write", None, (_Expression(body).whole(),)))
                continue
            word, _, rest = body.partition(" ")
            if word in ends:
                return Node("block", None, tuple(parts)), body
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"cannot read {body!r}")
                inside, _ = block("endfor")
                parts.append(Node("for", m[1], (_Expression(m[2]).whole(), inside)))
            elif word == "if":
                parts.append(condition(rest))
            elif word == "set":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"cannot read {body!r}")
                parts.append(Node("set", m[1], (_Expression(m[2]).whole(),)))
            elif word == "generation":
                inside, _ = block("endgeneration")
                parts.append(Node("generation", None, (inside,)))
            else:
                raise TemplateError(f"unknown statement {body!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return Node("block", None, tuple(parts)), ""

    def condition(rest: str) -> Node:
        inside, end = block("elif", "else", "endif")
        other = Node("block")
        if end.startswith("elif"):
            other = condition(end.partition(" ")[2])
        elif end == "else":
            other, _ = block("endif")
        return Node("if", None, (_Expression(rest).whole(), inside, other))

    return block()[0]


OPERATIONS: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b, "~": lambda a, b: shown(a) + shown(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b,
}


def shown(value: Any) -> str:
    return "" if value is None else str(value)


def fold(node: Node, filters: Mapping[str, Callable[[Any], Any]]) -> Node:
    """The same tree with constant parts worked out, dead branches gone and texts side by side joined."""
    parts = tuple(fold(p, filters) for p in node.parts)
    node = Node(node.kind, node.value, parts)
    known = bool(parts) and all(p.kind == "value" for p in parts)
    if node.kind in OPERATIONS and known:
        try:
            return Node("value", OPERATIONS[node.kind](parts[0].value, parts[1].value))
        except TypeError as e:
            raise TemplateError(str(e)) from e
    if node.kind == "filter":
        if node.value not in filters:
            raise TemplateError(f"unknown filter {node.value!r}")
        return Node("value", filters[node.value](parts[0].value)) if known else node
    if node.kind == "not" and known:
        return Node("value", not parts[0].value)
    if node.kind in ("and", "or") and parts[0].kind == "value":
        return parts[1] if bool(parts[0].value) == (node.kind == "and") else parts[0]
    if node.kind == "if" and parts[0].kind == "value":
        return parts[1] if parts[0].value else parts[2]
    if node.kind == "block":
        flat: list[Node] = []
        for p in parts:
            for q in p.parts if p.kind == "block" else (p,):
                if q.kind == "write" and q.parts[0].kind == "value" and flat and flat[-1].kind == "write" and flat[-1].parts[0].kind == "value":
                    q = Node("write", None, (Node("value", shown(flat.pop().parts[0].value) + shown(q.parts[0].value)),))
                flat.append(q)
        return Node("block", None, tuple(flat))
    return node


def _value(node: Node, filters: Mapping[str, Callable[[Any], Any]]) -> Callable[[dict], Any]:
    kind, value = node.kind, node.value
    parts = [_value(p, filters) for p in node.parts]
    if kind == "value":
        return lambda scope: value
    if kind == "name":
        def name(scope: dict) -> Any:
            if value not in scope:
                raise TemplateError(f"{value!r} is not given")
            return scope[value]
        return name
    if kind == "item":
        def item(scope: dict, of=parts[0], key=parts[1]) -> Any:
            holder, k = of(scope), key(scope)
            if isinstance(holder, Mapping):
                return holder.get(k)
            if isinstance(holder, Sequence) and not isinstance(holder, str) and isinstance(k, int):
                return holder[k] if k < len(holder) else None
            raise TemplateError(f"no key {k!r} here")
        return item
    if kind == "filter":
        run, inner = filters[value], parts[0]
        return lambda scope: run(inner(scope))
    if kind == "not":
        inner = parts[0]
        return lambda scope: not inner(scope)
    one, two = parts
    if kind == "and":
        return lambda scope: one(scope) and two(scope)
    if kind == "or":
        return lambda scope: one(scope) or two(scope)
    run = OPERATIONS[kind]
    return lambda scope: run(one(scope), two(scope))


def _statement(node: Node, filters: Mapping[str, Callable[[Any], Any]]) -> Callable[[dict, Output], None]:
    kind, name = node.kind, node.value
    if kind == "write":
        if node.parts[0].kind == "value":
            text = shown(node.parts[0].value)
            return lambda scope, out: out.write(text)
        value = _value(node.parts[0], filters)
        return lambda scope, out: out.write(shown(value(scope)))
    if kind == "block":
        steps = [_statement(p, filters) for p in node.parts]

        def block(scope: dict, out: Output) -> None:
            for step in steps:
                step(scope, out)
        return block
    if kind == "set":
        value = _value(node.parts[0], filters)

        def assign(scope: dict, out: Output) -> None:
            scope[name] = value(scope)
        return assign
    if kind == "if":
        test = _value(node.parts[0], filters)
        yes, no = (_statement(p, filters) for p in node.parts[1:])
        return lambda scope, out: (yes if test(scope) else no)(scope, out)
    if kind == "generation":
        inside = _statement(node.parts[0], filters)

        def generated(scope: dict, out: Output) -> None:
            begin = out.length
            inside(scope, out)
            out.spans.append((begin, out.length))
        return generated
    over, inside = _value(node.parts[0], filters), _statement(node.parts[1], filters)

    def loop(scope: dict, out: Output) -> None:
        items = over(scope)
        if isinstance(items, (str, Mapping)) or not isinstance(items, Sequence):
            raise TemplateError("only lists can be gone through")
        own = dict(scope)
        for i, x in enumerate(items):
            own[name] = x
            own["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
            inside(own, out)
    return loop


def compile_template(source: str, filters: Mapping[str, Callable[[Any], Any]] | None = None) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the names that the template uses; it gives the text and the spans of generated text."""
    filters = {"trim": lambda s: shown(s).strip(), "upper": lambda s: shown(s).upper(), "lower": lambda s: shown(s).lower(), "length": len, **(filters or {})}
    run = _statement(fold(parse(source), filters), filters)

    def render(**names: Any) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run(names, out)
        return "".join(out.pieces), out.spans

    return render
