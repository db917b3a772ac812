"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and the tree becomes Python closures that
yield pieces of text, each marked as generated (under the loss mask) or not. Messages are drawn one by one, so a conversation of any
length is rendered in the memory of one message. Texts are escaped reversibly: a control string in a text gets a backslash after its
first character, a backslash becomes two; ``read_back`` recovers roles, texts and mask from the formatted output alone.

Language: ``{{ expression }}``, ``{% for x in e %} {% endfor %}``, ``{% if e %} {% elif e %} {% else %} {% endif %}``,
``{% generation %} {% endgeneration %}``. Expressions have strings, integers, true, false, names, ``a.b`` on mappings only, ``+``, ``==``,
``!=``, ``not``, ``and``, ``or``, brackets and the filters escape, trim, upper and lower. There are no calls, indexes or Python attributes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TURN]")
DEFAULT = """{{ bos }}{% for m in messages %}{% if m.role == 'user' %}[INST] {{ m.text|escape }} [/INST]{% elif m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}</s>{% elif m.role == 'system' %}[SYS]{{ m.text|escape }}[/SYS]{% else %}[ROLE]{{ m.role|escape }}[/ROLE]{{ m.text|escape }}[/TURN]{% endif %}{% endfor %}"""
MAX_TEMPLATE, MAX_DEPTH = 20_000, 32

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_SPECIAL = re.compile(r"\\|" + _CONTROL.pattern)


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template is outside the language."""


# --- syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    name: str


@dataclass(frozen=True)
class Apply:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filtered:
    of: Any
    name: str


@dataclass(frozen=True)
class Emit:
    value: Any


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Choice:
    arms: tuple  # of (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_LEX = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.|()+]))")


class _Expression:
    """Recursive descent over one expression, loosest operator first."""

    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            if not (m := _LEX.match(text, at)):
                raise TemplateError(f"unexpected {text[at:].strip()[:20]!r}")
            self.items.append((("str", "int", "name", "op")[m.lastindex - 1], m[m.lastindex]))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.items) and self.items[self.at][1] in values and self.items[self.at][0] in ("op", "name"):
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def whole(self, depth: int = 0):
        found = self.any(depth)
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return found

    def _chain(self, inner: Callable, ops: tuple[str, ...], depth: int):
        left = inner(depth)
        while op := self.take(*ops):
            left = Apply(op, (left, inner(depth)))
        return left

    def any(self, depth: int):
        if depth > MAX_DEPTH:
            raise TemplateError("expression too deep")
        return self._chain(self.all, ("or",), depth)

    def all(self, depth: int):
        return self._chain(self.negation, ("and",), depth)

    def negation(self, depth: int):
        if self.take("not"):
            if depth > MAX_DEPTH:
                raise TemplateError("expression too deep")
            return Apply("not", (self.negation(depth + 1),))
        return self._chain(self.sum, ("==", "!="), depth)

    def sum(self, depth: int):
        return self._chain(self.postfix, ("+",), depth)

    def postfix(self, depth: int):
        left = self.atom(depth)
        while op := self.take(".", "|"):
            kind, value = self.items[self.at] if self.at < len(self.items) else ("", "")
            if kind != "name" or value.startswith("_"):
                raise TemplateError(f"no name after {op!r}")
            if op == "|" and value not in FILTERS:
                raise TemplateError(f"unknown filter {value!r}")
            self.at += 1
            left = Field(left, value) if op == "." else Filtered(left, value)
        return left

    def atom(self, depth: int):
        if self.take("("):
            found = self.any(depth + 1)
            if not self.take(")"):
                raise TemplateError("bracket not closed")
            return found
        if self.at >= len(self.items):
            raise TemplateError("expression ends early")
        kind, value = self.items[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "int":
            return Const(int(value))
        if kind == "name" and value not in ("or", "and", "not"):
            return Const(value == "true") if value in ("true", "false") else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(template: str) -> tuple:
    """The syntax tree of a template."""
    if len(template) > MAX_TEMPLATE:
        raise TemplateError("template too long")
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _PART.finditer(template):
        parts += [("text", template[at : m.start()]), ("out", m[1]) if m[1] is not None else ("tag", m[2].strip())]
        at = m.end()
    parts.append(("text", template[at:]))
    place = 0

    def body(ends: tuple[str, ...], depth: int) -> tuple[tuple, str]:
        nonlocal place
        if depth > MAX_DEPTH:
            raise TemplateError("blocks too deep")
        out: list = []
        while place < len(parts):
            kind, value = parts[place]
            place += 1
            word, _, rest = value.partition(" ")
            if kind == "text":
                out += [Emit(Const(value))] if value else []
            elif kind == "out":
                out.append(Emit(_Expression(value).whole()))
            elif word in ends:
                return tuple(out), value
            elif word == "for" and (m := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
                out.append(Loop(m[1], _Expression(m[2]).whole(), body(("endfor",), depth + 1)[0]))
            elif word == "generation":
                out.append(Generation(body(("endgeneration",), depth + 1)[0]))
            elif word == "if":
                arms, test = [], _Expression(rest).whole()
                while True:
                    inner, end = body(("elif", "else", "endif"), depth + 1)
                    arms.append((test, inner))
                    if end == "endif":
                        break
                    if end == "else":
                        arms.append((Const(True), body(("endif",), depth + 1)[0]))
                        break
                    test = _Expression(end.partition(" ")[2]).whole()
                out.append(Choice(tuple(arms)))
            else:
                raise TemplateError(f"unknown tag {value[:20]!r}")
        if ends:
            raise TemplateError(f"no {ends[-1]}")
        return tuple(out), ""

    return body((), 0)[0]


# --- folding


def text_of(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _apply(op: str, a: Any, b: Any = None) -> Any:
    if op == "+":
        return a + b if isinstance(a, int) and isinstance(b, int) else text_of(a) + text_of(b)
    return {"==": a == b, "!=": a != b, "not": not a}[op]


def fold_value(e: Any) -> Any:
    if isinstance(e, Field):
        return Field(fold_value(e.of), e.name)
    if isinstance(e, Filtered):
        of = fold_value(e.of)
        return Const(FILTERS[e.name](text_of(of.value))) if isinstance(of, Const) else Filtered(of, e.name)
    if isinstance(e, Apply):
        args = tuple(map(fold_value, e.args))
        if e.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (e.op == "and") else args[0]
        if e.op not in ("and", "or") and all(isinstance(a, Const) for a in args):
            return Const(_apply(e.op, *[a.value for a in args]))
        return Apply(e.op, args)
    return e


def fold(nodes: tuple) -> tuple:
    """The tree with constant expressions evaluated, dead branches gone and neighbouring texts joined."""
    out: list = []

    def add(node: Any) -> None:
        if isinstance(node, Emit) and isinstance(node.value, Const):
            text = text_of(node.value.value)
            if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                text = out.pop().value.value + text
            node = Emit(Const(text))
            if not text:
                return
        out.append(node)

    for node in nodes:
        if isinstance(node, Emit):
            add(Emit(fold_value(node.value)))
        elif isinstance(node, Loop):
            add(Loop(node.name, fold_value(node.over), fold(node.body)))
        elif isinstance(node, Generation):
            if body := fold(node.body):
                add(Generation(body))
        else:
            arms = []
            for test, body in node.arms:
                test = fold_value(test)
                if isinstance(test, Const) and not test.value:
                    continue
                arms.append((test, fold(body)))
                if isinstance(test, Const):
                    break
            if arms and isinstance(arms[0][0], Const):
                for inner in arms[0][1]:
                    add(inner)
            elif arms:
                add(Choice(tuple(arms)))
    return tuple(out)


# --- closures

Piece = tuple[str, bool]


def _value(e: Any) -> Callable[[dict], Any]:
    if isinstance(e, Const):
        return lambda env: e.value
    if isinstance(e, Name):
        return lambda env: env.get(e.name)
    if isinstance(e, Field):
        of = _value(e.of)
        return lambda env: x.get(e.name) if isinstance(x := of(env), dict) else None
    if isinstance(e, Filtered):
        of, f = _value(e.of), FILTERS[e.name]
        return lambda env: f(text_of(of(env)))
    args = [_value(a) for a in e.args]
    if e.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if e.op == "or":
        return lambda env: args[0](env) or args[1](env)
    return lambda env: _apply(e.op, *[a(env) for a in args])


def _body(nodes: tuple, under: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_node(n, under) for n in nodes]

    def run(env: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(env)

    return run


def _node(node: Any, under: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, Emit):
        value = _value(node.value)
        return lambda env: iter(((text_of(value(env)), under),))
    if isinstance(node, Generation):
        return _body(node.body, True)
    if isinstance(node, Choice):
        arms = [(_value(t), _body(b, under)) for t, b in node.arms]
        return lambda env: next((body(env) for test, body in arms if test(env)), iter(()))
    over, body = _value(node.over), _body(node.body, under)

    def loop(env: dict) -> Iterator[Piece]:
        items, index = iter(over(env) or ()), 0
        item, there = next(items, None), True
        while there and item is not None:
            after = next(items, None)
            yield from body(env | {node.name: item, "loop": {"index0": index, "first": index == 0, "last": after is None}})
            item, index = after, index + 1

    return loop


def compile_template(template: str = DEFAULT) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from messages (role, text) to pieces of text with their generation marks."""
    run = _body(fold(parse(template)), False)
    return lambda messages: run({"messages": messages, "bos": "<s>", "eos": "</s>"})


# --- reading back


def read_back(pieces: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of output in the default format, from its pieces in order; a turn's memory at a time."""
    held, role = "", ""
    kept: list[str] = []

    def closed(control: str) -> tuple[str, str] | None:
        nonlocal role
        text = "".join(kept)
        kept.clear()
        if control == "[/ROLE]":
            role = unescape(text)
        return {"[/INST]": ("user", unescape(text[1:-1])), "</s>": ("assistant", unescape(text)), "[/SYS]": ("system", unescape(text)), "[/TURN]": (role, unescape(text))}.get(control)

    longest = max(map(len, CONTROLS))
    for piece in pieces:
        held += piece
        at = 0
        for m in _CONTROL.finditer(held):
            kept.append(held[at : m.start()])
            at = m.end()
            if (turn := closed(m[0])) is not None:
                yield turn
        held = held[at:]
        if len(held) >= longest:  # a control may still lie across the end
            kept.append(held[: 1 - longest])
            held = held[1 - longest :]


# --- Spark

PARTS = "conv_id long, part long, text string, generated boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, Iterator[dict]]]:
    """Each conversation with an iterator over its messages, in the order of the rows."""
    rows = (row for batch in batches for at in range(0, batch.num_rows, 1024) for row in batch.slice(at, 1024).to_pylist())
    row = next(rows, None)
    while row is not None:
        key = row["conv_id"]

        def messages(key: Any = key) -> Iterator[dict]:
            nonlocal row
            while row is not None and row["conv_id"] == key:
                yield {"role": row["role"] or "", "text": row["text"] or ""}
                row = next(rows, None)

        own = messages()
        yield key, own
        for _ in own:  # what the template left
            pass


def _in_order(conversations: DataFrame) -> DataFrame:
    """A conversation is rendered by one task, turn by turn; ties of ``turn`` go by role and text, so repeated rows are turns of their own."""
    return conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted(conversations: DataFrame, template: str = DEFAULT) -> DataFrame:
    """Every conversation as numbered pieces of text, marked if generated; joined in order they are the formatted conversation.

    Null roles and texts are empty; a null turn comes first; rows with a null conv_id form one conversation.
    """
    compile_template(template)
    out = T.StructType.fromDDL(PARTS)

    def run(batches):
        render, arrow = compile_template(template), to_arrow_schema(out)
        rows: list[tuple] = []
        size = 0
        for key, messages in _conversations(batches):
            for k, (text, generated) in enumerate(render(messages)):
                rows.append((key, k, text, generated))
                size += len(text) + 32
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return _in_order(conversations).mapInArrow(run, out)


def digest_of(pieces: Iterable[Piece]) -> tuple[int, str, int, str, int]:
    """Turn count, digest of turns, length and digest of the unescaped loss text, formatted length: all read from formatted pieces."""
    turns, loss = hashlib.sha256(), hashlib.sha256()
    count = loss_chars = chars = 0

    def watched() -> Iterator[str]:
        nonlocal loss_chars, chars
        for text, generated in pieces:
            chars += len(text)
            if generated:
                plain = unescape(text)
                loss_chars += len(plain)
                loss.update(plain.encode("utf-8", "replace"))
            yield text

    for role, text in read_back(watched()):
        count += 1
        turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
    return count, turns.hexdigest(), loss_chars, loss.hexdigest(), chars


def digests(conversations: DataFrame) -> DataFrame:
    """The digest of every conversation in the default format, read back from its formatted output."""
    out = T.StructType.fromDDL(DIGESTS)

    def run(batches):
        render, arrow = compile_template(), to_arrow_schema(out)
        rows: list[tuple] = []
        for key, messages in _conversations(batches):
            rows.append((key, *digest_of(render(messages))))
            if len(rows) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return _in_order(conversations).mapInArrow(run, out)
