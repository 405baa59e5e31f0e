"""Chat formatting by a template compiler (operator 1).

A template has text, `{{ expression }}`, `{% for x in expression %}...{% endfor %}`, `{% if %} ... {% elif
%} ... {% else %} ... {% endif %}`, `{% set name = expression %}` and `{% generation %} ...
{% endgeneration %}`, which marks what a model is trained to write. Expressions have string and
integer literals, names, items by name (`m.role`, `m['role']`), filters (`|escape`, `|trim`,
`|upper`, `|lower`, `|length`), `+`, `==`, `!=`, `in`, `not`, `and`, `or` and brackets. The language
is sandboxed: items come from mappings only, there are no calls, attributes or imports, and nothing
is evaluated as Python source.

The source is parsed into a syntax tree, constants are folded (neighbouring texts joined, branches
that can't run removed), and each node becomes a Python closure. Rendering gives pieces and marks
in order, so that a conversation of any length needs the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Strings that structure the output; a backslash in front makes one plain text.
CONTROLS = ("<turn>", "</turn>", "### ")
TEMPLATE = (
    "{% for m in messages %}<turn>{{ m.role|escape }}### "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}"
    "{% else %}{{ m.text|escape }}{% endif %}</turn>\n{% endfor %}"
)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, "\\" + c)
    return text


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class TemplateError(ValueError):
    pass


# --- syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Filter:
    of: Any
    name: str


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body), the last condition may be Const(True)


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|[|.\[\]()+]))")
FILTERS: dict[str, Callable] = {"escape": lambda v: escape(_text(v)), "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "length": lambda v: len(v)}
_UNQUOTE = {"n": "\n", "t": "\t"}


def _text(v: Any) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v) if isinstance(v, (int, float)) else _fail(f"{type(v).__name__} is not text")


def _fail(why: str) -> Any:
    raise TemplateError(why)


class _Expression:
    """Parser of one expression, by descending precedence."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            number, quoted, word, sign = m.groups()
            self.tokens.append(("const", int(number)) if number else ("const", re.sub(r"\\(.)", lambda x: _UNQUOTE.get(x[1], x[1]), quoted[1:-1], flags=re.S)) if quoted else ("word", word) if word else ("sign", sign))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def word(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "word":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def whole(self) -> Any:
        out = self.any()
        return out if self.at == len(self.tokens) else _fail(f"unexpected {self.tokens[self.at][1]!r}")

    def any(self) -> Any:
        out = self.all()
        while self.take("or"):
            out = Op("or", (out, self.all()))
        return out

    def all(self) -> Any:
        out = self.negated()
        while self.take("and"):
            out = Op("and", (out, self.negated()))
        return out

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        out = self.sum()
        while name := self.take("==", "!=", "in"):
            out = Op(name, (out, self.sum()))
        return out

    def sum(self) -> Any:
        out = self.filtered()
        while self.take("+"):
            out = Op("+", (out, self.filtered()))
        return out

    def filtered(self) -> Any:
        out = self.item()
        while self.take("|"):
            name = self.word()
            out = Filter(out, name) if name in FILTERS else _fail(f"no filter {name!r}")
        return out

    def item(self) -> Any:
        out = self.atom()
        while sign := self.take(".", "["):
            if sign == ".":
                out = Item(out, Const(self.word()))
            else:
                out = Item(out, self.any())
                self.take("]") or _fail("] is missing")
        return out

    def atom(self) -> Any:
        if self.take("("):
            out = self.any()
            return out if self.take(")") else _fail(") is missing")
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            self.at += 1
            return Const(self.tokens[self.at - 1][1])
        name = self.word()
        return Const({"true": True, "false": False, "none": None}[name]) if name in ("true", "false", "none") else Name(name)


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = iter([p for p in _PARTS.split(source) if p])

    def body(*ends: str) -> tuple[tuple, str]:
        nodes: list[Any] = []
        for p in parts:
            if p.startswith("{#"):
                continue
            if p.startswith("{{"):
                nodes.append(Out(_Expression(p[2:-2]).whole()))
            elif p.startswith("{%"):
                tag = p[2:-2].strip()
                word, _, rest = tag.partition(" ")
                if word in ends:
                    return tuple(nodes), tag
                if word == "for":
                    m = re.fullmatch(r"(\w+)\s+in\s+(.*)", rest.strip(), re.S) or _fail(f"for {rest!r}")
                    nodes.append(For(m[1], _Expression(m[2]).whole(), body("endfor")[0]))
                elif word == "if":
                    branches, test = [], rest
                    while True:
                        inner, end = body("elif", "else", "endif")
                        branches.append((_Expression(test).whole() if test is not None else Const(True), inner))
                        if end == "endif":
                            break
                        test = end[4:] if end.startswith("elif") else None
                    nodes.append(If(tuple(branches)))
                elif word == "set":
                    name, sign, value = rest.partition("=")
                    nodes.append(Set(name.strip() if sign and name.strip().isidentifier() else _fail(f"set {rest!r}"), _Expression(value).whole()))
                elif word == "generation":
                    nodes.append(Generation(body("endgeneration")[0]))
                else:
                    raise TemplateError(f"unexpected {word!r}")
            else:
                nodes.append(Out(Const(p)))
        return tuple(nodes), "" if not ends else _fail(f"{ends[-1]} is missing")

    return body()[0]


# --- constants folded


def fold(node: Any) -> Any:
    """`node` with constant expressions evaluated, texts joined, dead branches removed."""
    if isinstance(node, tuple):
        out: list[Any] = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Out) and isinstance(y.value, Const):
                    if not (text := _text(y.value.value)):
                        continue
                    if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                        out[-1] = Out(Const(out[-1].value.value + text))
                        continue
                    y = Out(Const(text))
                out.append(y)
        return tuple(out)
    if isinstance(node, Out):
        return Out(fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        left = []
        for test, body in node.branches:
            test = fold(test)
            if isinstance(test, Const) and not test.value:
                continue
            left.append((test, fold(body)))
            if isinstance(test, Const):
                break
        if not left:
            return ()
        return left[0][1] if isinstance(left[0][0], Const) else If(tuple(left))
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        node = Op(node.name, args)
        return Const(_expression(node)({})) if all(isinstance(a, Const) for a in args) else node
    if isinstance(node, Filter):
        of = fold(node.of)
        node = Filter(of, node.name)
        return Const(_expression(node)({})) if isinstance(of, Const) else node
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    return node


# --- closures

START, END = object(), object()


def _expression(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Item):
        of, key = _expression(node.of), _expression(node.key)

        def item(env: dict) -> Any:
            x = of(env)
            return x.get(key(env)) if type(x) is dict else _fail("items come from mappings only")

        return item
    if isinstance(node, Filter):
        of, f = _expression(node.of), FILTERS[node.name]
        return lambda env: f(of(env))
    a, *more = map(_expression, node.args)
    if node.name == "not":
        return lambda env: not a(env)
    b = more[0]
    return {
        "or": lambda env: a(env) or b(env),
        "and": lambda env: a(env) and b(env),
        "==": lambda env: a(env) == b(env),
        "!=": lambda env: a(env) != b(env),
        "in": lambda env: a(env) in b(env),
        "+": lambda env: a(env) + b(env),
    }[node.name]


def _statements(nodes: tuple) -> Callable[[dict], Iterator]:
    steps = tuple(map(_statement, nodes))

    def run(env: dict) -> Iterator:
        for step in steps:
            yield from step(env)

    return run


def _statement(node: Any) -> Callable[[dict], Iterator]:
    if isinstance(node, Out):
        if isinstance(node.value, Const):
            fixed = (node.value.value,)
            return lambda env: fixed
        value = _expression(node.value)
        return lambda env: (_text(value(env)),)
    if isinstance(node, Set):
        value = _expression(node.value)

        def put(env: dict) -> Iterable:
            env[node.name] = value(env)
            return ()

        return put
    if isinstance(node, For):
        over, body = _expression(node.over), _statements(node.body)

        def loop(env: dict) -> Iterator:
            for x in over(env) or ():
                yield from body({**env, node.name: x})

        return loop
    if isinstance(node, Generation):
        body = _statements(node.body)

        def marked(env: dict) -> Iterator:
            yield START
            yield from body(env)
            yield END

        return marked
    branches = tuple((_expression(t), _statements(b)) for t, b in node.branches)

    def choose(env: dict) -> Iterator:
        for test, body in branches:
            if test(env):
                yield from body(env)
                return

    return choose


class Template:
    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self.run = _statements(self.tree)

    def pieces(self, **names: Any) -> Iterator:
        """Texts in order, with START and END around what a model is to write."""
        return self.run(names)

    def render(self, **names: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the spans (in code points) under the loss mask."""
        out, spans, at = [], [], 0
        for p in self.pieces(**names):
            if p is START:
                spans.append((at, at))
            elif p is END:
                spans[-1] = (spans[-1][0], at)
            else:
                out.append(p)
                at += len(p)
        return "".join(out), spans


# --- reading back

_SCAN = re.compile(r"\\.|<turn>|</turn>|### ", re.S)


class Reader:
    """Turns and loss text from the pieces of a formatted conversation, one turn in memory at a time."""

    def __init__(self) -> None:
        self.turns, self.digest = 0, hashlib.sha256()
        self.chars, self.loss_chars, self.loss = 0, 0, hashlib.sha256()
        self.buffer: list[str] = []
        self.masked: list[str] | None = None

    def feed(self, piece: Any) -> None:
        if piece is START:
            self.masked = []
        elif piece is END:
            text = unescape("".join(self.masked or ()))
            self.loss_chars += len(text)
            self.loss.update(text.encode())
            self.masked = None
        else:
            self.chars += len(piece)
            if self.masked is not None:
                self.masked.append(piece)
            self.buffer.append(piece)
            if "</turn>" in piece:
                self._turns()

    def _turns(self) -> None:
        whole, role, begin, done = "".join(self.buffer), None, 0, 0
        for m in _SCAN.finditer(whole):
            mark = m[0]
            if mark == "<turn>":
                begin, role = m.end(), None
            elif mark == "### " and role is None:
                role, begin = unescape(whole[begin : m.start()]), m.end()
            elif mark == "</turn>" and role is not None:
                self.turns += 1
                self.digest.update(f"{role}\n{unescape(whole[begin:m.start()])}\n".encode())
                done, role = m.end(), None
        self.buffer = [whole[done:]]


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Sorted rows as (conversation, its messages); messages are read as they are asked for."""
    rows = ((c, r, t) for b in batches for c, r, t in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()))
    row = next(rows, None)
    while row is not None:
        conv = row[0]

        def messages() -> Iterator[dict]:
            nonlocal row
            while row is not None and row[0] == conv:
                yield {"role": row[1] or "", "text": row[2] or ""}
                row = next(rows, None)

        own = messages()
        yield conv, own
        for _ in own:
            pass


def _sorted(df: DataFrame) -> DataFrame:
    """By conversation and turn; rows that repeat a turn in order of role and text."""
    small_batches(df.sparkSession)
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_digests(df: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """For each conversation of `df` (conv_id, turn, role, text) what its formatted text reads back as.

    Turns stream through the template and the reader, so a conversation that holds a third of all
    rows needs the memory of one turn. Null roles and texts are empty; a null conv_id is one
    conversation; repeated rows are turns of their own; an empty table gives no rows; further columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = Template(template), []
        for conv, messages in _conversations(batches):
            read = Reader()
            for p in own.pieces(messages=messages):
                read.feed(p)
            out.append((conv, read.turns, read.digest.hexdigest(), read.loss_chars, read.loss.hexdigest(), read.chars))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=[c.split()[0] for c in _DIGEST.split(", ")])
                out = []
        if out:
            columns = [*zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *map(pa.array, columns[1:])], names=[c.split()[0] for c in _DIGEST.split(", ")])

    return _sorted(df).mapInArrow(run, _DIGEST)


def format_texts(df: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, spans array<struct<start, end>> (code points under the loss mask); here a
    conversation's text is one value. Cases as in `format_digests`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Template(template)
        for conv, messages in _conversations(batches):
            text, spans = own.render(messages=messages)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([text]), pa.array([[{"start": a, "end": b} for a, b in spans]], kind)], names=["conv_id", "formatted", "spans"])

    return _sorted(df).mapInArrow(run, "conv_id long, formatted string, spans array<struct<start: long, end: long>>")
