"""Chat formatting by a small template compiler.

A template is parsed to a syntax tree, constants are folded, and the tree becomes Python closures.
The language is a sandbox: literals, names, keys of mappings, comparisons, and/or/not, `in`, `~`,
a fixed set of filters, `if`, `for`, and `generation` blocks that mark what a model learns from.
It has no calls and no attribute access on Python objects, so a template can't reach the host.

    {{ expr }}   {% for x in expr %}..{% endfor %}   {% if e %}..{% elif e %}..{% else %}..{% endif %}
    {% generation %}..{% endgeneration %}            {%- and -%} trim white space beside the tag

`loop.first`, `loop.last` and `loop.index0` exist inside a loop.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    """An operator over argument nodes; name is a key of OPERATORS, or and/or."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    expr: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    var: str
    items: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class TemplateError(ValueError):
    pass


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


OPERATORS: dict[str, Callable] = {
    "~": lambda *a: "".join(map(_text, a)),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: a in b,
    "not": lambda a: not a,
}
FILTERS: dict[str, Callable] = {"trim": lambda s: _text(s).strip(), "upper": lambda s: _text(s).upper(), "lower": lambda s: _text(s).lower(), "length": lambda s: len(s or "")}

# ---------------------------------------------------------------- parsing

_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[~.\[\]()|]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expr:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        source = source.strip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in wanted

    def take(self, *wanted: str) -> str:
        if not self.peek(*wanted):
            raise TemplateError(f"expected {wanted} in {self.source!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"too much in {self.source!r}")
        return node

    def either(self):
        node = self.both()
        while self.peek("or"):
            self.at += 1
            node = Op("or", (node, self.both()))
        return node

    def both(self):
        node = self.inverse()
        while self.peek("and"):
            self.at += 1
            node = Op("and", (node, self.inverse()))
        return node

    def inverse(self):
        if self.peek("not"):
            self.at += 1
            return Op("not", (self.inverse(),))
        node = self.joined()
        if self.peek("==", "!=", "in"):
            return Op(self.take("==", "!=", "in"), (node, self.joined()))
        return node

    def joined(self):
        parts = [self.filtered()]
        while self.peek("~"):
            self.at += 1
            parts.append(self.filtered())
        return parts[0] if len(parts) == 1 else Op("~", tuple(parts))

    def filtered(self):
        node = self.atom()
        while self.peek("|"):
            self.at += 1
            node = Filter(self.name(), node)
        return node

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError(f"expected a name in {self.source!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError(f"{self.source!r} ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            node = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "int":
            node = Const(int(value))
        elif kind == "name":
            node = Const({"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Name(value)
        elif value == "(":
            node = self.either()
            self.take(")")
        else:
            raise TemplateError(f"unexpected {value!r} in {self.source!r}")
        while self.peek(".", "["):
            if self.take(".", "[") == ".":
                node = Key(node, Const(self.name()))
            else:
                node = Key(node, self.either())
                self.take("]")
        return node


def parse(source: str) -> tuple:
    """The template's syntax tree: a tuple of nodes."""
    parts: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        parts.append(("text", text.rstrip() if m[0][2] == "-" else text))
        parts.append(("expr", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at, trim = m.end(), m[0][-3] == "-"
    parts.append(("text", source[at:].lstrip() if trim else source[at:]))
    it = iter(parts)

    def block(*ends: str) -> tuple[tuple, str]:
        out: list = []
        for kind, value in it:
            if kind == "text":
                out.append(Text(value))
            elif kind == "expr":
                out.append(Output(_Expr(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return tuple(out), value
                if word == "for":
                    if not (m := re.fullmatch(r"(\w+)\s+in\s+(.*)", rest.strip(), re.S)):
                        raise TemplateError(f"can't read {value!r}")
                    out.append(For(m[1], _Expr(m[2]).whole(), block("endfor")[0]))
                elif word == "if":
                    out.append(branch(rest))
                elif word == "generation":
                    out.append(Generation(block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(out), ""

    def branch(test: str) -> If:
        then, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            return If(_Expr(test).whole(), then, (branch(end[4:]),))
        return If(_Expr(test).whole(), then, block("endif")[0] if end == "else" else ())

    return block()[0]


# ---------------------------------------------------------------- constant folding


def fold(node: Any, filters: dict[str, Callable]) -> Any:
    """The same tree with everything evaluated that depends on no input, and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in (fold(x, filters) for x in node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + y.text)
                elif not (isinstance(y, Text) and not y.text):
                    out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(fold(a, filters) for a in node.args)
        if node.name in ("and", "or"):
            if isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
        elif all(isinstance(a, Const) for a in args):
            return Const(OPERATORS[node.name](*(a.value for a in args)))
        return Op(node.name, args)
    if isinstance(node, Filter):
        of = fold(node.of, filters)
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        return Const(filters[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Key):
        return Key(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Output):
        expr = fold(node.expr, filters)
        return Text(_text(expr.value)) if isinstance(expr, Const) else Output(expr)
    if isinstance(node, If):
        test, then, other = fold(node.test, filters), fold(node.then, filters), fold(node.other, filters)
        if isinstance(test, Const):
            return then if test.value else other
        return If(test, then, other)
    if isinstance(node, For):
        return For(node.var, fold(node.items, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    return node


# ---------------------------------------------------------------- closures


class Sink:
    """Takes the rendered pieces in order, with absolute spans of the mask."""

    def __init__(self):
        self.parts, self.spans, self.at, self.open = [], [], 0, None

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.at += len(text)

    def begin(self) -> None:
        if self.open is not None:
            raise TemplateError("generation blocks don't nest")
        self.open = self.at

    def end(self) -> None:
        if self.at > self.open:
            self.spans.append((self.open, self.at))
        self.open = None

    def take(self) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """What is ready; nothing inside a generation block, which stays whole."""
        if self.open is None and self.parts:
            yield "".join(self.parts), self.spans
            self.parts, self.spans = [], []


def _expression(node: Any, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Key):
        of, key = _expression(node.of, filters), _expression(node.key, filters)
        return lambda env: x.get(key(env)) if isinstance(x := of(env), dict) else None
    if isinstance(node, Filter):
        of, f = _expression(node.of, filters), filters[node.name]
        return lambda env: f(of(env))
    args = [_expression(a, filters) for a in node.args]
    if node.name == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.name == "or":
        return lambda env: args[0](env) or args[1](env)
    f = OPERATORS[node.name]
    return lambda env: f(*(a(env) for a in args))


def _statement(node: Any, filters: dict[str, Callable]) -> Callable[[dict, Sink], Iterator[None]]:
    """A generator that writes to the sink and stops after each round of a loop, so that the caller
    can take what is ready before more messages are read."""
    if isinstance(node, tuple):
        body = [_statement(x, filters) for x in node]

        def run(env, sink):
            for x in body:
                yield from x(env, sink)

        return run
    if isinstance(node, Text):

        def text(env, sink, t=node.text):
            sink.write(t)
            return ()

        return text
    if isinstance(node, Output):
        e = _expression(node.expr, filters)

        def output(env, sink):
            sink.write(_text(e(env)))
            return ()

        return output
    if isinstance(node, If):
        test, then, other = _expression(node.test, filters), _statement(node.then, filters), _statement(node.other, filters)
        return lambda env, sink: (then if test(env) else other)(env, sink)
    if isinstance(node, Generation):
        body = _statement(node.body, filters)

        def mark(env, sink):
            sink.begin()
            yield from body(env, sink)
            sink.end()

        return mark
    items, body, var = _expression(node.items, filters), _statement(node.body, filters), node.var

    def loop(env, sink):
        it = iter(items(env) or ())
        here, i = next(it, loop), 0
        while here is not loop:
            after = next(it, loop)
            yield from body(env | {var: here, "loop": {"index0": i, "first": i == 0, "last": after is loop}}, sink)
            yield
            here, i = after, i + 1

    return loop


class Template:
    """A compiled template. controls: strings that its own text uses as marks; the filter `escape`
    writes a backslash before each of them, and before each backslash, in a text that isn't the
    template's own. unescape() is its inverse."""

    def __init__(self, source: str, controls: Iterable[str] = ()):
        marks = sorted(controls, key=len, reverse=True)
        pattern = re.compile("|".join(map(re.escape, ["\\", *marks])))
        filters = FILTERS | {"escape": lambda s: pattern.sub(lambda m: "\\" + m[0], _text(s))}
        self.tree = fold(parse(source), filters)
        self.run = _statement(self.tree, filters)

    def stream(self, messages: Iterable[dict]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Render message by message: each message's text and its spans under the mask."""
        sink = Sink()
        for _ in self.run({"messages": messages}, sink):
            yield from sink.take()
        yield from sink.take()

    def render(self, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
        """The whole text, and the spans (code points) under the generation mask."""
        rows = list(self.stream(messages))
        return "".join(r[0] for r in rows), [s for r in rows for s in r[1]]


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


#: The marks of the default template, and that template.
CONTROLS = ("<turn>", "</role>", "</turn>", "### Assistant:")
TURNS = (
    "{% for m in messages %}{{ '<' ~ 'turn>' }}{{ m.role | escape }}</role>"
    "{% if m.role == 'assistant' %}### Assistant:{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)

FORMATTED = "conv_id long, part long, formatted string, starts array<long>, ends array<long>"


def format_conversations(conversations: DataFrame, source: str = TURNS, controls: Iterable[str] = CONTROLS) -> DataFrame:
    """Render each conversation (conv_id, turn, role, text), its rows by turn.

    One row per message comes out, in order within its partition: conv_id, part (from 0), formatted,
    and the spans of its text under the mask, counted in code points of the whole conversation. A
    conversation of any length streams through one message at a time. Equal turns are ordered by role
    and text, so reruns agree; null role and text are empty; null conv_id is a conversation of its
    own; repeated rows are rendered as often as they come; other columns are ignored.
    """
    controls = tuple(controls)
    Template(source, controls)  # errors show here, not in a task
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source, controls)
        rows = (r for b in batches for r in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist(), strict=True))
        parts = ((conv, n, text, spans) for conv, out in _groups(rows) for n, (text, spans) in enumerate(template.stream({"role": r, "text": t} for _, r, t in out)))
        yield from _batches(parts)

    return rows.mapInArrow(run, FORMATTED)


def _groups(rows: Iterator[tuple]) -> Iterator[tuple[Any, Iterator[tuple]]]:
    from itertools import groupby

    return groupby(rows, key=lambda r: r[0])


def _batches(parts: Iterator[tuple], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about `size` characters; messages are read as the batches need them."""
    held: list[tuple] = []
    chars = 0

    def close() -> pa.RecordBatch:
        conv, n, text, spans = zip(*held, strict=True)
        ends = [pa.array([[s[i] for s in x] for x in spans], pa.list_(pa.int64())) for i in range(2)]
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(n, pa.int64()), pa.array(text, pa.string()), *ends], names=["conv_id", "part", "formatted", "starts", "ends"])

    for part in parts:
        held.append(part)
        chars += len(part[2])
        if chars >= size or len(held) >= 10_000:
            yield close()
            held, chars = [], 0
    if held:
        yield close()


_MARKS = re.compile(r"\\(.)|(<turn>)|(</role>(?:### Assistant:)?)|(</turn>\n)|([^\\<]+|<)", re.S)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each whole turn in the output of the default template."""
    role: list[str] = []
    text: list[str] = []
    into = role
    for m in _MARKS.finditer(formatted):
        if m[2]:
            role, text = [], []
            into = role
        elif m[3]:
            into = text
        elif m[4]:
            yield "".join(role), "".join(text)
        else:
            into.append(m[1] if m[1] is not None else m[5])


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Read the default template's output back: one row per conversation with counts and digests of
    its turns and of the text under the mask. Rows of a conversation must be together and in order,
    as format_conversations() leaves them; nothing is shuffled."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("conv_id", "formatted", "starts", "ends")), strict=True))
        out: list[tuple] = []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        for conv, parts in _groups(rows):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = at = 0
            for _, text, starts, ends in parts:
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for s, e in zip(starts, ends, strict=True):
                    learnt = unescape(text[s - at : e - at])
                    chars += len(learnt)
                    loss.update(learnt.encode())
                at += len(text)
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), at))
            if len(out) >= 2000:
                yield pack()
                out.clear()
        if out:
            yield pack()

    return formatted.mapInArrow(run, schema)
