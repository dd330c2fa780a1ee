"""Chat templates: a small sandboxed template language, and conversations rendered with it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Strings that mark turns. Inside texts they are written with a backslash after the first character.
CONTROLS = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
TEMPLATE = (
    "{% for message in messages %}"
    "{% if message.role == 'system' %}{{ '<<' + 'SYS>>' }}{{ message.text | escape }}<</SYS>>"
    "{% elif message.role == 'user' %}[INST]{{ message.text | escape }}[/INST]"
    "{% elif message.role == 'assistant' %}<s>{% generation %}{{ message.text | escape }}{% endgeneration %}</s>"
    "{% else %}[ROLE]{{ message.role | escape }}[/ROLE]{{ message.text | escape }}</s>{% endif %}"
    "{% endfor %}"
)
_OPEN, _REST = r"([<\[])", "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_RAW = re.compile(rf"{_OPEN}(?=\\*(?:{_REST}))")
_ESCAPED = re.compile(rf"{_OPEN}\\(?=\\*(?:{_REST}))")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))


def escape(text: str) -> str:
    """A text in which no control string stands; ``unescape`` gives the text back."""
    return _RAW.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class TemplateError(ValueError):
    """The template cannot be parsed, or asks for what the sandbox does not hold."""


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": len,
}
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\w+)|(==|!=|<=|>=|[-+*%~<>()\[\].,|]))")
_TAG = re.compile(r"(\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\})", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: _times(a, b),
    "%": lambda a, b: a % b if not isinstance(a, str) else _refuse("text formatting"),
    "~": lambda a, b: _text(a) + _text(b),
    "in": lambda a, b: a in b,
    "not in": lambda a, b: a not in b,
}
_LEVELS = (("==", "!=", "<", ">", "<=", ">=", "in", "not in"), ("+", "-", "~"), ("*", "%"))


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _refuse(what: str):
    raise TemplateError(f"{what} is not allowed in a template")


def _times(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a * b
    return _refuse("repetition")


# The syntax tree. Expressions are constants, names, members, operators and choices; what
# stands between tags is a list of outputs, conditions, loops, assignments and generations.
@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Member:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    function: Callable
    arguments: tuple


@dataclass(frozen=True)
class Logic:
    kind: str  # and, or, not
    parts: tuple


@dataclass(frozen=True)
class Choice:
    test: Any
    yes: Any
    no: Any


@dataclass
class Output:
    value: Any


@dataclass
class If:
    branches: list  # (test, nodes)


@dataclass
class For:
    name: str
    over: Any
    body: list


@dataclass
class Set:
    name: str
    value: Any


@dataclass
class Generation:
    body: list


class _Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            match = _TOKEN.match(source, at)
            if not match:
                raise TemplateError(f"unreadable expression: {source[at:]!r}")
            self.tokens.append((match.lastindex, match.group(match.lastindex)))
            at = match.end()
        self.at = 0

    def parse(self):
        value = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return value

    def peek(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != 2 and self.tokens[self.at][1] in words

    def take(self, *words: str) -> str | None:
        if self.peek(*words):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise TemplateError(f"{word!r} is missing")

    def choice(self):
        value = self.either()
        if self.take("if"):
            test = self.either()
            value = Choice(test, value, self.choice() if self.take("else") else Const(None))
        return value

    def either(self):
        parts = [self.both()]
        while self.take("or"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Logic("or", tuple(parts))

    def both(self):
        parts = [self.negation()]
        while self.take("and"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else Logic("and", tuple(parts))

    def negation(self):
        return Logic("not", (self.negation(),)) if self.take("not") else self.binary(0)

    def binary(self, level: int):
        if level == len(_LEVELS):
            return self.filtered()
        left = self.binary(level + 1)
        while True:
            operator = self.take(*_LEVELS[level])
            if not operator and level == 0 and self.take("not"):
                self.need("in")
                operator = "not in"
            if not operator:
                return left
            left = Apply(_BINARY[operator], (left, self.binary(level + 1)))

    def filtered(self):
        value = self.member()
        while self.take("|"):
            kind, name = self.next()
            if kind != 3 or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            value = Apply(FILTERS[name], (value,))
        return value

    def member(self):
        value = self.atom()
        while True:
            if self.take("."):
                kind, name = self.next()
                if kind != 3 or name.startswith("_"):
                    raise TemplateError(f"no member {name!r}")
                value = Member(value, Const(name))
            elif self.take("["):
                value = Member(value, self.choice())
                self.need("]")
            else:
                return value

    def next(self):
        if self.at == len(self.tokens):
            raise TemplateError("the expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def atom(self):
        if self.take("("):
            value = self.choice()
            self.need(")")
            return value
        if self.take("-"):
            return Apply(lambda v: -v, (self.member(),))
        kind, word = self.next()
        if kind == 1:
            return Const(int(word))
        if kind == 2:
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        if kind == 3:
            known = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            return Const(known[word]) if word in known else Name(word)
        raise TemplateError(f"unexpected {word!r}")


def parse(source: str) -> list:
    """The syntax tree of a template."""
    parts = _TAG.split(source)
    for i in range(1, len(parts), 2):
        if parts[i][2:3] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3:-2] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
    stack: list[tuple[str, Any, list]] = [("", None, [])]
    for i, part in enumerate(parts):
        nodes = stack[-1][2]
        if i % 2 == 0:
            if part:
                nodes.append(Output(Const(part)))
            continue
        inner = part[2:-2].strip("-").strip()
        if part.startswith("{#"):
            continue
        if part.startswith("{{"):
            nodes.append(Output(_Expression(inner).parse()))
            continue
        word, _, rest = inner.partition(" ")
        if word == "if":
            stack.append(("if", If([]), []))
            stack[-1][1].branches.append((_Expression(rest).parse(), stack[-1][2]))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            test = _Expression(rest).parse() if word == "elif" else Const(True)
            stack[-1] = ("if", stack[-1][1], [])
            stack[-1][1].branches.append((test, stack[-1][2]))
        elif word == "for":
            match = re.fullmatch(r"(\w+)\s+in\s+(.*)", rest.strip(), re.S)
            if not match:
                raise TemplateError(f"unreadable loop: {rest!r}")
            stack.append(("for", For(match[1], _Expression(match[2]).parse(), []), []))
            stack[-1][1].body = stack[-1][2]
        elif word == "set":
            match = re.fullmatch(r"(\w+)\s*=\s*(.*)", rest.strip(), re.S)
            if not match:
                raise TemplateError(f"unreadable assignment: {rest!r}")
            nodes.append(Set(match[1], _Expression(match[2]).parse()))
        elif word == "generation":
            stack.append(("generation", Generation([]), []))
            stack[-1][1].body = stack[-1][2]
        elif word in ("endif", "endfor", "endgeneration") and stack[-1][0] == word[3:]:
            node = stack.pop()[1]
            stack[-1][2].append(node)
        else:
            raise TemplateError(f"unexpected tag: {inner!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} is not closed")
    return stack[0][2]


def fold_value(value):
    """The expression with every part that does not depend on a name computed."""
    if isinstance(value, Member):
        value = Member(fold_value(value.of), fold_value(value.key))
    elif isinstance(value, Apply):
        value = Apply(value.function, tuple(map(fold_value, value.arguments)))
        if all(isinstance(a, Const) for a in value.arguments):
            return Const(value.function(*(a.value for a in value.arguments)))
    elif isinstance(value, Logic):
        value = Logic(value.kind, tuple(map(fold_value, value.parts)))
        if all(isinstance(p, Const) for p in value.parts):
            return Const(compile_value(value)({}))
    elif isinstance(value, Choice):
        test = fold_value(value.test)
        if isinstance(test, Const):
            return fold_value(value.yes if test.value else value.no)
        value = Choice(test, fold_value(value.yes), fold_value(value.no))
    return value


def fold(nodes: list) -> list:
    """The tree with constants computed, dead branches dropped and neighbouring texts joined."""
    out: list = []
    for node in nodes:
        if isinstance(node, Output):
            value = fold_value(node.value)
            if isinstance(value, Const):
                value = Const(_text(value.value))
                if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                    out[-1] = Output(Const(out[-1].value.value + value.value))
                    continue
            out.append(Output(value))
        elif isinstance(node, If):
            branches = []
            for test, body in node.branches:
                test = fold_value(test)
                if isinstance(test, Const) and not test.value:
                    continue
                branches.append((test, fold(body)))
                if isinstance(test, Const):
                    break
            if branches and isinstance(branches[0][0], Const):
                out += branches[0][1]
            elif branches:
                out.append(If(branches))
        elif isinstance(node, For):
            out.append(For(node.name, fold_value(node.over), fold(node.body)))
        elif isinstance(node, Set):
            out.append(Set(node.name, fold_value(node.value)))
        else:
            out.append(Generation(fold(node.body)))
    return out


def compile_value(value) -> Callable[[dict], Any]:
    if isinstance(value, Const):
        constant = value.value
        return lambda names: constant
    if isinstance(value, Name):
        name = value.name
        return lambda names: names.get(name)
    if isinstance(value, Member):
        of, key = compile_value(value.of), compile_value(value.key)
        return lambda names: _member(of(names), key(names))
    if isinstance(value, Apply):
        function, arguments = value.function, [compile_value(a) for a in value.arguments]
        if len(arguments) == 1:
            only = arguments[0]
            return lambda names: function(only(names))
        left, right = arguments
        return lambda names: function(left(names), right(names))
    if isinstance(value, Choice):
        test, yes, no = map(compile_value, (value.test, value.yes, value.no))
        return lambda names: yes(names) if test(names) else no(names)
    parts = [compile_value(p) for p in value.parts]
    if value.kind == "not":
        return lambda names: not parts[0](names)
    stop = value.kind == "or"

    def logic(names):
        for part in parts:
            found = part(names)
            if bool(found) == stop:
                break
        return found

    return logic


def _member(of, key):
    """Members of mappings and items of lists only; nothing of Python's own objects."""
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return None


@dataclass
class Sink:
    """What a rendering has written, and the spans of it that a model should learn."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def compile_nodes(nodes: list) -> Callable[[dict, Sink], None]:
    steps = [_compile_node(n) for n in nodes]

    def run(names: dict, sink: Sink) -> None:
        for step in steps:
            step(names, sink)

    return run


def _compile_node(node) -> Callable[[dict, Sink], None]:
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            text = node.value.value
            return lambda names, sink: sink.write(text)
        value = compile_value(node.value)
        return lambda names, sink: sink.write(_text(value(names)))
    if isinstance(node, Set):
        name, value = node.name, compile_value(node.value)

        def assign(names, sink):
            names[name] = value(names)

        return assign
    if isinstance(node, If):
        branches = [(compile_value(test), compile_nodes(body)) for test, body in node.branches]

        def choose(names, sink):
            for test, body in branches:
                if test(names):
                    body(names, sink)
                    return

        return choose
    body = compile_nodes(node.body)
    if isinstance(node, Generation):

        def generation(names, sink):
            start = sink.size
            body(names, sink)
            sink.spans.append((start, sink.size))

        return generation
    name, over = node.name, compile_value(node.over)

    def loop(names, sink):
        items = over(names) or []
        for i, item in enumerate(items):
            inner = dict(names)
            inner[name] = item
            inner["loop"] = loop_names(i, i + 1 == len(items), items[i - 1] if i else None)
            body(inner, sink)

    return loop


def loop_names(index: int, last: bool, previous) -> dict:
    return {"index0": index, "index": index + 1, "first": index == 0, "last": last, "previtem": previous}


class Template:
    """A compiled template.

    ``render`` writes a conversation that is at hand. ``turn`` writes a single message of a
    template that is one loop over ``messages`` between constant parts, so that a
    conversation of any length can be written turn by turn.
    """

    def __init__(self, source: str):
        tree = fold(parse(source))
        self.render_all = compile_nodes(tree)
        loops = [i for i, n in enumerate(tree) if isinstance(n, For) and n.over == Name("messages")]
        self.streams = len(loops) == 1 and not any(_uses_messages(n) for i, n in enumerate(tree) if i != loops[0])
        if self.streams:
            loop = tree[loops[0]]
            self.streams = not any(_uses_messages(n) for n in loop.body)
            self.item, self.body = loop.name, compile_nodes(loop.body)
            self.before, self.after = compile_nodes(tree[: loops[0]]), compile_nodes(tree[loops[0] + 1 :])

    def render(self, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        sink = Sink()
        self.render_all({"messages": messages}, sink)
        return "".join(sink.parts), sink.spans

    def turn(self, names: dict, index: int, message: dict, last: bool, previous: dict | None) -> tuple[str, list]:
        """The part of one message; ``names`` is kept by the caller for the whole conversation."""
        sink = Sink()
        if index == 0:
            self.before(names, sink)
        self.body({**names, self.item: message, "loop": loop_names(index, last, previous)}, sink)
        if last:
            self.after(names, sink)
        return "".join(sink.parts), sink.spans


def _uses_messages(node) -> bool:
    if isinstance(node, Name):
        return node.name == "messages"
    if isinstance(node, (list, tuple)):
        return any(map(_uses_messages, node))
    return any(map(_uses_messages, vars(node).values())) if hasattr(node, "__dataclass_fields__") else False


def parse_turns(formatted: str, spans: list[tuple[int, int]]) -> Iterator[tuple[str, str, bool]]:
    """(role, text, learned) of each turn in text written with ``TEMPLATE``."""
    marks = [(m.group(), m.start(), m.end()) for m in _CONTROL.finditer(formatted)]
    learned, at = set(spans), 0
    while at < len(marks):
        mark, _, start = marks[at]
        role = {"<<SYS>>": "system", "[INST]": "user", "<s>": "assistant"}.get(mark)
        if mark == "[ROLE]":
            role, at = unescape(formatted[start : marks[at + 1][1]]), at + 1
            start = marks[at][2]
        end = marks[at + 1][1]
        yield role, unescape(formatted[start:end]), (start, end) in learned
        at += 2


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, seq, text, spans): the formatted conversations, a row for each turn.

    The texts of a conversation joined by ``seq`` are its formatted form; ``spans`` are the
    learned (start, end) places in the row's text, in code points. Turns stand in order of
    turn (null first), role and text; repeated rows are turns like any other. A null text or
    role counts as empty; rows without a conversation id form one conversation. An empty
    table gives no rows. A conversation is read as a sorted stream, one turn at a time, and
    never gathered.
    """
    if not Template(template).streams:
        raise TemplateError("the template must be one loop over messages that looks at one message at a time")

    def run(batches):
        compiled = Template(template)
        waiting, names, index, previous = None, {}, 0, None

        def write(last: bool):
            text, spans = compiled.turn(names, index, waiting[1], last, previous)
            return waiting[0], index, text, [{"start": s, "end": e} for s, e in spans]

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                message = {"role": row["role"], "text": row["text"]}
                if waiting is not None:
                    same = waiting[0] == row["conv_id"]
                    rows.append(write(not same))
                    names, index, previous = (names, index + 1, waiting[1]) if same else ({}, 0, None)
                waiting = row["conv_id"], message
            yield _record(rows, _FORMATTED)
        if waiting is not None:
            yield _record([write(True)], _FORMATTED)

    source = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    ordered = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, seq long, text string, spans array<struct<start:long,end:long>>"
    return ordered.select("conv_id", "role", "text").mapInArrow(run, schema)


_FORMATTED = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("seq", pa.int64()),
        ("text", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
_READ = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """A digest of each conversation, from the formatted text alone.

    The turns are parsed out of the text by its control strings and unescaped; the learned
    text is what the spans cover, unescaped.
    """

    def run(batches):
        now = None

        def fresh(conv_id):
            return {"id": conv_id, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}

        def close(c):
            return c["id"], c["turns"], c["all"].hexdigest(), c["chars"], c["loss"].hexdigest(), c["size"]

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if now is None or now["id"] != row["conv_id"]:
                    if now is not None:
                        rows.append(close(now))
                    now = fresh(row["conv_id"])
                now["size"] += len(row["text"])
                for role, text, learned in parse_turns(row["text"], [(s["start"], s["end"]) for s in row["spans"]]):
                    now["turns"] += 1
                    now["all"].update(f"{role}\n{text}\n".encode())
                    if learned:
                        now["chars"] += len(text)
                        now["loss"].update(text.encode())
            yield _record(rows, _READ)
        if now is not None:
            yield _record([close(now)], _READ)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.select("conv_id", "text", "spans").mapInArrow(run, schema)
