"""A tokenizer and a precedence-climbing parser for the engine's SQL fragment."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from quern.types import EngineError

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
      | (?P<string>'(?:[^']|'')*')
      | (?P<quoted>"(?:[^"]|"")+")
      | (?P<name>[^\W\d]\w*)
      | (?P<sign>\|\||<>|!=|<=|>=|::|[-+*/%~=<>(),.;])""",
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m or (m[0] == "/" and sql.startswith("/*", at)):  # a comment that doesn't end
            raise EngineError(f"can't read {sql[at : at + 20]!r}")
        kind, text = m.lastgroup or "", m[0]
        if kind == "string":
            text = text[1:-1].replace("''", "'")
        elif kind == "quoted":
            kind, text = "exact", text[1:-1].replace('""', '"')
        elif kind == "name":
            text = text.lower()
        if kind != "space":
            out.append(Token(kind, text, at))
        at = m.end()
    return [*out, Token("end", "", at)]


# Expressions as parsed


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Name:
    table: str | None
    column: str


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Call:
    """An operator or a function: `op` is its sign or lower-case name."""

    op: str
    args: tuple
    distinct: bool = False


@dataclass(frozen=True)
class CastTo:
    arg: Any
    kind: str


# Statements


@dataclass
class Select:
    items: list[tuple[Any, str | None]]
    tables: list[tuple[str, str]]
    where: Any = None
    group: list | None = None
    having: Any = None
    distinct: bool = False
    order: list[tuple[Any, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None


@dataclass
class CreateTable:
    name: str
    columns: list[tuple[str, str]]
    key: str | None


@dataclass
class CreateIndex:
    table: str
    column: str


@dataclass
class Insert:
    table: str
    rows: list[list] | None
    select: Select | None


@dataclass
class Delete:
    table: str
    where: Any


@dataclass
class Analyze:
    tables: list[str] | None


@dataclass
class ShowTables:
    pass


@dataclass
class SetOption:
    option: str
    value: str


@dataclass
class Commit:
    pass


@dataclass
class Rollback:
    pass


#: Binary operators, loosest first; those of one level associate to the left.
_LEVELS = [("or",), ("and",), (), ("=", "<>", "!="), ("<", "<=", ">", ">="), ("~",), ("||",), ("+", "-"), ("*", "/", "%")]
_NOT = 2
_CLAUSES = {"from", "where", "group", "having", "order", "limit", "offset", "as", "on", "union", "intersect", "except", "join", "inner", "left", "right", "full", "cross", "natural", "using", "and", "or", "not", "asc", "desc", "values", "select", "fetch", "for", "window"}


class Parser:
    def __init__(self, sql: str):
        self.sql, self.all, self.i = sql, tokens(sql), 0

    @property
    def now(self) -> Token:
        return self.all[self.i]

    def take(self, *texts: str) -> bool:
        """Skip these names or signs if they come next."""
        part = self.all[self.i : self.i + len(texts)]
        if len(part) == len(texts) and all(t.kind in ("name", "sign") and t.text == x for t, x in zip(part, texts, strict=True)):
            self.i += len(texts)
            return True
        return False

    def need(self, *texts: str) -> None:
        if not self.take(*texts):
            raise EngineError(f"expected {' '.join(texts).upper()} before {self.now.text or 'the end'!r}")

    def name(self) -> str:
        t = self.now
        if t.kind == "exact" or (t.kind == "name" and t.text not in _CLAUSES):
            self.i += 1
            return t.text
        raise EngineError(f"expected a name before {t.text or 'the end'!r}")

    def listed(self, one) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    # expressions

    def expression(self, level: int = 0):
        if level == _NOT:
            return Call("not", (self.expression(3),)) if self.take("not") else self.expression(3)
        if level == len(_LEVELS):
            return self.unary()
        left = self.expression(level + 1)
        while self.now.kind in ("sign", "name") and self.now.text in _LEVELS[level]:
            op = {"!=": "<>"}.get(self.now.text, self.now.text)
            self.i += 1
            left = Call(op, (left, self.expression(level + 1)))
        return left

    def unary(self):
        if self.take("-"):
            return Call("neg", (self.unary(),))
        if self.take("+"):
            return self.unary()
        out = self.primary()
        while self.take("::"):
            out = CastTo(out, self.kind())
        return out

    def kind(self) -> str:
        out = self.name()
        if self.take("("):
            raise EngineError("types don't take parameters")
        return out

    def primary(self):
        t = self.now
        if t.kind == "number":
            self.i += 1
            return Literal(int(t.text) if t.text.isdigit() else float(t.text))
        if t.kind == "string":
            self.i += 1
            return Literal(t.text)
        if self.take("("):
            if self.now.text == "select":
                raise EngineError("subqueries aren't supported")
            out = self.expression()
            self.need(")")
            return out
        if self.take("true"):
            return Literal(True)
        if self.take("false"):
            return Literal(False)
        if t.kind == "name" and t.text in ("null", "case", "exists", "interval"):
            raise EngineError(f"{t.text.upper()} isn't supported")
        if self.take("cast", "("):
            arg = self.expression()
            self.need("as")
            out = CastTo(arg, self.kind())
            self.need(")")
            return out
        first = self.name()
        if self.take("("):
            distinct = self.take("distinct")
            args: list = []
            if self.take("*"):
                args = [Star()]
                self.need(")")
            elif not self.take(")"):
                args = self.listed(self.expression)
                self.need(")")
            if self.now.text == "over":
                raise EngineError("window functions aren't supported")
            return Call(first, tuple(args), distinct)
        if self.take("."):
            return Name(first, self.name())
        return Name(None, first)

    # statements

    def statement(self):
        if self.now.text == "select":
            return self.select()
        if self.take("create", "table"):
            return self.create_table()
        if self.take("create", "index"):
            if self.now.text != "on":
                self.name()
            self.need("on")
            table = self.name()
            self.need("(")
            columns = self.listed(self.name)
            self.need(")")
            if len(columns) > 1:
                raise EngineError("an index has one column")
            return CreateIndex(table, columns[0])
        if self.take("insert", "into"):
            return self.insert()
        if self.take("delete", "from"):
            table = self.name()
            return Delete(table, self.expression() if self.take("where") else None)
        if self.take("analyze"):
            return Analyze(None if self.now.kind == "end" or self.now.text == ";" else self.listed(self.name))
        if self.take("show", "tables"):
            return ShowTables()
        if self.take("set"):
            words = []
            while self.now.kind != "end" and self.now.text != ";":
                words.append(self.now.text)
                self.i += 1
            words = [w for w in words if w not in ("=", "to")]
            if len(words) < 2:
                raise EngineError("SET needs an option and its value")
            return SetOption(words[0], " ".join(words[1:]).lower())
        if self.take("commit"):
            return Commit()
        if self.take("rollback"):
            return Rollback()
        raise EngineError(f"{self.now.text.upper() or 'an empty statement'} isn't supported")

    def create_table(self) -> CreateTable:
        table = self.name()
        self.need("(")
        columns: list[tuple[str, str]] = []
        key = None
        while True:
            if self.take("primary", "key"):
                self.need("(")
                names = self.listed(self.name)
                self.need(")")
                if len(names) > 1 or key:
                    raise EngineError("a primary key has one column")
                key = names[0]
            else:
                columns.append((self.name(), self.kind()))
                if self.now.text not in (",", ")"):
                    raise EngineError("column constraints aren't supported")
            if not self.take(","):
                break
        self.need(")")
        return CreateTable(table, columns, key)

    def insert(self) -> Insert:
        table = self.name()
        if self.take("values"):

            def row():
                self.need("(")
                out = self.listed(self.expression)
                self.need(")")
                return out

            return Insert(table, self.listed(row), None)
        if self.take("("):
            if self.now.text != "select":
                raise EngineError("INSERT into listed columns isn't supported")
            out = Insert(table, None, self.select())
            self.need(")")
            return out
        raise EngineError("INSERT needs VALUES or a SELECT in parentheses")

    def select(self) -> Select:
        self.need("select")
        distinct = self.take("distinct")
        items = self.listed(self.item)
        if not self.take("from"):
            raise EngineError("a SELECT needs FROM")
        tables = self.listed(self.table)
        if self.now.text in ("join", "inner", "left", "right", "full", "cross", "natural"):
            raise EngineError("joins are written with commas and WHERE")
        out = Select(items, tables, distinct=distinct)
        if self.take("where"):
            out.where = self.expression()
        if self.take("group", "by"):
            out.group = self.listed(self.expression)
        if self.take("having"):
            out.having = self.expression()
        if self.take("order", "by"):
            out.order = self.listed(lambda: (self.expression(), not self.take("desc") and (self.take("asc") or True)))
        if self.take("limit"):
            out.limit = self.whole()
        if self.take("offset"):
            out.offset = self.whole()
        return out

    def whole(self) -> int:
        t = self.now
        if t.kind != "number" or not t.text.isdigit():
            raise EngineError("expected a whole number")
        self.i += 1
        return int(t.text)

    def item(self) -> tuple[Any, str | None]:
        if self.take("*"):
            return Star(), None
        part = self.all[self.i : self.i + 3]
        if len(part) == 3 and part[0].kind in ("name", "exact") and part[1].text == "." and part[2].text == "*":
            self.i += 3
            return Star(part[0].text), None
        out = self.expression()
        if self.take("as"):
            return out, self.name()
        return out, self.name() if self.now.kind == "exact" or (self.now.kind == "name" and self.now.text not in _CLAUSES) else None

    def table(self) -> tuple[str, str]:
        if self.take("("):
            raise EngineError("subqueries aren't supported")
        name = self.name()
        if self.take("as"):
            return name, self.name()
        return name, self.name() if self.now.kind == "exact" or (self.now.kind == "name" and self.now.text not in _CLAUSES) else name


def parse(sql: str) -> list:
    """All statements of a script."""
    p, out = Parser(sql), []
    while True:
        while p.take(";"):
            pass
        if p.now.kind == "end":
            return out
        out.append(p.statement())
        if p.now.kind != "end" and not p.take(";"):
            raise EngineError(f"can't go on at {p.now.text!r}")
