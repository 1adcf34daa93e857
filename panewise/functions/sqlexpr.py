"""Column expressions that are put together as SQL text.

The rule catalogues make expressions of thousands of nodes. Built node by node, each node
costs several calls into the JVM and planning takes longer than a small scan; as text, an
expression is one ``expr`` call. ``F`` reads like ``pyspark.sql.functions`` and its results
are ordinary columns, so both kinds mix freely.
"""

from __future__ import annotations

import inspect
import itertools

from pyspark.sql import functions as native
from pyspark.sql.classic.column import Column as _Column

from ..tables import sql_literal

_names = itertools.count(1)
#: functions whose text arguments from this position on are literals, not column names
_LITERALS_FROM = {
    "array_contains": 1, "array_join": 1, "element_at": 1, "from_json": 1, "lpad": 1, "rpad": 1,
    "map_contains_key": 1, "regexp_extract": 1, "regexp_replace": 1, "split": 1,
    "substring_index": 1, "translate": 1, "try_variant_get": 1, "decode": 1, "contains": 1,
}
_SQL_NAMES = {"create_map": "map"}


class SqlColumn(_Column):
    """A column that knows its SQL text; it reaches the JVM when a DataFrame first uses it."""

    def __new__(cls, text: str, chain: str = "", cases: tuple = ()):
        return object.__new__(cls)

    def __init__(self, text: str, chain: str = "", cases: tuple = ()):
        self.text, self._chain, self._cases, self._java = text, chain, cases, None

    @property
    def _jc(self):
        if self._java is None:
            self._java = native.expr(self.text)._jc
        return self._java

    def __repr__(self) -> str:
        return f"SqlColumn<{self.text}>"

    __hash__ = object.__hash__

    def _binary(self, op: str, other, method: str, chain: str = ""):
        if isinstance(other, _Column) and not isinstance(other, SqlColumn):
            return getattr(_Column, method)(self, other)
        left, right = self.text, text_of(other)
        if chain and self._chain == chain:
            left = left[1:-1]  # a longer chain needs no deeper nesting
        return SqlColumn(f"({left} {op} {right})", chain)

    def __and__(self, other):
        return self._binary("AND", other, "__and__", "AND")

    def __or__(self, other):
        return self._binary("OR", other, "__or__", "OR")

    def __invert__(self):
        return SqlColumn(f"(NOT {self.text})")

    def __eq__(self, other):
        return self._binary("=", other, "__eq__")

    def __ne__(self, other):
        return self._binary("!=", other, "__ne__")

    def __lt__(self, other):
        return self._binary("<", other, "__lt__")

    def __le__(self, other):
        return self._binary("<=", other, "__le__")

    def __gt__(self, other):
        return self._binary(">", other, "__gt__")

    def __ge__(self, other):
        return self._binary(">=", other, "__ge__")

    def __add__(self, other):
        return self._binary("+", other, "__add__", "+")

    def __sub__(self, other):
        return self._binary("-", other, "__sub__")

    def __mul__(self, other):
        return self._binary("*", other, "__mul__")

    def __truediv__(self, other):
        return self._binary("/", other, "__truediv__")

    def __mod__(self, other):
        return self._binary("%", other, "__mod__")

    def __getitem__(self, key):
        if isinstance(key, str):
            return SqlColumn(f"{self.text}.{quoted(key)}")
        return SqlColumn(f"{self.text}[{text_of(key)}]")

    def alias(self, *names, **kwargs):
        if len(names) > 1:
            return super().alias(*names, **kwargs)
        return SqlColumn(f"{self.text} AS {quoted(names[0])}")

    def cast(self, to):
        return SqlColumn(f"CAST({self.text} AS {to})")

    def isNull(self):
        return SqlColumn(f"({self.text} IS NULL)")

    def isNotNull(self):
        return SqlColumn(f"({self.text} IS NOT NULL)")

    def isin(self, *values):
        return SqlColumn(f"({self.text} IN ({', '.join(text_of(v) for v in values)}))")

    def between(self, low, high):
        return SqlColumn(f"({self.text} BETWEEN {text_of(low)} AND {text_of(high)})")

    def contains(self, other):
        return SqlColumn(f"contains({self.text}, {text_of(other)})")

    def startswith(self, other):
        return SqlColumn(f"startswith({self.text}, {text_of(other)})")

    def endswith(self, other):
        return SqlColumn(f"endswith({self.text}, {text_of(other)})")

    def rlike(self, other):
        return SqlColumn(f"rlike({self.text}, {text_of(other)})")

    def when(self, condition, value):
        return _case((*self._cases, (text_of(condition), text_of(value))))

    def otherwise(self, value):
        return _case(self._cases, text_of(value))


def _case(cases: tuple, default: str | None = None) -> SqlColumn:
    body = " ".join(f"WHEN {c} THEN {v}" for c, v in cases)
    tail = "" if default is None else f" ELSE {default}"
    return SqlColumn(f"CASE {body}{tail} END", cases=cases)


def quoted(path: str) -> str:
    return ".".join(f"`{part}`" for part in path.split("."))


def text_of(value) -> str:
    """SQL text of a column or a Python value."""
    if isinstance(value, SqlColumn):
        return value.text
    if isinstance(value, _Column):
        raise TypeError(f"a column without SQL text cannot be part of this expression: {value}")
    if isinstance(value, float):
        return f"{value!r}D"
    return sql_literal(value) if value is not None else "NULL"


def _argument(name: str, position: int, value) -> str:
    if isinstance(value, str) and position < _LITERALS_FROM.get(name, 99):
        return value if value == "*" else quoted(value)
    return text_of(value)


def _lambda(function) -> str:
    parameters = inspect.signature(function).parameters.values()
    plain = [p for p in parameters if p.kind is p.POSITIONAL_OR_KEYWORD and p.default is p.empty]
    names = [f"v{next(_names)}" for _ in plain or [None]]
    body = function(*[SqlColumn(quoted(n)) for n in names])
    head = names[0] if len(names) == 1 else "(" + ", ".join(names) + ")"
    return f"{head} -> {body.text}"


class _Functions:
    """``pyspark.sql.functions`` for SqlColumn."""

    def __getattr__(self, name: str):
        sql_name = _SQL_NAMES.get(name, name)

        def call(*args):
            parts = [
                _lambda(a) if callable(a) and not isinstance(a, _Column) else _argument(name, i, a)
                for i, a in enumerate(args)
            ]
            return SqlColumn(f"{sql_name}({', '.join(parts)})")

        return call

    broadcast = staticmethod(native.broadcast)
    desc = staticmethod(native.desc)

    @staticmethod
    def col(name: str) -> SqlColumn:
        return SqlColumn(quoted(name))

    @staticmethod
    def lit(value) -> SqlColumn:
        return SqlColumn(text_of(value))

    @staticmethod
    def expr(text: str) -> SqlColumn:
        return SqlColumn(text)

    @staticmethod
    def when(condition, value) -> SqlColumn:
        return _case(((text_of(condition), text_of(value)),))

    @staticmethod
    def ltrim(text, characters) -> SqlColumn:
        return SqlColumn(f"ltrim({text_of(characters)}, {_argument('ltrim', 0, text)})")

    @staticmethod
    def rtrim(text, characters) -> SqlColumn:
        return SqlColumn(f"rtrim({text_of(characters)}, {_argument('rtrim', 0, text)})")

    @staticmethod
    def count_distinct(column) -> SqlColumn:
        return SqlColumn(f"count(DISTINCT {_argument('count', 0, column)})")

    @staticmethod
    def concat_ws(separator: str, *columns) -> SqlColumn:
        parts = ", ".join(_argument("concat_ws", 0, c) for c in columns)
        return SqlColumn(f"concat_ws({text_of(separator)}, {parts})")

    @staticmethod
    def try_variant_get(value, path: str, to: str) -> SqlColumn:
        return SqlColumn(
            f"try_variant_get({_argument('v', 0, value)}, {text_of(path)}, {text_of(to)})"
        )

    @staticmethod
    def from_json(value, schema: str, options: dict | None = None) -> SqlColumn:
        return SqlColumn(f"from_json({_argument('v', 0, value)}, {text_of(schema)})")


F = _Functions()
