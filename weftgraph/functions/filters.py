"""The compact filter language for attributes, compiled to Columns that Catalyst can push down.

    *                 defined            !f            defined and not f
    =x ==x <x <=x >x >=x                 a,b,c         one of
    (a,b) [a,b) (a,b] [a,b]              regex(p)      contains a match
    all(f) forall(f) Ɐ(f)                any(f) some(f) exists(f) ∃(f)
    [a,b],[c,d]       box of positions   "..."         quoted text, with \\" and \\\\

An undefined value matches no filter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTED = r'"(?:[^"\\]|\\.)*"'
_ATOM = rf'(?:{_QUOTED}|[^,()\[\]"]*)'
_INTERVAL = re.compile(rf"\s*([\[(])\s*({_ATOM})\s*,\s*({_ATOM})\s*([\])])\s*")
_CALL = re.compile(r"(\w+|Ɐ|∃)\((.*)\)", re.S)
_COMPARE = re.compile(r"(==|=|<=|>=|<|>)(.*)", re.S)
_ALL, _ANY, _REGEX = {"all", "forall", "Ɐ"}, {"any", "some", "exists", "∃"}, {"regex", "regexp"}


class FilterError(ValueError):
    """A filter that does not fit the language or the attribute's type."""


def _text(atom: str) -> str:
    atom = atom.strip()
    return re.sub(r"\\(.)", r"\1", atom[1:-1]) if len(atom) > 1 and atom[0] == atom[-1] == '"' else atom


def _value(atom: str, kind: T.DataType):
    text = _text(atom)
    try:
        if isinstance(kind, T.FractionalType):
            return float(text)
        if isinstance(kind, T.IntegralType):
            return int(text)
    except ValueError:
        raise FilterError(f"{text!r} is no {kind.simpleString()}") from None
    if isinstance(kind, T.StringType):
        return text
    raise FilterError(f"no comparison for {kind.simpleString()}")


def _split(text: str) -> list[str]:
    return [m.group(1) for m in re.finditer(rf"({_QUOTED}|[^,]*)(?:,|$)", text)][: text.count(",") + 1] if '"' not in text else [x for x in re.findall(rf"{_QUOTED}|[^,]+", text)]


def _interval(x: Column, kind: T.DataType, m: re.Match) -> Column:
    low, high = _value(m.group(2), kind), _value(m.group(3), kind)
    left = x >= F.lit(low) if m.group(1) == "[" else x > F.lit(low)
    return left & (x <= F.lit(high) if m.group(4) == "]" else x < F.lit(high))


def _predicate(x: Column, kind: T.DataType, text: str) -> Column:
    text = text.strip()
    if text in ("", "*"):
        return x.isNotNull()
    if text.startswith("!"):
        return ~_predicate(x, kind, text[1:])
    call = _CALL.fullmatch(text)
    if call and call.group(1) in _ALL | _ANY:
        if not isinstance(kind, T.ArrayType):
            raise FilterError(f"{call.group(1)} is for vectors")
        test = F.forall if call.group(1) in _ALL else F.exists
        return test(x, lambda e: _predicate(e, kind.elementType, call.group(2)))
    if call and call.group(1) in _REGEX:
        if not isinstance(kind, T.StringType):
            raise FilterError("regex is for text")
        return x.rlike(_text(call.group(2)))
    if isinstance(kind, T.ArrayType):
        boxes = list(_INTERVAL.finditer(text))
        if not boxes or _INTERVAL.sub("", text).replace(",", "").strip():
            raise FilterError(f"no filter for vectors: {text!r}")
        tests = [_interval(F.get(x, F.lit(i)), kind.elementType, m) for i, m in enumerate(boxes)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out
    if m := _COMPARE.fullmatch(text):
        v = F.lit(_value(m.group(2), kind))
        return {"=": x == v, "==": x == v, "<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[m.group(1)]
    if m := _INTERVAL.fullmatch(text):
        return _interval(x, kind, m)
    return x.isin([_value(a, kind) for a in _split(text)])


def predicate(name: str, kind: T.DataType, text: str) -> Column:
    """The filter ``text`` on the column ``name``; never null."""
    x = F.col(f"`{name}`")
    return x.isNotNull() & F.coalesce(_predicate(x, kind, text), F.lit(False))
