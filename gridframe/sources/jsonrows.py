"""Matrices in JSON, row by row: the text is walked once and only one row of numbers is held."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

#: Names under which an object may hold its matrix; the first that is there and not null counts.
NAMES = ("data", "grid", "values")
SPACE = re.compile(r"[ \t\r\n\ufeff]*")
#: What matters for skipping a value: strings and brackets.
MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]')
PLAIN = re.compile(r"[^\s,\]}]+")


def _skip(text: str, at: int) -> int:
    return SPACE.match(text, at).end()


def _expect(text: str, at: int, mark: str) -> int:
    if text[at : at + 1] != mark:
        raise ValueError(f"'{mark}' expected at {at}, found '{text[at : at + 10]}'" if at < len(text) else f"ends where '{mark}' is expected")
    return _skip(text, at + 1)


def _after(text: str, at: int) -> int:
    """The place behind the value that begins at ``at``."""
    if text[at : at + 1] not in ("[", "{", '"'):
        plain = PLAIN.match(text, at)
        if not plain:
            raise ValueError(f"value expected at {at}")
        return plain.end()
    depth = 0
    for mark in MARKS.finditer(text, at):
        depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(mark[0], 0)
        if depth == 0:
            return mark.end()
    raise ValueError("ends inside a value")


def _payload(text: str) -> int:
    """Where the matrix begins."""
    at = _skip(text, 0)
    if text[at : at + 1] != "{":
        return at
    found: dict[str, int] = {}
    at = _expect(text, at, "{")
    while text[at : at + 1] != "}":
        if text[at : at + 1] != '"':
            raise ValueError(f"name expected at {at}")
        name, at = json.decoder.scanstring(text, at + 1)
        at = _expect(text, _skip(text, at), ":")
        end = _after(text, at)
        if name in NAMES and text[at:end] != "null":
            found[name] = at
        at = _skip(text, end)
        if text[at : at + 1] != "}":
            at = _expect(text, at, ",")
    for name in NAMES:
        if name in found:
            return found[name]
    raise ValueError("no data, grid or values in the object")


def _row(text: str, at: int, width: int | None) -> tuple[list[float | None], int]:
    end = text.find("]", at)
    if end < 0:
        raise ValueError("ends inside a row")
    try:
        row = json.loads(text[at : end + 1])
    except json.JSONDecodeError as error:
        raise ValueError(f"row at {at}: {error.msg}") from None
    for x in row:
        if x is not None and (isinstance(x, bool) or not isinstance(x, (int, float))):
            raise ValueError(f"row at {at} holds {x!r}, which is no number")
    if width is not None and len(row) != width:
        raise ValueError(f"row at {at} has {len(row)} values, others have {width}")
    return [None if x is None else float(x) for x in row], _skip(text, end + 1)


def matrix_rows(text: str) -> Iterator[tuple[int, int, list[float | None]]]:
    """(t, y, values) for each row of [y][x] or [t][y][x]; ValueError at the first place that is not as it should be.

    Rows that come before that place have been yielded by then. All rows of a matrix have one length.
    """
    at = _expect(text, _payload(text), "[")
    if text[at : at + 1] != "[":
        raise ValueError(f"row expected at {at}")
    deep = text[_skip(text, at + 1) : _skip(text, at + 1) + 1] == "["
    t, width, height = 0, None, None
    while True:
        if deep:
            at = _expect(text, at, "[")
        y = 0
        while True:
            if text[at : at + 1] != "[":
                raise ValueError(f"row expected at {at}" if at < len(text) else "ends where a row is expected")
            row, at = _row(text, at, width)
            width = len(row)
            yield t, y, row
            y += 1
            if text[at : at + 1] == "]":
                at = _skip(text, at + 1)
                break
            at = _expect(text, at, ",")
        if not deep:
            return
        if height is not None and y != height:
            raise ValueError(f"step {t} has {y} rows, others have {height}")
        t, height = t + 1, y
        if text[at : at + 1] == "]":
            return
        at = _expect(text, at, ",")
