"""Matches of several patterns in whole documents, in one pass over Arrow batches outside the JVM.

The JVM's functions would run each pattern once for every group and once more for the places,
copy the list of matches for each match, and exhaust their stack on deeply nested hrefs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf


@dataclass(frozen=True)
class Pattern:
    """A pattern, its groups by name, and a string in lower case that every match holds."""

    pattern: str
    groups: dict[str, int]
    needle: str

    @property
    def kind(self) -> pa.DataType:
        return pa.struct([*((x, pa.int32()) for x in ("s", "e", "line", "gap")), *((x, pa.string()) for x in self.groups)])

    @property
    def sql(self) -> str:
        return f"array<struct<s:int,e:int,line:int,gap:int,{','.join(f'{x}:string' for x in self.groups)}>>"


def _blanks_before(text: str, at: int, least: int) -> int:
    n = 0
    while at - n > least and text[at - n - 1] in " \t":
        n += 1
    return n


def _lists(texts: list[str | None], lowered: list[str | None], wanted: Pattern) -> pa.ListArray:
    columns: list[list] = [[] for _ in range(4 + len(wanted.groups))]
    compiled, places, ends = re.compile(wanted.pattern), list(wanted.groups.values()), [0]
    for text, low in zip(texts, lowered, strict=True):
        if text is not None and wanted.needle in low:
            last, line = 0, 1
            for m in compiled.finditer(text):
                start, end = m.span()
                line += text.count("\n", last, start)
                for column, value in zip(columns, (start, end, line, _blanks_before(text, start, last), *(m[k] or "" for k in places)), strict=True):
                    column.append(value)
                line += text.count("\n", start, end)
                last = end
        ends.append(len(columns[0]))
    rows = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, wanted.kind, strict=True)], fields=list(wanted.kind))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def scanner(patterns: dict[str, Pattern]) -> Callable[[Column], Column]:
    """Text to a struct with, for each name, the matches in order: array<struct<s, e, line, gap int, *groups string>>.

    Offsets count code points, ends are exclusive, lines count from 1; gap: spaces and tabs right
    before the match, not counting those of the match before; a group that took no part is empty.
    A null text has no matches.
    """

    def run(texts: pa.Array) -> pa.Array:
        plain = texts.to_pylist()
        lowered = [None if x is None else x.lower() for x in plain]
        return pa.StructArray.from_arrays([_lists(plain, lowered, x) for x in patterns.values()], list(patterns))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return arrow_udf(run, f"struct<{','.join(f'{name}:{x.sql}' for name, x in patterns.items())}>")
